"""Session construction and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", app: str = "trendloom", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` entries use `__` for dots."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a new local one, which is then set, if the session runs on this
    machine alone (local[...], as in tests); on a cluster an error, for executors would write to disks of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="trendloom-shared-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_root(spark)}/trendloom-{uuid.uuid4().hex}/{name}"


#: The workspaces that are open, the innermost last.
_open: list[Workspace] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back, so a lost executor costs no recomputation. While a
    Workspace is open the table is one of its own, and goes with it."""
    return _open[-1].written(df, name) if _open else write_to(df, shared_path(df.sparkSession, name))


def write_to(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reaches."""
    where, system = _file_system(spark, path)
    system.delete(where, True)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """What stands in a folder of any file system that Spark reaches; nothing if there is no such folder."""
    where, system = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(where)) if system.exists(where) else []


def move(spark: SparkSession, path: str, to: str) -> None:
    """Renames a folder; an error if it can't be."""
    where, system = _file_system(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(to)
    system.mkdirs(target.getParent())
    if not system.rename(where, target):
        raise OSError(f"{path} could not become {to}")


def mark(spark: SparkSession, path: str) -> None:
    """An empty file."""
    where, system = _file_system(spark, path)
    system.create(where, True).close()


class Workspace:
    """The intermediate tables of one run of an operator: `written` in a folder of their own, which goes when the run ends.

    The result has to be written outside of it before that, by `finish`, which puts it in the workspace that encloses this one, if
    any; a run that fails deletes its folder too.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.folder = spark, name, shared_path(spark, name)
        self.tables: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Workspace:
        _open.append(self)
        return self

    def __exit__(self, *failed) -> None:
        _open.remove(self)
        remove(self.spark, self.folder.rsplit("/", 1)[0])

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{len(self.tables)}-{name}"
        self.tables.append((write_to(df, path), path))
        return self.tables[-1][0]

    def together(self, *tables: DataFrame) -> DataFrame:
        """The rows of tables of this folder that have the same columns, as one scan: joins are not dealt out over its parts as over a union's."""
        paths = [path for table, path in self.tables if any(table is t for t in tables)]
        return self.spark.read.schema(tables[0].schema).parquet(*paths)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing later reads."""
        for table, path in self.tables:
            if any(table is t for t in tables):
                remove(self.spark, path)

    def finish(self, df: DataFrame) -> DataFrame:
        at = _open.index(self)
        return _open[at - 1].written(df, self.name) if at else write_to(df, shared_path(self.spark, self.name))
