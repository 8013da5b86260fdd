"""Files fetched over HTTP by Spark tasks, resumed where they broke off, with a list of what came and what failed."""

from __future__ import annotations

import posixpath
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.session import written
from trendloom.sources.zarr import file_system

PIECE_BYTES = 1 << 22
MANIFEST = pa.schema([("url", pa.string()), ("path", pa.string()), ("state", pa.string()), ("bytes", pa.int64()), ("tries", pa.int32()), ("error", pa.string())])


def yearly_files(spark: SparkSession, base_url: str, folder: str, variables: Sequence[str], start: int, end: int) -> DataFrame:
    """(url, path) of each variable and year, as BASE/VARIABLE/YEAR.VARIABLE.nc and under the same name in the folder."""
    name = F.concat_ws("/", F.col("variable"), F.concat_ws(".", "year", "variable", F.lit("nc")))
    years = spark.range(start, end + 1).select(F.col("id").cast("string").alias("year"))
    rows = spark.createDataFrame([(v,) for v in variables], "variable string").join(years, how="cross")
    return rows.select(F.concat(F.lit(base_url.rstrip("/") + "/"), name).alias("url"), F.concat(F.lit(folder.rstrip("/") + "/"), name).alias("path"))


def remote_size(url: str, timeout: float) -> int | None:
    """None if the server doesn't tell."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as answer:
            size = answer.headers.get("Content-Length")
            return None if size is None else int(size)
    except (urllib.error.URLError, OSError, ValueError):
        return None


class Target:
    """A file and the pieces of it that have come so far, on any file system: a piece is named by where it starts."""

    def __init__(self, path: str):
        self.system, self.path = file_system(path)
        self.folder, self.name = posixpath.split(self.path)

    def size(self) -> int | None:
        from pyarrow import fs

        info = self.system.get_file_info(self.path)
        return info.size if info.type == fs.FileType.File else None

    def pieces(self) -> list[tuple[int, str, int]]:
        """(start, path, bytes) from 0 on without a gap; what doesn't join on is deleted."""
        from pyarrow import fs

        found = []
        for info in self.system.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            start = info.base_name.removeprefix(f"{self.name}.part-")
            if start != info.base_name and start.isdigit():
                found.append((int(start), info.path, info.size))
        out, at = [], 0
        for start, path, size in sorted(found):
            if start == at and size:
                out.append((start, path, size))
                at += size
            else:
                self.system.delete_file(path)
        return out

    def drop_pieces(self) -> None:
        for _, path, _ in self.pieces():
            self.system.delete_file(path)

    def take(self, answer, start: int) -> None:
        """Adds a piece; what has come stays also if the connection breaks."""
        self.system.create_dir(self.folder, recursive=True)
        with self.system.open_output_stream(f"{self.path}.part-{start:020d}") as out:
            while data := answer.read(PIECE_BYTES):
                out.write(data)

    def finish(self) -> None:
        """One file of all pieces, which has its name only when it is whole."""
        pieces, draft = self.pieces(), f"{self.path}.{uuid.uuid4().hex}"
        with self.system.open_output_stream(draft) as out:
            for _, path, _ in pieces:
                with self.system.open_input_stream(path) as f:
                    while data := f.read(PIECE_BYTES):
                        out.write(data)
        if self.size() is not None:
            self.system.delete_file(self.path)
        self.system.move(draft, self.path)
        self.drop_pieces()


def fetch_one(url: str, path: str, tries: int, pause: float, timeout: float) -> tuple[str, int | None, int, str | None]:
    """(state, bytes, tries, error): `kept` if the file is there in whole, `fetched`, or `failed`."""
    target, expected, error = Target(path), remote_size(url, timeout), None
    if (size := target.size()) is not None and expected in (None, size):
        return "kept", size, 0, None
    for attempt in range(1, tries + 1):
        try:
            have = sum(n for _, _, n in target.pieces())
            if expected is not None and have > expected:
                target.drop_pieces()
                have = 0
            if expected is None or have < expected:
                headers = {"Range": f"bytes={have}-"} if have else {}
                with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
                    if have and answer.status == 200:  # the server starts again from the beginning
                        target.drop_pieces()
                        have = 0
                    target.take(answer, have)
                have = sum(n for _, _, n in target.pieces())
            if expected in (None, have):
                target.finish()
                return "fetched", have, attempt, None
            error = f"{have} of {expected} bytes"
        except Exception as e:  # noqa: BLE001 - one file that fails must not stop the others
            if isinstance(e, urllib.error.HTTPError) and e.code == 416:
                target.drop_pieces()  # they are not of this file
            error = f"{type(e).__name__}: {e}"
        if attempt < tries:
            time.sleep(pause * attempt)
    return "failed", None, tries, error


def fetch(wanted: DataFrame, at_once: int = 3, tries: int = 5, pause: float = 3.0, timeout: float = 60.0) -> DataFrame:
    """(url, path, state, bytes, tries, error) of each distinct (url, path): fetched, kept as it was, or failed.

    at_once tasks fetch, each one file after another. A file has its name only when all bytes that the server announces have
    come; what has come of it before is kept beside it, and the next try, or the next run, asks for the rest. A failure is a row of
    the result and stops nothing. The result is written, so that reading it again fetches nothing. Paths have to be ones that all
    executors reach, and speculative execution has to be off, as two copies of a task would write the same pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, path in zip(*(c.to_pylist() for c in batch.columns)):
                row = (url, path, *fetch_one(url, path, tries, pause, timeout))
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, MANIFEST)], schema=MANIFEST)

    rows = wanted.select("url", "path").filter("url is not null and path is not null").distinct().repartition(at_once)
    return written(rows.mapInArrow(run, "url string, path string, state string, bytes long, tries int, error string"), "fetched")
