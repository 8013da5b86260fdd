"""Chunked array stores (Zarr, format 2) as a source of long rows, a partition for each chunk that is wanted, and as a sink.

    spark.dataSource.register(ZarrSource)
    spark.read.format("zarr").option("variable", "mslp").option("south", -60).option("start", "1979-01-01").load(path)

Rows are (time, [level,] lat, lon, value), or with a model calendar (day, second, calendar, ...). A box (south, north, west, east) and
a period (start, stop; both included) choose chunks before any is read, and then rows. Where the session has
spark.sql.python.filterPushdown.enabled and the option pushdown is true, as read_zarr sets it then, plain comparisons of lat, lon, level,
time and day choose chunks too. Longitudes are compared as they are stored.
"""

from __future__ import annotations

import datetime as dt
import gzip
import json
import math
import posixpath
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from trendloom.functions.calendar import DEFAULT_YEAR_DAYS, REAL, UNIT_SECONDS, YEAR_DAYS, month_starts
from trendloom.session import move, names_in, remove

#: The names that axes go by, and the column of each.
AXES = {"time": "time", "valid_time": "time", "level": "level", "pressure_level": "level", "lat": "lat", "latitude": "lat", "lon": "lon", "longitude": "lon"}
#: Values of a chunk that is written, at most, and rows of a batch that is read.
CHUNK_VALUES, BATCH_ROWS = 4_000_000, 1 << 17


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_bytes(path: str) -> bytes | None:
    """The bytes of a file; None if there is none."""
    system, at = file_system(path)
    try:
        with system.open_input_stream(at) as f:
            return f.read()
    except FileNotFoundError:
        return None


def write_bytes(path: str, data: bytes) -> None:
    system, at = file_system(path)
    system.create_dir(posixpath.dirname(at), recursive=True)
    with system.open_output_stream(at) as f:
        f.write(data)


def unpacked(data: bytes, compressor: dict | None) -> bytes:
    kind = (compressor or {}).get("id")
    if kind is None:
        return data
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if kind == "zlib":
        return zlib.decompress(data)
    if kind == "gzip":
        return gzip.decompress(data)
    raise ValueError(f"no decompressor for {kind}")


def packed(data: bytes, compressor: dict | None) -> bytes:
    if compressor is None:
        return data
    import zstandard

    return zstandard.ZstdCompressor(level=compressor.get("level", 3)).compress(data)


@dataclass(frozen=True)
class Array:
    """The metadata of one array of a store."""

    path: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    order: str
    compressor: dict | None
    fill: float | None
    separator: str
    axes: tuple[str, ...]
    attributes: dict

    @classmethod
    def open(cls, store: str, name: str, metadata: dict | None = None) -> Array:
        """From consolidated metadata where there are such, else from the array's own files."""
        def part(kind: str) -> dict | None:
            if metadata is not None:
                return metadata.get(f"{name}/{kind}")
            raw = read_bytes(f"{store}/{name}/{kind}")
            return json.loads(raw) if raw else None

        made, attributes = part(".zarray"), part(".zattrs") or {}
        if made is None:
            raise KeyError(f"{store} has no array {name}")
        if made.get("zarr_format") != 2 or made.get("filters"):
            raise ValueError(f"{name}: only arrays of format 2 without filters are read")
        fill = made.get("fill_value")
        return cls(f"{store}/{name}", tuple(made["shape"]), tuple(made["chunks"]), made["dtype"], made.get("order", "C"), made.get("compressor"),
                   None if fill is None else float(fill), made.get("dimension_separator", "."), tuple(attributes.get("_ARRAY_DIMENSIONS", ())), attributes)

    def chunk(self, at: Sequence[int]) -> np.ndarray:
        """A chunk, cut where it reaches over the edge; a chunk that isn't stored is the fill value."""
        raw = read_bytes(f"{self.path}/{self.separator.join(map(str, at)) or '0'}")
        if raw is None:
            values = np.full(self.chunks, math.nan if self.fill is None else self.fill, np.dtype(self.dtype) if self.fill is not None and not math.isnan(self.fill) else np.float64)
        else:
            values = np.frombuffer(unpacked(raw, self.compressor), self.dtype).reshape(self.chunks, order=self.order)
        return values[tuple(slice(0, min(c, n - i * c)) for i, c, n in zip(at, self.chunks, self.shape))]

    def decoded(self, at: Sequence[int]) -> np.ndarray:
        """A chunk as doubles, missing values as NaN, scale and offset applied."""
        values, missing = self.chunk(at), [self.attributes.get(k) for k in ("_FillValue", "missing_value")]
        out = values.astype(np.float64)
        for m in [x for x in missing if x is not None]:
            out[values == np.asarray(m).astype(values.dtype)] = np.nan
        return out * self.attributes.get("scale_factor", 1.0) + self.attributes.get("add_offset", 0.0)

    def whole(self) -> np.ndarray:
        """A coordinate, which is one array in memory."""
        parts = [self.chunk((i,)) for i in range(-(-self.shape[0] // self.chunks[0]))]
        return np.concatenate(parts) if parts else np.empty(0)


def moments(values: np.ndarray, units: str, calendar: str) -> tuple[np.ndarray, np.ndarray]:
    """(day, second) of a time axis: days since the start of 1970 in the calendar, and seconds of the day."""
    unit, _, start = units.strip().split(None, 2)
    date, _, clock = start.replace("T", " ").partition(" ")
    year, month, day = map(int, date.split("-"))
    if calendar in REAL:
        first = (dt.date(year, month, day) - dt.date(1970, 1, 1)).days
    else:
        days = int(YEAR_DAYS.get(calendar, DEFAULT_YEAR_DAYS))
        if calendar not in YEAR_DAYS:
            raise ValueError(f"unknown calendar: {calendar}")
        first = (year - 1970) * days + month_starts(days)[month - 1] + day - 1
    clock = [float(x) for x in clock.replace("Z", "").replace("UTC", "").strip().split(":") if x]
    whole = np.floor(values).astype(np.int64)
    size = UNIT_SECONDS[unit.lower().removesuffix("s")]
    seconds = whole * size + np.round((values - np.floor(values)) * size).astype(np.int64) + int(sum(x * s for x, s in zip(clock, (3600, 60, 1))))
    return (first + seconds // 86_400).astype(np.int64), seconds % 86_400


@dataclass(frozen=True)
class Chunk(InputPartition):
    """One chunk and the places of its axes, so that a task reads nothing else."""

    at: tuple[int, ...]
    places: tuple[np.ndarray, ...]


class Store:
    """An array of a store with its coordinates."""

    def __init__(self, path: str, variable: str | None):
        self.path = path.rstrip("/")
        raw = read_bytes(f"{self.path}/.zmetadata")
        metadata = json.loads(raw)["metadata"] if raw else None
        if variable is None:
            names = sorted({k.rsplit("/", 1)[0] for k in metadata or {} if k.endswith("/.zarray")} - set(AXES))
            if len(names) != 1:
                raise ValueError(f"name one variable of {self.path}: {', '.join(names)}")
            variable = names[0]
        self.array = Array.open(self.path, variable, metadata)
        if unknown := [a for a in self.array.axes if a not in AXES] or not self.array.axes:
            raise ValueError(f"{variable}: axes have to be time, level, latitude and longitude, not {unknown or 'none'}")
        self.coordinates = [Array.open(self.path, a, metadata) for a in self.array.axes]
        self.columns = [AXES[a] for a in self.array.axes]
        time = next((c for c, n in zip(self.coordinates, self.columns) if n == "time"), None)
        self.calendar = time.attributes.get("calendar", "standard").lower() if time else "standard"

    def schema(self) -> str:
        real = self.calendar in REAL
        names = {"time": "time timestamp" if real else "day int, second int, calendar string"}
        return ", ".join([*(names.get(c, f"{c} double") for c in self.columns), "value double"])

    def places(self) -> list[np.ndarray]:
        """Of each axis: numbers, or for time the microseconds since the start of 1970 in the calendar."""
        out = []
        for column, c in zip(self.columns, self.coordinates):
            values = c.whole().astype(np.float64)
            if column == "time":
                day, second = moments(values, c.attributes["units"], self.calendar)
                out.append((day * 86_400 + second) * 1_000_000)
            else:
                out.append(values)
        return out


def micros(text: str, end: bool = False) -> int:
    """Of a date or a moment; with `end`, the last of a date's."""
    moment = dt.datetime.fromisoformat(text.strip())
    if moment.tzinfo:
        moment = moment.astimezone(dt.UTC).replace(tzinfo=None)
    out = (moment - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    return out + 86_400_000_000 - 1 if end and len(text.strip()) == 10 else out


class ZarrReader(DataSourceReader):
    def __init__(self, store: Store, options: dict):
        self.store = store
        low, high = -math.inf, math.inf
        get = lambda name, default: float(options[name]) if name in options else default
        self.bounds = {"lat": (get("south", low), get("north", high)), "lon": (get("west", low), get("east", high)), "level": (get("level", low), get("level", high)),
                       "time": (micros(options["start"]) if "start" in options else low, micros(options["stop"], True) if "stop" in options else high)}
        self.pushed: list[tuple[str, float, float]] = []

    def narrow(self, column: str, low, high) -> None:
        def place(x, end):
            if column == "day":
                return (int(x) + end) * 86_400_000_000 - end
            if isinstance(x, dt.datetime):
                return (x.astimezone(dt.UTC).replace(tzinfo=None) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
            return float(x)

        self.pushed.append(("time" if column == "day" else column, -math.inf if low is None else place(low, 0), math.inf if high is None else place(high, 1)))

    def partitions(self) -> list[Chunk]:
        """A chunk each that has a place within all bounds on every axis."""
        wanted = []
        for column, places, size, n in zip(self.store.columns, self.store.places(), self.store.array.chunks, self.store.array.shape):
            (low, high), own = self.bounds[column], []
            narrowed = [(a, b) for c, a, b in self.pushed if c == column]
            for i in range(-(-n // size)):
                x = places[i * size : (i + 1) * size]
                if ((x >= low) & (x <= high)).any() and all(((x >= a) & (x <= b)).any() for a, b in narrowed):
                    own.append((i, x))
            wanted.append(own)
        out: list[tuple] = [((), ())]
        for own in wanted:
            out = [(at + (i,), places + (x,)) for at, places in out for i, x in own]
        return [Chunk(at, places) for at, places in out]

    def read(self, partition: Chunk | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no chunk is wanted
            return
        values, columns, real = self.store.array.decoded(partition.at), self.store.columns, self.store.calendar in REAL
        inside = [np.flatnonzero((x >= self.bounds[c][0]) & (x <= self.bounds[c][1])) for c, x in zip(columns, partition.places)]
        values = values[np.ix_(*inside)]
        places = [x[i] for x, i in zip(partition.places, inside)]
        for start in range(0, values.size, BATCH_ROWS):
            at = np.unravel_index(np.arange(start, min(start + BATCH_ROWS, values.size)), values.shape)
            arrays: dict[str, pa.Array] = {}
            for column, x, i in zip(columns, places, at):
                if column == "time" and real:
                    arrays["time"] = pa.array(x[i].astype(np.int64), pa.timestamp("us", "UTC"))
                elif column == "time":
                    arrays |= {"day": pa.array((x[i] // 86_400_000_000).astype(np.int32)), "second": pa.array((x[i] % 86_400_000_000 // 1_000_000).astype(np.int32)), "calendar": pa.array([self.store.calendar] * len(i))}
                else:
                    arrays[column] = pa.array(x[i])
            value = values[at]
            arrays["value"] = pa.array(value, mask=np.isnan(value))
            yield pa.RecordBatch.from_pydict(arrays)


class NarrowingZarrReader(ZarrReader):
    """Takes filters too, which Spark allows only where the session has switched it on."""

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in (*self.bounds, "day"):
                if isinstance(f, EqualTo):
                    self.narrow(column, f.value, f.value)
                elif isinstance(f, In):
                    values = [v for v in f.value if v is not None]
                    if values:
                        self.narrow(column, min(values), max(values))
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.narrow(column, f.value, None)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.narrow(column, None, f.value)
            yield f  # chunks are chosen, rows are still Spark's to test


class ZarrSource(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "zarr"

    def store(self) -> Store:
        return Store(self.options["path"], self.options.get("variable"))

    def schema(self) -> str:
        return self.store().schema()

    def reader(self, schema: StructType) -> ZarrReader:
        kind = NarrowingZarrReader if self.options.get("pushdown", "").lower() == "true" else ZarrReader
        return kind(self.store(), dict(self.options))


def read_zarr(spark: SparkSession, path: str, variable: str | None = None, **options) -> DataFrame:
    spark.dataSource.register(ZarrSource)
    named = {"variable": variable} if variable else {}
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("zarr").options(pushdown=pushdown, **named, **options).load(path)


def write_zarr(field: DataFrame, path: str, variable: str, time_chunk: int = 200, replace: bool = False, lat_descends: bool = True) -> bool:
    """Writes a field (time, lat, lon, value), or (day, second, calendar, ...) of one model calendar; False if the store is there already.

    A chunk has up to time_chunk moments of the whole grid, fewer where they would be over CHUNK_VALUES, and is one group of rows, so a
    task holds a chunk. Moments, latitudes and longitudes are the store's axes and stand on the driver. A value that is missing, or
    has no row, is NaN. The store is made beside its place and renamed when it is whole; of rows for one cell and moment the mean counts.
    """
    spark = field.sparkSession
    if not replace and names_in(spark, path):
        return False
    model = "calendar" in field.columns
    moment = F.col("day").cast("long") * 86_400 + F.col("second") if model else F.col("time").cast("timestamp").cast("long")
    rows = field.select(moment.alias("t"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col("value").cast("double").alias("value"))
    calendar = field.select("calendar").first()[0] if model else "standard"
    axes = {c: sorted((r[0] for r in rows.select(c).distinct().collect()), reverse=c == "lat" and lat_descends) for c in ("t", "lat", "lon")}
    cells = max(len(axes["lat"]) * len(axes["lon"]), 1)
    size = max(1, min(time_chunk, CHUNK_VALUES // cells, max(len(axes["t"]), 1)))
    draft, shape = f"{path}.{uuid.uuid4().hex}", (size, len(axes["lat"]), len(axes["lon"]))
    target = draft.removeprefix("file:") if draft.startswith("file:/") and not draft.startswith("file://") else draft
    numbered = rows
    for c in axes:
        order = Window.orderBy(F.desc(c) if c == "lat" and lat_descends else c)
        place = rows.select(c).distinct().select(c, (F.row_number().over(order) - 1).alias(f"{c}_at"))  # an axis
        numbered = numbered.join(F.broadcast(place), c)
    compressor, kind = {"id": "zstd", "level": 3}, "<f4"

    def write_chunk(table: pa.Table) -> pa.Table:
        at = [table[f"{c}_at"].to_numpy() for c in ("t", "lat", "lon")]
        index = int(at[0][0]) // size
        flat = np.ravel_multi_index((at[0] % size, at[1], at[2]), shape)
        value = table["value"].to_numpy()
        known = ~np.isnan(value)
        n = np.bincount(flat[known], minlength=math.prod(shape))
        with np.errstate(invalid="ignore"):
            values = np.bincount(flat[known], value[known], math.prod(shape)) / np.where(n, n, np.nan)
        write_bytes(f"{target}/{variable}/{index}.0.0", packed(values.astype(kind).tobytes(), compressor))
        return pa.table({"chunk": pa.array([index], pa.int64()), "n": pa.array([int(known.sum())], pa.int64())})

    chunk = F.floor(F.col("t_at") / size).cast("long")
    numbered.withColumn("chunk", chunk).groupBy("chunk").applyInArrow(write_chunk, "chunk long, n long").agg(F.sum("n")).collect()
    metadata: dict[str, dict] = {".zgroup": {"zarr_format": 2}, ".zattrs": {}}

    def array(name: str, shape: Sequence[int], chunks: Sequence[int], dtype: str, dims: list[str], packer: dict | None, **attributes) -> None:
        metadata[f"{name}/.zarray"] = {"zarr_format": 2, "shape": list(shape), "chunks": [max(c, 1) for c in chunks], "dtype": dtype, "compressor": packer,
                                       "fill_value": "NaN" if dtype == kind else None, "order": "C", "filters": None}
        metadata[f"{name}/.zattrs"] = {"_ARRAY_DIMENSIONS": dims} | attributes

    names = {"t": "time", "lat": "latitude", "lon": "longitude"}
    array(variable, [len(v) for v in axes.values()], shape, kind, list(names.values()), compressor)
    for c, values in axes.items():
        extra = {"units": "seconds since 1970-01-01", "calendar": calendar} if c == "t" else {}
        array(names[c], [len(values)], [len(values)], "<i8" if c == "t" else "<f8", [names[c]], None, **extra)
        write_bytes(f"{target}/{names[c]}/0", np.array(values, "<i8" if c == "t" else "<f8").tobytes())
    for name, content in metadata.items():
        write_bytes(f"{target}/{name}", json.dumps(content).encode())
    write_bytes(f"{target}/.zmetadata", json.dumps({"zarr_consolidated_format": 1, "metadata": metadata}).encode())
    if replace:
        remove(spark, path)
    move(spark, draft, path)
    return True
