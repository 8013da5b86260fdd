"""Principal components of a (day, cell) matrix, and projection of other fields onto them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.checks import unless
from trendloom.functions.statistics import clean, eof_weight
from trendloom.operators.blocks import array_block, keyed_blocks, rows_a_batch, summed
from trendloom.operators.fields import anomaly, coarsen, daily_mean, detrend, regrid, variable_scales
from trendloom.session import Workspace

#: Length of the shorter axis up to which all products of its members are summed at once: 32 MB of the driver and a task.
GRAM_SIDE = 2_000
#: Modes beyond those wanted that the iteration carries, blocks of a cycle, most cycles, and the residual at which it ends.
SPARE_MODES, CYCLE_BLOCKS, MOST_CYCLES, RESIDUAL = 10, 4, 60, 1e-12
#: Bytes of loadings that are sent to tasks at once.
LOADING_BYTES = 256 << 20


def with_same_keys(field: DataFrame) -> DataFrame:
    """The field; reading it is an error unless all variables have the same days and cells, told by one sum over the keys of each."""
    key = F.xxhash64("day", F.col("lat").cast("double"), F.col("lon").cast("double")).cast("decimal(38,0)")
    sums = field.groupBy("variable").agg(F.sum(key).alias("keys"), F.count("*").alias("n")).agg(F.count_distinct("keys", "n").alias("kinds"))
    return unless(field, sums, F.col("kinds") > 1, "the variables differ in their days or cells")


def prepare_like_observations(steps: DataFrame, grid: DataFrame, scales: DataFrame, factor: int = 1, detrended: bool = True, harmonics: int = 3) -> tuple[DataFrame, DataFrame]:
    """(matrix, cells) of a model's steps (variable, time, lat, lon, value), made like the observations that it is held against:
    regridded to their grid (lat, lon), daily means, anomalies of the model's own cycle, its trend taken out, coarsened, and divided
    by the scales (variable, scale) observed, not by its own. Steps of a model calendar have (day, second, calendar) for the time,
    and the days of the matrix are then numbers of days in it."""
    keys = ("variable", "lat", "lon")
    when = ("day", "second", "calendar") if "calendar" in steps.columns else ("time",)
    field = daily_mean(regrid(steps, grid, ("variable", *when)), keys)
    field = anomaly(field, harmonics, keys)
    matrix, cells, _ = prepare(detrend(field, keys) if detrended else field, factor, scales)
    return matrix, cells


def prepare(field: DataFrame, factor: int = 1, scales: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matrix, cells, scales) of a field (variable, day, lat, lon, value): coarsened, one scale a variable, weighted by area.

    matrix: (day, cell, value); cells: (cell, variable, lat, lon) in order of variable, latitude and longitude. Without scales
    (variable, scale) the field's own are taken. Variables that differ in their days or cells are an error.
    """
    field = coarsen(with_same_keys(field), factor, ("variable", "day"))
    scales = variable_scales(field) if scales is None else scales
    cells = field.select("variable", "lat", "lon").distinct()
    cells = cells.withColumn("cell", F.row_number().over(Window.orderBy("variable", "lat", "lon")) - 1)  # a row a cell
    value = clean(F.col("value")) / F.col("scale") * eof_weight(F.col("lat"))
    matrix = field.join(F.broadcast(scales), "variable").join(cells, ["variable", "lat", "lon"]).select("day", "cell", value.alias("value"))
    return matrix, cells, scales


def centred(matrix: DataFrame, key: str = "day") -> DataFrame:
    matrix = matrix.withColumn("value", clean(F.col("value")))
    means = matrix.groupBy("cell").agg(F.avg("value").alias("mean"))
    return matrix.join(means, "cell").select(key, "cell", (F.col("value") - F.col("mean")).alias("value"))


def leading_vectors(times: Callable[[np.ndarray], np.ndarray], side: int, modes: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues and their vectors of a symmetric matrix that is known by its products alone.

    Each cycle spans a block of vectors and their products with the matrix, taken CYCLE_BLOCKS times, and keeps the best
    combinations of all of them as the next cycle's block, until what they lack of being eigenvectors is under RESIDUAL of the
    largest eigenvalue. A product is one job; the driver holds 2 * CYCLE_BLOCKS * (modes + SPARE_MODES) vectors.
    """
    width = min(modes + SPARE_MODES, side)
    block = np.linalg.qr(np.random.default_rng(0).normal(size=(side, width)))[0]
    for _ in range(MOST_CYCLES):
        basis, images = block, times(block)
        scale = np.abs(images).max()
        for _ in range(CYCLE_BLOCKS - 1):
            fresh = images[:, -width:]
            for _ in range(2):  # once more for what rounding left
                fresh = fresh - basis @ (basis.T @ fresh)
            q, r = np.linalg.qr(fresh)
            q = q[:, np.abs(np.diag(r)) > 1e-13 * scale]
            q = q - basis @ (basis.T @ q)
            if not q.shape[1] or basis.shape[1] + q.shape[1] > side:
                break
            q = np.linalg.qr(q)[0]
            basis, images = np.hstack([basis, q]), np.hstack([images, times(q)])
        small = basis.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1][:width]
        values, block, image = values[order], basis @ turns[:, order], images @ turns[:, order]
        if np.linalg.norm(image - block * values, axis=0)[:modes].max() <= RESIDUAL * max(values[0], 1e-300):
            break
        block = np.linalg.qr(block)[0]
    return values[:modes], block[:, :modes]


def components(matrix: DataFrame, n_modes: int = 50, key: str = "day", gram_side: int = GRAM_SIDE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spectrum, pcs, patterns) of a dense matrix (key, cell, value), the thin singular value decomposition of its centred form.

    spectrum: (mode, eigenvalue, fraction); pcs: (key, mode, pc); patterns: (mode, cell, loading). The matrix is dealt out by the
    longer of its axes, as vectors along the shorter, so all that meets on the driver has the length of the shorter axis: of
    17,167 days and 145,161 cells, 17,167 numbers a vector, 66 MB in all for 50 modes. Up to gram_side the products of all pairs
    are summed in one job and solved whole; beyond it the leading ones come from leading_vectors. The other axis's vectors are
    made in tasks. Of each mode, the largest number along the shorter axis is positive.
    """
    spark = matrix.sparkSession
    with Workspace(spark, "components") as space:
        rows = matrix.select(key, "cell", clean(F.col("value")).alias("value"))
        known = rows.agg(F.count_distinct(key).alias("n"), F.count_distinct("cell").alias("cells"), F.count("*").alias("rows"), F.count("value").alias("values")).first()
        n, cells = known.n, known.cells
        if n < 2 or known.rows != n * cells or known["values"] != known.rows:
            raise ValueError("the matrix has to be two-dimensional and without gaps")
        long, short = ("cell", key) if cells > n else (key, "cell")
        names = sorted(r[0] for r in rows.select(short).distinct().collect())
        vectors = rows.groupBy(long).agg(F.array_sort(F.collect_list(F.struct(short, "value"))).alias("x")).select(long, F.transform("x", lambda c: c["value"]).alias("x"))
        vectors, side, n_modes = space.written(vectors, "vectors"), len(names), min(n_modes, n, cells)
        with rows_a_batch(spark, 8 * side):
            means = None
            if short == "cell":  # of each cell; vectors of days are centred each by its own mean
                def add_rows(total):
                    def add(batch):
                        total[:] += array_block(batch.column(0)).sum(0)
                    return add

                means = summed(vectors.select("x"), add_rows, (side,)) / n

            def block(batch: pa.RecordBatch, column: int = 0) -> np.ndarray:
                x = array_block(batch.column(column))
                return x - (x.mean(1, keepdims=True) if means is None else means)

            def times(q: np.ndarray) -> np.ndarray:
                shared = spark.sparkContext.broadcast(q)

                def start(total):
                    def add(batch):
                        x = block(batch)
                        total[:] += x.T @ (x @ shared.value)
                    return add

                found = summed(vectors.select("x"), start, q.shape)
                shared.unpersist()
                return found

            def add_squares(total):
                def add(batch):
                    total[:] += (block(batch) ** 2).sum()
                return add

            squares = float(summed(vectors.select("x"), add_squares, (1,))[0])
            if side <= gram_side:
                values, turns = np.linalg.eigh(times(np.eye(side)))
                values, turns = values[::-1][:n_modes], turns[:, ::-1][:, :n_modes]
            else:
                values, turns = leading_vectors(times, side, n_modes)
            values = np.maximum(values, 0.0)
            turns = turns * np.sign(turns[np.abs(turns).argmax(0), np.arange(n_modes)])
            strength = np.sqrt(values)
            # the vectors of the longer axis: pcs of keys, or loadings of cells
            factor = turns if long == key else np.divide(turns, strength, out=np.zeros_like(turns), where=strength > 1e-12 * max(strength[0], 1e-300))
            shared = spark.sparkContext.broadcast(factor)
            kind, name = dict(matrix.dtypes)[long], "pc" if long == key else "loading"

            def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    out = block(batch, 1) @ shared.value
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(out)), n_modes))), pa.array(np.tile(np.arange(n_modes, dtype=np.int32), len(out))),
                                                      pa.array(out.ravel())], names=[long, "mode", name])

            of_long = space.finish(vectors.mapInArrow(made, f"{long} {kind}, mode int, {name} double"))
    own = turns * strength if short == key else turns
    flat = pa.table({short: pa.array(names * n_modes), "mode": pa.array(np.repeat(np.arange(n_modes, dtype=np.int32), side)), ("pc" if short == key else "loading"): pa.array(own.T.ravel())})
    of_short = spark.createDataFrame(flat)
    of_short = of_short.withColumn(short, F.col(short).cast(dict(matrix.dtypes)[short]))
    total = squares / (n - 1)
    spectrum = spark.createDataFrame([(i, float(v / (n - 1)), float(v / (n - 1) / total) if total else 0.0) for i, v in enumerate(values)], "mode int, eigenvalue double, fraction double")
    pcs, patterns = (of_long, of_short) if long == key else (of_short, of_long)
    return spectrum, pcs.select(key, "mode", "pc"), patterns.select("mode", "cell", "loading")


def cumulative(spectrum: DataFrame) -> DataFrame:
    return spectrum.withColumn("cumulative", F.sum("fraction").over(Window.orderBy("mode")))  # a row a mode


def modes_for(spectrum: DataFrame, fraction: float) -> DataFrame:
    """(modes): how many leading modes hold the fraction of the variance."""
    return cumulative(spectrum).filter(F.col("cumulative") >= fraction).agg((F.min("mode") + 1).alias("modes"))


def separable(spectrum: DataFrame, n_samples: int) -> DataFrame:
    """Adds the sampling error of each eigenvalue, and whether the next lies further off; the last mode is never separable."""
    error = F.col("eigenvalue") * float(np.sqrt(2 / n_samples))
    gap = F.col("eigenvalue") - F.lead("eigenvalue").over(Window.orderBy("mode"))
    return spectrum.withColumn("error", error).withColumn("separable", F.coalesce(gap > F.col("error"), F.lit(False)))


def pattern_map(patterns: DataFrame, cells: DataFrame, scales: DataFrame, mode: int) -> DataFrame:
    """(variable, lat, lon, value) of a mode in the units of its variable; null where the weight is 0."""
    rows = patterns.filter(F.col("mode") == mode).join(cells, "cell").join(F.broadcast(scales), "variable")
    return rows.select("variable", "lat", "lon", (F.try_divide("loading", eof_weight(F.col("lat"))) * F.col("scale")).alias("value"))


def project(matrix: DataFrame, patterns: DataFrame, key: str = "day", loading_bytes: int = LOADING_BYTES) -> DataFrame:
    """(key, mode, pc): the product of the centred matrix with the patterns; cells have to agree. A value that is missing adds nothing.

    The rows of the matrix are dealt out by key once, whatever the number of modes, and tasks multiply blocks of keys with the
    loadings, which they are sent as one array; more than loading_bytes of them go in parts, each of some modes.
    """
    spark = matrix.sparkSession
    rows = matrix.select(key, F.col("cell").cast("long").alias("cell"), clean(F.col("value")).alias("value"))
    found = rows.groupBy("cell").agg(F.avg("value").alias("mean")).toArrow().sort_by("cell")  # a row a cell
    cells, means = found["cell"].to_numpy(), np.nan_to_num(found["mean"].to_numpy())
    known = patterns.select("mode", F.col("cell").cast("long").alias("cell"), F.col("loading").cast("double").alias("loading"))
    if not np.array_equal(cells, known.select("cell").distinct().toArrow().sort_by("cell")["cell"].to_numpy()):
        raise ValueError("the field and the patterns have different cells")
    modes = sorted(r[0] for r in known.select("mode").distinct().collect())
    kind, mode_kind = dict(matrix.dtypes)[key], dict(patterns.dtypes)["mode"]
    dealt, at_once = rows.repartition(key).sortWithinPartitions(key), max(1, loading_bytes // (8 * max(len(cells), 1)))

    def part(own: list) -> DataFrame:
        table = known.filter(F.col("mode").isin(own)).toArrow()
        loadings = np.zeros((len(cells), len(own)))
        loadings[np.searchsorted(cells, table["cell"].to_numpy()), np.searchsorted(own, table["mode"].to_numpy())] = table["loading"].to_numpy()
        shared = spark.sparkContext.broadcast((cells, means, loadings))

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places, centre, weights = shared.value
            for keys, block in keyed_blocks(batches, places, centre):
                out = block @ weights
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(np.arange(len(keys)), len(own)))), pa.array(own * len(keys), pa.int64()), pa.array(out.ravel())], names=[key, "mode", "pc"])

        return dealt.mapInArrow(product, f"{key} {kind}, mode long, pc double").withColumn("mode", F.col("mode").cast(mode_kind))

    parts = [part(modes[at : at + at_once]) for at in range(0, len(modes), at_once)]
    return reduce(DataFrame.unionByName, parts)


def unexplained(matrix: DataFrame, pcs: DataFrame, key: str = "day") -> DataFrame:
    """(unexplained): the share of variance outside of the modes."""
    whole = centred(matrix, key).agg(F.sum(F.col("value") * F.col("value")).alias("whole"))
    held = pcs.agg(F.sum(F.col("pc") * F.col("pc")).alias("held"))
    return whole.join(held, how="cross").select((1 - F.try_divide("held", "whole")).alias("unexplained"))  # one row each


def scaled_pcs(pcs: DataFrame) -> DataFrame:
    """Every component by the standard deviation of the first."""
    first = pcs.filter("mode = 0").agg(F.stddev_samp("pc").alias("s"))
    return pcs.join(F.broadcast(first), how="cross").withColumn("pc", F.try_divide("pc", "s")).drop("s")  # one row


def amplitude_ratio(model: DataFrame, observed: DataFrame) -> DataFrame:
    a = model.filter("mode = 0").agg(F.stddev_pop("pc").alias("a"))
    b = observed.filter("mode = 0").agg(F.stddev_samp("pc").alias("b"))
    return a.join(b, how="cross").select(F.try_divide("a", "b").alias("ratio"))  # one row each
