"""Types of days: k-means partitions, their agreement, and whether they are more than red noise would give."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.operators.blocks import array_block
from trendloom.operators.decompose import frequencies
from trendloom.operators.sequences import matrix

#: Rows and numbers of a block in a step of k-means, and values that the driver brings together at once.
BLOCK_ROWS, BLOCK_NUMBERS, MOST_AT_ONCE = 2048, 1 << 18, 64


def assign(rows: DataFrame, centroids: DataFrame, key: str = "day", scale: float = 1.0) -> DataFrame:
    """(key, type, distance2) for each row (key, features): the nearest of the centroids (type, centre), the lowest type at a tie.

    The centroids are a row a type, so they go to each task as one array; rows are not shuffled, and rows that share a key
    stay apart. Leading features are used if a centre is shorter.
    """
    known = centroids.agg(F.collect_list(F.struct("type", "centre")).alias("known"))  # one row

    def far(c):
        squares = F.zip_with(F.slice("features", 1, F.size(c["centre"])), c["centre"], lambda x, y: (x.cast("double") / scale - y) * (x.cast("double") / scale - y))
        return F.struct(F.aggregate(squares, F.lit(0.0), lambda total, s: total + s).alias("distance2"), c["type"].alias("type"))

    nearest = rows.join(F.broadcast(known), how="cross").select(key, F.array_min(F.transform("known", far)).alias("at"))
    return nearest.select(key, "at.type", "at.distance2")


def squares_to(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to the centres (start, type, feature): an array (row, start, type)."""
    flat = centres.reshape(-1, centres.shape[-1])
    far = (x * x).sum(1)[:, None] - 2 * (x @ flat.T) + (flat * flat).sum(1)
    return np.maximum(far, 0).reshape(len(x), *centres.shape[:2])


def drawn_numbers(at: np.ndarray, seed: int, step: int) -> np.ndarray:
    """Numbers between 0 and 1 that follow from a row's hash, a start's seed and the step alone, on any partitioning."""
    with np.errstate(over="ignore"):
        z = at.view(np.uint64) + np.uint64((seed * 1_000_003 + step + 1) & 0xFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53


def dealt(rows: DataFrame) -> RDD:
    """The rows (at, x) as pairs of arrays (hashes, features), dealt evenly to the cores: steps pass over blocks, not over lists of numbers."""

    def pack(batches):
        for batch in batches:
            at, x = batch.column(0).to_numpy(), array_block(batch.column(1))
            size = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(x.shape[1], 1)))
            cuts = range(0, len(x), size)
            yield pa.RecordBatch.from_pydict({"at": [at[c : c + size].tobytes() for c in cuts], "x": [x[c : c + size].tobytes() for c in cuts]}, schema=pa.schema([("at", pa.binary()), ("x", pa.binary())]))

    def unpack(row):
        at = np.frombuffer(row.at, np.int64)
        return at, np.frombuffer(row.x, np.float64).reshape(len(at), -1)

    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores).mapInArrow(pack, "at binary, x binary").rdd.map(unpack)


def merged(parts: RDD, merge):
    """One value a task, brought together on the driver, by way of tasks where they are many."""
    return parts.treeReduce(merge, 1 if parts.getNumPartitions() <= MOST_AT_ONCE else 2)


def first_centres(blocks: RDD, k: int, seeds: Sequence[int]) -> np.ndarray:
    """k rows for each start, (start, type, feature): the first by chance, each further one by its squared distance to those before.

    A step draws the next row of all starts in one job: the row with the least exponential number for its weight.
    """
    if not blocks.getNumPartitions():  # a plan that is known to have no rows
        raise ValueError("no rows to partition")
    centres = None
    for step in range(k):

        def draw(part, step=step, centres=centres):
            best = {}
            for at, x in part:
                weight = np.ones((len(x), len(seeds))) if centres is None else squares_to(x, centres).min(2)
                for s, seed in enumerate(seeds):
                    with np.errstate(divide="ignore"):
                        score = -np.log1p(-drawn_numbers(at, seed, step)) / weight[:, s]
                    score[weight[:, s] <= 0] = np.inf  # a row that is a centre already
                    if score[i := int(score.argmin())] < best.get(s, (np.inf,))[0]:
                        best[s] = (float(score[i]), x[i].tolist())
            yield best

        drawn = merged(blocks.mapPartitions(draw), lambda a, b: {s: min(own[s] for own in (a, b) if s in own) for s in a.keys() | b.keys()})
        found = {s: x for s, (_, x) in drawn.items()}  # a row a start
        if not found and centres is None:
            raise ValueError("no rows to partition")
        # with fewer different rows than types, the last centre again: a type without rows
        chosen = np.array([found[s] if s in found else centres[s, -1] for s in range(len(seeds))])[:, None]
        centres = chosen if centres is None else np.concatenate([centres, chosen], axis=1)
    return centres


def step_sums(part, own: np.ndarray):
    """(sums of the features by (start, type), counts, costs by start) of the blocks of a task, each row by its nearest of `own` centres
    (start, type, feature), the lowest type at a tie."""
    n, k, width = own.shape
    flat = own.transpose(1, 0, 2).reshape(k * n, width)  # a type's starts side by side
    norms = (flat * flat).sum(1)
    sums, counts, costs = np.zeros((k * n, width)), np.zeros(k * n), np.zeros(n)
    for _, x in part:
        far = np.maximum((x * x).sum(1)[:, None] - 2 * (x @ flat.T) + norms, 0).reshape(len(x), k, n)
        least, nearest = far[:, 0].copy(), np.zeros((len(x), n), np.int32)
        for t in range(1, k):
            nearest[far[:, t] < least] = t
            np.minimum(least, far[:, t], out=least)
        chosen = (nearest[:, None] == np.arange(k, dtype=np.int32)[:, None]).astype(np.float64).reshape(len(x), k * n)
        sums += chosen.T @ x
        counts += chosen.sum(0)
        costs += least.sum(0)
    by_start = lambda a: a.reshape(k, n, -1).transpose(1, 0, 2)
    yield by_start(sums), by_start(counts), costs


def fit_starts(rows: DataFrame, k: int, seeds: Sequence[int], rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(centres (start, type, feature), cost of each start) of k-means from each seed over (at, x) rows.

    All starts move in the same job: tasks have all centres as one array and give sums by start and type. A start that no longer
    moves takes no further part, so the jobs are as many as the rounds of the slowest start. A type without rows stays where it is.
    """
    blocks = dealt(rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        centres = first_centres(blocks, k, seeds)
        costs, moving = np.zeros(len(seeds)), np.arange(len(seeds))
        for _ in range(rounds + 1):
            own = centres[moving]
            sums, counts, costs[moving] = merged(blocks.mapPartitions(lambda part, own=own: step_sums(part, own)), lambda a, b: tuple(x + y for x, y in zip(a, b)))
            means = np.where(counts > 0, sums / np.maximum(counts, 1), own)
            still = np.abs(means - own).max((1, 2)) <= 1e-10 * max(1.0, np.abs(centres).max())
            centres[moving[~still]] = means[~still]
            moving = moving[~still]
            if not len(moving):
                break
    finally:
        blocks.unpersist()
    return centres, costs


def as_rows(rows: DataFrame, key: str) -> DataFrame:
    """(at, x): a hash of the row, for draws, and its features."""
    return rows.select(F.xxhash64(key, "features").alias("at"), F.col("features").cast("array<double>").alias("x"))


def centroid_table(spark, centres: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "type int, centre array<double>")


def fit_once(rows: DataFrame, k: int, seed: int, key: str = "day"):
    """(labels (key, type), centres, cost) of one start."""
    centres, costs = fit_starts(as_rows(rows, key), k, [seed])
    return assign(rows, centroid_table(rows.sparkSession, centres[0]), key).select(key, "type"), centres[0], float(costs[0])


def best_partition(rows: DataFrame, k: int, seed: int = 0, starts: int = 50, key: str = "day") -> tuple[DataFrame, DataFrame]:
    """(labels, centroids) of the start with the least cost, all starts fitted together; types are numbered by size, largest first."""
    centres, costs = fit_starts(as_rows(rows, key), k, range(seed, seed + starts))
    table = centroid_table(rows.sparkSession, centres[costs.argmin()])
    labels = assign(rows, table, key).select(key, "type")
    sizes = table.select("type").join(labels.groupBy("type").count(), "type", "left")
    place = sizes.select("type", (F.row_number().over(Window.orderBy(F.desc_nulls_last("count"), "type")) - 1).alias("place"))  # a row a type
    found = labels.join(F.broadcast(place), "type").select(key, F.col("place").alias("type"))
    return found, table.join(F.broadcast(place), "type").select(F.col("place").alias("type"), "centre")


def best_matching(counts: np.ndarray) -> float:
    """The greatest sum over one-to-one pairings of rows with columns.

    Each row is added by a shortest path over reduced costs, along which earlier pairs change over; the cost is the cube of the
    number of types.
    """
    cost = counts.max() - np.asarray(counts, np.float64)
    k = len(cost)
    of_row, of_column, owner = np.zeros(k), np.zeros(k), np.full(k, -1)
    for row in range(k):
        least, came, done = np.full(k, np.inf), np.full(k, -1), np.zeros(k, bool)
        at, reached, column = row, 0.0, -1
        while True:
            over = reached + cost[at] - of_row[at] - of_column
            better = ~done & (over < least)
            least[better], came[better] = over[better], column
            column = int(np.where(done, np.inf, least).argmin())
            reached, done[column] = least[column], True
            if owner[column] < 0:
                break
            at = owner[column]
        of_row[row] += reached
        ended = done & (least <= reached)
        taken = np.flatnonzero(ended & (owner >= 0))
        of_row[owner[taken]] += reached - least[taken]
        of_column[ended] -= reached - least[ended]
        while column >= 0:  # every column on the way takes the row of the one before
            before = came[column]
            owner[column] = row if before < 0 else owner[before]
            column = before
    return float(np.asarray(counts)[owner, np.arange(k)].sum())


def contingency(a: DataFrame, b: DataFrame, key: str = "day") -> DataFrame:
    """(type, type_to, n) over the keys that both have."""
    return a.join(b.select(key, F.col("type").alias("type_to")), key).groupBy("type", "type_to").agg(F.count("*").alias("n"))


def agreement(a: DataFrame, b: DataFrame, k: int, key: str = "day") -> float:
    """The share of keys on which two partitions agree, under the best renaming; only the k x k counts reach the driver."""
    counts = matrix(contingency(a, b, key), k)
    return best_matching(counts) / counts.sum() if counts.sum() else 0.0


def single_start(x: np.ndarray, k: int, seed: int, rounds: int = 300) -> np.ndarray:
    """The types of one k-means start over a series of days that a task holds: far centres first, then means until they stay."""
    rng = np.random.default_rng(seed)
    centres = x[rng.integers(len(x))][None]
    while len(centres) < min(k, len(x)):  # of a few days drawn by their distance the one that leaves least
        far = ((x[:, None] - centres) ** 2).sum(2).min(1)
        drawn = rng.choice(len(x), 2 + int(np.log(k)), p=far / far.sum() if far.sum() else None)
        left = np.minimum(far[:, None], ((x[:, None] - x[drawn]) ** 2).sum(2)).sum(0)
        centres = np.vstack([centres, x[drawn[left.argmin()]]])
    for _ in range(rounds):
        types = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        means = np.array([x[types == t].mean(0) if (types == t).any() else centres[t] for t in range(len(centres))])
        if np.allclose(means, centres, rtol=0, atol=1e-10):
            break
        centres = means
    return types


def mean_agreement(x: np.ndarray, k: int, seeds: int, seed: int) -> float:
    found = [single_start(x, k, seed + s) for s in range(seeds)]
    counts = lambda a, b: np.bincount(a * k + b, minlength=k * k).reshape(k, k)
    return float(np.mean([best_matching(counts(a, b)) / len(x) for i, a in enumerate(found) for b in found[i + 1 :]]))


#: Numbers of a series that is sent to tasks, at most: 256 MB.
MOST_NUMBERS = 1 << 25


def series_of(pcs: DataFrame, at: str = "at") -> np.ndarray:
    """(at, mode, pc) as an array of days in order by modes, on the driver; more than MOST_NUMBERS are an error, as a task has to hold a
    series of days."""
    n = pcs.count()
    if n > MOST_NUMBERS:
        raise ValueError(f"a series of {n} numbers is more than the {MOST_NUMBERS} that a task takes; give fewer modes")
    found = pcs.select(F.col(at).alias("at"), "mode", "pc").toPandas()
    return found.pivot(index="at", columns="mode", values="pc").sort_index().to_numpy()


def red_series(x: np.ndarray, mode: int, copy: int, seed: int) -> np.ndarray:
    """A series with the variance and lag-1 correlation of x, whose shocks follow from seed, copy and mode alone."""
    rng = np.random.default_rng([seed, copy, mode])
    sd = x.std(ddof=1) if len(x) > 1 else 0.0
    r = float(np.clip(np.corrcoef(x[:-1], x[1:])[0, 1], -0.99, 0.99)) if len(x) > 2 and sd else 0.0
    out = np.empty(len(x))
    shocks = rng.normal(0, 1, len(x)) * sd * np.sqrt(1 - r * r)
    out[0] = rng.normal(0, 1) * sd
    for i in range(1, len(x)):
        out[i] = r * out[i - 1] + shocks[i]
    return out


def classifiability_of(spark, x: np.ndarray, ks: Sequence[int], surrogates: int = 0, seeds: int = 20, seed: int = 0) -> DataFrame:
    """(surrogate, k, score): the mean agreement between partitions from single starts, of x (days by modes) as surrogate -1 and of
    each of its red-noise surrogates, for each k.

    The series goes to every task once; a task is a surrogate and a k, and makes the surrogate itself, so no series is shuffled.
    """
    shared = spark.sparkContext.broadcast(x)
    cases = [(s, int(k)) for s in range(-1, surrogates) for k in ks]
    grid = spark.createDataFrame(cases, "surrogate int, k int").repartition(max(1, len(cases)))

    def score(parts):
        for part in parts:
            out = []
            for copy, k in zip(part["surrogate"], part["k"]):
                own = shared.value if copy < 0 else np.stack([red_series(shared.value[:, m], m, int(copy), seed) for m in range(shared.value.shape[1])], 1)
                out.append((copy, k, mean_agreement(own, int(k), seeds, seed)))
            yield pd.DataFrame(out, columns=["surrogate", "k", "score"])

    return grid.mapInPandas(score, "surrogate int, k int, score double")


def classifiability(pcs: DataFrame, k: int, seeds: int = 20, seed: int = 0, at: str = "at") -> float:
    """The mean agreement between partitions of pcs (at, mode, pc) from single starts."""
    return classifiability_of(pcs.sparkSession, series_of(pcs, at), [k], 0, seeds, seed).first()["score"]


def red_noise(pcs: DataFrame, surrogates: int, seed: int = 0) -> DataFrame:
    """(surrogate, at, mode, pc): series with the variance and lag-1 correlation of each mode of pcs (at, mode, pc).

    One group is a mode: a series of days, whose recurrence has to be run in order; it gives the mode of each surrogate in turn.
    """

    def make(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        x, mode = group["pc"].to_numpy(), int(group["mode"][0].as_py())
        made = np.concatenate([red_series(x, mode, copy, seed) for copy in range(surrogates)]) if surrogates else np.empty(0)
        return pa.table({"surrogate": pa.array(np.repeat(np.arange(surrogates, dtype=np.int32), len(x))), "at": pa.array(np.tile(group["at"].to_numpy(), surrogates)),
                         "mode": pa.array(np.full(len(made), mode, np.int32)), "pc": pa.array(made)})

    own = pcs.select(F.col("at").cast("long").alias("at"), F.col("mode").cast("int").alias("mode"), F.col("pc").cast("double").alias("pc"))
    return own.groupBy("mode").applyInArrow(make, "surrogate int, at long, mode int, pc double")


def as_features(pcs: DataFrame, key: str = "at", n_modes: int | None = None) -> DataFrame:
    """(key, features) from (key, mode, pc)."""
    kept = pcs if n_modes is None else pcs.filter(F.col("mode") < n_modes)
    rows = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("mode", "pc"))).alias("x"))
    return rows.select(key, F.transform("x", lambda c: c["pc"]).alias("features"))


def sweep(pcs: DataFrame, ks: Sequence[int], seeds: int = 20, surrogates: int = 50, seed: int = 0, n_modes: int | None = None) -> DataFrame:
    """(k, observed, surrogate_mean, surrogate_p95, scores, margin, exceeds) for each k: how well the starts agree on pcs (at,
    mode, pc) against red noise with the same variances and lag-1 correlations. All k and surrogates are one Spark job."""
    own = pcs if n_modes is None else pcs.filter(F.col("mode") < n_modes)
    scores = classifiability_of(pcs.sparkSession, series_of(own), ks, surrogates, seeds, seed)
    noise = F.col("surrogate") >= 0
    found = scores.groupBy("k").agg(
        F.max(F.when(~noise, F.col("score"))).alias("observed"), F.avg(F.when(noise, F.col("score"))).alias("surrogate_mean"),
        F.percentile(F.when(noise, F.col("score")), 0.95).alias("surrogate_p95"), F.sort_array(F.collect_list(F.when(noise, F.col("score")))).alias("scores"))
    return found.withColumns({"margin": F.col("observed") - F.col("surrogate_p95"), "exceeds": F.col("observed") > F.col("surrogate_p95")})


def frequency_bias(model: DataFrame, observed: DataFrame, k: int) -> DataFrame:
    """(type, bias): frequencies of a model's labels less those observed."""
    a, b = frequencies(model, k), frequencies(observed, k).withColumnRenamed("frequency", "seen")
    return a.join(b, "type").select("type", (F.col("frequency") - F.col("seen")).alias("bias"))


def total_bias(bias: DataFrame) -> DataFrame:
    return bias.agg((F.sum(F.abs("bias")) / 2).alias("total_bias"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
