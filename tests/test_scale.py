"""What must not depend on partitions, and what must not meet in one task: components, projection, partitions, ranks and scans."""

import datetime as dt
import itertools
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trendloom.functions.quantiles import exact_quantiles, of_ordered_bits, ordered_bits
from trendloom.operators import clusters, eof, indices, sequences
from trendloom.operators.blocks import summed


def long_matrix(spark, values, partitions=5):
    rows = [(i, c, float(v)) for i, row in enumerate(values) for c, v in enumerate(row)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(pd.DataFrame(rows, columns=["day", "cell", "value"]), "day int, cell int, value double").repartition(partitions)


def decaying(n, m, seed=0, modes=40):
    rng = np.random.default_rng(seed)
    u, v = np.linalg.qr(rng.normal(size=(n, modes)))[0], np.linalg.qr(rng.normal(size=(m, modes)))[0]
    return u * 100 * 0.9 ** np.arange(modes) @ v.T + 0.01 * rng.normal(size=(n, m))


@pytest.mark.parametrize("n,m,gram_side", [(60, 240, 2000), (60, 240, 20), (240, 60, 2000), (240, 60, 20), (70, 70, 20)])
def test_components_of_wide_and_tall_matrices_are_numpy_s(spark, n, m, gram_side):
    values = decaying(n, m)
    centred = values - values.mean(0)
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    spectrum, pcs, patterns = eof.components(long_matrix(spark, values), 6, gram_side=gram_side)
    rows = spectrum.orderBy("mode").collect()
    assert np.allclose([r.eigenvalue for r in rows], s[:6] ** 2 / (n - 1), rtol=1e-8)
    assert np.allclose([r.fraction for r in rows], s[:6] ** 2 / (s**2).sum(), rtol=1e-8)
    loadings = patterns.toPandas().pivot(index="mode", columns="cell", values="loading").to_numpy()
    found = pcs.toPandas().pivot(index="day", columns="mode", values="pc").to_numpy()
    signs = np.sign((loadings * vt[:6]).sum(1))
    assert np.allclose(loadings * signs[:, None], vt[:6], atol=1e-8)
    assert np.allclose(found * signs, u[:, :6] * s[:6], atol=1e-6) and np.allclose(found, centred @ loadings.T, atol=1e-6)


def test_components_of_a_matrix_of_low_rank(spark):
    values = np.outer(np.arange(30.0), np.arange(1.0, 9.0))
    spectrum, pcs, patterns = eof.components(long_matrix(spark, values), 4)
    fractions = [r.fraction for r in spectrum.orderBy("mode").collect()]
    assert fractions[0] == pytest.approx(1) and max(fractions[1:]) < 1e-9
    wide = eof.components(long_matrix(spark, values.T), 4)[2]
    assert wide.count() == 4 * 30 and not wide.filter("isnan(loading)").count()


def test_projection_is_blocked_and_the_same_on_any_partitions(spark):
    values, loadings = decaying(50, 90), np.random.default_rng(2).normal(size=(7, 90))
    patterns = spark.createDataFrame(pd.DataFrame([(m, c, loadings[m, c]) for m in range(7) for c in range(90)], columns=["mode", "cell", "loading"]), "mode int, cell int, loading double")
    want = (values - values.mean(0)) @ loadings.T
    for partitions, size in ((1, eof.LOADING_BYTES), (50, 90 * 8 * 3)):  # whole, and three modes at a time
        found = eof.project(long_matrix(spark, values, partitions), patterns, loading_bytes=size)
        plan = found._jdf.queryExecution().toString()
        assert "Join" not in plan.split("== Physical Plan ==")[1]
        got = found.toPandas()
        assert len(got) == 350 and np.allclose(got.pivot(index="day", columns="mode", values="pc").to_numpy(), want, atol=1e-9)
    # a missing value adds nothing
    holed = long_matrix(spark, values).filter("NOT (day = 3 AND cell = 5)")
    means = values.mean(0)
    means[5] = np.delete(values[:, 5], 3).mean()
    row = values[3] - means
    row[5] = 0
    assert np.allclose([r.pc for r in eof.project(holed, patterns).filter("day = 3").orderBy("mode").collect()], row @ loadings.T)


def test_sums_of_arrays_over_tasks(spark):
    def start(total):
        def add(batch):
            total[:] += batch.column(0).to_numpy().sum() * np.arange(9000.0).reshape(90, 100)
        return add

    for rows in (spark.range(100, numPartitions=7), spark.range(0, numPartitions=3)):
        n = sum(range(100)) if rows.count() else 0
        assert np.allclose(summed(rows, start, (90, 100)).ravel(), n * np.arange(9000.0))


def features(spark, x, partitions=4):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "day int, features array<double>").repartition(partitions)


def test_many_starts_in_one_job_are_the_single_ones(spark):
    x = np.random.default_rng(3).normal(size=(300, 3)) + np.random.default_rng(4).integers(0, 4, (300, 1)) * 3
    own = clusters.as_rows(features(spark, x), "day")
    centres, costs = clusters.fit_starts(own, 5, range(8))
    for s in (0, 3, 7):
        single, cost = clusters.fit_starts(own.repartition(1), 5, [s])
        assert np.allclose(single[0], centres[s]) and cost[0] == pytest.approx(costs[s])
    for c, cost in zip(centres, costs):  # each is a fixed point of the algorithm, with its cost
        far = ((x[:, None] - c) ** 2).sum(2)
        types = far.argmin(1)
        assert cost == pytest.approx(far.min(1).sum()) and all(np.allclose(x[types == t].mean(0), c[t]) for t in range(5) if (types == t).any())
    labels, table = clusters.best_partition(features(spark, x), 5, starts=8)
    best = {r.type: np.array(r.centre) for r in table.collect()}
    assert sum(((x[r.day] - best[r.type]) ** 2).sum() for r in labels.collect()) == pytest.approx(costs.min())


def test_jobs_grow_with_rounds_and_not_with_starts(spark):
    x = np.concatenate([np.random.default_rng(5).normal(size=(50, 2)) + c for c in ((0, 0), (50, 0), (0, 50))])
    own = clusters.as_rows(features(spark, x), "day").persist()
    own.count()
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for n in (1, 30):
        spark.sparkContext.setJobGroup(f"starts-{n}", "")
        clusters.fit_starts(own, 3, range(n))
        jobs.append(len(tracker.getJobIdsForGroup(f"starts-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= 4 * jobs[0]


def test_a_round_is_one_stage_on_all_cores(spark):
    x = np.random.default_rng(9).normal(size=(400, 2))
    sc = spark.sparkContext
    sc.setJobGroup("rounds", "")
    clusters.fit_starts(clusters.as_rows(features(spark, x, partitions=1), "day"), 3, range(2))
    sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    last = tracker.getJobInfo(max(tracker.getJobIdsForGroup("rounds")))
    ran = [info.numCompletedTasks for info in map(tracker.getStageInfo, last.stageIds) if info and info.numCompletedTasks]
    assert ran == [sc.defaultParallelism]


def test_sums_of_a_step_and_of_many_tasks(spark):
    rng = np.random.default_rng(10)
    x, centres = rng.normal(size=(500, 3)), rng.normal(size=(6, 4, 3))
    centres[0, 3] = centres[0, 1]  # a tie goes to the lower type
    sums, counts, costs = next(clusters.step_sums([(None, x[:123]), (None, x[123:])], centres))
    for s, own in enumerate(centres):
        far = ((x[:, None] - own) ** 2).sum(2)
        types = far.argmin(1)
        assert costs[s] == pytest.approx(far.min(1).sum())
        assert counts[s, :, 0].tolist() == np.bincount(types, minlength=4).tolist()
        assert np.allclose(sums[s], [x[types == t].sum(0) for t in range(4)])
    sc, n = spark.sparkContext, 2 * clusters.MOST_AT_ONCE
    assert clusters.merged(sc.parallelize(range(n), n), lambda a, b: a + b) == sum(range(n))


def test_fewer_rows_than_types(spark):
    labels, table = clusters.best_partition(features(spark, [[0.0], [0.0], [5.0]]), 4, starts=2)
    found = {r.day: r.type for r in labels.collect()}
    assert found[0] == found[1] == 0 and found[2] == 1 and table.count() == 4
    with pytest.raises(ValueError, match="no rows"):
        clusters.best_partition(features(spark, [[0.0]]).limit(0), 2, starts=1)


def by_subsets(counts):
    best = {0: 0}
    for row in counts:
        step = {}
        for used, total in best.items():
            for j, n in enumerate(row):
                if not used >> j & 1:
                    step[used | 1 << j] = max(step.get(used | 1 << j, -1), total + n)
        best = step
    return best[(1 << len(counts)) - 1]


def test_matching_of_many_types():
    rng = np.random.default_rng(6)
    for k in [*range(1, 11), 12]:
        for top in (2, 50):
            counts = rng.integers(0, top, (k, k))
            assert clusters.best_matching(counts) == by_subsets(counts.tolist())
    counts, before = rng.integers(0, 1000, (100, 100)), time.perf_counter()
    found = clusters.best_matching(counts)
    assert time.perf_counter() - before < 1 and found >= max(counts[np.arange(100), (np.arange(100) + s) % 100].sum() for s in range(100))


SPECIAL = [0.0, -0.0, 1.0, -1.0, 1e-300, -1e-300, 5e-324, 1e300, -1e300, float("inf"), float("-inf"), 2.0, 2.0000000000000004]


def test_bits_are_in_the_order_of_numbers(spark):
    df = spark.createDataFrame([(v,) for v in SPECIAL], "v double").select("v", ordered_bits("v").alias("o"), of_ordered_bits(ordered_bits("v")).alias("back"))
    rows = sorted((r.o, r.v, r.back) for r in df.collect())
    assert [v for _, v, _ in rows] == sorted(SPECIAL) and all(v == b for _, v, b in rows)
    assert len({o for o, v, _ in rows if v == 0}) == 1


@pytest.mark.parametrize("partitions", [1, 50])
def test_quantiles_are_exact(spark, duck, partitions):
    rng, probabilities = np.random.default_rng(7), [0.0, 0.025, 0.5, 0.9, 0.975, 1.0]
    values = {"normal": rng.normal(size=1501), "ties": rng.integers(0, 3, 800).astype(float), "one": np.array([4.5]), "tiny": rng.normal(size=20) * 1e-300, "near": 1 + np.arange(40) * 2e-16}
    frame = pd.DataFrame([(g, float(v)) for g, own in values.items() for v in own] + [("normal", np.nan), ("none", np.nan)], columns=["g", "value"])
    rows = spark.createDataFrame(frame, "g string, value double").repartition(partitions)
    found = exact_quantiles(rows, ["g"], probabilities)
    assert partitions == 1 or "SinglePartition" not in found._jdf.queryExecution().toString()
    got = {(r.g, r.probability): r.quantile for r in found.collect()}
    assert set(got) == {(g, p) for g in values for p in probabilities}
    for (g, p), q in got.items():
        assert q == pytest.approx(np.quantile(values[g], p), rel=1e-15, abs=0 if g != "normal" else 1e-15), (g, p)


def test_no_task_holds_the_values_of_a_half(spark):
    series = spark.createDataFrame([(dt.date(2000, 1, 1) + dt.timedelta(days=i), float(i * 7919 % 1000)) for i in range(1000)], "day date, value double")
    found = indices.hot_days(series)
    assert "percentile(" not in found._jdf.queryExecution().toString()
    own = found.toPandas()
    cool = own.day.map(lambda d: 4 <= d.month <= 10)
    for half in (cool, ~cool):
        assert (own[half].hot == (own[half].value > own[half].value.quantile(0.9)).astype(int)).all()


@pytest.mark.parametrize("partitions", [1, 50])
def test_one_long_series_in_stretches(spark, partitions):
    r = random.Random(8)
    types = list(itertools.chain.from_iterable([r.choice([0, 1, 2, None])] * r.choice([1, 1, 2, 300]) for _ in range(40)))
    labels = spark.createDataFrame(list(enumerate(types)), "day int, type int").repartition(partitions)
    spark.conf.set("spark.sql.shuffle.partitions", str(max(partitions, 2)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = sorted((x.start, x.type, x.length) for x in sequences.run_lengths(labels).collect())
        steps = {(x.type, x.type_to): x.n for x in sequences.transitions(labels, 3).collect()}
        rows = labels.select("day", F.when(F.col("day") % 7 > 0, F.sin("day")).alias("value"))
        lag = indices.lag_correlation(rows).first().r
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, at = [], 0
    for t, own in itertools.groupby(types):
        n = len(list(own))
        want.append((at, t, n))
        at += n
    assert runs == want
    assert all(n == sum((x, y) == pair for x, y in zip(types, types[1:])) for pair, n in steps.items()) and len(steps) == 9
    v = pd.Series([np.sin(i) if i % 7 else np.nan for i in range(len(types))])
    assert lag == pytest.approx(v.corr(v.shift(-1)))
    assert sequences.run_lengths(labels.limit(0)).collect() == [] and indices.lag_correlation(rows.limit(0)).first().r is None
