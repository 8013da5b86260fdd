"""Known answers for the operators, against numpy or planted signals."""

import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trendloom.functions import calendar, statistics
from trendloom.operators import clusters, components, eof, fields, indices, labels, sequences
from trendloom.operators import decompose as dec
from trendloom.streaming.daily import daily_mean_stream

DAY = dt.date(1979, 1, 1)


def days(n, start=DAY):
    return [start + dt.timedelta(days=i) for i in range(n)]


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def grid_field(spark, values, lats, lons, start=DAY):
    """values: (day, lat, lon)."""
    rows = [(d, float(a), float(o), float(values[i, j, k])) for i, d in enumerate(days(len(values), start)) for j, a in enumerate(lats) for k, o in enumerate(lons)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["day", "lat", "lon", "value"]), "day date, lat double, lon double, value double")


# fields

@pytest.mark.parametrize("name, length", [(None, 365.25), ("360_day", 360.0), ("noleap", 365.0), ("all_leap", 366.0), ("no such", 365.25)])
def test_year_length(spark, name, length):
    assert spark.range(1).select(calendar.year_length(F.lit(name).cast("string"))).first()[0] == length


def test_box_at_either_edge_order_with_a_margin_and_wrapped_longitudes(spark):
    field = spark.createDataFrame([(float(a), float(o), 1.0) for a in (-40, -35, -30, -25) for o in (-190, -185, 170, 180)], "lat double, lon double, value double")
    assert {(r.lat, r.lon) for r in fields.in_box(field, -35, -30, 170, 175).collect()} == {(a, o) for a in (-35.0, -30.0) for o in (-190.0, -185.0, 170.0)}
    assert fields.in_box(field, -30, -35, 170, 175).count() == 6 and fields.in_box(field, -35, -30, 170, 175, margin=5).count() == 16


def test_days_between_both_ends_and_none(spark):
    rows = spark.createDataFrame([(d,) for d in days(10)], "day date")
    assert fields.between_days(rows, "1979-01-03", "1979-01-05").count() == 3
    with pytest.raises(PySparkException, match="no rows"):
        fields.between_days(rows, "1990-01-01", "1990-01-02").collect()


def test_cycle_is_removed_trend_kept_then_removed_in_spite_of_gaps_and_nan(spark):
    rng, n = np.random.default_rng(1), 365 * 6
    when = np.array([d.timetuple().tm_yday for d in days(n)])
    values = (100 + 8 * np.sin(2 * np.pi * when / 365.25) + 0.5 * np.arange(n) / 365.25 + rng.normal(0, 0.01, n))[:, None, None] * np.ones((1, 1, 2))
    field = grid_field(spark, values, [-30], [140, 145]).filter("NOT (lon = 140 AND month(day) = 2 AND year(day) = 1980)")
    field = field.withColumn("value", F.when((F.col("day") == F.lit("1981-05-05").cast("date")), float("nan")).otherwise(F.col("value")))
    out = fields.anomaly(field, 3).toPandas().dropna().sort_values(["lon", "day"])
    for lon in (140.0, 145.0):
        own = out[out.lon == lon]
        x = np.array([(d - DAY).days for d in own.day]) / 365.25
        assert abs(np.polyfit(x, own.value, 1)[0] - 0.5) < 0.02 and np.std(own.value - np.polyval(np.polyfit(x, own.value, 1), x)) < 0.15
        terms = np.array([[1, *[f(2 * np.pi * k * d.timetuple().tm_yday / 365.25) for k in (1, 2, 3) for f in (math.cos, math.sin)]] for d in own.day])
        raw = field.filter(F.col("lon") == lon).toPandas().dropna().sort_values("day").value.to_numpy()
        assert np.allclose(own.value, raw - terms @ np.linalg.lstsq(terms, raw, rcond=None)[0], atol=1e-6)
    for degree in (1, 2):
        flat = fields.detrend(fields.anomaly(field, 3), degree=degree).toPandas().dropna()
        assert all(abs(np.polyfit([(d - DAY).days for d in g.day], g.value, 1)[0]) < 1e-9 for _, g in flat.groupby("lon"))


def test_calendars_without_real_dates_by_day_of_the_year(spark):
    rows = [(y * 360 + d, y, d, "360_day", -30.0, 140.0, 5 * math.cos(2 * math.pi * d / 360)) for y in range(4) for d in range(1, 361)]
    field = spark.createDataFrame(rows, "at int, year int, doy int, calendar string, lat double, lon double, value double")
    assert max(abs(r.value) for r in fields.anomaly(field, 2).collect()) < 1e-9
    assert max(abs(r.value) for r in fields.anomaly(field, 2, year_days=365.25).collect()) > 1e-3


def test_one_nan_does_not_void_a_cell_a_block_or_a_type(spark):
    values = np.arange(4 * 2 * 2, dtype=float).reshape(4, 2, 2)
    values[0, 0, 0] = np.nan
    field = grid_field(spark, values, [-30, -31], [140, 141])
    assert by(fields.coarsen(field, 2), "day")[DAY].value == pytest.approx(2.0)
    scaled = by(fields.standardise_cells(field), "day", "lat", "lon")
    assert scaled[DAY, -30.0, 140.0].value is None and scaled[days(2)[1], -30.0, 140.0].value == pytest.approx(4 / np.std([4, 8, 12]))
    assert by(fields.regional_mean(field), "day")[days(2)[1]].value == pytest.approx(np.average([5, 6, 7], weights=np.cos(np.radians([30, 31, 31]))))
    types = spark.createDataFrame([(d, 0) for d in days(4)], "day date, type int")
    maps = by(sequences.composite(field, types, 2), "type", "lat", "lon")
    assert maps[0, -30.0, 140.0].value == pytest.approx(8.0) and maps[1, -30.0, 140.0].value is None


def test_weights_height_and_scales(spark):
    row = spark.createDataFrame([(60.0, 9.80665)], "lat double, z double").select(
        statistics.area_weight(F.col("lat")), statistics.eof_weight(F.col("lat")), fields.geopotential_height(F.col("z")), statistics.area_weight(F.col("lat") + 90)).first()
    assert row[0] == pytest.approx(0.5) and row[1] == pytest.approx(math.sqrt(0.5)) and row[2] == 1.0 and row[3] == 0.0
    constant = spark.createDataFrame([("p", 1.0), ("p", 1.0)], "variable string, value double")
    with pytest.raises(PySparkException, match="without variance cannot be standardised: p"):
        fields.variable_scales(constant).collect()


def test_regridding_outside_and_beside_gaps(spark):
    field = grid_field(spark, np.array([[[0.0, 10.0], [20.0, np.nan]]]), [-30, -32], [140, 142]).withColumn("value", statistics.clean(F.col("value")))
    grid = spark.createDataFrame([(-30.0, 141.0), (-31.0, 140.0), (-31.0, 141.0), (-40.0, 141.0)], "lat double, lon double")
    got = by(fields.regrid(field, grid), "lat", "lon")
    assert got[-30.0, 141.0].value == 5 and got[-31.0, 140.0].value == 10 and got[-31.0, 141.0].value is None and got[-40.0, 141.0].value is None
    for empty in (field.withColumn("value", F.lit(None).cast("double")), field.withColumn("lon", F.col("lon") + 100), field.limit(0)):
        with pytest.raises(PySparkException, match="no value"):
            fields.regrid(empty, grid).collect()


def test_regridding_around_the_ring(spark):
    """Conventions of longitude may differ between a field and a grid, and a field that goes all around has no edge."""
    lats = [-30.0, -40.0]

    def at(field_lons, grid_lons, value=lambda lon: lon % 360):
        field = grid_field(spark, np.array([[[value(x) for x in field_lons]] * 2]), lats, field_lons)
        grid = spark.createDataFrame([(-35.0, float(x)) for x in grid_lons], "lat double, lon double")
        return [r.value for r in fields.regrid(field, grid).orderBy("lon").collect()]

    assert at([-170, -160, -150], [195, 205]) == pytest.approx([195, 205])
    assert at([190, 200, 210], [-165, -155]) == pytest.approx([195, 205])
    around = list(range(0, 360, 30))
    assert at(around, [-15, 345, 359], lambda x: 1.0 if x == 0 else 0.0) == pytest.approx([0.5, 0.5, 29 / 30])
    assert at(range(-180, 180, 30), [345, 180], lambda x: 1.0 if x == 0 else 0.0) == pytest.approx([0.0, 0.5])
    assert at([-10, 0, 10], [-5, 5, 355, 180], lambda x: float(x)) == [-5.0, 5.0, None, -5.0]  # by longitude: -5, 5, 180, 355
    assert at([90, 100, 110], [85, 95, 110, 115]) == [None, 95.0, 110.0, None]
    assert at([0, 120, 240, 360], [60, 300], lambda x: 1.0) == pytest.approx([1.0, 1.0])  # 0 and 360 are one place


def test_nan_is_a_missing_value_in_every_operator(spark):
    """Each operator gives the same for NaN and for null, and no NaN."""
    values = np.arange(6 * 3 * 4, dtype=float).reshape(6, 3, 4) ** 1.3 % 17
    values[2, 1, 1] = values[0, 0, 3] = np.nan
    holed = grid_field(spark, values, [-30, -35, -40], [140, 142, 145, 149])
    nulls = holed.withColumn("value", statistics.clean(F.col("value")))
    named = lambda f: f.withColumn("variable", F.lit("p"))
    grid = spark.createDataFrame([(a, o) for a in (-31.0, -37.5) for o in (141.0, 144.0, 147.0)], "lat double, lon double")
    types = spark.createDataFrame([(d, i % 2) for i, d in enumerate(days(6))], "day date, type int")
    patterns = spark.createDataFrame([(0, c, 0.5 + c) for c in range(12)], "mode int, cell int, loading double")
    line = lambda f: f.filter("lat = -35 and lon = 142")
    operators = [
        lambda f: fields.regrid(f, grid), fields.gradient_wind, fields.weighted, fields.spatial_mean, fields.regional_mean, fields.standardise_cells, fields.detrend,
        lambda f: fields.anomaly(f, 1), lambda f: fields.coarsen(f, 2), lambda f: sequences.composite(f, types, 2), lambda f: fields.variable_scales(named(f)),
        lambda f: eof.prepare(named(f))[0], lambda f: eof.centred(eof.prepare(named(f))[0]), lambda f: eof.project(eof.prepare(named(f))[0], patterns),
        lambda f: indices.lag_correlation(line(f)), lambda f: indices.lag_correlation(f, ["lat", "lon"]), lambda f: indices.ridge_index(f, -35.0, 1.0), lambda f: indices.sam_proxy(f, -30.0, -40.0, 1.0),
        lambda f: indices.hot_days(line(f)), lambda f: indices.seasonal_mean(f), lambda f: indices.offset_spread(f, types, range(-1, 2))]
    for operator in operators:
        a, b = (sorted(map(repr, (tuple(x if not isinstance(x, float) else round(x, 9) for x in r) for r in operator(f).collect()))) for f in (holed, nulls))
        assert a == b and a and not any("nan" in r for r in a)


def test_wind_takes_the_next_cell_with_a_value(spark):
    field = grid_field(spark, np.array([[[0.0, np.nan, 6.0, 8.0]]]), [-30], [140, 141, 143, 144])
    got = by(fields.gradient_wind(field), "lon")
    across = 111_320.0 * math.cos(math.radians(30)) * 2 * 7.2921e-5 * math.sin(math.radians(-30))
    assert got[141.0].wind is None and got[140.0].wind == pytest.approx(2 / across) and got[143.0].wind == pytest.approx(2 / across)


# labels

def test_codes_are_fixed_and_an_unknown_label_is_an_error(spark):
    rows = spark.createDataFrame([(dt.datetime(2000, 1, d, 12), x) for d, x in ((1, "b-1"), (2, "a-2"), (3, "b-9"))], "ts timestamp, label string")
    assert [r.type for r in labels.load_labels(rows, "regime", ["b", "a"]).orderBy("day").collect()] == [0, 1, 0]
    assert [r.type for r in labels.load_labels(rows, "type").orderBy("day").collect()] == [1, 0, 2]
    assert [r.day for r in labels.load_labels(rows, "type", shift_days=-1).orderBy("day").collect()] == [dt.date(1999, 12, 31), dt.date(2000, 1, 1), dt.date(2000, 1, 2)]
    with pytest.raises(PySparkException, match="without a code: a"):
        labels.load_labels(rows, "regime", ["b"]).collect()
    with pytest.raises(ValueError, match="grouping"):
        labels.load_labels(rows, "month")
    with pytest.raises(PySparkException, match="no label"):
        labels.load_labels(rows, "type", start="2010-01-01").collect()


def test_alignment_and_look_up_name_what_is_missing(spark):
    impact = spark.createDataFrame([(d, 1.0) for d in days(3)], "day date, value double")
    types = spark.createDataFrame([(d, i) for i, d in enumerate(days(2))], "day date, type int")
    assert labels.align_to(impact, types).count() == 2
    with pytest.raises(PySparkException, match="1979-01-03"):
        labels.look_up(impact, types).collect()
    with pytest.raises(PySparkException, match="share no day"):
        labels.align_to(impact, types.withColumn("day", F.date_add("day", 900))).collect()
    field = impact.withColumns({"lat": F.lit(1.0), "lon": F.lit(1.0)})
    with pytest.raises(PySparkException, match="without a label: 1979-01-03"):
        sequences.composite(field, types, 3).collect()


# decomposition

@pytest.fixture(scope="module")
def planted(spark):
    """12 years with types that shift towards the second, whose means rise by 0.1 a year."""
    rng, rows = np.random.default_rng(3), []
    for d in days(365 * 12):
        year = d.year - 1979
        t = int(rng.random() < 0.3 + 0.02 * year)
        rows.append((d, t, 10.0 + 5 * t + 0.1 * year + rng.normal(0, 0.2)))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["day", "type", "value"]), "day date, type int, value double")


def test_planted_frequency_and_intensity_trends(spark, planted):
    table = dec.yearly_tables(planted, 2).cache()
    (cool,) = [d for d in dec.Decomposition.of(dec.decompose(table)) if d.season == "cool"]
    assert cool.intensity_term == pytest.approx(0.1, abs=0.02) and cool.frequency_term == pytest.approx(0.02 * 5, abs=0.04)
    assert cool.residual == pytest.approx(cool.total - cool.explained) and cool.summary().startswith("cool: +")
    alone = dec.yearly_table(planted, 2, "warm").orderBy("year", "type").collect()
    assert alone == table.filter("season = 'warm'").orderBy("year", "type").collect() and {r.year for r in alone} == set(range(1980, 1991))  # the first winter is partial


def test_unit_impact_gives_frequencies_only(spark, planted):
    table = dec.yearly_table(planted.withColumn("value", F.lit(1.0)), 3)
    rows = by(table, "year", "type")
    assert all(r.type_mean in (1.0, None) and (r.type_mean is None) == (r.n == 0) for r in rows.values())
    assert all(sum(rows[y, t].frequency for t in range(3)) == pytest.approx(1) and rows[y, 2].n == 0 for y in range(1979, 1991))


def numpy_decompose(freq, mean, years):
    slope = lambda y: np.polyfit(years, y, 1)[0]
    fs, ms = np.array([slope(f) for f in freq.T]), np.array([slope(m) for m in mean.T])
    return slope((freq * mean).sum(1)), (fs * mean.mean(0)).sum(), (freq.mean(0) * ms).sum(), (fs * ms).sum()


def test_bootstrap_draws_with_the_same_starts_as_numpy(spark, planted):
    table, draws, block = dec.yearly_table(planted, 2).cache(), 20, 4
    flat = table.orderBy("year", "type").toPandas()
    years = np.array(sorted(flat.year.unique()), float)
    freq, mean = (flat.pivot(index="year", columns="type", values=c).to_numpy() for c in ("frequency", "type_mean"))
    fit = lambda x: np.array([np.polyval(np.polyfit(years, c, 1), years) for c in x.T]).T
    blocks = -(-len(years) // block)
    starts = {(r.draw, r.b): r.s for r in spark.range(draws).select(F.col("id").cast("int").alias("draw")).crossJoin(spark.range(blocks).select(F.col("id").cast("int").alias("b"))).select(
        "draw", "b", F.pmod(F.xxhash64("draw", "b", F.lit(0)), F.lit(len(years) - block + 1)).alias("s")).collect()}
    got = by(dec.block_bootstrap(table, draws, block), "draw")
    for draw in range(draws):
        pick = np.concatenate([np.arange(starts[draw, b], starts[draw, b] + block) for b in range(blocks)])[: len(years)]
        f = np.maximum(fit(freq) + (freq - fit(freq))[pick], 0)
        want = numpy_decompose(f / f.sum(1, keepdims=True), fit(mean) + (mean - fit(mean))[pick], years)
        assert np.allclose([got[draw][c] for c in ("total", "frequency_term", "intensity_term", "cross_term")], want, atol=1e-8)
    low, high = np.percentile([got[d].total for d in range(draws)], [2.5, 97.5])
    row = by(dec.intervals(dec.block_bootstrap(table, draws, block)), "term")["total"]
    assert row.low == pytest.approx(low) and row.high == pytest.approx(high) and row.spans_zero == (low <= 0 <= high)
    other = by(dec.block_bootstrap(table.repartition(7), draws, block), "draw")
    assert all(np.allclose(other[d][2:6], got[d][2:6]) for d in range(draws))


def test_spread_of_partitions_and_what_is_kept(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", -2.0), ("c", -1.0), ("c", 1.0)], "season string, value double")
    got = by(dec.across_partitions(rows, by=["season"]), "season")
    assert (got["a"].sd, got["b"].sd) == (pytest.approx(math.sqrt(2)), 0.0) and [got[s].sign_stable for s in "abc"] == [True, True, False]
    before = spark.createDataFrame([("all", 2.0, 1.0, 0.0, 1e-13)], "season string, total double, frequency_term double, intensity_term double, cross_term double")
    after = spark.createDataFrame([("all", 1.0, -0.5, 3.0, 1.0)], before.schema)
    got = by(dec.kept_after_removal(before, after), "term")
    assert [(got[t].kept, got[t].sign_flips) for t in ("total", "frequency_term", "intensity_term", "cross_term")] == [(50.0, False), (-50.0, True), (None, False), (None, False)]


def test_index_operators_keep_seasons_apart(spark):
    table = spark.createDataFrame([(s, 1979 + y, t, (0.3 + sign * 0.01 * math.sin(y)) if t else 0.5, 1.0, 5) for s, sign in (("cool", 1), ("warm", -1)) for y in range(12) for t in (0, 1)],
                                  "season string, year int, type int, frequency double, type_mean double, n long")
    index = spark.createDataFrame([(1979 + y, math.sin(y)) for y in range(12)], "year int, value double")
    got = by(indices.regress_on_index(table, index), "season", "type")
    assert got["cool", 1].slope == pytest.approx(0.01) and got["warm", 1].slope == pytest.approx(-0.01) and got["cool", 1].r == pytest.approx(1)
    assert got["cool", 0].slope == 0 and got["cool", 0].r is None
    rest = by(indices.residual_trend(table, index), "season", "type")
    assert abs(rest["warm", 1].after) < 1e-12 < abs(rest["warm", 1].before)
    assert indices.attributable_fraction(table, index).count() == 4
    removed = by(indices.remove_index(table, index), "season", "year")
    assert len(removed) == 24
    with pytest.raises(ValueError, match="shared years"):
        indices.remove_index(table, index.limit(3))


def test_indices_of_a_banded_field(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=60), rng.normal(size=60)
    lats = [-37.5, -40, -42.5, -57.5, -60]
    values = np.stack([a, a, a, b, b], 1)[:, :, None] * 3 + 1000 + np.zeros((1, 1, 3))
    field = grid_field(spark, values, lats, [90, 95, 100])
    z = lambda x: (x - x.mean()) / x.std()
    assert np.allclose([r.value for r in indices.sam_proxy(field).orderBy("day").collect()], z(a) - z(b))
    assert np.allclose([r.value for r in indices.ridge_index(field).orderBy("day").collect()], z(a))
    with pytest.raises(PySparkException, match="no cell"):
        indices.sam_proxy(field, south=-80.0).collect()
    spreads = spark.createDataFrame([(-1, 2.0), (0, 2.0), (1, None), (2, 1.0)], "offset int, spread double")
    assert indices.best_offset(spreads).first().offset == -1


# components

@pytest.fixture(scope="module")
def two_patterns(spark):
    """A 9 x 7 grid with two planted patterns and noise, as (variable, day, lat, lon, value)."""
    rng, n = np.random.default_rng(5), 150
    lats, lons = np.linspace(-20, -60, 9), np.linspace(100, 130, 7)
    p1, p2 = np.sin(np.radians(lats * 3))[:, None] * np.ones(7), np.ones(9)[:, None] * np.cos(np.radians(lons * 6))
    values = 3 * rng.normal(size=n)[:, None, None] * p1 + rng.normal(size=n)[:, None, None] * p2 + 0.05 * rng.normal(size=(n, 9, 7))
    return grid_field(spark, values, lats, lons).withColumn("variable", F.lit("mslp")), values, lats, lons


def test_spectrum_components_and_maps_against_numpy(spark, two_patterns):
    field, values, lats, lons = two_patterns
    matrix, cells, scales = eof.prepare(field)
    weighted = (values / values.std() * np.sqrt(np.cos(np.radians(lats)))[None, :, None])[:, ::-1].reshape(len(values), -1)  # cells by ascending latitude
    weighted = weighted - weighted.mean(0)
    u, s, vt = np.linalg.svd(weighted, full_matrices=False)
    for gram_side in (eof.GRAM_SIDE, 10):  # all products at once, and by steps over the distributed rows
        spectrum, pcs, patterns = eof.components(matrix, 3, gram_side=gram_side)
        rows = spectrum.orderBy("mode").collect()
        assert np.allclose([r.eigenvalue for r in rows], (s**2 / (len(values) - 1))[:3], rtol=1e-6) and sum(r.fraction for r in rows) > 0.95
        loadings = patterns.filter("mode = 0").orderBy("cell").toPandas().loading.to_numpy()
        assert np.allclose(np.abs(loadings), np.abs(vt[0]), atol=1e-6)
        found = pcs.filter("mode = 1").orderBy("day").toPandas().pc.to_numpy()
        assert np.allclose(np.abs(found), np.abs(u[:, 1] * s[1]), atol=1e-5)
    assert eof.modes_for(spectrum, 0.9).first().modes == int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.9)) + 1
    told = eof.separable(spectrum, len(values)).orderBy("mode").collect()
    assert told[0].error == pytest.approx(told[0].eigenvalue * math.sqrt(2 / len(values))) and told[0].separable and not told[-1].separable
    maps = by(eof.pattern_map(patterns, cells, scales, 0), "lat", "lon")
    want = vt[0].reshape(9, 7)[::-1] / np.sqrt(np.cos(np.radians(lats)))[:, None] * values.std()
    assert np.allclose([[abs(maps[float(a), float(o)].value) for o in lons] for a in lats], np.abs(want), atol=1e-6)
    again = eof.project(matrix, patterns)
    assert eof.unexplained(matrix, again).first()[0] == pytest.approx(1 - (s[:3] ** 2).sum() / (s**2).sum(), abs=1e-9)
    scaled = eof.scaled_pcs(pcs).filter("mode = 0").agg(F.stddev_samp("pc")).first()[0]
    assert scaled == pytest.approx(1) and eof.amplitude_ratio(pcs, pcs).first().ratio == pytest.approx(math.sqrt(149 / 150))
    with pytest.raises(ValueError, match="different cells"):
        eof.project(matrix.filter("cell < 5"), patterns)
    with pytest.raises(ValueError, match="without gaps"):
        eof.components(matrix.filter("NOT (cell = 1 AND day = '1979-01-05')"))


def test_variables_have_to_share_days_and_cells(spark, two_patterns):
    field = two_patterns[0]
    other = field.withColumns({"variable": F.lit("z500"), "value": F.col("value") * 7 + 1})
    matrix, cells, scales = eof.prepare(field.unionByName(other))
    assert cells.count() == 126 and {r.variable for r in scales.collect()} == {"mslp", "z500"}
    assert [r.variable for r in cells.orderBy("cell").collect()] == ["mslp"] * 63 + ["z500"] * 63
    with pytest.raises(PySparkException, match="differ in their days or cells"):
        eof.prepare(field.unionByName(other.filter("lat < -25")))[0].collect()
    assert eof.prepare(field, factor=3)[1].count() == 6


def test_model_on_its_own_grid_is_prepared_by_the_scales_observed(spark, two_patterns):
    """A model that is the observations times 2, on half steps, of six-hourly steps: twice the components, not scaled away."""
    field, values, lats, lons = two_patterns
    scales = spark.createDataFrame([("mslp", 2.0)], "variable string, scale double")
    steps = field.select("variable", F.explode(F.array(*[F.timestamp_add("HOUR", F.lit(h), F.col("day").cast("timestamp")) for h in (0, 6, 12, 18)])).alias("time"), "lat", "lon", (F.col("value") * 2).alias("value"))
    grid = field.select("lat", "lon").distinct().filter("lat < -21 AND lat > -59")
    matrix, cells = eof.prepare_like_observations(steps.filter("day(time) > 0"), grid, scales, detrended=False, harmonics=1)
    assert cells.count() == 49
    when = np.array([d.timetuple().tm_yday for d in days(len(values))])
    terms = np.stack([np.ones(len(values)), np.cos(2 * np.pi * when / 365.25), np.sin(2 * np.pi * when / 365.25)], 1)
    own = 2 * values[:, 1:8].reshape(len(values), -1)
    want = (own - terms @ np.linalg.lstsq(terms, own, rcond=None)[0]).reshape(len(values), 7, 7) / 2.0 * np.sqrt(np.cos(np.radians(lats[1:8])))[None, :, None]
    got = matrix.join(cells, "cell").filter("day = '1979-02-10'").toPandas()
    at = {(a, o): want[40, i, j] for i, a in enumerate(lats[1:8]) for j, o in enumerate(lons)}
    assert np.allclose(got.value, [at[r.lat, r.lon] for r in got.itertuples()], atol=1e-8)


# types of days

def test_assignment_keeps_every_row_and_takes_the_lowest_type_at_a_tie(spark):
    rows = spark.createDataFrame([(1, [0.0, 9.0]), (1, [4.0, 0.0]), (2, [2.0, 5.0]), (None, [0.1, 0.0])], "day long, features array<double>")
    centroids = spark.createDataFrame([(1, [4.0]), (0, [0.0])], "type int, centre array<double>")
    got = sorted((r.day or 0, r.type, round(r.distance2, 6)) for r in clusters.assign(rows, centroids).collect())
    assert got == [(0, 0, 0.01), (1, 0, 0.0), (1, 1, 0.0), (2, 0, 4.0)]
    assert "Exchange hashpartitioning(day" not in clusters.assign(rows, centroids)._jdf.queryExecution().toString()


def blobs(spark, spread, n=240, seed=6):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [6, 0, 0], [0, 6, 0], [0, 0, 6]]) * spread
    x = centres[rng.integers(4, size=n)] + rng.normal(size=(n, 3))
    return spark.createDataFrame(pd.DataFrame([(i, m, float(x[i, m])) for i in range(n) for m in range(3)], columns=["at", "mode", "pc"]), "at long, mode int, pc double")


def test_partition_of_blobs_and_its_order_by_size(spark):
    rows = clusters.as_features(blobs(spark, 2.0)).withColumnRenamed("at", "day")
    found, centroids = clusters.best_partition(rows, 4, starts=6)
    sizes = [r["count"] for r in found.groupBy("type").count().orderBy("type").collect()]
    assert sizes == sorted(sizes, reverse=True) and sum(sizes) == 240 and len(sizes) == 4
    again = clusters.assign(rows, centroids)
    assert clusters.agreement(found, again, 4) == 1.0
    swapped = found.withColumn("type", (F.lit(3) - F.col("type")).cast("int"))
    assert clusters.agreement(found, swapped, 4) == 1.0
    assert clusters.as_features(blobs(spark, 2.0), n_modes=2).first().features.__len__() == 2


@pytest.mark.parametrize("k", [3, 5])
def test_best_matching_is_optimal_not_greedy(k):
    rng = np.random.default_rng(k)
    for _ in range(20):
        counts = rng.integers(0, 50, (k, k))
        assert clusters.best_matching(counts) == max(sum(counts[i, p[i]] for i in range(k)) for p in itertools.permutations(range(k)))
    assert clusters.best_matching(np.array([[10, 9], [9, 0]])) == 18


def test_red_noise_has_the_variance_and_memory_of_each_mode(spark):
    rng, n = np.random.default_rng(7), 3000
    x = np.zeros((n, 2))
    for i in range(1, n):
        x[i] = [0.8, 0.0] * x[i - 1] + rng.normal(size=2)
    pcs = spark.createDataFrame(pd.DataFrame([(i, m, float(x[i, m])) for i in range(n) for m in range(2)], columns=["at", "mode", "pc"]), "at long, mode int, pc double")
    made = clusters.red_noise(pcs, 2, seed=1).toPandas()
    for m, r in ((0, 0.8), (1, 0.0)):
        own = made[(made["mode"] == m) & (made.surrogate == 1)].sort_values("at").pc.to_numpy()
        assert abs(np.corrcoef(own[:-1], own[1:])[0, 1] - r) < 0.08 and own.std() == pytest.approx(x[:, m].std(), rel=0.15)
    pd.testing.assert_frame_equal(made.sort_values(["surrogate", "mode", "at"], ignore_index=True), clusters.red_noise(pcs.repartition(5), 2, seed=1).toPandas().sort_values(["surrogate", "mode", "at"], ignore_index=True))


def test_blobs_stand_out_of_red_noise_and_noise_does_not(spark):
    got = by(clusters.sweep(blobs(spark, 2.0, 160), [3, 4], seeds=6, surrogates=6), "k")
    assert got[4].observed > 0.95 and got[4].exceeds and got[4].margin == pytest.approx(got[4].observed - got[4].surrogate_p95)
    assert len(got[4].scores) == 6 and got[4].surrogate_p95 == pytest.approx(np.percentile(got[4].scores, 95)) and got[4].surrogate_mean == pytest.approx(np.mean(got[4].scores))
    assert clusters.classifiability(blobs(spark, 2.0, 160), 4, seeds=6) == pytest.approx(got[4].observed)
    assert clusters.classifiability(blobs(spark, 0.0, 160), 4, seeds=6) < 0.9


# sequences

def test_cyclic_order_report_and_persistence(spark):
    types = [0, 0, 1, 1, 1, 2, 0, 1, 2, 2, 0, 1]
    series = spark.createDataFrame(list(zip(days(12), types)), "day date, type int")
    steps = sequences.matrix(sequences.transitions(series, 3), 3)
    assert steps.tolist() == [[1, 3, 0], [0, 2, 2], [2, 0, 1]] and sequences.cyclic_order(steps) == [0, 1, 2]
    report = sequences.sequence_report(series, 3)
    runs = {0: [2, 1, 1], 1: [3, 1, 1], 2: [1, 2]}
    means = [np.mean(r) for r in runs.values()]
    assert report["mean_run"] == pytest.approx(np.mean(means)) and report["run_spread"] == pytest.approx(np.std(means)) and report["asymmetry"] == 1.0
    assert report["mean_stay"] == pytest.approx(np.mean([1 / 4, 2 / 4, 1 / 3]))
    got = by(sequences.persistence(series, 4), "type")
    assert got[0].median_run == 1 and got[3].mean_run is None and got[3].runs == 0
    assert sequences.cyclic_asymmetry(sequences.transitions(series.limit(1), 3), [0, 1, 2]).first()[0] == 0.0


def test_connected_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (7, 9), (4, 4), (None, 1), (20, 21)] + [(100 + i, 101 + i) for i in range(50)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20} | {i: 100 for i in range(100, 151)}
    assert components.connected_components(edges.limit(0)).collect() == []


def test_daily_means_of_a_stream(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    steps = spark.createDataFrame([(dt.datetime(2024, 1, d, h), "a", float(d + h)) for d in (1, 2, 3, 9) for h in (0, 6, 12, 18)], "ts timestamp, kind string, value double")
    steps.coalesce(1).write.parquet(str(source))
    made = daily_mean_stream(spark.readStream.schema(steps.schema).parquet(str(source)), ["kind"])
    query = made.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start(str(out))
    assert query.awaitTermination(120)
    got = {r.day: (r.value, r.n) for r in spark.read.parquet(str(out)).collect()}
    assert got == {dt.date(2024, 1, d): (d + 9.0, 4) for d in (1, 2, 3)}  # the last day may still grow
