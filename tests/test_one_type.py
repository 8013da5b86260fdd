"""Queries over label series against their SQL where every day has the same type, as in larger tables with many orders a day."""

import datetime as dt
import math

import duckdb
import pandas as pd
import pytest

from trendloom.operators import indices, sequences
from trendloom.plans import catalog

DAYS = [dt.date(1996, 1, 1) + dt.timedelta(days=i) for i in range(30)]


@pytest.fixture(scope="module")
def one_type(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("one_type"))
    orders = pd.DataFrame({"o_orderdate": DAYS, "o_orderpriority": "1-URGENT", "o_totalprice": [100.0 + i for i in range(30)]})
    items = pd.DataFrame({"l_shipdate": DAYS * 3, "l_quantity": [25 + (i * 37 % 101) / 7 for i in range(90)]})
    orders.to_parquet(f"{folder}/orders.parquet")
    items.to_parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return folder, con


@pytest.mark.parametrize("name", ["best_offset_shipments", "offset_spread_shipments", "sequence_report_orders"])
def test_rows(spark, one_type, name):
    folder, con = one_type
    got = catalog.QUERIES[name](spark, folder).toPandas()
    want = con.execute(catalog.SQL[name]).df()
    pd.testing.assert_frame_equal(got.sort_values(list(got.columns), ignore_index=True), want.sort_values(list(got.columns), ignore_index=True), check_dtype=False, rtol=0, atol=2e-6)


def test_a_report_without_turns(spark, one_type):
    found = catalog.QUERIES["sequence_report_orders"](spark, one_type[0]).first()
    assert math.isnan(found.asymmetry) and math.isnan(one_type[1].execute(catalog.SQL["sequence_report_orders"]).fetchone()[3])
    labels = spark.createDataFrame([(d, 0) for d in DAYS], "day date, type int")
    assert sequences.sequence_report(labels, 5)["asymmetry"] == 0.0


def test_means_that_are_alike_have_a_spread_of_0(spark, one_type):
    impact = spark.read.parquet(f"{one_type[0]}/lineitem.parquet").selectExpr("l_shipdate AS day", "l_quantity AS value")
    labels = spark.createDataFrame([(d, 0) for d in DAYS], "day date, type int")
    assert {r.spread for r in indices.offset_spread(impact, labels, range(-3, 4), least=1).collect()} == {0.0}
    assert {(r.spread, r.gap) for r in indices.offset_spread(impact, labels, range(-3, 4)).collect()} == {(None, None)}
