"""Every SQL-backed query agrees with DuckDB; semantics on hand-made rows."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom import catalog
from tallyloom.operators import periods
from tallyloom.streaming.totals import windowed_totals

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    clean = lambda v: round(v, 4) if isinstance(v, float) else v
    return sorted(repr([clean(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF), con.execute(catalog.ORACLE_SQL[name])
    want_columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(want_columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want_columns, want.fetchall())


def test_change_goes_by_calendar(spark):
    d = dt.date
    totals = spark.createDataFrame([("a", d(2020, 1, 1), 1, 10.0), ("a", d(2020, 3, 1), 1, 30.0), ("a", d(2020, 4, 1), 1, 0.0), ("a", d(2020, 5, 1), 1, 5.0)], "g string, month date, n long, total double")
    got = {r.month.month: (r.before, r.relative) for r in periods.change(totals, "g", 1).collect()}
    assert got == {1: (None, None), 3: (None, None), 4: (30.0, -1.0), 5: (0.0, None)}


def test_trailing_mean_skips_absent_months(spark):
    d = dt.date
    totals = spark.createDataFrame([("a", d(2020, 1, 1), 10.0), ("a", d(2020, 4, 1), 20.0), ("a", d(2020, 5, 1), 40.0)], "g string, month date, total double")
    assert [r.trailing for r in periods.trailing_mean(totals, "g", 3).orderBy("month").collect()] == [10.0, 20.0, 30.0]


def test_share_of_nothing_is_null(spark):
    df = spark.createDataFrame([("a", True, 0.0), ("b", True, 1.0), ("b", False, 3.0)], "g string, p boolean, v double")
    assert {r.g: r.share for r in periods.share(df, "g", F.col("p"), "v").collect()} == {"a": None, "b": 0.25}


def test_top_groups_break_ties(spark):
    d = dt.date(2020, 1, 1)
    df = spark.createDataFrame([("b", d, 5), ("a", d, 5), ("c", d, 5)], "g string, month date, n long")
    assert [r.g for r in periods.top_groups(df, "g", 2).orderBy("rank").collect()] == ["a", "b"]


def test_percentiles_are_exact(spark):
    """Ties, nulls, a null group, one row, and more values than a stretch, against the built-in exact form."""
    rows = [("a", float(i % 700) if i % 7 else 3.0) for i in range(3000)] + [("b", 5.0)] + [(None, float(i)) for i in range(50)] + [("c", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    at, names = [0.0, 0.1, 0.333, 0.5, 0.99, 0.995, 1.0], ["p0", "p10", "p33_3", "p50", "p99", "p99_5", "p100"]
    want = df.where("v is not null").groupBy("g").agg(*(F.percentile("v", p).alias(n) for p, n in zip(at, names))).collect()
    close = lambda rows: sorted((repr(r.g), *(round(r[n], 6) for n in names)) for r in rows)
    for exact_up_to in (100_000, 0):  # all groups in the built-in form; those with over ``accuracy`` rows by their sketch
        out = periods.percentiles(df, "g", "v", at, exact_up_to, accuracy=40)
        assert out.columns == ["g", *names]
        got = out.collect()
        assert close(got) == close(want) and len(got) == 3
    with pytest.raises(ValueError):
        periods.percentiles(df, "g", "v", [0.5, 0.5])


def test_null_groups_meet_their_own_months(spark):
    d = dt.date
    totals = spark.createDataFrame([(None, d(2020, 1, 1), 10.0), (None, d(2020, 2, 1), 30.0), ("a", d(2020, 2, 1), 1.0), (None, None, 7.0)], "g string, month date, total double")
    got = {(r.g, r.month and r.month.month): r.before for r in periods.change(totals, "g", 1).collect()}
    assert got == {(None, 1): None, (None, 2): 10.0, ("a", 2): None, (None, None): None}


@pytest.mark.parametrize("name", ["month", "before", "__i"])
def test_names_of_results_are_refused(spark, name):
    totals = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0)], "g string, month date, total double")
    with pytest.raises(ValueError):
        periods.change(totals.withColumnRenamed("total", "v").withColumn(name, F.lit(1)), name, 1, "v")


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, ts timestamp, v double")
    assert periods.period_totals(df, "g", "ts", "v").count() == 0
    assert periods.flows(df, "g", "g", ["ts"]).count() == 0
    assert periods.percentiles(df, "g", "v", [0.5]).count() == 0


def test_stream_agrees_with_batch(spark, tmp_path):
    """A stream of the events gives the batch totals for the windows that its watermark has closed."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    os.makedirs(tmp_path / "in")
    events.repartition(1).write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in" / "*"))
    out = windowed_totals(stream, "ts", "event_type", "value")
    query = out.writeStream.outputMode("append").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.window_start, r.event_type): r.n for r in spark.table("totals").collect()}
    want = {(r.window_start, r.event_type): r.n for r in windowed_totals(events, "ts", "event_type", "value").collect()}
    assert got and all(want[k] == n for k, n in got.items())
