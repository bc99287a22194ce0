"""The library's own jobs applied to the test tables, and the SQL for each.

Orders and events stand in for records of a periodic survey.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import periods
from tallyloom.sources.tables import orders_by_nation, table
from tallyloom.streaming.totals import windowed_totals


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 2) for c in columns})


def _in_cents(df: DataFrame) -> DataFrame:
    """Prices as whole cents, whose sums don't depend on the order of addition."""
    return df.withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.period_totals(_in_cents(orders_by_nation(spark, sf_dir)), "n_name", "o_orderdate", "cents")


def f1_period_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir)


def f2_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.change(_totals(spark, sf_dir), "n_name", 12)


def f3_trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.trailing_mean(_totals(spark, sf_dir), "n_name", 3)


def f4_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.share(_in_cents(table(spark, sf_dir, "orders")), "o_orderpriority", F.col("o_orderstatus") == "F", "cents")


def f5_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.rollup_totals(_in_cents(orders_by_nation(spark, sf_dir)), ["r_name", "n_name"], "cents")


def f6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(periods.percentiles(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", [0.1, 0.5, 0.9]), "p10", "p50", "p90")


def f7_top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.top_groups(_totals(spark, sf_dir), "n_name", 3)


def f8_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.flows(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(windowed_totals(table(spark, sf_dir, "events"), "ts", "event_type", "value"), "total").withColumn("window_start", F.col("window_start").cast("date"))


QUERIES = {
    "f1_period_totals": f1_period_totals,
    "f2_change": f2_change,
    "f3_trailing_mean": f3_trailing_mean,
    "f4_share": f4_share,
    "f5_rollup": f5_rollup,
    "f6_percentiles": f6_percentiles,
    "f7_top_groups": f7_top_groups,
    "f8_flows": f8_flows,
    "windowed_events": windowed_events,
}

_CENTS = "cast(round(o_totalprice * 100) as bigint)"
_PLACES = "orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"
_T = f"""t as (select n_name, cast(date_trunc('month', o_orderdate) as date) as month, count(*) as n, cast(sum({_CENTS}) as bigint) as total
from {_PLACES} group by 1, 2)"""

ORACLE_SQL = {
    "f1_period_totals": f"with {_T} select n_name, month, n, total from t",
    "f2_change": f"""with {_T} select a.n_name, a.month, a.total, b.total as before, a.total - b.total as difference,
cast(a.total - b.total as double) / nullif(cast(b.total as double), 0) as relative
from t a left join t b on a.n_name = b.n_name and a.month = cast(b.month + interval 12 month as date)""",
    "f3_trailing_mean": f"""with {_T} select n_name, month, total, avg(total) over (partition by n_name order by year(month) * 12 + month(month)
range between 2 preceding and current row) as trailing from t""",
    "f4_share": f"""select o_orderpriority, cast(sum(case when o_orderstatus = 'F' then {_CENTS} else 0 end) as bigint) as part, cast(sum({_CENTS}) as bigint) as whole,
cast(sum(case when o_orderstatus = 'F' then {_CENTS} else 0 end) as double) / nullif(cast(sum({_CENTS}) as double), 0) as share from orders group by 1""",
    "f5_rollup": f"""select r_name, n_name, cast(grouping_id(r_name, n_name) as int) as level, count(*) as n, cast(sum({_CENTS}) as bigint) as total
from {_PLACES} group by rollup(r_name, n_name)""",
    "f6_percentiles": """select o_orderpriority, round(quantile_cont(o_totalprice, 0.1), 2) as p10, round(quantile_cont(o_totalprice, 0.5), 2) as p50,
round(quantile_cont(o_totalprice, 0.9), 2) as p90 from orders group by 1""",
    "f7_top_groups": f"""with {_T} select month, cast(rank as int) as rank, n_name, n from (select month, n_name, n, row_number() over (partition by month order by n desc, n_name) as rank from t) where rank <= 3""",
    "f8_flows": """select from_status, to_status, count(*) as n from (select event_type as from_status, lead(event_type) over (partition by user_id order by ts, event_id) as to_status from events)
where to_status is not null group by 1, 2""",
    "windowed_events": "select cast(date_trunc('day', ts) as date) as window_start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2",
}
