"""Totals per period and what follows from them.

Column names are arguments; one that a job also gives to a result of its own is an
error.  Change and trailing means go by the calendar, not by row order, so a missing
month is a missing month.  Rows without a time form a month of their own, null, that is
never before or after another.  A null group is a group like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.dates import month_index, month_of


def _apart(own: set[str], *columns: str) -> None:
    """Complains about a column with the name of a result."""
    for c in columns:
        if c in own or c.startswith("__"):
            raise ValueError(f"column {c!r} has the name of a column of the result, or one kept for use inside")


def period_totals(df: DataFrame, group: str, ts: str, value: str) -> DataFrame:
    """Rows and total value per group and month: (group, month, n, total)."""
    _apart({"month", "n", "total"}, group)
    return df.groupBy(group, month_of(F.col(ts)).alias("month")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def change(totals: DataFrame, group: str, months: int, value: str = "total") -> DataFrame:
    """Each period beside the one ``months`` earlier: value before, difference, relative change."""
    _apart({"month", "before", "difference", "relative"}, group, value)
    before = totals.select(F.col(group).alias("__group"), F.add_months("month", months).alias("__month"), F.col(value).alias("before"))
    same = F.col(group).eqNullSafe(F.col("__group")) & (F.col("month") == F.col("__month"))
    difference = F.col(value) - F.col("before")
    joined = totals.select(group, "month", value).join(before, same, "left")
    return joined.select(group, "month", F.col(value), "before", difference.alias("difference"), F.try_divide(difference, F.col("before")).alias("relative"))


def trailing_mean(totals: DataFrame, group: str, months: int, value: str = "total") -> DataFrame:
    """Mean of the months present among the last ``months``, this one included."""
    _apart({"month", "trailing"}, group, value)
    w = Window.partitionBy(group).orderBy("__i").rangeBetween(-(months - 1), Window.currentRow)
    return totals.withColumn("__i", month_index(F.col("month"))).select(group, "month", F.col(value), F.avg(value).over(w).alias("trailing"))


def top_groups(totals: DataFrame, group: str, k: int, value: str = "n") -> DataFrame:
    """The k largest groups of each month; ties go to the smaller group."""
    _apart({"month", "rank"}, group, value)
    w = Window.partitionBy("month").orderBy(F.desc(value), F.col(group))
    return totals.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("month", "rank", group, F.col(value))


def share(df: DataFrame, group: str, part: Column, value: str) -> DataFrame:
    """Value of the rows where ``part`` holds, over all value, per group; null where that is zero."""
    _apart({"part", "whole", "share"}, group)
    sums = df.groupBy(group).agg(F.sum(F.when(part, F.col(value)).otherwise(F.lit(0))).alias("part"), F.sum(value).alias("whole"))
    return sums.withColumn("share", F.try_divide("part", "whole"))


def rollup_totals(df: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Totals at every level of a hierarchy, with the grouping id of the level."""
    _apart({"level", "n", "total"}, *levels)
    return df.rollup(*levels).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.sum(value).alias("total"))


def percentile_name(share: float) -> str:
    """p50 for 0.5, p99_5 for 0.995."""
    return "p" + f"{100 * share:.10g}".replace(".", "_")


def percentiles(df: DataFrame, group: str, value: str, at: list[float], exact_up_to: int = 100_000, accuracy: int = 10_000) -> DataFrame:
    """Exact percentiles per group, linear between the two nearest values, named as :func:`percentile_name` does; nulls of ``value`` are left out.

    Groups with up to ``exact_up_to`` rows (``accuracy`` at least) take the built-in form,
    which holds their values.  For a larger one a sketch tells between which two values
    each percentile lies, about 10 / ``accuracy`` of the group's rows apart: rows below are
    counted where they are read, and only those between are put in order.
    """
    names = [percentile_name(p) for p in at]
    _apart(set(names), group)
    if len(set(names)) < len(names):
        raise ValueError(f"a share stands twice in {at}")
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    reach = 5 / accuracy
    bounds = F.percentile_approx("v", [b for p in at for b in (max(p - reach, 0.0), min(p + reach, 1.0))], accuracy)
    sizes = rows.groupBy("g").agg(F.count("*").alias("total"), bounds.alias("bounds"))
    sized = rows.alias("a").join(sizes.alias("b"), F.col("a.g").eqNullSafe(F.col("b.g"))).select("a.g", "v", "total", "bounds")
    is_small = F.col("total") <= max(exact_up_to, accuracy)
    small = sized.where(is_small).groupBy("g").agg(*(F.percentile("v", p).alias(n) for p, n in zip(at, names)))
    # Each row counts for the percentiles that it isn't above: as itself where it may be near, else as one of those below.
    low, high = (lambda i: F.col("bounds")[2 * i]), (lambda i: F.col("bounds")[2 * i + 1])
    counts_for = (F.when(F.col("v") <= high(i), F.struct(F.lit(i).alias("i"), F.when(F.col("v") >= low(i), F.col("v")).alias("v"))) for i in range(len(at)))
    near = sized.where(~is_small).select("g", "total", F.explode(F.array_compact(F.array(*counts_for))).alias("c"))
    near = near.groupBy("g", "total", "c.i", "c.v").agg(F.count("*").alias("n"))
    end = F.sum("n").over(Window.partitionBy("g", "i").orderBy(F.asc_nulls_first("v")))
    place = F.element_at(F.array(*map(F.lit, map(float, at))), F.col("i") + 1) * (F.col("total") - 1)
    ranked = near.withColumn("end", end).withColumn("start", F.col("end") - F.col("n")).withColumn("place", place).where("v is not null")
    inside = lambda rank: (rank >= F.col("start")) & (rank < F.col("end"))
    below, part = F.floor("place"), F.col("place") - F.floor("place")
    weight = F.when(inside(below), 1 - part).otherwise(0.0) + F.when((part > 0) & inside(below + 1), part).otherwise(0.0)
    large = ranked.withColumn("w", weight).where("w > 0").groupBy("g")
    large = large.agg(*(F.sum(F.when(F.col("i") == i, F.col("v") * F.col("w"))).alias(n) for i, n in enumerate(names)))
    return small.union(large).withColumnRenamed("g", group)


def flows(df: DataFrame, who: str, status: str, order: list[str]) -> DataFrame:
    """Counts of moves between consecutive statuses of one person.

    A person's records are ordered together, so one very long history is one task
    (sorted on disk if need be, and read row by row).
    """
    _apart({"from_status", "to_status", "n"}, who)
    w = Window.partitionBy(who).orderBy(*order)
    moved = df.select(F.col(status).alias("from_status"), F.lead(status).over(w).alias("to_status")).where("to_status is not null")
    return moved.groupBy("from_status", "to_status").agg(F.count("*").alias("n"))
