"""Bounded, repeatable samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Parts into which a hash of the id is cut.
PARTS = 1 << 20


def bounded_sample(labels: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """(key, value) of about ``most`` rows at most, chosen by a hash of the key.

    Repeated keys count once, with their largest value; null keys or values are
    left out.  All rows stay where there are fewer than ``most``.  Small enough
    to broadcast: the bound doesn't grow with the data.
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.max(value).alias(value))
    return rows.where(part_of(F.col(key)) < share(rows.count(), most))


def part_of(key: Column) -> Column:
    """A part from 0 to PARTS - 1 by the key's hash."""
    return F.pmod(F.xxhash64(key), F.lit(PARTS))


def share(rows: int, most: int) -> int:
    """How many of PARTS to take for ``most`` of ``rows``."""
    return PARTS if rows <= most else int(PARTS * most / rows)


def reservoir(rows: DataFrame, key: str, columns: list[str], most: int, scratch: Scratch) -> DataFrame:
    """At most ``most`` distinct rows of each value of ``key`` (one of ``columns``), those with the smallest hashes.

    A row that repeats counts once, so no repeats can fill the sample or keep others
    out, and a key with at most ``most`` distinct rows keeps them all.  Two passes: an
    estimate of each key's distinct rows says which hashes can be among the smallest;
    the rows with those, few more than ``most`` for a key, are written once, repeats gone,
    and the ``most``-th smallest hash cuts them off.  No more than that is ever sorted or
    held, and the result doesn't depend on partitions.  Only the chosen rows are
    shuffled; the driver holds an estimate for each key.
    """
    place = F.pmod(F.xxhash64(F.xxhash64(*columns)), F.lit(1 << 62)).alias("__at")
    own = rows.select(*columns, place)
    spread = own.groupBy(key).agg(F.approx_count_distinct("__at", 0.02).alias("__distinct"))
    spread = rows.sparkSession.createDataFrame(spread.collect(), spread.schema)  # a row for each key
    reach = F.lit(float(1 << 62)) * F.least(F.lit(1.0), 1.25 * most / F.col("__distinct"))
    few = own.join(F.broadcast(spread), key).where(F.col("__at") <= reach).select(*columns, "__at")
    few = scratch.save(few.dropDuplicates([*columns, "__at"]), "few")
    order = Window.partitionBy(key).orderBy("__at")
    ranked = few.select(key, "__at").distinct().withColumn("__rank", F.row_number().over(order))
    cut = ranked.where(F.col("__rank") <= most).groupBy(key).agg(F.max("__at").alias("__cut"))
    return few.join(F.broadcast(cut), key).where(F.col("__at") <= F.col("__cut")).select(*columns)
