"""Readers for the star-schema tables; every job takes its inputs from here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the nation and region of their customer.

    Only the two fixed-size dimension tables (25 and 5 rows) carry a broadcast
    hint; customer grows, so its join strategy is left to Spark.
    """
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = F.broadcast(nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey))
    return orders.join(customer, orders.o_custkey == customer.c_custkey).join(places, customer.c_nationkey == places.n_nationkey)
