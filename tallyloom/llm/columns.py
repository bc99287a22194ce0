"""Keeping a table's other columns out of an operator's way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """The column of exactly this name, with dots or quotes in it or not."""
    return F.col("`" + column.replace("`", "``") + "`")


def set_aside(df: DataFrame, needed: list[str]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``df`` with all but the needed columns under private names, and what gives a result df's columns back.

    Columns that the operator adds are named to the second; where ``df`` has such
    a column, the operator's takes its place.
    """
    private = {c: c if c in needed else f"__other_{i}" for i, c in enumerate(df.columns)}
    renamed = df.select(*(named(c).alias(p) for c, p in private.items()))

    def back(out: DataFrame, *added: str) -> DataFrame:
        return out.select(*(F.col(p).alias(c) for c, p in private.items() if c not in added), *added)

    return renamed, back
