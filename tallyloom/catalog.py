"""Queries over the test tables and the SQL that they must agree with."""

from __future__ import annotations

from tallyloom.plans.labor import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
