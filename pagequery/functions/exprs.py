"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def first_group(col: Column, pattern: str) -> Column:
    return F.regexp_extract(col, pattern, 1)


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)
