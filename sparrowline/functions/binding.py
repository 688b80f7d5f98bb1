"""Evaluate an expensive expression once, however often it is used.

Spark inlines a computed column into every filter and projection that refers to
it. For a JSON parse that means parsing a row again for each use, and nested
uses multiply. Generators and lambda parameters are not inlined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def with_computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add (or replace) columns, each evaluated once per row."""
    kept = [name for name in df.columns if name not in columns]
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(values)))
