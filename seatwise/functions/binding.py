"""Naming a value inside a column expression, so that it is worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
