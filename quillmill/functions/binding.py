"""Naming a value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row.

    The optimizer may put a column's expression in place of its name, also inside a lambda that runs for each element
    of an array; a lambda's own variable stays a value.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
