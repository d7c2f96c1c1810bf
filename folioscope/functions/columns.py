"""Column helpers that the other functions share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once for a row however often body names it."""
    return F.transform(F.array(value), body)[0]


def present(values: list[Column]) -> Column:
    """The values that are not null, in order."""
    return F.filter(F.array(*values), F.isnotnull)


def nearest(values: Column, to: Column) -> Column:
    """The 0-based place of the value nearest to a number, the earliest of equals; null without values."""
    return F.array_min(F.transform(values, lambda v, i: F.struct(F.abs(v - to).alias("d"), i.alias("i"))))["i"]


def pairs(edges: Column) -> Column:
    """Consecutive pairs (lo, hi) of an array; empty below two."""
    return F.transform(F.slice(edges, 1, F.greatest(F.size(edges) - 1, F.lit(0))), lambda v, i: F.struct(v.alias("lo"), F.get(edges, i + 1).alias("hi")))
