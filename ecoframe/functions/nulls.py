"""Null, NaN and division semantics used throughout the library.

Spark's ANSI mode raises where columnar Python engines return NaN or infinity, so every division
here goes through ``try_divide`` and "invalid" always means null, NaN or infinite.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

_INF = float("inf")


def col(name: str) -> Column:
    """A column by its literal name (dots are not treated as struct access)."""
    return F.col(f"`{name}`")


def is_invalid(c: Column) -> Column:
    d = c.cast("double")
    return c.isNull() | F.isnan(d) | (F.abs(d) == F.lit(_INF))


def is_finite(c: Column) -> Column:
    return ~is_invalid(c)


def finite_text(name: str) -> str:
    """``finite_or_null`` of a named column as SQL text.

    Wide plans are built from text: one call per expression instead of one per operator.
    """
    c = f"CAST(`{name}` AS DOUBLE)"
    return f"CASE WHEN isnan({c}) OR abs({c}) = DOUBLE('Infinity') THEN NULL ELSE {c} END"


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def finite_or_null(c: Column) -> Column:
    return F.when(is_finite(c), c)


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def clamp(c: Column, low, high) -> Column:
    """Limit to [low, high]; null stays null (``greatest`` would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def label(*cols: Column, sep: str = "_") -> Column:
    """Joined label that is null as soon as one part is null."""
    parts: list[Column] = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(c.cast("string"))
    return F.concat(*parts)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def sum_of(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def sum_or_zero(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def n_unique(*cols: Column) -> Column:
    """Distinct values (or distinct tuples) with null counted as a value."""
    if len(cols) == 1:
        c = cols[0]
        return F.countDistinct(c) + F.coalesce(F.max(F.when(c.isNull(), 1).otherwise(0)), F.lit(0))
    return F.countDistinct(F.struct(*cols))


def keys_match(left: str, right: str, keys: list[str]) -> Column:
    """Null-safe equality of key columns between two aliased frames."""
    return all_of([F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys])
