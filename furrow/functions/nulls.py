"""Null and number rules, decided once.

NA is NULL. NaN and the infinities are values of their own and are kept until a rule drops them.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def if3(cond: Column, a, b) -> Column:
    """Two-branch conditional that stays NULL where the condition is NULL."""
    return F.when(cond, a).when(~cond, b)


def fill(c: Column | str, value) -> Column:
    """NULL becomes ``value``."""
    return F.coalesce(_col(c), F.lit(value))


def empty_to(c: Column | str, value: str) -> Column:
    """The empty string becomes ``value``; NULL stays NULL."""
    return F.when(_col(c) == "", F.lit(value)).otherwise(_col(c))


def null_if_zero(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(0.0))


def nan_to_null(c: Column | str) -> Column:
    """NaN compares as NA, so it must be NULL before a comparison."""
    return F.when(~F.isnan(_col(c)), _col(c))


def is_finite(c: Column | str) -> Column:
    """Not NULL, not NaN, not infinite; never NULL itself."""
    c = _col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def is_member(c: Column | str, values: list) -> Column:
    """Membership in a list; NULL is never a member, so the negation keeps NULL rows."""
    return F.coalesce(_col(c).isin(values), F.lit(False))


def ratio(n: Column | str, d: Column | str, mode: str = "null") -> Column:
    """``n / d``. Zero denominators give NULL, or Inf / NaN with ``mode='ieee'``."""
    n, d = _col(n).cast("double"), _col(d).cast("double")
    quotient = n / F.nullif(d, F.lit(0.0))
    if mode == "null":
        return quotient
    if mode != "ieee":
        raise ValueError(f"mode must be 'null' or 'ieee', not {mode!r}")
    by_zero = (
        F.when(F.isnan(n) | (n == 0), F.lit(float("nan")))
        .when(n > 0, F.lit(float("inf")))
        .when(n < 0, F.lit(float("-inf")))
    )
    return F.when(d == 0, by_zero).otherwise(quotient)


def pct(a: Column | str, b: Column | str, mode: str = "null") -> Column:
    return F.lit(100.0) * ratio(a, b, mode)


def row_sum(*cols: Column | str) -> Column:
    """Sum across columns that skips NULL; a row of NULLs gives 0."""
    return reduce(add, [F.coalesce(_col(c), F.lit(0.0)) for c in cols])


def sum_skip(c: Column | str) -> Column:
    """Aggregate: sum that skips NULL; a group of NULLs gives 0."""
    return F.coalesce(F.sum(_col(c)), F.lit(0))


def sum_strict(c: Column | str) -> Column:
    """Aggregate: sum that is NULL as soon as one value is NULL."""
    return F.when(F.count(_col(c)) == F.count(F.lit(1)), F.sum(_col(c)))


def count_if(c: Column | str) -> Column:
    """Aggregate: number of rows where the condition holds."""
    return F.count_if(_col(c))


def complete_cases(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop rows with NULL or NaN in any of ``cols`` (all columns by default)."""
    return df.dropna("any", subset=cols)


def recode(c: Column | str, mapping: dict, default=None, keep: bool = True) -> Column:
    """Replace listed values. Others keep their value, or take ``default`` when ``keep`` is false.

    The mapping is a literal of the plan, so it is for hand-written maps; join a lookup table for
    anything larger.
    """
    c = _col(c)
    chain = None
    for old, new in mapping.items():
        chain = F.when(c == old, F.lit(new)) if chain is None else chain.when(c == old, F.lit(new))
    other = c if keep else F.lit(default)
    return other if chain is None else chain.otherwise(other)


def override(c: Column | str, source: Column | str, mapping: dict) -> Column:
    """``c``, except where ``source`` holds a listed value: then the mapped value."""
    source = _col(source)
    chain = None
    for old, new in mapping.items():
        chain = F.when(source == old, F.lit(new)) if chain is None else chain.when(source == old, F.lit(new))
    return _col(c) if chain is None else chain.otherwise(_col(c))


def band(c: Column | str, edges: list[float], labels: list[str]) -> tuple[Column, Column]:
    """Value bands with inclusive upper edges. Returns (label, 1-based order); NULL and NaN give NULL."""
    if len(labels) != len(edges) + 1:
        raise ValueError("need one label more than edges")
    c = nan_to_null(c)
    label = order = None
    for i, edge in enumerate(edges):
        if label is None:
            label, order = F.when(c <= edge, F.lit(labels[i])), F.when(c <= edge, F.lit(i + 1))
        else:
            label, order = label.when(c <= edge, F.lit(labels[i])), order.when(c <= edge, F.lit(i + 1))
    label, order = label.when(c > edges[-1], F.lit(labels[-1])), order.when(c > edges[-1], F.lit(len(labels)))
    return label, order
