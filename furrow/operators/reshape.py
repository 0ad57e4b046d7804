"""Reshaping: multi-value columns to long form, pivots, densified series."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.nulls import _col, empty_to, fill
from furrow.functions.text import replace_first, split_values
from furrow.operators.relational import group_total, merge


def explode_multivalue(
    df: DataFrame,
    id_cols: list[str],
    columns: dict[str, str],
    delimiter: str = ",",
    protect: dict[str, dict[str, str]] | None = None,
    empty: dict[str, str] | None = None,
    category: str = "category",
    value: str = "value",
) -> DataFrame:
    """Several delimited columns to one (id, category, value) row per item, in one pass and no shuffle.

    ``columns`` maps category name to column. ``protect`` rewrites, per category, labels that hold the
    delimiter before the split (first match of each); ``empty`` gives the text an empty cell of a category stands for. Empty items drop.
    """

    def items(name: str, col: str) -> Column:
        text = F.col(col)
        for old, new in (protect or {}).get(name, {}).items():
            text = replace_first(text, old, new)
        if empty and name in empty:
            # only an empty first item is filled; the items after it stay
            text = F.when(text.startswith(delimiter), F.concat(F.lit(empty[name]), text)).otherwise(
                empty_to(text, empty[name])
            )
        return split_values(text, delimiter)

    lists = F.array(*[F.struct(F.lit(n).alias("c"), items(n, c).alias("v")) for n, c in columns.items()])
    return (
        df.select(*id_cols, F.explode(lists).alias("__e"))
        .select(*id_cols, F.col("__e.c").alias(category), F.explode("__e.v").alias(value))
        .filter(F.col(value) != "")
    )


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    """Columns to rows."""
    return df.unpivot(ids, values, name, value)


def densify(
    df: DataFrame,
    keys: list[str],
    col: str,
    bounds: DataFrame | None = None,
    carry: list[str] | None = None,
    fill_with=0,
) -> DataFrame:
    """Every key with every integer of ``col`` from its minimum to its maximum, missing rows filled.

    ``df`` has one row per (keys, col). The range comes from ``bounds`` when given (the frame before
    a category filter). It enters the plan as a scalar subquery, so there is no cross join.
    """
    ends = (df if bounds is None else bounds).agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    span = F.sequence(ends.select("lo").scalar(), ends.select("hi").scalar())
    grid = df.select(*keys).distinct().select(*keys, F.explode(span).alias(col))
    joined = merge(grid, df, on=[*keys, col], how="left")
    carry = [c for c in df.columns if c not in keys and c != col] if carry is None else carry
    return joined.withColumns({c: fill(c, fill_with) for c in carry})


def running_sum(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """Running sum along ``order``. For one row per (by, order): a group is as long as its time axis."""
    window = Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(window))


def cumulative_by(
    df: DataFrame, keys: list[str], time: str, value: str, name: str = "cumulative", bounds: DataFrame | None = None
) -> DataFrame:
    """Densify, zero-fill, running sum: the series behind every cumulative figure."""
    return running_sum(densify(df, keys, time, bounds, [value]), keys, time, value, name)


def pct_of(df: DataFrame, col: str, by: list[str], name: str) -> DataFrame:
    """Percent of the group total of ``col``; NULL where the total is 0."""
    whole = group_total(df, col, by, "__whole")
    return whole.withColumn(name, F.lit(100.0) * _col(col) / F.nullif(F.col("__whole"), F.lit(0))).drop("__whole")


def stack_position(df: DataFrame, time: str, order: str, value: str, name: str = "position") -> DataFrame:
    """Top of each category in the stack of its time slice, last category at the bottom.

    One row per (time, category) expected, so a slice holds as many rows as there are categories.
    """
    window = Window.partitionBy(time).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(window))


def top_n(df: DataFrame, by: list[str], order: str, n: int, rank: str | None = None) -> DataFrame:
    """The ``n`` highest per group with ties; NULL never ranks.

    Rows are counted per (group, value), so ties are one row however many there are, and the ``n`` highest values of
    a group are enough: each has a row. Their ranks come from the counts and meet the rows by group and value.
    No window holds rows of ``df``, which is computed twice, the first time with the group and ``order`` only.
    """
    name = rank or "__rank"
    keys = [f"__g{i}" for i in range(len(by))]
    ranked = df.filter(F.col(order).isNotNull())
    counts = ranked.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(order).alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    falling = Window.partitionBy(*keys).orderBy(F.col("__x").desc())
    highest = counts.withColumn("__at", F.row_number().over(falling)).filter(F.col("__at") <= n)
    above = F.sum("__n").over(falling.rowsBetween(Window.unboundedPreceding, -1))
    places = highest.withColumn(name, (F.coalesce(above, F.lit(0)) + 1).cast("int")).filter(F.col(name) <= n).drop("__n", "__at")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)], F.col(order) == F.col("__x"))
    return ranked.join(places, same).select(*df.columns, *([name] if rank else []))
