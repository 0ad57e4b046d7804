"""Group summaries. Every one is a two-phase hash aggregate; totals are taken from the first result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.nulls import pct, sum_skip, sum_strict
from furrow.operators.relational import group_stat


def count_by(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def n_distinct(df: DataFrame, by: list[str], col: str, name: str = "n", approximate: float | None = None) -> DataFrame:
    """Distinct count per group, NULL counted as a value. ``approximate`` gives the wanted relative error.

    Spark first removes duplicates on (by, col), so a hot group is spread by ``col``.
    """
    has_null = F.max(F.col(col).isNull().cast("int"))
    if approximate:
        return df.groupBy(*by).agg((F.approx_count_distinct(col, approximate) + has_null).alias(name))
    return df.groupBy(*by).agg((F.count_distinct(F.col(col)) + has_null).alias(name))


def pooled_pct(df: DataFrame, num: str, den: str, by: list[str], name: str = "p") -> DataFrame:
    """Percentage of sums, not the mean of percentages."""
    return df.groupBy(*by).agg(pct(sum_skip(num), sum_skip(den)).alias(name))


def with_total(
    df: DataFrame, detail: str, keys: list[str], sums: dict[str, str], label: str
) -> DataFrame:
    """Sums per (detail, keys) plus a ``label`` row per keys, from one scan.

    The rows are summed to (detail, keys) first; the grouping sets then expand that small result. The
    label marks the total row by ``grouping()``, so a NULL detail keeps its own row.
    """
    base = df.groupBy(detail, *keys).agg(*[sum_skip(c).alias(n) for n, c in sums.items()])
    sets = [[F.col(detail), *map(F.col, keys)], [F.col(k) for k in keys]]
    both = base.groupingSets(sets, F.col(detail), *map(F.col, keys)).agg(
        F.grouping(detail).alias("__is_total"), *[sum_skip(n).alias(f"__{n}") for n in sums]
    )
    return both.select(
        F.when(F.col("__is_total") == 1, F.lit(label)).otherwise(F.col(detail)).alias(detail),
        *keys,
        *[F.col(f"__{n}").alias(n) for n in sums],
        (F.col("__is_total") == 1).alias("is_total"),
    )


def share_of_total(df: DataFrame, by: list[str], within: list[str], cols: dict[str, str]) -> DataFrame:
    """Percent of the ``by`` total held by each (by, within); NULL when the part holds a NULL.

    ``cols`` maps output name to input column. The denominator skips NULL, the numerator does not.
    """
    parts = df.groupBy(*by, *within).agg(
        *[sum_strict(c).alias(f"__p_{n}") for n, c in cols.items()],
        *[sum_skip(c).alias(f"__s_{n}") for n, c in cols.items()],
    )
    whole = group_stat(parts, by, **{f"__t_{n}": F.sum(f"__s_{n}") for n in cols})
    return whole.select(*by, *within, *[pct(f"__p_{n}", f"__t_{n}").alias(n) for n in cols])


def crosstab(df: DataFrame, rows: list[str], col: str, values: list | None = None) -> DataFrame:
    """Counts of ``rows`` by ``col`` in wide form, zero for pairs never seen. NULL in ``col`` has no column.

    With ``values``, which are then the columns, a row with any other value fails the job rather than being left out.
    Without, the distinct values are looked up first: they are the names of columns, so the driver has to know
    them (at most ``spark.sql.pivotMaxValues``). ``crosstab_long`` needs no names.
    """
    if values is not None:
        text = F.concat(F.lit(f"crosstab: {col} has a value outside the given ones: "), F.col(col).cast("string"))
        known = F.col(col).isNull() | F.col(col).isin(values)
        df = df.withColumn(col, F.when(known, F.col(col)).otherwise(F.raise_error(text).cast(df.schema[col].dataType)))
    wide = df.groupBy(*rows).pivot(col, values).agg(F.count(F.lit(1)))
    counts = [c for c in wide.columns if c not in rows]
    return wide.na.fill(0, counts)


def crosstab_long(df: DataFrame, rows: list[str], col: str, name: str = "n") -> DataFrame:
    """Counts of ``rows`` by ``col`` in long form, zero for pairs never seen; every value of ``col`` but NULL has a part.

    The values come from the counted groups, so none is lost and none is collected. A group of ``rows`` with
    NULLs is a group. One row per distinct group and value: sizes of the result, not of the data.
    """
    counts = df.groupBy(*rows, col).agg(F.count(F.lit(1)).alias(name))
    values = counts.filter(F.col(col).isNotNull()).agg(F.array_sort(F.collect_set(col)).alias("__values"))
    groups = counts.groupBy(*rows).agg(F.map_from_entries(F.collect_list(F.when(F.col(col).isNotNull(), F.struct(col, name)))).alias("__seen"))
    wide = groups.withColumn("__values", values.scalar())
    each = wide.select(*rows, "__seen", F.explode("__values").alias(col))
    return each.select(*rows, col, F.coalesce(F.try_element_at("__seen", F.col(col)), F.lit(0)).cast("bigint").alias(name))


def fold_summary(df: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean and population standard deviation of each metric over the folds."""
    aggs: list[Column] = [F.avg(m).alias(f"mean_{m}") for m in metrics]
    aggs += [F.stddev_pop(m).alias(f"std_{m}") for m in metrics]
    return df.groupBy(*(by or [])).agg(*aggs)
