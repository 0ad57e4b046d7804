"""Exact per-group quantiles that survive hot groups.

Rows are summed once per (group, value); the sums are stored in ranges of (group, value). The weight of each
(group, range) gives the range in which a group's target falls, and only the rows of that range are put in order. A
group of any size is spread over the ranges, and no list of values is ever built.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.nulls import if3, nan_to_null
from furrow.lineage import cut
from furrow.operators.ordering import AT, range_of, ranged, same

Reached = Callable[[Column, Column], Column]  # (running weight, total weight) -> target reached


def _first_reaching(stored: DataFrame, by: list[str], targets: dict[str, Reached], usable: Column | None = None) -> DataFrame:
    """``stored`` is a ``ranged`` frame of by, __x, __w with one row per (by, __x). One row per group, one column per target.

    A group has at most as many range sums as there are ranges. A target is settled in a range of one group; rows of
    other ranges are dropped by a semi-join-like filter before anything is sorted.
    """
    rows = (stored if usable is None else stored.filter(usable)).withColumn("__range", range_of())
    in_order = Window.partitionBy(*by).orderBy("__range")
    sums = rows.groupBy(*by, "__range").agg(F.sum("__w").alias("__bw"))
    running = sums.select(
        *by,
        "__range",
        F.sum("__bw").over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("__cum"),
        F.coalesce(F.sum("__bw").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__bw").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__tot"),
    )
    spot = F.struct(F.col("__range").alias("b"), F.col("__before").alias("before"), F.col("__tot").alias("tot"))
    keys = [f"__k{i}" for i in range(len(by))]
    found = [
        F.struct(F.lit(i).alias("which"), F.min_by(spot, F.when(reached(F.col("__cum"), F.col("__tot")), F.col("__range"))).alias("at"))
        for i, reached in enumerate(targets.values())
    ]
    hits = running.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]).agg(F.array(*found).alias("__hits"))
    hits = hits.select(*keys, F.explode("__hits").alias("__h")).select(
        *keys,
        F.col("__h.which").alias("__which"),
        F.col("__h.at.b").alias("__spot"),
        F.col("__h.at.before").alias("__before"),
        F.col("__h.at.tot").alias("__tot"),
    )
    inside = rows.join(hits, same([*by, "__range"], [*keys, "__spot"]), "inner")
    within = Window.partitionBy(*by, "__which").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("__cum", F.col("__before") + F.sum("__w").over(within))
    picks = []
    for i, (name, reached) in enumerate(targets.items()):
        mine = F.col("__which") == i
        first = F.min(F.when(mine & reached(F.col("__cum"), F.col("__tot")), F.col("__x")))
        # The two running sums may differ in the last bit; the range's last value is then the answer.
        picks.append(F.coalesce(first, F.max(F.when(mine, F.col("__x")))).alias(name))
    return inside.groupBy(*by).agg(*picks)


def weighted_quantile(
    df: DataFrame, x: str, w: str, q: float, by: list[str], name: str = "threshold", buckets: int | None = None
) -> DataFrame:
    """Smallest ``x`` whose cumulative weight share reaches ``q``: one row per group with a valid pair.

    Rows with NULL or NaN ``x``, or NULL, NaN or zero ``w`` are left out. ``df`` is computed once, into sums.
    """
    if not 0 <= q < 1:
        raise ValueError("q must be in [0, 1)")
    valid = df.select(
        *by, nan_to_null(F.col(x).cast("double")).alias("__x"), nan_to_null(F.col(w).cast("double")).alias("__w")
    ).filter(F.col("__x").isNotNull() & (F.col("__w") > 0))
    weights = valid.groupBy(*by, "__x").agg(F.sum("__w").alias("__w"))
    return quantile_of_weights(weights, by, q, name, buckets)


def quantile_of_weights(weights: DataFrame, by: list[str], q: float, name: str, buckets: int | None = None) -> DataFrame:
    """The same from rows already summed to one per (by, __x) with a weight __w above 0."""
    stored = ranged(weights, [*[F.col(c) for c in by], F.col("__x")], buckets)
    return _first_reaching(stored, by, {name: lambda cum, tot: cum / tot >= q})


def quantile_of_stored(stored: DataFrame, by: list[str], w: str, q: float, name: str) -> DataFrame:
    """The same from a ``ranged`` frame whose ``__x`` rises in every group, with the weights in column ``w``. A group's values
    may repeat; rows with NULL ``__x`` or without a weight above 0 are left out. So one store serves several weights."""
    rows = stored.select(*by, "__x", F.col(w).alias("__w"), AT)
    return _first_reaching(rows, by, {name: lambda cum, tot: cum / tot >= q}, F.col("__x").isNotNull() & (F.col("__w") > 0))


def median_strict(df: DataFrame, x: str, by: list[str], name: str = "median", buckets: int | None = None) -> DataFrame:
    """Exact median per group (mean of the middle two); NULL when a group holds a NULL or NaN."""
    values = df.select(*by, nan_to_null(F.col(x).cast("double")).alias("__x"))
    weights = values.groupBy(*by, "__x").agg(F.count(F.lit(1)).alias("__w"))
    stored = ranged(weights, [*[F.col(c) for c in by], F.col("__x")], buckets)
    keys = [f"__s{i}" for i in range(len(by))]
    whole = stored.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]).agg(
        F.max(F.col("__x").isNull()).alias("__broken")
    )
    middle = _first_reaching(
        stored, by, {"__lo": lambda cum, tot: cum * 2 >= tot, "__hi": lambda cum, tot: cum * 2 >= tot + 1}, F.col("__x").isNotNull()
    )
    joined = whole.join(middle, same(keys, by), "left")
    value = F.when(~F.col("__broken"), (F.col("__lo") + F.col("__hi")) / 2)
    return joined.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], value.alias(name))


def flag_below_quantile(
    df: DataFrame, x: str, w: str, q: float, by: list[str], threshold: str, flag: str, **kwargs
) -> DataFrame:
    """Add the group's weighted quantile and 1/0 for ``x`` at or below / above it (NULL if either is).

    ``df`` is computed once: it is stored unless it already is.
    """
    df = df if getattr(df, "stored_path", None) else cut(df)
    cuts = weighted_quantile(df, x, w, q, by, threshold, **kwargs)
    keys = [f"__q{i}" for i in range(len(by))]
    cuts = cuts.withColumnsRenamed(dict(zip(by, keys)))
    joined = df.join(cuts, same(by, keys), "left").drop(*keys)
    return joined.withColumn(flag, if3(nan_to_null(F.col(x).cast("double")) <= F.col(threshold), F.lit(1), F.lit(0)))


def mode_first(df: DataFrame, key: list[str], value: str, order: str, name: str = "mode") -> DataFrame:
    """Most frequent value per key, NULL included; of equals, the one seen first by ``order`` (numeric)."""
    counts = df.groupBy(*key, value).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first"))
    return counts.groupBy(*key).agg(F.max_by(F.col(value), F.struct(F.col("__n"), -F.col("__first"))).alias(name))
