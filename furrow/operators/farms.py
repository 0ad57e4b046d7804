"""Measures and classes of farm cells.

A cell frame has: cell_id, fs (farm size), months (scarce months), rain (median monthly rain),
gdp_pc, irri_area, paddy_area, rainfed_area, iso3, country, income_group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.constants import (
    LMIC_INCOMES,
    MIN_USABLE_CELLS,
    NOT_SCARCE,
    NOT_SMALL,
    SCARCE,
    SCARCE_MONTHS,
    SCARCE_RAIN,
    SMALL,
    SMALL_SCALE_QUANTILE,
)
from furrow.functions.nulls import (
    _col,
    complete_cases,
    if3,
    is_member,
    nan_to_null,
    null_if_zero,
    pct,
    ratio,
    row_sum,
    sum_skip,
)
from furrow.lineage import cut, release
from furrow.operators.ordering import ranged
from furrow.operators.quantile import quantile_of_stored
from furrow.operators.relational import lookup_first, merge


def scarcity(months: Column | str, rain: Column | str) -> Column:
    """Scarce with a scarce month or too little rain; NULL when the known part cannot decide."""
    scarce = (nan_to_null(months) >= SCARCE_MONTHS) | (nan_to_null(rain) <= SCARCE_RAIN)
    return if3(scarce, F.lit(SCARCE), F.lit(NOT_SCARCE))


ALLOCATIONS = ("none", "rainfed", "irrigation")


def _sides(paddy: Column | str) -> tuple[Column, Column]:
    """Irrigated and rain-fed area under an allocation."""
    how = F.lit(paddy) if isinstance(paddy, str) else paddy
    irrigated = F.when(how == "irrigation", row_sum("irri_area", "paddy_area")).otherwise(F.col("irri_area"))
    rainfed = F.when(how == "rainfed", row_sum("rainfed_area", "paddy_area")).otherwise(F.col("rainfed_area"))
    return irrigated, rainfed


def areas(df: DataFrame, paddy: Column | str = "irrigation") -> DataFrame:
    """Irrigated, rain-fed and total area. ``paddy``: counted as irrigation, rainfed or none.

    ``paddy`` may be a column, so that several allocations run in one job. The side paddy is added
    to skips NULL; a total of 0 is NULL.
    """
    irrigated, rainfed = _sides(paddy)
    split = df.withColumns({"irri_area": irrigated, "rainfed_area": rainfed})
    return split.withColumn("tot_area", null_if_zero(row_sum("irri_area", "rainfed_area")))


def _total(area: Column | str, irrigated: Column | str, rainfed: Column | str) -> Column:
    return if3(_col(area).isNotNull(), row_sum(irrigated, rainfed), F.lit(None).cast("double"))


def farm_counts(df: DataFrame) -> DataFrame:
    """Farms per cell: area by farm size, per class and in total; no total without area."""
    counted = df.withColumns({"irri_farms": ratio("irri_area", "fs"), "rainfed_farms": ratio("rainfed_area", "fs")})
    return counted.withColumn("tot_farms", _total("tot_area", "irri_farms", "rainfed_farms"))


def tot_farms(paddy: str) -> Column:
    """The farms of a raw cell under an allocation, as ``farm_counts`` of its ``areas`` has them."""
    irrigated, rainfed = _sides(paddy)
    return _total(null_if_zero(row_sum(irrigated, rainfed)), ratio(irrigated, "fs"), ratio(rainfed, "fs"))


def country_thresholds(
    df: DataFrame,
    q: float = SMALL_SCALE_QUANTILE,
    min_cells: int = MIN_USABLE_CELLS,
    by: list[str] | None = None,
    buckets: int | None = None,
    weights: dict[str, str] | None = None,
) -> DataFrame:
    """Per (by, iso3): iso3_usable and the thresholds t_fs, t_gdp and minima min_fs, min_gdp of its group.

    Countries with more than ``min_cells`` farm-size cells are groups of their own; all others pool in
    the NULL group. Thresholds are quantiles weighted by farm count. Product per head counts only in
    cells with a farm size. ``weights`` names a column of farm counts for each allocation, in place of ``tot_farms``;
    there is then one row per (allocation, by, iso3).

    The frame is read once, into weights per (by, iso3, measure, value). That profile is stored and put in ranges once,
    with all weights side by side; everything after it works on these alone.
    """
    by = by or []
    named = {f"__w{i}": c for i, c in enumerate((weights or {"": "tot_farms"}).values())}
    has_size = F.col("fs").isNotNull()
    measures = F.array(
        F.struct(F.lit("fs").alias("m"), F.col("fs").alias("x")),
        F.struct(F.lit("gdp").alias("m"), F.when(has_size, F.col("gdp_pc")).alias("x")),
    )
    counted = [nan_to_null(F.col(c)).alias(w) for w, c in named.items()]
    long = df.select(*by, "iso3", *counted, F.explode(measures).alias("__e")).select(
        *by, "iso3", F.col("__e.m").alias("measure"), F.col("__e.x").alias("__x"), *named
    )
    profile = cut(
        long.groupBy(*by, "iso3", "measure", "__x").agg(
            F.count(F.lit(1)).alias("__n"), *[F.sum(F.when(F.col(w) > 0, F.col(w))).alias(w) for w in named]
        )
    )
    sized = (F.col("measure") == "fs") & F.col("__x").isNotNull()
    countries = profile.groupBy(*by, "iso3").agg(F.sum(F.when(sized, F.col("__n")).otherwise(0)).alias("__cells"))
    # stored, as is the result: one row per country, whose size the planner then knows, so nothing need move to meet it
    usable = cut(countries.select(*by, "iso3", F.when(F.col("__cells") > min_cells, F.col("iso3")).alias("iso3_usable")))

    group = [*by, "iso3_usable", "measure"]
    stored = ranged(profile, [*by, "measure", "__x"], buckets)
    pooled = merge(stored, usable, on=[*by, "iso3"])
    lows = cut(pooled.filter(F.col("__x").isNotNull()).groupBy(*group).agg(F.min("__x").alias("low")))
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))

    def of(w: str) -> DataFrame:
        wide = (
            merge(lows, quantile_of_stored(pooled, group, w, q, "t"), on=group)
            .groupBy(*group[:-1])
            .agg(
                pick("fs", "t").alias("t_fs"),
                pick("fs", "low").alias("min_fs"),
                pick("gdp", "t").alias("t_gdp"),
                pick("gdp", "low").alias("min_gdp"),
            )
        )
        return merge(usable, wide, on=[*by, "iso3_usable"])

    made = [of(w) for w in named]
    if weights:
        made = [m.select(F.lit(a).alias("allocation"), "*") for a, m in zip(weights, made, strict=True)]
    out = cut(reduce(DataFrame.unionByName, made))
    for old in (profile, usable, stored, lows):
        release(old)
    return out


def _clean(df: DataFrame) -> DataFrame:
    return df.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in ("fs", "gdp_pc")})


def _classed(cells: DataFrame) -> DataFrame:
    """``score`` and ``size`` of cells with the thresholds of their group."""
    cells = cells.withColumn("b_fs", if3(F.col("fs") <= F.col("t_fs"), F.lit(1), F.lit(0)))
    cells = cells.withColumn("gdp_ag", F.when(F.col("b_fs").isNotNull(), F.col("gdp_pc")))
    cells = cells.withColumn("b_gdp", if3(F.col("gdp_ag") <= F.col("t_gdp"), F.lit(1), F.lit(0)))

    score = row_sum("b_fs", "b_gdp")
    score = if3(F.col("min_fs") == F.col("t_fs"), score + 1, score)
    score = if3(F.col("min_gdp") == F.col("t_gdp"), score + 1, score)
    has_class = F.col("tot_area").isNotNull() & F.col("fs").isNotNull() & is_member("income_group", LMIC_INCOMES)
    size = F.when(has_class, if3(F.col("score") >= 2, F.lit(SMALL), F.lit(NOT_SMALL)))
    return cells.withColumn("score", score).withColumn("size", size)


def classify_small_scale(
    df: DataFrame,
    q: float = SMALL_SCALE_QUANTILE,
    min_cells: int = MIN_USABLE_CELLS,
    by: list[str] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Mark cells of small-scale farms: both farm size and product per head in the lowest share.

    ``by`` adds leading group columns, such as a scenario. The cells meet one row per country in one
    null-safe join; the pooled group of countries with few cells is never brought to one task.
    Eager as to the thresholds, see ``country_thresholds``. ``df`` is read twice: hand in a stored one
    when it is dear to compute.
    """
    by = by or []
    df = _clean(df)
    return _classed(merge(df, country_thresholds(df, q, min_cells, by, buckets), on=[*by, "iso3"]))


def classify_scenarios(
    df: DataFrame,
    allocations: tuple[str, ...] = ALLOCATIONS,
    q: float = SMALL_SCALE_QUANTILE,
    min_cells: int = MIN_USABLE_CELLS,
    buckets: int | None = None,
) -> DataFrame:
    """``classify_small_scale`` of ``scenarios`` by allocation, of raw cells with their scarcity.

    Allocations differ in the farms they count, not in the cells: the thresholds come from one profile that has the counts side by side,
    and a cell becomes one row per allocation only where it is classed. ``df`` is read twice, as there.
    """
    weights = {a: f"__farms{i}" for i, a in enumerate(allocations)}
    counted = _clean(df.withColumns({c: tot_farms(a) for a, c in weights.items()}))
    thresholds = country_thresholds(counted, q, min_cells, None, buckets, weights)
    return _classed(merge(_clean(scenarios(df, allocations)), thresholds, on=["allocation", "iso3"]))


def farm_summary(df: DataFrame, by: list[str], totals: bool = True) -> DataFrame:
    """Irrigated farms and area, their pooled percentages, and all farms and area per group."""
    base = df.groupBy(*by).agg(
        sum_skip("irri_farms").alias("t_irr_fs"),
        sum_skip("irri_area").alias("t_irr_ag"),
        sum_skip("tot_farms").alias("tot_fs"),
        sum_skip("tot_area").alias("tot_ag"),
    )
    out = base.withColumns({"p_irr_fs": pct("t_irr_fs", "tot_fs"), "p_irr_ag": pct("t_irr_ag", "tot_ag")})
    lead = ["t_irr_fs", "t_irr_ag"] if totals else []
    return out.select(*by, *lead, "p_irr_fs", "p_irr_ag", "tot_fs", "tot_ag")


def country_summary(cells: DataFrame) -> DataFrame:
    return farm_summary(cells, ["water_scarce", "iso3_usable", "country", "income_group", "size"])


def global_summary(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per scarcity and size, complete rows only."""
    return complete_cases(farm_summary(cells, [*(by or []), "water_scarce", "size"], totals=False))


def scenarios(df: DataFrame, allocations: tuple[str, ...] = ALLOCATIONS) -> DataFrame:
    """Every cell once per paddy allocation, areas and farm counts done: one job for all scenarios."""
    tagged = df.withColumn("allocation", F.explode(F.array(*[F.lit(a) for a in allocations])))
    return farm_counts(areas(tagged, F.col("allocation")))


def country_of(df: DataFrame, lookup: DataFrame, raster_id: str = "world") -> DataFrame:
    """Country code and name of the raster id: the first match in the lookup (id, seq, iso3, country)."""
    return lookup_first(df, lookup, raster_id, "id", "seq", ["iso3", "country"])


def prepare_cells(frame: DataFrame, paddy: str = "irrigation") -> DataFrame:
    """Scarcity, areas and farm counts of a raw cell frame."""
    return farm_counts(areas(frame.withColumn("water_scarce", scarcity(_col("months"), _col("rain"))), paddy))
