"""Products of the evidence review: from the survey to the frame behind each figure.

``long`` is the keyword table (study_id, category, subcategory). Nearly every product reads it, so
store it once (``hand_off``) before building them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.constants import (
    ALL_LMIC,
    COMMA_LABELS,
    COUNTRY_CODES,
    OUTCOME_LEVELS,
    REGIONS,
    SCARCE,
    SHORT_COUNTRY_NAMES,
    SMALL,
    STUDY_TYPE_NOISE,
    SURVEY_CATEGORIES,
    SYSTEM_LEVELS,
    THEME_LEVELS,
    YIELD_PATTERN,
)
from furrow.functions import nulls, text
from furrow.lineage import cut
from furrow.operators import aggregates, ordering, relational, reshape


def included_studies(survey: DataFrame) -> DataFrame:
    """study_id of every study that met the inclusion criteria, as often as it occurs."""
    return survey.filter(F.col("inclusion") == "Yes").select(text.to_int("study_id").alias("study_id"))


def keyword_long(survey: DataFrame) -> DataFrame:
    """(study_id, category, subcategory), lower case, without empty answers and ``no``. No shuffle."""
    kept = survey.filter(F.col("inclusion") == "Yes").withColumn("study_id", text.to_int("study_id"))
    long = reshape.explode_multivalue(
        kept,
        ["study_id"],
        SURVEY_CATEGORIES,
        protect={"type of study": COMMA_LABELS},
        empty={"environmental impacts": "No"},
        value="subcategory",
    )
    return long.withColumn("subcategory", F.lower("subcategory")).filter(F.col("subcategory") != "no")


def _of(long: DataFrame, *categories: str) -> DataFrame:
    return long.filter(nulls.is_member("category", list(categories)))


def _dated(df: DataFrame, metadata: DataFrame) -> DataFrame:
    return relational.merge(df, metadata, on="study_id")


def _per_year(df: DataFrame, name: str) -> DataFrame:
    """Studies per (year, ``name``)."""
    return aggregates.n_distinct(df, ["year", name], "study_id")


def _series(df: DataFrame, name: str, keep: Column | None = None) -> DataFrame:
    """Cumulative studies per ``name``, over the years of all names and then only the kept ones.

    The counts are a few rows that every step of the series reads, so they are computed once.
    """
    counts = cut(_per_year(df, name))
    return reshape.cumulative_by(counts if keep is None else counts.filter(keep), [name], "year", "n", bounds=counts)


def country_counts(long: DataFrame, classes: DataFrame) -> DataFrame:
    """Studies per country name with its code. ``classes``: country_code, country_name, group_name."""
    names = _of(long, "country").select(text.title_words(text.trim_all("subcategory")).alias("country_name"))
    counts = aggregates.count_by(names, ["country_name"])
    codes = classes.select("country_code", "country_name").distinct()
    joined = relational.merge(counts, codes, on="country_name")
    return joined.withColumn("country_code", nulls.override("country_code", "country_name", COUNTRY_CODES))


def funding_needs(
    farms: DataFrame, counts: DataFrame, n: int = 15, shown: int = 35, null_keys: str = "drop"
) -> DataFrame:
    """The countries with most small farms in scarce regions per income group, with their studies."""
    needs = farms.filter((F.col("water_scarce") == SCARCE) & (F.col("size") == SMALL))
    needs = needs.withColumns(
        {
            "water_scarce": text.paste(text.title_words("water_scarce"), F.lit("Regions")),
            "size": text.paste(text.title_words("size"), F.lit("Farms")),
            "income_group": text.title_words("income_group"),
        }
    )
    studies = counts.select(F.col("country_code").alias("__code"), F.col("country_name").alias("studied_as"), "n")
    joined = relational.merge(needs, studies, left_on="iso3_usable", right_on="__code", null_keys=null_keys)
    best = reshape.top_n(joined.withColumn("n", nulls.fill("n", 0)), ["income_group"], "tot_fs", n)
    order = [F.col("income_group").asc_nulls_last(), F.col("tot_fs").desc_nulls_last(), F.col("country").asc_nulls_last()]
    placed = ordering.reverse_index(best, order, shown).withColumns(
        {"tot_fs": F.col("tot_fs") / 1000000, "country": nulls.recode("country", SHORT_COUNTRY_NAMES)}
    )
    return placed.withColumn("log_fs", F.log1p("tot_fs"))


def outcome_matrix(long: DataFrame) -> DataFrame:
    """Studies per (outcome, intervention, study type), with the orders the figure is laid out by."""
    kept = _of(long, "outcomes", "interventions", "type of study").filter(
        (F.col("subcategory") != "other") & (F.col("subcategory") != "labor")
    )
    kept = nulls.complete_cases(
        kept.withColumn(
            "subcategory",
            F.when(text.matches_ci("subcategory", YIELD_PATTERN), F.lit("yield")).otherwise(F.col("subcategory")),
        )
    ).distinct()
    side = lambda category, name: _of(kept, category).select("study_id", F.col("subcategory").alias(name))
    # studies without one of the three count nowhere, and pairs never seen are dropped by the figure,
    # so inner joins and the long counts are enough; the counts are few and read three times
    pairs = relational.merge(side("outcomes", "outcome"), side("interventions", "intervention"), on="study_id", how="inner")
    triples = relational.merge(pairs, side("type of study", "studytype"), on="study_id", how="inner")
    counts = cut(aggregates.count_by(triples, ["outcome", "intervention", "studytype"], "value"))
    named = counts.select(
        text.title_words("outcome").alias("outcome"),
        nulls.recode(text.title_words("intervention"), {"Conservation": "Natural Resource\nProtection"}).alias("intervention"),
        text.trim_all(text.remove_all(text.title_words("studytype"), STUDY_TYPE_NOISE)).alias("studytype"),
        "value",
    )
    ordered = ordering.category_order(named, "studytype", F.sum("value"), "studytype_ord")
    ordered = ordering.category_order(ordered, "intervention", F.sum("value"), "intervention_ord")
    return ordered.withColumn("outcome_ord", ordering.fixed_order("outcome", OUTCOME_LEVELS))


def system_series(long: DataFrame, metadata: DataFrame) -> DataFrame:
    """Cumulative studies of crop, mixed and livestock systems."""
    kept = nulls.complete_cases(_of(long, "crop_livestock").select("subcategory", "study_id")).distinct()
    named = _dated(kept, metadata).withColumn("system", text.title_words("subcategory"))
    series = _series(named, "system", nulls.is_member("system", SYSTEM_LEVELS))
    return series.withColumn("system_ord", ordering.fixed_order("system", SYSTEM_LEVELS))


def theme_series(long: DataFrame, included: DataFrame, metadata: DataFrame) -> DataFrame:
    """Cumulative studies per cross-cutting theme, studies without one included."""
    themes = nulls.complete_cases(_of(long, "gender", "environmental impacts").select("category", "study_id")).distinct()
    every = nulls.complete_cases(included).distinct()
    joined = _dated(relational.merge(themes, every, on="study_id", how="full"), metadata)
    named = joined.withColumn("theme", text.title_words(nulls.fill("category", "no cross-cutting theme")))
    series = _series(named, "theme")
    return series.withColumn("theme_ord", ordering.fixed_order("theme", THEME_LEVELS))


def impact_series(long: DataFrame, metadata: DataFrame) -> DataFrame:
    """Cumulative studies per environmental impact, ordered by total, with stacked label positions."""
    kept = nulls.complete_cases(_of(long, "environmental impacts").select("subcategory", "study_id")).distinct()
    dated = _dated(kept, metadata).filter(F.col("subcategory") != "environmental")
    named = dated.withColumn("impact", nulls.recode(text.title_words("subcategory"), {"Climate Change": "GHG Emissions"}))
    series = _series(named, "impact", F.col("impact") != "Other")
    series = relational.group_max(series, "cumulative", ["impact"], "tot")
    ordered = ordering.category_order(series, "impact", F.max("tot"), "impact_ord")
    return reshape.stack_position(ordered, "year", "impact_ord", "cumulative")


def farms_by_region(farms: DataFrame, classes: DataFrame) -> DataFrame:
    """Country summaries with their region."""
    regions = classes.filter(nulls.is_member("group_name", REGIONS)).select("country_code", "country_name", "group_name")
    return relational.merge(farms, regions, left_on="iso3_usable", right_on="country_code")


def complete_farms(by_region: DataFrame) -> DataFrame:
    """Rows with a finite irrigated share and nothing missing."""
    return nulls.complete_cases(by_region.filter(nulls.is_finite("p_irr_fs")))


def region_shares(by_region: DataFrame) -> DataFrame:
    """Irrigated share of farms per region, scarcity and size, and over all regions, in figure order."""
    sums = {"tot": "tot_fs", "tot_irr_fs": "t_irr_fs"}
    both = aggregates.with_total(complete_farms(by_region), "group_name", ["water_scarce", "size"], sums, ALL_LMIC)
    shares = both.withColumn("p_irr_fs", nulls.pct("tot_irr_fs", "tot"))
    # one row per (region, scarcity, size): as many as the figure has bars
    order = [F.col("is_total").desc(), F.col("water_scarce").desc(), F.col("size").desc(), F.col("p_irr_fs").asc_nulls_last()]
    placed = shares.withColumn("place", F.row_number().over(Window.orderBy(*order, "group_name")))
    first = relational.group_min(placed, "place", ["group_name"], "__first")
    return first.withColumn("group_ord", F.dense_rank().over(Window.orderBy("__first"))).select(
        "group_name", "water_scarce", "size", "p_irr_fs", "place", "group_ord"
    )


def country_shares(by_region: DataFrame) -> DataFrame:
    return complete_farms(by_region).withColumn("size", text.paste("size", F.lit("farms")))


def size_shares(by_region: DataFrame) -> DataFrame:
    """Irrigated share of farms per farm size."""
    return aggregates.pooled_pct(complete_farms(by_region), "t_irr_fs", "tot_fs", ["size"], "p_irr_fs")


def scarce_shares(by_region: DataFrame) -> DataFrame:
    """Share of farms and area of each size found in scarce regions."""
    shares = aggregates.share_of_total(by_region, ["size"], ["water_scarce"], {"p_f": "tot_fs", "p_a": "tot_ag"})
    return nulls.complete_cases(shares)


def intervention_shares(long: DataFrame, metadata: DataFrame) -> DataFrame:
    """Share of each intervention in the cumulative studies of every year."""
    kept = _dated(nulls.complete_cases(long).filter(F.col("category") == "interventions").distinct(), metadata)
    named = kept.withColumn(
        "intervention", text.title_words(nulls.recode("subcategory", {"conservation": "natural-resource protection"}))
    )
    series = _series(named, "intervention")
    shares = reshape.pct_of(series, "cumulative", ["year"], "pc")
    return ordering.category_order(shares, "intervention", F.max("n"), "intervention_ord")


def outcome_counts(long: DataFrame, metadata: DataFrame) -> DataFrame:
    """Studies per outcome and year."""
    is_yield = text.matches_ci("subcategory", YIELD_PATTERN)
    named = _dated(_of(long, "outcomes").drop("category"), metadata).withColumn(
        "outcome", nulls.if3(is_yield, F.lit("Yield"), text.title_words("subcategory"))
    )
    return _per_year(named.filter(F.col("outcome") != "Other"), "outcome")
