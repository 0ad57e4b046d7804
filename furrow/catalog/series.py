"""Counts over time: densified, cumulative, stacked and relative series."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.catalog.base import Tables, query
from furrow.constants import THEME_LEVELS
from furrow.functions import nulls, text
from furrow.operators import aggregates, ordering, relational, reshape


@query(
    "cumulative_by_year",
    """
    with long as (select o_orderkey, o_custkey, cast(year(o_orderdate) as bigint) as year, unnest(string_split(o_orderpriority, '-')) as v,
                         o_totalprice from orders),
    named as (select distinct o_custkey, year, upper(v[1]) || lower(v[2:]) as theme from long
              where v not in ('', '1', '2', '3', '4', '5')),
    counts as (select year, theme, count(distinct o_custkey) as n from named group by all),
    span as (select min(year) as lo, max(year) as hi from counts),
    grid as (select theme, unnest(generate_series((select lo from span), (select hi from span))) as year
             from (select distinct theme from counts where theme in ('Urgent', 'High', 'Low')))
    select theme, year, coalesce(n, 0) as n,
           cast(sum(coalesce(n, 0)) over (partition by theme order by year) as bigint) as cumulative,
           cast(case theme when 'Urgent' then 1 when 'High' then 2 when 'Low' then 3 end as bigint) as theme_ord
    from grid left join counts using (theme, year)
    """,
)
def cumulative_by_year(spark, folder):
    o = Tables(spark, folder).orders
    studies = o.select(
        F.col("o_custkey").alias("study_id"), F.year("o_orderdate").cast("bigint").alias("year"), "o_orderpriority"
    )
    long = reshape.explode_multivalue(studies, ["study_id", "year"], {"theme": "o_orderpriority"}, "-")
    named = long.filter(~F.col("value").rlike("^[0-9]$")).select(
        "study_id", "year", F.concat(F.upper(F.substring("value", 1, 1)), F.lower(F.substr("value", F.lit(2)))).alias("theme")
    )
    counts = aggregates.n_distinct(named, ["year", "theme"], "study_id")
    levels = ["Urgent", "High", "Low"]
    kept = counts.filter(nulls.is_member("theme", levels))
    series = reshape.cumulative_by(kept, ["theme"], "year", "n", bounds=counts)
    return series.withColumn("theme_ord", ordering.fixed_order("theme", levels).cast("bigint")).select(
        "theme", "year", "n", "cumulative", "theme_ord"
    )


@query(
    "cumulative_cross_cutting",
    """
    with themes as (select distinct o_custkey as study_id, case o_orderstatus when 'F' then 'gender' else 'environmental impacts' end as theme
                    from orders where o_orderstatus in ('F', 'P')),
    included as (select c_custkey as study_id from customer),
    meta as (select o_custkey as study_id, cast(nullif(min(year(o_orderdate)), 1997) as bigint) as year from orders group by 1),
    joined as (select coalesce(t.study_id, i.study_id) as study_id, coalesce(theme, 'no cross-cutting theme') as theme
               from themes t full join included i on t.study_id = i.study_id),
    named as (select j.study_id, year, case theme when 'gender' then 'Gender' when 'environmental impacts' then 'Environmental Impacts'
                     else 'No Cross-Cutting Theme' end as theme from joined j left join meta m on j.study_id = m.study_id),
    counts as (select year, theme, count(distinct study_id) as n from named group by all),
    span as (select min(year) as lo, max(year) as hi from counts),
    grid as (select theme, unnest(generate_series((select lo from span), (select hi from span))) as year
             from (select distinct theme from counts))
    select theme, year, coalesce(n, 0) as n,
           cast(sum(coalesce(n, 0)) over (partition by theme order by year) as bigint) as cumulative,
           cast(case theme when 'Environmental Impacts' then 1 when 'No Cross-Cutting Theme' then 2 when 'Gender' then 3 end as bigint) as theme_ord
    from grid left join counts using (theme, year)
    """,
)
def cumulative_cross_cutting(spark, folder):
    t = Tables(spark, folder)
    themes = (
        t.orders.filter(nulls.is_member("o_orderstatus", ["F", "P"]))
        .select(
            F.col("o_custkey").alias("study_id"),
            nulls.recode("o_orderstatus", {"F": "gender"}, "environmental impacts", keep=False).alias("theme"),
        )
        .distinct()
    )
    included = t.customer.select(F.col("c_custkey").alias("study_id"))
    meta = (
        t.orders.groupBy(F.col("o_custkey").alias("study_id"))
        .agg(F.nullif(F.min(F.year("o_orderdate")), F.lit(1997)).cast("bigint").alias("year"))
    )
    joined = relational.merge(themes, included, on="study_id", how="full", null_keys="drop")
    dated = relational.merge(joined, meta, on="study_id", null_keys="drop")
    named = dated.withColumn("theme", text.title_words(nulls.fill("theme", "no cross-cutting theme")))
    counts = aggregates.n_distinct(named, ["year", "theme"], "study_id")
    series = reshape.cumulative_by(counts, ["theme"], "year", "n")
    return series.withColumn("theme_ord", ordering.fixed_order("theme", THEME_LEVELS).cast("bigint")).select(
        "theme", "year", "n", "cumulative", "theme_ord"
    )


_DAILY = """
    counts as (select cast(date_diff('day', date '2024-01-01', cast(ts as date)) as bigint) as day, event_type, count(distinct user_id) as n
               from events group by all),
    span as (select min(day) as lo, max(day) as hi from counts),
    grid as (select event_type, unnest(generate_series((select lo from span), (select hi from span))) as day
             from (select distinct event_type from counts)),
    dense as (select event_type, day, coalesce(n, 0) as n,
                     sum(coalesce(n, 0)) over (partition by event_type order by day) as nc
              from grid left join counts using (event_type, day))
"""


def _daily(t: Tables):
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
    dated = t.events.select(day.alias("day"), "event_type", "user_id")
    counts = aggregates.n_distinct(dated, ["day", "event_type"], "user_id")
    return reshape.cumulative_by(counts, ["event_type"], "day", "n", "nc")


@query(
    "stacked_position",
    f"""
    with {_DAILY},
    tot as (select event_type, max(nc) as tot from dense group by 1),
    ranked as (select event_type, tot, row_number() over (order by tot desc, event_type) as ord from tot)
    select event_type, day, n, cast(nc as bigint) as nc, cast(tot as bigint) as tot, cast(ord as bigint) as ord,
           cast(sum(nc) over (partition by day order by ord desc) as bigint) as position
    from dense join ranked using (event_type)
    """,
)
def stacked_position(spark, folder):
    series = relational.group_max(_daily(Tables(spark, folder)), "nc", ["event_type"], "tot")
    ordered = ordering.category_order(series, "event_type", F.max("tot"), "ord")
    placed = reshape.stack_position(ordered, "day", "ord", "nc")
    return placed.select("event_type", "day", "n", "nc", "tot", F.col("ord").cast("bigint").alias("ord"), "position")


@query(
    "pct_of_year",
    f"""
    with {_DAILY},
    best as (select event_type, max(n) as biggest from dense group by 1)
    select event_type, day, cast(biggest as bigint) as biggest, round(100.0 * nc / nullif(sum(nc) over (partition by day), 0), 6) as pc
    from dense join best using (event_type)
    """,
)
def pct_of_year(spark, folder):
    series = relational.group_max(_daily(Tables(spark, folder)), "n", ["event_type"], "biggest")
    return reshape.pct_of(series, "nc", ["day"], "pc").select("event_type", "day", "biggest", F.round("pc", 6).alias("pc"))


@query(
    "densify_only",
    """
    with counts as (select user_id, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as bigint) as day, count(*) as n
                    from events group by all),
    span as (select min(day) as lo, max(day) as hi from counts),
    grid as (select user_id, unnest(generate_series((select lo from span), (select hi from span))) as day
             from (select distinct user_id from counts))
    select user_id, day, coalesce(n, 0) as n from grid left join counts using (user_id, day)
    """,
)
def densify_only(spark, folder):
    e = Tables(spark, folder).events
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
    counts = aggregates.count_by(e.select("user_id", day.alias("day")), ["user_id", "day"])
    return reshape.densify(counts, ["user_id"], "day")


@query(
    "outcomes_by_year",
    """
    select year, outcome, count(distinct o_custkey) as n
    from (select o_custkey, cast(year(o_orderdate) as bigint) as year,
                 case when regexp_matches(o_orderpriority, 'urgent|high', 'i') then 'Yield' else o_orderpriority end as outcome
          from orders)
    where outcome <> '5-LOW' group by all
    """,
)
def outcomes_by_year(spark, folder):
    o = Tables(spark, folder).orders
    outcome = nulls.if3(text.matches_ci("o_orderpriority", "urgent|high"), F.lit("Yield"), F.col("o_orderpriority"))
    dated = o.select("o_custkey", F.year("o_orderdate").cast("bigint").alias("year"), outcome.alias("outcome"))
    return aggregates.n_distinct(dated.filter(F.col("outcome") != "5-LOW"), ["year", "outcome"], "o_custkey")
