"""The review products on studies made from the trade tables: a study is a customer, its keywords come
from its orders, and farms are the quantities sold per nation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.catalog.base import Tables, query
from furrow.functions import nulls
from furrow.functions.text import title_words
from furrow.operators import relational
from furrow.plans import review

_OUTCOMES = {"1-URGENT": "crop yield", "2-HIGH": "productivity", "3-MEDIUM": "income/expenditure", "4-NOT SPECIFIED": "other", "5-LOW": "food-security"}
_TYPES = {"F": "observational primary data", "O": "experimental primary data", "P": "modelling with secondary data"}
_SYSTEMS = {"BUILDING": "crop", "MACHINERY": "mixed", "FURNITURE": "livestock", "HOUSEHOLD": "fish", "AUTOMOBILE": "forest"}
_IMPACTS = {"1-URGENT": "environmental", "2-HIGH": "other", "3-MEDIUM": "water quantity", "4-NOT SPECIFIED": "biodiversity", "5-LOW": "climate change"}
_MEASURES = {"PROMO": "conservation", "SMALL": "labor", "LARGE": "seeds", "MEDIUM": "irrigation", "ECONOMY": "other", "STANDARD": "soil management"}
_REGIONS = {"AFRICA": "Sub-Saharan Africa", "AMERICA": "Latin America & Caribbean", "ASIA": "South Asia", "EUROPE": "Europe & Central Asia", "MIDDLE EAST": "World"}


def _case(col: str, mapping: dict[str, str]) -> str:
    return f"case {col} " + " ".join(f"when '{k}' then '{v}'" for k, v in mapping.items()) + " end"


_LONG = f"""
    long as (
      select o_custkey as study_id, 'outcomes' as category, {_case('o_orderpriority', _OUTCOMES)} as subcategory from orders
      union all select o_custkey, 'type of study', {_case('o_orderstatus', _TYPES)} from orders
      union all select o_custkey, 'interventions', {_case('p_type', _MEASURES)} from lineitem join orders on l_orderkey = o_orderkey
                join part on l_partkey = p_partkey
      union all select c_custkey, 'crop_livestock', {_case('c_mktsegment', _SYSTEMS)} from customer
      union all select c_custkey, 'country', ' ' || lower(n_name) from customer join nation on c_nationkey = n_nationkey
      union all select o_custkey, 'environmental impacts', {_case('o_orderpriority', _IMPACTS)} from orders
      union all select o_custkey, 'gender', 'gender'  from orders),
    meta as (select o_custkey as study_id, cast(nullif(max(year(o_orderdate)), 1998) as bigint) as year from orders group by 1)
"""


def _long(t: Tables) -> DataFrame:
    def part(frame: DataFrame, key: str, category: str, value) -> DataFrame:
        return frame.select(F.col(key).alias("study_id"), F.lit(category).alias("category"), value.alias("subcategory"))

    said = lambda col, mapping: nulls.recode(col, mapping, None, keep=False)
    o, c = t.orders, t.customer
    returned = t.lineitem.select("l_orderkey", "l_partkey")
    returned = relational.merge(returned, o.select("o_orderkey", "o_custkey"), left_on="l_orderkey", right_on="o_orderkey", how="inner", null_keys="drop")
    returned = relational.merge(returned, t.part.select("p_partkey", "p_type"), left_on="l_partkey", right_on="p_partkey", how="inner", null_keys="drop")
    lived = relational.merge(c, t.nation.select("n_nationkey", "n_name"), left_on="c_nationkey", right_on="n_nationkey", how="inner", null_keys="drop")
    return reduce(
        DataFrame.unionByName,
        [
            part(o, "o_custkey", "outcomes", said("o_orderpriority", _OUTCOMES)),
            part(o, "o_custkey", "type of study", said("o_orderstatus", _TYPES)),
            part(returned, "o_custkey", "interventions", said("p_type", _MEASURES)),
            part(c, "c_custkey", "crop_livestock", said("c_mktsegment", _SYSTEMS)),
            part(lived, "c_custkey", "country", F.concat(F.lit(" "), F.lower("n_name"))),
            part(o, "o_custkey", "environmental impacts", said("o_orderpriority", _IMPACTS)),
            part(o, "o_custkey", "gender", F.lit("gender")),
        ],
    )


def _meta(t: Tables) -> DataFrame:
    dated = t.orders.groupBy(F.col("o_custkey").alias("study_id"))
    return dated.agg(F.nullif(F.max(F.year("o_orderdate")), F.lit(1998)).cast("bigint").alias("year"))


def _integers(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


_TITLE = r"list_aggregate(list_transform(regexp_extract_all(lower({0}), '([\p{{L}}\p{{N}}'']+|[^\p{{L}}\p{{N}}'']+)'), lambda t: upper(t[1]) || t[2:]), 'string_agg', '')"


def _per_year(category: str, name: str, value: str, where: str = "true") -> str:
    """CTE counts (year, name, n) of the distinct keywords of a category."""
    return f"""
    kept as (select distinct study_id, subcategory from long where category = '{category}'),
    counts as (select year, {name}, count(distinct study_id) as n from (select k.study_id, year, {value} as {name} from kept k left join meta m on k.study_id = m.study_id)
               where {where} group by all)
    """


def _dense(name: str, where: str = "true") -> str:
    """CTE dense (name, year, n, cumulative) over the span of all counts."""
    return f"""
    span as (select min(year) as lo, max(year) as hi from counts),
    grid as (select {name}, unnest(generate_series((select lo from span), (select hi from span))) as year from (select distinct {name} from counts where {where})),
    dense as (select g.{name}, g.year, coalesce(n, 0) as n, cast(sum(coalesce(n, 0)) over (partition by g.{name} order by g.year) as bigint) as cumulative
              from grid g left join counts c on g.{name} = c.{name} and g.year = c.year)
    """


@query(
    "keyword_table",
    """
    with s as (select *, left(o_orderpriority, 1) as p from orders where o_orderstatus <> 'P'),
    long as (
      select o_custkey, 'interventions' as category, unnest(string_split(replace(o_orderpriority, '-', ','), ',')) as v from s
      union all select o_custkey, 'outcomes', unnest([o_orderstatus, o_orderpriority]) from s
      union all select o_custkey, 'environmental impacts', unnest(case o_orderstatus when 'F' then ['No'] else ['No', 'Water', o_orderpriority] end) from s
      union all select o_custkey, 'type of study', unnest(case p when '1' then ['Observational primary data', 'Modelling'] when '2' then ['Experimental primary data'] else ['Other'] end) from s
      union all select o_custkey, 'crop_livestock', unnest(['Crop', 'Mixed']) from s where p <> '3'
      union all select o_custkey, 'gender', 'Gender' from s where o_orderkey % 2 = 1
      union all select o_custkey, 'country', unnest([' C' || p, ' Y' || year(o_orderdate)]) from s)
    select cast(o_custkey as integer) as study_id, category, lower(v) as subcategory from long where v <> '' and lower(v) <> 'no'
    """,
)
def keyword_table(spark, folder):
    """A survey made from the orders: an answer list per category, some blank, one label with a comma."""
    o = Tables(spark, folder).orders
    status, priority, first = F.col("o_orderstatus"), F.col("o_orderpriority"), F.left("o_orderpriority", F.lit(1))
    survey = o.select(
        F.concat(F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 7 == 0, ".5").otherwise("")).alias("study_id"),
        F.when(status == "P", "No").otherwise("Yes").alias("inclusion"),
        F.replace(priority, F.lit("-"), F.lit(",")).alias("interventions"),
        F.concat(status, F.lit(",,"), priority).alias("outcomes"),
        F.when(status == "F", "").otherwise(F.concat(F.lit(",Water,"), priority)).alias("environmental_impacts"),
        F.when(first == "1", "Observational, primary data,Modelling").when(first == "2", "Experimental, primary data").otherwise("Other").alias("type_of_study"),
        F.when(first != "3", "Crop,,Mixed").otherwise("").alias("crop_livestock"),
        F.when(F.col("o_orderkey") % 2 == 1, "Gender").otherwise("No").alias("gender"),
        F.concat(F.lit(" C"), first, F.lit(", Y"), F.year("o_orderdate").cast("string")).alias("country"),
    )
    return review.keyword_long(survey)


@query(
    "review_countries",
    f"""
    with {_LONG}, named as (select {_TITLE.format('trim(subcategory)')} as country_name from long where category = 'country')
    select country_name, count(*) as n, max('C' || n_nationkey) as country_code
    from named left join nation on {_TITLE.format('n_name')} = country_name group by 1
    """,
)
def review_countries(spark, folder):
    t = Tables(spark, folder)
    classes = t.nation.select(
        F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("country_code"), title_words("n_name").alias("country_name")
    )
    return review.country_counts(_long(t), classes)


@query(
    "review_matrix",
    f"""
    with {_LONG}, clean as (select distinct study_id, category, case when regexp_matches(subcategory, 'yield|productivity') then 'yield' else subcategory end as v
                            from long where subcategory not in ('other', 'labor')),
    cells as (select o.v as o, i.v as i, s.v as s, count(*) as value from clean o join clean i on o.study_id = i.study_id join clean s on s.study_id = o.study_id
              where o.category = 'outcomes' and i.category = 'interventions' and s.category = 'type of study' group by all),
    named as (select {_TITLE.format('o')} as outcome, case i when 'conservation' then 'Natural Resource' || chr(10) || 'Protection' else {_TITLE.format('i')} end as intervention,
              trim(regexp_replace({_TITLE.format('s')}, 'Primary|Secondary|Data|With', '', 'g')) as studytype, value from cells),
    so as (select studytype, row_number() over (order by sum(value) desc, studytype) as studytype_ord from named group by 1),
    io as (select intervention, row_number() over (order by sum(value) desc, intervention) as intervention_ord from named group by 1)
    select outcome, intervention, studytype, value, cast(studytype_ord as bigint) as studytype_ord, cast(intervention_ord as bigint) as intervention_ord,
           cast(case outcome when 'Income/Expenditure' then 1 when 'Yield' then 2 end as bigint) as outcome_ord
    from named join so using (studytype) join io using (intervention)
    """,
)
def review_matrix(spark, folder):
    out = review.outcome_matrix(_long(Tables(spark, folder)))
    return _integers(out, "studytype_ord", "intervention_ord", "outcome_ord")


@query(
    "review_systems",
    f"""
    with {_LONG}, {_per_year('crop_livestock', 'system', _TITLE.format('subcategory'))}, {_dense('system', "system in ('Crop', 'Mixed', 'Livestock')")}
    select *, cast(case system when 'Crop' then 1 when 'Mixed' then 2 else 3 end as bigint) as system_ord from dense
    """,
)
def review_systems(spark, folder):
    t = Tables(spark, folder)
    return _integers(review.system_series(_long(t), _meta(t)), "system_ord").select("system", "year", "n", "cumulative", "system_ord")


@query(
    "review_themes",
    f"""
    with {_LONG}, themed as (select distinct study_id, category from long where category in ('gender', 'environmental impacts')),
    joined as (select c_custkey as study_id, {_TITLE.format("coalesce(category, 'no cross-cutting theme')")} as theme from customer left join themed on study_id = c_custkey),
    counts as (select year, theme, count(*) as n from joined j left join meta m on j.study_id = m.study_id group by all), {_dense('theme')}
    select *, cast(case theme when 'Environmental Impacts' then 1 when 'No Cross-Cutting Theme' then 2 else 3 end as bigint) as theme_ord from dense
    """,
)
def review_themes(spark, folder):
    t = Tables(spark, folder)
    included = t.customer.select(F.col("c_custkey").alias("study_id"))
    return _integers(review.theme_series(_long(t), included, _meta(t)), "theme_ord").select("theme", "year", "n", "cumulative", "theme_ord")


@query(
    "review_impacts",
    f"""
    with {_LONG}, {_per_year('environmental impacts', 'impact', "case subcategory when 'climate change' then 'GHG Emissions' else " + _TITLE.format('subcategory') + " end", "impact <> 'Environmental'")},
    {_dense('impact', "impact <> 'Other'")}, tots as (select impact, max(cumulative) as tot, row_number() over (order by max(cumulative) desc, impact) as impact_ord from dense group by 1)
    select impact, year, n, cumulative, tot, cast(impact_ord as bigint) as impact_ord,
           cast(sum(cumulative) over (partition by year order by impact_ord desc) as bigint) as position from dense join tots using (impact)
    """,
)
def review_impacts(spark, folder):
    t = Tables(spark, folder)
    return _integers(review.impact_series(_long(t), _meta(t)), "impact_ord").select(
        "impact", "year", "n", "cumulative", "tot", "impact_ord", "position"
    )


@query(
    "review_interventions",
    f"""
    with {_LONG}, {_per_year('interventions', 'intervention', "case subcategory when 'conservation' then 'Natural-Resource Protection' else " + _TITLE.format('subcategory') + " end")},
    {_dense('intervention')}, ords as (select intervention, row_number() over (order by max(n) desc, intervention) as ord from dense group by 1)
    select intervention, year, n, cumulative, 100e0 * cumulative / nullif(sum(cumulative) over (partition by year), 0) as pc, cast(ord as bigint) as intervention_ord
    from dense join ords using (intervention)
    """,
)
def review_interventions(spark, folder):
    t = Tables(spark, folder)
    return _integers(review.intervention_shares(_long(t), _meta(t)), "intervention_ord").select(
        "intervention", "year", "n", "cumulative", "pc", "intervention_ord"
    )


@query(
    "review_outcomes",
    f"""
    with {_LONG}
    select year, outcome, count(distinct study_id) as n from (
      select l.study_id, year, case when regexp_matches(subcategory, 'yield|productivity') then 'Yield' else {_TITLE.format('subcategory')} end as outcome
      from long l left join meta m on l.study_id = m.study_id where category = 'outcomes') where outcome <> 'Other' group by all
    """,
)
def review_outcomes(spark, folder):
    t = Tables(spark, folder)
    return review.outcome_counts(_long(t), _meta(t))


_FARMS = f"""
    farms as (select case l_linestatus when 'F' then 'Water Scarce' else 'Not Water Scarce' end as water_scarce, 'C' || s_nationkey as iso3_usable,
      case l_returnflag when 'A' then 'Small-scale' when 'R' then 'Not small-scale' end as size,
      coalesce(sum(case when l_discount > 0.05 then l_quantity end), 0) as t_irr_fs, sum(l_quantity) as tot_fs, sum(l_linenumber)::double as tot_ag
      from lineitem join supplier on l_suppkey = s_suppkey group by all),
    placed as (select f.*, n_name as country, {_case('r_name', _REGIONS)} as group_name, 100e0 * (t_irr_fs / nullif(case when tot_fs < 900 then 0 else tot_fs end, 0)) as p_irr_fs
      from farms f join nation on iso3_usable = 'C' || n_nationkey join region on n_regionkey = r_regionkey),
    regional as (select * replace (case when group_name = 'World' then null else group_name end as group_name) from placed),
    complete as (select * from regional where p_irr_fs is not null and size is not null and group_name is not null)
"""


def _farms(t: Tables) -> DataFrame:
    lines = relational.merge(
        t.lineitem.select("l_suppkey", "l_linestatus", "l_returnflag", "l_quantity", "l_linenumber", "l_discount"),
        t.supplier.select("s_suppkey", "s_nationkey"), left_on="l_suppkey", right_on="s_suppkey", how="inner", null_keys="drop",
    )
    sums = lines.groupBy("l_linestatus", "l_returnflag", "s_nationkey").agg(
        nulls.sum_skip(F.when(F.col("l_discount") > 0.05, F.col("l_quantity"))).alias("t_irr_fs"),
        F.sum("l_quantity").alias("tot_fs"), F.sum("l_linenumber").cast("double").alias("tot_ag"),
    )
    named = relational.merge(sums, t.nation.select("n_nationkey", "n_name"), left_on="s_nationkey", right_on="n_nationkey", how="inner", null_keys="drop")
    return named.select(
        nulls.recode("l_linestatus", {"F": "Water Scarce"}, "Not Water Scarce", keep=False).alias("water_scarce"),
        F.concat(F.lit("C"), F.col("s_nationkey").cast("string")).alias("iso3_usable"),
        F.col("n_name").alias("country"),
        nulls.recode("l_returnflag", {"A": "Small-scale", "R": "Not small-scale"}, None, keep=False).alias("size"),
        "t_irr_fs", "tot_fs", "tot_ag",
        nulls.pct("t_irr_fs", F.when(F.col("tot_fs") < 900, F.lit(0.0)).otherwise(F.col("tot_fs"))).alias("p_irr_fs"),
    )


def _by_region(t: Tables) -> DataFrame:
    regions = relational.merge(t.nation, t.region, left_on="n_regionkey", right_on="r_regionkey", how="inner", null_keys="drop")
    classes = regions.select(
        F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("country_code"), F.col("n_name").alias("country_name"),
        nulls.recode("r_name", _REGIONS, None, keep=False).alias("group_name"),
    )
    return review.farms_by_region(_farms(t), classes)


@query(
    "review_regions",
    f"""
    with {_FARMS}, shares as (select case when grouping(group_name) = 1 then 'All LMIC Countries' else group_name end as group_name, water_scarce, size, grouping(group_name) as tot,
             100e0 * (sum(t_irr_fs) / nullif(sum(tot_fs), 0)) as p_irr_fs from complete group by grouping sets ((group_name, water_scarce, size), (water_scarce, size))),
    ranked as (select *, row_number() over (order by tot desc, water_scarce desc, size desc, p_irr_fs, group_name) as place from shares),
    firsts as (select group_name, dense_rank() over (order by min(place)) as group_ord from ranked group by 1)
    select group_name, water_scarce, size, p_irr_fs, cast(place as bigint) as place, cast(group_ord as bigint) as group_ord from ranked join firsts using (group_name)
    """,
)
def review_regions(spark, folder):
    return _integers(review.region_shares(_by_region(Tables(spark, folder))), "place", "group_ord")


@query("review_sizes", f"with {_FARMS} select size, 100e0 * (sum(t_irr_fs) / nullif(sum(tot_fs), 0)) as p_irr_fs from complete group by 1")
def review_sizes(spark, folder):
    return review.size_shares(_by_region(Tables(spark, folder)))


@query(
    "review_country_shares",
    f"with {_FARMS} select country, water_scarce, size || ' farms' as size, group_name, p_irr_fs from complete",
)
def review_country_shares(spark, folder):
    return review.country_shares(_by_region(Tables(spark, folder))).select("country", "water_scarce", "size", "group_name", "p_irr_fs")


@query(
    "review_scarce_shares",
    f"""
    with {_FARMS}, parts as (select size, water_scarce, sum(tot_fs) as f, sum(tot_ag) as a from regional group by all)
    select * from (select size, water_scarce, 100e0 * (f / nullif(sum(f) over (partition by size), 0)) as p_f, 100e0 * (a / nullif(sum(a) over (partition by size), 0)) as p_a from parts)
    where size is not null
    """,
)
def review_scarce_shares(spark, folder):
    return review.scarce_shares(_by_region(Tables(spark, folder)))


@query(
    "review_needs",
    f"""
    with {_FARMS}, scarce as (select p.country, 'Small-Scale Farms' as size, 'Water Scarce Regions' as water_scarce, {_TITLE.format('group_name')} as income_group, tot_fs, coalesce(n, 0) as n
      from placed p left join (select 'C' || c_nationkey as code, count(*) as n from customer group by 1) on code = iso3_usable
      where p.water_scarce = 'Water Scarce' and p.size = 'Small-scale'),
    best as (select * from (select *, rank() over (partition by income_group order by tot_fs desc) as r from scarce) where r <= 15),
    ranked as (select *, row_number() over (order by income_group, tot_fs desc, country) as place, count(*) over () as total from best)
    select country, size, water_scarce, income_group, tot_fs / 1000000 as tot_fs, n, cast(total - place + 1 as bigint) as ix, round(ln(tot_fs / 1000000 + 1), 9) as log_fs
    from ranked where place <= 35
    """,
)
def review_needs(spark, folder):
    t = Tables(spark, folder)
    farms = _by_region(t).select("water_scarce", "iso3_usable", "country", F.col("group_name").alias("income_group"), "size", "tot_fs")
    # the region list holds no "World", so these rows keep it as their group here
    farms = farms.withColumn("income_group", nulls.fill("income_group", "World"))
    counted = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    counts = counted.select(
        F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("country_code"), F.col("c_nationkey").alias("country_name"), "n"
    )
    out = review.funding_needs(farms, counts, n=15, shown=35).withColumn("log_fs", F.round("log_fs", 9))
    return _integers(out, "ix").select("country", "size", "water_scarce", "income_group", "tot_fs", "n", "ix", "log_fs")
