"""Filters, projections, text functions, joins and unions over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from furrow.catalog.base import Tables, query
from furrow.functions import nulls, text
from furrow.operators import aggregates, ordering, relational, reshape


@query(
    "filter_predicates",
    """
    select c_custkey, c_mktsegment, c_acctbal,
           case when c_acctbal <= 0 then 'debt' when c_acctbal <= 2500 then 'low'
                when c_acctbal <= 7500 then 'middle' when c_acctbal > 7500 then 'high' end as balance_band,
           cast(case when c_acctbal <= 0 then 1 when c_acctbal <= 2500 then 2
                when c_acctbal <= 7500 then 3 when c_acctbal > 7500 then 4 end as bigint) as balance_ord,
           case when flagged then 'scarce' when not flagged then 'not scarce' end as flag,
           c_acctbal / nullif(abs(round(c_acctbal / 1000, 0)), 0.0) as per_thousand,
           'customer' as origin
    from (select *, (nullif(c_nationkey, 3) >= 20) or (nullif(c_nationkey, 4) <= 5) as flagged from customer)
    where c_mktsegment <> 'MACHINERY'
      and regexp_matches(c_mktsegment, 'o|D', 'i')
      and not coalesce(nullif(c_nationkey, 7) in (1, 2), false)
    """,
)
def filter_predicates(spark, folder):
    c = Tables(spark, folder).customer
    kept = c.filter(
        (F.col("c_mktsegment") != "MACHINERY")
        & text.matches_ci("c_mktsegment", "o|D")
        & ~nulls.is_member(F.nullif("c_nationkey", F.lit(7)), [1, 2])
    )
    label, order = nulls.band("c_acctbal", [0, 2500, 7500], ["debt", "low", "middle", "high"])
    flagged = (F.nullif("c_nationkey", F.lit(3)) >= 20) | (F.nullif("c_nationkey", F.lit(4)) <= 5)
    rounded = F.abs(F.round(F.col("c_acctbal") / 1000, 0))
    return relational.tag(
        kept.select(
            "c_custkey",
            "c_mktsegment",
            "c_acctbal",
            label.alias("balance_band"),
            order.cast("bigint").alias("balance_ord"),
            nulls.if3(flagged, F.lit("scarce"), F.lit("not scarce")).alias("flag"),
            nulls.ratio("c_acctbal", nulls.null_if_zero(rounded)).alias("per_thousand"),
        ),
        origin="customer",
    )


@query(
    "select_rename_cast",
    """
    select o_totalprice as price, cast(length(o_orderpriority) as bigint) as priority_length,
           coalesce(nullif(o_totalprice, 100.0), 0) + coalesce(case when o_orderstatus = 'F' then 5.0 end, 0) as summed,
           100.0 * (o_totalprice / nullif(o_custkey, 0)) as price_pct,
           strftime(o_orderdate, '%Y-%m-%d') as day
    from orders
    """,
)
def select_rename_cast(spark, folder):
    o = Tables(spark, folder).orders
    cut = relational.drop_matching(relational.select_from(o, 2), "STATUS_CODE|comment")
    named = relational.rename(cut, {"o_totalprice": "price", "o_orderpriority": "priority"})
    return named.select(
        "price",
        F.length("priority").cast("bigint").alias("priority_length"),
        nulls.row_sum("price", F.when(F.col("o_orderstatus") == "F", F.lit(5.0))).alias("summed"),
        nulls.pct("price", "o_custkey").alias("price_pct"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
    )


@query(
    "title_words",
    r"""
    select o_orderkey,
           list_aggregate(list_transform(regexp_extract_all(lower(o_orderpriority), '([\p{L}\p{N}'']+|[^\p{L}\p{N}'']+)'),
             lambda t: upper(t[1]) || t[2:]), 'string_agg', '') as title,
           trim(regexp_replace(o_orderpriority, 'NOT|SPECIFIED|[0-9]-', '', 'g')) as bare,
           list_aggregate(list_transform(regexp_extract_all(lower(c_name || '/' || c_mktsegment), '([\p{L}\p{N}'']+|[^\p{L}\p{N}'']+)'),
             lambda t: upper(t[1]) || t[2:]), 'string_agg', '') as owner
    from orders join customer on o_custkey = c_custkey
    """,
)
def title_words(spark, folder):
    t = Tables(spark, folder)
    owners = t.customer.select("c_custkey", F.concat_ws("/", "c_name", "c_mktsegment").alias("owner"))
    joined = relational.merge(t.orders, owners, left_on="o_custkey", right_on="c_custkey", how="inner", null_keys="drop")
    return joined.select(
        "o_orderkey",
        text.title_words("o_orderpriority").alias("title"),
        text.trim_all(text.remove_all("o_orderpriority", "NOT|SPECIFIED|[0-9]-")).alias("bare"),
        text.title_words("owner").alias("owner"),
    )


@query(
    "replace_first_wrap",
    r"""
    select p_partkey, regexp_replace(p_name, '[aeiou]', '*') as first_vowel,
           replace(p_name, 'ring', '') as without_ring,
           p_brand || ' ' || coalesce(nullif(p_type, 'PROMO'), 'NA') as pasted,
           p_brand || ' ' || nullif(p_type, 'PROMO') as pasted_null,
           case when length(p_name) <= 9 then p_name else replace(p_name, ' ', chr(10)) end as wrapped,
           split_part(p_brand, '#', 1) as head
    from part
    """,
)
def replace_first_wrap(spark, folder):
    p = Tables(spark, folder).part
    kind = F.nullif("p_type", F.lit("PROMO"))
    return p.select(
        "p_partkey",
        text.replace_first("p_name", "[aeiou]", "*").alias("first_vowel"),
        text.strip_literal("p_name", "ring").alias("without_ring"),
        text.paste("p_brand", kind).alias("pasted"),
        text.paste("p_brand", kind, na="null").alias("pasted_null"),
        text.wrap("p_name", 9).alias("wrapped"),
        text.before("p_brand", "#").alias("head"),
    )


@query(
    "to_int_bad_text",
    """
    select c_custkey, cast(split_part(c_name, '#', 2) as bigint) as tail, cast(null as bigint) as bad,
           cast(trunc(c_acctbal) as bigint) as whole, cast(c_nationkey as bigint) as nation
    from customer
    """,
)
def to_int_bad_text(spark, folder):
    c = Tables(spark, folder).customer
    return c.select(
        "c_custkey",
        text.to_int(F.substring_index("c_name", "#", -1)).cast("bigint").alias("tail"),
        text.to_int("c_name").cast("bigint").alias("bad"),
        text.to_int("c_acctbal").cast("bigint").alias("whole"),
        text.to_int(F.concat(F.col("c_nationkey").cast("string"), F.lit(".9"))).cast("bigint").alias("nation"),
    )


@query(
    "count_lookup_recode",
    """
    select c.nation, c.n, case when c.nation = 1 then 'ONE' when c.nation = 2 then 'TWO' else n.n_name end as code,
           d.n_name as strict_name
    from (select nullif(c_nationkey, 3) as nation, count(*) as n from customer group by 1) c
    left join (select nullif(n_nationkey, 3) as k, n_name from nation) n on c.nation is not distinct from n.k
    left join (select nullif(n_nationkey, 3) as k, n_name from nation) d on c.nation = d.k
    """,
)
def count_lookup_recode(spark, folder):
    t = Tables(spark, folder)
    counts = aggregates.count_by(t.customer.select(F.nullif("c_nationkey", F.lit(3)).alias("nation")), ["nation"])
    names = t.nation.select(F.nullif("n_nationkey", F.lit(3)).alias("k"), "n_name")
    both = relational.merge(counts, names, left_on="nation", right_on="k")
    strict = names.select("k", F.col("n_name").alias("strict_name"))
    both = relational.merge(both, strict, left_on="nation", right_on="k", null_keys="drop")
    code = nulls.override("n_name", "nation", {1: "ONE", 2: "TWO"})
    return both.select("nation", "n", code.alias("code"), "strict_name")


@query(
    "lookup_first",
    """
    select s_suppkey, s_nationkey, f.c_name, f.c_mktsegment
    from supplier left join (
      select c_nationkey, c_name, c_mktsegment from (
        select * replace (case when c_mktsegment <> 'BUILDING' then c_nationkey end as c_nationkey), row_number() over (partition by case when c_mktsegment <> 'BUILDING' then c_nationkey end order by c_custkey) as r from customer)
      where r = 1) f on s_nationkey = f.c_nationkey
    """,
)
def lookup_first(spark, folder):
    t = Tables(spark, folder)
    lookup = t.customer.withColumn("c_nationkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey")))
    found = relational.lookup_first(
        t.supplier, lookup, "s_nationkey", "c_nationkey", "c_custkey", ["c_name", "c_mktsegment"]
    )
    return found.select("s_suppkey", "s_nationkey", "c_name", "c_mktsegment")


@query(
    "inner_three_keys",
    """
    select a.l_partkey, a.l_suppkey, a.l_linenumber, a.heads, b.product, round(b.product / nullif(a.heads, 0.0), 4) as per_head
    from (select l_partkey, l_suppkey, l_linenumber, sum(case when l_returnflag <> 'A' then l_quantity else 0.0 end) as heads
          from lineitem group by all) a
    join (select l_partkey, l_suppkey, l_linenumber, sum(case when l_linestatus = 'F' then round(l_extendedprice, 0) end) as product
          from lineitem group by all) b using (l_partkey, l_suppkey, l_linenumber)
    """,
)
def inner_three_keys(spark, folder):
    li = Tables(spark, folder).lineitem
    keys = ["l_partkey", "l_suppkey", "l_linenumber"]
    heads = li.groupBy(*keys).agg(
        F.sum(F.when(F.col("l_returnflag") != "A", F.col("l_quantity")).otherwise(0.0)).alias("heads")
    )
    sold = F.when(F.col("l_linestatus") == "F", F.round("l_extendedprice", 0))
    product = li.groupBy(*keys).agg(F.sum(sold).alias("product"))
    both = relational.merge(heads, product, on=keys, how="inner", null_keys="drop")
    return both.withColumn("per_head", F.round(nulls.ratio("product", "heads"), 4))


@query(
    "join_year_and_sort",
    """
    select l_orderkey, l_partkey, l_linenumber, year,
           cast(row_number() over (partition by year order by coalesce(p, 0) desc, l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice) as bigint) as place
    from (select l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, nullif(l_discount, 0.05) as p,
                 cast(year(o_orderdate) as bigint) as year
          from lineitem left join orders on l_orderkey = o_orderkey)
    """,
)
def join_year_and_sort(spark, folder):
    t = Tables(spark, folder)
    years = t.orders.select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("year"))
    joined = relational.merge(t.lineitem, years, left_on="l_orderkey", right_on="o_orderkey", null_keys="drop")
    keys = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    # -0.0 occurs in the data; adding 0.0 leaves one zero to sort by
    shown = joined.withColumn("p", nulls.fill(F.nullif("l_discount", F.lit(0.05)), 0.0) + F.lit(0.0))
    placed = ordering.place(shown.select("year", "p", *keys), [F.col("p").desc_nulls_last(), *keys], "place", by=["year"])
    out = placed.select("l_orderkey", "l_partkey", "l_linenumber", "year", (F.col("place") + 1).alias("place"))
    return out.orderBy(F.col("year").asc_nulls_last(), "place")


@query(
    "union_tagged",
    """
    select 'customer' as origin, c_nationkey as nation, c_acctbal as balance from customer
    union all select 'supplier', s_nationkey, s_acctbal from supplier
    """,
)
def union_tagged(spark, folder):
    t = Tables(spark, folder)
    return relational.union_tagged(
        {
            "customer": t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")),
            "supplier": t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")),
        },
        "origin",
    )


@query(
    "multivalue_long",
    """
    select 'part' as origin, p_partkey as id, regexp_extract(category, '^[a-zA-Z ]*') as category, lower(value) as value
    from (select p_partkey, 'name_1' as category, unnest(string_split(p_name, ' ')) as value from part
          union all select p_partkey, 'type_1', unnest(string_split(coalesce(nullif(p_type, 'PROMO'), 'No'), ' ')) from part)
    where value <> '' and lower(value) <> 'no'
    union all
    select 'orders', o_orderkey, 'priority', lower(value) from (
      select o_orderkey, unnest(string_split(replace(o_orderpriority, '5-LOW', '5 LOW'), '-')) as value from orders) where value <> ''
    """,
)
def multivalue_long(spark, folder):
    t = Tables(spark, folder)
    parts = t.part.withColumn("p_type", nulls.recode("p_type", {"PROMO": ""}))
    words = reshape.explode_multivalue(
        parts, ["p_partkey"], {"name_1": "p_name", "type_1": "p_type"}, " ", empty={"type_1": "No"}
    )
    words = words.select(
        F.col("p_partkey").alias("id"), text.leading_words("category").alias("category"), F.lower("value").alias("value")
    ).filter(F.col("value") != "no")
    priorities = reshape.explode_multivalue(
        t.orders, ["o_orderkey"], {"priority": "o_orderpriority"}, "-", protect={"priority": {"5-LOW": "5 LOW"}}
    ).select(F.col("o_orderkey").alias("id"), "category", F.lower("value").alias("value"))
    return relational.union_tagged({"part": words, "orders": priorities}, "origin")


def _outcome_frames(t: Tables):
    """Study = order; outcome = its priority, intervention = part types returned, type = line status."""
    outcomes = t.orders.select(
        F.col("o_orderkey").alias("study_id"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("outcome")
    )
    lines = t.lineitem.select(F.col("l_orderkey").alias("study_id"), "l_partkey", "l_linestatus")
    types = t.part.select("p_partkey", F.col("p_type").alias("intervention"))
    interventions = relational.merge(lines, types, left_on="l_partkey", right_on="p_partkey", how="inner", null_keys="drop")
    return outcomes, interventions.select("study_id", "intervention"), lines.select("study_id", F.col("l_linestatus").alias("studytype"))


_THREE_WAY = """
    o as (select distinct o_orderkey as study_id, nullif(o_orderpriority, '5-LOW') as outcome from orders),
    i as (select distinct l_orderkey as study_id, p_type as intervention from lineitem join part on l_partkey = p_partkey),
    s as (select distinct l_orderkey as study_id, l_linestatus as studytype from lineitem),
    oi as (select coalesce(o.study_id, i.study_id) as study_id, outcome, intervention from o full join i on o.study_id = i.study_id),
    ois as (select distinct coalesce(oi.study_id, s.study_id) as study_id, outcome, intervention, studytype
            from oi full join s on oi.study_id = s.study_id)
"""


def three_way(t: Tables):
    return relational.full_distinct(list(_outcome_frames(t)), on="study_id", null_keys="drop")


@query("full_outer_three_way", f"with {_THREE_WAY} select * from ois")
def full_outer_three_way(spark, folder):
    return three_way(Tables(spark, folder))


@query(
    "crosstab_counts",
    f"""
    with {_THREE_WAY},
    rows_ as (select distinct outcome, studytype from ois where outcome is not null and studytype is not null),
    cols_ as (select distinct intervention from ois where intervention is not null),
    cells as (select outcome, studytype, intervention, count(*) as n from ois group by all),
    full_ as (select r.outcome, r.studytype, c.intervention, coalesce(n, 0) as n from rows_ r cross join cols_ c
              left join cells x on x.outcome = r.outcome and x.studytype = r.studytype and x.intervention = c.intervention)
    select outcome, studytype, intervention, cast(n as bigint) as n,
           cast(sum(n) over (partition by intervention) as bigint) as intervention_total,
           cast(sum(n) over (partition by outcome, intervention) as bigint) as pair_total
    from full_
    """,
)
def crosstab_counts(spark, folder):
    frame = three_way(Tables(spark, folder))
    keyed = frame.filter(F.col("outcome").isNotNull() & F.col("studytype").isNotNull())
    cells = aggregates.crosstab_long(keyed, ["outcome", "studytype"], "intervention")
    totals = relational.group_total(cells, "n", ["intervention"], "intervention_total")
    return relational.group_stat(totals, ["outcome", "intervention"], pair_total=nulls.sum_strict("n"))


@query(
    "unpivot_pivot",
    """
    select l_partkey, flag, n, cast(quantity as double) as quantity from (
      select l_partkey, flag, count(l_quantity) filter (where l_returnflag = flag) as n,
             coalesce(sum(l_quantity) filter (where l_returnflag = flag), 0) as quantity
      from lineitem, (values ('A'), ('N'), ('R')) f(flag) group by all)
    """,
)
def unpivot_pivot(spark, folder):
    li = Tables(spark, folder).lineitem
    flags = ["A", "N", "R"]
    wide = aggregates.crosstab(li, ["l_partkey"], "l_returnflag", flags)
    counts = reshape.unpivot(wide, ["l_partkey"], flags, "flag", "n")
    amounts = li.groupBy("l_partkey", F.col("l_returnflag").alias("flag")).agg(F.sum("l_quantity").alias("quantity"))
    joined = relational.merge(counts, amounts, on=["l_partkey", "flag"], null_keys="drop")
    return joined.withColumn("quantity", nulls.fill("quantity", 0.0))


@query(
    "top_n_ties",
    """
    select c_mktsegment, c_custkey, place, country, millions, log_millions, n, cast(ix as bigint) as ix from (
      select *, count(*) over () - row_number() over (order by c_mktsegment, balance desc, c_custkey) + 1 as ix from (
        select c_mktsegment, c_custkey, cast(place as bigint) as place, balance,
               case when n_name = 'NATION_1' then 'First' when n_name = 'NATION_2' then 'Second' else n_name end as country,
               balance / 1000000.0 as millions, round(ln(balance / 1000.0 + 1), 6) as log_millions, coalesce(n, 0) as n
        from (select *, rank() over (partition by c_mktsegment order by balance desc) as place
              from (select *, nullif(round(c_acctbal / 10.0, 0) * 10.0, 0.0) as balance from customer) where balance > 0) c
        left join nation on c_nationkey = n_nationkey
        left join (select o_custkey, count(*) as n from orders group by 1) o on o_custkey = c_custkey
        where place <= 15))
    order by c_mktsegment, ix desc limit 35
    """,
)
def top_n_ties(spark, folder):
    t = Tables(spark, folder)
    balance = nulls.null_if_zero(F.round(F.col("c_acctbal") / 10.0, 0) * 10.0)
    best = reshape.top_n(
        t.customer.withColumn("balance", balance).filter(F.col("balance") > 0), ["c_mktsegment"], "balance", 15, "place"
    )
    names = t.nation.select("n_nationkey", "n_name")
    best = relational.merge(best, names, left_on="c_nationkey", right_on="n_nationkey", null_keys="drop")
    studies = aggregates.count_by(t.orders, ["o_custkey"])
    best = relational.merge(best, studies, left_on="c_custkey", right_on="o_custkey", null_keys="drop")
    shown = best.select(
        "c_mktsegment",
        "c_custkey",
        F.col("place").cast("bigint").alias("place"),
        nulls.recode("n_name", {"NATION_1": "First", "NATION_2": "Second"}).alias("country"),
        (F.col("balance") / 1000000.0).alias("millions"),
        F.round(F.log1p(F.col("balance") / 1000.0), 6).alias("log_millions"),
        nulls.fill("n", 0).alias("n"),
        "balance",
    )
    order = [F.col("c_mktsegment").asc_nulls_last(), F.col("balance").desc_nulls_last(), F.col("c_custkey")]
    return ordering.reverse_index(shown, order, 35).drop("balance")
