"""Pooled percentages, totals, shares and per-group quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.catalog.base import Tables, query
from furrow.functions import nulls
from furrow.operators import aggregates, quantile, relational


def _lines_with_nation(t: Tables, *cols: str):
    nations = relational.merge(
        t.supplier.select("s_suppkey", "s_nationkey"),
        t.nation.select("n_nationkey", "n_name"),
        left_on="s_nationkey",
        right_on="n_nationkey",
        null_keys="drop",
    )
    lines = t.lineitem.select("l_suppkey", *cols)
    return relational.merge(lines, nations, left_on="l_suppkey", right_on="s_suppkey", how="inner", null_keys="drop")


@query(
    "pooled_pct_with_total",
    """
    with base as (select nullif(n_name, 'NATION_3') as region, l_linestatus as scarce, l_returnflag as size, l_quantity,
                         case when l_discount >= 0.05 then l_quantity end as irrigated
                  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
                  where l_tax <> 0 and l_quantity is not null)
    select case when grouping(region) = 1 then 'All' else region end as region, scarce, size,
           sum(l_quantity) as tot, coalesce(sum(irrigated), 0) as tot_irr,
           100.0 * (coalesce(sum(irrigated), 0) / nullif(sum(l_quantity), 0)) as p
    from base group by grouping sets ((region, scarce, size), (scarce, size))
    """,
)
def pooled_pct_with_total(spark, folder):
    t = Tables(spark, folder)
    lines = _lines_with_nation(t, "l_linestatus", "l_returnflag", "l_quantity", "l_discount", "l_tax")
    share = nulls.ratio("l_discount", "l_tax", mode="ieee")
    base = nulls.complete_cases(lines.filter(nulls.is_finite(share)), ["l_quantity"]).select(
        F.nullif("n_name", F.lit("NATION_3")).alias("region"),
        F.col("l_linestatus").alias("scarce"),
        F.col("l_returnflag").alias("size"),
        "l_quantity",
        F.when(F.col("l_discount") >= 0.05, F.col("l_quantity")).alias("irrigated"),
    )
    both = aggregates.with_total(base, "region", ["scarce", "size"], {"tot": "l_quantity", "tot_irr": "irrigated"}, "All")
    return both.withColumn("p", nulls.pct("tot_irr", "tot")).drop("is_total")


@query(
    "pooled_pct",
    """
    select l_returnflag, l_linestatus, 100.0 * (coalesce(sum(l_quantity) filter (where l_discount > 0.04), 0) / nullif(sum(l_quantity), 0)) as p
    from lineitem group by all
    """,
)
def pooled_pct(spark, folder):
    li = Tables(spark, folder).lineitem.withColumn("part", F.when(F.col("l_discount") > 0.04, F.col("l_quantity")))
    return aggregates.pooled_pct(li, "part", "l_quantity", ["l_returnflag", "l_linestatus"])


@query(
    "share_of_total",
    """
    with base as (select o_orderpriority as size, l_linestatus as scarce, nullif(l_quantity, case when o_orderpriority = '5-LOW'
                         and l_linestatus = 'O' then 50.0 end) as farms, l_linenumber as area
                  from lineitem join orders on l_orderkey = o_orderkey),
    parts as (select size, scarce, case when count(farms) = count(*) then sum(farms) end as f, sum(farms) as fs,
                     sum(area) as a from base group by all)
    select size, scarce, 100.0 * (f / nullif(sum(fs) over (partition by size), 0)) as p_f,
           100.0 * (cast(a as double) / nullif(sum(a) over (partition by size), 0)) as p_a
    from parts
    """,
)
def share_of_total(spark, folder):
    t = Tables(spark, folder)
    lines = t.lineitem.select("l_orderkey", "l_linestatus", "l_quantity", "l_linenumber")
    joined = relational.merge(
        lines, t.orders.select("o_orderkey", "o_orderpriority"), left_on="l_orderkey", right_on="o_orderkey",
        how="inner", null_keys="drop",
    )
    hole = (F.col("o_orderpriority") == "5-LOW") & (F.col("l_linestatus") == "O") & (F.col("l_quantity") == 50)
    base = joined.select(
        F.col("o_orderpriority").alias("size"),
        F.col("l_linestatus").alias("scarce"),
        F.when(~hole, F.col("l_quantity")).alias("farms"),
        F.col("l_linenumber").alias("area"),
    )
    return aggregates.share_of_total(base, ["size"], ["scarce"], {"p_f": "farms", "p_a": "area"})


@query(
    "weighted_quantile",
    """
    with base as (select nullif(n_name, 'NATION_3') as country, cast(p_size as double) as x, l_quantity as w
                  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
                  join part on l_partkey = p_partkey where p_size <> 7 and l_quantity <> 13),
    sums as (select country, x, sum(w) as w from base group by all),
    run as (select *, sum(w) over (partition by country order by x) / sum(w) over (partition by country) as share from sums),
    cut as (select country, min(x) as threshold from run where share >= 0.4 group by 1)
    select b.country, b.x, t.threshold, cast(case when b.x <= t.threshold then 1 else 0 end as bigint) as flag, count(*) as n
    from base b join cut t on b.country is not distinct from t.country group by all
    """,
)
def weighted_quantile(spark, folder):
    t = Tables(spark, folder)
    lines = _lines_with_nation(t, "l_partkey", "l_quantity")
    sizes = t.part.select("p_partkey", "p_size")
    joined = relational.merge(lines, sizes, left_on="l_partkey", right_on="p_partkey", how="inner", null_keys="drop")
    base = joined.select(
        F.nullif("n_name", F.lit("NATION_3")).alias("country"),
        F.nullif("p_size", F.lit(7)).cast("double").alias("x"),
        F.nullif("l_quantity", F.lit(13.0)).alias("w"),
    )
    flagged = quantile.flag_below_quantile(base, "x", "w", 0.4, ["country"], "threshold", "flag")
    kept = nulls.complete_cases(flagged, ["x", "w"])
    return aggregates.count_by(
        kept.withColumn("flag", F.col("flag").cast("bigint")), ["country", "x", "threshold", "flag"]
    )


@query(
    "quantile_per_part_price",
    """
    with sums as (select l_returnflag, l_extendedprice as x, sum(l_quantity) as w from lineitem group by all),
    run as (select *, sum(w) over (partition by l_returnflag order by x) / sum(w) over (partition by l_returnflag) as share from sums)
    select l_returnflag, min(x) as threshold from run where share >= 0.4 group by 1
    """,
)
def quantile_per_part_price(spark, folder):
    li = Tables(spark, folder).lineitem
    return quantile.weighted_quantile(li, "l_extendedprice", "l_quantity", 0.4, ["l_returnflag"])


@query(
    "mode_first",
    """
    with base as (select l_partkey, nullif(l_returnflag, 'N') as value, l_orderkey * 8 + l_linenumber as seen from lineitem),
    counts as (select l_partkey, value, count(*) as n, min(seen) as first from base group by all)
    select l_partkey, value as mode from (
      select *, row_number() over (partition by l_partkey order by n desc, first) as r from counts) where r = 1
    """,
)
def mode_first(spark, folder):
    li = Tables(spark, folder).lineitem.select(
        "l_partkey",
        F.nullif("l_returnflag", F.lit("N")).alias("value"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seen"),
    )
    return quantile.mode_first(li, ["l_partkey"], "value", "seen")


@query(
    "median_strict",
    """
    select user_id, round(case when count(v) = count(*) then median(v) end, 6) as median from (
      select user_id, case when value > 60 and user_id < 40 then null else value end as v from events
      where cast(ts as date) between date '2024-01-05' and date '2024-01-20') group by 1
    """,
)
def median_strict(spark, folder):
    e = Tables(spark, folder).events.withColumn("day", F.to_date("ts"))
    window = relational.between_dates(e, "day", "2024-01-05", "2024-01-20")
    holes = F.when(~((F.col("value") > 60) & (F.col("user_id") < 40)), F.col("value"))
    found = quantile.median_strict(window.withColumn("v", holes), "v", ["user_id"])
    return found.withColumn("median", F.round("median", 6))


@query(
    "fold_mean_std",
    """
    select event_type, round(avg(m), 6) as mean_m, round(avg(n), 6) as mean_n,
           round(stddev_pop(m), 6) as std_m, round(stddev_pop(n), 6) as std_n
    from (select event_type, user_id % 10 as fold, sum(cast(value * 100 as bigint)) / 1000.0 as m, count(*) as n from events group by all)
    group by 1
    """,
)
def fold_mean_std(spark, folder):
    e = Tables(spark, folder).events
    folds = e.groupBy("event_type", (F.col("user_id") % 10).alias("fold")).agg(
        (F.sum(F.round(F.col("value") * 100, 0).cast("bigint")) / 1000.0).alias("m"), F.count(F.lit(1)).alias("n")
    )
    out = aggregates.fold_summary(folds, ["m", "n"], ["event_type"])
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in out.columns[1:]])
