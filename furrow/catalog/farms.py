"""Farm cells built from the trade tables: a cell is a part in a country, its area the quantity sold."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.catalog.base import Tables, query
from furrow.functions import nulls
from furrow.lineage import cut
from furrow.operators import farms, grid, quantile, relational

_CELLS = """
    cells as (
      select l_partkey * 25 + s_nationkey as cell_id, max(n_name) as country, nullif(max(n_name), 'NATION_5') as iso3,
        case max(n_regionkey) when 0 then 'Low income' when 1 then 'Lower middle income' when 2 then 'Upper middle income'
             when 3 then 'High income' end as income_group,
        cast(nullif(max(p_size), 7) as double) as fs,
        cast(nullif(count(*) filter (where l_discount > 0.08), 2) as double) as months,
        nullif(max(l_tax) * 300e0, 0e0) as rain, max(l_extendedprice) as gdp_pc,
        sum(l_quantity) filter (where l_returnflag = 'A' and l_linestatus = 'F') as irri_area,
        sum(l_quantity) filter (where l_returnflag = 'R') as paddy_area,
        sum(l_quantity) filter (where l_returnflag = 'N' and l_linestatus = 'O') as rainfed_area
      from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
      group by l_partkey, s_nationkey)
"""

_SCARCE = """case when months >= 1 or rain <= 20.8333 then 'Water Scarce' when not (months >= 1 or rain <= 20.8333) then 'Not Water Scarce' end"""


def _measures(allocation: str, cells: str = "cells") -> str:
    """SQL of areas and farm counts for one allocation."""
    irri = "coalesce(irri_area, 0) + coalesce(paddy_area, 0)" if allocation == "irrigation" else "irri_area"
    rain = "coalesce(rainfed_area, 0) + coalesce(paddy_area, 0)" if allocation == "rainfed" else "rainfed_area"
    return f"""
      select *, case when tot_area is not null then coalesce(irri_farms, 0) + coalesce(rainfed_farms, 0) end as tot_farms from (
        select *, irri_area / nullif(fs, 0) as irri_farms, rainfed_area / nullif(fs, 0) as rainfed_farms,
               nullif(coalesce(irri_area, 0) + coalesce(rainfed_area, 0), 0) as tot_area
        from (select '{allocation}' as allocation, cell_id, country, iso3, income_group, fs, gdp_pc, {_SCARCE} as water_scarce,
                     {irri} as irri_area, {rain} as rainfed_area from {cells}))
    """


_CLASSES = """
    usable as (select *, case when count(fs) over (partition by allocation, iso3) > 2 then iso3 end as iso3_usable from measured),
    fs_sums as (select allocation, iso3_usable, fs, sum(tot_farms) as w from usable where fs is not null and tot_farms > 0 group by all),
    fs_cut as (select allocation, iso3_usable, min(fs) as t_fs from (
      select *, sum(w) over (partition by allocation, iso3_usable order by fs) / sum(w) over (partition by allocation, iso3_usable) as share from fs_sums)
      where share >= 0.4 group by all),
    first as (select u.*, t_fs, min(fs) over (partition by u.allocation, u.iso3_usable) as min_fs,
      case when fs <= t_fs then 1 when fs > t_fs then 0 end as b_fs,
      case when fs is not null and t_fs is not null then gdp_pc end as gdp_ag
      from usable u left join fs_cut c on u.iso3_usable is not distinct from c.iso3_usable and u.allocation = c.allocation),
    gdp_sums as (select allocation, iso3_usable, gdp_ag, sum(tot_farms) as w from first where gdp_ag is not null and tot_farms > 0 group by all),
    gdp_cut as (select allocation, iso3_usable, min(gdp_ag) as t_gdp from (
      select *, sum(w) over (partition by allocation, iso3_usable order by gdp_ag) / sum(w) over (partition by allocation, iso3_usable) as share from gdp_sums)
      where share >= 0.4 group by all),
    second as (select f.*, t_gdp, min(gdp_ag) over (partition by f.allocation, f.iso3_usable) as min_gdp,
      case when gdp_ag <= t_gdp then 1 when gdp_ag > t_gdp then 0 end as b_gdp
      from first f left join gdp_cut c on f.iso3_usable is not distinct from c.iso3_usable and f.allocation = c.allocation),
    scored as (select *, case when t_gdp is null or t_fs is null then null else cast(coalesce(b_fs, 0) + coalesce(b_gdp, 0)
        + case when min_fs = t_fs then 1 else 0 end + case when min_gdp = t_gdp then 1 else 0 end as double) end as score from second),
    classed as (select *, case when tot_area is null or fs is null or income_group is null
        or income_group not in ('Low income', 'Lower middle income', 'Upper middle income') then null
        when score >= 2 then 'Small-scale' when score < 2 then 'Not small-scale' end as size from scored)
"""


def cell_frame(t: Tables):
    """Names and sizes are attached after the aggregation, which then is on numbers only."""
    lines = relational.merge(
        t.lineitem.select(
            "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
        ),
        t.supplier.select("s_suppkey", "s_nationkey"),
        left_on="l_suppkey", right_on="s_suppkey", how="inner", null_keys="drop",
    )

    def area(flag: str, status: str | None = None):
        cond = F.col("l_returnflag") == flag
        return F.sum(F.when(cond & (F.col("l_linestatus") == status) if status else cond, F.col("l_quantity")))

    grouped = lines.groupBy("l_partkey", "s_nationkey").agg(
        F.nullif(F.count_if(F.col("l_discount") > 0.08), F.lit(2)).cast("double").alias("months"),
        nulls.null_if_zero(F.max("l_tax") * F.lit(300.0)).alias("rain"),
        F.max("l_extendedprice").alias("gdp_pc"),
        area("A", "F").alias("irri_area"),
        area("R").alias("paddy_area"),
        area("N", "O").alias("rainfed_area"),
    )
    sizes = t.part.select("p_partkey", F.nullif("p_size", F.lit(7)).cast("double").alias("fs"))
    named = relational.merge(grouped, sizes, left_on="l_partkey", right_on="p_partkey", how="inner", null_keys="drop")
    nations = t.nation.select("n_nationkey", F.col("n_name").alias("country"), "n_regionkey")
    named = relational.merge(named, nations, left_on="s_nationkey", right_on="n_nationkey", how="inner", null_keys="drop")
    incomes = {0: "Low income", 1: "Lower middle income", 2: "Upper middle income", 3: "High income"}
    return named.select(
        (F.col("l_partkey") * 25 + F.col("s_nationkey")).alias("cell_id"),
        "country",
        F.nullif("country", F.lit("NATION_5")).alias("iso3"),
        nulls.recode("n_regionkey", incomes, None, keep=False).alias("income_group"),
        *["fs", "months", "rain", "gdp_pc", "irri_area", "paddy_area", "rainfed_area"],
    )


@query(
    "small_scale_class",
    f"""
    with {_CELLS}, measured as ({_measures('irrigation')}), {_CLASSES}
    select cell_id, water_scarce, iso3_usable, t_fs, t_gdp, score, size, round(tot_farms, 6) as tot_farms from classed
    """,
)
def small_scale_class(spark, folder):
    cells = farms.classify_small_scale(cut(farms.prepare_cells(cell_frame(Tables(spark, folder)))))
    return cells.select(
        "cell_id", "water_scarce", "iso3_usable", "t_fs", "t_gdp", F.col("score").cast("double").alias("score"), "size",
        F.round("tot_farms", 6).alias("tot_farms"),
    )


@query(
    "farm_summary",
    f"""
    with {_CELLS}, measured as ({_measures('irrigation')}), {_CLASSES}
    select water_scarce, iso3_usable, country, income_group, size,
           round(coalesce(sum(irri_farms), 0), 4) as t_irr_fs, round(coalesce(sum(irri_area), 0), 4) as t_irr_ag,
           round(100.0 * coalesce(sum(irri_farms), 0) / nullif(coalesce(sum(tot_farms), 0), 0), 4) as p_irr_fs,
           round(100.0 * coalesce(sum(irri_area), 0) / nullif(coalesce(sum(tot_area), 0), 0), 4) as p_irr_ag,
           round(coalesce(sum(tot_farms), 0), 4) as tot_fs, round(coalesce(sum(tot_area), 0), 4) as tot_ag
    from classed group by all
    """,
)
def farm_summary(spark, folder):
    cells = farms.classify_small_scale(cut(farms.prepare_cells(cell_frame(Tables(spark, folder)))))
    out = farms.country_summary(cells)
    return out.select(*out.columns[:5], *[F.round(c, 4).alias(c) for c in out.columns[5:]])


@query(
    "scenario_sensitivity",
    f"""
    with {_CELLS}, measured as ({_measures('none')} union all {_measures('rainfed')} union all {_measures('irrigation')}), {_CLASSES}
    select * from (
      select allocation, water_scarce, size,
           round(100.0 * coalesce(sum(irri_farms), 0) / nullif(coalesce(sum(tot_farms), 0), 0), 4) as p_irr_fs,
           round(100.0 * coalesce(sum(irri_area), 0) / nullif(coalesce(sum(tot_area), 0), 0), 4) as p_irr_ag,
           round(coalesce(sum(tot_farms), 0), 4) as tot_fs, round(coalesce(sum(tot_area), 0), 4) as tot_ag
      from classed group by all)
    where water_scarce is not null and size is not null and p_irr_fs is not null and p_irr_ag is not null
    """,
)
def scenario_sensitivity(spark, folder):
    frame = cell_frame(Tables(spark, folder)).withColumn("water_scarce", farms.scarcity("months", "rain"))
    read = ["iso3", "income_group", "water_scarce", "fs", "gdp_pc", "irri_area", "paddy_area", "rainfed_area"]
    cells = farms.classify_scenarios(cut(frame.select(read)))
    out = farms.global_summary(cells, ["allocation"])
    return out.select(*out.columns[:3], *[F.round(c, 4).alias(c) for c in out.columns[3:]])


@query(
    "per_capita",
    """
    select p.cell, p.layer, heads, product, coalesce(product / nullif(heads, 0), 0) as per_head
    from (select l_partkey as cell, l_linenumber as layer, sum(case when l_returnflag = 'A' then l_quantity else 0 end) as heads from lineitem group by all) p
    join (select l_partkey as cell, l_linenumber as layer, sum(case when l_linestatus = 'O' then l_quantity end) as product from lineitem group by all) g
      on p.cell = g.cell and p.layer = g.layer
    """,
)
def per_capita(spark, folder):
    li = Tables(spark, folder).lineitem
    keyed = li.withColumnsRenamed({"l_partkey": "cell", "l_linenumber": "layer"})
    counted = F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0.0)
    people = keyed.groupBy("cell", "layer").agg(F.sum(counted).alias("heads"))
    product = keyed.groupBy("cell", "layer").agg(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("product"))
    return grid.per_capita(people, product, ["cell", "layer"], "heads", "product", "per_head")


@query(
    "layer_mode_and_lookup",
    """
    with layers as (select l_partkey as cell_id, l_linenumber as layer, max(s_nationkey) as value
                    from lineitem join supplier on l_suppkey = s_suppkey group by all),
    counts as (select cell_id, value, count(*) as n, min(layer) as first from layers group by all),
    modes as (select cell_id, value from (select *, row_number() over (partition by cell_id order by n desc, first) as r from counts) where r = 1)
    select cell_id, value as world, n_name as country, 'C' || n_regionkey as iso3 from modes left join nation on value = n_nationkey
    """,
)
def layer_mode_and_lookup(spark, folder):
    t = Tables(spark, folder)
    lines = relational.merge(
        t.lineitem.select("l_partkey", "l_linenumber", "l_suppkey"), t.supplier.select("s_suppkey", "s_nationkey"),
        left_on="l_suppkey", right_on="s_suppkey", how="inner", null_keys="drop",
    )
    layers = lines.groupBy(F.col("l_partkey").alias("cell_id"), F.col("l_linenumber").alias("layer")).agg(
        F.max("s_nationkey").alias("value")
    )
    modes = grid.composite_mode(layers).withColumnRenamed("value", "world")
    lookup = t.nation.select(
        F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("seq"),
        F.concat(F.lit("C"), F.col("n_regionkey").cast("string")).alias("iso3"), F.col("n_name").alias("country"),
    )
    return farms.country_of(modes, lookup).select("cell_id", "world", "country", "iso3")


@query(
    "rain_composite",
    """
    select l_partkey as cell_id, case when count(v) = count(*) then median(v) end as value from (
      select l_partkey, nullif(l_quantity, case when l_partkey % 3 = 0 then 50.0 end) as v from lineitem
      where cast(l_shipdate as date) between date '1996-01-01' and date '2005-12-31') group by 1
    """,
)
def rain_composite(spark, folder):
    li = Tables(spark, folder).lineitem
    hole = (F.col("l_partkey") % 3 == 0) & (F.col("l_quantity") == 50)
    cube = li.select(
        F.col("l_partkey").alias("cell_id"), F.to_date("l_shipdate").alias("ts"),
        F.when(~hole, F.col("l_quantity")).alias("value"),
    )
    return grid.composite(cube)


@query(
    "quantile_threshold_flag",
    f"""
    with {_CELLS}, measured as ({_measures('irrigation')}),
    sums as (select country, gdp_pc, sum(tot_area) as w from measured where tot_area > 0 group by all),
    run as (select *, sum(w) over (partition by country order by gdp_pc) / sum(w) over (partition by country) as share from sums),
    cut as (select country, min(gdp_pc) as threshold from run where share >= 0.4 group by 1)
    select cell_id, m.country, threshold, cast(case when gdp_pc <= threshold then 1 when gdp_pc > threshold then 0 end as bigint) as low
    from measured m left join cut c on m.country = c.country
    """,
)
def quantile_threshold_flag(spark, folder):
    cells = farms.prepare_cells(cell_frame(Tables(spark, folder)))
    flagged = quantile.flag_below_quantile(cells, "gdp_pc", "tot_area", 0.4, ["country"], "threshold", "low")
    return flagged.select("cell_id", "country", "threshold", F.col("low").cast("bigint").alias("low"))
