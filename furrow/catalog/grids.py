"""Grid work on layers derived from the trade tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from furrow.catalog.base import Tables, query
from furrow.constants import EARTH_RADIUS
from furrow.lineage import cut
from furrow.operators import polygons, relational
from furrow.operators.grid import KX, KY, GridSpec, align, regrid, rotate, stack_layers, to_layer
from furrow.plans import irrigation

SOURCE = GridSpec.degrees(1)
# moved off the globe's corner so that no target centre falls on a source edge
TARGET = GridSpec.equal_area(100_000.0, dx=137.0, dy=-211.0)

_LAYER = f"""
    layer as (select (l_orderkey * 7 + l_linenumber * 11 + l_partkey * 13) % {SOURCE.nrow * SOURCE.ncol} as cell_id, sum(l_quantity) as value
              from lineitem group by 1)
"""

_TARGETS = f"""
    raw as (select id as cell_id, {TARGET.xmin!r}::double + (id % {TARGET.ncol} + 0.5e0) * {TARGET.res!r}::double as x,
                   {TARGET.ymax!r}::double - (id // {TARGET.ncol} + 0.5e0) * {TARGET.res!r}::double as y
            from range({TARGET.nrow * TARGET.ncol}) r(id)),
    turned as (select cell_id, x, y / {KY * EARTH_RADIUS!r}::double as s from raw),
    globe as (select cell_id, x, s, sqrt(1e0 - s * s) as c from turned where abs(s) <= 1),
    placed as (select cell_id, degrees(x / ({KX * EARTH_RADIUS!r}::double * (1e0 + c))) as lon,
                      degrees(asin(least(greatest((asin(s) + s * c + 2e0 * s) / {2 + math.pi / 2!r}::double, -1e0), 1e0))) as lat from globe),
    targets as (select * from placed where abs(lon) <= 180)
"""


def _layer(t: Tables):
    spot = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 11 + F.col("l_partkey") * 13) % (SOURCE.nrow * SOURCE.ncol)
    return t.lineitem.groupBy(spot.alias("cell_id")).agg(F.sum("l_quantity").alias("value"))


@query(
    "regrid_nearest",
    f"""
    with {_LAYER}, {_TARGETS}
    select t.cell_id, l.value from targets t
    join layer l on l.cell_id = cast(floor(90e0 - lat) as bigint) * {SOURCE.ncol} + cast(floor(lon + 180e0) as bigint)
    """,
)
def regrid_nearest(spark, folder):
    return regrid(_layer(Tables(spark, folder)), SOURCE, TARGET, "nearest")


@query(
    "regrid_bilinear",
    f"""
    with {_LAYER}, {_TARGETS},
    pos as (select cell_id, lon + 180e0 - 0.5e0 as fx, 90e0 - lat - 0.5e0 as fy from targets),
    cut as (select cell_id, cast(floor(fx) as bigint) as c, cast(floor(fy) as bigint) as r, fx - floor(fx) as u, fy - floor(fy) as v from pos),
    parts as (select cell_id, r + dr as r, c + dc as c, (case dc when 0 then 1 - u else u end) * (case dr when 0 then 1 - v else v end) as k
              from cut, (values (0, 0), (0, 1), (1, 0), (1, 1)) d(dr, dc)),
    met as (select p.cell_id, k, value from parts p join layer l on l.cell_id = least(greatest(p.r, 0), {SOURCE.nrow - 1}) * {SOURCE.ncol} + (p.c + {SOURCE.ncol}) % {SOURCE.ncol})
    select cell_id, round(case when count(*) = 4 then sum(k * value) end, 5) as value from met group by 1
    """,
)
def regrid_bilinear(spark, folder):
    out = regrid(_layer(Tables(spark, folder)), SOURCE, TARGET, "bilinear")
    return out.withColumn("value", F.round("value", 5))


@query(
    "rotate_layer",
    f"""
    with {_LAYER}, turned as (select (cell_id // 360) * 360 + (cell_id % 360 + 180) % 360 as cell_id, value from layer)
    select (cell_id // 360 - 30) * 200 + cell_id % 360 - 80 as cell_id, value from turned
    where cell_id // 360 between 30 and 129 and cell_id % 360 between 80 and 279
    """,
)
def rotate_layer(spark, folder):
    turned, spec = rotate(_layer(Tables(spark, folder)), GridSpec(0.0, 90.0, 1.0, 180, 360))
    window = GridSpec(-100.0, 60.0, 1.0, 100, 200)
    return align(turned, spec, window)


@query(
    "stack_layers",
    """
    select p_partkey as cell_id,
           max(case when l_linenumber = 1 then q end) as fs, max(case when l_linenumber = 2 then q end) as months,
           max(case when l_linenumber = 3 then q end) as world, max(case when l_linenumber = 4 then q end) as rain,
           max(case when l_linenumber = 5 then q end) as gdp_pc, max(case when l_linenumber = 6 then q end) as irri_area,
           max(case when l_linenumber = 7 then q end) as paddy_area
    from part left join (select l_partkey, l_linenumber, sum(l_quantity) as q from lineitem group by all) on l_partkey = p_partkey
    group by 1
    """,
)
def stack_layers_query(spark, folder):
    t = Tables(spark, folder)
    names = ["fs", "months", "world", "rain", "gdp_pc", "irri_area", "paddy_area"]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("l_linenumber"))
    long = (
        t.lineitem.groupBy(F.col("l_partkey").alias("cell_id"), name.alias("layer"))
        .agg(F.sum("l_quantity").alias("value"))
    )
    return stack_layers(long, names, cells=t.part.select(F.col("p_partkey").alias("cell_id")))


_SHAPES = """
    corner as (select p_partkey as feature_id, p_size, (p_partkey * 7919 % 3400) / 10e0 - 175e0 + 0.03e0 as x0,
                      (p_partkey * 104729 % 1600) / 10e0 - 85e0 + 0.02e0 as y0, p_size / 10e0 + 1e0 as w, p_partkey % 7 / 2e0 + 1.23e0 as h from part),
    shape as (select feature_id, x0, y0, x0 + w as xa, y0 + 0.7e0 as ya, x0 + w / 4e0 as xb, y0 + h as yb from corner),
    edge as (select feature_id, x0 as x1, y0 as y1, xa as x2, ya as y2 from shape
             union all select feature_id, xa, ya, xb, yb from shape
             union all select feature_id, xb, yb, x0, y0 from shape)
"""


def _edges(t: Tables):
    key = F.col("p_partkey")
    shapes = t.part.select(
        key.alias("feature_id"),
        ((key * 7919 % 3400) / 10.0 - 175.0 + 0.03).alias("x0"),
        ((key * 104729 % 1600) / 10.0 - 85.0 + 0.02).alias("y0"),
        (F.col("p_size") / 10.0 + 1.0).alias("w"),
        (key % 7 / 2.0 + 1.23).alias("h"),
    )
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    points = F.array(corner(x0, y0), corner(x0 + w, y0 + 0.7), corner(x0 + w / 4.0, y0 + h))
    return polygons.edges_of(shapes.select("feature_id", points.alias("points")))


@query(
    "rasterize_polygons",
    f"""
    with {_SHAPES},
    box as (select feature_id, least(x0, xa, xb) as lx, greatest(x0, xa, xb) as hx, least(y0, ya, yb) as ly, greatest(y0, ya, yb) as hy from shape),
    rows_ as (select *, unnest(generate_series(greatest(cast(floor(90e0 - hy) as bigint), 0), least(cast(floor(90e0 - ly) as bigint), 179))) as r from box),
    cell as (select feature_id, r, unnest(generate_series(greatest(cast(floor(lx + 180e0) as bigint), 0), least(cast(floor(hx + 180e0) as bigint), 359))) as c from rows_),
    inside as (select c.feature_id, r, c from cell c join edge e on c.feature_id = e.feature_id
               where (y1 <= 90e0 - (r + 0.5e0)) <> (y2 <= 90e0 - (r + 0.5e0))
                 and x1 + ((90e0 - (r + 0.5e0)) - y1) / (y2 - y1) * (x2 - x1) < -180e0 + (c + 0.5e0)
               group by all having count(*) % 2 = 1),
    owner as (select r * 360 + c as cell_id, max(feature_id) as feature_id from inside group by 1),
    attr as (select l_partkey as feature_id, sum(l_quantity) as value from lineitem group by 1)
    select cell_id, value from owner left join attr using (feature_id)
    """,
)
def rasterize_polygons(spark, folder):
    t = Tables(spark, folder)
    values = t.lineitem.groupBy(F.col("l_partkey").alias("feature_id")).agg(
        F.sum("l_quantity").alias("value")
    )
    return polygons.rasterize(_edges(t), values, GridSpec.degrees(1), "value")


@query(
    "attribute_to_polygon",
    f"""
    with {_SHAPES}, attr as (select l_partkey as feature_id, sum(l_quantity) as value from lineitem group by 1)
    select feature_id, x1, y1, x2, y2, value from edge left join attr using (feature_id)
    """,
)
def attribute_to_polygon(spark, folder):
    t = Tables(spark, folder)
    values = t.lineitem.groupBy(F.col("l_partkey").alias("feature_id")).agg(
        F.sum("l_quantity").alias("value")
    )
    return relational.merge(_edges(t), values, on="feature_id", null_keys="drop")


@query(
    "write_back",
    f"""
    with {_LAYER}
    select r.id as cell_id, case when value > 40 then 1 end as value from range({SOURCE.nrow * SOURCE.ncol}) r(id) left join layer l on l.cell_id = r.id
    """,
)
def write_back(spark, folder):
    marked = _layer(Tables(spark, folder)).withColumn("mark", F.when(F.col("value") > 40, F.lit(1)))
    return to_layer(marked, "mark", SOURCE.cells(spark))


_BLENDED = ["rain", "gdp_pc", "irri_area", "paddy_area", "rainfed_area"]
_NAMED = ["fs", "months", "world", *_BLENDED[:4]]
_NUMBERED = " ".join(f"when {i} then '{n}'" for i, n in enumerate(_NAMED, 1))
_SPOT = f"(l_orderkey * 7 + l_linenumber * 11 + l_partkey * 13) % {SOURCE.nrow * SOURCE.ncol}"


@query(
    "overlay_frame",
    f"""
    with {_TARGETS},
    drawn as (select case l_linenumber {_NUMBERED} end as layer, {_SPOT} as spot, l_quantity as q, l_suppkey from lineitem
              union all select 'rainfed_area', {_SPOT}, l_quantity, l_suppkey from lineitem where l_linenumber <= 7),
    base as (select layer, case layer when 'rain' then (spot // 360) * 360 + (spot % 360 + 180) % 360 else spot end as cell_id,
                    cast(case layer when 'world' then max(l_suppkey % 25) else sum(q) end as double) as value
             from drawn group by layer, spot),
    near as (select layer, t.cell_id, value from targets t join base b
             on b.cell_id = cast(floor(90e0 - lat) as bigint) * {SOURCE.ncol} + cast(floor(lon + 180e0) as bigint) where layer in ('fs', 'months', 'world')),
    pos as (select cell_id, lon + 180e0 - 0.5e0 as fx, 90e0 - lat - 0.5e0 as fy from targets),
    cut as (select cell_id, cast(floor(fx) as bigint) as c, cast(floor(fy) as bigint) as r, fx - floor(fx) as u, fy - floor(fy) as v from pos),
    parts as (select cell_id, r + dr as r, c + dc as c, (case dc when 0 then 1 - u else u end) * (case dr when 0 then 1 - v else v end) as k
              from cut, (values (0, 0), (0, 1), (1, 0), (1, 1)) d(dr, dc)),
    blend as (select layer, p.cell_id, case when count(*) = 4 then sum(k * value) end as value from parts p
              join base b on b.cell_id = least(greatest(p.r, 0), {SOURCE.nrow - 1}) * {SOURCE.ncol} + (p.c + {SOURCE.ncol}) % {SOURCE.ncol}
              where layer not in ('fs', 'months', 'world') group by all),
    moved as (select * from near union all select * from blend),
    frame as (select id as cell_id, {", ".join(f"max(value) filter (where layer = '{n}') as {n}" for n in [*_NAMED, "rainfed_area"])}
              from range({TARGET.nrow * TARGET.ncol}) r(id) left join moved on cell_id = id group by id)
    select cell_id, fs, months, cast(world as integer) as world, {", ".join(f"round({n}, 5) as {n}" for n in _BLENDED)}, n_name as country,
           case n_regionkey when 0 then 'Low income' when 1 then 'High income' end as income_group
    from frame left join nation on n_nationkey = world
    """,
)
def overlay_frame_query(spark, folder):
    """Eight layers, one of them on a 0..360 grid, resampled, stacked, with country and income group."""
    t = Tables(spark, folder)
    li = t.lineitem.filter(F.col("l_linenumber") <= len(_NAMED))
    spot = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 11 + F.col("l_partkey") * 13) % (SOURCE.nrow * SOURCE.ncol)
    turned_grid = GridSpec(0.0, 90.0, 1.0, SOURCE.nrow, SOURCE.ncol)

    def measure(number, name):
        col, total = (F.col("l_suppkey") % 25, F.max) if name == "world" else (F.col("l_quantity"), F.sum)
        return total(F.when(F.col("l_linenumber") == number, col)).alias(name)

    # one scan gives every layer; the stored columns are then read a layer at a time
    measures = [measure(number, name) for number, name in enumerate(_NAMED, 1)]
    drawn = cut(li.groupBy(spot.alias("cell_id")).agg(*measures, F.sum("l_quantity").alias("rainfed_area")))
    layers = {}
    for name in [*_NAMED, "rainfed_area"]:
        cells = drawn.select("cell_id", F.col(name).alias("value")).filter(F.col("value").isNotNull())
        layers[name] = rotate(cells, turned_grid) if name == "rain" else (cells, SOURCE)
    lookup = t.nation.select(
        F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("seq"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("iso3"), F.col("n_name").alias("country"),
    )
    incomes = t.region.select(
        F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("code"),
        F.when(F.col("r_regionkey") == 0, "Low income").when(F.col("r_regionkey") == 1, "High income").alias("income_group"),
    )
    frame = irrigation.overlay_frame(layers, TARGET, lookup, incomes)
    return frame.select("cell_id", "fs", "months", "world", *[F.round(n, 5).alias(n) for n in _BLENDED], "country", "income_group")
