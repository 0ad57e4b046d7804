import math

from pyspark.sql import functions as F

from conftest import table
from furrow.operators import polygons
from furrow.operators.grid import (
    GridSpec,
    align,
    composite,
    composite_mode,
    per_capita,
    regrid,
    rotate,
    stack_layers,
    to_layer,
    to_lonlat,
)


def test_grid_spec():
    half = GridSpec.degrees(2)
    assert (half.nrow, half.ncol, half.res) == (360, 720, 0.5)
    area = GridSpec.equal_area()
    assert (area.ncol, area.nrow) == (4011, 2006)


def test_cells_and_lookup(spark):
    grid = GridSpec(-10.0, 5.0, 2.5, 4, 8)
    cells = grid.cells(spark)
    assert cells.count() == 32
    back = cells.withColumn("again", grid.cell_at(F.col("x"), F.col("y")))
    assert back.filter(F.col("again") != F.col("cell_id")).count() == 0
    assert spark.range(1).select(grid.cell_at(F.lit(-11.0), F.lit(0.0))).first()[0] is None


def eckert(lon, lat):
    """Forward projection by bisection, independent of the closed inverse."""
    target = (2 + math.pi / 2) * math.sin(math.radians(lat))
    lo, hi = -math.pi / 2, math.pi / 2
    for _ in range(200):
        t = (lo + hi) / 2
        if t + math.sin(t) * math.cos(t) + 2 * math.sin(t) < target:
            lo = t
        else:
            hi = t
    r = 6378137.0
    x = 2 / math.sqrt(4 * math.pi + math.pi**2) * r * math.radians(lon) * (1 + math.cos(t))
    return x, 2 * math.sqrt(math.pi / (4 + math.pi)) * r * math.sin(t)


def test_equal_area_inverse(spark):
    points = [(100.0, 30.0), (-170.0, -60.0), (0.0, 0.0), (12.5, 89.0), (179.9, 1.0)]
    df = spark.createDataFrame([(*p, *eckert(*p)) for p in points], "lon double, lat double, x double, y double")
    lon, lat = to_lonlat(F.col("x"), F.col("y"), "eck4")
    for r in df.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert abs(r.lon - r.a) < 1e-6 and abs(r.lat - r.b) < 1e-6
    off = spark.createDataFrame([(1.69e7, 8e6), (0.0, 9e6)], "x double, y double").select(lon, lat).collect()
    assert all(tuple(r) == (None, None) for r in off)


def test_nearest_to_same_grid_is_identity(spark):
    grid = GridSpec.degrees(1)
    layer = spark.range(0, grid.nrow * grid.ncol, 7).select(F.col("id").alias("cell_id"), (F.col("id") * 1.5).alias("value"))
    assert table(regrid(layer, grid, grid)) == table(layer)


def test_constant_and_linear_layers(spark):
    src = GridSpec.degrees(1)
    cells = src.cells(spark)
    target = GridSpec.equal_area(400_000.0, dx=137.0, dy=-211.0)
    constant = cells.select("cell_id", F.lit(3.0).alias("value"))
    for method in ("nearest", "bilinear"):
        got = regrid(constant, src, target, method)
        assert got.count() > 2000 and got.filter("value is null").count() == 0 and got.filter(F.abs(F.col("value") - 3) > 1e-12).count() == 0
    linear = cells.select("cell_id", (F.col("x") * 2 + F.col("y")).alias("value"))
    placed = regrid(linear, src, target, "bilinear").join(target.cells(spark), "cell_id")
    lon, lat = to_lonlat(F.col("x"), F.col("y"), "eck4")
    inner = (F.abs(lon) < 179.5) & (F.abs(lat) < 89.5)
    assert placed.filter(inner & (F.abs(F.col("value") - (lon * 2 + lat)) > 1e-9)).count() == 0


def test_bilinear_needs_all_four(spark):
    src, dst = GridSpec(0.0, 4.0, 1.0, 4, 4), GridSpec(1.0, 3.0, 1.0, 2, 2)
    shifted = GridSpec(1.25, 2.75, 0.5, 1, 1)
    full = src.cells(spark).select("cell_id", F.col("x").alias("value"))
    assert table(regrid(full, src, shifted, "bilinear")) == [(0, 1.5)]
    hole = full.filter("cell_id != 5")
    assert table(regrid(hole, src, shifted, "bilinear")) == [(0, None)]
    assert table(align(full, src, dst)) == [(0, 1.5), (1, 2.5), (2, 1.5), (3, 2.5)]


def test_layers_of_one_grid_together(spark):
    src = GridSpec(0.0, 4.0, 1.0, 4, 4)
    both = src.cells(spark).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("layer"), "cell_id", F.col("x").alias("value"))
    got = regrid(both, src, src, "nearest", by=["layer"])
    assert got.count() == 32 and got.filter("layer = 'b'").count() == 16


def test_rotate_and_align(spark):
    grid = GridSpec(0.0, 1.0, 1.0, 2, 4)
    layer = grid.cells(spark).select("cell_id", F.col("col").cast("double").alias("value"))
    turned, spec = rotate(layer, GridSpec(0.0, 1.0, 90.0, 2, 4))
    assert spec.xmin == -180.0
    assert [r[1] for r in table(turned)][:4] == [2.0, 3.0, 0.0, 1.0]
    wide = GridSpec(-1.0, 2.0, 1.0, 4, 6)
    kept = table(align(layer, grid, wide, keep_empty=True))
    assert len(kept) == 24 and sum(v is not None for _, v in kept) == 8 and (7, 0.0) in kept


def test_composites(spark):
    rows = [(1, "1995-12-31", 99.0), (1, "1996-01-01", 1.0), (1, "2005-12-31", 3.0), (2, "2000-01-01", None), (2, "2000-02-01", 1.0)]
    cube = spark.createDataFrame(rows, "cell_id bigint, ts string, value double").withColumn("ts", F.to_date("ts"))
    assert table(composite(cube)) == [(1, 2.0), (2, None)]
    layers = spark.createDataFrame([(1, 1, 5.0), (2, 1, 7.0), (3, 1, 7.0), (1, 2, None), (2, 2, None), (3, 2, 1.0)], "layer int, cell_id bigint, value double")
    assert table(composite_mode(layers)) == [(1, 7.0), (2, None)]


def test_per_capita_null_is_zero(spark):
    pop = spark.createDataFrame([(1, 0.0, 0.0, 2.0), (2, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 1.0)], "gID bigint, px double, py double, p double")
    gdp = spark.createDataFrame([(1, 0.0, 0.0, 6.0), (2, 0.0, 0.0, 0.0), (4, 0.0, 0.0, 1.0)], "gID bigint, px double, py double, g double")
    got = per_capita(pop, gdp, ["gID", "px", "py"], "p", "g", "v").select("gID", "v")
    assert table(got) == [(1, 3.0), (2, 0.0)]


def test_stack_and_write_back(spark):
    a = spark.createDataFrame([(0, 1.0), (2, 5.0)], "cell_id bigint, value double")
    b = spark.createDataFrame([(2, 7.0)], "cell_id bigint, value double")
    cells = GridSpec(0.0, 1.0, 1.0, 1, 4).cells(spark)
    assert table(stack_layers({"a": a, "b": b}, cells=cells)) == [(0, 1.0, None), (1, None, None), (2, 5.0, 7.0), (3, None, None)]
    assert [tuple(r) for r in to_layer(a, "value", cells, 2).collect()] == [(0, 1.0), (1, None), (2, 5.0), (3, None)]


def parity(rings, x, y):
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 <= y) != (y2 <= y) and x1 + (y - y1) / (y2 - y1) * (x2 - x1) < x:
                inside = not inside
    return inside


def test_rasterize_against_brute_force(spark):
    shapes = {
        1: [[(0.2, 0.5), (9.3, 0.5), (9.3, 8.5), (4.9, 2.5), (0.2, 8.5)], [(1.1, 1.2), (3.3, 1.2), (3.3, 2.9)]],
        2: [[(-5.0, 4.0), (20.0, 4.2), (20.0, 6.7), (-5.0, 6.6)]],
        3: [[(2.0, 12.0), (3.0, 12.0), (2.5, 11.0)]],
    }
    rows = [(f, i, [{"x": float(x), "y": float(y)} for x, y in ring]) for f, rings in shapes.items() for i, ring in enumerate(rings)]
    rings = spark.createDataFrame(rows, "feature_id bigint, ring int, points array<struct<x: double, y: double>>")
    grid = GridSpec(0.0, 10.0, 1.0, 10, 10)
    edges = polygons.edges_of(rings)
    want = {(f, r * 10 + c) for f, g in shapes.items() for r in range(10) for c in range(10) if parity(g, c + 0.5, 10 - (r + 0.5))}
    assert set(table(polygons.covered_cells(edges, grid))) == want and len(want) > 30
    values = spark.createDataFrame([(1, 1.0), (2, None)], "feature_id bigint, value double")
    got = dict(table(polygons.rasterize(edges, values, grid, "value")))
    top = {}
    for f, cell in want:
        top[cell] = max(top.get(cell, 0), f)
    assert got == {cell: {1: 1.0, 2: None}[f] for cell, f in top.items()}
