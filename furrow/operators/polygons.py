"""Polygons as edge tables, and their rasterisation by even-odd parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.grid import GridSpec


def edges_of(rings: DataFrame, feature: str = "feature_id") -> DataFrame:
    """(feature, ring, points array<struct<x, y>>) to edges, each ring closed. No shuffle."""
    n = F.size("points")
    following = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col("points"), F.pmod(i + 1, n)))
    pairs = F.arrays_zip(F.col("points").alias("a"), following.alias("b"))
    # an empty ring would make sequence(0, -1) count down
    return (
        rings.filter(n > 1)
        .select(feature, F.explode(pairs).alias("e"))
        .select(
            feature,
            F.col("e.a.x").alias("x1"),
            F.col("e.a.y").alias("y1"),
            F.col("e.b.x").alias("x2"),
            F.col("e.b.y").alias("y2"),
        )
    )


def covered_cells(edges: DataFrame, grid: GridSpec, feature: str = "feature_id") -> DataFrame:
    """(feature, cell_id) for every cell whose centre lies inside the feature.

    Each edge is crossed with the rows whose centre lies in its half-open y range. A crossing flips
    the parity of all columns right of it, so crossings are summed modulo 2 per (feature, row, first
    column); at most one entry per column remains, and runs of odd parity are the covered columns.
    """
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    # rows with lo <= centre < hi
    first = F.floor((F.lit(grid.ymax) - hi) / F.lit(grid.res) - F.lit(0.5)) + 1
    last = F.floor((F.lit(grid.ymax) - lo) / F.lit(grid.res) - F.lit(0.5))
    first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(grid.nrow - 1))
    spans = edges.filter(F.col("y1") != F.col("y2")).withColumns({"__first": first, "__last": last})
    spans = spans.filter(F.col("__first") <= F.col("__last"))
    hits = spans.select("*", F.explode(F.sequence("__first", "__last")).alias("row"))
    y = grid.y(F.col("row"))
    x = F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    # first column whose centre is right of the crossing
    start = F.floor((x - F.lit(grid.xmin)) / F.lit(grid.res) - F.lit(0.5)) + 1
    start = F.least(F.greatest(start, F.lit(0)), F.lit(grid.ncol))
    flips = hits.groupBy(feature, "row", start.alias("__col")).agg((F.count(F.lit(1)) % 2).alias("__odd"))
    along = Window.partitionBy(feature, "row").orderBy("__col")
    runs = flips.filter(F.col("__odd") == 1).select(
        feature,
        "row",
        "__col",
        (F.row_number().over(along) % 2).alias("__inside"),
        F.coalesce(F.lead("__col").over(along), F.lit(grid.ncol)).alias("__end"),
    )
    inside = runs.filter((F.col("__inside") == 1) & (F.col("__end") > F.col("__col")))
    return inside.select(feature, "row", F.explode(F.sequence(F.col("__col"), F.col("__end") - 1)).alias("col")).select(
        feature, grid.id_of(F.col("row"), F.col("col")).alias("cell_id")
    )


def rasterize(
    edges: DataFrame, attributes: DataFrame, grid: GridSpec, value: str, feature: str = "feature_id"
) -> DataFrame:
    """(cell_id, value): the value of the covering feature, the highest feature id where several cover."""
    owner = covered_cells(edges, grid, feature).groupBy("cell_id").agg(F.max(feature).alias(feature))
    return owner.join(attributes.select(feature, value), feature, "left").select("cell_id", value)
