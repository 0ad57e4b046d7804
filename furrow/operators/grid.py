"""Gridded layers as cell tables.

A layer is a table of (cell_id, value); the geometry is a GridSpec. Cell ids run row by row from the
top left corner, so row and column are one division away and no lookup is needed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.constants import EARTH_RADIUS, EQUAL_AREA_CELL, RAIN_END, RAIN_START
from furrow.functions.nulls import _col, fill, ratio
from furrow.operators.quantile import median_strict, mode_first
from furrow.operators.relational import between_dates, merge

# Eckert IV scale factors for a unit sphere.
KX = 2.0 / math.sqrt(4 * math.pi + math.pi**2)
KY = 2.0 * math.sqrt(math.pi / (4 + math.pi))


@dataclass(frozen=True)
class GridSpec:
    """A regular grid. ``crs`` is ``lonlat`` (degrees) or ``eck4`` (Eckert IV, metres)."""

    xmin: float
    ymax: float
    res: float
    nrow: int
    ncol: int
    crs: str = "lonlat"

    @classmethod
    def degrees(cls, n: int = 2) -> GridSpec:
        """The whole globe at 1/n degree."""
        return cls(-180.0, 90.0, 1.0 / n, 180 * n, 360 * n)

    @classmethod
    def equal_area(cls, res: float = EQUAL_AREA_CELL, dx: float = 0.0, dy: float = 0.0) -> GridSpec:
        """The whole globe in equal-area cells of ``res`` metres, the corner moved by (dx, dy)."""
        xmax, ymax = 2 * math.pi * KX * EARTH_RADIUS, KY * EARTH_RADIUS
        return cls(-xmax + dx, ymax + dy, res, math.ceil(2 * ymax / res), math.ceil(2 * xmax / res), "eck4")

    @property
    def is_global(self) -> bool:
        """Whether the grid goes once around the globe and from pole to pole."""
        return self.crs == "lonlat" and math.isclose(self.ncol * self.res, 360.0) and math.isclose(self.nrow * self.res, 180.0)

    def row(self, cell: Column | str) -> Column:
        return F.floor(_col(cell) / F.lit(self.ncol)).cast("int")

    def col(self, cell: Column | str) -> Column:
        return F.pmod(_col(cell), F.lit(self.ncol)).cast("int")

    def x(self, col: Column) -> Column:
        """Centre of a column."""
        return F.lit(self.xmin) + (col + F.lit(0.5)) * F.lit(self.res)

    def y(self, row: Column) -> Column:
        """Centre of a row."""
        return F.lit(self.ymax) - (row + F.lit(0.5)) * F.lit(self.res)

    def id_of(self, row: Column, col: Column) -> Column:
        """Cell id, NULL outside the grid."""
        inside = (row >= 0) & (row < self.nrow) & (col >= 0) & (col < self.ncol)
        return F.when(inside, row.cast("bigint") * F.lit(self.ncol) + col.cast("bigint"))

    def cell_at(self, x: Column, y: Column) -> Column:
        """Id of the cell that covers a point."""
        return self.id_of(
            F.floor((F.lit(self.ymax) - y) / F.lit(self.res)), F.floor((x - F.lit(self.xmin)) / F.lit(self.res))
        )

    def cells(self, spark: SparkSession) -> DataFrame:
        """All cells with row, col and centre; generated on the executors."""
        ids = spark.range(self.nrow * self.ncol).withColumnRenamed("id", "cell_id")
        return ids.select("cell_id", self.row("cell_id").alias("row"), self.col("cell_id").alias("col")).withColumns(
            {"x": self.x(F.col("col")), "y": self.y(F.col("row"))}
        )


def to_lonlat(x: Column, y: Column, crs: str) -> tuple[Column, Column]:
    """Longitude and latitude of a point; NULL where the point is off the globe."""
    if crs == "lonlat":
        return x, y
    sin_t = y / F.lit(KY * EARTH_RADIUS)
    cos_t = F.sqrt(F.lit(1.0) - sin_t * sin_t)
    t = F.asin(sin_t)
    on_globe = F.abs(sin_t) <= 1
    arg = (t + sin_t * cos_t + F.lit(2.0) * sin_t) / F.lit(2 + math.pi / 2)
    lat = F.degrees(F.asin(F.least(F.greatest(arg, F.lit(-1.0)), F.lit(1.0))))
    lon = F.degrees(x / (F.lit(KX * EARTH_RADIUS) * (F.lit(1.0) + cos_t)))
    on_globe = on_globe & (F.abs(lon) <= 180)
    return F.when(on_globe, lon), F.when(on_globe, lat)


def _targets(spark: SparkSession, src: GridSpec, dst: GridSpec) -> DataFrame:
    if src.crs != "lonlat":
        raise ValueError("the source grid must be in degrees")
    cells = dst.cells(spark)
    lon, lat = to_lonlat(F.col("x"), F.col("y"), dst.crs)
    return cells.select("cell_id", lon.alias("lon"), lat.alias("lat")).filter(F.col("lon").isNotNull())


def regrid(
    layer: DataFrame,
    src: GridSpec,
    dst: GridSpec,
    method: str = "nearest",
    value: str = "value",
    by: list[str] | None = None,
) -> DataFrame:
    """Resample (by..., cell_id, value) from ``src`` to ``dst``: one row per target cell with a value.

    The target centres are inverted in closed form and equi-joined on the source cell id. ``by``
    carries layer columns, so all layers of one source grid are done in one job. Bilinear is NULL
    where one of the four neighbours is missing. On a grid around the globe the neighbour of the last column is
    the first one, and beyond the poles the edge row counts twice.
    """
    by = by or []
    spark = layer.sparkSession
    targets = _targets(spark, src, dst)
    source = layer.select(*by, F.col("cell_id").alias("__src"), F.col(value).cast("double").alias("__v"))
    if method == "nearest":
        ids = targets.select("cell_id", src.cell_at(F.col("lon"), F.col("lat")).alias("__src")).filter(
            F.col("__src").isNotNull()
        )
        return ids.join(source, "__src").select(*by, "cell_id", F.col("__v").alias(value))
    if method != "bilinear":
        raise ValueError(f"method must be nearest or bilinear, not {method!r}")
    fx = (F.col("lon") - F.lit(src.xmin)) / F.lit(src.res) - F.lit(0.5)
    fy = (F.lit(src.ymax) - F.col("lat")) / F.lit(src.res) - F.lit(0.5)
    placed = targets.select(
        "cell_id", F.floor(fx).alias("c"), F.floor(fy).alias("r"), (fx - F.floor(fx)).alias("u"), (fy - F.floor(fy)).alias("v")
    )
    u, v, r, c = F.col("u"), F.col("v"), F.col("r"), F.col("c")
    if src.is_global:
        near = lambda i, j: src.id_of(F.least(F.greatest(i, F.lit(0)), F.lit(src.nrow - 1)), F.pmod(j, F.lit(src.ncol)))
    else:
        near = src.id_of
    corners = F.array(
        F.struct(near(r, c).alias("s"), ((1 - u) * (1 - v)).alias("k")),
        F.struct(near(r, c + 1).alias("s"), (u * (1 - v)).alias("k")),
        F.struct(near(r + 1, c).alias("s"), ((1 - u) * v).alias("k")),
        F.struct(near(r + 1, c + 1).alias("s"), (u * v).alias("k")),
    )
    spread = placed.select("cell_id", F.explode(corners).alias("e")).select(
        "cell_id", F.col("e.s").alias("__src"), F.col("e.k").alias("__k")
    )
    met = spread.filter(F.col("__src").isNotNull()).join(source, "__src")
    summed = met.groupBy(*by, "cell_id").agg(F.count("__v").alias("__n"), F.sum(F.col("__k") * F.col("__v")).alias("__s"))
    return summed.select(*by, "cell_id", F.when(F.col("__n") == 4, F.col("__s")).alias(value))


def rotate(layer: DataFrame, grid: GridSpec) -> tuple[DataFrame, GridSpec]:
    """0..360 degrees to -180..180: the halves change places. Arithmetic on the id, no shuffle."""
    col = F.pmod(grid.col("cell_id") + F.lit(grid.ncol // 2), F.lit(grid.ncol))
    moved = grid.row("cell_id").cast("bigint") * F.lit(grid.ncol) + col
    return layer.withColumn("cell_id", moved.cast("bigint")), replace(grid, xmin=grid.xmin - 180.0)


def align(layer: DataFrame, src: GridSpec, dst: GridSpec, keep_empty: bool = False) -> DataFrame:
    """Extend, crop and snap a layer to another extent of the same cell size."""
    if src.crs != dst.crs or abs(src.res - dst.res) > 1e-9 * src.res:
        raise ValueError("grids differ in projection or cell size; regrid first")
    down, right = round((dst.ymax - src.ymax) / src.res), round((src.xmin - dst.xmin) / src.res)
    moved = dst.id_of(src.row("cell_id") + F.lit(down), src.col("cell_id") + F.lit(right))
    kept = layer.withColumn("cell_id", moved).filter(F.col("cell_id").isNotNull())
    return dst.cells(layer.sparkSession).select("cell_id").join(kept, "cell_id", "left") if keep_empty else kept


def composite(
    cube: DataFrame, start: str = RAIN_START, end: str = RAIN_END, ts: str = "ts", value: str = "value", **kwargs
) -> DataFrame:
    """Median over the dates of each cell, both ends included; NULL when a date is missing its value."""
    return median_strict(between_dates(cube, ts, start, end), value, ["cell_id"], name=value, **kwargs)


def composite_mode(layers: DataFrame, value: str = "value", layer: str = "layer") -> DataFrame:
    """Most frequent value over the layers of each cell; of equals, the one of the lowest layer."""
    return mode_first(layers, ["cell_id"], value, layer, name=value)


def per_capita(population: DataFrame, product: DataFrame, keys: list[str], people: str, amount: str, name: str) -> DataFrame:
    """Product per head on shared keys; a missing ratio counts as 0."""
    both = merge(population, product, on=keys, how="inner", null_keys="drop")
    return both.withColumn(name, fill(ratio(amount, people), 0.0))


def stack_layers(
    layers: DataFrame | dict[str, DataFrame],
    names: list[str] | None = None,
    cells: DataFrame | None = None,
    layer: str = "layer",
    value: str = "value",
) -> DataFrame:
    """Layers side by side, one row per cell, in one shuffle instead of a join per layer.

    Takes a long (cell_id, layer, value) table with the layer ``names``, or a dict of layers.
    ``cells`` keeps the cells that are empty in every layer.
    """
    if isinstance(layers, dict):
        names = list(layers)
        layers = reduce(
            DataFrame.unionByName,
            [
                d.select("cell_id", F.lit(n).alias(layer), F.col(value).cast("double").alias(value))
                for n, d in layers.items()
            ],
        )
    wide = layers.groupBy("cell_id").agg(
        *[F.max(F.when(F.col(layer) == n, F.col(value))).alias(n) for n in names]
    )
    return wide if cells is None else cells.select("cell_id").join(wide, "cell_id", "left")


def to_layer(df: DataFrame, value: str, cells: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write a cell measure back to its grid: every cell, in cell order, NULL where there is none."""
    full = cells.select("cell_id").join(df.select("cell_id", F.col(value).alias("value")), "cell_id", "left")
    ranged = full.repartitionByRange(partitions, "cell_id") if partitions else full.repartitionByRange("cell_id")
    return ranged.sortWithinPartitions("cell_id")
