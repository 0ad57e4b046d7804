"""Gridded layers, cubes and polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.operators.grid import GridSpec


def _on_grid(cells: DataFrame, grid: GridSpec, on_outside: str) -> DataFrame:
    """Cells whose id lies on the grid. Others, and NULL ids, are an error or (``'drop'``) left out at the scan."""
    inside = F.col("cell_id").between(0, grid.nrow * grid.ncol - 1)
    if on_outside == "drop":
        return cells.filter(inside)
    if on_outside != "error":
        raise ValueError(f"on_outside must be 'error' or 'drop', not {on_outside!r}")
    foreign = F.raise_error(F.concat(F.lit("cell id outside the grid: "), F.coalesce(F.col("cell_id").cast("string"), F.lit("NULL"))))
    return cells.withColumn("cell_id", F.when(inside, F.col("cell_id")).otherwise(foreign.cast("bigint")))


def read_layer(spark: SparkSession, path: str, grid: GridSpec, on_outside: str = "error") -> DataFrame:
    """One layer as (cell_id, value) with row and column; ids outside the grid fail unless ``on_outside='drop'``."""
    inside = _on_grid(spark.read.schema("cell_id bigint, value double").parquet(path), grid, on_outside)
    return inside.withColumns({"row": grid.row("cell_id"), "col": grid.col("cell_id")})


def write_cube(cube: DataFrame, path: str) -> None:
    """Store (cell_id, ts, value) by year, so a date range reads only its years."""
    cube.withColumn("year", F.year("ts")).write.mode("overwrite").partitionBy("year").parquet(path)


def read_cube(spark: SparkSession, path: str, grid: GridSpec, start: str | None = None, end: str | None = None, on_outside: str = "error") -> DataFrame:
    """(cell_id, ts, value) of a cube stored by year; both ends of the range included. Foreign ids as in ``read_layer``."""
    cube = spark.read.schema("cell_id bigint, ts date, value double, year int").parquet(path)
    if start:
        cube = cube.filter((F.col("year") >= int(start[:4])) & (F.col("ts") >= F.lit(start).cast("date")))
    if end:
        cube = cube.filter((F.col("year") <= int(end[:4])) & (F.col("ts") <= F.lit(end).cast("date")))
    return _on_grid(cube, grid, on_outside).drop("year")


def read_layers(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """All layers of a folder whose file name matches ``pattern``: (layer, cell_id, value).

    Layers are numbered from 1 in the order of their file names; the ranking runs on one row per file.
    """
    cells = (
        spark.read.schema("cell_id bigint, value double")
        .option("pathGlobFilter", pattern)
        .parquet(folder)
        .select(F.col("_metadata.file_name").alias("__file"), "cell_id", "value")
    )
    numbers = cells.select("__file").distinct().withColumn("layer", F.row_number().over(Window.orderBy("__file")))
    return cells.join(numbers, "__file").select("layer", "cell_id", "value")


_POINTS = "array<array<double>>"


def read_polygons(spark: SparkSession, path: str, attributes: str, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """GeoJSON to (feature_id, ring, points) rings and an attribute table.

    ``attributes`` is the schema of the properties, e.g. ``iso string, value double``; it must name
    ``feature_id`` as the number that orders the features. With ``multiline=False`` the file holds one
    feature per line and is read by many tasks.
    """
    feature = f"properties struct<{_colons(attributes)}>, geometry struct<type: string, coordinates: string>"
    reader = spark.read.option("multiLine", multiline)
    if multiline:
        nested = feature.replace("properties struct", "properties: struct").replace("geometry struct", "geometry: struct")
        features = reader.schema(f"features array<struct<{nested}>>").json(path).select(F.explode("features").alias("f"))
    else:
        features = reader.schema(feature).json(path).select(F.struct("properties", "geometry").alias("f"))
    flat = features.select("f.properties.*", F.col("f.geometry.type").alias("__type"), F.col("f.geometry.coordinates").alias("__xy"))
    single = F.from_json("__xy", f"array<{_POINTS}>")
    several = F.flatten(F.from_json("__xy", f"array<array<{_POINTS}>>"))
    rings = flat.select(
        "feature_id", F.posexplode(F.when(F.col("__type") == "MultiPolygon", several).otherwise(single)).alias("ring", "__ring")
    )
    points = F.transform("__ring", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return rings.select("feature_id", "ring", points.alias("points")), flat.drop("__type", "__xy")


def _colons(schema: str) -> str:
    """``a string, b double`` to ``a: string, b: double``."""
    return ", ".join(": ".join(f.split(maxsplit=1)) for f in (p.strip() for p in schema.split(",")))


def vertices(rings: DataFrame) -> DataFrame:
    """(feature_id, ring, seq, x, y)."""
    return rings.select("feature_id", "ring", F.posexplode("points").alias("seq", "p")).select(
        "feature_id", "ring", "seq", "p.x", "p.y"
    )
