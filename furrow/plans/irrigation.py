"""Products of the grid overlay: the cell frame and the irrigation summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.lineage import cut
from furrow.operators import farms, relational
from furrow.operators.grid import GridSpec, composite, composite_mode, per_capita, regrid, rotate, stack_layers
from furrow.operators.polygons import rasterize

# how each layer of the frame is resampled: classes keep their values, amounts are blended
METHODS = {
    "fs": "nearest",
    "months": "nearest",
    "world": "nearest",
    "rain": "bilinear",
    "gdp_pc": "bilinear",
    "irri_area": "bilinear",
    "paddy_area": "bilinear",
    "rainfed_area": "bilinear",
}


def rain_layer(cube: DataFrame, grid: GridSpec) -> tuple[DataFrame, GridSpec]:
    """Median monthly rain of the reference decade on a -180..180 grid."""
    return rotate(composite(cube), grid)


def product_layer(population: DataFrame, product: DataFrame, edges: DataFrame, grid: GridSpec, people: str, amount: str) -> DataFrame:
    """Product per head of the grid polygons (keyed gID, px, py), as a layer of ``grid``."""
    ratio = per_capita(population, product, ["gID", "px", "py"], people, amount, "value")
    return rasterize(edges, ratio.select(F.col("gID").alias("feature_id"), "value"), grid, "value")


def farm_size_layer(layers: DataFrame) -> DataFrame:
    return composite_mode(layers)


def overlay_frame(
    layers: dict[str, tuple[DataFrame, GridSpec]], target: GridSpec, lookup: DataFrame, incomes: DataFrame
) -> DataFrame:
    """All layers on the target grid, one row per cell, with country and income group.

    Layers that share a source grid and a method are resampled in one job; the stack is one shuffle.
    ``lookup``: id, seq, iso3, country. ``incomes``: code, income_group.
    """
    groups: dict[tuple[GridSpec, str], list[DataFrame]] = {}
    for name, (cells, grid) in layers.items():
        long = cells.select(F.lit(name).alias("layer"), "cell_id", F.col("value").cast("double").alias("value"))
        groups.setdefault((grid, METHODS[name]), []).append(long)
    moved = [
        regrid(reduce(DataFrame.unionByName, frames), grid, target, method, by=["layer"])
        for (grid, method), frames in groups.items()
    ]
    spark = moved[0].sparkSession
    frame = stack_layers(reduce(DataFrame.unionByName, moved), list(layers), cells=target.cells(spark))
    named = farms.country_of(frame.withColumn("world", F.col("world").cast("int")), lookup)
    return relational.merge(named, incomes, left_on="iso3", right_on="code")


def classified_cells(frame: DataFrame, **kwargs) -> DataFrame:
    """The frame is computed once: thresholds and classes both read the stored cells."""
    return farms.classify_small_scale(cut(farms.prepare_cells(frame)), **kwargs)


def summaries(frame: DataFrame, **kwargs) -> tuple[DataFrame, DataFrame]:
    """(per country, global) irrigation summaries."""
    cells = classified_cells(frame, **kwargs)
    return farms.country_summary(cells), farms.global_summary(cells)


def paddy_sensitivity(frame: DataFrame, **kwargs) -> DataFrame:
    """The global summary under every allocation of paddy area, in one job."""
    scarce = cut(frame.withColumn("water_scarce", farms.scarcity("months", "rain")))
    cells = farms.classify_scenarios(scarce, **kwargs)
    return farms.global_summary(cells, ["allocation"])
