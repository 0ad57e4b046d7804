"""Classifier metrics, fold summaries, grid search and score tables."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.aggregates import fold_summary
from furrow.operators.relational import tag

METRICS = ["accuracy", "precision", "recall", "f1"]


def parameter_grid(**values: list) -> list[dict]:
    """All combinations, the last name varying fastest."""
    return [dict(zip(values, combo)) for combo in product(*values.values())]


def metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 per group; undefined parts count 0.

    One aggregate turns the rows into confusion counts; the rest works on classes x classes.
    """
    by = by or []
    hit = F.col(label) == F.col(prediction)
    confusion = df.groupBy(*by, label, prediction).agg(F.count(F.lit(1)).alias("__n"))
    sides = F.array(
        F.struct(
            F.col(label).cast("double").alias("c"), F.col("__n").alias("support"), F.lit(0).cast("bigint").alias("called"),
            F.when(hit, F.col("__n")).otherwise(0).cast("bigint").alias("right"),
        ),
        F.struct(
            F.col(prediction).cast("double").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("__n").alias("called"),
            F.lit(0).cast("bigint").alias("right"),
        ),
    )
    per_class = (
        confusion.select(*by, F.explode(sides).alias("__e"))
        .select(*by, "__e.*")
        .groupBy(*by, "c")
        .agg(*[F.sum(x).alias(x) for x in ("support", "called", "right")])
    )
    part = lambda n, d: F.coalesce(F.col(n) / F.nullif(F.col(d), F.lit(0)), F.lit(0.0))
    rated = per_class.withColumns({"p": part("right", "called"), "r": part("right", "support")})
    rated = rated.withColumn(
        "f", F.coalesce(F.lit(2.0) * F.col("p") * F.col("r") / F.nullif(F.col("p") + F.col("r"), F.lit(0.0)), F.lit(0.0))
    )
    weighted = lambda x: F.sum(F.col("support") * F.col(x)) / F.sum("support")
    return rated.groupBy(*by).agg(
        (F.sum("right") / F.sum("support")).alias("accuracy"),
        weighted("p").alias("precision"),
        weighted("r").alias("recall"),
        weighted("f").alias("f1"),
    )


def summarise_folds(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """mean_* and std_* of the four metrics over the folds."""
    return fold_summary(scores, METRICS, by)


def best_setting(predictions: DataFrame, setting: str, grid: list, fold: str = "fold", label: str = "label") -> DataFrame:
    """Mean fold accuracy per setting and the winner; of equals, the first of the grid."""
    scores = metrics(predictions, label, "prediction", [setting, fold])
    place = F.array_position(F.array(*[F.lit(g) for g in grid]), F.col(setting))
    means = scores.groupBy(setting).agg(F.avg("accuracy").alias("mean_accuracy")).withColumn("place", place)
    # one row per setting: as many as the grid has
    order = Window.orderBy(F.round("mean_accuracy", 12).desc(), "place")
    return means.withColumn("is_best", F.row_number().over(order) == 1)


def score_table(summaries: dict[str, DataFrame]) -> DataFrame:
    """One row of mean and std scores per model."""
    return reduce(DataFrame.unionByName, [tag(s, model=name) for name, s in summaries.items()])
