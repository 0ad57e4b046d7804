"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Each partition sums its own normal equations, Spark sums those, and the driver solves one small system. Scoring is
one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.lineage import cut, release
from furrow.llm import textstats
from furrow.llm.toxicity import labelled

FEATURES = 384
#: Inverse width of the kernel on standardised statistics, ridge per row, labelled rows at most, partial sums.
GAMMA, RIDGE, LABELLED, PARTS = 0.2, 1e-6, 20_000, 16
#: One labelled row in so many calibrates and is not fitted on.
CALIBRATE = 4


@dataclass
class Model:
    centre: np.ndarray
    width: np.ndarray
    beams: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    level: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.centre) / self.width, -8, 8)
        wave = np.cos(z @ self.beams + self.phase) * np.sqrt(2 / self.beams.shape[1])
        return np.column_stack([wave, np.ones(len(stats))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.features(stats) @ self.weights, self.raw, self.level)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean raw score and level of each block, levels rising strictly.

    A block's level is smoothed by half a row of either label, so no level is 0 or 1 and blocks stay apart.
    """
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for r, t in zip(raw[order], y[order], strict=True):
        blocks.append([r, t, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][i] + a[i] for i in range(3)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], np.maximum.accumulate((b[:, 1] + 0.5) / (b[:, 2] + 1.0))


def _start(stats: np.ndarray) -> Model:
    rng = np.random.default_rng(20)
    d = stats.shape[1]
    none = np.zeros(0)
    return Model(
        stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3), rng.normal(size=(d, FEATURES)) * np.sqrt(2 * GAMMA) / np.sqrt(d) * 2,
        rng.uniform(0, 2 * np.pi, FEATURES), none, none, none,
    )


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, most: int = LABELLED) -> Model:
    """Fit on at most ``most`` labelled rows; ``learn`` is a condition on ``_id``. One row in ``CALIBRATE`` (by a hash
    of its id) is kept for calibration. Without both labels every score is the share of good rows (0.5 without rows)."""
    rows = labelled(docs, labels, "quality", F.lit(True) if learn is None else learn, most)
    stored = cut(with_stats(rows, "_text").select("_id", "_label", *(F.col(f"_stats.{c}").alias(c) for c in textstats.COUNTS + textstats.MORE)))
    local = stored.orderBy("_id", "_label").toPandas()
    if local["_label"].nunique() < 2:
        release(stored)
        share = float(local["_label"].mean()) if len(local) else 0.5
        flat = _start(np.zeros((1, textstats.ratios(textstats.frame(pd.Series([""]))).shape[1])))
        flat.weights, flat.raw, flat.level = np.zeros(FEATURES + 1), np.zeros(1), np.array([share])
        return flat
    kept = F.pmod(F.xxhash64(F.lit("calibrate"), "_id"), F.lit(CALIBRATE)) == 0
    fitted = stored.filter(~kept)
    model = _start(textstats.ratios(local))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for b in batches:
            z = model.features(textstats.ratios(b))
            total += z.T @ np.column_stack([z, b["_label"].to_numpy(float)])
        yield pd.DataFrame({"row": range(FEATURES + 1), "part": list(total)})

    def added(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": [key[0]], "part": [np.sum(np.stack(group["part"].to_numpy()), axis=0)]})

    shape = "row int, part array<double>"
    parts = fitted.repartition(PARTS, F.xxhash64("_id")).mapInPandas(sums, shape)
    total = np.stack([r["part"] for r in sorted(parts.groupBy("row").applyInPandas(added, shape).collect())])
    n = max(total[-1, -2], 1.0)
    model.weights = np.linalg.solve(total[:, :-1] + RIDGE * n * np.eye(FEATURES + 1), total[:, -1])
    marks = stored.select("_id", "_label", kept.alias("kept")).orderBy("_id", "_label").toPandas()
    held = marks["kept"].to_numpy() if marks["kept"].any() else np.ones(len(marks), bool)
    model.raw, model.level = isotonic(model.features(textstats.ratios(local[held])) @ model.weights, local["_label"].to_numpy(float)[held])
    release(stored)
    return model


def with_stats(docs: DataFrame, text: str = "text", into: str = "_stats") -> DataFrame:
    """``docs`` with the rule statistics of each whole text as a struct of longs."""

    @F.pandas_udf(", ".join(f"{c} long" for c in textstats.COUNTS + textstats.MORE))
    def stats(texts: pd.Series) -> pd.DataFrame:
        return textstats.frame(texts)

    return docs.withColumn(into, stats(F.col(text)))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` with the calibrated score of each whole text in ``into`` (0 to 1, replacing a column of that name).

    NULL and empty texts score as texts without words. Every row stays, repeated rows score alike, no other
    column is read. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score(textstats.ratios(textstats.frame(texts))) if len(texts) else [], dtype=float)

    return docs.withColumn(into, scored(F.col(text)))
