"""Neural and forest text classifiers, and batch scoring of a text column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from furrow.lineage import cut, release
from furrow.operators.descent import descend, packed
from furrow.operators.kernels import projected

#: Inputs of the network: random projections of all terms. Terms that the forest splits on.
WIDTH, TERMS = 256, 512


def vectors(rows: DataFrame, dims: int) -> DataFrame:
    """(slots, values) to a dense vector column ``features``; slots are numbers below ``dims``."""

    @F.pandas_udf("array<double>")
    def dense(slots: pd.Series, values: pd.Series) -> pd.Series:
        made = np.zeros((len(slots), dims))
        sizes = slots.map(len).to_numpy()
        if sizes.sum():
            at = np.concatenate([np.asarray(s, np.int64) for s in slots])
            made[np.repeat(np.arange(len(slots)), sizes), at] = np.concatenate([np.asarray(v, float) for v in values])
        return pd.Series(list(made))

    return rows.withColumn("features", array_to_vector(dense("slots", "values"))).drop("slots", "values")


def projections(rows: DataFrame, width: int = WIDTH, seed: int = 17) -> DataFrame:
    """(slots, values) to a dense vector column ``features``: a random projection in which every term has a row of its own."""

    @F.pandas_udf("array<double>")
    def dense(slots: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series(list(projected(slots, values, width, seed)))

    return rows.withColumn("features", array_to_vector(dense("slots", "values"))).drop("slots", "values")


def network_inputs(width: int = WIDTH, seed: int = 17):
    """A function of slots and values for the inputs of ``network_cross_validate``."""

    @F.pandas_udf("binary")
    def project(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for slots, values in parts:
            yield pd.Series([x.tobytes() for x in projected(slots, values, width, seed).astype(np.float32)], dtype=object)

    return project


def network_cross_validate(
    rows: DataFrame, fold: str, k: int, label: str = "label", width: int = WIDTH, hidden: int = 16, max_iter: int = 40, seed: int = 17
) -> DataFrame:
    """Held-out predictions of every fold by networks of one hidden layer with softmax output, trained together.

    ``rows`` have slots and values; the inputs are random projections of all terms, stored once, if the rows are not stored ones
    that have them in ``__x`` already (``network_inputs``). The number of jobs is that of the rounds, however many folds there are.
    """
    others, own = [c for c in rows.columns if c not in ("slots", "values", "__x")], "__x" not in rows.columns
    stored = cut(rows.withColumn("__x", network_inputs(width, seed)("slots", "values")).select(*others, "__x")) if own else rows
    sizes = {r[0]: r[1] for r in stored.groupBy(fold).count().collect()}
    n = np.array([max(1, sum(sizes.values()) - sizes.get(f, 0)) for f in range(k)], float)[:, None, None]
    rng = np.random.default_rng(seed)
    start = [
        rng.normal(0, 1 / np.sqrt(width), (k, width + 1, hidden)),
        rng.normal(0, 1 / np.sqrt(hidden), (k, hidden + 1, 1)),
    ]

    def forward(raw: bytes, params: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.frombuffer(raw, np.float32).reshape(-1, width).astype(float)
        x = np.hstack([x, np.ones((len(x), 1))])
        # the networks side by side are one product
        hid = np.tanh(x @ params[0].transpose(1, 0, 2).reshape(width + 1, k * hidden)).reshape(len(x), k, hidden).transpose(1, 0, 2)
        inner = np.concatenate([hid, np.ones((k, len(x), 1))], axis=2)
        return x, inner, 1 / (1 + np.exp(-np.clip(inner @ params[1], -40, 40)))

    def gradients(packs: pd.DataFrame, params: list[np.ndarray]) -> list[np.ndarray]:
        made = [np.zeros_like(p) for p in params]
        for i in range(len(packs)):
            pack = packs.iloc[i]
            x, inner, p = forward(pack["__x"], params)
            seen = np.frombuffer(pack[fold])[None, :, None] != np.arange(k)[:, None, None]
            miss = (p - np.frombuffer(pack[label])[None, :, None]) * seen  # the cross-entropy's slope
            back = (miss @ params[1][:, :-1].transpose(0, 2, 1)) * (1 - inner[:, :, :-1] ** 2)
            made[0] += (x.T @ back.transpose(1, 0, 2).reshape(len(x), k * hidden)).reshape(width + 1, k, hidden).transpose(1, 0, 2)
            made[1] += inner.transpose(0, 2, 1) @ miss
        return made

    finish = lambda grads, params: [g / n + 1e-4 * w for g, w in zip(grads, params, strict=True)]
    packs = packed(stored, [label, fold], ["__x"])
    weights = descend(packs, gradients, finish, start, max_iter, rate=0.05)
    release(packs)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p, own = forward(b"".join(batch["__x"]), weights)[2][:, :, 0], batch[fold].to_numpy()
            here = (own >= 0) & (own < k)
            yield batch.loc[here, others].assign(prediction=(p[own[here], np.flatnonzero(here)] > 0.5).astype(np.int32))

    kept = [stored.schema[c] for c in others]
    made = cut(stored.select(*others, "__x").mapInPandas(predict, StructType([*kept, StructField("prediction", IntegerType())])))
    if own:
        release(stored)
    return made


def mlp_fit(train: DataFrame, layers: list[int], label: str = "label", max_iter: int = 40, seed: int = 5):
    """Feed-forward network with softmax output and cross-entropy loss."""
    net = MultilayerPerceptronClassifier(
        featuresCol="features", labelCol=label, layers=layers, maxIter=max_iter, seed=seed, blockSize=128
    )
    return net.fit(train)


def rf_fit(
    train: DataFrame, n_estimators: int = 20, criterion: str = "gini", max_features: int = 10, label: str = "label", seed: int = 5
):
    """Random forest; ``max_features`` counts the slots tried per split."""
    forest = RandomForestClassifier(
        featuresCol="features", labelCol=label, numTrees=n_estimators, impurity=criterion,
        featureSubsetStrategy=str(max_features), seed=seed,
    )
    return forest.fit(train)


def logistic_fit(train: DataFrame, label: str = "label", max_iter: int = 40):
    """Softmax cross-entropy without a hidden layer."""
    return LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter, regParam=0.01).fit(train)


def predicted(model, rows: DataFrame) -> DataFrame:
    out = model.transform(rows).withColumn("prediction", F.col("prediction").cast("int"))
    return out.drop("features", "rawPrediction", "probability")


def score_text(
    df: DataFrame, col: str, predictor_factory: Callable[[], Callable[[pd.Series], pd.Series]], name: str = "prediction", dtype: str = "int"
) -> DataFrame:
    """Apply a predictor to a text column in Arrow batches; the factory runs once per task."""

    @F.pandas_udf(dtype)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = predictor_factory()
        for batch in batches:
            yield predict(batch)

    return df.withColumn(name, score(F.col(col)))


def mean_difference(cells: DataFrame, marks: DataFrame, key: str, label: str = "label") -> tuple[DataFrame, float]:
    """The linear scorer between the class means as a stored table (term, weight), one row per term, and its intercept.

    ``cells`` has key, term and v; ``marks`` the documents to learn from with a label of 1 or 0.
    """
    sizes = {r[0]: float(r[1]) for r in marks.groupBy(label).count().collect()}
    part = lambda k: F.sum(F.when(F.col(label) == k, F.col("v")).otherwise(0.0)) / F.lit(max(sizes.get(k, 0.0), 1.0))
    means = cut(cells.join(marks.select(key, label), key).groupBy("term").agg(part(1).alias("one"), part(0).alias("zero")))
    gap = means.agg(F.sum(F.col("zero") * F.col("zero") - F.col("one") * F.col("one"))).first()[0]
    return means.select("term", (F.col("one") - F.col("zero")).alias("weight")), 0.5 * (gap or 0.0)


def score_terms(docs: DataFrame, cells: DataFrame, weights: DataFrame, intercept: float, key: str, name: str = "prediction") -> DataFrame:
    """``docs`` with 1 where the linear score of a document's terms is positive, else 0, as a join with the model's table and a
    sum: no weight goes through the driver or Python. A document without known terms has the intercept as its score."""
    found = cells.join(weights, "term").groupBy(key).agg(F.sum(F.col("v") * F.col("weight")).alias("__s"))
    score = F.round(F.coalesce("__s", F.lit(0.0)) + F.lit(intercept), 9)
    return docs.join(found, key, "left").withColumn(name, (score > 0).cast("int")).drop("__s")
