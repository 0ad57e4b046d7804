"""Support vector classifiers with rbf and polynomial kernels, as random features and linear machines.

The kernels are approximated by random features, so results are close to, not equal to, an exact kernel machine. There is
no table of terms and no bound on them: a term's row of the projection is drawn from a hash of the term, and a text's row is the
sum over its own terms. All machines of a search, every setting and fold, are trained together (``descent``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from furrow.lineage import cut, release
from furrow.operators.descent import descend, packed
from furrow.operators.evaluation import best_setting, parameter_grid

FEATURES = 256
DEGREE = 3
#: Texts projected at once; terms whose rows are drawn at once (few, so that they stay in the processor's cache).
TEXTS, DRAWN = 128, 32
#: Frequent terms of a batch whose rows are kept while it is projected.
OFTEN = 1 << 14
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64((salt + 1) * 0x632BE59BD9B4E019 % (1 << 64))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _term_rows(terms: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Normal numbers, one row per term: the same row for a term in every batch. A hash gives two of them, by its upper and lower bits."""
    made, half = np.empty((len(terms), width)), (width + 1) // 2
    start, steps = _hash(terms, seed), np.arange(half, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    for first in range(0, len(terms), DRAWN):
        h = _hash(start[first : first + DRAWN, None] + steps, 1)
        size = ((h >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) / np.float32(1 << 24)
        np.sqrt(np.multiply(np.float32(-2), np.log(size, out=size), out=size), out=size)
        turn = ((h >> np.uint64(8)) & np.uint64((1 << 24) - 1)).astype(np.float32) * np.float32(2 * np.pi / (1 << 24))
        made[first : first + DRAWN, :half] = size * np.cos(turn)
        made[first : first + DRAWN, half:] = (size * np.sin(turn))[:, : width - half]
    return made


def _cells(slots: pd.Series, values: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term, value) of a batch's terms."""
    sizes = slots.map(len).to_numpy()
    term = np.concatenate([np.asarray(s, np.int64) for s in slots] or [np.zeros(0, np.int64)]).view(np.uint64)
    return np.repeat(np.arange(len(slots)), sizes), term, np.concatenate([np.asarray(v, float) for v in values] or [np.zeros(0)])


def projected(slots: pd.Series, values: pd.Series, width: int, seed: int) -> np.ndarray:
    """Texts x width: sums of the terms' rows. A text without terms has zeros."""
    made = np.zeros((len(slots), width))
    often, known = np.zeros(0, np.uint64), np.zeros((0, width))
    if len(slots) > TEXTS:  # rows that many texts of the batch need are drawn once
        term, times = np.unique(_cells(slots, values)[1], return_counts=True)
        often = term[np.sort(np.argsort(-times, kind="stable")[:OFTEN])]
        known = _term_rows(often, width, seed)
    for first in range(0, len(slots), TEXTS):
        row, term, value = _cells(slots.iloc[first : first + TEXTS], values.iloc[first : first + TEXTS])
        if len(row):
            own, at = np.unique(term, return_inverse=True)
            drawn = np.empty((len(own), width))
            place = np.minimum(np.searchsorted(often, own), max(len(often) - 1, 0))
            held = often[place] == own if len(often) else np.zeros(len(own), bool)
            drawn[held], drawn[~held] = known[place[held]], _term_rows(own[~held], width, seed)
            ends = np.searchsorted(row, np.arange(row[-1] + 2)).tolist()
            for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                made[first + i] = value[a:b] @ drawn[at[a:b]]
    return made


def _sketched(slots: pd.Series, values: pd.Series, width: int, seed: int) -> np.ndarray:
    """Tensor sketch: inner products approach (x.y) ** DEGREE. Place and sign of a term follow from its hash, per degree."""
    row, term, value = _cells(slots, values)
    spectrum = None
    for d in range(DEGREE):
        h = _hash(term, seed + 101 * (d + 1))
        place, sign = (h >> np.uint64(1)) % np.uint64(width), 1.0 - 2.0 * (h & np.uint64(1)).astype(float)
        one = np.bincount(row * width + place.astype(np.int64), value * sign, len(slots) * width).reshape(len(slots), width)
        f = np.fft.rfft(one, axis=1)
        spectrum = f if spectrum is None else spectrum * f
    return np.fft.irfft(spectrum, n=width, axis=1)


def _base(slots: pd.Series, values: pd.Series, kernel: str, features: int, seed: int) -> np.ndarray:
    """What the gammas of a kernel share."""
    return {"rbf": projected, "poly": _sketched}[kernel](slots, values, features, seed)


def _of_gamma(base: np.ndarray, kernel: str, gamma: float, seed: int) -> np.ndarray:
    """The features of a kernel and gamma, of the type of ``base``."""
    if kernel == "poly":
        return base * base.dtype.type(gamma ** (DEGREE / 2))
    shift = np.random.default_rng(seed).uniform(0.0, 2.0 * np.pi, base.shape[1]).astype(base.dtype)
    # inner products approach exp(-gamma |x - y|^2)
    return base.dtype.type(np.sqrt(2.0 / base.shape[1])) * np.cos(base.dtype.type(np.sqrt(2.0 * gamma)) * base + shift)


def mapped(slots: pd.Series, values: pd.Series, maps: list[tuple[str, float]], features: int, seed: int) -> list[np.ndarray]:
    """The features of each (kernel, gamma); what the gammas of a kernel share is made once."""
    base = {kernel: _base(slots, values, kernel, features, seed) for kernel in sorted({k for k, _ in maps})}
    return [_of_gamma(base[kernel], kernel, gamma, seed) for kernel, gamma in maps]


def kernel_features(hashed: DataFrame, kernel: str, gamma: float, features: int = FEATURES, seed: int = 11) -> DataFrame:
    """Add the vector column ``features`` to rows with ``slots`` (whole numbers that stand for terms) and ``values``. No shuffle."""

    @F.pandas_udf("array<double>")
    def project(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for slots, values in parts:
            yield pd.Series(list(mapped(slots, values, [(kernel, gamma)], features, seed)[0]))

    return hashed.withColumn("features", array_to_vector(project("slots", "values"))).drop("slots", "values")


def svm_bases(kernels: list[str], features: int = FEATURES, seed: int = 11):
    """A function of slots and values for what the gammas of each kernel share, in the kernels' order."""

    @F.pandas_udf("array<binary>")
    def project(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for slots, values in parts:
            made = [_base(slots, values, kernel, features, seed).astype(np.float32) for kernel in kernels]
            yield pd.Series([[x[i].tobytes() for x in made] for i in range(len(slots))], dtype=object)

    return project


def svm_predictions(
    rows: DataFrame,
    settings: list[dict],
    held: list[int],
    fold: str = "fold",
    label: str = "label",
    max_iter: int = 40,
    features: int = FEATURES,
    seed: int = 11,
    kernels: list[str] | None = None,
) -> DataFrame:
    """Predictions of every setting (dicts of C, kernel, gamma) on the rows of every fold in ``held``, by machines that have not
    seen that fold: the columns of ``rows`` without slots and values, ``setting`` (its place in the list), ``prediction``.

    ``label`` is 1 or 0. Hinge loss with the penalty 1 / (C n). All machines take each step together, so the number
    of jobs is that of the rounds, however many settings and folds there are; what the gammas of a kernel share is stored once.
    With ``kernels`` the rows are stored ones that have it already, as ``svm_bases`` of these kernels gives it, in ``__bases``.
    """
    maps = sorted({(s["kernel"], s["gamma"]) for s in settings})
    models = [[(i, s["C"], f) for i, s in enumerate(settings) if (s["kernel"], s["gamma"]) == m for f in held] for m in maps]
    others = [c for c in rows.columns if c not in ("slots", "values", "__bases")]
    own = kernels is None
    if own:
        kernels = sorted({kernel for kernel, _ in maps})
        stored = cut(rows.withColumn("__bases", svm_bases(kernels, features, seed)("slots", "values")).select(*others, "__bases"))
    else:
        stored = rows
    sizes = {r[0]: r[1] for r in stored.groupBy(fold).count().collect()}
    n = [np.array([max(1, sum(sizes.values()) - sizes.get(f, 0)) for _, _, f in own]) for own in models]
    reg = [1 / (np.array([c for _, c, _ in own]) * many) for own, many in zip(models, n, strict=True)]
    out = [np.array([f for *_, f in own]) for own in models]

    def matrix(raw: bytes, g: int) -> np.ndarray:
        x = _of_gamma(np.frombuffer(raw, np.float32).reshape(-1, features), *maps[g], seed)
        return np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(float)

    place = [kernels.index(kernel) for kernel, _ in maps]

    def gradients(packs: pd.DataFrame, params: list[np.ndarray]) -> list[np.ndarray]:
        made = [np.zeros_like(w) for w in params]
        for i in range(len(packs)):
            pack = packs.iloc[i]
            y, own = 2.0 * np.frombuffer(pack[label])[:, None] - 1, np.frombuffer(pack[fold])[:, None]
            for g, w in enumerate(params):
                x = matrix(pack[f"__b{place[g]}"], g)
                short = (y * (x @ w) < 1) & (own != out[g])
                made[g] -= x.T @ (short * y)
        return made

    def finish(grads: list[np.ndarray], params: list[np.ndarray]) -> list[np.ndarray]:
        inner = np.append(np.ones(features), 0)[:, None]  # no penalty on the constant
        return [g / many + r * w * inner for g, many, r, w in zip(grads, n, reg, params, strict=True)]

    cells = [f"__b{i}" for i in range(len(kernels))]
    packs = packed(stored.select(label, fold, *[F.col("__bases")[i].alias(c) for i, c in enumerate(cells)]), [label, fold], cells)
    weights = descend(packs, gradients, finish, [np.zeros((features + 1, len(own))) for own in models], max_iter)

    release(packs)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bases = [b"".join(m[i] for m in batch["__bases"]) for i in range(len(kernels))]
            for g, own in enumerate(models):
                found = (matrix(bases[place[g]], g) @ weights[g] > 0).astype(np.int32)
                for j, (setting, _, f) in enumerate(own):
                    here = (batch[fold] == f).to_numpy()
                    if here.any():
                        yield batch.loc[here, others].assign(setting=setting, prediction=found[here, j])

    kept = [stored.schema[c] for c in others]
    made = cut(stored.select(*others, "__bases").mapInPandas(predict, StructType([*kept, *(StructField(c, IntegerType()) for c in ("setting", "prediction"))])))
    if own:
        release(stored)
    return made


def svm_cross_validate(rows: DataFrame, fold: str, k: int, C: float, kernel: str, gamma: float, label: str = "label", **kwargs) -> DataFrame:  # noqa: N803
    """Held-out predictions of every fold by one setting."""
    return svm_predictions(rows, [{"C": C, "kernel": kernel, "gamma": gamma}], list(range(k)), fold, label, **kwargs).drop("setting")


def svm_grid_search(rows: DataFrame, grid: dict[str, list], fold: str = "fold", k: int = 5, label: str = "label", **kwargs) -> DataFrame:
    """C, kernel and gamma of every setting with ``n`` predictions and their mean fold accuracy, and the winner."""
    settings = parameter_grid(**grid)
    found = svm_predictions(rows, settings, list(range(k)), fold, label, **kwargs)
    best = best_setting(found, "setting", list(range(len(settings))), fold, label).join(found.groupBy("setting").agg(F.count("*").alias("n")), "setting")
    column = lambda name: F.get(F.array(*[F.lit(s[name]) for s in settings]), F.col("setting")).alias(name)
    return best.select(*[column(c) for c in ("C", "kernel", "gamma")], "setting", "n", "mean_accuracy", "is_best")
