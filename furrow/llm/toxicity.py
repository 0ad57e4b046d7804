"""Counterfactually regularised toxicity classifier: a logistic model over hashed words and word beginnings.

Fitting adds, to the logistic loss, the squared change of the raw score when an identity term in a labelled text is
swapped for another of its set, so a neutral mention of a group can't carry a score. Scoring is one pass over
whole texts without a shuffle; the model is an array of ``SLOTS`` weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.lineage import cut, release
from furrow.llm.batches import frugal

SLOTS = 1 << 18
#: Bytes of a word's beginning that are features, beside the whole word (0).
HEADS = (0, 4, 5, 6, 7, 8)
#: Labelled rows that are fitted on at most: the first ones in the order of a hash of their id.
LABELLED = 6000
TEXTS = 256
#: A slot whose log ratio is smaller says nothing.
FLOOR = 1.0
#: Sets of identity terms; a term is swapped for the others of its set.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "transgender", "bisexual"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("deaf", "blind", "disabled"),
)

_LETTER = np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz0123456789'") + list(range(128, 256))] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of every word of every text (words x ``HEADS``) and the words per text."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\0".join(raw) + b"\0" * 17, np.uint8)
    letter = _LETTER[data]
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    edge = np.concatenate([[0], edge]) if letter[0] else edge
    starts, ends = edge[::2], edge[1::2]
    size = ends - starts
    eight = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    first = np.ascontiguousarray(eight[starts]).view("<u8").reshape(-1)
    middle = np.ascontiguousarray(eight[np.minimum(starts + 8, len(data) - 8)]).view("<u8").reshape(-1)
    last = np.ascontiguousarray(eight[np.maximum(ends - 8, 0)]).view("<u8").reshape(-1)
    head = first & _MASKS[np.minimum(size, 8)]
    rest = _mixed(middle & _MASKS[np.clip(size - 8, 0, 8)]) ^ np.where(size > 16, _mixed(last + _MIX), np.uint64(0))
    made = np.empty((len(starts), len(HEADS)), np.int32)
    for j, k in enumerate(HEADS):
        key = head ^ rest ^ size.astype(np.uint64) if k == 0 else head & _MASKS[k]
        made[:, j] = (_mixed(_mixed(key) + np.uint64(j + 1)) >> np.uint64(40)).astype(np.int64) % SLOTS
    bounds = np.cumsum([len(r) + 1 for r in raw])
    words = np.diff(np.searchsorted(starts, bounds), prepend=0)
    return made, words


def _sums(values: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Sums over each text's words; a text without words gives 0."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.cumsum(words)
    return total[ends] - total[ends - words]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def raw(self, texts: list[str]) -> np.ndarray:
        made, words = slots(texts)
        return self.bias + _sums(self.weights[made].sum(axis=1), words) / np.sqrt(np.maximum(words, 1))

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(texts), -40, 40)))


def patterns(identity=IDENTITY) -> list[tuple[tuple[str, ...], re.Pattern]]:
    """Each set of terms with the pattern of its words; a term ends where letters and digits of any script end."""
    return [(terms, re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(terms, key=len, reverse=True))) + r")\b")) for terms in identity]


def swapped(text: str, identity=IDENTITY) -> list[str]:
    """The text in lower case with its identity terms swapped, one variant per other term of a set that occurs in it."""
    low = text.lower()
    made = []
    for terms, pattern in patterns(identity):
        if pattern.search(low):
            made += [pattern.sub(other, low) for other in terms]
    return [m for m in made if m != low]


def frequencies(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, texts that hold it, toxic ones among them)."""
    with_, all_ = np.zeros(SLOTS), np.zeros(SLOTS, np.int64)
    for first in range(0, len(texts), TEXTS):
        made, words = slots(texts[first : first + TEXTS])
        n, y = len(words), toxic[first : first + TEXTS]
        owner = np.repeat(np.arange(n), words)
        for head in made.T:
            pairs = np.unique(head.astype(np.int64) * n + owner)
            with_ += np.bincount(pairs // n, y[pairs % n], SLOTS)
            all_ += np.bincount(pairs // n, minlength=SLOTS)
    used = np.flatnonzero(all_)
    return used, all_[used], with_[used].astype(np.int64)


def leaning(used: np.ndarray, all_: np.ndarray, with_: np.ndarray, n: int, toxic: int) -> np.ndarray:
    """Per slot, how much likelier toxic texts are to hold it: the size of the log ratio of document frequencies;
    0 for slots in few texts."""
    ratio = np.log((with_ + 0.5) / (toxic + 1)) - np.log((all_ - with_ + 0.5) / (n - toxic + 1))
    lean = np.zeros(SLOTS)
    lean[used] = np.where(all_ >= max(2, min(8, n // 200)), np.maximum(np.abs(ratio) - FLOOR, 0), 0.0)
    return lean


@dataclass
class Cells:
    """Rows of a sparse matrix: how many cells each row has, their slots and values."""

    sizes: np.ndarray
    slot: np.ndarray
    value: np.ndarray

    @staticmethod
    def joined(parts: list[Cells]) -> Cells:
        made = [[getattr(p, c) for p in parts] for c in ("sizes", "slot", "value")]
        return Cells(*(np.concatenate(m) if m else np.zeros(0, k) for m, k in zip(made, (np.int32, np.int32, np.float32), strict=True)))


def cells(texts: list[str], telling: np.ndarray) -> Cells:
    """Counts of the telling slots of each text, over the root of its words."""
    made, words = slots(texts)
    owner = np.repeat(np.arange(len(texts)), words)
    parts = []
    for head in made.T:
        own = telling[head]
        parts.append(owner[own] * SLOTS + head[own])
    key, times = np.unique(np.concatenate(parts), return_counts=True)
    row = key // SLOTS
    value = times / np.sqrt(np.maximum(words, 1))[row]
    return Cells(np.bincount(row, minlength=len(texts)).astype(np.int32), (key % SLOTS).astype(np.int32), value.astype(np.float32))


def swap_cells(text: str, telling: np.ndarray, identity=IDENTITY) -> Cells:
    """One row per variant of the text: its telling slots less the variant's."""
    variants = swapped(text, identity)
    if not variants:
        return Cells.joined([])
    found = cells([text.lower(), *variants], telling)
    ends = np.cumsum(found.sizes)
    rows = []
    for i in range(1, len(ends)):
        own = slice(ends[i - 1], ends[i])
        slot = np.concatenate([found.slot[: ends[0]], found.slot[own]])
        rows.append(Cells(np.array([len(slot)], np.int32), slot, np.concatenate([found.value[: ends[0]], -found.value[own]])))
    return Cells.joined(rows)


def descend(texts: Cells, swaps: Cells, y: np.ndarray, lean: np.ndarray, penalty: float = 30.0, ridge: float = 1e-5, rounds: int = 300, rate: float = 0.1) -> Model:
    """Full-batch Adam on the logistic loss, the counterfactual penalty and a ridge term.

    A slot's weight is its leaning times what is learned, so slots that say little start and stay near zero.
    """
    n, pairs = len(y), len(swaps.sizes)
    used, slot = np.unique(texts.slot, return_inverse=True)
    slot = slot.astype(np.int32)
    rows, value = np.repeat(np.arange(n, dtype=np.int32), texts.sizes), texts.value * lean[texts.slot].astype(np.float32)
    at = np.searchsorted(used, swaps.slot)
    known = used[np.minimum(at, len(used) - 1)] == swaps.slot if len(used) else np.zeros(len(at), bool)
    pair, delta_slot, delta = np.repeat(np.arange(pairs), swaps.sizes)[known], at[known], (swaps.value * lean[swaps.slot])[known]
    learned, bias, m, v = np.zeros(len(used)), 0.0, np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for i in range(1, rounds + 1):
        z = bias + np.bincount(rows, value * learned[slot], n)
        miss = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        grad = np.bincount(slot, value * miss[rows], len(used)) / n + ridge * learned
        if len(pair):
            gap = np.bincount(pair, delta * learned[delta_slot], pairs)
            grad += np.bincount(delta_slot, delta * gap[pair], len(used)) * (2 * penalty / pairs)
        full = np.append(grad, miss.mean())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        step = rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        step *= min(1.0, 2 * (1 - i / (rounds + 1)))
        learned -= step[:-1]
        bias -= step[-1]
    weights = np.zeros(SLOTS)
    weights[used] = learned * lean[used]
    return Model(weights, float(bias))


def fit(texts: list[str], labels: np.ndarray, identity=IDENTITY, penalty: float = 30.0) -> Model:
    """The same on texts at hand."""
    y = labels.astype(float)
    lean = leaning(*frequencies(texts, y), len(texts), int(y.sum()))
    return descend(cells(texts, lean > 0), Cells.joined([swap_cells(t, lean > 0, identity) for t in texts]), y, lean, penalty)


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label) of at most ``most`` labelled rows to learn from, the first in the order of a hash of the id."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label"))
    few = known.filter(learn).orderBy(F.xxhash64("_id"), "_id", "_label").limit(most)
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return own.join(F.broadcast(few), "_id").select("_id", "_text", "_label")


def _packed(c: Cells) -> list[bytes]:
    return [c.sizes.tobytes(), c.slot.tobytes(), c.value.tobytes()]


def _unpacked(columns: list[list[bytes]]) -> Cells:
    return Cells(*(np.frombuffer(b"".join(c), k) for c, k in zip(columns, (np.int32, np.int32, np.float32), strict=True)))


_CELLS = ("sizes", "slots", "values", "swap_sizes", "swap_slots", "swap_values")


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, most: int = LABELLED, identity=IDENTITY, penalty: float = 30.0) -> Model:
    """Fit on at most ``most`` labelled documents; ``learn`` is a condition on ``_id``. Without both labels among
    them every score is the share of toxic rows (0.5 without rows).

    Tasks make the features: document frequencies of at most ``SLOTS`` slots come back first, then of each labelled row, and of
    each of its identity swaps, the slots that lean. No text reaches the driver.
    """
    rows = cut(labelled(docs, labels, "toxic", F.lit(True) if learn is None else learn, most))
    shares = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_label"), F.lit(0))).first()
    if shares[1] in (0, shares[0]):
        release(rows)
        share = shares[1] / shares[0] if shares[0] else 0.5
        return Model(np.zeros(SLOTS), float(np.log((share + 1e-6) / (1 - share + 1e-6))))

    @frugal
    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(dict(zip(("slot", "n", "toxic"), frequencies(batch["_text"].tolist(), batch["_label"].to_numpy(float)), strict=True)))

    counts = rows.mapInPandas(held, "slot long, n long, toxic long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toArrow()
    lean = leaning(*(counts[c].to_numpy() for c in ("slot", "n", "toxic")), shares[0], shares[1])
    telling = rows.sparkSession.sparkContext.broadcast(lean > 0)

    @frugal
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), TEXTS):
                texts = batch["_text"].iloc[i : i + TEXTS].tolist()
                swaps = Cells.joined([swap_cells(t, telling.value, identity) for t in texts])
                packed = [*_packed(cells(texts, telling.value)), *_packed(swaps)]
                own = batch.iloc[i]
                y = batch["_label"].iloc[i : i + TEXTS].to_numpy(np.int32).tobytes()
                yield pd.DataFrame({"first": [own["_id"]], "y": [y]} | {c: [p] for c, p in zip(_CELLS, packed, strict=True)})

    kind = dict(rows.dtypes)["_id"]
    found = rows.mapInPandas(made, f"first {kind}, y binary, " + ", ".join(f"{c} binary" for c in _CELLS)).toArrow().sort_by("first")
    release(rows)
    columns = {c: found[c].to_pylist() for c in ("y", *_CELLS)}
    y = np.frombuffer(b"".join(columns["y"]), np.int32).astype(float)
    return descend(_unpacked([columns[c] for c in _CELLS[:3]]), _unpacked([columns[c] for c in _CELLS[3:]]), y, lean, penalty)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with the score of each whole text in ``into`` (0 to 1, replacing a column of that name).

    NULL and empty texts score as a text without words. Every row stays, repeated rows score alike, no other
    column is read. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    @frugal
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for batch in batches:
            texts = batch.fillna("").tolist()
            parts = [own.score(texts[i : i + TEXTS]) for i in range(0, len(texts), TEXTS)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype=float)

    return docs.withColumn(into, scored(F.col(text)))
