"""Language-model scores from a Bloom filter of quantised bigram and word counts.

Counts are quantised on a logarithmic scale; a gram of level q is put into the filter q times, once for each level up to its
own, and is read back by probing level after level until one is missing. The filter is made in segments by hash, one group a
segment, and its bytes grow with the grams of the corpus; it is broadcast while it is smaller than ``FILTER_BYTES``. Beyond that
the keys of the texts go to the segments, a run of texts at a time, and are probed there; their levels come back in the keys'
order, a byte each. The answers are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from furrow.lineage import cut, release
from furrow.llm.batches import small_batches
from furrow.operators.ordering import AT

#: Ratio of neighbouring count levels, bits per entry, bits set of a 64-bit word per entry.
BASE, BITS, SET = 1.5, 12, 5
#: Weight of the lower order, in tokens.
CONCENTRATION = 64.0
#: Bytes of filter that are broadcast at most; frequent words whose exact counts are (a word of the N tokens is frequent from N / WORDS on).
FILTER_BYTES, WORDS = 256 << 20, 1 << 19
#: Bytes of text a segment of the filter is for; bytes that are hashed, and tokens that are sorted, at once.
SEGMENT, PIECE, TOKENS = 4 << 20, 1 << 19, 1 << 20
#: Bytes of text in a run, the keys of which are asked together.
RUN = 4 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(12)
_CODE = _rng.integers(0, 1 << 64, 256, np.uint64)
_MIX = _U(0x9E3779B97F4A7C15)
_STEP = _U(0xD1342543DE82EF95)
START, END = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)


def _powers(first: int, n: int) -> np.ndarray:
    out = np.full(n, first, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(int(_STEP), PIECE + 1), _powers(pow(int(_STEP), -1, 1 << 64), PIECE + 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _MIX
    x = (x ^ (x >> _U(29))) * _STEP
    return x ^ (x >> _U(32))


def _pieces(raw: bytes) -> Iterator[bytes]:
    """The text in pieces of at most ``PIECE`` bytes, cut behind a white space where there is one."""
    at = 0
    while len(raw) - at > PIECE:
        end = max(raw.rfind(c, at, at + PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) + 1
        if end <= at:  # one word longer than a piece: all of it
            ends = [e for e in (raw.find(c, at) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if e >= 0]
            end = min(ends, default=len(raw) - 1) + 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def _hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of these bytes, and where it starts."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = (_UP, _DOWN) if len(data) <= PIECE else (_powers(int(_STEP), len(data) + 1), _powers(pow(int(_STEP), -1, 1 << 64), len(data) + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[data] * up[: len(data)], dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and the words per text. Short texts are hashed together."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    found, counts, group, size = [], np.zeros(len(raw), np.int64), [], 0

    def close() -> None:
        keys, starts = _hashes(b" ".join(raw[i] for i in group))
        found.append(keys)
        counts[group] = np.diff(np.searchsorted(starts, np.cumsum([len(raw[i]) + 1 for i in group])), prepend=0)

    for i, r in enumerate(raw):
        if group and size + len(r) + 1 > PIECE:
            close()
            group, size = [], 0
        if len(r) >= PIECE:
            parts = [_hashes(p)[0] for p in _pieces(r)]
            found += parts
            counts[i] = sum(map(len, parts))
        else:
            group.append(i)
            size += len(r) + 1
    if group:
        close()
    return np.concatenate(found) if found else np.zeros(0, np.uint64), counts


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token, an end after the words of each text included: its key, the key of the token before, the key of both;
    and the tokens per text."""
    keys, counts = words(texts)
    sizes = counts + 1
    last = np.cumsum(sizes) - 1
    token = np.full(int(sizes.sum()), END)
    own = np.ones(len(token), bool)
    own[last] = False
    token[own] = keys
    before = np.concatenate([[START], token[:-1]])
    before[last - counts] = START
    return token, before, mixed(before * _MIX + token), sizes


def levels() -> np.ndarray:
    """Least count of each level: whole numbers, each ``BASE`` times the one before, and one more at least."""
    steps = [1]
    while steps[-1] < 1 << 44:
        steps.append(max(steps[-1] + 1, int(np.ceil(steps[-1] * BASE))))
    return np.array(steps, np.int64)


LEVELS = levels()
#: The count that a level stands for, 0 for none.
VALUES = np.concatenate([[0.0], (LEVELS[:-1] + LEVELS[1:] - 1) / 2, [float(LEVELS[-1])]])


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, "right")


def _places(keys: np.ndarray, level: int, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Word of the segment and the bits in it that stand for a key at a level."""
    h = mixed(keys + _U(level * int(_MIX) % (1 << 64)))
    mask = np.zeros(len(keys), np.uint64)
    for i in range(SET):
        mask |= _U(1) << ((h >> _U(6 * i)) & _U(63))
    return ((h >> _U(32)) * np.asarray(size, np.uint64)) >> _U(32), mask


def filled(keys: np.ndarray, level: np.ndarray) -> np.ndarray:
    """A segment with these keys at these levels."""
    made = np.zeros(max(1, -(-int(level.sum()) * BITS // 64)), np.uint64)
    for j in range(1, int(level.max(initial=0)) + 1):
        at, mask = _places(keys[level >= j], j, len(made))
        np.bitwise_or.at(made, at, mask)
    return made


@dataclass
class Filter:
    """Segments one after the other; a key's segment is given by its upper bits."""

    words: np.ndarray
    first: np.ndarray
    size: np.ndarray

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key by probes from 1 until a miss; never below the true one."""
        found, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
        segment = segment_of(keys, len(self.size))
        first, size = self.first[segment], self.size[segment]
        for j in range(1, len(LEVELS) + 1):
            if not len(left):
                break
            at, mask = _places(keys[left], j, size[left])
            hit = (self.words[first[left] + at.astype(np.int64)] & mask) == mask
            left = left[hit]
            found[left] = j
        return found


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (((keys >> _U(32)) * _U(segments)) >> _U(32)).astype(np.int64)


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``PIECE`` characters each, or one longer text."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > PIECE:
            yield first, i
            first, size = i, 0
        size += len(t or "") + 1
    if first < len(texts):
        yield first, len(texts)


def squeezed(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, the first byte of all, then the second, and so on: the upper ones are zeros, which
    a shuffle's compression drops."""
    return np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unsqueezed(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(np.uint64).reshape(-1), dtype=np.uint64)


def cuts(keys: np.ndarray, segments: int) -> np.ndarray:
    """Where the sorted keys of each segment begin, and their end."""
    return np.searchsorted(segment_of(keys, segments), np.arange(segments + 1))


_PACKED = pa.schema([("segment", pa.int32()), *[(c, pa.binary()) for c in ("gram_keys", "gram_times", "word_keys", "word_times")]])
_SEGMENT = pa.schema(
    [("segment", pa.int32()), ("bits", pa.binary()), ("grams", pa.binary()), ("times", pa.binary()), ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
)


def _packed(docs: DataFrame, text: str, segments: int) -> DataFrame:
    """Bigrams and words of the texts with their times, one row per segment and ``TOKENS`` tokens or so."""

    def packed(kept: list[tuple]) -> pa.RecordBatch:
        found = []
        for parts in zip(*kept, strict=True):
            keys, times = np.unique(np.concatenate(parts), return_counts=True)
            found.append((keys, times.astype(np.uint32), cuts(keys, segments)))
        rows = [[s, *[x for keys, times, c in found for x in (squeezed(keys[c[s] : c[s + 1]]), times[c[s] : c[s + 1]].tobytes())]] for s in range(segments)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[r for r in rows if any(r[1:])], strict=True), _PACKED, strict=True)], schema=_PACKED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in slices(texts):
                token, _, both, _ = grams(texts[i:j])
                kept.append((both, np.concatenate([token, np.full(j - i, START)])))
                size += len(token)
                if size >= TOKENS:
                    yield packed(kept)
                    kept, size = [], 0
        if kept:
            yield packed(kept)

    return docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(count, "segment int, gram_keys binary, gram_times binary, word_keys binary, word_times binary")


def _summed(keys: list[bytes], times: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(np.concatenate([unsqueezed(k) for k in keys]), return_inverse=True)
    return own, np.bincount(at, np.frombuffer(b"".join(times), np.uint32), len(own)).astype(np.int64)


def _segments(docs: DataFrame, text: str, segments: int, with_grams: bool) -> DataFrame:
    """One row per segment: its part of the filter, its words with their counts, on demand its bigrams with theirs. Stored."""

    def fill(rows: pa.Table) -> pa.Table:
        cols = rows.to_pydict()
        both, times = _summed(cols["gram_keys"], cols["gram_times"])
        own, counts = _summed(cols["word_keys"], cols["word_times"])
        bits = filled(np.concatenate([both, own]), level_of(np.concatenate([times, counts])))
        kept = own != START
        made = [cols["segment"][0], bits.tobytes(), both.tobytes() if with_grams else None, times.tobytes() if with_grams else None, own[kept].view(np.int64), counts[kept]]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(made, _SEGMENT, strict=True)], schema=_SEGMENT)

    kind = "segment int, bits binary, grams binary, times binary, keys array<long>, counts array<long>"
    with small_batches(docs.sparkSession):
        return cut(_packed(docs, text, segments).groupBy("segment").applyInArrow(fill, kind))


@dataclass
class Model:
    """``filter`` is None where it would be too large to broadcast; its ``segments``, so many and each for ``segment`` bytes of text, are
    ``stored`` in any case. ``exact``: the stored counts are asked in its place."""

    filter: Filter | None
    stored: DataFrame
    segments: int
    segment: int
    exact: bool
    vocabulary: DataFrame
    tokens: int
    distinct: int

    @property
    def mass(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)


def train(docs: DataFrame, text: str = "text", filter_bytes: int | None = None, segment: int = SEGMENT, broadcast: int = FILTER_BYTES) -> Model:
    """Counts of all words and bigrams of all texts, whole; a NULL text is an empty one, a repeated row counts again.

    One shuffle, of packed arrays. A segment is one group, of about ``segment`` bytes of text whatever the texts are, as
    keys are hashes of 64 bits (two different words share one with a chance of distinct words squared / 2 ** 65). The
    driver gets the filter, at most ``broadcast`` bytes; where it is larger, it stays in its stored segments and is probed there: the
    scores are those of the same filter, wherever it lies. A caller may set ``filter_bytes``: a filter that would be larger is not
    asked at all, the exact counts, quantised, are.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    segments = size // segment + 1
    made = _segments(docs, text, segments, False)
    whole = made.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    filter_, exact = None, filter_bytes is not None and whole > filter_bytes
    if exact:
        release(made)
        made = _segments(docs, text, segments, True)
    elif whole <= broadcast:
        words_, first, sizes, at = np.zeros(whole // 8 + 1, np.uint64), np.full(segments, whole // 8), np.ones(segments, np.int64), 0
        for row in made.select("segment", "bits").toLocalIterator():
            bits = np.frombuffer(row["bits"], np.uint64)
            words_[at : at + len(bits)] = bits
            first[row["segment"]], sizes[row["segment"]] = at, len(bits)
            at += len(bits)
        filter_ = Filter(words_, first, sizes)
    vocabulary = made.select(F.explode(F.arrays_zip("keys", "counts")).alias("e")).select("e.keys", "e.counts")
    totals = vocabulary.agg(F.sum("counts"), F.count(F.lit(1))).first()
    return Model(filter_, made, segments, segment, exact, vocabulary, totals[0] or 0, totals[1])


def smoothed(both: np.ndarray, before: np.ndarray, word: np.ndarray, mass: float) -> np.ndarray:
    """log10 of a token's probability from quantised counts: the bigram's share, drawn towards the word's by ``CONCENTRATION``."""
    lower = CONCENTRATION * (word + 0.5) / mass
    return np.log10((np.minimum(both, before) + lower) / (before + CONCENTRATION))


_FOUND = "n_tokens long, frequent long, base double, score double, rare array<long>, token array<long>, before array<long>, both array<long>"


@F.pandas_udf(DoubleType())
def quantised(counts: pd.Series) -> pd.Series:
    return pd.Series(VALUES[level_of(counts.to_numpy())])


@F.pandas_udf(LongType())
def _run(sizes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Number of a text's run in its task, from the bytes of the texts before it."""
    done = 0
    for own in sizes:
        ends = done + own.cumsum()
        yield (ends - own) // RUN
        done = ends.iloc[-1] if len(own) else done


def _probed(stored: DataFrame, model: Model) -> DataFrame:
    """(row, ``_score``) of stored texts in runs, read from the filter where its segments are.

    A run's different keys are sorted, so those of a segment are one stretch of them, and what the segment answers is a byte a key
    in the same order. A run that is read in two parts asks for each of them (``first`` and ``last`` row). A segment is asked
    in turns of about the text it was made from.
    """
    segments, mass = model.segments, model.mass
    size = stored.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    turns = int(size // (2 * segments * max(model.segment, RUN)) + 1)
    kinds = [("run", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("segment", pa.int32())]

    def different(texts: list) -> tuple[np.ndarray, tuple]:
        made = grams(texts)
        return np.unique(np.concatenate([made[0], made[2], [START]])), made

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def asked(run: int, rows: list, texts: list) -> pa.RecordBatch:
            keys = different(texts)[0]
            c = cuts(keys, segments)
            where = np.flatnonzero(np.diff(c))
            same = [np.full(len(where), x) for x in (run, min(rows), max(rows))]
            cols = [*same, where, (run ^ run >> 33) % turns + 0 * where, [squeezed(keys[c[s] : c[s + 1]]) for s in where]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(cols, asks, strict=True)], [n for n, _ in asks])

        own, rows, texts = None, [], []
        for batch in batches:
            for run, at, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if run != own and rows:
                    yield asked(own, rows, texts)
                    rows, texts = [], []
                own = run
                rows.append(at)
                texts.append(text)
        if rows:
            yield asked(own, rows, texts)

    def probe(asked: pa.Table, kept: pa.Table) -> pa.Table:
        parts = [unsqueezed(x) for x in asked["keys"].to_pylist()]
        bits = kept["bits"].to_pylist()
        if bits and parts:
            level = Filter(np.frombuffer(bits[0], np.uint64), np.zeros(1, np.int64), np.array([len(bits[0]) // 8])).level(np.concatenate(parts))
        else:
            level = np.zeros(sum(map(len, parts)), np.int64)
        found = [x.tobytes() for x in np.split(level.astype(np.uint8), np.cumsum([len(p) for p in parts])[:-1])] if parts else []
        return pa.table({**{n: asked[n] for n, _ in kinds}, "levels": pa.array(found, pa.binary())})

    def read(own: pa.Table, replies: pa.Table) -> pa.Table:
        at = own[AT].to_numpy()
        order = np.argsort(at)
        own = own.take(pa.array(order))
        at, texts = at[order], own["_text"].to_pylist()
        by: dict[tuple, list] = {}
        for first, last, where, raw in zip(*(replies[n].to_pylist() for n in ("first", "last", "segment", "levels")), strict=True):
            by.setdefault((first, last), []).append((where, raw))
        rows, scores = [], []
        for (first, last), found in by.items():
            i, j = np.searchsorted(at, first), np.searchsorted(at, last, "right")
            keys, (token, before, both, sizes) = different(texts[i:j])
            value = VALUES[np.frombuffer(b"".join(raw for _, raw in sorted(found)), np.uint8)]
            of = lambda x: value[np.searchsorted(keys, x)]  # noqa: B023, E731
            ends = np.cumsum(sizes)
            rows.append(at[i:j])
            scores.append(np.add.reduceat(smoothed(of(both), of(before), of(token), mass), ends - sizes))
        none = [np.zeros(0)]
        return pa.table({AT: pa.array(np.concatenate(rows or none), pa.int64()), "_score": pa.array(np.concatenate(scores or none), pa.float64())})

    asks = [*kinds, ("turn", pa.int32()), ("keys", pa.binary())]
    texts = stored.select("_run", AT, "_text")
    with small_batches(stored.sparkSession):
        asked = texts.mapInArrow(ask, "run long, first long, last long, segment int, turn int, keys binary").groupBy("segment", "turn")
        bits = model.stored.select("segment", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), "bits").groupBy("segment", "turn")
        replies = cut(asked.cogroup(bits).applyInArrow(probe, "run long, first long, last long, segment int, levels binary"))
        made = cut(texts.groupBy("_run").cogroup(replies.groupBy("run")).applyInArrow(read, f"{AT} long, _score double"))
    release(replies)
    return made


def _counted(model: Model) -> tuple[DataFrame, DataFrame]:
    """(key, value) of the words and of the bigrams from their exact counts."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n in zip(batch["grams"].to_pylist(), batch["times"].to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (k, n)], ["key", "n"])

    pairs = model.stored.select("grams", "times").mapInArrow(unpack, "key long, n long").select("key", quantised("n").alias("value"))
    return model.vocabulary.select(F.col("keys").alias("key"), quantised("counts").alias("value")), pairs


def _joined(stored: DataFrame, model: Model) -> DataFrame:
    """(row, ``_score``) from exact counts: the values of the keys meet the texts by joins."""
    cells = stored.select(AT, F.explode(F.arrays_zip("_found.token", "_found.before", "_found.both")).alias("e")).select(AT, "e.*")
    words_, pairs = _counted(model)
    met = cells
    for column, values in (("both", pairs), ("token", words_), ("before", words_)):
        met = met.join(values.withColumnsRenamed({"key": column, "value": f"of_{column}"}), column, "left")
    both, word, prior = (F.coalesce(f"of_{c}", F.lit(0.0)) for c in ("both", "token", "before"))
    lower = F.lit(CONCENTRATION) * (word + 0.5) / F.lit(model.mass)
    return met.groupBy(AT).agg(F.sum(F.log10((F.least(both, prior) + lower) / (prior + CONCENTRATION))).alias("_score"))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", words_: int = WORDS) -> DataFrame:
    """``keep`` columns with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (exact word counts) and ``score`` (the model's
    log10 probability of the text) of each whole text; what else ``docs`` has is not read.

    A NULL or empty text is one end; rows that are alike score alike, each in a row of its own; an empty table gives no rows; a model
    of no texts gives each token the probability 1. Exact counts of frequent words, at most ``words_`` of them by their definition,
    are broadcast; rare words meet theirs in a join, in which no key has more rows than its word's share allows.
    """
    spark = docs.sparkSession
    few = model.vocabulary.filter(F.col("counts") * words_ >= model.tokens).toArrow()
    order = np.argsort(few["keys"].to_numpy().view(np.uint64))
    known = few["keys"].to_numpy().view(np.uint64)[order], few["counts"].to_numpy()[order]
    shared, mass = spark.sparkContext.broadcast((model.filter, *known)), model.mass
    exact = model.exact
    del few, order, known

    @F.pandas_udf(_FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        filter_, frequent, counts = shared.value
        for batch in batches:
            texts = [None if t is None or t != t else t for t in batch]
            parts = [one(texts[i:j], filter_, frequent, counts) for i, j in slices(texts)]
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c.split()[0]: [] for c in _FOUND.split(", ")})

    def one(texts: list, filter_: Filter | None, frequent: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        token, before, both, sizes = grams(texts)
        own, at = np.unique(np.concatenate([token, [START]]), return_inverse=True)
        place = np.minimum(np.searchsorted(frequent, own), max(len(frequent) - 1, 0))
        often = frequent[place] == own if len(frequent) else np.zeros(len(own), bool)
        base = np.where(often, np.log10(((counts[place] if len(counts) else 0) + 0.5) / mass), 0.0)
        first = np.cumsum(sizes) - sizes
        at, start = at[:-1], at[-1]
        rare = ~often[at]
        ends = np.cumsum(np.add.reduceat(rare, first))[:-1]
        made = {"n_tokens": sizes, "frequent": np.add.reduceat(often[at].astype(np.int64), first), "base": np.add.reduceat(base[at], first)}
        made["score"] = np.nan
        if filter_ is not None:
            word = VALUES[filter_.level(own)]
            prior = np.concatenate([[start], at[:-1]])
            prior[first] = start
            made["score"] = np.add.reduceat(smoothed(VALUES[filter_.level(both)], word[prior], word[at], mass), first)
        lists = {"rare": np.split(token[rare].view(np.int64), ends), "token": [()] * len(sizes), "before": [()] * len(sizes), "both": [()] * len(sizes)}
        if exact:
            before = np.where(before == START, END, before)  # a text has one of each, and counts are of ends
            lists |= {c: np.split(x.view(np.int64), first[1:]) for c, x in (("token", token), ("before", before), ("both", both))}
        return pd.DataFrame(made | {c: pd.Series(x, dtype=object, index=range(len(sizes))) for c, x in lists.items()})

    plain = [F.col(f"`{c}`") for c in keep]
    own, place = F.col(f"`{text}`").cast("string"), F.monotonically_increasing_id()
    asked = model.filter is None and not exact
    with small_batches(spark):
        if asked:  # the texts are read once more, in runs, and are not kept any longer
            run = F.spark_partition_id().cast("long") * (1 << 33) + _run(F.coalesce(F.octet_length(own), F.lit(0)))
            rows = cut(docs.select(F.struct(*plain).alias("_keep"), own.alias("_text"), run.alias("_run")).withColumn(AT, place))
            scores = _probed(rows, model)
            stored = cut(rows.select("_keep", found("_text").alias("_found"), AT))
            release(rows)
        else:
            stored = cut(docs.select(F.struct(*plain).alias("_keep"), found(own).alias("_found")).withColumn(AT, place))
    shared.unpersist()
    cells = stored.select(AT, F.explode("_found.rare").alias("keys")).join(model.vocabulary, "keys", "left")
    count = F.coalesce("counts", F.lit(0))
    rare = cells.groupBy(AT).agg(F.sum(F.log10((count + 0.5) / F.lit(mass))).alias("_base"), F.sum((count > 0).cast("long")).alias("_known"))
    made = stored.join(rare, AT, "left")
    total = F.col("_found.score")
    if model.filter is None:
        made, total = made.join(scores if asked else _joined(stored, model), AT, "left"), F.col("_score")
    return made.select(
        "_keep.*",
        F.col("_found.n_tokens").alias("n_tokens"),
        (F.col("_found.frequent") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("_found.base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        total.alias("score"),
    )
