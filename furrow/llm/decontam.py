"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of words as TF-IDF vectors over the benchmark's terms, with document frequencies over all
different passages of the corpus. A randomised SVD of all of these, on their products by term, which Spark sums, gives the latent
space; every passage is compared with every item by cosine there. Word shingles, matched exactly, are a second way to a candidate that needs
no weights, for items whose words are frequent. What is near enough is read word by word: the longest common subsequence
with the item, and whether the item's answer, its last words, is there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.lineage import cut, release
from furrow.llm.batches import frugal, small_batches
from furrow.llm.minhash import _PRIME, mixed, word_hashes

#: Words of a passage and between passages.
PASSAGE, STRIDE = 64, 32
#: Latent dimensions, extra random directions, power rounds.
RANK, EXTRA, POWER = 256, 16, 2
#: Sums of products a task holds at once; beyond that many the terms are dealt over several passes of the stored passages.
SUMS = 1 << 23
#: Terms in a larger share of the passages are frequent: they keep this share of their weight, at least LEAST, and are
#: not telling. Cosine for a candidate, and the share of the item's telling words that its passage must hold.
COMMON, SLIGHT, LEAST, NEAR, SHARED = 0.05, 0.1, 0.01, 0.3, 0.3
#: Words of a shingle that makes a candidate: of any item, and of one with less than this share of telling words.
SHINGLE, SHORT, WEAK = 6, 3, 0.5
#: Share of an item's words in order that is a leak by itself, and together with its answer; answer: share of its words.
WHOLE, PART, ANSWER, ANSWER_FOUND = 0.8, 0.5, 0.25, 0.8
TEXTS = 128

_BETWEEN = np.ones(256, bool)
_BETWEEN[list(b"abcdefghijklmnopqrstuvwxyz0123456789") + list(range(128, 256))] = False


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(texts, _BETWEEN)


@dataclass
class Index:
    """Items and, once fitted, the latent space; all bounded by the benchmark block."""

    items: list[int]
    words: list[np.ndarray]
    terms: np.ndarray
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    telling: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    #: (words of a shingle, sorted hashes, item of each)
    runs: list[tuple[int, np.ndarray, np.ndarray]] = field(default_factory=list)
    #: parts that hold each telling term: the parts by term, and where each term's begin
    holders: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    begins: np.ndarray = field(default_factory=lambda: np.zeros(1, int))
    #: telling terms of each part that a candidate passage must hold; first part of each item
    least: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    heads: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    #: item, first and last + 1 word of each part: an item is searched by its own passages
    parts: tuple[np.ndarray, np.ndarray, np.ndarray] = field(default_factory=lambda: passages(np.zeros(0), np.zeros(0, int)))
    latent: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    queries: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))

    def find(self, word: np.ndarray) -> np.ndarray:
        """Term numbers, -1 for words that are no term."""
        if not len(self.terms):
            return np.full(len(word), -1)
        shift, begins, most = self.dealt
        begin = begins[word >> shift]
        made = np.full(len(word), -1)
        here = np.flatnonzero(begin >= 0)
        begin, word = begin[here], word[here]
        for i in range(most):
            at = np.minimum(begin + i, len(self.terms) - 1)
            same = self.terms[at] == word
            made[here[same]] = at[same]
        return made

    @cached_property
    def dealt(self) -> tuple[np.uint64, np.ndarray, int]:
        """Terms by their first bits: how far a hash is shifted, the first term with these bits or -1, most terms that share them."""
        shift = np.uint64(64 - max(16, len(self.terms).bit_length() + 4))
        bits, first, times = np.unique(self.terms >> shift, return_index=True, return_counts=True)
        begins = np.full(1 << (64 - int(shift)), -1, np.int32)
        begins[bits] = first
        return shift, begins, int(times.max(initial=0))


def item_index(rows: list[tuple[int, str | None]]) -> Index:
    rows = sorted({(i, t or "") for i, t in rows if i is not None})
    word, n = words_of([t for _, t in rows]) if rows else (np.zeros(0, np.uint64), np.zeros(0, int))
    ends = np.cumsum(n)
    parts = [word[e - k : e] for e, k in zip(ends, n, strict=True)]
    some = [(i, p) for (i, _), p in zip(rows, parts, strict=True) if len(p)]
    made = Index([i for i, _ in some], [p for _, p in some], np.unique(word))
    size = np.array([len(p) for _, p in some], int)
    item, first, last = passages(word, size)
    begin = (np.cumsum(size) - size)[item]
    made.parts = item, first - begin, last - begin
    return made


def passages(word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first, last + 1) of the passages in the batch's words; a short text is one passage."""
    count = np.where(n > 0, np.maximum(1, -(-(n - PASSAGE) // STRIDE) + 1), 0)
    own = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.cumsum(n) - n
    first = begin[own] + nth * STRIDE
    return own, first, np.minimum(first + PASSAGE, (begin + n)[own])


def _cells(index: Index, texts: list[str]) -> tuple[np.ndarray, ...]:
    """Words, words per text, passages, and (passage, term, times) of the terms of the passages."""
    word, n = words_of(texts)
    own, first, last = passages(word, n)
    term = index.find(word)
    known = np.flatnonzero(term >= 0)
    a, b = np.searchsorted(known, first), np.searchsorted(known, last)
    passage = np.repeat(np.arange(len(first)), b - a)
    at = known[np.arange(len(passage)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]
    key, times = np.unique(passage * max(1, len(index.terms)) + term[at], return_counts=True)
    return word, n, own, first, last, key // max(1, len(index.terms)), key % max(1, len(index.terms)), times


def _sequences(word: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of the words of each passage, in order."""
    key = (last - first).astype(np.uint64)
    for i in range(PASSAGE):
        inside = np.flatnonzero(first + i < last)
        key[inside] = mixed(key[inside] * np.uint64(_PRIME) + word[first[inside] + i])
    return key


def _shingled(word: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` words in a row."""
    made = word[: max(0, len(word) - size + 1)].copy()
    for i in range(1, size):
        made = mixed(made * np.uint64(_PRIME) + word[i : i + len(made)])
    return made


def _runs(index: Index) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The items' shingles by length; an item with few telling words has short ones, one of few words its whole text."""
    by: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, w in enumerate(index.words):
        telling = index.telling[np.unique(index.find(w))]
        size = min(len(w), SHINGLE if telling.mean() >= WEAK else SHORT)
        by.setdefault(size, []).append((i, np.unique(_shingled(w, size))))
    made = []
    for size, parts in sorted(by.items()):
        key, item = np.concatenate([k for _, k in parts]), np.repeat([i for i, _ in parts], [len(k) for _, k in parts])
        order = np.argsort(key, kind="stable")
        made.append((size, key[order], item[order]))
    return made


def _matched(index: Index, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, item) where a shingle of the item begins in a text."""
    owner = np.repeat(np.arange(len(n)), n)
    at, items = [np.zeros(0, int)], [np.zeros(0, int)]
    for size, key, item in index.runs:
        run = _shingled(word, size)
        here = np.flatnonzero(owner[: len(run)] == owner[size - 1 :][: len(run)])
        some = np.zeros(1 << 20, bool)  # most shingles are ruled out by 20 bits
        some[key >> np.uint64(44)] = True
        here = here[some[run[here] >> np.uint64(44)]]
        a, b = np.searchsorted(key, run[here]), np.searchsorted(key, run[here], "right")
        times = b - a
        at.append(np.repeat(here, times))
        items.append(item[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(a, times)])
    return np.concatenate(at), np.concatenate(items)


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[list[str]]:
    for f in frames:
        texts = f["text"].fillna("").tolist()
        for at in range(0, len(texts), TEXTS):
            yield texts[at : at + TEXTS]


def _weighted(index: Index, passage: np.ndarray, term: np.ndarray, times: np.ndarray) -> np.ndarray:
    """TF-IDF cells, each passage of length 1."""
    value = np.log1p(times) * index.weight[term]
    size = np.sqrt(np.bincount(passage, value**2)) if len(passage) else np.zeros(0)
    return value / size[passage]


def fit(docs: DataFrame, index: Index, text: str = "text", fitted: int | None = None) -> Index:
    """Document frequencies over all different passages, then the latent space by a randomised range finder with power rounds.

    The space is that of all different passages too, or, with ``fitted``, of those of so many texts (the first by a hash).
    Every item counts as a passage, so the space holds the items' own terms.
    """
    own = docs.select(F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @frugal
    def bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        for texts in _batches(frames):
            word, _, _, first, last, passage, term, times = _cells(ix, texts)
            if not len(first):
                continue
            keys = _sequences(word, first, last)
            ends = np.searchsorted(passage, np.arange(len(first) + 1))
            raw, many = term.astype("<i4").tobytes(), times.astype(np.uint8).tobytes()
            some = np.unique(keys, return_index=True)[1]
            spans = list(zip(some.tolist(), ends[some].tolist(), ends[some + 1].tolist(), strict=True))
            yield pd.DataFrame(
                {"key": keys[some].view(np.int64), "terms": [raw[4 * a : 4 * b] for _, a, b in spans], "times": [many[a:b] for _, a, b in spans]}
            )

    @frugal
    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(index.terms) + 1, np.int64)
        for f in frames:
            total[:-1] += np.bincount(np.frombuffer(b"".join(f["terms"]), "<i4"), minlength=len(index.terms))
            total[-1] += len(f)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"term": some, "n": total[some]})

    def different(texts: DataFrame) -> DataFrame:
        with small_batches(texts.sparkSession, 8 * TEXTS):
            return cut(texts.mapInPandas(bags, "key long, terms binary, times binary").dropDuplicates(["key"]).drop("key"))

    passages_ = different(own)
    found = passages_.mapInPandas(counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(len(index.terms) + 1)
    for r in found:
        frequency[r["term"]] = r["n"]
    total, frequency = frequency[-1], frequency[:-1]
    index.telling = frequency <= max(COMMON * total, 1)
    rare = np.log((total + 1) / (frequency + 0.5))
    index.weight = np.where(index.telling, rare, np.maximum(SLIGHT * rare, LEAST))
    index.runs = _runs(index)
    cells = [np.unique(index.find(w), return_counts=True) for w in _parts(index)]
    passage = np.repeat(np.arange(len(cells)), [len(t) for t, _ in cells])
    term = np.concatenate([t for t, _ in cells]) if cells else np.zeros(0, int)
    value = _weighted(index, passage, term, np.concatenate([k for _, k in cells]) if cells else np.zeros(0, int))
    index.heads = np.searchsorted(index.parts[0], np.arange(len(index.items)))
    told = index.telling[term] if len(term) else np.zeros(0, bool)
    order = np.argsort(term[told], kind="stable")
    index.holders, index.begins = passage[told][order], np.searchsorted(term[told][order], np.arange(len(index.terms) + 1))
    index.least = np.ceil(SHARED * np.bincount(passage[told], minlength=len(cells))).astype(int)
    if fitted is not None:
        release(passages_)
        few = own.select(F.xxhash64("text").alias("_h")).distinct().orderBy("_h").limit(fitted)
        passages_ = different(own.filter(F.col("text").isNotNull()).join(F.broadcast(few), F.xxhash64("text") == F.col("_h"), "left_semi"))
    products = _products(passages_, index)
    release(passages_)
    by_part = lambda x: _times(passage, term, value, x, len(cells))
    both = lambda x: _times(term, passage, value, by_part(x), len(index.terms))
    rank = min(RANK, len(index.terms))
    rng = np.random.default_rng(6)
    basis = np.linalg.qr(rng.normal(size=(len(index.terms), min(len(index.terms), rank + EXTRA))))[0]
    for _ in range(POWER):
        basis = np.linalg.qr(_gram(products, basis) + both(basis))[0]
    small = basis.T @ (_gram(products, basis) + both(basis))
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    release(products)
    index.latent = (basis @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)
    index.queries = _unit(by_part(index.latent).astype(np.float32))
    return index


def _times(row: np.ndarray, column: np.ndarray, value: np.ndarray, dense: np.ndarray, rows: int) -> np.ndarray:
    """A sparse matrix, given by its cells, times a dense one; some thousand cells at a time."""
    made = np.zeros((rows, dense.shape[1]))
    for at in range(0, len(row), 4096):
        own = slice(at, at + 4096)
        np.add.at(made, row[own], dense[column[own]] * value[own, None])
    return made


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _products(bags: DataFrame, index: Index) -> DataFrame:
    """A' A of the weighted passages A: (term, columns, sums), one row per term. Stored.

    A task sums the products of its passages, Spark those of the tasks; there are as many tasks as the session runs at once. What
    a task holds, what is shuffled and what is stored are bounded by the terms, not by the passages.
    """
    terms, context = len(index.terms), bags.sparkSession.sparkContext
    shared, height = context.broadcast(index), max(1, SUMS // max(1, len(index.terms)))

    def rows(block: np.ndarray, term: int, column: int) -> pd.DataFrame:
        some = [(i, np.flatnonzero(r)) for i, r in enumerate(block)]
        held = [(term + i, (c + column).astype("<i4").tobytes(), block[i][c].astype("<f4").tobytes()) for i, c in some if len(c)]
        return pd.DataFrame(held, columns=["term", "columns", "sums"])

    def summer(low: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        @frugal
        def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ix, high = shared.value, min(low + height, terms)
            total = np.zeros((high - low) * terms)
            for f in frames:
                for at in range(0, len(f), TEXTS):
                    n = f["times"].iloc[at : at + TEXTS].map(len).to_numpy()
                    term = np.frombuffer(b"".join(f["terms"].iloc[at : at + TEXTS]), "<i4").astype(np.int64)
                    times = np.frombuffer(b"".join(f["times"].iloc[at : at + TEXTS]), np.uint8).astype(float)
                    value = _weighted(ix, np.repeat(np.arange(len(n)), n), term, times)
                    # each cell with itself and those after it in its passage; terms ascend there
                    one = np.flatnonzero((term >= low) & (term < high))
                    many = np.repeat(np.cumsum(n), n)[one] - one
                    two = np.arange(many.sum()) + np.repeat(one - (np.cumsum(many) - many), many)
                    one = np.repeat(one, many)
                    np.add.at(total, (term[one] - low) * terms + term[two], value[one] * value[two])
            total = total.reshape(high - low, terms)
            for at in range(low, high, TEXTS):
                yield rows(total[at - low : at - low + TEXTS], at, 0)
            total[np.arange(high - low), np.arange(low, high)] = 0
            for at in range(low, terms, TEXTS):  # the same below the diagonal
                yield rows(total[:, at : at + TEXTS].T, at, low)

        return summed

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = np.bincount(np.frombuffer(b"".join(group["columns"]), "<i4"), np.frombuffer(b"".join(group["sums"]), "<f4"), terms)
        some = np.flatnonzero(total)
        return pd.DataFrame({"term": group["term"].iloc[:1], "columns": [some.astype("<i4").tobytes()], "sums": [total[some].astype("<f4").tobytes()]})

    shape = "term int, columns binary, sums binary"
    fewer = bags.coalesce(context.defaultParallelism)
    parts = [fewer.mapInPandas(summer(low), shape) for low in range(0, max(1, terms), height)]
    return cut(reduce(DataFrame.unionAll, parts).groupBy("term").applyInPandas(added, shape))


def _gram(products: DataFrame, basis: np.ndarray) -> np.ndarray:
    """(A' A) basis from the stored products, some rows at a time."""
    shared = products.sparkSession.sparkContext.broadcast(basis)

    @frugal
    def product(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for f in frames:
            for at in range(0, len(f), TEXTS):
                part = f.iloc[at : at + TEXTS]
                strip = np.zeros((len(part), len(own)))
                for row, columns, sums in zip(strip, part["columns"], part["sums"], strict=True):
                    row[np.frombuffer(columns, "<i4")] = np.frombuffer(sums, "<f4")
                yield pd.DataFrame({"term": part["term"], "part": [x.tobytes() for x in strip @ own]})

    made = np.zeros_like(basis)
    with small_batches(products.sparkSession):  # a row holds as many sums as there are terms
        for r in products.mapInPandas(product, "term int, part binary").collect():
            made[r["term"]] = np.frombuffer(r["part"])
    return made


def common_words(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Longest common subsequence of two word sequences, of the whole item and of its last words (bit-parallel)."""

    def longest(part: np.ndarray) -> int:
        where: dict[int, int] = {}
        for i, w in enumerate(part.tolist()):
            where[w] = where.get(w, 0) | 1 << i
        full = (1 << len(part)) - 1
        row = full
        for w in text.tolist():
            hit = row & where.get(w, 0)
            row = (row + hit | row - hit) & full
        return len(part) - row.bit_count()

    return longest(item), longest(item[-max(1, round(ANSWER * len(item))) :])


def _parts(index: Index) -> list[np.ndarray]:
    return [index.words[i][a:b] for i, a, b in zip(*(x.tolist() for x in index.parts), strict=True)]


def _told(index: Index, passage: np.ndarray, term: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(passage, part) where the passage holds enough of the part's telling terms, counted from the terms' parts; every
    passage for a part without telling terms."""
    parts = len(index.parts[0])
    own = np.flatnonzero(index.telling[term])
    first, last = index.begins[term[own]], index.begins[term[own] + 1]
    times = last - first
    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
    key, held = np.unique(np.repeat(passage[own], times) * parts + index.holders[at], return_counts=True)
    enough = key[held >= index.least[key % parts]]
    free = np.flatnonzero(index.least == 0)
    if len(free):
        enough = np.concatenate([enough, (np.arange(rows)[:, None] * parts + free).reshape(-1)])
    return enough // parts, enough % parts


def _spans(rows: list[tuple[int, int, int, int, float]]) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, item, first, last + 1, cosine) with the stretches of a text and an item that overlap made one."""
    open_: tuple[int, int, int, int, float] | None = None
    for t, q, lo, hi, cosine in sorted(rows):
        if open_ and open_[:2] == (t, q) and lo <= open_[3]:
            open_ = (t, q, open_[2], max(hi, open_[3]), max(cosine, open_[4]))
        else:
            if open_:
                yield open_
            open_ = (t, q, lo, hi, cosine)
    if open_:
        yield open_


def leaks(index: Index, texts: list[str]) -> list[list[tuple[int, float, float]]]:
    """For each text its leaked items: (item, share of all its words in order, cosine of the best passage)."""
    made: list[list[tuple[int, float, float]]] = [[] for _ in texts]
    if not len(index.items):
        return made
    word, n, own, first, last, passage, term, times = _cells(index, texts)
    if not len(passage):
        return made
    value = _weighted(index, passage, term, times).astype(np.float32)
    starts = np.flatnonzero(np.diff(passage, prepend=-1))
    nth = np.cumsum(np.diff(passage, prepend=-1) > 0) - 1
    row, query = _told(index, nth, term, len(starts))
    # a shingle is in one or more passages: the one that begins last before it stands for all
    found, items = _matched(index, word, n)
    held_by = np.searchsorted(passage[starts], np.searchsorted(first, found, "right") - 1)
    # only passages that pass the counts, or hold a shingle, are taken to the latent space
    used = np.unique(np.concatenate([row, held_by]))
    if not len(used):
        return made
    ends = np.append(starts, len(passage))
    sizes = ends[used + 1] - ends[used]
    cell = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(ends[used], sizes)
    rows = _unit(np.add.reduceat(index.latent[term[cell]] * value[cell, None], np.cumsum(sizes) - sizes, axis=0))
    near = rows @ index.queries.T
    close = near[np.searchsorted(used, row), query] >= NEAR
    row, item_of = np.concatenate([row[close], held_by]), np.concatenate([index.parts[0][query[close]], items])
    pair = np.unique(row * len(index.items) + item_of)
    cosines = np.maximum.reduceat(near, index.heads, axis=1)  # of the nearest part
    begin = np.cumsum(n) - n
    best: dict[tuple[int, int], tuple[float, float]] = {}
    spans = []
    for r, q in zip((pair // len(index.items)).tolist(), (pair % len(index.items)).tolist(), strict=True):
        p, size = passage[starts[r]], len(index.words[q])
        t, reach = int(own[p]), max(STRIDE, size + max(3, size // 4))
        spans.append((t, q, int(max(begin[t], first[p] - reach)), int(min(begin[t] + n[t], last[p] + reach)), float(cosines[np.searchsorted(used, r), q])))
    for t, q, lo, hi, cosine in _spans(spans):
        key, item = (t, index.items[q]), index.words[q]
        size = len(item)
        width = size + max(3, size // 4)
        there = np.isin(word[lo:hi], item)  # a bound on any common subsequence, before it is sought
        inside = np.concatenate([[0], np.cumsum(there)])
        for a in range(0, max(1, hi - lo - width + max(1, size // 4)), max(1, size // 4)):
            b = min(a + width, hi - lo)
            if inside[b] - inside[a] < PART * size:
                continue
            whole, answer = common_words(item, word[lo + a : lo + b])
            share = whole / size
            told = answer >= ANSWER_FOUND * max(1, round(ANSWER * size))
            if (share >= WHOLE or share >= PART and told and size >= 8) and share > best.get(key, (0.0, 0.0))[0]:
                best[key] = (share, cosine)
    for (t, item), (share, cosine) in sorted(best.items()):
        made[t].append((item, share, cosine))
    return made


#: Items in a block; a larger benchmark is searched block by block, with one pass over the documents each.
BLOCK = 2000
LEAKS = "array<struct<item_id: long, share: double, cosine: double>>"


def _searcher(shared: Broadcast) -> Callable[[Column], Column]:
    @F.pandas_udf(LEAKS)
    @frugal
    def searched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.tolist()
            parts = [x for at in range(0, len(texts), TEXTS) for x in leaks(shared.value, texts[at : at + TEXTS])]
            yield pd.Series([[{"item_id": i, "share": s, "cosine": c} for i, s, c in x] for x in parts], dtype=object)

    return searched


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "leaks", item_id: str = "item_id", item_text: str = "text", fitted: int | None = None) -> DataFrame:
    """``docs`` with the leaked items of each whole text in ``into``: array of (item_id, share, cosine), empty
    where there are none (replacing a column of that name).

    Words are lower-case runs of letters and digits. NULL and empty texts leak nothing, items without id or words
    are left out, an item id with several texts is an item for each. Every row stays; empty tables give no rows or
    no leaks. No shuffle of documents.
    """
    known = benchmark.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    # a long item counts as often as it has parts
    sizes = known.select(F.ceil(F.length("t") / (8 * PASSAGE)).alias("parts")).agg(F.count("*"), F.sum(F.greatest("parts", F.lit(1)))).first()
    blocks = max(1, -(-max(sizes[0], sizes[1] or 0) // BLOCK))
    made = docs.drop(into) if into != text else docs
    found = F.expr(f"cast(array() as {LEAKS})")
    for k in range(blocks):
        rows = known.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).collect() if blocks > 1 else known.collect()
        index = item_index([tuple(r) for r in rows])
        if not index.items:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(fit(docs, index, text, fitted))

        found = F.concat(found, _searcher(shared)(F.coalesce(F.col(text), F.lit(""))))
    return made.withColumn(into, found)
