"""Best-fit packing by a configuration linear program over the histogram of piece lengths.

Tasks tokenise whole texts and cut them into pieces; only the histogram (at most ``capacity`` counts) reaches the
driver. There multiplicative weights price the lengths, a knapsack by dynamic programming finds the best
configuration for the prices, and configurations are taken a whole number of times until the rest is small enough
for best fit. What goes back to Spark is a table of slots per length: a piece finds its sequence from its rank.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.lineage import cut
from furrow.llm.batches import frugal

END = 2
CAPACITY = 1024
#: Texts that are looked up at once, and word parts that a worker remembers at most.
TEXTS, REMEMBERED = 256, 600_000
#: Share of the possible times a configuration is taken, rate of the prices, slack of a configuration, pieces left to best fit.
STEP, RATE, NEAR, REST = 0.34, 3.0, 0.02, 400


#: Not word by word: double spaces, a space between other white space, white space other than spaces and line breaks.
_WHOLE = re.compile(r"  |\s (?!\S)|[^\S \n]")


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Ids:
    """Byte-level BPE ids of texts, remembered per word.

    The vocabulary's pattern never joins a word to the space after it, so a text whose white space is single spaces and
    plain line breaks may be encoded word by word (a word with the space before it), where no space is inside a run of
    white space. Unknown words are encoded together and parted by their lengths in bytes, those that begin or end with
    white space one by one.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = dict(zip([*map(chr, plain), *(chr(256 + i) for i in range(256 - len(plain)))], [*plain, *(b for b in range(256) if b not in plain)], strict=True))
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.coder = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for word, i in ranks.items():
            self.sizes[i] = len(word)
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        for w in [w for w in words if w != w.strip() or not w]:
            self.known[w] = np.array(self.coder.encode_ordinary(" " + w), "<u4").tobytes()
        words = [w for w in words if w and w == w.strip()]
        if not words:
            return
        ids = np.array(self.coder.encode_ordinary(" " + " ".join(words)), "<u4")
        ends = np.cumsum(self.sizes[ids])
        at = np.searchsorted(ends, np.cumsum([len(w.encode()) + 1 for w in words])) + 1
        raw, begin = ids.tobytes(), 0
        for w, end in zip(words, (4 * at).tolist(), strict=True):
            self.known[w] = raw[begin:end]
            begin = end

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [None if _WHOLE.search(t) else t.split(" ") for t in texts]
        wanted = set().union(*(s[1:] for s in split if s))
        new = wanted - self.known.keys()
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = wanted
            self._learn(list(new))
        whole = lambda t: np.array(self.coder.encode_ordinary(t), "<u4").tobytes()
        return [whole(t) if s is None else whole(s[0]) + b"".join(map(self.known.__getitem__, s[1:])) for t, s in zip(texts, split, strict=True)]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (bytes), ids_crc32; ``run`` and ``k``: the task, and the piece's rank there
    among those of its length. No shuffle. Only texts over ``capacity`` are cut, the first piece is the short one."""

    @frugal
    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, run, seen = Ids(vocabulary), TaskContext.get().partitionId(), Counter()
        tail = np.array([END], "<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.iloc[at : at + TEXTS]
                rows = []
                for doc, raw in zip(part["doc_id"], ids(part["text"].fillna("").tolist()), strict=True):
                    raw += tail
                    n, start = len(raw) // 4, 0
                    for p in range(-(-n // capacity)):
                        end = n - (-(-n // capacity) - 1 - p) * capacity
                        own, size = raw[4 * start : 4 * end], end - start
                        rows.append((doc, p, start, size, own, zlib.crc32(own), run, seen[size]))
                        seen[size] += 1
                        start = end
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids", "ids_crc32", "run", "k"])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return named.mapInPandas(cut_up, "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, run int, k long")


def _knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value for each capacity and the last length taken (0: none)."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(value)
    worth = value[lengths]
    reach = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := reach[c]:
            gain = best[c - lengths[:n]] + worth[:n]
            j = int(gain.argmax())
            if gain[j] > best[c]:
                best[c], last[c] = gain[j], lengths[j]
    return best, last


def _filled(last: np.ndarray, c: int) -> list[int]:
    """The lengths of the best filling of capacity ``c``."""
    made = []
    while c > 0:
        if last[c]:
            made.append(int(last[c]))
        c -= int(last[c]) or 1
    return made


def configurations(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(configuration: pieces per length, how often) that hold every piece of the histogram.

    Multiplicative weights for the covering program: a length's price falls with the share of its demand that is
    covered. One knapsack prices, for every length, the best configuration that holds it; those within ``NEAR`` of
    the best are taken, each ``STEP`` of the times its scarcest length allows, at least once. The last ``REST``
    pieces go by best fit decreasing. Rounds depend on the number of lengths and the logarithm of the counts.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, k in histogram.items():
        left[n] = k
    taken: list[tuple[dict[int, int], int]] = []
    if left[capacity]:
        taken.append(({capacity: 1}, int(left[capacity])))
        left[capacity] = 0
    demand = np.maximum(left, 1).astype(float)
    price = np.zeros(capacity + 1)
    size = np.arange(capacity + 1)
    while left.sum() > REST:
        value = np.where(left > 0, size * np.exp(RATE * price), 0.0)
        best, last = _knapsack(value, capacity)
        lengths = np.flatnonzero(left)[::-1]
        total = value[lengths] + best[capacity - lengths]
        order = np.argsort(-total, kind="stable")
        for i, n in enumerate(lengths[order[total[order] >= (1 - NEAR) * total.max()]].tolist()):
            config = Counter([n, *_filled(last, capacity - n)])
            if i and any(k > left[m] for m, k in config.items()):
                continue
            config = {m: min(k, int(left[m])) for m, k in config.items() if left[m]}
            times = max(1, int(STEP * min(left[m] // k for m, k in config.items())))
            taken.append((config, times))
            for m, k in config.items():
                left[m] -= k * times
                price[m] -= k * times / demand[m]
    room: list[list] = []
    for n in range(capacity, 0, -1):
        for _ in range(int(left[n])):
            fit = min((r for r in room if r[0] >= n), key=lambda r: r[0], default=None)
            if fit is None:
                room.append(fit := [capacity, Counter()])
            fit[0] -= n
            fit[1][n] += 1
    return taken + [(dict(r[1]), 1) for r in room]


def _slots(taken: list[tuple[dict[int, int], int]]) -> list[tuple]:
    """(length, first rank, pieces a sequence, first sequence, offset): where the pieces of a length go, by rank."""
    used, base, rows = Counter(), 0, []
    for config, times in taken:
        offset = 0
        for n in sorted(config, reverse=True):
            rows.append((n, used[n], config[n], base, offset))
            used[n] += config[n] * times
            offset += n * config[n]
        base += times
    return rows


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (where kept), ids_crc32, sequence_id, offset.

    A NULL or empty text is one piece, the end mark. Repeated rows are packed each on their own. An empty
    table gives no rows; further columns are dropped. Pieces are stored once; ranks within a length come from the
    counts per task, so no length meets in one task.
    """
    made = pieces(docs, vocabulary or public_vocabulary(), capacity, id_col, text)
    stored = cut(made if keep_ids else made.drop("ids"))
    counts = cut(stored.groupBy("length", "run").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = _slots(configurations(histogram, capacity))
    spark = docs.sparkSession
    slots = spark.createDataFrame(rows, "length long, first long, each long, base long, at long")
    by_length = slots.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "each", "base", "at"))).alias("slots"))
    before = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # few rows: lengths x tasks, so pieces of a frequent length stay spread over the tasks that made them
    ranked = stored.join(starts.join(by_length, "length"), ["length", "run"]).withColumn("rank", F.col("before") + F.col("k"))
    slot = F.element_at(F.filter("slots", lambda s: s["first"] <= F.col("rank")), -1)
    placed = ranked.withColumn("slot", slot).withColumn("nth", F.col("rank") - F.col("slot.first"))
    return placed.select(
        "doc_id", "piece", "start", "length", *(["ids"] if keep_ids else []), "ids_crc32",
        (F.col("slot.base") + F.expr("nth div slot.each")).alias("sequence_id"),
        (F.col("slot.at") + F.col("nth") % F.col("slot.each") * F.col("length")).alias("offset"),
    )
