"""Suffix-array dedup: every byte covered by a 400-byte string that also starts elsewhere, exactly.

Each 400-byte string owns one seed, the window of ``SEED`` bytes with the least hash in it, so equal strings own equal
seeds at equal distances. The strings of one seed occurrence make one stretch of text. Stretches of equal seed and
equal content are counted by Spark without their text. Of seeds with different stretches one text per stretch goes
to shards; a shard puts aside the stretches that agree with no other one far enough around their seed, sorts the suffixes
of the rest (Larsson-Sadakane refinement), takes common prefixes in text order (Kasai) and marks strings that occur twice. Seeds with very many stretches are dealt over several shards; across these no suffixes
are merged: two 64-bit hashes of each string are counted, as only whether a string occurs twice is asked.

Passages counted in words go the same way: a text becomes the hashes of its words, four bytes each, so that a passage
of some words is a string of four times as many bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from furrow.lineage import cut, release
from furrow.llm.batches import frugal, small_batches
from furrow.llm.minhash import mixed, node

LENGTH, SEED = 400, 48
#: Stretches in a shard, stretches of one seed that may share a shard, string keys in a merge task, bytes scanned at once.
SHARD, CROWD, MERGE, CHUNK = 400, 150, 40_000, 1 << 19
#: Windows around a seed of which one is common to any two stretches that share a string.
PARTS = 8
#: Bytes of a word's hash, words of a seed where passages are counted in words.
CODE, SEED_WORDS = 4, 6
_PRIMES = (0x100000001B3, 0x9E3779B97F4A7C15)
_BYTES = [np.random.default_rng(s).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1) for s in (11, 12)]
_MASK = np.uint64((1 << 23) - 1)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of a prime and of its inverse modulo 2 ** 64, kept for the next call."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        made = [np.full(n + n // 4, factor, np.uint64) for factor in (_PRIMES[which], pow(_PRIMES[which], -1, 2**64))]
        for table in made:
            table[0] = 1
        _POWERS[which] = np.cumprod(made[0]), np.cumprod(made[1])
    up, down = _POWERS[which]
    return up[:n], down[:n]


class Rolling:
    """Hashes of substrings of a buffer from one prefix sum: (sum of byte codes x prime ** place) / prime ** start."""

    def __init__(self, data: np.ndarray, which: int):
        up, self.down = _powers(which, len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[which][data] * up[:-1], out=self.total[1:])

    def __call__(self, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        return mixed((self.total[ends] - self.total[starts]) * self.down[starts])


def stretches(raws: list[bytes], length: int = LENGTH, seed: int = SEED) -> pd.DataFrame:
    """(text, lo, hi, gap, seed, content): strings of text number ``text`` that start in lo..hi own one seed
    occurrence, at lo + gap."""
    sizes = np.array([len(r) for r in raws], np.int64)
    data = np.frombuffer(b"".join(raws), np.uint8)
    none = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("text", "lo", "hi", "gap", "seed", "content")})
    if len(data) < length:
        return none
    first = Rolling(data, 0)
    hashed = first(slice(len(data) - seed + 1), slice(seed, None))  # every window, without lists of places
    least = (hashed & ~_MASK) | np.arange(len(hashed), dtype=np.uint64)
    span, width = length - seed + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    begin = np.cumsum(sizes) - sizes
    whole = np.zeros(len(least) + 1, np.int64)  # up where a text's strings begin, down where they end
    held = sizes >= length
    np.add.at(whole, begin[held], 1)
    np.add.at(whole, (begin + sizes - length + 1)[held], -1)
    starts = np.flatnonzero(np.cumsum(whole[:-1]))
    if not len(starts):
        return none
    chosen = (least[starts] & _MASK).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1) | (whole[starts[1:]] != 0)
    lo_at = np.flatnonzero(new)
    hi_at = np.append(lo_at[1:], len(starts)) - 1
    lo, hi = starts[lo_at], starts[hi_at]
    own = np.searchsorted(begin, lo, side="right") - 1  # of texts that begin together all but the last are empty
    content = Rolling(data, 1)(lo, hi + length) ^ mixed((chosen[lo_at] - lo).astype(np.uint64), 3)
    return pd.DataFrame({"text": own, "lo": lo - begin[own], "hi": hi - begin[own], "gap": chosen[lo_at] - lo, "seed": hashed[chosen[lo_at]].view(np.int64), "content": content.view(np.int64)})


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane: sort by eight bytes, then by the ranks of the halves, only where groups are still tied.

    ``data`` ends with eight bytes that occur nowhere else, so all suffixes differ.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1)).copy().view(">u8").reshape(-1).astype(np.uint64)
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's rank is the place of its first row
    rank[order] = heads
    places = np.flatnonzero(~(new & np.append(new[1:], True)))
    h = 8
    while len(places):
        rows = order[places]
        after = np.where(rows + h < n, rank[np.minimum(rows + h, n - 1)] + 1, 0)
        key = rank[rows] * (n + 1) + after
        by = np.argsort(key)
        rows, key = rows[by], key[by]
        order[places] = rows
        new = np.ones(len(rows), bool)
        new[1:] = key[1:] != key[:-1]
        rank[rows] = places[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        places = places[~(new & np.append(new[1:], True))]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Kasai: the common prefix of each suffix with the one before it in the order, by rank.

    In text order a prefix is one byte shorter than its predecessor's wherever the bytes before agree, so only the
    other places are compared, eight bytes at a time.
    """
    n = len(data)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    fresh = (before < 1) | (at < 1)
    fresh[~fresh] = data[at[~fresh] - 1] != data[before[~fresh] - 1]
    i = np.flatnonzero(fresh & (before >= 0))
    j, same = before[i], np.zeros(len(i), np.int64)
    words = np.lib.stride_tricks.as_strided(padded := np.concatenate([data, np.zeros(16, np.uint8)]), (n + 8, 8), (1, 1))
    live = np.arange(len(i))
    while len(live):
        x, y = np.minimum(i[live] + same[live], n), np.minimum(j[live] + same[live], n)
        a, b = (np.ascontiguousarray(words[p]).view("<u8").reshape(-1) for p in (x, y))
        differ = a ^ b
        low = differ & (~differ + np.uint64(1))
        step = np.where(differ == 0, 8, (np.log2(np.maximum(low, 1).astype(float)) // 8).astype(np.int64))
        same[live] += step
        live = live[(differ == 0) & (np.maximum(x, y) < n)]
    del padded
    value = np.full(n, -1)
    value[i] = np.minimum(same, n - np.maximum(i, j))
    source = np.maximum.accumulate(np.where(fresh, at, 0))
    inherited = np.where(value[source] >= 0, value[source] - (at - source), 0)
    return np.maximum(inherited, 0)[order]


def twice(texts: list[bytes], length: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text the starts whose ``length`` bytes also start at another place of these texts, and one key of
    128 bits for each such string start in text order (all starts)."""
    marks = [b"\xff" + bytes((i // 100**k) % 100 + 1 for k in range(6, -1, -1)) for i in range(len(texts))]
    data = np.frombuffer(b"".join(t + m for t, m in zip(texts, marks, strict=True)), np.uint8)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes + 8) - sizes - 8
    starts = np.concatenate([b + np.arange(max(0, s - length + 1)) for b, s in zip(begin, sizes, strict=True)])
    order = suffix_array(data)
    group = np.cumsum(common_prefixes(data, order) < length)
    valid = np.zeros(len(data), bool)
    valid[starts] = True
    counted = np.bincount(group[valid[order]], minlength=len(data) + 1)
    repeated = np.zeros(len(data), bool)
    repeated[order] = counted[group] > 1
    keys = np.column_stack([Rolling(data, k)(starts, starts + length) for k in (0, 1)])
    return [np.flatnonzero(repeated[b : b + max(0, s - length + 1)]) for b, s in zip(begin, sizes, strict=True)], keys


def alike(texts: list[bytes], gaps: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Whether each stretch, its seed ``gaps`` bytes from its start, may share a string with another one of these.

    A string goes beyond its seed by ``length - seed`` bytes on both sides together, so two equal ones hold one of
    ``PARTS`` windows around the seed that lack a ``PARTS``-th of these bytes. A stretch none of whose windows is met
    again shares no string.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    first = Rolling(np.frombuffer(b"".join(texts), np.uint8), 0)
    at = np.cumsum(sizes) - sizes + gaps
    found = np.zeros(len(texts), bool)
    for k in range(PARTS):
        left, right = (length - seed) * k // PARTS, (length - seed) * (PARTS - 1 - k) // PARTS
        inside = np.flatnonzero((gaps >= left) & (sizes - gaps >= seed + right))
        _, slot, times = np.unique(first(at[inside] - left, at[inside] + seed + right), return_inverse=True, return_counts=True)
        found[inside[times[slot.reshape(-1)] > 1]] = True
    return found


def _runs(at: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of neighbouring numbers."""
    if not len(at):
        return []
    breaks = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.append(0, breaks + 1)].tolist(), at[np.append(breaks, len(at) - 1)].tolist(), strict=True))


def _scan(docs: DataFrame, length: int, seed: int) -> DataFrame:
    @frugal
    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes, raws, size = [], [], 0
            for key, raw in zip(batch["_node"], batch["raw"], strict=True):
                for lo in range(0, max(1, len(raw) - length + 1), CHUNK):  # a chunk owns the strings that start in it
                    part = bytes(raw[lo : lo + CHUNK + length - 1])
                    nodes.append((key, lo))
                    raws.append(part)
                    size += len(part)
                    if size > CHUNK:
                        yield found(nodes, raws)
                        nodes, raws, size = [], [], 0
            if raws:
                yield found(nodes, raws)

    def found(nodes: list[tuple[bytes, int]], raws: list[bytes]) -> pd.DataFrame:
        made = stretches(raws, length, seed)
        shift = np.array([lo for _, lo in nodes])[made["text"]]
        return pd.DataFrame({"node": [nodes[i][0] for i in made["text"]], "lo": made["lo"] + shift, "hi": made["hi"] + shift, "gap": made["gap"], "seed": made["seed"], "content": made["content"]})

    own = docs.select("_node", F.col("_text").cast("binary").alias("raw")).filter(F.octet_length("_text") >= length)
    return own.mapInPandas(scanned, "node binary, lo int, hi int, gap int, seed long, content long")


def spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(node, spans): for every text with removed bytes its digest and the sorted disjoint removed runs (start, end).

    ``docs`` has _id, _node (digest of the text) and _text (never NULL).
    """
    with small_batches(docs.sparkSession):
        found = cut(_scan(docs, length, seed))
    kinds = cut(found.groupBy("seed", "content").agg(F.count("*").alias("times"), F.min(F.struct("node", "lo", "hi", "gap")).alias("one")))
    crowd = kinds.groupBy("seed").agg(F.count("*").alias("kinds"))
    copied = found.join(kinds.filter("times > 1").select("seed", "content"), ["seed", "content"]).select("node", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    unlike = cut(kinds.join(crowd.filter("kinds > 1"), "seed").select("seed", "content", "times", "kinds", "one.*"))
    shards = max(1, -(-unlike.count() // SHARD))
    salts = F.ceil(F.col("kinds") / CROWD)
    dealt = unlike.withColumn("shard", F.pmod(F.xxhash64("seed", F.pmod(F.xxhash64("content"), salts)), F.lit(shards)))
    wanted = dealt.groupBy("node").agg(F.collect_list(F.struct("shard", "lo", "hi", "gap", "times", "seed", "kinds")).alias("wanted"))
    first = docs.groupBy("_node").agg(F.min("_id").alias("_id"))
    texts = docs.join(wanted.join(first, wanted.node == first._node).drop("_node"), (F.col("_node") == F.col("node")) & (docs._id == first._id))
    cell = F.explode("wanted")
    rows = texts.select("node", F.col("_text").cast("binary").alias("raw"), cell.alias("w")).select(
        "node", "w.*", F.expr(f"substring(raw, w.lo + 1, w.hi - w.lo + {length})").alias("raw")
    )

    @frugal
    def sorted_shard(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(["node", "lo"]).sort_values(["node", "lo"])  # a row of the table may be repeated
        # all stretches of a seed are here, but for crowds, whose strings also meet those of other shards
        part = part[(part["kinds"] > CROWD) | alike([bytes(x) for x in part["raw"]], part["gap"].to_numpy(np.int64), length, seed)]
        if part.empty:
            return pd.DataFrame([], columns=columns).astype({c: "Int64" for c in columns if c not in ("node", "k0", "k1")})
        starts, keys = twice([bytes(x) for x in part["raw"]], length)
        made, at = [], 0
        keep = []
        for (n, lo, hi, times), own in zip(part[["node", "lo", "hi", "times"]].itertuples(index=False), starts, strict=True):
            if times == 1:
                made += [(n, a + lo, b + lo + length, *[None] * 6) for a, b in _runs(own)]
            keep.append((at, at + hi - lo + 1))
            at += hi - lo + 1
        for place, (n, lo, gap, times, its, kinds) in zip(keep, part[["node", "lo", "gap", "times", "seed", "kinds"]].itertuples(index=False), strict=True):
            if kinds > CROWD:
                own = keys[slice(*place)]
                made.append((n, lo, None, own[:, 0].tobytes(), own[:, 1].tobytes(), gap, times, its, kinds))
        return pd.DataFrame(made, columns=columns).astype({c: "Int64" for c in columns if c not in ("node", "k0", "k1")})

    shape = "node binary, start int, end int, k0 binary, k1 binary, gap int, times long, seed long, kinds long"
    columns = [c.split()[0] for c in shape.split(", ")]
    local = cut(rows.groupBy("shard").applyInPandas(sorted_shard, shape))
    crowds = local.filter("k0 IS NOT NULL")
    span = length - seed + 1

    @frugal
    def parted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The string keys of each stretch, cut by merge task.

        Equal strings lie equally far before equal seeds, so a task takes a seed's strings of some distances: about
        ``MERGE`` keys. Where even one distance has more, its keys are dealt by their values too.
        """
        for b in batches:
            made = []
            for n, lo, k0, k1, gap, times, its, kinds in b[["node", "start", "k0", "k1", "gap", "times", "seed", "kinds"]].itertuples(index=False):
                keys = np.frombuffer(k0, np.uint64), np.frombuffer(k1, np.uint64)
                away = gap - np.arange(len(keys[0]))
                blocks = min(span, -(-kinds * span // 2 // MERGE))
                salts = max(1, -(-kinds // MERGE))
                cell = away * blocks // span * salts + (keys[0] % np.uint64(salts)).astype(np.int64)
                bounds = np.flatnonzero(np.diff(cell, prepend=cell[0] + 1))
                for i, j in zip(bounds.tolist(), [*bounds[1:].tolist(), len(cell)], strict=True):
                    made.append((its, int(cell[i]), n, lo + i, keys[0][i:j].tobytes(), keys[1][i:j].tobytes(), times == 1))
            yield pd.DataFrame(made, columns=["seed", "cell", "node", "start", "k0", "k1", "one"])

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        """String keys of several shards; a key met twice marks its places."""
        k0, k1 = (np.concatenate([np.frombuffer(x, np.uint64) for x in part[c]]) for c in ("k0", "k1"))
        slot = np.unique(k0, return_inverse=True)[1].reshape(-1)
        _, inverse, times = np.unique(slot.astype(np.uint64) * np.uint64(_PRIMES[1]) ^ k1, return_inverse=True, return_counts=True)
        twice_ = times[inverse.reshape(-1)] > 1
        made, at = [], 0
        for n, start, raw, one in part[["node", "start", "k0", "one"]].itertuples(index=False):
            size = len(raw) // 8
            if one:
                made += [(n, start + a, start + b + length) for a, b in _runs(np.flatnonzero(twice_[at : at + size]))]
            at += size
        return pd.DataFrame(made, columns=["node", "start", "end"])

    pieces = "seed long, cell long, node binary, start int, k0 binary, k1 binary, one boolean"
    crossed = crowds.mapInPandas(parted, pieces).groupBy("seed", "cell").applyInPandas(merged, "node binary, start int, end int")
    removed = copied.distinct().union(local.filter("k0 IS NULL").select("node", "start", "end")).union(crossed)

    # start and end in one long, so that a text's runs are an array of numbers
    listed = removed.groupBy("node").agg(F.collect_set(F.shiftleft(F.col("start").cast("long"), 32) + F.col("end")).alias("runs"))

    @F.pandas_udf("array<long>")
    def grown(runs: pd.Series) -> pd.Series:
        return runs.map(_union)

    made = cut(listed.select("node", _unpacked(grown("runs")).alias("spans")))
    for old in (found, kinds, unlike, local):
        release(old)
    return made


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words: runs of bytes that are no ASCII white space."""
    inside = np.concatenate([[False], (data != 32) & ((data < 9) | (data > 13)), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _codes(raws: list[bytes]) -> list[bytes]:
    """Each text as the hashes of its words."""
    data = np.frombuffer(b" ".join(raws), np.uint8)
    start, end = _words(data)
    code = np.zeros(len(start), "<u4")
    at = 0
    while at < len(start):  # some ``CHUNK`` of text at once
        to = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK)))
        lo = start[at]
        code[at:to] = Rolling(data[lo : end[to - 1]], 0)(start[at:to] - lo, end[at:to] - lo) >> np.uint64(64 - 8 * CODE)
        at = to
    first = np.cumsum([0, *(len(r) + 1 for r in raws)])
    bounds = np.searchsorted(start, first).tolist()
    return [code[i:j].tobytes() for i, j in zip(bounds, bounds[1:], strict=False)]


@F.pandas_udf(BinaryType())
@frugal
def _coded(raws: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in raws:
        yield pd.Series(_codes([bytes(x) for x in batch]), index=batch.index, dtype=object)


@F.pandas_udf(ArrayType(LongType()))
@frugal
def _with_words(raws: pd.Series, runs: pd.Series, more: pd.Series) -> pd.Series:
    """Runs of bytes, and runs of word hashes as the bytes of their words; a word not wholly in a run stays."""
    made = []
    for raw, own, coded in zip(raws, runs, more, strict=True):
        if raw is None:
            made.append(None)
            continue
        start, end = _words(np.frombuffer(raw, np.uint8))
        coded = np.asarray(coded, np.int64)
        first, last = -(-(coded >> 32) // CODE), (coded & (2**32 - 1)) // CODE - 1
        made.append(_union(np.concatenate([np.asarray(own, np.int64), (start[first] << 32) | end[last]])))
    return pd.Series(made, index=raws.index, dtype=object)


def _packed(spans: str | Column) -> Column:
    """Runs as numbers, see ``_union``."""
    return F.transform(spans, lambda x: F.shiftleft(x["start"].cast("long"), 32) + x["end"])


def _unpacked(runs: Column) -> Column:
    return F.transform(runs, lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("start"), x.bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("end")))


def _union(runs: np.ndarray) -> np.ndarray:
    """Disjoint runs, overlapping and touching ones joined; a run is start << 32 | end."""
    runs = np.sort(np.asarray(runs, np.int64))
    start, end = runs >> 32, np.maximum.accumulate(runs & (2**32 - 1))
    new = np.ones(len(runs), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return (start[at] << 32) | end[np.append(at[1:], len(runs)) - 1]


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text: str = "text", words: int | None = None, apart: bool = False) -> DataFrame:
    """``docs`` with ``raw`` (the text's UTF-8 bytes), ``spans`` (removed runs: start, end, in bytes) and
    ``remaining`` (the other bytes), replacing columns of these names.

    A byte goes if some string of ``length`` bytes over it also starts at another place, in the same or another text,
    judged on the texts as they come. With ``words`` a passage of so many words that occurs at another place goes too, however
    few its bytes and whatever the white space between its words; ``apart``: it stays, and ``passages`` (runs like
    ``spans``) tells where such ones are. A NULL text counts as empty; texts shorter than
    ``length`` lose no string of it; equal texts and repeated rows are copies of each other and go whole. Every row stays,
    an empty table gives no rows.
    """
    own = docs.drop("raw", "spans", "remaining", *["passages"] * (words is not None and apart)).withColumns(
        {"_text": F.coalesce(F.col(text), F.lit("")), "_node": node(F.col(text)), "_id": F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))}
    )
    raw = F.col("_text").cast("binary")
    found = spans(own.select("_id", "_node", "_text"), length, seed)
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    if words:
        with small_batches(docs.sparkSession):
            coded = cut(own.select("_id", "_node", _coded(raw).alias("_text")))
        more = spans(coded, words * CODE, SEED_WORDS * CODE).withColumnRenamed("spans", "_more")
        release(coded)
        found = found.join(more, "node", "full")
    made = own.join(found.withColumnRenamed("node", "_node"), "_node", "left").withColumn("spans", F.coalesce("spans", none))
    if words:
        into, own_runs = ("passages", none) if apart else ("spans", F.col("spans"))
        both = _with_words(F.when(F.col("_more").isNotNull(), raw), _packed(own_runs), _packed("_more"))
        made = made.withColumn(into, F.when(F.col("_more").isNull(), own_runs).otherwise(_unpacked(both))).drop("_more")
    wide = made.withColumn("raw", raw)
    place = F.expr("transform(spans, (s, i) -> substring(raw, if(i = 0, 0, spans[i - 1].end) + 1, s.start - if(i = 0, 0, spans[i - 1].end)))")
    tail = F.expr("substring(raw, if(size(spans) = 0, 0, element_at(spans, -1).end) + 1)")
    joined = F.concat(F.aggregate(place, F.lit(b""), lambda a, x: F.concat(a, x)), tail)
    return wide.withColumn("remaining", F.when(F.size("spans") == 0, F.col("raw")).otherwise(joined)).drop("_text", "_node", "_id")
