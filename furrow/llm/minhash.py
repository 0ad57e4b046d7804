"""Near-duplicates by ProbMinHash of weighted word shingles, banding and exact verification.

A shingle is five words, its weight 1 + ln(times it occurs), so the similarity is the probability Jaccard index of
weighted sets (the plain Jaccard index where nothing repeats). Every shingle emits arrivals of a Poisson process
with its weight as rate; a component keeps the shingle of its first arrival, and a shingle stops when its next
arrival comes after the last first arrival. Exact copies are one node from the start. In each band bucket members
are compared with leaders, the member with the most company first, so no bucket is expanded into all its pairs.
What leaders leave apart in a large bucket is compared in blocks: some hundred members outside the bucket's main class with
some hundred members, by products of incidence matrices, and only links that join classes come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.lineage import cut, release
from furrow.llm.batches import frugal, small_batches
from furrow.llm.links import components

WORDS, SIMILAR = 5, 0.8
#: Two texts of similarity 0.8 share no band with probability (1 - 0.8 ** ROWS) ** BANDS, 3 in a million.
BANDS, ROWS = 24, 4
#: Buckets up to this size are compared pair by pair; later rounds of leaders for what a bucket's leaders left over,
#: before what is still apart is compared in blocks of so many members, so many shingles at once.
SMALL, ROUNDS, BLOCK, WIDTH = 6, 3, 384, 4096
TEXTS = 256
#: Powers in a table.
STEP = 1 << 12

_MIX = np.uint64(0x9E3779B97F4A7C15)
_PRIME = 0x100000001B3
_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x + np.uint64(salt * 0x632BE59BD9B4E019 % 2**64)) * _MIX
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers modulo 2 ** 64 in two short tables: that of i is the product of place i // STEP and place i % STEP, below n."""
    made = []
    for factor, size in ((pow(base, STEP, 2**64), -(-n // STEP)), (base, STEP)):
        table = np.full(size, factor, np.uint64)
        table[:1] = 1
        made.append(np.cumprod(table))
    return made[0], made[1]


def word_hashes(texts: list[str], space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every lower-case word and the words per text; ``space`` marks the bytes between words."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(raw) + b"\n"
    letter = np.frombuffer(b"\0" + data.translate((~space).tobytes()), bool)
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = edge[::2], edge[1::2]
    many, few = _powers(_PRIME, len(data))
    code = np.zeros((len(many), STEP), np.uint64)
    code.reshape(-1)[: len(data)] = _BYTE.take(np.frombuffer(data, np.uint8))
    code *= few
    code *= many[:, None]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code.reshape(-1)[: len(data)], out=total[1:])
    many, few = _powers(pow(_PRIME, -1, 2**64), len(data))
    made = mixed((total[ends] - total[starts]) * (many[starts // STEP] * few[starts % STEP]))
    words = np.diff(np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw])), prepend=0)
    return made, words


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, weight) of the distinct shingles, by text and hash.

    A text of fewer than five words is one shingle of all its words, a text without words has none.
    """
    word, n = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), n)
    short = (n > 0) & (n < WORDS)
    if len(word) >= WORDS:
        made = word[: len(word) - WORDS + 1].copy()
        for i in range(1, WORDS):
            made = made * np.uint64(_PRIME) + word[i : len(word) - WORDS + 1 + i]
        whole = owner[: len(made)] == owner[WORDS - 1 :]
        made, own = mixed(made[whole]), owner[: len(whole)][whole]
    else:
        made, own = word[:0], owner[:0]
    if short.any():
        first = np.cumsum(n) - n
        extra = [mixed(np.array([sum(int(w) * _PRIME**j for j, w in enumerate(word[first[i] : first[i] + n[i]])) % 2**64], np.uint64), int(n[i]))[0] for i in np.flatnonzero(short)]
        made, own = np.concatenate([made, np.array(extra, np.uint64)]), np.concatenate([own, np.flatnonzero(short)])
    order = np.lexsort((made, own))
    made, own = made[order], own[order]
    new = np.ones(len(made), bool)
    new[1:] = (made[1:] != made[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(made)))
    return own[at], made[at], 1 + np.log(times)


def signatures(own: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, size: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash: texts x size shingle hashes; texts without shingles get zeros."""
    first = np.full(texts * size, np.inf)
    last = np.full(texts, np.inf)
    arrival = np.zeros(len(shingle))
    active, points, r = np.arange(len(shingle)), [], 0
    while len(active):
        r += 1
        chance = mixed(shingle[active], 2 * r)
        arrival[active] -= np.log(((chance >> np.uint64(11)).astype(float) + 1) / 2**53) / weight[active]
        active = active[arrival[active] <= last[own[active]]]
        slot = own[active] * size + (mixed(shingle[active], 2 * r + 1) % np.uint64(size)).astype(np.int64)
        x = arrival[active]
        np.minimum.at(first, slot, x)
        points.append((slot, x, active))
        last = first.reshape(texts, size).max(axis=1)
        active = active[x <= last[own[active]]]
    made = np.zeros(texts * size, np.uint64)
    if points:
        slot, x, element = (np.concatenate(c) for c in zip(*points, strict=True))
        order = np.argsort(-x, kind="stable")
        made[slot[order]] = shingle[element[order]]  # the earliest arrival is written last
    return made.reshape(texts, size)


def band_keys(texts: list[str]) -> list[np.ndarray | None]:
    """One hash per band and text; None for texts without words."""
    own, shingle, weight = shingles(texts)
    sig = signatures(own, shingle, weight, len(texts)).reshape(len(texts), BANDS, ROWS)
    key = np.zeros((len(texts), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mixed(key * np.uint64(_PRIME) + sig[:, :, i], i + 1)
    some = np.bincount(own, minlength=len(texts)) > 0
    return [k.view(np.int64) if s else None for k, s in zip(key, some, strict=True)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard index of two (sorted hashes, weights): the sum over shared shingles i of
    1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    shared, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    x, y = a[1][i], b[1][j]
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    below, above = np.cumsum(x), y.sum() - np.cumsum(y)
    end = np.searchsorted(ratio, ratio, "right") - 1
    return float((1 / ((below[end] + only_a) / x + (above[end] + only_b) / y)).sum())


def node(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _read(shingles: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of a stored set; no weights stand for ones."""
    hashes = np.frombuffer(shingles, np.uint64)
    return hashes, np.frombuffer(weights, np.float64) if len(weights) else np.ones(len(hashes))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""

    @F.pandas_udf("double")
    @frugal
    def similar(xs: pd.Series, xw: pd.Series, ys: pd.Series, yw: pd.Series) -> pd.Series:
        return pd.Series([similarity(_read(a, b), _read(c, d)) for a, b, c, d in zip(xs, xw, ys, yw, strict=True)], dtype=float)

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("xs"), F.col("weights").alias("xw"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("ys"), F.col("weights").alias("yw"))
    both = pairs.join(right, "b").join(left, "a")
    return both.withColumn("s", similar("xs", "xw", "ys", "yw")).filter(F.col("s") >= SIMILAR - 1e-9).select("a", "b")


def _overlaps(shingle: list[np.ndarray], weight: list[np.ndarray], queries: int) -> tuple[np.ndarray, np.ndarray]:
    """Weight of what each of the first ``queries`` sets shares with each set, by its own weights and by the other's."""
    sizes = [len(x) for x in shingle]
    known, at, held = np.unique(np.concatenate(shingle), return_inverse=True, return_counts=True)
    column = np.cumsum(held > 1) - 1  # a shingle of one set is shared with none
    row, value = np.repeat(np.arange(len(shingle)), sizes), np.concatenate(weight)
    some = held[at] > 1
    row, at, value = row[some], column[at[some]], value[some].astype(np.float32)
    own, other = (np.zeros((queries, len(shingle)), np.float32) for _ in range(2))
    order = np.argsort(at, kind="stable")
    row, at, value = row[order], at[order], value[order]
    plain = bool((value == 1).all())
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, WIDTH):
        a, b = np.searchsorted(at, (first, first + WIDTH))
        there = np.zeros((len(shingle), WIDTH), np.float32)
        there[row[a:b], at[a:b] - first] = 1
        if plain:
            own += there[:queries] @ there.T
            continue
        heavy = np.zeros_like(there)
        heavy[row[a:b], at[a:b] - first] = value[a:b]
        own += heavy[:queries] @ there.T
        other += there[:queries] @ heavy.T
    return own, own if plain else other


def linked_classes(label: np.ndarray, query: np.ndarray, shingle: list[np.ndarray], weight: list[np.ndarray]) -> list[tuple]:
    """Pairs of labels that a link between a query and any other member joins, enough of them to join all that belong together.

    A similarity is at most the share of either weight that is shared; where no shingle repeats it follows from the shared
    weight. Exact similarities are taken only of pairs that can reach the threshold and whose labels are still apart.
    """
    order = np.argsort(~query, kind="stable")
    label, shingle, weight, n = label[order], [shingle[i] for i in order], [weight[i] for i in order], int(query.sum())
    own, other = _overlaps(shingle, weight, n)
    total = np.array([w.sum() for w in weight])
    plain = np.array([bool((w == 1).all()) for w in weight])
    some = np.minimum(own / total[:n, None], other / total)
    some = np.where(plain[:n, None] & plain, own / np.maximum(total[:n, None] + total - own, 1e-9), some)
    up = {x: x for x in set(label.tolist())}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    made = []
    for i, j in zip(*(x.tolist() for x in np.nonzero((some >= SIMILAR - 1e-4) & (label[:n, None] != label))), strict=True):
        a, b = top(label[i]), top(label[j])
        if a != b and similarity((shingle[i], weight[i]), (shingle[j], weight[j])) >= SIMILAR - 1e-9:
            up[a] = b
            made.append((label[i], label[j]))
    return made


def _blocked(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): labels joined by links inside the buckets of ``rest`` (key, node, label; each bucket has several labels).

    In a bucket all members outside its largest class meet all members, block by block: a task has at most some ``BLOCK``
    of each, and a member's set goes to as many tasks as the other side has blocks. A pair with both ends in the largest class is a
    link already.
    """
    by_label = rest.groupBy("key", "label").agg(F.count("*").alias("c"))
    sizes = by_label.groupBy("key").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("main"))
    ways = lambda c: F.ceil(c / F.lit(BLOCK)).cast("int")
    placed = rest.join(sizes.select("key", F.col("main.label").alias("main"), ways(F.col("m")).alias("all"), ways(F.col("m") - F.col("main.c")).alias("few")), "key")
    part = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    asked = placed.filter("label <> main").select(
        "key", "node", "label", F.lit(True).alias("query"), part("few", 1).alias("q"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("t")
    )
    there = placed.select("key", "node", "label", F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("q"), part("all", 2).alias("t"))

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        shingle, weight = zip(*map(_read, rows["shingles"], rows["weights"]), strict=True)
        names, label = np.unique(np.array([bytes(x).hex() for x in rows["label"]]), return_inverse=True)
        made = linked_classes(label.reshape(-1), rows["query"].to_numpy(bool), list(shingle), list(weight))
        ends = [[bytes.fromhex(str(names[x])) for x in side] for side in (zip(*made, strict=True) if made else ((), ()))]
        return pd.DataFrame({"a": ends[0], "b": ends[1]})

    met = asked.unionByName(there).join(sets, "node")
    return met.groupBy("key", "q", "t").applyInPandas(compared, "a binary, b binary")


def _sets(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """Shingles and weights of the wanted nodes."""

    @frugal
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.iloc[at : at + TEXTS]
                own, shingle, weight = shingles(part["text"].tolist())
                ends = np.searchsorted(own, np.arange(len(part) + 1))
                cuts = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
                yield pd.DataFrame({"node": part["node"], "shingles": [shingle[a:b].tobytes() for a, b in cuts], "weights": [b"" if (weight[a:b] == 1).all() else weight[a:b].tobytes() for a, b in cuts]})

    own = docs.select(F.col("_node").alias("node"), "_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    # of equal texts the one with the least id is read; rows that repeat it too are joined away below
    first = own.join(wanted.select("node", F.col("id").alias("_id")), ["node", "_id"], "left_semi")
    return first.mapInPandas(made, "node binary, shingles binary, weights binary").dropDuplicates(["node"])


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, label, id): for every different text its class and the least doc_id with that text.

    ``node`` is the text's digest, ``label`` one digest of its class.
    """
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text), node(F.col(text)).alias("_node"))

    @F.pandas_udf("array<long>")
    @frugal
    def keys(texts: pd.Series) -> pd.Series:
        return pd.Series([k for at in range(0, len(texts), TEXTS) for k in band_keys(texts.iloc[at : at + TEXTS].tolist())], dtype=object)

    raw = own.withColumn("keys", keys(F.coalesce(F.col(text), F.lit("")))).select("_node", "_id", "keys")
    with small_batches(docs.sparkSession):
        nodes = cut(raw.groupBy(F.col("_node").alias("node")).agg(F.min(F.coalesce("_id", F.lit(2**63 - 1))).alias("id"), F.first("keys").alias("keys")))
    members = nodes.select("node", "id", F.explode("keys").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(members.join(sizes, "key"))
    company = shared.groupBy("node").agg(F.sum("n").alias("company"))
    seats = cut(shared.join(company, "node"))
    release(shared)
    wanted = seats.select("node", "id").distinct()
    ided = own.withColumn("_id", F.coalesce("_id", F.lit(2**63 - 1)))
    with small_batches(docs.sparkSession):
        sets = cut(_sets(ided, wanted, text))

    def pairs_of(members: DataFrame, leaders: list[Column]) -> DataFrame:
        chosen = members.groupBy("key").agg(F.array(*leaders).alias("leaders"))
        met = members.select("key", "node").join(chosen, "key").select("node", F.explode("leaders").alias("leader"))
        return met.filter("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))

    popular = F.max(F.struct("company", "node"))["node"]
    spread = F.struct(F.xxhash64("key", "node").alias("h"), F.col("node"))
    found = pairs_of(seats, [popular, F.min(spread)["node"], F.max(spread)["node"]])
    few = seats.filter(F.col("n") <= SMALL).select("key", "node")
    each = few.alias("l").join(few.alias("r"), F.expr("l.key = r.key AND l.node < r.node")).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
    tried = cut(found.union(each).distinct())
    links = cut(_verified(tried, sets))
    labels = components(links)
    for _ in range(ROUNDS):
        labelled = seats.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        apart = labelled.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.max(F.struct("company", "node", "label"))["label"].alias("main")).filter("l0 <> l1")
        rest = labelled.join(apart, "key").filter("label <> main").select("key", "node", "company")
        new = cut(pairs_of(rest, [popular, F.min(spread)["node"]]).distinct().join(tried, ["a", "b"], "left_anti"))
        if not new.limit(1).count():
            break
        old, tried = tried, cut(tried.union(new))
        release(old)
        # the labels stand for the links found before
        old, labels = labels, components(_verified(new, sets).union(labels.select(F.col("label").alias("a"), F.col("node").alias("b"))))
        release(old)
        release(new)
    labelled = seats.filter(F.col("n") > SMALL).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = labelled.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("key")
    rest = cut(labelled.join(apart, "key").select("key", "node", "label"))
    if rest.limit(1).count():
        old, labels = labels, components(_blocked(rest, sets).union(labels.select(F.col("label").alias("a"), F.col("node").alias("b"))))
        release(old)
    for stored in (seats, sets, tried, links, rest):
        release(stored)
    return nodes.select("node", "id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _placed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``docs`` with _node, _least and _best: the least id of the class and the text that has it."""
    found = cut(classes(docs, id_col, text))
    least = found.groupBy("label").agg(F.min(F.struct("id", "node")).alias("least"))
    placed = found.join(least, "label").select(F.col("node").alias("_node"), F.col("least.id").alias("_least"), F.col("least.node").alias("_best"))
    return docs.withColumn("_node", node(F.col(text))).join(placed, "_node")


def _chosen(id_col: str) -> Column:
    return (F.col("_node") == F.col("_best")) & (F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)) == F.col("_least"))


def with_class(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``class_id``, the least doc_id of its class, and ``kept`` (replacing columns of these names).

    A class is what links of similarity 0.8 or more hold together; equal texts are always one class. NULL and
    empty texts are equal and belong together, as do texts of fewer than five words only with the same words.
    ``kept`` marks one document of each class, that with the least id (NULL ids come last and give a NULL class id);
    rows that repeat its id and text are all marked. Every row stays, an empty table gives no rows.
    """
    made = _placed(docs.drop("class_id", "kept"), id_col, text)
    return made.withColumn("class_id", F.nullif("_least", F.lit(2**63 - 1))).withColumn("kept", _chosen(id_col)).drop("_node", "_least", "_best")


def representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``docs`` with one row of each class, of the least id; of rows that repeat id and text any one."""
    return _placed(docs, id_col, text).filter(_chosen(id_col)).dropDuplicates(["_node"]).select(*(F.col(f"`{c}`") for c in docs.columns))
