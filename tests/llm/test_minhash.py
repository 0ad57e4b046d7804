import random
from collections import Counter
from math import log

import numpy as np
import pytest
from conftest import SMALL

from furrow.llm import links, minhash
from furrow.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, class_id string, kept string"


def weighted(text):
    w = (text or "").lower().encode().split()
    n = min(5, len(w))
    return {s: 1 + log(k) for s, k in Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)).items()} if n else {}


def alike(x, y):
    """The probability Jaccard index by its definition."""
    ids = x.keys() | y.keys()
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in ids) for i in x.keys() & y.keys())


def brute(rows):
    texts = sorted({t or "" for _, t in rows})
    sets, up = {t: weighted(t) for t in texts}, {t: t for t in texts}

    def top(t):
        while up[t] != t:
            t = up[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            few = min(len(sets[a]), len(sets[b]))
            if few and top(a) != top(b) and len(sets[a].keys() & sets[b].keys()) > few / 2 and alike(sets[a], sets[b]) >= 0.8 - 1e-9:
                up[top(a)] = top(b)
    least = {}
    for d, t in rows:
        least[top(t or "")] = min(least.get(top(t or ""), 2**63), 2**63 if d is None else d)
    return Counter((d, None if least[top(t or "")] == 2**63 else least[top(t or "")]) for d, t in rows)


def test_similarity_and_signatures():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.95):
        ids = rng.choice(2**62, 400, replace=False).astype(np.uint64)
        cut = int(400 * (1 - share) / 2)
        x, y = np.sort(ids[: 400 - cut]), np.sort(ids[cut:])
        wx, wy = rng.uniform(1, 3, len(x)), rng.uniform(1, 3, len(y))
        exact = alike(dict(zip(x, wx)), dict(zip(y, wy)))
        assert abs(minhash.similarity((x, wx), (y, wy)) - exact) < 1e-9
        own = np.repeat([0, 1], [len(x), len(y)])
        sig = minhash.signatures(own, np.concatenate([x, y]), np.concatenate([wx, wy]), 2, size=4096)
        assert abs((sig[0] == sig[1]).mean() - exact) < 0.03


def test_classes_are_brute_force_classes(spark):
    rng = random.Random(7)
    base = [[rng.choice(["the", "of"]) if rng.random() < 0.3 else "w%d" % rng.randrange(4000) for _ in range(rng.randrange(20, 90))] for _ in range(25)]
    rows = []
    for i in range(420):
        words = list(base[int(len(base) * rng.random() ** 2)])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = "x%d" % rng.randrange(9)
        rows.append((i, " ".join(words)))
    rows += [(900 + i, rows[0][1]) for i in range(60)]
    rows += [(None, rows[5][1]), (None, "only null ids here at all"), (990, None), (991, ""), (992, " \n"), (993, "two words"), (994, "Two  words"), (995, "words two"), (996, "junk " * 4000), (996, "junk " * 4000)]
    got = minhash.with_class(spark.createDataFrame([(d, t, "", "") for d, t in rows], SCHEMA)).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == brute(rows)
    kept = Counter(r.class_id for r in got if r.kept)
    assert set(kept) == {r.class_id for r in got} and {k for k, n in kept.items() if n > 1} <= {996}


def test_crowd_of_unlike_pairs(spark):
    body = ["b%d" % i for i in range(104)]  # unlike texts share 100 of 128 shingles, a pair 102 of 126
    rows = [(i, " ".join([*body, *("c%d" % (i // 2 * 2 + j) for j in range(2)), *("u%d_%d" % (i, j) for j in range(12))])) for i in range(600)]
    got = minhash.with_class(spark.createDataFrame([(d, t, "", "") for d, t in rows], SCHEMA)).collect()
    assert sum(r.class_id != r.doc_id // 2 * 2 for r in got) == 0 and len(got) == 600


def test_query_on_a_table_and_empty(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = QUERIES["op5_near_dedup"](spark, SMALL).collect()
    texts = sorted({t for _, t in rows}, key=lambda t: len(t))
    near = {(r.doc_id): r.class_id for r in got}
    assert len(got) == len(rows) and len(texts) >= len(set(near.values()))
    none = spark.createDataFrame([], SCHEMA)
    assert minhash.with_class(none).collect() == [] and minhash.representatives(none).collect() == []


def test_query_on_its_whole_table(spark):
    """All texts of the table by brute force: pairs that share enough shingles are found by an inverted list."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in QUERIES["op5_near_dedup"](spark, SMALL).collect()}
    assert Counter(got.items()) == brute(rows)


def crowd(n, words=100):
    """Variants of one text; a word more or less changed, so that some pairs reach 0.8 and most do not."""
    rng = random.Random(4)
    base, rows = ["w%d" % i for i in range(words)], []
    for i in range(n):
        own = list(base)
        for _ in range(rng.choice([1, 2, 2, 3, 3, 4])):
            own[rng.randrange(words)] = "c%d" % rng.randrange(60)
        rows.append((i, " ".join(own)))
    return rows


def test_crowd_of_variants_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 40)
    rows = crowd(110, 60)
    got = minhash.with_class(spark.createDataFrame([(d, t, "", "") for d, t in rows], SCHEMA)).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == brute(rows)


def test_blocks_make_fewer_rows_than_pairs(spark, monkeypatch):
    """Rows that meet in blocks grow with members times blocks of the other side, not with pairs."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(minhash, "BLOCK", 500)
    made = []
    for n in (1000, 2000):
        rest = spark.range(n).select(F.lit(1).cast("long").alias("key"), F.col("id").cast("string").cast("binary").alias("node"), F.when(F.col("id") < n // 2, F.lit("main")).otherwise(F.col("id").cast("string")).cast("binary").alias("label"))
        one = [np.array([5], np.uint64).tobytes(), np.array([1.0]).tobytes()]
        sets = rest.select("node", F.lit(bytearray(one[0])).alias("shingles"), F.lit(bytearray(one[1])).alias("weights"))
        linked = minhash._blocked(rest, sets).collect()
        made.append(len(linked))
        assert n // 2 <= len(linked) <= n * -(-n // 500)
    assert made[1] < 1000 * 1999 / 100  # of so many pairs


@pytest.mark.parametrize("pairs", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, 3), (200, 201), (None, 5)]])
def test_components(spark, pairs):
    up = {}
    for a, b in pairs:
        if a is not None and a != b:
            group = up.get(a, {a}) | up.get(b, {b})
            up |= dict.fromkeys(group, group)
    got = links.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node for r in got} == set(up) and len(got) == len(up)
    groups = {}
    for r in got:
        groups.setdefault(r.label, set()).add(r.node)
    assert all(up[n] == g for g in groups.values() for n in g)
