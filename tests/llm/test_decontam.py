import random

import numpy as np
import pytest
from conftest import SMALL

from furrow.llm import decontam
from furrow.llm.queries import QUERIES

DOCS = "doc_id long, text string, leaks string, item_id string"


@pytest.mark.parametrize("seed", range(4))
def test_common_subsequence(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))

    def longest(x, y):
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if p == q else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    tail = a[-max(1, round(decontam.ANSWER * len(a))) :]
    assert decontam.common_words(np.array(a), np.array(b)) == (longest(a, b), longest(tail, b))


def world(seed=1):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(3000)]
    say = lambda n: [rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.4 else rng.choice(words) for _ in range(n)]
    items = {i: say(rng.choice([15, 25, 40, 59])) for i in range(40)}
    docs, want = [], set()
    for d in range(200):
        text = say(rng.randrange(5, 400))
        if d % 4 == 0:
            i = rng.randrange(40)
            put = list(items[i])
            if d % 8 == 0:  # a paraphrase: one word in eight is another
                put = [w if k % 8 else "other%d" % k for k, w in enumerate(put)]
            at = rng.randrange(len(text))
            text[at:at] = put
            want.add((d, i))
        docs.append((d, (", " if d % 3 else " ").join(text).upper() if d % 5 == 0 else " ".join(text), None, None))
    return docs, [(i, " ".join(w)) for i, w in items.items()], want


def found(spark, docs, items, **more):
    made = decontam.with_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), **more)
    assert made.columns == ["doc_id", "text", "item_id", "leaks"]
    return made.collect()


def test_passages_and_paraphrases(spark):
    docs, items, want = world()
    got = found(spark, docs, items)
    assert {(r.doc_id, x.item_id) for r in got for x in r.leaks} == want and len(got) == len(docs)
    assert {(r.doc_id, x.item_id) for r in found(spark, docs, items, fitted=20) for x in r.leaks} == want


def test_blocks_of_a_large_benchmark(spark, monkeypatch):
    docs, items, want = world(2)
    monkeypatch.setattr(decontam, "BLOCK", 15)
    assert {(r.doc_id, x.item_id) for r in found(spark, docs, items) for x in r.leaks} == want


def test_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, None, "", ""), (1, None, "", ""), (None, item, None, None), (2, "", "", ""), (3, "x " * 60_000 + item, "", "")]
    items = [(7, item), (7, item), (7, "another text of the same item here now"), (None, "no id"), (8, None), (9, ""), (10, "...")]
    assert [[x.item_id for x in r.leaks] for r in found(spark, docs, items)] == [[], [], [7], [], [7]]
    assert all(not r.leaks for r in found(spark, docs, []))
    assert found(spark, [], items) == []


def test_query_finds_every_passage_of_a_table(spark):
    docs = {r.doc_id: (r.text or "").lower() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = {r.item_id: r.text.lower() for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_decontaminate"](spark, SMALL).collect()}
    assert got >= {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert got


@pytest.mark.parametrize("copied", [False, True])
def test_item_in_a_third_of_the_rows(spark, copied):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(3000)]
    item = " ".join(rng.sample(words, 30))
    other = [" ".join(rng.sample(words, 30)) for _ in range(5)]
    docs = [(d, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 200))), None, None) for d in range(240)]
    leak = "see " + item + " end"
    docs = [(d, leak if copied else t[: len(t) // 2].rsplit(" ", 1)[0] + " " + leak, a, b) if d % 3 == 0 else (d, t, a, b) for d, t, a, b in docs]
    got = found(spark, docs, [(1, item), *((2 + i, t) for i, t in enumerate(other))])
    assert {(r.doc_id, x.item_id) for r in got for x in r.leaks} == {(d, 1) for d in range(0, 240, 3)}


@pytest.mark.parametrize("size", [180, 300, 1000])
def test_long_items(spark, size):
    rng = random.Random(size)
    words = ["w%d" % i for i in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = {i: say(size) for i in range(4)}
    put = {0: items[0], 1: [w if k % 8 else "other%d" % k for k, w in enumerate(items[1])], 2: items[2][: size // 3]}
    docs = [(d, " ".join(say(70 * d) + put.get(d, []) + say(90)), None, None) for d in range(12)]
    got = found(spark, docs, [(i, " ".join(w)) for i, w in items.items()])
    assert {(r.doc_id, x.item_id): round(x.share, 3) >= 0.87 for r in got for x in r.leaks} == {(0, 0): True, (1, 1): True}


def test_latent_space_is_that_of_all_different_passages(spark, monkeypatch):
    docs, items, _ = world(5)
    index = decontam.item_index(items)
    seen = []
    first = decontam._gram
    monkeypatch.setattr(decontam, "_gram", lambda products, basis: seen.append(first(products, np.eye(len(index.terms)))) or first(products, basis))
    decontam.fit(spark.createDataFrame(docs + docs[:50], DOCS), index)  # copies add no passages
    rows = {}
    for _, text, *_ in docs:
        word, n = decontam.words_of([text])
        for _, a, b in zip(*(x.tolist() for x in decontam.passages(word, n)), strict=True):
            rows[tuple(word[a:b].tolist())] = np.bincount(index.find(word[a:b])[index.find(word[a:b]) >= 0], minlength=len(index.terms))
    cells = np.log1p(np.array(list(rows.values()))) * index.weight
    cells = cells / np.maximum(np.linalg.norm(cells, axis=1, keepdims=True), 1e-12)
    np.testing.assert_allclose(seen[0], cells.T @ cells, rtol=1e-5, atol=1e-6)
    monkeypatch.setattr(decontam, "SUMS", 7 * len(index.terms))  # by seven terms a pass
    again = decontam.item_index(items)
    decontam.fit(spark.createDataFrame(docs, DOCS), again)
    np.testing.assert_allclose(seen[3], seen[0], rtol=1e-5, atol=1e-6)
