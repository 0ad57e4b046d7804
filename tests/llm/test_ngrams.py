import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from conftest import SMALL
from furrow.llm import ngrams, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


def brute(texts, learned):
    """(tokens, known, base, score with exact lookups of quantised counts) of each text."""
    ones, twos, starts = Counter(), Counter(), 0
    for t in learned:
        own = tokens(t)
        ones.update(own)
        twos.update(zip(["<"] + own[:-1], own))
        starts += 1
    mass = sum(ones.values()) + 0.5 * (len(ones) + 1)
    value = lambda c: float(ngrams.VALUES[int(ngrams.level_of(np.array([c]))[0])])
    out = []
    for t in texts:
        own, score = tokens(t), 0.0
        for a, b in zip(["<"] + own[:-1], own):
            prior, pair = value(starts if a == "<" else ones[a]), value(twos[a, b])
            lower = ngrams.CONCENTRATION * (value(ones[b]) + 0.5) / mass
            score += math.log10((min(pair, prior) + lower) / (prior + ngrams.CONCENTRATION))
        out.append((len(own), sum(ones[w] > 0 for w in own), sum(math.log10((ones[w] + 0.5) / mass) for w in own), score))
    return sum(ones.values()), out


ODD = ["", None, "The the THE the", "a b  c\x1cd\n\t e", "É é A", "x " * 400 + "y", " lead and trail ", "The the THE the", "z" * 900, "\x85   one"]


@pytest.mark.parametrize("segment", [64, 1 << 20])
@pytest.mark.parametrize("limit", [ngrams.FILTER_BYTES, 0])
@pytest.mark.parametrize("frequent", [1, 1 << 20])
def test_against_brute_force(spark, segment, limit, frequent):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(ODD * 3)], "doc_id long, text string, score string, keys string")
    model = ngrams.train(docs.filter("doc_id < 25"), filter_bytes=limit, segment=segment)
    assert (model.filter is None) == (limit == 0)
    got = sorted(ngrams.score(docs, model, ["doc_id"], words_=frequent).collect())
    total, want = brute(ODD * 3, (ODD * 3)[:25])
    for row, (n, known, base, score) in zip(got, want, strict=True):
        assert (row.n_tokens, row.n_known, row.train_tokens) == (n, known, total)
        # a probe may find one level too many, which a text that repeats one word feels in every token
        assert row.base_score == pytest.approx(base, abs=1e-9) and row.score == pytest.approx(score, abs=1e-9 if limit == 0 else 0.5 + 0.2 * n)


def test_empty_tables_and_a_model_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = ngrams.train(empty)
    assert ngrams.score(empty, model, ["doc_id"]).collect() == []
    row = ngrams.score(spark.createDataFrame([(None, "a b")], empty.schema), model, ["doc_id"]).first()
    assert tuple(row)[:4] == (None, 3, 0, 0) and row.base_score == 0 and row.score == pytest.approx(0)


def test_pieces_do_not_cut_words(monkeypatch):
    monkeypatch.setattr(ngrams, "PIECE", 16)
    monkeypatch.setattr(ngrams, "_UP", ngrams._UP[:17])
    monkeypatch.setattr(ngrams, "_DOWN", ngrams._DOWN[:17])
    texts = ["one two three four five six seven", "a" * 50 + " b", "short", "", "tail " + "q" * 40, "x y " * 9]
    keys, counts = ngrams.words(texts)
    assert counts.tolist() == [7, 2, 1, 0, 2, 18]
    monkeypatch.undo()
    assert sorted(keys.tolist()) == sorted(ngrams.words(texts)[0].tolist())


def test_filter_never_reads_less_and_seldom_more():
    rng = np.random.default_rng(1)
    keys, counts = rng.integers(0, 1 << 63, 60_000).astype(np.uint64), rng.zipf(1.6, 60_000)
    bits = ngrams.filled(keys[:50_000], ngrams.level_of(counts[:50_000]))
    own = ngrams.Filter(bits, np.zeros(1, np.int64), np.array([len(bits)]))
    found = own.level(keys)
    assert (found[:50_000] >= ngrams.level_of(counts[:50_000])).all()
    assert (found[:50_000] > ngrams.level_of(counts[:50_000])).mean() < 0.03 and (found[50_000:] > 0).mean() < 0.03


def test_query_on_its_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    held = {r.doc_id: crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows}
    total, want = brute([r.text for r in rows], [r.text for r in rows if not held[r.doc_id]])
    got = {r.doc_id: r for r in queries.op12_lm_score(spark, SMALL).collect()}
    assert len(got) == len(rows)
    gain = base_sum = 0.0
    for r, (n, known, base, score) in zip(rows, want, strict=True):
        g = got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[r.doc_id], n, known, total)
        assert g.base_score == pytest.approx(base, rel=1e-9)
        assert abs(g.score - score) <= 0.05 * n + 3
        if g.held_out:
            gain, base_sum = gain + g.score, base_sum + g.base_score
    assert gain > base_sum  # bigrams help on texts that were not learned


def test_scores_do_not_depend_on_where_the_filter_lies(spark):
    rng = np.random.default_rng(4)
    texts = ODD + [" ".join(f"w{i}" for i in rng.zipf(1.3, 400) % 5000) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = []
    for limit in (ngrams.FILTER_BYTES, 0):
        model = ngrams.train(docs.filter("doc_id % 3 > 0"), broadcast=limit, segment=4096)
        assert (model.filter is None) == (limit == 0)
        scores.append({r.doc_id: r.score for r in ngrams.score(docs, model, ["doc_id"]).collect()})
    assert scores[0] == pytest.approx(scores[1], rel=1e-12)


def test_texts_that_ask_the_segments_are_not_taken_apart_into_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = ODD + [" ".join(f"w{i}" for i in rng.zipf(1.3, 300) % 5000) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngrams, "RUN", 20_000)
    scores = []
    for limit in (ngrams.FILTER_BYTES, 0):
        model = ngrams.train(docs.filter("doc_id % 3 > 0"), broadcast=limit, segment=1 << 14)
        made = ngrams.score(docs, model, ["doc_id"], words_=1 << 30)
        scores.append({r.doc_id: r.score for r in made.collect()})
        # tokens do not meet the filter's answers as rows: what is joined is the rare words, their sums and the scores
        assert made._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= (3 if limit == 0 else 2)
    assert scores[0] == pytest.approx(scores[1], rel=1e-12)


def test_squeezed_keys_come_back():
    for n in (0, 1, 1000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, np.uint64))
        assert (ngrams.unsqueezed(ngrams.squeezed(keys)) == keys).all()
