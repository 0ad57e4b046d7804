"""Toxicity, quality and rules: defined results at the edges, held-out accuracy, brute force for the counts."""

import re
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from furrow.llm import quality, rules, textstats, toxicity
from furrow.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, score string, kept string"
ODD = [(1, "", "x", "y"), (1, "", "x", "y"), (2, None, None, None), (None, "é" * 300_000, "", ""), (3, "a b c " * 20_000, "", ""), (4, "good words here", "", "")]


@pytest.fixture(scope="module")
def medium():
    return "/root/testdata/sf0.1"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@pytest.mark.parametrize("text", [None, "", "a", "a a a a", "x y z x y z", "l\n\nl\n \nl", "# $ % b \x1c c\x85d", "a b c d a b c\n" * 5, "éé \U0001f600|"])
def test_counts_are_brute_force(text):
    assert textstats.counts(text)[:5] == brute(text)


def test_rules_query_counts_on_a_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in QUERIES["op8_rules"](spark, SMALL).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == brute(docs[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)


def walk(column, split, path, row, node=0):
    if column[node] < 0:
        return path[node]
    return walk(column, split, path, row, 2 * node + (2 if row[column[node]] >= split[node] else 1))


def test_verdict_is_a_plain_walk_of_every_tree(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    forest, texts = rules.train(docs.select("doc_id", "text"), labels), {r.doc_id: r.text or "" for r in docs.collect()}
    usual = 2 * (np.log(rules.SAMPLE - 1) + np.euler_gamma) - 2 * (rules.SAMPLE - 1) / rules.SAMPLE
    verdicts = set()
    for r in QUERIES["op8_rules"](spark, SMALL).collect():
        text, words, chars = texts[r.doc_id], max(r.n_words, 1), max(r.word_chars, 1)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
        many = [np.log1p(10 * (n / words)) for n in (r.n_symbols, text.count("!"), text.count("|"))]
        row = [r.word_chars / words, *many, len(re.findall("[A-Z]", text)) / chars, r.n_dup_lines / max(lines, 1), r.n_repeat_words / words]
        paths = [walk(*tree, row) for tree in zip(forest.column, forest.split, forest.path, strict=True)]
        anomaly = 2 ** (-sum(paths) / len(paths) / usual)
        assert r.kept == (not r.base_failed and anomaly <= forest.threshold + 1e-12)
        verdicts.add((r.base_failed, r.kept))
    assert (False, True) in verdicts


def test_isolation_parts_junk_and_keeps_good(spark, medium):
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    made = QUERIES["op8_rules"](spark, medium).join(labels, "doc_id").filter(~F.col("base_failed"))
    share = {r.quality: r.kept for r in made.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.99 and share[0] < 0.1


@pytest.mark.parametrize("name,label,least", [("op2_toxicity", "toxic", 0.98), ("op3_quality", "quality", 0.98)])
def test_held_out_accuracy(spark, medium, name, label, least):
    docs = spark.read.parquet(f"{medium}/documents.parquet").count()
    got = QUERIES[name](spark, medium).join(spark.read.parquet(f"{medium}/labels.parquet"), "doc_id", "left").toPandas()
    assert len(got) == docs and got["score"].between(0, 1).all() and ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
    held = got[got["held_out"] & got[label].notna()]
    assert (held["predicted"] == held[label]).mean() > least


def test_odd_rows_and_empty_tables(spark):
    df, none = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([(4, 1, 0), (1, 0, 1), (None, 1, 1), (3, None, None), (77, 1, 1)], "doc_id long, quality int, toxic int")
    for have in (labels, labels.limit(0)):
        tox, good, forest = toxicity.train(df, have), quality.train(df, have), rules.train(df, have)
        for made in (toxicity.score(df, tox, into="score"), quality.score(df, good, into="score")):
            rows = made.collect()
            assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert toxicity.score(none, tox).collect() == [] and quality.score(none, good).collect() == [] and rules.apply(none, forest).collect() == []
        rows = rules.apply(df, forest).collect()
        assert len(rows) == len(ODD) and all(r.base_failed and not r.kept for r in rows if not r.text)


def test_swaps():
    assert "a muslim," not in toxicity.swapped("a muslim, here") and len(toxicity.swapped("a muslim, here")) == 5
    assert toxicity.swapped("nothing") == []


def test_counterfactual_penalty_frees_identity_terms():
    """In the labelled rows one group's name goes with abuse; neutral mentions must not score as toxic."""
    rng = np.random.default_rng(1)
    plain = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(1200):
        words = rng.choice(plain, 30).tolist()
        toxic = i % 4 == 0
        if toxic:
            words[3] = "scum"
            words[9] = "muslim" if i % 8 else "filler"
        elif i % 8 == 1:
            words[9] = "christian"
        texts.append(" ".join(words))
        labels.append(float(toxic))
    neutral = [" ".join([*rng.choice(plain, 29), "muslim"]) for _ in range(200)]
    with_, without = toxicity.fit(texts, np.array(labels)), toxicity.fit(texts, np.array(labels), penalty=0.0)
    assert (with_.score(neutral) >= 0.5).mean() < 0.02
    assert with_.raw(neutral).mean() < without.raw(neutral).mean() - 1
    assert ((with_.score(texts) >= 0.5) == np.array(labels)).mean() > 0.97


def test_isotonic_rises():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=500)
    x, y = quality.isotonic(raw, (raw + rng.normal(size=500) > 0).astype(float))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and 0 < y.min() and y.max() < 1
