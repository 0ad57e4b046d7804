"""Every stage on planted cases; the whole on a table."""

import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from furrow.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    item, passage = say(30), say(90)
    base = say(200)
    words = base.split()
    rows = {i: say(120) for i in range(30)}
    rows |= {100: base, 101: base, 102: " ".join([*words[:90], "changed", *words[91:]]), 103: None, 104: "", 105: None}
    rows |= {110: say(40) + " " + passage + " " + say(40), 111: say(50) + " " + passage}
    rows |= {120: say(60) + " " + item.upper() + " " + say(60), 121: say(20) + " " + " ".join(w for k, w in enumerate(item.split()) if k % 9 != 4)}
    return rows, item, passage


def test_stages_on_planted_cases(spark, planted, tmp_path):
    rows, item, passage = planted
    spark.createDataFrame([(5, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows.items()] + [(7, rows[7], None, "s", None)], SCHEMA)
    stage = dict(corpus_pipeline.STAGES)
    alike = stage["toxicity"](spark, docs, str(tmp_path))  # nothing labelled: nothing is toxic
    assert alike.columns == docs.columns and alike.count() == docs.count()
    near = stage["near_dedup"](spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(rows) - {101, 102, 104, 105})
    repeats = stage["suffix_dedup"](spark, near, str(tmp_path))
    got = texts(repeats)
    assert passage[50:-50] not in got[110] + got[111] and got[110].split()[:39] == rows[110].split()[:39]
    assert {i: t for i, t in got.items() if i not in (110, 111)} == {i: rows[i] for i in got if i not in (110, 111)}
    assert all(r.n_chars == len(r.text) for r in repeats.filter("doc_id IN (110, 111)").collect())
    clean = stage["decontaminate"](spark, repeats, str(tmp_path))
    assert set(got) - set(texts(clean)) == {120, 121}
    out = stage["pack"](spark, clean, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == set(texts(clean))
    for name, fn in corpus_pipeline.STAGES:
        assert fn(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_passages_of_over_50_short_words_go(spark, tmp_path):
    rng = random.Random(8)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passages = {n: say(n) for n in (40, 51, 59)}
    assert all(len(p) < 400 for p in passages.values())
    rows = {(n, i): say(60 + 10 * i) + " " + p + "\n" + say(80) for n, p in passages.items() for i in range(2)}
    docs = spark.createDataFrame([(100 * n + i, t, None, "s", len(t)) for (n, i), t in rows.items()], SCHEMA)
    got = texts(dict(corpus_pipeline.STAGES)["suffix_dedup"](spark, docs, str(tmp_path)))
    for (n, i), t in rows.items():
        before, after = t.split(passages[n])
        assert got[100 * n + i] == (t if n == 40 else before + after), n


def test_run_on_a_table(spark):
    out = corpus_pipeline.run(spark, SMALL)
    per = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert per and all(r.n == r.end <= 1024 for r in per)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_runs_on_a_table(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_columns_of_any_name_come_back(spark, planted, tmp_path):
    rows, item, _ = planted
    spark.createDataFrame([(5, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ["raw", "spans", "remaining", "leaks", "_node", "_id", "_text", "class_id"]
    docs = spark.createDataFrame([(i, t, *(f"{c}{i}" for c in names)) for i, t in rows.items()], ["doc_id", "text", *names])
    for name in ("near_dedup", "suffix_dedup", "decontaminate"):
        made = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
        assert made.columns == docs.columns
        assert all(r[c] == f"{c}{r.doc_id}" for r in made.collect() for c in names), name
