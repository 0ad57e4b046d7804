import math
import time
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from conftest import table
from furrow import lineage
from furrow.operators import bayes, corpus, descent, evaluation, kernels, neural
from furrow.plans import classifier


def test_clean_order(spark):
    keep = "Abstract: " + "É" * 201 + "#tail#more"
    rows = [(1, keep), (2, "a" * 200), (3, None), (4, "b" * 150 + "#" + "c" * 300), (5, "Abstract: Abstract: " + "d" * 201)]
    got = table(corpus.clean_text(spark.createDataFrame(rows, "i int, text string")))
    assert got == [(1, "é" * 201), (5, "d" * 201)]
    both = corpus.corpus(spark.createDataFrame([("p",)], "text string"), spark.createDataFrame([("n",)], "text string"))
    assert table(both) == [("n", 0), ("p", 1)]


TEXTS = [
    (0, 1, "water water soil crop"), (1, 1, "crop yield water"), (2, 1, "soil soil yield farm"), (3, 0, "metal engine crop"),
    (4, 0, "engine engine noise"), (5, 0, "noise metal metal water"), (6, 1, "a b"), (7, 0, "unseen words here"), (8, 1, "crop crop"),
]


def brute_tfidf(train, doc):
    """Weights of a document with the idf of the training documents."""
    n, df = len(train), Counter(t for d in train for t in set(d))
    raw = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in Counter(doc).items() if df[t]}
    length = math.sqrt(sum(v * v for v in raw.values()))
    return {t: v / length for t, v in raw.items()}


def words(text):
    return [w for w in text.split() if len(w) > 1]


def brute_bayes(train, test, alpha):
    docs = [words(t) for _, _, t in train]
    vocab = {w for d in docs for w in d}
    sums = {0: defaultdict(float), 1: defaultdict(float)}
    for (_, y, _), d in zip(train, docs):
        for t, v in brute_tfidf(docs, d).items():
            sums[y][t] += v
    out = {}
    for i, _, text in test:
        weights, scores = brute_tfidf(docs, words(text)), []
        for c in (0, 1):
            mass = sum(sums[c].values()) + alpha * len(vocab)
            prior = math.log(sum(y == c for _, y, _ in train) / len(train))
            scores.append(prior + sum(v * math.log((sums[c][t] + alpha) / mass) for t, v in weights.items()))
        out[i] = int(scores[1] > scores[0])
    return out


def test_tfidf_and_bayes_against_brute_force(spark):
    docs = spark.createDataFrame(TEXTS, "id int, label int, text string")
    counts = corpus.term_counts(docs, "id")
    weights = {(r.id, r.term): r.weight for r in corpus.tfidf(counts, docs, "id").collect()}
    every = [words(t) for _, _, t in TEXTS]
    want = {(i, t): v for i, _, text in TEXTS for t, v in brute_tfidf(every, words(text)).items()}
    assert weights.keys() == want.keys() and all(abs(weights[k] - want[k]) < 1e-12 for k in want)
    folded = docs.withColumn("fold", F.col("id") % 3).drop("text")
    alphas = (0.01, 0.1, 1.0)
    got = bayes.nb_cross_validate(counts, folded, "id", "label", "fold", 3, alphas)
    found = {(r.alpha, r.id): r.prediction for r in got.collect()}
    assert len(found) == len(TEXTS) * 3
    for a in alphas:
        for f in range(3):
            train, test = [t for t in TEXTS if t[0] % 3 != f], [t for t in TEXTS if t[0] % 3 == f]
            for i, y in brute_bayes(train, test, a).items():
                assert found[(a, i)] == y, (a, i)


def test_metrics_against_mllib_and_edges(spark):
    rows = [(f, (i * 7) % 2, (i * i + f) % 2) for f in range(3) for i in range(20 + f)]
    df = spark.createDataFrame(rows, "fold int, label int, prediction int")
    mine = {r.fold: r for r in evaluation.metrics(df, by=["fold"]).collect()}
    for f in range(3):
        one = df.filter(F.col("fold") == f).select(F.col("label").cast("double"), F.col("prediction").cast("double"))
        for name, metric in (("accuracy", "accuracy"), ("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1", "f1")):
            want = MulticlassClassificationEvaluator(metricName=metric).evaluate(one)
            assert abs(mine[f][name] - want) < 1e-12
        assert abs(mine[f].recall - mine[f].accuracy) < 1e-12
    never = spark.createDataFrame([(1, 0), (1, 0), (0, 0)], "label int, prediction int")
    r = evaluation.metrics(never).first()
    assert abs(r.precision - 1 / 9) < 1e-12 and abs(r.f1 - 1 / 6) < 1e-12
    single = spark.createDataFrame([(1, 0), (1, 1)], "label int, prediction int")
    assert evaluation.metrics(single).first().accuracy == 0.5


def test_grid_and_first_of_equals(spark):
    assert len(evaluation.parameter_grid(C=[1, 2, 3], kernel=["a", "b"], gamma=[1, 2, 3])) == 18
    rows = [(a, f, 1, int(a < 1 or f == 0)) for a in (0.01, 0.1, 1.0) for f in (0, 1)]
    found = spark.createDataFrame(rows, "alpha double, fold int, label int, prediction int")
    assert [r.alpha for r in evaluation.best_setting(found, "alpha", [0.01, 0.1, 1.0]).filter("is_best").collect()] == [0.01]


def two_topics(spark, n=60):
    rows = [(i, i % 2, ("water soil crop " if i % 2 else "metal engine noise ") * (1 + i % 3) + f"word{i % 5}") for i in range(n)]
    return spark.createDataFrame(rows, "id int, label int, text string")


def test_kernel_products(spark):
    docs = two_topics(spark, 8)
    hashed = corpus.hashed_features(corpus.term_counts(docs, "id"), "id", 64)
    rows = hashed.orderBy("id").collect()
    dense = [dict(zip(r.slots, r["values"])) for r in rows]
    for kernel, gamma in (("rbf", 0.5), ("poly", 1.0)):
        made = [r.features.toArray() for r in kernels.kernel_features(hashed, kernel, gamma, 8192).orderBy("id").collect()]
        for i in range(4):
            dot = sum(v * dense[i].get(k, 0) for k, v in dense[0].items())
            want = math.exp(-gamma * (2 - 2 * dot)) if kernel == "rbf" else (gamma * dot) ** 3
            assert abs(made[0] @ made[i] - want) < 0.06, (kernel, i)


def test_classifiers_learn(spark):
    docs = two_topics(spark)
    counts = corpus.term_counts(docs, "id")
    base = docs.select("id", "label", (F.col("id") % 3).alias("fold"))
    wide = corpus.with_features(base, corpus.hashed_features(counts, "id", 64), "id").cache()
    grid = {"C": [1.0], "kernel": ["rbf", "poly"], "gamma": [1.0]}
    best = kernels.svm_grid_search(wide, grid, "fold", 3, max_iter=12, features=64)
    assert best.filter("is_best").count() == 1 and best.agg(F.max("mean_accuracy")).first()[0] > 0.9
    rows = neural.vectors(wide, 64)
    for model in (neural.mlp_fit(rows, [64, 4, 2], max_iter=20), neural.rf_fit(rows, 5)):
        assert evaluation.metrics(neural.predicted(model, rows)).first().accuracy > 0.9
    constant = neural.score_text(docs, "text", lambda: lambda batch: pd.Series([7] * len(batch)))
    assert {r.prediction for r in constant.collect()} == {7}


def test_term_scorer_is_the_plain_product(spark):
    terms = {1: {"a": 0.6, "b": 0.8}, 2: {"c": 1.0}, 3: {"b": 1.0}, 4: {}, 5: {"c": 0.8, "b": 0.6}, 6: {"new": 1.0}}
    cells = spark.createDataFrame([(k, t, v) for k, own in terms.items() for t, v in own.items()], "id int, term string, v double")
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "id int, label int")
    table_, intercept = neural.mean_difference(cells, marks, "id")
    weights = {r.term: r.weight for r in table_.collect()}
    assert weights == pytest.approx({"a": 0.3, "b": 0.9, "c": -0.5}) and intercept == pytest.approx(0.5 * (0.25 - 0.09 - 0.81))
    docs = spark.createDataFrame([(k,) for k in terms], "id int")
    got = {r.id: r.prediction for r in neural.score_terms(docs, cells, table_, intercept, "id").collect()}
    assert got == {k: int(sum(weights.get(t, 0) * v for t, v in own.items()) + intercept > 0) for k, own in terms.items()}
    assert neural.score_terms(docs.limit(0), cells, table_, intercept, "id").collect() == []


def test_every_term_has_a_slot_of_its_own(spark):
    words = " ".join(f"term{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, words), (2, "term1 term1 other")], "id int, text string")
    rows = {r.id: r for r in corpus.hashed_features(corpus.term_counts(docs, "id"), "id").collect()}
    assert len(set(rows[1].slots)) == 3000 and sum(v * v for v in rows[1]["values"]) == pytest.approx(1)
    assert set(rows[2].slots) & set(rows[1].slots) and sorted(rows[2]["values"]) == pytest.approx([1 / 5**0.5, 2 / 5**0.5])


def test_chi_squared_terms(spark):
    docs = two_topics(spark, 40)
    counts = corpus.term_counts(docs, "id")
    found = {r.term: r.slot for r in corpus.telling_terms(counts, docs, "id", 6).collect()}
    assert set(found) == {"water", "soil", "crop", "metal", "engine", "noise"} and sorted(found.values()) == list(range(6))


def test_rounds_not_models_make_the_jobs(spark):
    docs = two_topics(spark, 30)
    base = docs.select("id", "label", (F.col("id") % 3).alias("fold"))
    wide = corpus.with_features(base, corpus.hashed_features(corpus.term_counts(docs, "id"), "id"), "id").cache()
    wide.count()
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for grid in ({"C": [1.0], "kernel": ["rbf"], "gamma": [1.0]}, {"C": [0.1, 1.0, 10.0], "kernel": ["rbf", "poly"], "gamma": [0.1, 1.0]}):
        spark.sparkContext.setJobGroup(f"g{len(jobs)}", "")
        settings = evaluation.parameter_grid(**grid)
        found = kernels.svm_predictions(wide, settings, [0, 1, 2], max_iter=3, features=16)
        jobs.append(len(tracker.getJobIdsForGroup(f"g{len(jobs)}")))
        assert found.count() == 30 * len(settings) and found.filter("fold is null").count() == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_machine_has_not_seen_its_fold(spark):
    """A fold with labels turned round is predicted as the other folds teach."""
    docs = two_topics(spark, 60).select("id", "text", (F.col("id") % 3).alias("fold"), F.when(F.col("id") % 3 == 0, 1 - F.col("label")).otherwise(F.col("label")).alias("label"))
    wide = corpus.with_features(docs.drop("text"), corpus.hashed_features(corpus.term_counts(docs, "id"), "id"), "id")
    for found in (kernels.svm_cross_validate(wide, "fold", 1, 1.0, "rbf", 1.0, features=64), neural.network_cross_validate(wide, "fold", 1, width=64)):
        rows = found.collect()
        assert len(rows) == 20 and sum(r.label == r.prediction for r in rows) < 4


def test_terms_are_counted_in_tasks_of_bounded_text(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "alpha beta beta " * 20) for i in range(100)] + [(None, None), (1, "beta")], "doc_id long, text string")
    monkeypatch.setattr(corpus, "TEXT", 100)
    counts = corpus.term_counts(docs, "doc_id")
    assert counts.rdd.getNumPartitions() >= 100 * 320 // 100
    found = {(r.doc_id, r.term): r.tf for r in counts.collect()}
    assert len(found) == 200 and found[1, "beta"] == 41 and found[0, "alpha"] == 20


def test_spread_jobs_have_more_partitions_for_more_rows(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(n) for n in names]
    with pytest.raises(ValueError), lineage.spread(spark, 100 * lineage.ROWS):
        assert int(spark.conf.get(names[0])) == 101
        raise ValueError
    with lineage.spread(spark, 0):
        assert spark.conf.get(names[0]) == before[0]
    assert [spark.conf.get(n) for n in names] == before


def test_features_of_a_gamma_follow_from_the_stored_base():
    rng = np.random.default_rng(2)
    slots, values = pd.Series([rng.integers(0, 1 << 60, n) for n in (5, 0, 40)] * 90), pd.Series([rng.normal(size=n) for n in (5, 0, 40)] * 90)
    for kernel in ("rbf", "poly"):
        base = kernels._base(slots, values, kernel, 64, 3)
        for gamma in (0.01, 1.0):
            want = kernels.mapped(slots, values, [(kernel, gamma)], 64, 3)[0]
            np.testing.assert_allclose(kernels._of_gamma(base.astype(np.float32), kernel, gamma, 3), want, atol=1e-5)
    few = kernels.projected(slots[:3], values[:3], 64, 3)  # without rows that are kept for the batch
    np.testing.assert_allclose(kernels.projected(slots, values, 64, 3)[:3], few, atol=1e-12)


def test_a_stored_frame_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in (str(b) for b in iterate(disk.getAllBlocks())) if f.startswith("shuffle_")}

    def iterate(blocks):
        return [blocks.apply(i) for i in range(blocks.size())]

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, kept = shuffled(), spark.conf.get(name)
    stored = lineage.cut(spark.range(1000, numPartitions=3).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "count"))
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and spark.conf.get(name) == kept
    assert stored.count() == 7
    lineage.release(stored)


@pytest.mark.parametrize("often", [1, 6, bayes.OFTEN])
def test_bayes_does_not_depend_on_which_terms_are_frequent(spark, monkeypatch, often):
    """Keys that repeat or are NULL, labels of no class and documents of no training set included."""
    monkeypatch.setattr(bayes, "OFTEN", often)
    monkeypatch.setattr(bayes, "_BITS", 2)
    docs = spark.createDataFrame(
        [(t[0], t[1], t[0] % 3, t[2]) for t in TEXTS] + [(1, 0, 2, "crop water noise"), (None, 1, 0, "metal soil"), (9, 5, 1, "soil engine"), (10, 1, None, "yield yield farm")],
        "id int, label int, fold int, text string",
    )
    counts, rows = corpus.term_counts(docs, "id").cache(), docs.drop("text").collect()
    model = bayes.nb_fit(counts, docs.drop("text"), "id", "label", bayes.held_out("fold", 3))
    cells = [(r, c.term, c.tf) for c in counts.collect() for r in rows if r.id is not None and r.id == c.id]
    got = {r.term: r for r in model.terms.collect()}
    assert got.keys() == {t for _, t, _ in cells}
    for f in range(3):
        inside = lambda r: r.fold is not None and r.fold != f  # noqa: B023, E731
        n, df = sum(map(inside, rows)), Counter(t for r, t, _ in cells if inside(r))
        weight = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in df if df[t]}
        length = defaultdict(float)
        for r, t, tf in cells:
            length[r.id] += (tf * weight.get(t, 0)) ** 2
        for t, row in got.items():
            assert row.idf[f] == (pytest.approx(weight[t]) if t in weight else None)
            for c in (0, 1):
                want = sum(tf * weight[t] / math.sqrt(length[r.id]) for r, u, tf in cells if u == t and r.label == c and inside(r))
                assert row[f"s_{c}"][f] == pytest.approx(want, abs=1e-12)
    counts.unpersist()


def test_term_rows_are_not_shuffled_with_the_numbers_of_all_sets(spark):
    docs = spark.createDataFrame(TEXTS, "id int, label int, text string").withColumn("fold", F.col("id") % 3)
    counts = lineage.cut(corpus.term_counts(docs, "id"))
    model = bayes.nb_fit(counts, docs.drop("text"), "id", "label", bayes.held_out("fold", 3))
    assert model.terms.columns == ["term", "often", "idf", "s_0", "s_1"]
    found = bayes._met(counts, model.terms.select("term", "often", "idf"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and found.count() == counts.count()


def test_rows_are_packed_for_descent(spark, monkeypatch):
    monkeypatch.setattr(descent, "PACK", 3)
    rows = [(i, None if i == 4 else i % 2, np.full(2, i, np.float32).tobytes()) for i in range(10)]
    packs = descent.packed(spark.createDataFrame(rows, "fold int, label int, x binary").coalesce(1), ["label", "fold"], ["x"])
    found = packs.collect()
    assert packs.columns == ["label", "fold", "x"] and len(found) == 4
    read = lambda c, kind: np.concatenate([np.frombuffer(r[c], kind) for r in found])
    assert read("fold", float).tolist() == list(range(10)) and np.isnan(read("label", float)[4]) and read("label", float)[5] == 1
    assert read("x", np.float32).tolist() == [i for i in range(10) for _ in range(2)]
    batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    total = descent.summed(packs, lambda b, p: [sum(np.frombuffer(x).sum() for x in b["fold"]) * np.ones(2)], [np.zeros(2)])
    assert total[0].tolist() == [45, 45] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batches


def test_drawn_rows_are_normal_and_belong_to_their_term():
    rows = kernels._term_rows(np.arange(4000, dtype=np.uint64), 65, 3)
    assert abs(rows.mean()) < 0.01 and abs(rows.std() - 1) < 0.01 and abs((rows**4).mean() - 3) < 0.1
    assert np.abs(np.corrcoef(rows.T) - np.eye(65)).max() < 0.08
    assert (rows[17:19] == kernels._term_rows(np.array([17, 18], np.uint64), 65, 3)).all()


def test_classifiers_share_their_inputs(spark, monkeypatch):
    calls = Counter()
    for module, name in ((kernels, "svm_bases"), (neural, "network_inputs"), (bayes, "nb_fit"), (corpus, "raw_weights"), (corpus, "counted")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), n=name, **b: calls.update([n]) or f(*a, **b))
    texts = lambda w: spark.createDataFrame([(i, f"{w[i % 3]} " * 40 + "field " * 20) for i in range(len(w) * 8)], "id int, text string")
    positive, negative = texts(["water", "crop", "yield"]), texts(["engine", "noise", "metal"]).withColumn("id", F.col("id") + 100)
    for nested in (False, True):
        calls.clear()
        found = classifier.compare_classifiers(positive, negative, "id", folds=3, inner=2, svm_grid={"C": [1.0], "kernel": ["rbf", "poly"], "gamma": [1.0]}, nested=nested, stratified=True, features=32, max_iter=8)
        rows = {r.model: r for r in found.collect()}
        assert set(rows) == {"svm", "nb", "neural"} and rows["nb"].mean_accuracy > 0.9 and rows["svm"].mean_accuracy > 0.9
        assert calls == {"svm_bases": 1, "network_inputs": 1, "nb_fit": 1, "raw_weights": 1, "counted": 1}
