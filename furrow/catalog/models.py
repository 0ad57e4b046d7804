"""Trained classifiers over the labelled documents.

Their weights come from iterative training, so what is compared with SQL is which rows each model scored, and that it learned:
its accuracy on rows it has not seen is at least the share of the most frequent label, less 0.05.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.catalog.base import Tables, query
from furrow.catalog.texts import _CLEAN, _TOKENS, labelled
from furrow.constants import SVM_GRID
from furrow.lineage import cut, spread
from furrow.operators import corpus, kernels, neural, ordering
from furrow.plans import classifier

MARGIN = 0.05
_TEST = "cast('0x' || substr(md5('7:' || doc_id), 1, 7) as bigint) % 1000000 < 250000"


def _learned(found: DataFrame, by: list[str]) -> DataFrame:
    """Held-out rows per label and whether the model learned, from predictions."""
    # stored, some rows a model: the predictions are made once, and a model's name is a column like others when it is joined
    sizes = cut(found.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == F.col("prediction")).cast("long")).alias("hits")))
    whole = sizes.groupBy(*by).agg((F.sum("hits") / F.sum("n") >= F.max("n") / F.sum("n") - MARGIN).alias("learned"))
    return sizes.join(whole, by).select(*by, F.col("label").cast("long").alias("label"), "n", "learned")


def _scored_sql(*models: str) -> str:
    names = ", ".join(f"('{m}')" for m in models)
    return f"""
    with {_CLEAN} select model, cast(label as bigint) as label, count(*) as n, true as learned
    from clean, (values {names}) m(model) where {_TEST} group by all
    """


def _parted(t: Tables):
    """Labelled documents with a test mark, and their stored term counts."""
    ids, counts = corpus.counted(labelled(t), "doc_id", ["label"])
    return cut(ordering.split_rows(ids, "doc_id", 0.25, seed=7)), counts


def _weighted(t: Tables) -> DataFrame:
    """The same with the TF-IDF weights of all their terms, as 64-bit slots."""
    ids, counts = _parted(t)
    hashed = corpus.weighted_features(counts, ids, "doc_id")
    with spread(ids.sparkSession, counts.count()):
        return cut(corpus.with_features(ids, hashed, "doc_id"))


@query("svm_rff", _scored_sql("svm rbf", "svm poly"))
def svm_rff(spark, folder):
    rows = _weighted(Tables(spark, folder)).withColumn("fold", F.col("is_test").cast("int"))
    settings = [{"C": 1.0, "kernel": k, "gamma": 1.0} for k in ("rbf", "poly")]
    found = kernels.svm_predictions(rows, settings, [1])
    return _learned(found.withColumn("model", F.concat(F.lit("svm "), F.get(F.array(F.lit("rbf"), F.lit("poly")), F.col("setting")))), ["model"])


@query("mlp_text", _scored_sql("mlp"))
def mlp_text(spark, folder):
    rows = cut(neural.projections(_weighted(Tables(spark, folder))))
    model = neural.mlp_fit(rows.filter(~F.col("is_test")), [neural.WIDTH, 16, 2])
    return _learned(neural.predicted(model, rows.filter("is_test")).withColumn("model", F.lit("mlp")), ["model"])


@query("forest_text", _scored_sql("forest"))
def forest_text(spark, folder):
    """The terms are chosen, and the forest grown, on the training side."""
    ids, counts = _parted(Tables(spark, folder))
    with spread(spark, counts.count()):
        terms = corpus.telling_terms(counts, ids.filter(~F.col("is_test")), "doc_id", neural.TERMS)
        chosen = corpus.term_columns(corpus.tfidf(counts, ids, "doc_id"), terms, "doc_id")
        rows = cut(neural.vectors(corpus.with_features(ids, chosen, "doc_id"), neural.TERMS))
    model = neural.rf_fit(rows.filter(~F.col("is_test")))
    return _learned(neural.predicted(model, rows.filter("is_test")).withColumn("model", F.lit("forest")), ["model"])


_BATCH_SQL = rf"""
    with texts as (select doc_id, quality, lower(body) as text, {_TEST} as is_test from (
      select doc_id, quality, split_part(replace('Abstract: ' || text, 'Abstract: ', ''), '#', 1) as body
      from documents left join labels using (doc_id)) where length(body) > 200),
    counts as (select doc_id, term, count(*) as tf from (select doc_id, {_TOKENS} as term from texts) group by all),
    cells as (select doc_id, term, tf / sqrt(sum(tf * tf) over (partition by doc_id)) as v from counts),
    seen as (select doc_id, quality from texts where quality is not null and not is_test),
    means as (select term, sum(v) filter (quality = 1) / greatest((select count(*) from seen where quality = 1), 1) as one,
                     sum(v) filter (quality = 0) / greatest((select count(*) from seen where quality = 0), 1) as zero from cells join seen using (doc_id) group by 1),
    model as (select term, coalesce(one, 0) as one, coalesce(zero, 0) as zero from means),
    scores as (select doc_id, sum(v * (one - zero)) as s from cells join model using (term) group by 1)
    select doc_id, cast(round(coalesce(s, 0) + 0.5 * (select sum(zero * zero - one * one) from model), 9) > 0 as integer) as prediction
    from texts left join scores using (doc_id) where quality is null or is_test
"""


@query("batch_score", _BATCH_SQL)
def batch_score(spark, folder):
    """Fitted on the training side of the labelled documents; scores the test side and all unlabelled ones."""
    t = Tables(spark, folder)
    marks = labelled(t).select("doc_id", "label")
    texts = corpus.clean_text(t.documents.select("doc_id", F.concat(F.lit("Abstract: "), F.col("text")).alias("text")))
    ids, counts = corpus.counted(texts, "doc_id", [])
    rows = cut(ordering.split_rows(ids.join(marks, "doc_id", "left"), "doc_id", 0.25, seed=7))
    seen = F.col("label").isNotNull() & ~F.col("is_test")
    with spread(spark, counts.count()):
        cells = cut(corpus.unit_cells(counts, "doc_id"))
        weights, intercept = neural.mean_difference(cells, rows.filter(seen), "doc_id")
        return cut(neural.score_terms(rows.filter(~seen), cells, weights, intercept, "doc_id").select("doc_id", "prediction"))


_SETTINGS = ", ".join(f"({c!r}e0, '{k}', {g!r}e0)" for c in SVM_GRID["C"] for k in SVM_GRID["kernel"] for g in SVM_GRID["gamma"])


@query(
    "svm_grid_search",
    f"""
    with {_CLEAN} select g.C, kernel, gamma, count(*) as n, true as best_learned
    from clean, (values {_SETTINGS}) g(C, kernel, gamma) where not ({_TEST}) group by all
    """,
)
def svm_grid_search(spark, folder):
    """All settings by five stratified folds of the training side, trained together."""
    rows = _weighted(Tables(spark, folder)).filter(~F.col("is_test"))
    ids = ordering.stratified_kfold(rows.select("doc_id", "label"), 5, "doc_id", "label").select("doc_id", "fold")
    found = cut(kernels.svm_grid_search(rows.join(ids, "doc_id"), SVM_GRID))
    most = rows.groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0]
    best = found.agg(F.max("mean_accuracy")).first()[0]
    return found.select("C", "kernel", "gamma", "n", F.lit(best is not None and best >= most - MARGIN).alias("best_learned"))


@query("classifier_comparison", "select unnest(['svm', 'nb', 'neural']) as model, true as complete, true as learned")
def classifier_comparison(spark, folder):
    """Every model's scores over ten folds of the whole corpus, its settings tuned on the training side."""
    t = Tables(spark, folder)
    marked = t.labels.select("doc_id", "quality").join(t.documents.select("doc_id", F.concat(F.lit("Abstract: "), F.col("text")).alias("text")), "doc_id")
    positive, negative = (marked.filter(F.col("quality") == q).drop("quality") for q in (1, 0))
    scores = classifier.compare_classifiers(positive, negative, "doc_id", stratified=True)
    sizes = labelled(t).groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0] or 0.0
    whole = F.lit(True)
    for name in (c for c in scores.columns if c.startswith(("mean_", "std_"))):
        whole = whole & F.col(name).isNotNull() & (F.col(name) >= 0) & (F.col(name) <= 1)
    return scores.select("model", whole.alias("complete"), (F.col("mean_accuracy") >= sizes - MARGIN).alias("learned"))
