"""Corpus cleaning, splits, weights and naive Bayes on the documents and their labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from furrow.catalog.base import Tables, query
from furrow.constants import BAYES_GRID, INNER_FOLDS, OUTER_FOLDS
from furrow.lineage import cut, spread
from furrow.operators import bayes, corpus, evaluation, ordering

_CLEAN = """
    clean as (select doc_id, label, lower(body) as text from (
      select doc_id, quality as label, split_part(replace('Abstract: ' || text, 'Abstract: ', ''), '#', 1) as body
      from labels join documents using (doc_id)) where length(body) > 200)
"""


def labelled(t: Tables):
    """Included and excluded documents, cleaned: (doc_id, label, text)."""
    marks = corpus.corpus(
        t.labels.filter(F.col("quality") == 1).select("doc_id"), t.labels.filter(F.col("quality") == 0).select("doc_id")
    )
    texts = t.documents.select("doc_id", F.concat(F.lit("Abstract: "), F.col("text")).alias("text"))
    return corpus.clean_text(marks.join(texts, "doc_id"))


@query("clean_corpus", f"with {_CLEAN} select doc_id, cast(label as integer) as label, text from clean")
def clean_corpus(spark, folder):
    return labelled(Tables(spark, folder)).select("doc_id", "label", "text")


@query(
    "split_md5",
    """
    select doc_id, md5('7:' || doc_id) as shuffle_key, cast('0x' || substr(md5('7:' || doc_id), 1, 7) as bigint) % 1000000 < 250000 as is_test from documents
    """,
)
def split_md5(spark, folder):
    docs = Tables(spark, folder).documents.select("doc_id")
    split = ordering.split_rows(docs, "doc_id", 0.25, seed=7)
    return ordering.shuffle_rows(split.withColumn("shuffle_key", ordering.hash_key("doc_id", 7)), 7, "doc_id")


@query(
    "split_exact",
    """
    select doc_id, row_number() over (order by substr(md5('7:' || doc_id), 1, 13)) <= ceil(count(*) over () * 0.25) as is_test from documents
    """,
)
def split_exact(spark, folder):
    docs = Tables(spark, folder).documents.select("doc_id")
    return ordering.split_rows(docs, "doc_id", 0.25, seed=7, method="exact")


def _fold_sql(k: int) -> str:
    return f"case when i < n % {k} * (n // {k} + 1) then i // (n // {k} + 1) else n % {k} + (i - n % {k} * (n // {k} + 1)) // nullif(n // {k}, 0) end"


_FOLDS = f"""
    placed as (select *, row_number() over (order by label desc, doc_id) - 1 as i, count(*) over () as n from clean),
    docs as (select doc_id, label, text, cast({_fold_sql(OUTER_FOLDS)} as bigint) as fold from placed)
"""


@query("kfold_contiguous", f"with {_CLEAN}, {_FOLDS} select doc_id, cast(label as bigint) as label, fold from docs")
def kfold_contiguous(spark, folder):
    ids = labelled(Tables(spark, folder)).select("doc_id", "label")
    docs = ordering.kfold(ids, OUTER_FOLDS, "doc_id", ["label"], descending=("label",))
    return docs.select("doc_id", F.col("label").cast("bigint").alias("label"), F.col("fold").cast("bigint").alias("fold"))


_TOKENS = r"unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'))"


@query(
    "term_counts",
    rf"""
    select doc_id, term, count(*) as tf from (select doc_id, {_TOKENS} as term from documents) group by all
    """,
)
def term_counts(spark, folder):
    return corpus.term_counts(Tables(spark, folder).documents, "doc_id")


@query(
    "tfidf_top_terms",
    rf"""
    with counts as (select doc_id, term, count(*) as tf from (select doc_id, {_TOKENS} as term from documents) group by all),
    dfs as (select term, count(*) as df from counts group by 1),
    raw as (select doc_id, term, tf, tf * (ln((1e0 + (select count(*) from documents)) / (1e0 + df)) + 1e0) as w from counts join dfs using (term)),
    weighted as (select doc_id, term, tf, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from raw)
    select doc_id, term, tf, weight from (select *, row_number() over (partition by doc_id order by weight desc, term) as r from weighted) where r <= 5
    """,
)
def tfidf_top_terms(spark, folder):
    ids, counts = corpus.counted(Tables(spark, folder).documents, "doc_id", [])
    weights = corpus.tfidf(counts, ids, "doc_id")
    shown = weights.withColumn("weight", F.round("weight", 6))
    order = Window.partitionBy("doc_id").orderBy(F.col("weight").desc(), "term")
    with spread(spark, counts.count()):
        return cut(shown.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= 5).drop("r"))


def _bayes_sql(k: int, alphas: list[float]) -> str:
    """CTEs from docs (doc_id, label, text, fold) to preds (fold, alpha, doc_id, label, prediction)."""
    grid = ", ".join(f"({a!r}e0)" for a in alphas)
    return rf"""
    counts as (select doc_id, label, fold, term, count(*) as tf from (select doc_id, label, fold, {_TOKENS} as term from docs) group by all),
    folds as (select unnest(range({k})) as f),
    sizes as (select f, count(*) as n from docs, folds where fold <> f group by 1),
    dfs as (select f, term, count(*) as df from counts, folds where fold <> f group by all),
    raw as (select d.f, doc_id, label, fold, c.term, tf * (ln((1e0 + n) / (1e0 + df)) + 1e0) as w
            from counts c join dfs d on c.term = d.term join sizes s on s.f = d.f),
    weighted as (select *, w / sqrt(sum(w * w) over (partition by f, doc_id)) as u from raw),
    class_terms as (select f, label as c, term, sum(u) as s from weighted where fold <> f group by all),
    mass as (select f, c, sum(s) as m from class_terms group by all),
    vocab as (select f, count(*) as v from dfs group by 1),
    priors as (select f, label as c, ln(count(*)::double / max(n)) as p from docs join folds on fold <> f join sizes using (f) group by all),
    alphas as (select * from (values {grid}) a(alpha)),
    base as (select d.doc_id, d.label, d.fold, p.c, p.p, m.m, v.v, alpha from docs d join priors p on p.f = d.fold
             join mass m on m.f = p.f and m.c = p.c join vocab v on v.f = p.f cross join alphas),
    dots as (select b.doc_id, b.c, b.alpha, sum(u * ln((coalesce(s, 0) + alpha) / (m + alpha * v))) as dot
             from base b join weighted w on w.doc_id = b.doc_id and w.f = b.fold
             left join class_terms t on t.f = w.f and t.term = w.term and t.c = b.c group by all),
    scores as (select b.*, p + coalesce(dot, 0) as score from base b left join dots using (doc_id, c, alpha)),
    preds as (select fold, alpha, doc_id, label, c as prediction from (
      select *, row_number() over (partition by doc_id, alpha order by round(score, 9) desc, c) as r from scores) where r = 1)
    """


def _metrics_sql(source: str, by: str) -> str:
    """CTE ``scored`` from a table with label, prediction and the ``by`` columns."""
    return f"""
    sides as (select {by}, label as c, 1 as support, 0 as called, case when label = prediction then 1 else 0 end as hit from {source}
              union all select {by}, prediction, 0, 1, 0 from {source}),
    per_class as (select {by}, c, sum(support) as support, sum(called) as called, sum(hit) as hit from sides group by all),
    rated as (select *, coalesce(hit / nullif(called, 0), 0) as p, coalesce(hit / nullif(support, 0), 0) as r from per_class),
    scored as (select {by}, sum(hit) / sum(support) as accuracy, sum(support * p) / sum(support) as precision, sum(support * r) / sum(support) as recall,
                      sum(support * coalesce(2 * p * r / nullif(p + r, 0), 0)) / sum(support) as f1 from rated group by all)
    """


@query(
    "nb_cross_validated",
    f"""
    with {_CLEAN}, {_FOLDS}, {_bayes_sql(OUTER_FOLDS, [0.1])}, {_metrics_sql('preds', 'fold')}
    select 'nb' as model, round(avg(accuracy), 6) as mean_accuracy, round(avg(precision), 6) as mean_precision, round(avg(recall), 6) as mean_recall,
           round(avg(f1), 6) as mean_f1, round(stddev_pop(accuracy), 6) as std_accuracy, round(stddev_pop(precision), 6) as std_precision,
           round(stddev_pop(recall), 6) as std_recall, round(stddev_pop(f1), 6) as std_f1
    from scored
    """,
)
def nb_cross_validated(spark, folder):
    ids, counts = corpus.counted(labelled(Tables(spark, folder)), "doc_id", ["label"])
    docs = cut(ordering.kfold(ids, OUTER_FOLDS, "doc_id", ["label"], descending=("label",)))
    found = bayes.nb_cross_validate(counts, docs, "doc_id", "label", "fold", OUTER_FOLDS, (0.1,))
    summary = evaluation.summarise_folds(evaluation.metrics(found, by=["fold"]))
    out = evaluation.score_table({"nb": summary})
    return out.select("model", *[F.round(c, 6).alias(c) for c in summary.columns])


_INNER = f"""
    train as (select doc_id, label, text from clean where cast('0x' || substr(md5('7:' || doc_id), 1, 7) as bigint) % 1000000 >= 250000),
    placed as (select *, row_number() over (partition by label order by doc_id) - 1 as i, count(*) over (partition by label) as n from train),
    docs as (select doc_id, label, text, cast({_fold_sql(INNER_FOLDS)} as bigint) as fold from placed)
"""


@query(
    "nb_grid_search",
    f"""
    with {_CLEAN}, {_INNER}, {_bayes_sql(INNER_FOLDS, BAYES_GRID['alpha'])}, {_metrics_sql('preds', 'alpha, fold')},
    means as (select alpha, avg(accuracy) as mean_accuracy from scored group by 1)
    select alpha, round(mean_accuracy, 6) as mean_accuracy, row_number() over (order by round(mean_accuracy, 12) desc, alpha) = 1 as is_best from means
    """,
)
def nb_grid_search(spark, folder):
    split = ordering.split_rows(labelled(Tables(spark, folder)), "doc_id", 0.25, seed=7)
    ids, counts = corpus.counted(split.filter(~F.col("is_test")), "doc_id", ["label"])
    train = cut(ordering.stratified_kfold(ids, INNER_FOLDS, "doc_id", "label"))
    alphas = BAYES_GRID["alpha"]
    found = bayes.nb_cross_validate(counts, train, "doc_id", "label", "fold", INNER_FOLDS, tuple(alphas))
    best = evaluation.best_setting(found, "alpha", alphas)
    return best.select("alpha", F.round("mean_accuracy", 6).alias("mean_accuracy"), "is_best")


@query(
    "nb_predictions",
    f"""
    with {_CLEAN}, docs as (select *, case when cast('0x' || substr(md5('7:' || doc_id), 1, 7) as bigint) % 1000000 < 250000 then 0 else 1 end as fold from clean),
    {_bayes_sql(1, [1.0])}
    select doc_id, cast(label as bigint) as label, cast(prediction as bigint) as prediction from preds where fold = 0
    """,
)
def nb_predictions(spark, folder):
    docs = ordering.split_rows(labelled(Tables(spark, folder)), "doc_id", 0.25, seed=7)
    kept, counts = corpus.counted(docs, "doc_id", ["label", "is_test"])
    models = bayes.nb_fit(counts, kept, "doc_id", "label", [~F.col("is_test")])
    found = bayes.nb_predict(models, counts, kept.filter(F.col("is_test")), "doc_id")
    return found.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("label", "prediction")])


@query(
    "metrics_table",
    f"""
    with marks as (select quality as label, toxic as prediction, doc_id % 4 as part from labels), {_metrics_sql('marks', 'part')}
    select part, round(accuracy, 6) as accuracy, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from scored
    """,
)
def metrics_table(spark, folder):
    marks = Tables(spark, folder).labels.select(
        F.col("quality").alias("label"), F.col("toxic").alias("prediction"), (F.col("doc_id") % 4).alias("part")
    )
    out = evaluation.metrics(marks, by=["part"])
    return out.select("part", *[F.round(c, 6).alias(c) for c in evaluation.METRICS])
