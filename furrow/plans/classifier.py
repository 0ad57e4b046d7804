"""The classifier comparison: tune, evaluate by folds, one row of scores per model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.constants import BAYES_GRID, INNER_FOLDS, OUTER_FOLDS, SVM_GRID
from furrow.lineage import cut, spread
from furrow.operators import bayes, corpus, evaluation, kernels, neural, ordering


def _winner(found: DataFrame, *columns: str):
    return found.filter("is_best").select(*columns).first()


def compare_classifiers(
    positive: DataFrame,
    negative: DataFrame,
    key: str,
    text: str = "text",
    models: tuple[str, ...] = ("svm", "nb", "neural"),
    folds: int = OUTER_FOLDS,
    inner: int = INNER_FOLDS,
    svm_grid: dict[str, list] = SVM_GRID,
    alphas: list[float] = BAYES_GRID["alpha"],
    nested: bool = False,
    stratified: bool = False,
    test: float = 0.25,
    seed: int = 7,
    features: int = kernels.FEATURES,
    max_iter: int = 40,
) -> DataFrame:
    """Score table of the chosen models.

    Settings are tuned on the training part by stratified folds. The outer folds run over the whole
    corpus, as the study did; ``nested=True`` keeps them to the part not used for tuning. Outer folds
    are contiguous over the label-sorted corpus unless ``stratified``. Every prediction is made by a
    model that has not seen the row.
    """
    texts = corpus.clean_text(corpus.corpus(positive, negative), text)
    ids, counts = corpus.counted(texts, key, ["label"], text)
    marked = cut(ordering.split_rows(ids, key, test, seed))
    whole = marked.filter("is_test") if nested else marked
    if stratified:
        outer = cut(ordering.stratified_kfold(whole, folds, key, "label"))
    else:
        outer = cut(ordering.kfold(whole, folds, key, ["label"], descending=("label",)))
    # both folds side by side: fold, NULL in rows that are for tuning only, and tune, NULL in rows that are not for tuning
    none = F.lit(None).cast("int")
    train = marked.filter(~F.col("is_test")).withColumn("fold", none) if nested else outer.filter(~F.col("is_test"))
    tuned = ordering.stratified_kfold(train, inner, key, "label", "tune")
    rows = cut(tuned.unionByName(outer.filter(F.coalesce("is_test", F.lit(True))).withColumn("tune", none)))
    kernel_names = sorted(set(svm_grid["kernel"]))
    scores = {}
    if {"svm", "neural"} & set(models):
        with spread(counts.sparkSession, counts.count()):
            wide = corpus.with_features(rows, corpus.weighted_features(counts, ids, key), key)
            made = [kernels.svm_bases(kernel_names, features)("slots", "values").alias("__bases")] if "svm" in models else []
            made += [neural.network_inputs(features)("slots", "values").alias("__x")] if "neural" in models else []
            wide = cut(wide.select(*rows.columns, *made))
    if "svm" in models:
        common = {"max_iter": max_iter, "features": features, "kernels": kernel_names}
        own = wide.select(*rows.columns, "__bases")
        found = kernels.svm_grid_search(own.filter("tune is not null"), svm_grid, "tune", inner, **common)
        best = _winner(found, "C", "kernel", "gamma")
        scores["svm"] = kernels.svm_cross_validate(own.filter("fold is not null"), "fold", folds, *best, **common)
    if "nb" in models:
        # one fit: the models of the tuning folds, then those of the outer folds
        fitted = bayes.nb_fit(counts, rows, key, "label", [*bayes.held_out("tune", inner), *bayes.held_out("fold", folds)])
        found = bayes.nb_predict(fitted, counts, rows.filter("tune is not null"), key, F.col("tune"), tuple(alphas))
        alpha = _winner(evaluation.best_setting(found, "alpha", alphas, "tune"), "alpha")[0]
        scores["nb"] = bayes.nb_predict(fitted, counts, rows.filter("fold is not null"), key, F.col("fold") + inner, (alpha,))
    if "neural" in models:
        own = wide.select(*rows.columns, "__x")
        scores["neural"] = neural.network_cross_validate(own.filter("fold is not null"), "fold", folds, width=features, max_iter=max_iter)
    return evaluation.score_table(
        {name: evaluation.summarise_folds(evaluation.metrics(found, by=["fold"])) for name, found in scores.items()}
    )
