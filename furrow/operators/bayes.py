"""Multinomial naive Bayes on TF-IDF weights, for many training sets at once.

Folds are columns, not copies of the rows. A training set is a Boolean column over the documents, a bit of a number where it
meets term rows; document frequencies, weights and class sums of all sets are taken in the same aggregates. Smoothing enters only
when a document is scored, so one model serves a whole grid of alphas.

Numbers of every set are kept per document and per term, never per term row. The table of the frequent terms is broadcast, so
most term rows meet it where they lie, document by document, and are summed before they are shuffled; the others meet theirs in a
shuffle by term.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.lineage import cut, release, spread


#: A term is frequent that has at least one of so many equal parts of the term rows, so there are at most as many of them.
OFTEN = 1 << 18
_BITS = 63


@dataclass(frozen=True)
class BayesModels:
    """``terms``: one row per term with arrays over the training sets: idf, and s_<class>, the class sums; and ``often``.

    ``totals``: one row with arrays over the training sets: prior_<class>, mass_<class> and vocab.
    """

    terms: DataFrame
    totals: DataFrame
    classes: tuple[int, ...]


def held_out(fold: str, k: int) -> list[Column]:
    """Training sets of a k-fold run: all documents but those of the fold."""
    return [F.col(fold) != f for f in range(k)]


def _met(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Term rows with the columns of a table of one row per term: frequent terms (``often``) from a broadcast, others by a shuffle."""
    often, rest = terms.filter("often").drop("often"), terms.filter("not often").drop("often")
    rare = rows.join(F.broadcast(often.select("term")), "term", "left_anti")
    # one row per term on this side: it is the build side, so the term rows are not sorted
    return rows.join(F.broadcast(often), "term").unionByName(rare.join(rest.hint("shuffle_hash"), "term"))


def nb_fit(
    counts: DataFrame, docs: DataFrame, key: str, label: str, trains: list[Column], classes: tuple[int, ...] = (0, 1)
) -> BayesModels:
    """Fit one model per training set.

    ``counts``: (key, term, tf). ``docs``: one row per document with key, label and what the
    training-set columns name. Both are read several times: hand in stored ones (``counted``). Document frequencies, the
    documents' lengths and the term table are stored here, as later steps and every scoring read them.
    """
    sets = range(len(trains))
    listed = lambda part: f"array({', '.join(part(i) for i in sets)})"
    bits = [F.lit(0).cast("bigint")] * (len(trains) // _BITS + 1)
    for i, t in enumerate(trains):
        bits[i // _BITS] = bits[i // _BITS] + F.when(t, F.lit(1 << i % _BITS)).otherwise(0)
    marked = docs.select(F.col(key).alias("__key"), F.col(label).alias("__label"), *[b.alias(f"__in{j}") for j, b in enumerate(bits)])
    seen = lambda i: f"(__in{i // _BITS} & {1 << i % _BITS}L) <> 0"
    sizes = marked.selectExpr(
        f"{listed(lambda i: f'count_if({seen(i)})')} as n",
        *[f"{listed(lambda i: f'count_if({seen(i)} and __label = {c})')} as n_{c}" for c in classes],
    )
    n = sizes.first()["n"]
    rows = counts.select(F.col(key).alias("__key"), "term", "tf")
    with spread(counts.sparkSession, counts.count()):
        met = rows.drop("tf").join(marked.drop("__label"), "__key")
        found = cut(met.groupBy("term").agg(F.count(F.lit(1)).alias("rows"), F.expr(listed(lambda i: f"count_if({seen(i)})")).alias("df")))
        whole = found.agg(F.sum("rows")).first()[0] or 0
        # NULL where the training set does not know the term
        weight = lambda i: f"if(df[{i}] > 0, ln((1D + {n[i]}L) / (1D + df[{i}])) + 1D, null)"
        idf = found.selectExpr("term", f"rows >= {whole} / {OFTEN}D as often", f"{listed(weight)} as idf")
        squares = _met(rows, idf).groupBy("__key").agg(*[F.expr(f"sum(tf * idf[{i}] * (tf * idf[{i}]))").alias(f"q{i}") for i in sets])
        # a key of several documents has the terms of all of them
        times = F.count(F.lit(1)).over(Window.partitionBy("__key"))
        own = marked.filter("__key is not null").withColumn("__times", times).join(squares, "__key")
        scales = cut(own.selectExpr("__key", "__label", f"{listed(lambda i: f'if({seen(i)}, 1D / sqrt(__times * q{i}), null)')} as r"))
        part = lambda c, i: f"coalesce(sum(tf * r[{i}]) filter (where __label = {c}), 0D)"
        sums = rows.join(scales, "__key").groupBy("term").agg(*[F.expr(listed(lambda i, c=c: part(c, i))).alias(f"p_{c}") for c in classes])
        scaled = [f"{listed(lambda i, c=c: f'coalesce(idf[{i}] * p_{c}[{i}], 0D)')} as s_{c}" for c in classes]
        terms = cut(idf.join(sums, "term").selectExpr("term", "often", "idf", *scaled))
    release(found)
    release(scales)
    mass = terms.selectExpr(
        f"{listed(lambda i: f'count(idf[{i}])')} as vocab",
        *[f"{listed(lambda i, c=c: f'coalesce(sum(s_{c}[{i}]), 0D)')} as mass_{c}" for c in classes],
    )
    priors = sizes.selectExpr(*[f"{listed(lambda i, c=c: f'ln(nullif(n_{c}[{i}], 0) / n[{i}])')} as prior_{c}" for c in classes])
    totals = priors.withColumn("__mass", mass.select(F.struct("*")).scalar()).select("*", "__mass.*").drop("__mass")
    return BayesModels(terms, totals, tuple(classes))


def nb_predict(
    models: BayesModels, counts: DataFrame, docs: DataFrame, key: str, which: Column | None = None, alphas: tuple[float, ...] = (1.0,)
) -> DataFrame:
    """All columns of ``docs`` plus alpha and prediction; one row per document and alpha.

    ``which`` numbers the model a document is scored with (the first by default). A document's
    terms meet the model (``_met``); the scaling to length 1 divides the sum afterwards. A document
    without known terms goes by the prior. Ties go to the first class. The predictions are stored.
    """
    classes = models.classes
    numbered = docs.withColumn("__m", F.lit(0) if which is None else which.cast("int"))
    rows = (
        _met(counts.select(key, "term", "tf").join(numbered.select(key, "__m"), key), models.terms)
        .selectExpr(key, "tf * idf[__m] as w", *[f"s_{c}[__m] as s{c}" for c in classes])
        .filter("w is not null")
    )
    scored = rows.groupBy(key).agg(
        F.expr("sum(w)").alias("__sum"),
        F.expr("sqrt(sum(w * w))").alias("__len"),
        *[F.expr(f"sum(w * ln(s{c} + {a}D))").alias(f"__d{j}_{c}") for j, a in enumerate(alphas) for c in classes],
    )
    joined = numbered.join(scored, key, "left").withColumn("__tot", models.totals.select(F.struct("*")).scalar())
    parts = ["__tot.vocab[__m] as __v", *[f"__tot.mass_{c}[__m] as __mass{c}" for c in classes]]
    parts += [f"coalesce(__tot.prior_{c}[__m], double('-infinity')) as __prior{c}" for c in classes]
    joined = joined.selectExpr(*docs.columns, "__sum", "__len", *[c for c in scored.columns if c.startswith("__d")], *parts)

    def choice(j: int, a: float) -> str:
        # the highest score; of equals the first class, as its negated place is the higher
        score = lambda c: f"__prior{c} + coalesce((__d{j}_{c} - __sum * ln(__mass{c} + {a}D * __v)) / __len, 0D)"
        ranked = ", ".join(f"struct({score(c)} as s, {-i} as o, {c} as c)" for i, c in enumerate(classes))
        return f"struct(double({a}) as alpha, array_max(array({ranked})).c as prediction)"

    choices = ", ".join(choice(j, a) for j, a in enumerate(alphas))
    made = joined.selectExpr(*docs.columns, f"explode(array({choices})) as __c").select(
        *docs.columns, "__c.alpha", "__c.prediction"
    )
    with spread(counts.sparkSession, counts.count()):
        return cut(made)


def nb_cross_validate(
    counts: DataFrame, docs: DataFrame, key: str, label: str, fold: str, k: int, alphas: tuple[float, ...] = (1.0,), classes=(0, 1)
) -> DataFrame:
    """Every document predicted by the model that has not seen its fold, for every alpha, in one job."""
    models = nb_fit(counts, docs, key, label, held_out(fold, k), classes)
    return nb_predict(models, counts, docs, key, F.col(fold), alphas)
