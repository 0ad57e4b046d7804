"""Labelled text, term counts and TF-IDF weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.constants import MIN_ABSTRACT_LENGTH
from furrow.functions.text import before, min_length, strip_literal, tokens
from furrow.lineage import cut, release
from furrow.operators.relational import tag

#: Bytes of text whose terms are counted by one task, on average.
TEXT = 4 << 20


def corpus(positive: DataFrame, negative: DataFrame, label: str = "label") -> DataFrame:
    """Included and excluded sources in one frame, labelled 1 and 0."""
    return tag(positive, **{label: 1}).unionByName(tag(negative, **{label: 0}))


def clean_text(df: DataFrame, col: str = "text", longer_than: int = MIN_ABSTRACT_LENGTH) -> DataFrame:
    """Strip the marker, cut at the first ``#``, keep texts longer than the limit, lower-case. One stage."""
    cut = before(strip_literal(col, "Abstract: "), "#")
    return df.withColumn(col, cut).filter(min_length(col, longer_than)).withColumn(col, F.lower(col))


def term_counts(df: DataFrame, key: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(key, term, tf). One job sums the lengths of the texts.

    The texts are shuffled by key before they are split: a text is a fraction of its term rows, the
    counting then needs no shuffle of its own, and a few large input files still feed every task. There are as many
    tasks as the texts' bytes ask for, so the terms that one of them counts do not grow with the input.
    """
    carry = carry or []
    size = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, size // TEXT + 1)
    words = df.select(key, *carry, text).repartition(tasks, key).select(key, *carry, F.explode(tokens(text)).alias("term"))
    return words.groupBy(key, *carry, "term").agg(F.count(F.lit(1)).alias("tf"))


def counted(texts: DataFrame, key: str, keep: list[str], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key and ``keep`` columns, term counts) of a corpus, both checkpointed.

    Fitting and scoring read them many times, the texts themselves only here: they are found once, stored, and deleted again.
    """
    stored = cut(texts.select(key, *[c for c in keep if c != key], text))
    made = cut(stored.select(key, *keep)), cut(term_counts(stored, key, text))
    release(stored)
    return made


def smooth_idf(n, df):
    """Smoothed inverse document frequency."""
    return F.log((F.lit(1.0) + n) / (F.lit(1.0) + df)) + F.lit(1.0)


def raw_weights(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """``counts`` with ``__raw``, tf x smoothed idf.

    ``docs`` gives the number of documents, those without terms included. The idf side of the join is
    one row per term, spread evenly by hash: it is the build side, so the term rows are not sorted,
    and AQE can split a term that occurs everywhere. ``counts`` is read twice: hand in a stored one (``counted``).
    """
    total = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    frequency = counts.groupBy("term").agg(F.count(F.lit(1)).alias("__df")).hint("shuffle_hash")
    return counts.join(frequency, "term").withColumn("__raw", F.col("tf") * smooth_idf(total, F.col("__df")))


def tfidf(counts: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(key, term, tf, weight): tf x smoothed idf (``raw_weights``), each document scaled to length 1.

    The length is a window over the terms of one document.
    """
    length = F.sqrt(F.sum(F.col("__raw") * F.col("__raw")).over(Window.partitionBy(key)))
    return raw_weights(counts, docs).select(key, "term", "tf", (F.col("__raw") / length).alias("weight"))


def weighted_features(counts: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(key, slots, values): the ``tfidf`` weights of each document, slots as in ``hashed_features``, in no order. One shuffle by
    document, and no sort of the term rows."""
    cells = F.collect_list(F.struct(F.xxhash64("term").alias("slot"), F.col("__raw").alias("v"))).alias("f")
    length = F.sqrt(F.sum(F.col("__raw") * F.col("__raw"))).alias("length")
    packed = raw_weights(counts, docs).select(key, "term", "__raw").repartition(key).groupBy(key).agg(cells, length)
    return packed.select(key, F.col("f.slot").alias("slots"), F.transform("f", lambda e: e["v"] / F.col("length")).alias("values"))


def hashed_features(counts: DataFrame, key: str, dims: int | None = None, by_weight: bool = False) -> DataFrame:
    """(key, slots, values): term counts or weights of each document, its length 1.

    A slot is a 64-bit hash of the term, so every term has its own, however many there are; with ``dims`` terms share that many.
    """
    amount = F.col("weight") if by_weight else F.col("tf").cast("double")
    slot = F.xxhash64("term") if dims is None else (F.crc32(F.col("term").cast("binary")) % dims).cast("int")
    slots = counts.groupBy(key, slot.alias("slot")).agg(F.sum(amount).alias("v"))
    packed = slots.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("slot", "v"))).alias("f"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length")
    )
    return packed.select(key, F.col("f.slot").alias("slots"), F.transform("f", lambda e: e["v"] / F.col("length")).alias("values"))


def with_features(docs: DataFrame, hashed: DataFrame, key: str) -> DataFrame:
    """Attach hashed features; a document without terms keeps its row with empty ones."""
    joined = docs.join(hashed, key, "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(dict(hashed.dtypes)[c])).alias(c)
    return joined.select(*docs.columns, empty("slots"), empty("values"))


def telling_terms(counts: DataFrame, docs: DataFrame, key: str, most: int, label: str = "label") -> DataFrame:
    """(term, slot): the ``most`` terms of the highest chi-squared against a label of 1 or 0, numbered from 0.

    From document frequencies per (term, label), one shuffle by term; the cut is a distributed top-k. ``docs`` are
    the documents to learn from.
    """
    marked = counts.join(docs.select(key, F.col(label).cast("double").alias("__y")), key)
    held = marked.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("h"), F.sum("__y").alias("a"))
    sizes = docs.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("p")).first()
    n, p = float(sizes["n"]), float(sizes["p"] or 0)
    a, h = F.col("a"), F.col("h")
    gap = F.lit(n) * a - F.lit(p) * h
    spread = h * (F.lit(n) - h) * F.lit(p) * F.lit(n - p)
    ranked = held.select("term", F.coalesce(F.lit(n) * gap * gap / F.nullif(spread, F.lit(0.0)), F.lit(0.0)).alias("chi"))
    few = ranked.orderBy(F.round("chi", 9).desc(), "term").limit(most)
    # as many rows as are asked for
    return cut(few.select("term", (F.row_number().over(Window.orderBy(F.round("chi", 9).desc(), "term")) - 1).alias("slot")))


def term_columns(weights: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(key, slots, values) of the numbered terms alone."""
    own = weights.join(terms, "term")
    return own.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("slot", "weight"))).alias("f")).select(
        key, F.col("f.slot").alias("slots"), F.col("f.weight").alias("values")
    )


def unit_cells(counts: DataFrame, key: str) -> DataFrame:
    """(key, term, v): term counts of each document, its length 1."""
    length = F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy(key)))
    return counts.select(key, "term", (F.col("tf") / length).alias("v"))
