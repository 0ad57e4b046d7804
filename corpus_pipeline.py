"""From documents to packed training sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of ``docs``. A stage
works on everything its predecessor kept, and what it decides is in what it returns.

In every stage a NULL text counts as empty and is kept by the filters (all empty texts are copies of each other for near_dedup),
rows with a NULL id or repeated rows are rows like others, an empty table gives no rows, and extra columns of any name
come back as they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from furrow.lineage import cut, release
from furrow.llm import decontam, minhash, packing, suffix, toxicity
from furrow.llm.batches import frugal

TOXIC = 0.7
#: A passage of so many words that occurs elsewhere goes, however few its bytes.
WORDS = 50


READ = ("doc_id", "text", "n_chars")


def _apart(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns that no stage reads under names that no operator uses."""
    return docs.withColumnsRenamed({c: f"__own{i}" for i, c in enumerate(docs.columns) if c not in READ})


def _columns(made: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return made.select(*(F.col(f"`{c}`" if c in READ else f"__own{i}").alias(c) for i, c in enumerate(docs.columns)))


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The classifier learns from the labelled ones, at most ``toxicity.LABELLED``."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _columns(toxicity.score(_apart(docs), model, into="_toxicity").filter(F.col("_toxicity") < TOXIC), docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    return _columns(minhash.representatives(_apart(docs)), docs)


@F.pandas_udf(StringType())
@frugal
def _whole_characters(remaining: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Bytes as text; what is left of a character cut through goes."""
    for batch in remaining:
        yield batch.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or of 400 bytes and more that occur elsewhere go from the texts; every document stays, and
    ``n_chars`` counts what is left. A text that loses nothing is as before."""
    made = suffix.remove_repeats(_apart(docs), words=WORDS)
    left = F.when(F.size("spans") > 0, _whole_characters(F.when(F.size("spans") > 0, F.col("remaining")))).otherwise(F.col("text"))
    made = made.withColumn("_left", left)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        made = made.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("_left").cast(kind)).otherwise(F.col("n_chars")))
    return _columns(made.withColumn("text", F.col("_left")), docs)


def leaked_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    made = decontam.with_leaks(_apart(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into="_leaks")
    return _columns(made.filter(F.size("_leaks") == 0), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes."""
    return packing.pack(_apart(docs), keep_ids=False)


STAGES = [
    ("toxicity", toxic_out),
    ("near_dedup", near_copies_out),
    ("suffix_dedup", repeats_out),
    ("decontaminate", leaked_out),
    ("pack", packed),
]

#: Classifiers, hashing and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
