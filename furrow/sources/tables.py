"""Delimited and columnar tables. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from furrow.constants import PREVIEW, SURVEY_COLUMNS, SURVEY_DROP_PATTERN, SURVEY_HEAD_ROWS, SURVEY_LEAD_COLUMNS
from furrow.lineage import cut
from furrow.operators.relational import drop_matching, rename, select_from


MISSING = "NA"


def _missing_as_null(df: DataFrame) -> DataFrame:
    """The study's rule for text: a blank field is empty text, ``NA`` is missing."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    return df.withColumns({c: F.nullif(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit(MISSING)) for c in texts})


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, record) of CSV files whose quoted fields may hold line breaks; a file is read by many tasks.

    ``place`` counts a file's records from 0; records keep their line breaks, empty ones are left out. The reader splits a file into
    blocks of whole lines. Odd numbers of quotes say at which blocks a field is open: counted per block and summed over
    the blocks before. Inside a block the same sum over its lines tells the lines at which records begin. What a
    block holds of a record begun earlier is joined to the last record of the nearest block before it that begins one.

    Windows run over the lines of one block (``spark.sql.files.maxPartitionBytes``) and over the blocks of a file, one row
    each. The records are stored. A quote inside a field must be quoted and doubled, as RFC 4180 has it; files with stray quotes
    need the reader of one task. A field that is never closed runs to the end of its file.
    """
    block = ["file", "start"]
    lines = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'))))
    )
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    held = lines.groupBy(*block).agg(F.sum("quotes").alias("__q"))
    opened = held.select(*block, F.coalesce(F.sum("__q").over(before), F.lit(0)).alias("__before"))

    so_far = Window.partitionBy(*block).orderBy("at")
    quotes = F.col("__before") + F.coalesce(F.sum("quotes").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = lines.join(opened, block).withColumn("__begins", (quotes % 2 == 0).cast("bigint"))
    filled = begun.filter((F.col("__begins") == 0) | ~F.col("value").isin("", "\r"))
    numbered = filled.withColumn("nth", F.sum("__begins").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda e: e["value"]), "\n")
    pieces = cut(numbered.groupBy(*block, "nth").agg(text.alias("text")))

    # the part of a block that belongs to a record of an earlier one has nth 0
    counts = pieces.groupBy(*block).agg(F.max("nth").alias("n"))
    last = F.last(F.when(F.col("n") > 0, F.struct("start", "n")), ignorenulls=True).over(before)
    placed = counts.select(*block, last.alias("__last"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    late = pieces.filter(F.col("nth") == 0).select(*block, "text").join(placed.select(*block, "__last"), block)
    tails = late.groupBy("file", F.col("__last.start").alias("start"), F.col("__last.n").alias("nth")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), F.col("text").alias("t")))), lambda e: e["t"]), "\n").alias("__tail")
    )
    heads = pieces.filter(F.col("nth") > 0).join(placed.select(*block, "__offset"), block).join(tails, [*block, "nth"], "left")
    whole = F.when(F.col("__tail").isNull(), F.col("text")).otherwise(F.concat("text", F.lit("\n"), "__tail"))
    return heads.select("file", (F.col("__offset") + F.col("nth") - 1).alias("place"), F.regexp_replace(whole, "\\r\\z", "").alias("record"))


def _parsed(records: DataFrame, schema: StructType | str) -> DataFrame:
    """The fields of ``records``; what does not fit its type is NULL, as in the readers of files."""
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    return records.select(F.from_csv("record", ddl, {"quote": '"', "escape": '"', "multiLine": "true"}).alias("__row")).select("__row.*")


def read_table(spark: SparkSession, path: str, schema: StructType | str, multiline: bool | str = False) -> DataFrame:
    """CSV with a header. A blank text stays empty text, ``NA`` is NULL; a blank or ``NA`` number is NULL.

    Large files are split over tasks. For quoted line breaks ``multiline="split"`` keeps it so (``quoted_records``, which
    starts a job); ``multiline=True`` reads a file in one task and forgives stray quotes.
    """
    if multiline == "split":
        return _missing_as_null(_parsed(quoted_records(spark, path).filter(F.col("place") > 0), schema))
    read = (
        spark.read.option("header", True)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .schema(schema)
        .csv(path)
    )
    return _missing_as_null(read)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(study_id, year) of a table with the columns id and year."""
    schema = StructType([StructField("id", IntegerType()), StructField("year", IntegerType())])
    return read_table(spark, path, schema).select(F.col("id").alias("study_id"), "year")


def read_survey(
    spark: SparkSession,
    path: str,
    header: list[str],
    response_type: str,
    names: list[str] | None = None,
    head_rows: int = SURVEY_HEAD_ROWS,
    lead_columns: int = SURVEY_LEAD_COLUMNS,
    split: bool = True,
) -> DataFrame:
    """A survey export: ``head_rows`` rows above the data, test entries, leading and helper columns go.

    ``header`` names the columns of the file; blank answers stay empty text, ``NA`` is NULL, and a row goes as a test
    entry only where its response type says so or is missing. A quoted field may hold line breaks: ``quoted_records`` splits
    the files and starts a job; ``split=False`` reads each file in one task, for files with stray quotes.
    """
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(header))])
    if split:
        rows = _parsed(quoted_records(spark, path).filter(F.col("place") >= head_rows), schema)
    else:
        raw = (
            spark.read.option("header", False)
            .option("multiLine", True)
            .option("quote", '"')
            .option("escape", '"')
            .schema(schema)
            .csv(path)
            .select("*", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__id"))
        )
        starts = raw.groupBy("__file").agg(F.min("__id").alias("__start"))
        rows = raw.join(starts, "__file").filter(F.col("__id") - F.col("__start") >= head_rows).drop("__file", "__id", "__start")
    named = rename(_missing_as_null(rows), [f"{n}" for n in header])
    kept = named.filter(F.col(f"`{response_type}`") != PREVIEW)
    answers = drop_matching(select_from(kept, lead_columns + 1), SURVEY_DROP_PATTERN)
    return rename(answers, names or SURVEY_COLUMNS)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write a result; CSV gets a header, no row names, and ``NA`` for NULL."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"').option("nullValue", MISSING)
    writer.format(fmt).save(path)


def write_figure_table(df: DataFrame, folder: str, name: str) -> str:
    """Store the frame behind a figure; returns its path."""
    path = f"{folder}/{name}"
    write_table(df, path)
    return path


def hand_off(df: DataFrame, folder: str, name: str = "water_scarce_farms") -> DataFrame:
    """Store a stage result and go on from the stored table."""
    return df.sparkSession.read.schema(df.schema).parquet(write_figure_table(df, folder, name))
