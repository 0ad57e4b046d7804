"""Storing a frame once: Parquet in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: Rows and bytes of a shuffle partition at most, on average, in jobs that are ``spread``.
ROWS, BYTES = 500_000, 8 << 20
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. A local session without one gets a folder of its own,
    removed at exit; on a cluster a missing setting is an error, as a machine-local folder would be
    lost with its machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is not None:
        return named
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    key = context.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = tempfile.mkdtemp(prefix="furrow-store-")
        atexit.register(shutil.rmtree, _LOCAL[key], ignore_errors=True)
    return _LOCAL[key]


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, now, and go on from the stored columns.

    The rows are Parquet files, so later scans are pruned, filters reach them, and their size is known
    to the planner. A lost executor costs nothing: the files are in the shared folder. ``release`` deletes
    them when the frame is no longer read. What the job shuffled is deleted when the rows are stored: nothing reads it again,
    and Spark would keep it until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    plain = df.select(*(F.col(f"`{c}`").cast("string").alias(c) if t == "void" else F.col(f"`{c}`") for c, t in df.dtypes))
    path = f"{shared_folder(spark).rstrip('/')}/furrow-{uuid.uuid4().hex}"
    with tidy(spark):
        plain.write.parquet(path)
    stored = spark.read.schema(plain.schema).parquet(path)
    stored.stored_path = path
    return stored


def release(df: DataFrame) -> None:
    """Delete what ``cut`` stored for this frame. Nothing may read it afterwards."""
    path = getattr(df, "stored_path", None)
    if path is not None:
        jvm = df.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Each query that runs inside deletes its shuffle files at its end. The session's own setting comes back."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_TIDY)
        else:
            spark.conf.set(_TIDY, before)


@contextmanager
def spread(spark: SparkSession, rows: int) -> Iterator[None]:
    """The jobs run inside shuffle into partitions for ``ROWS`` of so many rows each, at least as many as the session has, and AQE
    joins them up to ``BYTES`` only. So what a task sorts or counts does not grow with the input. The session's settings come back."""
    parts, size = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = {parts: spark.conf.get(parts), size: spark.conf.get(size)}
    spark.conf.set(parts, str(max(int(before[parts]), rows // ROWS + 1)))
    spark.conf.set(size, f"{BYTES}b")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
