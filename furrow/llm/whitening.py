"""Whitening of vectors by principal components, with MLlib's distributed block matrices.

Centred rows are indexed into row blocks; the transposed matrix times the matrix gives the scatter, whose partial
products are made and summed in many tasks; the eigenvectors of that small matrix are found on the driver, and a
second block product projects the rows. All row work is in the JVM.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.lineage import cut
from furrow.operators.ordering import numbered

#: Rows and columns of a block; blocks that one task multiplies and sums.
ROWS, COLS, TOGETHER = 1024, 1024, 16
#: Entries must be smaller than this, so that they are whole numbers after scaling.
LARGEST = float(1 << 42)


def usable(vector: Column) -> Column:
    """No NULL vector, no NULL, NaN or infinite entry."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(fine(c), F.lit(False))), F.lit(False))


def whole_numbers(vector: Column, scale: int, shift: int) -> Column:
    def one(c: Column) -> Column:
        c = c.cast("double")
        return F.when(F.abs(c) < LARGEST, F.floor(c * scale).cast("long") + shift).otherwise(F.raise_error(F.lit("a vector's entry is too large")).cast("long"))

    return F.transform(vector, one)


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def blocks(rows: DataFrame, index: str, vector: str, n: int, dims: int) -> BlockMatrix:
    """Rows with an index and an array as a block matrix, without Python objects."""
    indexed = MLUtils.convertVectorColumnsFromML(rows.select(F.col(index).alias("index"), array_to_vector(F.col(vector)).alias("vector")), "vector")
    return IndexedRowMatrix(indexed, n, dims).toBlockMatrix(ROWS, min(COLS, dims))


def scatter(m: BlockMatrix) -> np.ndarray:
    """Transposed matrix times matrix. The row blocks are dealt to many tasks, each of which sums its products."""
    split = max(1, m.numRowBlocks // TOGETHER)
    turned = m.transpose()._java_matrix_wrapper
    made = BlockMatrix(turned.call("multiply", m._java_matrix_wrapper._java_model, split), m.colsPerBlock, m.colsPerBlock)
    return made.toLocalMatrix().toArray()


def projected(m: BlockMatrix, weights: np.ndarray) -> DataFrame:
    """(index, vector): the matrix times a small one."""
    step, wide = m.colsPerBlock, weights.shape[1]
    parts = [((i, 0), DenseMatrix(len(w), wide, w.T.reshape(-1))) for i in range(m.numColBlocks) for w in [weights[i * step : (i + 1) * step]]]
    local = BlockMatrix(m.blocks.context.parallelize(parts, 1), step, wide, len(weights), wide)
    rows = m.multiply(local).toIndexedRowMatrix()
    return callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model)


def components_of(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues falling, and their unit vectors as columns; the sign puts each vector's largest entry above 0."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """One row per usable vector and component: ``key``, ``component`` (from 1, by falling variance), ``n`` vectors,
    ``deviation`` (exact sum of squares of n * x - S; decimal where a long could not hold it), ``whitened``, ``explained``
    (share of all variance) and ``identity_error`` (of the covariance of all that is whitened).

    Vectors that are NULL or hold NULL, NaN or infinite entries are left out, and so are those whose length is not the most
    frequent one (of equals, the longer); an entry of ``LARGEST`` or more fails. A component without variance has NULL in
    ``whitened`` and no part in the error; without any variance ``explained`` is NULL. Repeated rows are rows of their own; an
    empty table gives no rows. Other columns are not read. The driver holds one dims x dims matrix and the
    indices of the blocks. Starts jobs.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{vector}`").alias("_v")).filter(usable(F.col("_v")) & (F.size("_v") > 0))
    common = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = common["d"] if common else 1
    stored, n = numbered(rows.filter(F.size("_v") == dims).select("_key", whole_numbers(F.col("_v"), scale, shift).alias("_x")), "_index")
    if not n:
        kind = dict(vectors.dtypes)[key]
        return spark.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    cells = stored.select(F.posexplode("_x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), (F.max("x") - F.min("x")).alias("r"))
    sums = sorted(cells.collect())
    spread = n * max(r["r"] for r in sums)
    kind = "long" if dims * spread * spread < 1 << 63 else "decimal(38,0)"
    offs = F.zip_with("_x", _longs([r["s"] for r in sums]), lambda x, s: x * n - s)
    square = lambda total, e: (total + e.cast(kind) * e.cast(kind)).cast(kind)
    centred = stored.withColumn("_off", offs).select("_index", F.transform("_off", lambda e: e / F.lit(float(n))).alias("_c"))

    covariance = scatter(blocks(centred, "_index", "_c", n, dims)) / n
    values, units = components_of(covariance, components)
    trace = float(np.trace(covariance))
    live = values > max(trace, 0) * dims * np.finfo(float).eps
    weights = np.where(live, units / np.sqrt(np.where(live, values, 1)), 0)
    made = projected(blocks(centred, "_index", "_c", n, dims), weights)
    made = cut(made.select(F.col("index").alias("_index"), vector_to_array("vector").alias("_w")))

    use = np.flatnonzero(live).tolist()
    pairs = [(i, j) for i in use for j in use if j <= i]
    error = F.lit(None).cast("double")
    if pairs:
        found = made.agg(*[F.covar_pop(F.get("_w", F.lit(i)), F.get("_w", F.lit(j))) for i, j in pairs]).first()
        error = F.lit(max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True)))
    shares = F.array(*[F.lit(float(v) / trace if trace > 0 else None).cast("double") for v in values])
    alive = F.array(*[F.lit(bool(x)) for x in live])
    rows = stored.select("_key", "_index", F.aggregate(offs, F.lit(0).cast(kind), square).alias("_deviation")).join(made, "_index")
    return rows.select("_key", "_deviation", F.posexplode("_w").alias("_i", "_value")).select(
        F.col("_key").alias(key),
        (F.col("_i") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.col("_deviation").alias("deviation"),
        F.when(F.get(alive, F.col("_i")), F.col("_value")).alias("whitened"),
        F.get(shares, F.col("_i")).alias("explained"),
        error.alias("identity_error"),
    )
