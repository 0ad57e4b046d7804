"""Gradient descent of many models at once: one pass over the stored rows and one aggregate a round.

The rows stay where they are. A task sums the gradients of all models over its rows, Spark sums those by chunks of the
parameters, and only the sums, as many numbers as there are parameters, come back. Rows are packed for that (``packed``), so that
a round handles arrays, not single rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from furrow.lineage import cut

Arrays = list[np.ndarray]
#: Numbers in a chunk, the unit that is summed by one reducer.
CHUNK = 1 << 14
#: Rows in a pack at most, packs in a batch.
PACK, PACKS = 1 << 10, 8
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def packed(rows: DataFrame, numbers: list[str], vectors: list[str]) -> DataFrame:
    """The rows, stored in packs: every column is the bytes of its values one after the other, those of ``numbers`` as doubles (NULL
    as NaN); ``vectors`` are binary columns of one length each."""
    names = [*numbers, *vectors]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, PACK):
                part = batch.slice(first, PACK)
                made = [part.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False).tobytes() for c in numbers]
                made += [b"".join(part.column(c).to_pylist()) for c in vectors]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in made], names)

    return cut(rows.select(*names).mapInArrow(pack, ", ".join(f"`{c}` binary" for c in names)))


def summed(rows: DataFrame, gradients: Callable[[pd.DataFrame, Arrays], Arrays], params: Arrays) -> Arrays:
    """The gradients of all rows, which come in batches of ``PACKS``, summed. One job; a table without rows gives zeros."""
    spark = rows.sparkSession
    shared, before = spark.sparkContext.broadcast(params), spark.conf.get(_BATCH)
    size = sum(p.size for p in params)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                own = np.concatenate([g.reshape(-1) for g in gradients(batch, shared.value)])
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"chunk": range(0, size, CHUNK), "part": [total[i : i + CHUNK].tobytes() for i in range(0, size, CHUNK)]})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x) for x in group["part"]]
        return pd.DataFrame({"chunk": group["chunk"].iloc[:1], "part": [np.sum(parts, axis=0).tobytes()]})

    kind = "chunk long, part binary"
    total = np.zeros(size)
    spark.conf.set(_BATCH, str(PACKS))
    try:
        found = rows.mapInPandas(partial, kind).groupBy("chunk").applyInPandas(added, kind).collect()
    finally:
        spark.conf.set(_BATCH, before)
    for row in found:
        part = np.frombuffer(row["part"])
        total[row["chunk"] : row["chunk"] + len(part)] = part
    shared.unpersist()
    ends = np.cumsum([p.size for p in params])
    return [part.reshape(p.shape) for part, p in zip(np.split(total, ends[:-1]), params, strict=True)]


def descend(
    rows: DataFrame,
    gradients: Callable[[pd.DataFrame, Arrays], Arrays],
    finish: Callable[[Arrays, Arrays], Arrays],
    params: Arrays,
    rounds: int,
    rate: float = 0.1,
) -> Arrays:
    """Adam with a rate that falls to zero. ``finish`` turns summed gradients into those of the objective."""
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for i in range(1, rounds + 1):
        grad = finish(summed(rows, gradients, params), params)
        first = [0.9 * m + 0.1 * g for m, g in zip(first, grad, strict=True)]
        second = [0.99 * v + 0.01 * g * g for v, g in zip(second, grad, strict=True)]
        step = rate * min(1.0, 2 * (1 - (i - 1) / rounds))
        params = [
            p - step * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8) for p, m, v in zip(params, first, second, strict=True)
        ]
    return params
