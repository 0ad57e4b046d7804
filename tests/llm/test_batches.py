import os
import random
import tracemalloc
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from furrow.llm import decontam, minhash
from furrow.llm.batches import frugal


def resident():
    return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGESIZE") / 1e6


@pytest.mark.skipif(not Path("/proc/self/statm").exists(), reason="needs Linux's process files")
@pytest.mark.parametrize("batched", [True, False])
def test_freed_memory_goes_back(batched):
    kept = []

    def work(_):
        parts = [b"%d" % i * 20_000 for i in range(1000, 3000)]  # 160 MB in pieces that are not mapped one by one
        kept.append(b"kept" * 20_000)  # above them, so that the heap can't just end lower
        return len(parts)

    def works(batches):
        for batch in batches:
            yield work(batch)

    before = resident()
    assert (list(frugal(works)(iter([1]))) if batched else [frugal(work)(1)]) == [2000]
    assert resident() < before + 60


def test_frugal_functions_of_spark(spark):
    @F.pandas_udf("long")
    @frugal
    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.str.len()

    @F.pandas_udf("long")
    @frugal
    def twice(n: pd.Series) -> pd.Series:
        return 2 * n

    made = spark.createDataFrame([("a",), ("bcd",)], "t string").select(twice(sizes("t")).alias("n"))
    assert sorted(r.n for r in made.collect()) == [2, 6]


@pytest.mark.parametrize("space", [minhash._SPACE, decontam._BETWEEN])
def test_word_hashes_are_power_sums(space):
    rng = random.Random(1)
    texts = ["", " ", "Word", "".join(rng.choice("aB \n\t-é1") for _ in range(3 * minhash.STEP + 17)), "x" * (minhash.STEP + 1), "end "]
    want, counts = [], []
    for t in texts:
        words = "".join(chr(b) if not space[b] else "\0" for b in t.lower().encode()).split("\0")
        words = [w.encode("latin-1") for w in words if w]
        counts.append(len(words))
        want += [sum(int(minhash._BYTE[b]) * pow(minhash._PRIME, i, 2**64) for i, b in enumerate(w)) % 2**64 for w in words]
    made, n = minhash.word_hashes(texts, space)
    assert made.tolist() == minhash.mixed(np.array(want, np.uint64)).tolist() and n.tolist() == counts


def test_word_hashes_hold_few_numbers_a_byte():
    texts = ["word " * 200_000] * 4
    tracemalloc.start()
    minhash.word_hashes(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 36 * sum(map(len, texts))


def test_terms_are_found_by_their_first_bits():
    rng = np.random.default_rng(2)
    close = (np.uint64(7) << np.uint64(48)) + np.arange(40, dtype=np.uint64)
    terms = np.unique(np.concatenate([rng.integers(0, 2**64, 500, np.uint64), close, np.array([0, 2**64 - 1], np.uint64)]))
    word = rng.permutation(np.concatenate([terms, terms + np.uint64(1), rng.integers(0, 2**64, 500, np.uint64)]))
    where = {t: i for i, t in enumerate(terms.tolist())}
    assert decontam.Index([], [], terms).find(word).tolist() == [where.get(w, -1) for w in word.tolist()]
    assert decontam.Index([], [], terms[:0]).find(word).tolist() == [-1] * len(word)
