import zlib

import pytest
import xxhash

from furrow.llm import sharding
from furrow.llm.queries import QUERIES


def shards_of(spark, rows, n, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, lang string")
    return sharding.shard(df, n, **more).collect()


def sound(got, rows, n):
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted((r[0] or 0, r[1] or "") for r in rows)
    for r in got:
        assert r["size"] == len((r.text or "").encode()) + 16 and r.law == "bytes" and 0 <= r.shard < n
    for k in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("more", [{}, {"run_rows": 20}])
def test_bytes_are_near_equal_with_a_hot_group(spark, more):
    rows = [(i, ("x%d " % i) * (i % 40), "?", "en") for i in range(2000)] + [(5000 + i, "same text " * 30, "?", "en") for i in range(900)]
    got = shards_of(spark, rows, 8, **more)
    sound(got, rows, 8)
    sizes = [sum(r["size"] for r in got if r.shard == k) for k in range(8)]
    assert max(sizes) - min(sizes) < 0.03 * sum(sizes) / 8


def test_small_groups_stay_together(spark):
    rows = [(i, "text %d" % (i // 3), "?", "en") for i in range(3000)]
    got = shards_of(spark, rows, 4, tolerance=0.02)
    sound(got, rows, 4)
    assert len({(r.text, r.shard) for r in got}) == 1000


def test_nulls_empty_long_and_repeated_rows(spark):
    rows = [(None, None, None, None), (1, "", None, "en"), (1, "", None, "en"), (2, "é" * 100_000, "x", None), (None, "a", "", "")]
    sound(shards_of(spark, rows, 3), rows, 3)
    assert shards_of(spark, [], 3) == []


def test_query_is_a_sort_of_all_keys_cut_at_equal_bytes(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op9_shard"](spark, folder).collect()}
    assert got.keys() == texts.keys()
    for k, r in got.items():
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(texts[k]) + 16, zlib.crc32(texts[k]), "bytes", None)
    for k in range(40):
        slots = sorted(r.slot for r in got.values() if r.shard == k)
        assert slots == list(range(len(slots)))
    order = sorted(texts, key=lambda k: (xxhash.xxh64(texts[k], seed=42).intdigest() >> 1, k))
    shards = [got[k].shard for k in order]
    assert shards == sorted(shards) and set(shards) <= set(range(40))
    total, largest = sum(r["size"] for r in got.values()), max(r["size"] for r in got.values())
    for i in range(1, 40):
        below = sum(got[k]["size"] for k, s in zip(order, shards, strict=True) if s < i)
        assert abs(below - i * total / 40) <= largest
