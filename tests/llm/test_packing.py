import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from furrow.llm import packing

SCHEMA = "doc_id long, text string, piece string, length string"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(packing.public_vocabulary())
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def sound(got, rows, plain, capacity):
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert 0 < r.length <= capacity and r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
    for doc, text in rows:
        own = sorted(by[doc], key=lambda r: r.piece)
        ids = plain(text or "") + [2]
        assert b"".join(bytes(r.ids) for r in own) == np.array(ids, "<u4").tobytes()
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert all(r.length == capacity for r in own[1:])
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= capacity
    return len(seqs)


def test_pieces_ids_and_places(spark, plain):
    hostile = ["", None, "a  b", "a   b\n\n  c \n d", " lead", "trail  ", "<|endoftext|> x", "naïve 'll it's 12 345", "é" * 9000, "\t   x", "I'm \n ok"]
    rows = list(enumerate(hostile + ["word %d of text" % i * (i % 60) for i in range(600)] + ["same text here"] * 200))
    df = spark.createDataFrame([(i, t, "x", None) for i, t in rows], SCHEMA).repartition(7)
    got = packing.pack(df, capacity=128).collect()
    n = sound(got, rows, plain, 128)
    assert n <= 1.02 * sum(r.length for r in got) / 128 + 2


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", "", "")] * 3 + [(None, None, None, None)], SCHEMA)
    got = packing.pack(df).collect()
    assert len(got) == 4 and len({r.offset for r in got}) == 4 and len({r.sequence_id for r in got}) == 1
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("hist", [{}, {1: 1}, {1024: 9}, {600: 5000}, {n: n % 7 for n in range(1, 1025)}, {n: 900 for n in range(300, 700)}])
def test_configurations_hold_everything(hist):
    taken = packing.configurations(hist)
    held = {}
    for config, times in taken:
        assert times > 0 and sum(n * k for n, k in config.items()) <= 1024
        for n, k in config.items():
            held[n] = held.get(n, 0) + k * times
    assert held == {n: k for n, k in hist.items() if k}
    if hist == {n: 900 for n in range(300, 700)}:
        assert sum(t for _, t in taken) <= 1.03 * sum(n * k for n, k in hist.items()) / 1024


def test_word_by_word_is_the_same_as_whole(spark, plain):
    from conftest import SMALL

    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert packing.Ids(packing.public_vocabulary())(texts) == [np.array(plain(t), "<u4").tobytes() for t in texts]


def test_white_space_in_turns(plain):
    import itertools

    runs = ["".join(r) for n in (1, 2, 3, 4, 5) for r in itertools.product(" \n\xa0", repeat=n)]
    runs += [" \t ", "\t ", "\r\n ", " \u3000 \u3000 ", " \x85 ", "\u2009 \u2009"]
    texts = ["foo \xa0 \xa0 bar", *(f"foo{r}bar" for r in runs), *(f"foo{r}" for r in runs), *(f"{r}bar 's" for r in runs), *(f"a{r}b{s}c" for r in runs[:39] for s in runs[:39])]
    ids = packing.Ids(packing.public_vocabulary())
    for _ in range(2):
        assert ids(texts) == [np.array(plain(t), "<u4").tobytes() for t in texts]
