import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from furrow.llm import suffix
from furrow.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, raw string, spans string"


def brute(raws, length):
    """Removed flags by counting every string."""
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i] += 1
                gone[min(i + length, len(r))] -= 1
        out.append(np.cumsum(gone)[:-1] > 0)
    return out


def test_suffix_array_and_common_prefixes():
    rng = random.Random(4)
    for alphabet in (b"a", b"ab", bytes(range(97, 107))):
        data = bytes(rng.choice(alphabet) for _ in range(700)) + b"\xff\x01\x02\x03\x04\x05\x06\x07"
        order = suffix.suffix_array(np.frombuffer(data, np.uint8))
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        want = [0] + [common(data[i:], data[j:]) for i, j in zip(order, order[1:])]
        assert suffix.common_prefixes(np.frombuffer(data, np.uint8), order)[1:].tolist() == want[1:]


@pytest.mark.parametrize("crowd", [150, 3])
def test_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    monkeypatch.setattr(suffix, "SHARD", 20)
    monkeypatch.setattr(suffix, "MERGE", 60)
    monkeypatch.setattr(suffix, "CHUNK", 700)
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [text(n) for n in (60, 45, 90, 39, 40, 41)]
    rows = [(i, text(rng.randrange(90)) + rng.choice(passages) + text(rng.randrange(60)) + rng.choice(passages) + text(rng.randrange(5)), "", "") for i in range(120)]
    rows += [(200, "ab" * 300, "", ""), (201, "x" * 55, "", ""), (202, None, None, None), (203, "", "", ""), (204, text(2000), "", ""), (205, text(30), "", ""), (206, text(30), "", "")]
    rows += [(300 + i, rows[3][1], "", "") for i in range(5)] + [rows[7]] * 3 + [(None, text(50), None, None)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, SCHEMA), length=40, seed=9).collect()
    raws = [(r[1] or "").encode() for r in rows]
    want = Counter((rows[i][0], raws[i], bytes(b for b, g in zip(raws[i], gone) if not g), int((np.diff(gone.astype(int), prepend=0) == 1).sum())) for i, gone in enumerate(brute(raws, 40)))
    assert Counter((r.doc_id, bytes(r.raw), bytes(r.remaining), len(r.spans)) for r in got) == want


@pytest.mark.parametrize("chunk", [1 << 19, 300])
def test_passages_in_words_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    monkeypatch.setattr(suffix, "SHARD", 20)
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice(["a", "bé", "cde", "to", "in"]) + rng.choice([" ", " ", "\n", " \t"]) for _ in range(n))
    passages = [say(n) for n in (9, 7, 8, 14)]  # all under 120 bytes
    rows = [(i, say(rng.randrange(30)) + rng.choice(passages) + say(rng.randrange(20)), "", "") for i in range(60)]
    rows += [(100, " ".join(passages[3].split()), "", ""), (101, "to " * 12, "", ""), (102, None, None, None), (103, "  ", "", ""), (104, "x" * 300, "", ""), (105, "x" * 200, "", "")]
    got = {r.doc_id: r for r in suffix.remove_repeats(spark.createDataFrame(rows, SCHEMA), length=120, seed=48, words=8).collect()}
    flags = brute([(r[1] or "").encode() for r in rows], 120)
    own = [[(m.start(), m.end()) for m in re.finditer(rb"[^ \t\n]+", (r[1] or "").encode())] for r in rows]
    said = [tuple((r[1] or "").split()) for r in rows]
    seen = Counter(w[i : i + 8] for w in said for i in range(len(w) - 7))
    for row, gone, places, w in zip(rows, flags, own, said, strict=True):
        raw = (row[1] or "").encode()
        for i in range(len(w) - 7):
            if seen[w[i : i + 8]] > 1:
                gone[places[i][0] : places[i + 7][1]] = True
        assert bytes(got[row[0]].remaining) == bytes(b for b, g in zip(raw, gone, strict=True) if not g), row[0]
    assert got[104].spans and got[101].spans and len(got) == len(rows)


def test_passages_apart_stay_in_the_text(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["a", "bé", "cde", "to", "in"]) for _ in range(n))
    passages = [say(n) for n in (9, 7, 8)]
    rows = [(i, say(rng.randrange(30)) + "\n" + rng.choice(passages) + "  " + say(rng.randrange(20)), "", "") for i in range(60)]
    rows += [(100, "x" * 300, "", ""), (101, None, None, None), (102, rows[5][1], "", "")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("passages", F.lit(1))
    plain = {r.doc_id: r for r in suffix.remove_repeats(docs, length=120, seed=48).collect()}
    got = {r.doc_id: r for r in suffix.remove_repeats(docs, length=120, seed=48, words=8, apart=True).collect()}
    said = [(r[1] or "").split() for r in rows]
    seen = Counter(tuple(w[i : i + 8]) for w in said for i in range(len(w) - 7))
    assert len(got) == len(rows) and plain[0].passages == 1
    for row, w in zip(rows, said, strict=True):
        raw, gone = (row[1] or "").encode(), np.zeros(len((row[1] or "").encode()), bool)
        places = [(m.start(), m.end()) for m in re.finditer(rb"[^ \n]+", raw)]
        for i in range(len(w) - 7):
            if seen[tuple(w[i : i + 8])] > 1:
                gone[places[i][0] : places[i + 7][1]] = True
        at = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(int))).reshape(-1, 2).tolist()
        assert [list(p) for p in got[row[0]].passages] == at, row[0]
        assert got[row[0]].spans == plain[row[0]].spans and got[row[0]].remaining == plain[row[0]].remaining


def test_stretches_that_may_share_a_string():
    rng = random.Random(3)
    text = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    for seed, length in ((6, 21), (6, 40), (5, 7), (6, 6)):
        for _ in range(100):
            middle, texts, gaps = text(seed), [], []
            near = text(length - seed), text(length - seed)
            for _ in range(6):
                left, right = ((rng.choice([own, text(len(own))])) for own in near)
                lo, hi = rng.randrange(length - seed + 1), rng.randrange(length - seed + 1)
                lo = max(lo, length - seed - hi)
                texts.append(left[len(left) - lo :] + middle + right[:hi])
                gaps.append(lo)
            around = [{(g - i, t[i : i + length]) for i in range(len(t) - length + 1) if i <= g <= i + length - seed} for t, g in zip(texts, gaps, strict=True)]
            flags = suffix.alike(texts, np.array(gaps), length, seed)
            for i, own in enumerate(around):
                assert flags[i] or not any(own & other for j, other in enumerate(around) if j != i)
    apart = [text(300) + b"the same seed" + text(300) for _ in range(5)]
    assert not suffix.alike(apart, np.full(5, 300), 400, 13).any()


def test_query_tells_of_passages_of_fewer_bytes(spark, tmp_path):
    rng = random.Random(2)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    passage = " ".join(w[:5] for w in say(54).split())
    rows = [(1, f"{say(40)} {passage} {say(30)}"), (2, f"{say(9)}\n{passage}"), (3, say(90)), (4, None), (5, passage.replace(" ", " x ", 1) + say(20))]
    assert len(passage.encode()) < 400
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op10_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert {d: (r.has_passage, r.n_passages) for d, r in got.items()} == {1: (True, 1), 2: (True, 1), 3: (False, 0), 4: (False, 0), 5: (True, 1)}
    assert not any(r.n_removed or r.n_spans or r.touched for r in got.values())


def test_empty_table(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_on_a_table(spark):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = {d: bytes(b for b, g in zip(r, gone) if not g) for (d, r), gone in zip(rows, brute([r for _, r in rows], 400))}
    got = QUERIES["op10_suffix_dedup"](spark, SMALL).collect()
    assert len(got) == len(rows) and any(r.n_removed for r in got)
    for r in got:
        assert r.kept_sha256 == hashlib.sha256(want[r.doc_id]).hexdigest() and r.n_bytes - r.n_removed == len(want[r.doc_id])
