from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from furrow.llm import merkle, queries
from oracle import compare, duck


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return H(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def fold_up(nodes):
    while len(nodes) > 1:
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0]


def proof(nodes, i):
    out = []
    while len(nodes) > 1:
        run = nodes[i - i % 16 : i - i % 16 + 16]
        out += [d for j, d in enumerate(run) if j != i % 16]
        nodes, i = [H(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)], i // 16
    return out


def brute(rows, changed):
    """rows: (key, group, text). Leaves of a group in key order, equal keys by leaf."""
    groups = {}
    for k, g, t in rows:
        groups.setdefault(g, []).append((k is not None, k or 0, leaf(k, g, t), k, t))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    groups = {g: sorted(groups[g]) for g in order}
    subs = [fold_up([x[2] for x in groups[g]]) for g in order]
    root, out = fold_up(subs), []
    for s, g in enumerate(order):
        own = [x[2] for x in groups[g]]
        for i, (_, _, d, k, t) in enumerate(groups[g]):
            now = list(own)
            now[i] = leaf(k, g, t.lower()) if changed(k) and t is not None else d
            folded = fold_up([fold_up(now) if j == s else x for j, x in enumerate(subs)])
            out.append((k, d, subs[s], root, H(*proof(own, i), *proof(subs, s)), folded, folded == root))
    return out


def made(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "k long, g string, t string, _key string, leaf string")
    found = merkle.manifest(df, ["k", "g", "t"], "k", "g", {"t": F.lower("t")}, F.col("k") % 3 == 0)
    return found


COLUMNS = ["k", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_against_a_plain_tree_for_any_block(spark, monkeypatch, levels):
    """With blocks of 16 and 256 leaves the tree of the hot group goes through several tiers."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 16**levels)
    rows = [(i * 7 % 701, "hot", f"Text {i % 50}") for i in range(700)] + [(i, f"g{i % 21}", "Ab") for i in range(60)]
    rows += [(5, "one", None), (None, "one", ""), (9, None, "É ABC"), (9, None, "É ABC"), (9, None, "other"), (12, "￿", "plain"), (12, "\U0001f600", "Q")]
    got = made(spark, rows).select(*COLUMNS).collect()
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, lambda k: k is not None and k % 3 == 0), key=key)


def test_versions_share_all_but_the_path(spark):
    rows = [(i, "s", f"T{i}") for i in range(40)]
    own = {r.k: r for r in made(spark, rows).collect()}
    assert all(len(r.copied) == 3 and r.copied[-1] == r.folded_root for r in own.values())
    assert own[3].copied[0] != own[3].leaf and own[4].copied[0] == own[4].leaf and own[4].copied[-1] == own[4].root


def test_lone_rows_and_empty_tables(spark):
    (row,) = made(spark, [(1, "s", "a")]).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == H()
    assert made(spark, []).collect() == []


def test_query_agrees_with_sql(spark):
    assert compare(queries.op11_merkle(spark, SMALL), duck(SMALL), queries.SQL["op11_merkle"]) is None
