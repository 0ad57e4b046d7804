import numpy as np
import pytest

from conftest import SMALL
from furrow.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, n int, _x string, component string"


def brute(vectors, scale=1024, shift=100_000, most=8):
    x = np.floor(np.array(vectors, np.float32).astype(float) * scale).astype(object) + shift
    x = np.array([[int(v) for v in row] for row in x], object)
    n = len(x)
    off = n * x - x.sum(axis=0)
    c = off.astype(float) / n
    values, units = np.linalg.eigh(c.T @ c / n)
    values, units = values[::-1][:most], units[:, ::-1][:, :most]
    return (off * off).sum(axis=1), c @ units / np.sqrt(values), values / np.trace(c.T @ c / n)


def check(rows, vectors, ids):
    deviation, white, share = brute(vectors)
    wide = white.shape[1]
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(got) == len(vectors) * wide
    for j in range(wide):
        own = np.array([got[v, j + 1].whitened for v in ids])
        sign = np.sign(own @ white[:, j])
        assert np.abs(own - sign * white[:, j]).max() < 1e-8
        assert all(got[v, j + 1].explained == pytest.approx(share[j], rel=1e-9) for v in ids)
    assert [int(got[v, 1].deviation) for v in ids] == [int(d) for d in deviation]
    assert all(r.n == len(vectors) and r.identity_error < 1e-9 for r in rows)


@pytest.mark.parametrize("rows, cols, together", [(1024, 1024, 16), (8, 3, 2)])
def test_against_numpy_for_any_blocks(spark, monkeypatch, rows, cols, together):
    for name, value in (("ROWS", rows), ("COLS", cols), ("TOGETHER", together)):
        monkeypatch.setattr(whitening, name, value)
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(90, 10)) * np.arange(1, 11) + 5).astype(np.float32)
    good[40:60] = good[0]  # a third or so are one vector
    bad = [None, [], [1.0] * 9 + [None], [float("nan")] * 10, [float("inf")] + [0.0] * 9, [1.0] * 4]
    table = [(i, [float(v) for v in row], i, "a", "b") for i, row in enumerate(good)] + [(100 + i, b, 0, "a", "b") for i, b in enumerate(bad)]
    made = whitening.whiten(spark.createDataFrame(table, SCHEMA)).collect()
    check(made, good, list(range(90)))


def test_repeated_rows_few_dimensions_and_no_variance(spark):
    rows = [(1, [1.0, 2.0, 7.0], 0, "", ""), (1, [1.0, 2.0, 7.0], 0, "", ""), (2, [3.0, 2.0, 7.0], 0, "", ""), (None, [5.0, 2.0, 7.0], 0, "", "")]
    made = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(made) == 12 and [r.component for r in made if r.vec_id is None] in ([1, 2, 3],)
    assert all((r.whitened is None) == (r.component > 1) for r in made)
    assert [r.explained for r in made if r.vec_id == 2] == pytest.approx([1, 0, 0]) and made[0].identity_error < 1e-9
    same = whitening.whiten(spark.createDataFrame(rows[:2], SCHEMA)).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in same)


def test_empty(spark):
    made = whitening.whiten(spark.createDataFrame([(1, None, 0, "", "")], SCHEMA))
    assert made.collect() == [] and made.columns[:4] == ["vec_id", "component", "n", "deviation"]


def test_deviation_beyond_a_long_is_exact(spark):
    rows = [(i, [float(1 << 39) * (i % 2), 1.0], 0, "", "") for i in range(40)]
    made = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    spread = (40 * (1024 << 39) - 20 * (1024 << 39)) ** 2
    assert {int(r.deviation) for r in made} == {spread}


def test_query_on_its_table(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    check(queries.op13_whiten(spark, SMALL).collect(), [r.embedding for r in rows], [r.vec_id for r in rows])
