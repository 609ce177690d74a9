"""Whitening against a dense eigensolver."""

import numpy as np
import pytest

from skygauge.llm import whitening
from skygauge.llm.queries import QUERIES


def dense(vectors, k=8):
    x = np.floor(1024 * np.asarray(vectors, np.float64)).astype(np.int64) + 100_000
    centred = (len(x) * x - x.sum(axis=0)) / len(x)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum(int(v) ** 2 for v in row) for row in (len(x) * x - x.sum(axis=0))]
    return centred @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum(), deviation


def table(spark, rows):
    return spark.createDataFrame([(i, v, "c", 0.5) for i, v in rows], "vec_id long, embedding array<float>, component string, x double")


def as_matrix(out, ids, k):
    found = {(r.vec_id, r.component): r for r in out}
    return np.array([[found[i, c].whitened for c in range(1, k + 1)] for i in ids]), found


@pytest.mark.parametrize("d", [3, 8, 40])
def test_query_against_dense(spark, tmp_path, d):
    rng = np.random.default_rng(d)
    vectors = (rng.standard_normal((300, d)) * np.geomspace(3, 1, d)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, None), (1001, [None] + [0.0] * (d - 1)), (1002, [float("nan")] * d), (1003, [float("inf")] * d), (1004, []), (1005, [1.0] * (d + 1))]
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["op13_embedding_whitening"](spark, str(tmp_path)).collect()
    k = min(8, d)
    expected, explained, deviation = dense(vectors)
    assert len(out) == 300 * k and out[0].__fields__ == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got, found = as_matrix(out, range(300), k)
    sign = np.sign((got * expected).sum(axis=0))
    assert np.abs(got - expected * sign).max() < 1e-8
    assert all(found[i, 1].deviation == deviation[i] for i in range(300)) and {r.n for r in out} == {300}
    assert max(abs(found[0, c].explained - explained[c - 1]) for c in range(1, k + 1)) < 1e-10 and out[0].identity_error < 1e-8


def test_ties_copies_nulls_and_low_rank(spark):
    plane = [[float(a), float(b), 0.0, 2.0] for a in (-1, 1) for b in (-1, 1)]  # two equal eigenvalues, two of none
    out = whitening.whiten(table(spark, [(None, plane[0]), (2**62, plane[1]), (5, plane[2]), (5, plane[3])] * 2)).collect()
    assert len(out) == 16 and {r.component for r in out} == {1, 2} and out[0].identity_error < 1e-9
    assert sorted({r.vec_id for r in out if r.vec_id}) == [5, 2**62] and sum(r.vec_id is None for r in out) == 4
    assert abs(sum(r.whitened**2 for r in out) - 16) < 1e-9


def test_without_variance_or_rows(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(table(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    assert whitening.whiten(table(spark, [(i, None) for i in range(3)])).count() == 0


def test_filter_is_small_on_the_interval_and_grows_above_it(monkeypatch):
    values = np.concatenate([np.linspace(1, 5, 30), [6.0, 7.0, 9.0]])
    monkeypatch.setattr(whitening, "product", lambda rows, m, q: values[:, None] * q)
    q = np.eye(33)
    gain = np.abs(np.diag(whitening.filtered(None, None, q, values[:, None] * q, 1.0, 5.0, 9.0, 10)))
    assert abs(gain[-1] - 1) < 1e-12 and gain[:30].max() < 1e-4 * gain[-1] and gain[30] > 100 * gain[:30].max()


def test_eigenpairs_stop_only_when_certified(spark):
    rng = np.random.default_rng(0)
    rows, d = whitening.prepare(table(spark, [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((200, 40)))]), "vec_id", "embedding")
    with pytest.raises(RuntimeError):
        whitening.fit(rows, d, whitening.WhitenConfig(max_cycles=0))


def test_deviations_beyond_long_products():
    m = whitening.Moments(10**9, np.array([10**14, 10**14]))
    assert whitening.deviations(np.array([[100_003, 99_990]]), m) == [(3 * 10**9) ** 2 + (10 * 10**9) ** 2]
