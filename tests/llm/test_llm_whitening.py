"""Whitening against numpy on the distinct rows; rank-one updates against a full decomposition."""

import os

import numpy as np
import pytest

from tidemark.llm import whitening
from tidemark.llm.common import table
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_rank_one_updates_keep_the_decomposition():
    rng = np.random.default_rng(0)
    for d in (1, 2, 5, 40):
        values, vectors, whole = np.zeros(d), np.eye(d), np.zeros((d, d))
        for i in range(3 * d):
            term = np.eye(d)[i % d] * 2 if i % 4 == 0 else rng.integers(-3, 4, d).astype(float) * 10.0 ** rng.integers(-3, 3)
            values, vectors = whitening.add_rank_one(values, vectors, term)
            whole += np.outer(term, term)
            assert np.abs(vectors @ np.diag(values) @ vectors.T - whole).max() <= 1e-11 * max(1.0, np.abs(whole).max())
            assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12 and (np.diff(values) >= 0).all()


def test_equal_eigenvalues_and_absent_entries_are_deflated():
    rng = np.random.default_rng(1)
    for _ in range(100):
        d = 6
        values = np.sort(rng.choice([0.0, 0.0, 1.0, 1.0 + 1e-15, 4.0], d))
        vectors = np.linalg.qr(rng.normal(size=(d, d)))[0]
        term = vectors @ (rng.normal(size=d) * rng.integers(0, 2, d))
        whole = vectors @ np.diag(values) @ vectors.T + np.outer(term, term)
        v, q = whitening.add_rank_one(values, vectors, term)
        assert np.abs(q @ np.diag(v) @ q.T - whole).max() < 1e-11 and np.abs(v - np.linalg.eigvalsh(whole)).max() < 1e-11


def test_spectra_combine_to_the_scatter_of_all():
    rng = np.random.default_rng(2)
    rows = rng.integers(-200, 300, (700, 12)) * rng.integers(0, 2, 12)
    own, other = whitening.Spectrum.empty(12), whitening.Spectrum.empty(12)
    own.add_rows(rows[:5])
    own.add_rows(rows[5:400])
    other.add_rows(rows[400:])
    own.add(other)
    centred = rows - rows.mean(axis=0)
    assert own.n == 700 and own.sums == rows.sum(axis=0).tolist()
    assert np.allclose(own.vectors @ np.diag(own.values) @ own.vectors.T, centred.T @ centred, atol=1e-6)


def whole_check(rows, vectors, components=4):
    """``rows`` of the operator against numpy; ``vectors`` maps an id to its list of whole vectors."""
    fit = np.unique(np.array([v for own in vectors.values() for v in own]), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    covariance = centred.T @ centred / n
    e, q = np.linalg.eigh(covariance)
    e, q = e[::-1], q[:, ::-1]
    signs = {}
    assert len(rows) == components * sum(map(len, vectors.values()))
    for r in rows:
        own = vectors[r.vec_id]
        assert r.n == n and int(r.deviation) in [int(((n * x - sums) ** 2).sum()) for x in own] and r.identity_error <= 1e-4
        k = r.component - 1
        assert abs(r.explained - e[k] / np.trace(covariance)) <= 1e-4 * e[k] / np.trace(covariance)
        want = [float((x - sums / n) @ q[:, k] / np.sqrt(e[k])) for x in own]
        assert min(abs(abs(r.whitened) - abs(w)) for w in want) < 1e-8
        if abs(r.whitened) > 1e-6 and len(own) == 1:
            signs.setdefault(k, set()).add(np.sign(r.whitened) == np.sign(want[0]))
    assert all(len(s) == 1 for s in signs.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_query_against_numpy(spark):
    vectors = {r.vec_id: [np.floor(256 * np.array(r.embedding, dtype=np.float64)).astype(np.int64)] for r in table(spark, SF, "embeddings").collect()}
    whole_check(QUERIES["op13_whitening"](spark, SF).collect(), vectors)


def test_many_small_parts_and_repeats(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 9)) * np.arange(1, 10)
    rows = [(i, [float(c) for c in base[i % 300 if i < 600 else 0]]) for i in range(900)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(40)
    vectors = {i: [np.floor(256 * np.array(v, dtype=np.float32).astype(np.float64)).astype(np.int64)] for i, v in rows}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # many tasks, so several rounds of combining
    try:
        got = whitening.whiten(frame).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole_check(got, vectors)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, []), (7, [1.0]), (8, [-0.0, 0.001]), (None, [2.0, 1.0]), (8, [3.0, 3.0]), (9, [1e30, 0.0]), (1, [0.5, 0.25])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as x", "2 as n", "'q' as _id", "3 as component")
    got = whitening.whiten(frame).collect()
    assert sorted({r.vec_id for r in got if r.vec_id}) == [1, 8] and len(got) == 5 * 2 and {r.component for r in got} == {1, 2} and {r.n for r in got} == {4}
    assert whitening.whiten(frame.limit(0)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0])] * 3, "vec_id long, embedding array<double>")).collect()
    assert len(one) == 9 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1 for r in one)
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 0.0, 0.0]) for i in range(5)], "vec_id long, embedding array<double>")).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in flat) and all(r.explained == (1.0 if r.component == 1 else 0.0) for r in flat)


def test_large_numbers_stay_exact(spark):
    rows = [(i, [(1 << 40) + i * i * 7.0, -3.0e9 * i]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    fit = [[int(np.floor(256 * c)) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*fit)]
    for r in got:
        assert int(r.deviation) == sum((40 * a - s) ** 2 for a, s in zip(fit[r.vec_id], sums))
