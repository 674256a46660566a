"""Whitening against exact sums and a dense eigensolver."""

import math
import random

import numpy as np
import pytest

from episodica.llm import whitening
from episodica.llm.queries import op13_embedding_whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string, x string"


def usable(vectors):
    return [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def whole(v):
    return tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)


def check(rows, vectors, components=16):
    """Rows of the result against the contract, from vectors (id, entries) that are usable."""
    xs = [(i, whole(v)) for i, v in vectors]
    fit = sorted({x for _, x in xs})
    n, d = len(fit), len(fit[0])
    sums = [sum(c) for c in zip(*fit)]
    gaps = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], object)
    v = np.array([[float(sum(gaps[:, a] * gaps[:, b])) / n**3 for b in range(d)] for a in range(d)])
    values, vectors_ = np.linalg.eigh(v)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    k = min(components, d)
    assert len(rows) == len(xs) * k
    by = {}
    for r in rows:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    signs = {}
    expected = {}
    for i, x in xs:
        gap = [n * c - s for c, s in zip(x, sums)]
        for c in range(1, k + 1):
            known = values[c - 1] > 1e-10 * values[0]
            z = float(np.array(gap, float) / n @ vectors_[:, c - 1]) / math.sqrt(values[c - 1]) if known else None
            expected.setdefault((i, c), []).append((sum(g * g for g in gap), z))
    for key, want in expected.items():
        got = by[key]
        assert len(got) == len(want)
        assert sorted(r["deviation"] for r in got) == sorted(w[0] for w in want)
        for r, (_, z) in zip(sorted(got, key=lambda r: abs(r["whitened"] or 0)), sorted(want, key=lambda w: abs(w[1] or 0))):
            assert (r["whitened"] is None) == (z is None) and r["n"] == n
            if z is not None:
                assert abs(r["whitened"]) == pytest.approx(abs(z), rel=1e-6, abs=1e-7)
                if abs(z) > 1e-3 and len(got) == 1:
                    assert signs.setdefault(key[1], np.sign(z * r["whitened"])) == np.sign(z * r["whitened"])
            assert r["explained"] == pytest.approx(values[key[1] - 1] / v.trace(), rel=1e-6, abs=1e-12)
            assert r["identity_error"] < 1e-9


def test_equals_dense_solution(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 1 + k / 4) + rng.gauss(0, 0.2) for k in range(24)]) for i in range(150)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(70)] + [(5, vectors[7][1]), (None, vectors[8][1])]
    bad = [(2000, None), (2001, [None] * 24), (2002, [float("nan")] + [0.0] * 23), (2003, [1.0] * 23 + [float("-inf")]), (2004, []), (2005, [1.0] * 3)]
    docs = spark.createDataFrame([(i, v, 0, "c", "n", "x") for i, v in vectors + bad], SCHEMA).repartition(4)
    found = whitening.whiten(docs)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(found.collect(), vectors)


def test_few_vectors_and_constant_dimensions(spark):
    def run(vectors):
        return whitening.whiten(spark.createDataFrame([(i, v, 0, "c", "n", "x") for i, v in vectors], SCHEMA)).collect()

    rng = random.Random(6)
    few = [(i, [rng.gauss(0, 2) for _ in range(18)] + [0.5, 0.5]) for i in range(4)]
    check(run(few), few)
    two = [(i, [rng.gauss(0, 2), rng.gauss(0, 1)]) for i in range(30)]
    check(run(two), two)
    one = run([(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert [(r["whitened"], r["deviation"], r["n"], r["explained"], r["identity_error"]) for r in one] == [(None, 0, 1, 0.0, 0.0)] * 4
    assert run([]) == []
    assert run([(1, None)]) == []


def test_large_entries_and_deviations(spark):
    vectors = [(i, [float(2**20 * (i + 1)), float(4096 * i * i)]) for i in range(6)]
    docs = spark.createDataFrame([(i, v, 0, "c", "n", "x") for i, v in vectors], SCHEMA)
    check(whitening.whiten(docs).collect(), vectors)
    assert whitening._deviation(np.array([[2**40, 0]]), 10**6, [0, 0]) == [None]
    assert whitening._deviation(np.array([[2**40, 0]]), 10**6, [2**40 * 10**6 - 5, 7]) == [74]


@pytest.mark.parametrize("spread", [0, 1e-9, 1e-7, 1e-5])
def test_clusters_are_resolved(spread):
    rng = np.random.default_rng(3)
    values = np.r_[10 + spread * np.arange(8), np.linspace(1, 5, 40)]
    q = np.linalg.qr(rng.normal(size=(48, 48)))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found = whitening.eigenvectors(a)
    assert np.abs(a @ found.vectors - found.vectors * found.values).max() < 1e-14 * 10
    assert np.abs(found.vectors.T @ found.vectors - np.eye(48)).max() < 1e-11
    assert np.abs(found.values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13


def test_refinement_squares_the_error():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(20, 20)))[0]
    a = (q * np.arange(1, 21)) @ q.T
    x = q + 1e-4 * rng.normal(size=(20, 20))
    for bound in (1e-5, 1e-9):
        x = whitening.refine((a + a.T) / 2, x, rounds=1)
        assert np.abs(np.abs((x * q).sum(0)) - 1).max() < bound and np.abs(x.T @ x - np.eye(20)).max() < bound


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    check(op13_embedding_whitening(spark, sf_dir).collect(), usable([(r["vec_id"], r["embedding"]) for r in rows]))
