"""Whitening against a plain eigendecomposition of the whole covariance."""

import math

import __spark_entry__ as entry
import numpy as np
import pytest
from pyspark.sql import functions as F
from wayfare.llm import whitening


def plain(rows, components=4):
    """{vec_id: deviation}, n, eigenvalues, {(vec_id, component): whitened up to sign}, shares."""
    x = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in rows}
    fit = [list(v) for v in {tuple(v) for v in x.values()}]
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    c = np.array([[n * a - b for a, b in zip(v, s)] for v in fit]) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    w = {i: (np.array([n * a - b for a, b in zip(v, s)]) / n) @ axes / np.sqrt(values) for i, v in x.items()}
    return {i: sum((n * a - b) ** 2 for a, b in zip(v, s)) for i, v in x.items()}, n, w, values / np.trace(c.T @ c / n)


def test_whole_table(spark, data):
    source = spark.read.parquet(f"{data}/sf0.01/embeddings.parquet").collect()
    deviation, n, whitened, shares = plain([(r["vec_id"], r["embedding"]) for r in source])
    rows = entry.queries()["op12_whitening"](spark, f"{data}/sf0.01").collect()
    assert sorted((r["vec_id"], r["component"]) for r in rows) == sorted((i, k) for i in deviation for k in range(1, 5))
    signs = {}
    for r in rows:
        k, want = r["component"], whitened[r["vec_id"]][r["component"] - 1]
        assert (r["n"], r["deviation"]) == (n, deviation[r["vec_id"]])
        assert r["explained"] == pytest.approx(shares[k - 1], rel=1e-9)
        assert r["identity_error"] < 1e-9
        if abs(want) > 1e-3:
            assert signs.setdefault(k, np.sign(r["whitened"] * want)) == np.sign(r["whitened"] * want)
        assert abs(r["whitened"]) == pytest.approx(abs(want), abs=1e-7)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize(("d", "k", "block", "size"), [(3, 4, 8, 64), (40, 4, 8, 64), (120, 4, 4, 32), (150, 6, 8, 64), (64, 4, 1, 64)])
def test_lanczos(seed, d, k, block, size):
    rng = np.random.default_rng(seed)
    half = rng.standard_normal((d, d)) * (rng.random(d) ** 2)[:, None]
    if seed == 1:
        half[:, d // 2 :] = 0  # of half rank
    if seed == 2:
        half = np.diag(np.repeat([3.0, 2.0, 1.0], d)[:d])  # few different eigenvalues: breakdown at once
    if seed == 3:
        half = np.outer(rng.standard_normal(d), rng.standard_normal(d))  # of rank one
    a = half.T @ half if seed != 3 else half @ half.T
    values, axes = whitening.leading(lambda v: a @ v, d, k, block=block, basis_size=size)
    want = np.linalg.eigvalsh(a)[::-1][: min(k, d)]
    assert values == pytest.approx(want, abs=1e-10 * want[0])
    assert np.abs(axes.T @ axes - np.eye(len(want))).max() < 1e-12
    assert np.abs(a @ axes - axes * values).max() < 1e-10 * want[0]


def test_zero_matrix():
    assert whitening.leading(lambda v: 0 * v, 5, 2)[0].tolist() == [0, 0]


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_odd_rows(make):
    rng = np.random.default_rng(3)
    good = [(i, [float(np.float32(c)) for c in rng.standard_normal(5) * [5, 4, 3, 2, 1]]) for i in range(50)]
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0]), (None, good[0][1]), (3, good[3][1]), (4, good[3][1])]
    df = make(good + odd).withColumns({c: F.lit("extra") for c in ("x", "n", "component", "d", "count", "k", "v", "whitened")})
    rows = whitening.whiten(df).collect()
    deviation, n, whitened, shares = plain(good)
    assert n == 50 and len(rows) == 4 * 53
    assert {r["n"] for r in rows} == {50}
    for r in rows:
        i = 0 if r["vec_id"] is None else r["vec_id"]
        if i != 4:
            assert r["deviation"] == deviation[i]
            assert abs(r["whitened"]) == pytest.approx(abs(whitened[i][r["component"] - 1]), abs=1e-9)


def test_degenerate_tables(make):
    assert whitening.whiten(make([])).collect() == []
    assert whitening.whiten(make([(1, None)])).collect() == []
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    line = whitening.whiten(make([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])).collect()
    assert {r["component"] for r in line} == {1} and line[0]["explained"] == pytest.approx(1)
    narrow = whitening.whiten(make([(i, [float(i * i % 7), float(i)]) for i in range(9)])).collect()
    assert {r["component"] for r in narrow} == {1, 2} and sum({r["explained"] for r in narrow}) == pytest.approx(1)


def test_large_entries(make):
    rows = whitening.whiten(make([(i, [float(2**40 * i), float(i % 3)]) for i in range(5)])).collect()
    n, xs = 5, [(256 * 2**40 * i, 256 * (i % 3)) for i in range(5)]
    s = [sum(c) for c in zip(*xs)]
    want = [sum((n * a - b) ** 2 for a, b in zip(v, s)) for v in xs]
    assert {r["vec_id"]: r["deviation"] for r in rows} == {i: w if w < 2**63 else None for i, w in enumerate(want)}
    assert {r["n"] for r in rows} == {5}
