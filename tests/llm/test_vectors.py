import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import lattice, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((120, 16)).astype(np.float32)
    x[60:90] = x[:30] + 0.02 * rng.standard_normal((30, 16))  # near copies
    x[90:100] = x[5]  # equal ones
    data = [(int(i), [float(v) for v in r], 1) for i, r in enumerate(x)]
    return [*data, data[7], (200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] + [1.0] * 15, 1), (203, [1.0, None], 1), (204, [], 1), (None, [1.0] * 16, 1), (205, [float("inf")] * 16, 1)]


def fine(v):
    return v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)


def brute_links(data, at_least=0.95):
    good = [(i, np.array(v, np.float64)) for i, v, _ in data if i is not None and fine(v) and any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    link = x @ x.T >= at_least
    root = np.array([i for i, _ in good])
    while True:
        new = np.where(link, root[None, :], 10**9).min(1)
        if (new == root).all():
            break
        root = new
    return sorted((i, int(n) - 1, int(r)) for (i, _), n, r in zip(good, link.sum(1), root, strict=True))


def test_lattice(spark, monkeypatch):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    want = brute_links(data) + [(i, 0, i) for i in (200, 201, 202, 203, 204, 205)]
    for tile in (512, 4):  # 4: cells are cut into tiles
        monkeypatch.setattr(lattice, "TILE", tile)
        got = lattice.near_duplicates(df.withColumns({"uid": F.lit("x"), "cells": F.lit(1), "home": F.lit(2)})).collect()  # clashing names
        assert len(got) == len(data)
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None) == sorted(want)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
        assert [(r.n_links, r.kept) for r in got if r.vec_id is None] == [(0, False)]
    assert lattice.near_duplicates(df.filter("vec_id < 0")).count() == 0


def test_lattice_points_and_recall():
    rng = np.random.default_rng(2)
    assert (lattice.roots() ** 2).sum(1).tolist() == [2.0] * 240
    x = rng.uniform(-3, 3, (300, 8))
    near = lattice.nearest(x)
    assert all(((x - near - r) ** 2).sum(1).min() >= 0 and (((x - near) ** 2).sum(1) <= ((x - near - r) ** 2).sum(1) + 1e-9).all() for r in lattice.roots())
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    g = rng.standard_normal((2000, 64))
    g -= (g * a).sum(1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    for blocks in (2, 3):
        h = lattice.Hash(64, blocks)
        assert lattice._meet(h.cells(a), h.cells(b)).any((1, 2)).mean() >= 0.95


def test_top_k(spark, monkeypatch):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    good = [(i, np.floor(256 * np.array(v, np.float64))) for i, v, _ in data if i is not None and fine(v)]
    want = []
    for q, v in {i: v for i, v in good if i % 10 == 0}.items():
        best = sorted((-int(v @ w), i) for i, w in good if i != q)[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    for block, longest in ((8192, 4096), (3, 7)):
        monkeypatch.setattr(topk, "LONGEST", longest)
        got = topk.top_k(df.withColumns({"size": F.lit("x"), "score": F.lit(1)}), F.col("vec_id") % 10 == 0, block=block)  # clashing names
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(df.filter("vec_id < 0"), F.lit(True)).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [3.0], 0)], SCHEMA)  # fewer than k; a short vector is filled up
    assert sorted(map(tuple, topk.top_k(two, F.lit(True)).collect())) == [(0, 1, 1, 256 * 768), (1, 1, 0, 256 * 768)]
    huge = spark.createDataFrame([(0, [1e30, 1.0], 0), (1, [1e30, 2.0], 0)], SCHEMA)
    assert {r.score for r in topk.top_k(huge, F.lit(True)).collect()} == {2**63 - 1}


def test_top_k_prunes():
    """The floor and the bounds leave few products, and the result is that of all products."""
    rng = np.random.default_rng(5)
    x = np.floor(rng.standard_normal((6000, 32)) * np.exp(rng.standard_normal((6000, 1))) * 256)
    ids, q = np.arange(6000), np.arange(0, 6000, 50)
    s = topk.BlockSearch(q, x[q], 5)
    order = np.argsort(-np.linalg.norm(x, axis=1))
    s.add(ids[order[:500]], x[order[:500]])
    s.start_over()
    before = s.products
    s.add(ids, x)
    assert s.products - before < 0.05 * len(q) * 6000
    got = {(r["query_id"], r["vec_id"], r["score"]) for r in s.rows().to_pylist()}
    for i in q.tolist():
        best = sorted(((-int(x[i] @ x[j]), j) for j in range(6000) if j != i))[:5]
        assert {(i, j, -v) for v, j in best} <= got
