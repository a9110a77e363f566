"""Embedding links and groups against all pairs."""

import numpy as np
import pytest

from faultline.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label string, node int, n int, root int"


def brute(rows, threshold=0.95):
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) for _, v in rows]
    n, label = [0] * len(rows), list(range(len(rows)))
    vs = [np.asarray(v, np.float32).astype(float) if o else None for (_, v), o in zip(rows, ok, strict=True)]
    vs = [v / np.linalg.norm(v) if v is not None else None for v in vs]

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(vs[i]) == len(vs[j]) and vs[i] @ vs[j] >= threshold:
                n[i] += 1
                n[j] += 1
                a, b = sorted((top(i), top(j)))
                label[b] = a
    tops = [top(i) for i in range(len(rows))]
    least = {}
    for (i, _), t in zip(rows, tops, strict=True):
        least[t] = min((x for x in (i, least.get(t)) if x is not None), default=None)
    return sorted(((i, k, least[t], i is not None and i == least[t]) for (i, _), k, t in zip(rows, n, tops, strict=True)), key=repr)


def vectors(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        base = rng.normal(size=dim)
        out.append(base)
        for _ in range(rng.integers(0, 3)):
            step = rng.normal(size=dim)
            out.append(base + step / np.linalg.norm(step) * np.linalg.norm(base) * rng.uniform(0, 0.4))
    out += [out[0] * 3, out[0] + 0, out[5] * 1e-20, out[6] * 1e18]
    return [[float(np.float32(x)) for x in v] for v in out]


@pytest.mark.parametrize(("seed", "block", "cells"), [(1, 2048, 12), (2, 30, 8), (3, 2048, 1)])
def test_all_pairs(spark, seed, block, cells):
    vs = vectors(seed, 250)
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1.0] * 3]
    order = np.random.default_rng(seed).permutation(len(vs) + len(odd)).tolist()
    rows = [(i, v) for i, v in zip(order, vs + odd, strict=True)]
    rows += [(None, vs[0]), (None, None), rows[4], rows[4]]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)
    got = ed.near_duplicates(df, block=block, cells=cells, slack=1.0).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_production_settings(spark):
    rows = [(i, v) for i, v in enumerate(vectors(9, 500, 64))]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)
    got = sorted(map(tuple, ed.near_duplicates(df, cells=60).collect()), key=repr)
    assert got == brute(rows)  # no link missed at the narrower border


@pytest.mark.parametrize("dim", [2, 4, 8, 16, 64])
def test_recall_by_dimension(spark, dim):
    """Links found of those there are, with many cells and the default border."""
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(500, dim))
    step = rng.normal(size=(500, dim))
    near = base + step / np.linalg.norm(step, axis=1, keepdims=True) * np.linalg.norm(base, axis=1, keepdims=True) * rng.uniform(0.05, 0.32, (500, 1))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(np.concatenate([base, near]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found, there = sum(r.n_links for r in ed.near_duplicates(df, cells=60).collect()), sum(r[1] for r in brute(rows))
    print(f"recall at {dim} components: {found / there:.4f} of {there // 2} links")
    assert found / there >= (1.0 if dim <= 4 else 0.99)


def test_empty(spark):
    assert ed.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
