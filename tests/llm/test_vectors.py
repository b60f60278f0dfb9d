"""Embedding near-dedup against brute force."""

import math

import numpy as np
import pytest

from ledgerline.llm import embedding as E

SCHEMA = "vec_id long, embedding array<float>, label int, links string"


def brute(rows, cosine=0.9):
    usable = [(i, np.array(x, float)) for i, x, *_ in rows if i is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    ids = [i for i, *_ in rows if i is not None]
    root, links = {i: i for i in ids}, [0] * len(usable)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(usable):
        for b, (j, y) in enumerate(usable):
            if a != b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                links[a] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    of = {}
    for (i, _), n in zip(usable, links, strict=True):
        of.setdefault(i, []).append(n)
    return sorted((i, of[i].pop() if of.get(i) else 0, find(i), find(i) == i) for i in ids)


def table():
    rng = np.random.default_rng(5)
    rows = []
    centres = rng.standard_normal((12, 16))
    for i in range(160):
        noise = rng.choice([0.02, 0.1, 0.2, 0.3, 1.0])
        rows.append((1000 - i, (centres[i % 12] + noise * rng.standard_normal(16)).astype(np.float32).tolist()))
    rows += [(2000, rows[3][1]), (2001, rows[3][1]), (2002, [2 * x for x in rows[4][1]])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [1.0, None] + [0.0] * 14), (3005, [float("inf")] + [0.0] * 15), (3006, [1.0, 2.0]), (3007, [1.0, 2.0])]
    rows += [(3008, [1e-38] + [0.0] * 15), (3009, [3e38] + [0.0] * 15)]
    return [(i, x, None, "x") for i, x in rows]


def test_links_and_components(spark, monkeypatch):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert sorted(tuple(r) for r in E.near_duplicates(df).collect()) == want
    assert max(n for _, n, _, _ in want) > 3
    monkeypatch.setattr(E, "_CELL", 8)  # many cells and rounds
    monkeypatch.setattr(E, "_BLOCK", 4)
    assert sorted(tuple(r) for r in E.near_duplicates(df).collect()) == want


def test_empty_and_null_ids(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    odd = [(None, [1.0, 0.0], None, None), (5, None, None, None)]
    assert [tuple(r) for r in E.near_duplicates(spark.createDataFrame(odd, SCHEMA)).collect()] == [(5, 0, 5, True)]


def test_recall_at_the_threshold():
    """Pairs at the threshold itself pass the collision count, and meet in a cell, as often as planned."""
    rng = np.random.default_rng(0)
    p = E.plan(1_000_000, 0.9)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((2000, 64))
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    y = 0.9 * x + math.sqrt(1 - 0.81) * y
    own, half = E._lines(64, p["lines"], 2), E.window(64, 0.9)
    collide = lambda z: (np.abs(x @ own - z @ own) <= half).sum(1) >= p["count"]
    assert collide(y).mean() > 0.99
    lines = E._lines(64, p["bits"] * p["rounds"], 1)
    same = ((x @ lines >= 0) == (y @ lines >= 0)).reshape(2000, p["rounds"], p["bits"]).all(2).any(1)
    assert p["bits"] >= 9 and same.mean() > 0.99
    far = rng.standard_normal((2000, 64))
    far /= np.linalg.norm(far, axis=1)[:, None]
    assert collide(far).mean() < 0.02


def test_collisions_by_brute_force():
    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((9, 5)).round(1), rng.standard_normal((30, 5)).round(1)
    order = y.argsort(0, kind="stable")
    got = E.collisions(x, order, np.take_along_axis(y, order, 0), 0.5)
    want = [[sum(a - 0.5 <= b <= a + 0.5 for a, b in zip(q, m, strict=True)) for q in x] for m in y]
    assert got.tolist() == want


def test_mixed_lengths(spark):
    """Windows are those of a pair's own length, whatever other lengths the table has."""
    rng = np.random.default_rng(8)
    rows = [(1, rng.standard_normal(640).tolist(), None, None)]
    for dim, pairs in ((64, 60), (256, 30), (1024, 20)):
        for _ in range(pairs):
            x, y = rng.standard_normal((2, dim))
            x /= np.linalg.norm(x)
            y -= (y @ x) * x
            t = rng.uniform(0.9, 0.95)
            rows += [(len(rows) + 10, x.tolist(), None, None), (len(rows) + 11, (t * x + math.sqrt(1 - t * t) * y / np.linalg.norm(y)).tolist(), None, None)]
    got = sorted(tuple(r) for r in E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    want = brute(rows)
    assert sum(n for _, n, _, _ in want) >= 214
    assert got == want


@pytest.mark.parametrize("same", [True, False])
def test_tiles(same, monkeypatch):
    monkeypatch.setattr(E, "_TILE", 7)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((5, 8))[rng.integers(0, 5, 40)] + 0.1 * rng.standard_normal((40, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x if same else x[:15]
    i, j = E.near_pairs(x, y, E.plan(40, 0.9), same)
    got = set(zip(i.tolist(), j.tolist(), strict=True))
    want = {(a, c) for a in range(40) for c in range(len(y)) if (c < a if same else True) and x[a] @ y[c] >= 0.9}
    assert got == want


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in E.op5_embedding_near_dedup(spark, sf).collect()) == brute(rows)
