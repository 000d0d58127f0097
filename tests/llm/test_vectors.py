"""Subspace join and tree search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from storepulse.llm import subspace, vptree


def clustered(seed, n=600, length=24):
    """Random vectors, groups near the threshold, many exact copies, and odd rows."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, length))
    for start, size, noise in ((0, 60, 0.02), (60, 80, 0.24), (140, 120, 0.32)):
        base[start:start + size] = base[start] + noise * rng.standard_normal((size, length)) * np.linalg.norm(base[start]) / math.sqrt(length)
    base[300:420] = base[300]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    odd = [None, [], [0.0] * length, [float("nan")] * length, [float("inf")] + [1.0] * (length - 1), [None] + [1.0] * (length - 1), [1.0, 2.0], [2.0, 4.0]]
    return rows + [(n + i, v) for i, v in enumerate(odd)] + [(n + 50, [1.0, 2.0])]


def frame(spark, rows):
    # Columns that differ from the operators' own only in case, or not at all.
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, Vector string, id int").repartition(5)


def valid(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute_links(rows, threshold):
    out = {i: set() for i, _ in rows}
    good = [(i, np.array(v, np.float64)) for i, v in rows if valid(v)]
    for length in {len(v) for _, v in good}:
        ids = [i for i, v in good if len(v) == length]
        m = np.stack([v for _, v in good if len(v) == length])
        cos = (m @ m.T) / np.sqrt((m**2).sum(1))[:, None] / np.sqrt((m**2).sum(1))[None]
        for a, b in zip(*np.nonzero(cos >= threshold)):
            if a != b:
                out[ids[a]].add(ids[b])
    return out


def brute_components(links):
    label = {}
    for start in sorted(links):
        todo = [start] if start not in label else []
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = start
                todo += links[x]
    return label


@pytest.mark.parametrize("seed,chunk", [(1, 2048), (2, 32)])
def test_near_duplicates(spark, seed, chunk):
    rows = clustered(seed)
    links = brute_links(rows, 0.9)
    label = brute_components(links)
    got = subspace.near_duplicates(frame(spark, rows), subspace.SubspaceOptions(chunk_rows=chunk, block_size=8)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (len(links[r.vec_id]), label[r.vec_id], label[r.vec_id] == r.vec_id)


def test_pigeonhole_budgets_add_up():
    options = subspace.SubspaceOptions(block_size=5)
    for length in (1, 2, 7, 64, 100):
        spans = subspace.blocks(length, options)
        assert sum(b for *_, b in spans) == pytest.approx(0.2) and spans[0][0] == 0 and spans[-1][1] == length


def test_no_vectors(spark):
    empty = frame(spark, clustered(1)).limit(0)
    assert subspace.near_duplicates(empty).count() == 0
    assert vptree.nearest(empty, F.col("id") % 20 == 0).count() == 0
    odd = frame(spark, [(4, None), (20, [0.0])])
    assert [(r.n_links, r.component_id) for r in subspace.near_duplicates(odd).orderBy("vec_id").collect()] == [(0, 4), (0, 20)]
    assert vptree.nearest(odd, F.col("id") % 20 == 0).count() == 0


def exact_dot(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += float(np.float32(x)) * float(np.float32(y))
    return total


def brute_nearest(rows, k):
    good = {i: v for i, v in rows if valid(v)}
    out = {}
    for q in good:
        if q % 20 == 0:
            found = sorted((-exact_dot(good[q], v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


@pytest.mark.parametrize("shard,leaf", [(10_000, 16), (150, 8)])
def test_search_is_exact_at_factor_one(spark, shard, leaf):
    rows = clustered(3, n=500)
    want = brute_nearest(rows, 20)
    twice = rows + rows[:40]  # repeated rows count once
    options = vptree.TreeOptions(shard_rows=shard, leaf_rows=leaf, query_batch=7)
    got = {}
    for r in vptree.nearest(frame(spark, twice), F.col("id") % 20 == 0, options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got == {q: found for q, found in want.items() if found}


def test_more_near_ties_than_spare_places():
    """Hundreds of points whose products differ by less than rounding: the exact score decides."""
    rng = np.random.default_rng(0)
    base = rng.standard_normal(16)
    points = np.stack([base * (1 + 1e-15 * rng.integers(-3, 4)) for _ in range(300)] + [rng.standard_normal(16) for _ in range(200)])
    options = vptree.TreeOptions(leaf_rows=16)
    tree = vptree.Tree(np.arange(500), points, options)
    got = tree.search(np.array([1000]), base[None])
    want = sorted((-sum(float(x) * float(y) for x, y in zip(base, p)), i) for i, p in enumerate(points))[:20]
    assert got.column(1).to_pylist() == [i for _, i in want]


def test_recall_of_a_relaxed_search():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 24))
    points = centres[rng.integers(0, 30, 3000)] + 0.15 * rng.standard_normal((3000, 24))
    queries = points[::60] + 0.05 * rng.standard_normal((50, 24))
    found = {}
    for factor in (1.0, 0.9):
        tree = vptree.Tree(np.arange(3000), points, vptree.TreeOptions(factor=factor, leaf_rows=32))
        got = tree.search(np.arange(10_000, 10_050), queries)
        for q, i in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
            found.setdefault((factor, q), set()).add(i)
    hits = sum(len(found[1.0, q] & found.get((0.9, q), set())) for q in range(10_000, 10_050))
    assert hits / (50 * 20) >= 0.9
