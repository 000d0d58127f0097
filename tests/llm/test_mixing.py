"""Targets, budgets and selection against plain versions."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from storepulse.llm import mixing, queries
from storepulse.llm.common import table

WORDS = "[^\x20\x09-\x0d]+"


def plain_targets(sizes, cap=3, weights=(1, 2, 3)):
    """Deal the total by weight; whatever is above a cap is dealt again to the rest."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes))}
    target, left, open_ = {}, float(sum(sizes.values())), set(sizes)
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        full = {s for s in open_ if share[s] >= cap * sizes[s]}
        if not full:
            return target | share
        target |= {s: float(cap * sizes[s]) for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {f"s{i}": int(rng.choice([0, 1, 5, 50, 1000]) * rng.integers(1, 9)) for i in range(int(rng.integers(1, 12)))}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df, mixing.MixOptions()).collect()}
    want = plain_targets(sizes)
    assert got == pytest.approx({s: want.get(s, 0.0) for s in sizes})


def nearest(sizes, most, goal):
    """Least distance to the goal over all choices of 0..most[i] times sizes[i]."""
    sums = {0}
    for s, m in zip(sizes, most):
        sums = {x + s * k for x in sums for k in range(m + 1)}
    return min(abs(x - goal) for x in sums)


@pytest.mark.parametrize("seed", range(30))
def test_budget_is_as_near_as_any_subset(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.choice(np.arange(0, 40), 5, replace=False).astype(np.int64)
    counts = rng.integers(1, 4, 5)
    total = int((sizes * counts).sum())
    budget = int(rng.integers(0, max(total, 1)))
    take = mixing.fit_budget(sizes, counts, budget, 1 << 16)
    assert (take >= 0).all() and (take <= counts).all()
    assert abs(int((take * sizes).sum()) - budget) == nearest(sizes.tolist(), counts.tolist(), budget)


@pytest.mark.parametrize("seed", range(30))
def test_copies_are_as_near_as_any_choice(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.choice(np.arange(0, 90), int(rng.integers(1, 5)), replace=False).astype(np.int64)
    counts = rng.integers(1, 3, len(sizes))
    total = int((sizes * counts).sum())
    wanted = int(rng.integers(0, 3 * total + 1))
    units = mixing.fit_copies(sizes, counts, wanted, 3, 1 << 16)
    assert (units >= 0).all() and (units <= 3 * counts).all()
    assert abs(int((units * sizes).sum()) - wanted) == nearest(sizes.tolist(), (3 * counts).tolist(), wanted)


def test_budget_over_many_sizes_is_exact():
    rng = np.random.default_rng(3)
    sizes, counts = np.arange(1, 3000), rng.integers(1, 50, 2999)
    total = int((sizes * counts).sum())
    for budget in (0, 1, 999, total // 3, total * 9 // 10, total - 1):
        take = mixing.fit_budget(sizes, counts, budget, 1 << 14)
        assert (take >= 0).all() and (take <= counts).all()
        assert int((take * sizes).sum()) == budget or budget == total - 1 and abs(budget - int((take * sizes).sum())) < sizes.max()


DOCS = "doc_id long, text string, source string, SIZE string, copies int"


def documents(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), f"s{i % 4}", "x", 9) for i in range(400)]
    rows += [(400 + i, "same three words", "s0", "x", 9) for i in range(300)]  # one length holds many documents
    rows += [(900, None, "s1", "x", 9), (901, "", None, "x", 9), (902, "a b\tc\x0bd", None, "x", 9), (902, "a b c d", None, "x", 9),
             (None, "no id here", "s2", "x", 9)]
    return spark.createDataFrame(rows, DOCS)


def test_mix(spark):
    docs = documents(spark)
    options = mixing.MixOptions(ranked_together=50)
    rows = mixing.taken_words(mixing.mix(docs, options)).collect()
    again = mixing.taken_words(mixing.mix(docs.repartition(7), options)).collect()
    assert sorted(rows, key=repr) == sorted(again, key=repr)
    assert len(rows) == docs.count()
    sources = {r.doc_id: r.source for r in docs.collect()}
    size, taken, target = {}, {}, {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        s = sources[r.doc_id]
        size[s] = size.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
    assert {r.doc_id: r["size"] for r in rows}[902] == 4 and {r.doc_id: r["size"] for r in rows}[900] == 0
    assert all(abs(taken[s] - target[s]) <= 5 for s in size)
    want = plain_targets({s if s is not None else "~": n for s, n in size.items()})
    assert {s if s is not None else "~": t for s, t in target.items()} == pytest.approx(want)


def test_query(spark):
    """Sizes, shares and targets against plain code; each source as near to its target as any choice of copies."""
    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents").collect()
    rows = {r.doc_id: r for r in queries.queries()["op3_subset_sum_mix"](spark, folder).collect()}
    assert len(rows) == len(docs)
    size = {d.doc_id: len(re.findall(WORDS, d.text or "")) for d in docs}
    by_source = {}
    for d in docs:
        by_source.setdefault(d.source, []).append(d.doc_id)
    want = plain_targets({s if s is not None else "~": sum(size[i] for i in ids) for s, ids in by_source.items()})
    for s, ids in by_source.items():
        target = want[s if s is not None else "~"]
        for i in ids:
            assert rows[i]["size"] == size[i] and rows[i].source_size == sum(size[j] for j in ids)
            assert rows[i].target == pytest.approx(target) and rows[i].taken <= 3 * size[i] and rows[i].taken % max(size[i], 1) == 0
        gap = abs(sum(rows[i].taken for i in ids) - int(round(target)))
        assert gap == nearest([size[i] for i in ids], [3] * len(ids), int(round(target)))


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "w " * 400_000, "a"), (2, "v", "a"), (3, "x " * 9, "b")], "doc_id long, text string, source string")
    got = {r.doc_id: (r["size"], r.taken) for r in mixing.taken_words(mixing.mix(docs)).collect()}
    assert got[1][0] == 400_000 and got[3] == (9, 27) and got[1][1] in (400_000 * k for k in range(4))


def test_mixed_rows_repeat_documents(spark):
    docs = documents(spark)
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    want = mixing.mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).filter("n > 0")
    got = out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(repr, want.collect())) == sorted(map(repr, got.collect()))
    assert out.filter("SIZE <> 'x' or copies <> 9").count() == 0


def test_no_words_and_no_rows(spark):
    none = spark.createDataFrame([(1, None, "a"), (2, " \n", None)], "doc_id long, text string, source string")
    got = mixing.taken_words(mixing.mix(none)).collect()
    assert [(r["size"], r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
    assert mixing.mix(none.limit(0)).count() == 0
