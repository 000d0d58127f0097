"""N-gram join against brute force, on groups of copies, chains and shared passages."""

import random

import numpy as np

import pytest

from storepulse.llm import ngram_join


def words_of(text):
    return (text or "").encode().lower().split()


def grams_of(text, k=5):
    w = words_of(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute(rows):
    sets = {i: grams_of(t) for i, t in rows}
    ids, label = sorted(sets), {}
    for start in ids:
        todo = [start] if start not in label else []
        while todo:
            x = todo.pop()
            if x in label:
                continue
            label[x] = start
            todo += [y for y in ids if y not in label and sets[x] and sets[y]
                     and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])]
    return {i: (len(sets[i]), label[i]) for i in ids}


def altered(words, rnd, share):
    return " ".join(rnd.choice("xyz") + str(rnd.random()) if rnd.random() < share else w for w in words)


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    rows, passage = [], text(60)
    for _ in range(120):
        rows.append(" ".join(text(rnd.randint(1, 90))))
    for _ in range(60):  # a passage that many otherwise different texts share
        rows.append(" ".join(text(rnd.randint(0, 40)) + passage + text(rnd.randint(0, 40))))
    for size, share in ((50, 0.02), (40, 0.04), (8, 0.03), (3, 0.01)):
        original = text(rnd.randint(40, 150))
        rows += [" ".join(original)] + [altered(original, rnd, share) for _ in range(size)]
    chain = text(200)
    for k in range(12):  # neighbours are alike, ends are not
        rows.append(" ".join(chain[k * 6:k * 6 + 100]))
    rows += [rows[0]] * 30 + [rows[0].upper(), rows[0].replace(" ", "\t\n ")]
    rows += [None, "", " \n\t", "one", "ONE", "one two three four", "one two three four", "É a b c d", "é a b c d", "very " * 5000]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,entries", [(1, 1_000_000), (2, 400)])
def test_components(spark, seed, entries):
    """Small blocks force groups over several of them."""
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 0, "n") for i, t in rows], "doc_id long, text string, node int, `TEXT.x` string").repartition(6)
    got = ngram_join.near_duplicates(df, ngram_join.JoinOptions(block_entries=entries)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_block_matches_brute_force():
    rnd = random.Random(3)
    shingle = ngram_join.Shingler(5)
    base = [f"w{rnd.randint(0, 99)}" for _ in range(60)]
    texts = [altered(base, rnd, 0.03) for _ in range(60)]
    block = ngram_join.Block(ngram_join.JoinOptions())
    for i, t in enumerate(texts):
        block.add(i, shingle(t))
    links = block.close()
    label = list(range(60))
    for a, b in links:
        label[a] = b
    want = brute(list(enumerate(texts)))
    assert label == [want[i][1] for i in range(60)]
    assert len(links) < 60


def test_null_and_repeated_ids(spark):
    long = "a b c d e f g h"
    rows = [(1, long), (1, long), (None, long), (None, "x y z"), (None, None), (5, "p q r s t"), (5, "another text of some words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 4, 1), (1, 4, 1), (None, 4, 1), (None, 1, None), (None, 0, None), (5, 1, 5), (5, 1, 5)], key=repr)
    kept = ngram_join.first_of_each(df.withColumnRenamed("text", "text"))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted(
        [(1, long), (0, long), (0, "x y z"), (0, ""), (5, "p q r s t"), (5, "another text of some words")])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(empty).count() == 0
    blank = spark.createDataFrame([(2, None), (1, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.near_duplicates(blank).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_linked_rows_share_enough_first_columns():
    """Over random pairs just at the threshold, in the worst order: all columns of one side alone come first."""
    options, rng = ngram_join.JoinOptions(), np.random.default_rng(8)
    for _ in range(3000):
        common = int(rng.integers(1, 400))
        alone = int((100 * common - 75 * common) // 75)  # union may hold so many more
        a_only = int(rng.integers(0, alone + 1))
        b_only = alone - a_only
        a, b = a_only + common, b_only + common
        assert 100 * common >= 75 * (a_only + b_only + common)
        assert options.prefix(a) <= a and options.first_shared(a) <= options.needed(a)
        # The order that hides most: what a row has alone comes before all that both have.
        in_a, in_b = max(options.prefix(a) - a_only, 0), max(options.prefix(b) - b_only, 0)
        assert min(in_a, in_b, common) >= max(options.fewest(a), options.fewest(b))


def test_leaders_against_a_plain_walk():
    rng = np.random.default_rng(2)
    for _ in range(200):
        grams = np.sort(rng.integers(0, 5, 30))
        sizes = rng.integers(1, 200, 30)
        order = np.lexsort((sizes, grams))
        grams, sizes = grams[order], sizes[order].astype(np.int32)
        want, lead = [], 0
        for i in range(30):
            if i and grams[i] != grams[i - 1] or 100 * sizes[lead] < 75 * sizes[i]:
                lead = i
            want.append(lead)
        assert ngram_join.leaders(grams, sizes, 75).tolist() == want


def test_prefix_bound():
    options = ngram_join.JoinOptions(longer=0)
    for n in range(1, 300):
        assert options.needed(n) == -(-75 * n // 100) and options.prefix(n) == n - options.needed(n) + 1
