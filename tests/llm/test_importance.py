"""Prefix CRCs, and the query against a plain version."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from storepulse.llm import importance, queries
from storepulse.llm.common import table
from storepulse.llm.importance import ImportanceOptions

FOLDER = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, max_n=2):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = WORDS.findall(lowered)
    return w, [" ".join(w[i:i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, max_n=2, buckets=10_000, min_words=20, percent=25):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    feats = [(i, *features(t, max_n)) for i, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for _, _, fs in feats:
        for f in fs:
            s[bucket(f)] += 1
    for text in target:
        for f in features(text, max_n)[1]:
            t[bucket(f)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (S + buckets) / ((a + 1) * (T + buckets)))) for a, b in zip(s, t)]
    rows, pool = {}, []
    for place, (i, w, fs) in enumerate(feats):
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows[place] = [i, len(fs), weight, score, None]
        if len(w) >= min_words:
            pool.append(place)
    order = sorted(pool, key=lambda p: (-rows[p][3], rows[p][0] is not None, rows[p][0] or 0, rows[p][1], rows[p][2]))
    for rank, p in enumerate(order[: percent * len(pool) // 100], start=1):
        rows[p][4] = rank
    return sorted(map(tuple, rows.values()), key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_crcs_of_all_ngrams(n):
    rnd = random.Random(n)
    texts = [" ".join("".join(rnd.choice("abzé9漢𝔸") for _ in range(rnd.choice([1, 2, 7, 90, 700]))) for _ in range(rnd.randint(0, 12)))
             for _ in range(20)] + ["", None, "  !", "x"]
    scans = [importance.prefix_crcs(t and t.encode()) for t in texts]
    words = np.array([len(c) for c, _ in scans])
    first = np.repeat(words.cumsum() - words, words)
    crc, heads = importance.ngram_crcs(np.concatenate([c for c, _ in scans]), np.concatenate([e for _, e in scans]), first, n)
    expected = [zlib.crc32(" ".join(w[i:i + n]).encode()) for t in texts for w in [WORDS.findall(t or "")] for i in range(len(w) - n + 1)]
    assert crc.tolist() == expected and len(heads) == len(expected)


def test_slices_do_not_change_the_scan(monkeypatch):
    text = ("word, Other  wörd\n" * 50 + "y" * 300 + " end").encode()
    whole = importance.prefix_crcs(text)
    monkeypatch.setattr(importance, "_SLICE", 64)
    for a, b in zip(whole, importance.prefix_crcs(text)):
        assert a.tolist() == b.tolist()


def test_query(spark):
    docs = [tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    target = [r.text for r in table(spark, FOLDER, "benchmark").collect()]
    df = queries.queries()["op11_prefix_crc_resampling"](spark, FOLDER)
    assert [f.dataType.simpleString() for f in df.schema.fields if f.name != "doc_id"] == ["bigint"] * 4
    assert got(df) == plain(docs, target)


def test_odd_rows(spark):
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice(["Alpha", "beta", "çà", "42", "x-y"]) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 60))) for i in range(80)] + [(80, None), (81, ""), (82, " .\n"), (None, text(30)), (None, None)]
    docs += [(7, text(25)), docs[3], docs[3], (90, text(60_000)), (91, "q" * 200_000)]
    target = ["alpha beta", None, "", "çà 42 " * 20]
    frame = spark.createDataFrame([(*d, 1, "b") for d in docs], "doc_id long, text string, TEXT int, band string")
    wanted = spark.createDataFrame([(t, 5) for t in target], "text string, doc_id int")
    assert got(importance.resample(frame, wanted)) == plain(docs, target)
    small = ImportanceOptions(max_n=3, buckets=70_000, min_words=5, percent=60, band=3)
    assert got(importance.resample(frame, wanted, small)) == plain(docs, target, 3, 70_000, 5, 60)
    assert got(importance.resample(frame, wanted.limit(0))) == plain(docs, [])
    assert importance.resample(frame.limit(0), wanted).count() == 0


def test_equal_scores_go_to_smaller_ids(spark):
    rows = [(i, 30, 1, 0, 5000 - 10 * (i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    ranks = {r.doc_id: r["rank"] for r in importance.drawn(df).collect()}
    assert [ranks[i] for i in range(0, 20, 2)] == list(range(1, 11)) and sum(r is not None for r in ranks.values()) == 10
