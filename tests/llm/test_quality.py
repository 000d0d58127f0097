"""Statistics, base limits and learned lists against plain versions and held-out labels."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from storepulse.llm import common, quality, queries
from storepulse.llm.quality import Condition, DecisionList, QualityOptions

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def plain(text):
    """The five counts and whether the base limits fail."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(8)}
    counts = [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)]
    return (*counts, len(words) < 20 or 100 * len(repeated) > 30 * len(words))


def measures(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    n, chars, symbols, dup, repeat, _ = plain(text)
    share = lambda a, b: a / b if b else 0.0
    count = lambda cs: sum(c in cs for c in text)
    return {
        "words": n, "word_length": share(chars, n), "symbols_per_word": share(symbols, n), "repeated_line_share": share(dup, len(lines)),
        "repeated_word_share": share(repeat, n), "distinct_word_share": share(len(set(words)), n),
        "capital_share": share(sum("A" <= c <= "Z" for c in text), chars), "digit_share": share(count("0123456789"), chars),
        "marks_per_word": share(count(".,;:!?"), n), "words_per_line": share(n, len(lines)),
    }


def applies(rules: DecisionList, text):
    found = measures(text)
    for rule in rules.rules:
        if all(found[c.measure] > c.threshold if c.above else found[c.measure] <= c.threshold for c in rule):
            return rules.verdict
    return not rules.verdict


def odd_texts():
    rnd = random.Random(2)
    words = ["a", "bb", "ç", "𝔸x", "#|", "9.", " ", "Z"]
    text = lambda n, k: "".join(rnd.choice(words[:k]) + rnd.choice([" ", " ", "\t", "\n", "\r\n", " \x0b "]) for _ in range(n))
    out = [text(rnd.randint(0, 60), rnd.choice([1, 2, 8])) for _ in range(150)]
    phrase = " ".join(f"w{i}" for i in range(9))
    out += [None, "", " \n\t", "\n\n", f"{phrase} x {phrase}", f"{phrase} {phrase}", "one two three four five six seven", "a " * 8, "a " * 9]
    return out + [" ".join(f"u{i}" for i in range(120_000)), "same line here\n" * 20_000, "x" * 300_000, text(300, 8), text(300, 8)]


def test_statistics(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, "z", 5) for i, t in enumerate(texts)], "doc_id long, text string, TEXT string, words int")
    got = quality.statistics(df).withColumn("failed", quality.base_failed()).orderBy("doc_id").collect()
    for row, t in zip(got, texts, strict=True):
        assert (*(row[c] for c in BASE), row.failed) == plain(t), repr((t or "")[:80])
    listed = quality.statistics(df).select("doc_id", *(c.alias(n) for n, c in quality.measures().items())).orderBy("doc_id").collect()
    for row, t in zip(listed, texts, strict=True):
        assert {n: row[n] for n in measures(t)} == pytest.approx(measures(t))


def test_query(spark):
    """The smallest folder has too few bad texts for a rule, so this runs on the next one."""
    folder = "/root/testdata/sf0.01"
    df = queries.queries()["op13_quality_decision_list"](spark, folder)
    assert dict(df.dtypes) == {"doc_id": "bigint", **dict.fromkeys(BASE, "bigint"), "base_failed": "boolean", "kept": "boolean"}
    docs = {r.doc_id: r.text for r in common.table(spark, folder, "documents").collect()}
    labels = common.table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    stats = common.stored(quality.statistics(common.table(spark, folder, "documents")), "stats")
    rules = quality.fit(quality.labelled_statistics(stats, labels))
    assert rules.rules and not rules.verdict
    got = df.collect()
    assert len(got) == len(docs)
    for r in got:
        *counts, failed = plain(docs[r.doc_id])
        assert [r[c] for c in BASE] == counts and r.base_failed == failed
        assert r.kept == (not failed and applies(rules, docs[r.doc_id]))


def test_base_columns_in_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{FOLDER}/documents.parquet')")
    sql = r"""
    select doc_id, cast(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as bigint) as n_words,
           cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
           cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
           cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines
    from (select doc_id, coalesce(text, '') as t,
                 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents)
    """
    expected = sorted(map(tuple, con.execute(sql).fetchall()))
    got = queries.queries()["op13_quality_decision_list"](spark, FOLDER).select("doc_id", *BASE[:4])
    assert sorted(map(tuple, got.collect())) == expected


def test_held_out_labels(spark):
    """Learned on some labels, the list must agree with the others and keep nearly all good texts."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (common.table(spark, folder, t) for t in ("documents", "labels"))
    held_out = common.crc_fold(F.col("doc_id"), 3) == 0
    labels = labels.select("doc_id", F.col("quality").alias("label"))
    judged = quality.judge(docs, labels.filter(~held_out)).join(labels.filter(held_out), "doc_id").filter("not base_failed").collect()
    good = [r.kept for r in judged if r.label == 1]
    bad = [r.kept for r in judged if r.label == 0]
    assert len(good) > 50 and sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_rules_are_found_and_ordered(spark):
    """Bad rows are those above 5 in one measure, or low in one and high in another."""
    rnd = random.Random(4)
    rows = []
    for _ in range(4000):
        x, y, z = (rnd.uniform(0, 10) for _ in range(3))
        rows.append((int(not (x > 8 or (y < 2 and z > 5))), x, y, z))
    df = spark.createDataFrame(rows, "label int, x double, y double, z double")
    found = {c: F.col(c) for c in "xyz"}
    rules = quality.fit(df, QualityOptions(bins=40), found)
    wrong = df.filter(rules.kept() != (F.col("label") == 1)).count()
    assert wrong < 0.03 * len(rows) and len(rules.rules) <= 6
    assert "x > " in str(rules) and "drop" in str(rules) and str(rules).endswith("else: keep")
    assert rules == quality.fit(df.repartition(7), QualityOptions(bins=40), found)


def test_first_rule_that_fits_decides(spark):
    rules = DecisionList(((Condition("x", True, 5.0),), (Condition("x", False, 1.0), Condition("y", True, 0.0))), False,
                         {"x": F.col("x"), "y": F.col("y")})
    df = spark.createDataFrame([(6.0, 0.0), (1.0, 1.0), (1.0, 0.0), (3.0, 3.0)], "x double, y double")
    assert [r[0] for r in df.select(rules.kept()).collect()] == [False, False, True, True]
    assert str(rules).splitlines()[1] == "else if x <= 1 and y > 0: drop"


def test_without_or_with_one_label(spark):
    good = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, good), (2, None), (3, "x"), (1, good), (None, good)], "doc_id long, text string")
    kept = lambda labels: sorted(r.kept for r in quality.judge(docs, spark.createDataFrame(labels, "doc_id long, label int")).collect())
    assert kept([]) == [False, False, True, True, True]
    assert kept([(1, 1), (9, 0), (None, 0), (1, None), (1, 7)]) == [False, False, True, True, True]
    assert kept([(1, 0)]) == [False] * 5
    assert quality.judge(docs.limit(0), spark.createDataFrame([(1, 0)], "doc_id long, label int")).count() == 0


def test_main_path_stays_in_the_jvm(spark):
    text = queries.queries()["op13_quality_decision_list"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    stats = quality.statistics(common.table(spark, FOLDER, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text + stats and "Arrow" not in text + stats and "Exchange" not in stats
