"""Queries against their SQL, the registration, and the pipeline stage by stage."""

import hashlib
import os
import random
import sys

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from storepulse.llm import common, langid, ngram_join, queries

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle_compare import compare  # noqa: E402

from .brute import components_of_texts  # noqa: E402
from .test_mixing import nearest, plain_targets  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "labels", "benchmark", "conversations")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    df = queries.queries()[name](spark, FOLDER)
    sql = queries.oracle_sql()[name]
    assert compare(df.schema, df.toPandas(), con.execute(f"describe {sql}").fetchall(), con.execute(sql).df()) == ""


def test_registration():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and "fct_orders" in names


def test_url_query_follows_the_rules(spark):
    got = queries.queries()["op8_url_trees"](spark, FOLDER).collect()
    assert len(got) == spark.read.parquet(f"{FOLDER}/pages.parquet").count()
    for r in got:
        fits = [(len(rule), kind, rule) for kind, rule in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
                if (r.host == rule.split("/")[0] or r.host.endswith("." + rule.split("/")[0])) and r.path.startswith(rule[rule.index("/"):])]
        _, kind, rule = max(fits, default=(0, None, None))
        assert r.rule == rule and (kind is None or r.verdict == kind)


def test_pipeline_stages(spark):
    docs = common.table(spark, FOLDER, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.stored(stage(spark, docs, FOLDER), "pipeline-test")
        kept[name] = (before.toPandas(), docs.toPandas())
        if name != "bpe":
            assert docs.columns == columns
    before, after = kept["language id"]
    assert len(after) >= 0.98 * len(before)
    before, after = kept["toxicity"]
    assert 0.8 * len(before) <= len(after) <= len(before)
    before, after = kept["ngram jaccard join"]
    label = components_of_texts(dict(zip(before.doc_id, before.text)))
    assert set(after.doc_id) == set(label.values()) and len(after) == len(set(after.doc_id))
    before, after = kept["source mix"]
    count = lambda t: len([w for w in t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w])
    sizes, total = before.text.map(count), before.text.map(count).sum()
    assert abs(after.text.map(count).sum() - total) <= 20 and after.doc_id.value_counts().max() <= 3
    # Each source is as near to its target as any choice of 0 to 3 copies.
    goal = plain_targets(sizes.groupby(before.source.fillna("~")).sum().to_dict())
    for source, target in goal.items():
        taken = after[after.source.fillna("~") == source].text.map(count).sum()
        here = sizes[before.source.fillna("~") == source].tolist()
        assert abs(taken - int(round(target))) == nearest(here, [3] * len(here), int(round(target)))
    before, after = kept["bpe"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in zip(before.doc_id, before.text)}
    assert sorted(after.doc_id) == sorted(before.doc_id)
    for r in after.itertuples():
        assert list(r.ids) == ids[r.doc_id] and r.n_tokens == len(ids[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids[r.doc_id])).encode()).hexdigest()


def test_pipeline_with_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, clashing names, and no rows at all."""
    real = [tuple(r) for r in common.table(spark, FOLDER, "documents").limit(40).collect()]
    text = real[1][1]
    odd = [(None, text, "de", "src1", 5), (500, None, None, None, None), (501, "", "en", "src2", 0), (502, text, None, None, None),
           (503, "wort " * 30_000 + text, "de", "src3", 7), (504, "12 34", "en", "src1", 5), real[3], real[3]]
    columns = "doc_id long, text string, lang string, source string, n_chars long, row string, key int, score double, copies int, ids string, Doc string"
    docs = spark.createDataFrame([(*r, "r", 1, 0.5, 9, None, "d") for r in real + odd], columns)
    before = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before[name] = [r.doc_id for r in docs.collect()]
        docs = common.stored(stage(spark, docs, FOLDER), "pipeline-odd")
        assert [f.name for f in docs.schema.fields] == [c.split()[0] for c in columns.split(", ")]
        assert {(r.row, r.key, r.score, r.copies, r.Doc) for r in docs.collect()} == {("r", 1, 0.5, 9, "d")}
    # Without a letter there is no language; the row without an id stays; one of a group stays.
    assert not {500, 501, 504} & set(before["toxicity"]) and None in before["source mix"]
    ids = [i for i in before["source mix"] if i is not None]
    assert len(ids) == len(set(ids)) and 502 not in ids
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.count() == docs.count()
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = common.stored(stage(spark, none, FOLDER), "pipeline-none")
        assert none.count() == 0


def test_of_equal_ids_and_texts_the_same_row_stays(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text, "a"), (1, text, "b"), (1, text, "c"), (2, text, "d"), (None, text, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, note string")
    kept = [sorted(map(tuple, ngram_join.first_of_each(df.repartition(n)).collect()), key=repr) for n in (1, 3, 5)]
    assert kept[0] == kept[1] == kept[2] and [r[0] for r in kept[0]] == [1, None]


def test_run_is_the_stages_in_order(spark, monkeypatch):
    seen = []
    fake = lambda name: lambda s, d, f: (seen.append(name), d.limit(7))[1]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, fake(n)) for n, _ in corpus_pipeline.STAGES])
    assert corpus_pipeline.run(spark, FOLDER).count() == 7
    assert seen == ["language id", "toxicity", "ngram jaccard join", "source mix", "bpe"]


def test_components_of_long_chains_and_hubs(spark):
    rnd = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 400)]
    hub = [(rnd.randint(1000, 9000), 999) for _ in range(500)]
    edges = chain + hub + [(5, 5), (7, 8), (8, 7)]
    rnd.shuffle(edges)
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 401)} == {100} and got[999] == 999 and got[8] == 7 and 5 not in got
    assert all(got[a] == 999 for a, _ in hub)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stage_functions_use_the_operators():
    assert corpus_pipeline.langid is langid and corpus_pipeline.ngram_join is ngram_join
