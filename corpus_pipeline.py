"""Corpus preparation in stages, each one written as Parquet and read again by the next.

STAGES holds (name, function); a function takes (spark, docs, sf_dir) and returns a frame.
All but the last keep the columns of `documents`:

1. language ID: rows without a known language go.
2. toxicity: rows scored 0.5 or more go; the model learns from the labels of rows still there.
3. n-gram Jaccard join: of each group of near-duplicates the smallest id stays.
4. source mix: a document comes as often as the mix takes it, so 0 to 3 times.
5. BPE: the ids of every row, and digests of ids and decoded text.

Defined cases: a null or empty text, or one without a letter, has no known language and goes in
stage 1; a null source is a source of its own; rows without an id stay through the join, and
of rows with equal id and text one stays, always the same; extra columns are carried along
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.llm import bpe, langid, mixing, ngram_join, toxicity
from storepulse.llm.common import prepare, stored, table
from storepulse.llm.queries import TOKENIZER, token_digests


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return langid.in_known_language(docs, langid.fit(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(prepare(spark), sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ngram_join.first_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_digests(bpe.encode_and_decode(docs, TOKENIZER), "ids")


STAGES = [
    ("language id", known_language),
    ("toxicity", not_toxic),
    ("ngram jaccard join", one_of_each_group),
    ("source mix", source_mix),
    ("bpe", token_ids),
]

# The learned classifiers and the budget fit have no SQL form; tests hold the run against
# the brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents` table."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
