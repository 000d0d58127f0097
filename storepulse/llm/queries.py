"""The dealt operators as named queries over a folder of tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.llm import bpe, conversations, importance, langid, mixing, ngram_join, quality, repair, subspace, toxicity, urls, vptree, warc
from storepulse.llm.common import crc_fold, prepare, table

Query = Callable[[SparkSession, str], DataFrame]
# Vocabulary files are a parameter of the operators; the queries name the installed ones.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    _QUERIES[fn.__name__] = run
    return fn


def token_digests(coded: DataFrame, *more: str) -> DataFrame:
    """Counts and digests of (doc_id, ids, decoded)."""
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.ids_text(F.col("ids")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), *more,
    )


@query
def op1_repair_files(spark, sf_dir):
    return repair.token_files(table(spark, sf_dir, "documents"), TOKENIZER)


@query
def op2_bpe_forced_boundaries(spark, sf_dir):
    return token_digests(bpe.encode_and_decode(table(spark, sf_dir, "documents"), TOKENIZER))


@query
def op3_subset_sum_mix(spark, sf_dir):
    return mixing.taken_words(mixing.mix(table(spark, sf_dir, "documents")))


@query
def op4_subspace_near_duplicates(spark, sf_dir):
    return subspace.near_duplicates(table(spark, sf_dir, "embeddings"))


# A vector takes part when it is there, finite and not zero; sums run in the order of the components.
_VECTORS = """
    select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
    where embedding is not null and len(embedding) > 0 and vec_id is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0
"""
_DOT = "list_reduce(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] * {1}[i]), lambda s, x: s + x)"

_SQL["op4_subspace_near_duplicates"] = f"""
with recursive vectors as ({_VECTORS}),
normed as (select vec_id, v, sqrt({_DOT.format("v", "v")}) as norm from vectors),
links as (
    select a.vec_id as a, b.vec_id as b from normed a join normed b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
    where {_DOT.format("a.v", "b.v")} / (a.norm * b.norm) >= 0.9
),
reach as (
    select vec_id as a, vec_id as b from embeddings
    union
    select r.a, l.b from reach r join links l on l.a = r.b
),
component as (select a as vec_id, min(b) as component_id from reach group by a)
select e.vec_id, (select count(*) from links where links.a = e.vec_id) as n_links, c.component_id,
       e.vec_id = c.component_id as kept
from embeddings e join component c using (vec_id)
"""


@query
def op5_vantage_point_search(spark, sf_dir):
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


_SQL["op5_vantage_point_search"] = f"""
with vectors as ({_VECTORS}),
scored as (
    select q.vec_id as query_id, c.vec_id, {_DOT.format("q.v", "c.v")} as score
    from vectors q join vectors c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
    where q.vec_id % 20 = 0
),
placed as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored)
select query_id, rank, vec_id, score from placed where rank <= 20
"""


@query
def op6_toxicity_trees(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_fold(F.col("doc_id"), 5) == 0
    learn = labels.select("doc_id", F.col("toxic").alias("label")).filter(F.col("doc_id").isNotNull() & ~held_out)
    model = toxicity.fit(docs, learn)
    return toxicity.scored(docs, model).select(
        "doc_id", held_out.alias("held_out"), F.col("tox_score").alias("score"),
        (F.col("tox_score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op7_language_hierarchy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 3) == 1
    model = langid.fit(docs.filter(~held_out))
    return langid.identified(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
    )


@query
def op8_url_trees(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query
def op9_warc_chunks(spark, sf_dir):
    return warc.archived_pages(spark, table(spark, sf_dir, "pages"))


_SQL["op9_warc_chunks"] = """
with sized as (
    select page_id, coalesce(html, '') as body, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes,
           sha256(coalesce(html, '')) as payload_digest
    from pages
), firsts as (
    select payload_digest, min(page_id) as first_id from sized where payload_bytes >= 100 group by payload_digest
)
select s.page_id, s.payload_bytes, s.payload_digest,
       case when f.first_id is not null and s.page_id <> f.first_id then 'revisit' else 'response' end as record_type,
       case when s.page_id <> f.first_id then f.first_id end as refers_to
from sized s left join firsts f using (payload_digest)
"""


@query
def op10_ngram_matrix_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


_SQL["op10_ngram_matrix_join"] = """
with recursive words as (
    select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
    from documents
),
sets as (
    select doc_id, case
        when len(w) = 0 then []
        when len(w) < 5 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as grams
    from words
),
sizes as (select doc_id, cast(len(grams) as bigint) as n from sets),
entries as (select doc_id, unnest(grams) as gram from sets),
common as (
    select a.doc_id as a, b.doc_id as b, count(*) as k
    from entries a join entries b on a.gram = b.gram and a.doc_id <> b.doc_id group by all
),
links as (
    select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where 100 * k >= 75 * (x.n + y.n - k)
),
reach as (
    select doc_id as a, doc_id as b from documents
    union
    select r.a, l.b from reach r join links l on l.a = r.b
)
select s.doc_id, s.n as n_shingles, min(r.b) as component_id
from sizes s join reach r on r.a = s.doc_id group by s.doc_id, s.n
"""


@query
def op11_prefix_crc_resampling(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_conversation_repair(spark, sf_dir):
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


@query
def op13_quality_decision_list(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.judge(table(spark, sf_dir, "documents"), labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
