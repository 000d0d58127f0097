"""Token files and BPE against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from storepulse.llm import bpe, repair

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n", "a", "one two  three\n\nfour \n five\t", "don't we'll I'M", "x" * 5000, "ab" * 4000 + " " * 300,
    "naïve 漢字 🙂‍　x \n y", "<|endoftext|> a<|endoftext|>b  <|endoftext|>", "stop., and, go... 12,3.4 (a,b.)",
    "nul\0byte \x1c\x1d odd\x85 spaces", "word " * 3000, "!?" * 700, "a" * 200_000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "again", "y"), (3, "again", "y"), (None, "no id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, `Text.x` string")


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encode_and_decode(spark, docs, library):
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert len(got) == len(TEXTS) + 3
    for row in got:
        if row.doc_id is not None and row.doc_id != 3:
            want = ids_of(library, TEXTS[row.doc_id])
            assert row.ids == want
            assert row.decoded == library.decode(want, skip_special_tokens=False)
    once = bpe.encode_and_decode(docs, PATH)
    assert sorted(map(repr, once.collect())) == sorted(map(repr, got))
    assert bpe.encode_and_decode(docs.limit(0), PATH).count() == 0


def test_unknown_ids_and_null(spark):
    df = spark.createDataFrame([([72, 101],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(df, PATH).collect()][1:] == [None, ""]
    broken = spark.createDataFrame([([220, 10_000_000],)], "ids array<int>")
    with pytest.raises(Exception, match="IndexError|out of range"):
        bpe.decode(broken, PATH).collect()


def test_a_forced_boundary_is_in_no_token():
    codec = bpe.codec(PATH)
    rng = np.random.default_rng(1)
    for token in rng.choice(len(codec.bytes_of) - 1, 2000):
        raw = codec.bytes_of[int(token)]
        assert all(codec.inside[a, b] for a, b in zip(raw, raw[1:]))
    assert codec.cut


def test_long_merges_equal_short_ones():
    codec = bpe.codec(PATH)
    rng = np.random.default_rng(2)
    for _ in range(200):
        raw = bytes(rng.choice(list(b"aeinrst "), int(rng.integers(2, 60))).tolist())
        start = codec.single[list(raw)]
        together = codec._merge_pieces(np.r_[start, start[:3]], np.r_[np.zeros(len(start), int), np.ones(len(start[:3]), int)])
        assert codec._merge_long(start.tolist()) == together[0][together[1] == 0].tolist()


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0
    assert repair.token_files(empty, PATH).count() == 0


ODD = [
    "word, word. word! word word?! wordé, éword; w:.", ".,;!? a.b,c 1. 2, A.\n.B ,\n", "it's, don't. we'll! 's, x.'s y,'ll",
    "a\u3000b\u2028c\u00a0d\u1680e\u0085f \u3000 \u00bfq? \u00a1x!", "x.  y,\t z;\r\nw:  \n . , ", "k" * 200 + "., " + "k" * 200,
    "東京、です。 ひらがな 東京. \u2026 a\u2014b", "nul\0, x\x1c. \x7f", "." * 3000 + "a" + "," * 3000, "", " ", "\n", " \n ", "e\u0301, e\u0301",
]


@pytest.mark.parametrize("remembered", [0, 300, 1 << 26])
def test_library_ids_whatever_is_remembered(library, remembered):
    encode = repair.LibraryEncoder(PATH)
    encode.remembered = remembered
    rng = np.random.default_rng(3)
    for _ in range(6):
        texts = [ODD[i] for i in rng.permutation(len(ODD))[:7]] + ["".join(rng.choice(list("ab ,.\n\u3000é"), 60))]
        for text, ids in zip(texts, encode(texts)):
            assert np.frombuffer(ids, np.uint32).tolist() == ids_of(library, text)


def test_words_met_before_are_not_encoded_again():
    """Remembering is bounded by bytes: 20,000 words fit into a megabyte."""
    encode, asked = repair.LibraryEncoder(PATH), []
    encode.remembered = 1 << 20
    whole = encode.compute_whole
    encode.compute_whole = lambda texts: asked.extend(texts) or whole(texts)
    words = [f"w{i:05d}x" for i in range(20_000)]
    first = encode([" ".join(words)])
    assert sum(map(len, asked)) >= 7 * len(words)
    asked.clear()
    assert encode([" ".join(words)]) == first
    encode([" ".join(["w00000x", *(w + s for w, s in zip(words[1:], ",.!;"))])])
    assert sum(map(len, asked)) <= 40  # the signs, and nothing else


@pytest.mark.parametrize("seed", range(4))
def test_grammar_round_trip_and_random_access(seed):
    rng = np.random.default_rng(seed)
    words = [rng.integers(0, 300, int(rng.integers(1, 6))) for _ in range(60)]
    docs = [np.concatenate([words[i] for i in rng.zipf(1.5, int(rng.integers(0, 400))) % 60] + [[7] * int(rng.integers(0, 9)), [0]])
            for _ in range(80)]
    lengths = np.array([len(x) for x in docs])
    flat = np.concatenate(docs).astype(np.uint32)
    block = repair.compress(flat, lengths, repair.RepairOptions(min_count=3))
    shard = repair.Shard(block)
    assert len(block) < flat.nbytes
    for i, want in enumerate(docs):
        assert (shard.document(i) == want).all()
    assert (np.diff(shard.first_ids.astype(np.int64)) == lengths).all()
    for start, stop in ((0, 1), (5, 5), (100, 700), (len(flat) - 3, len(flat) + 10)):
        assert (shard.id_range(start, stop) == flat[start:stop]).all()


def test_runs_of_one_id_and_documents_without_ids():
    flat = np.array([5] * 1001 + [0] + [5] * 4 + [0], np.uint32)
    shard = repair.Shard(repair.compress(flat, np.array([1002, 0, 5]), repair.RepairOptions(min_count=2)))
    assert [len(shard.document(i)) for i in range(3)] == [1002, 0, 5]
    assert (np.r_[shard.document(0), shard.document(2)] == flat).all()


def test_token_files(spark, docs, library):
    """Small shards, so that documents, repeated ids and the null id spread over many."""
    options = repair.RepairOptions(shard_ids=2000, min_count=4)
    got = repair.token_files(docs, PATH, options).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 3, 3, *range(4, len(TEXTS))]
    at = 0
    for row in got:
        assert row.start == at
        at += row.n_tokens
        if row.doc_id is not None and row.doc_id != 3:
            ids = np.array([*ids_of(library, TEXTS[row.doc_id]), 0], np.uint32)
            assert (row.n_tokens, row.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_queries_on_a_whole_table(spark, library):
    from storepulse.llm import queries

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    files = {r.doc_id: r for r in queries.queries()["op1_repair_files"](spark, folder).collect()}
    coded = {r.doc_id: r for r in queries.queries()["op2_bpe_forced_boundaries"](spark, folder).collect()}
    at = 0
    for doc_id in sorted(texts):
        ids = ids_of(library, texts[doc_id])
        whole = np.array([*ids, 0], np.uint32)
        assert tuple(files[doc_id][c] for c in ("start", "n_tokens", "ids_crc32")) == (at, len(whole), zlib.crc32(whole.tobytes()))
        at += len(whole)
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (coded[doc_id].n_tokens, coded[doc_id].ids_sha256) == (len(ids), digest)
        assert coded[doc_id].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_ids_text(spark):
    df = spark.createDataFrame([([1, 22, 3],), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(bpe.ids_text(F.col("ids"))).collect()] == ["1,22,3", ""]
