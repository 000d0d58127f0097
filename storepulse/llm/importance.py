"""Target-distribution importance resampling on hashed word n-grams, by prefix CRCs.

A document is normalised to its words (A-Z lower-cased; runs of digits, letters a-z and any
character beyond ASCII), each after one separator, and scanned once: the running CRC-32
after each word is kept. The CRC of any n-gram follows from two prefixes, because a prefix's
share in a longer one is a shift by so many zero bytes over GF(2) and cancels out:
crc(gram) = crc(prefix with gram) xor shift(crc(prefix before gram), bytes of gram).

Documents and target texts are counted per bucket of these CRCs, each bucket gets a log
ratio as gain, a document's weight is the mean gain of its n-grams, and documents are drawn
without replacement by weight plus seeded Gumbel noise.

Defined cases: a null or empty text, or one without a word, has no features and weight 0;
a null id is hashed as the empty text; repeated rows are counted, scored and ranked each for
itself, rows that agree in score and id by n_features, then weight; an empty table gives an
empty result, an empty target gives gains from smoothing alone; extra columns are ignored.
Very long texts are scanned in slices, which keep 12 bytes a word.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storepulse.llm.common import pick, small_batches, stored

# Bytes of words, A-Z lower-cased; every other ASCII byte separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PIECE = re.compile(rb" [^ ]+")
_SLICE = 1 << 20
_SHORT = 64


@dataclass(frozen=True)
class ImportanceOptions:
    """Feature space, noise seed and size of the draw.

    `band` is the width of the score bands that ranks are counted in; scores lie within some
    200,000 of each other, so bands are few whatever the number of documents.
    """

    max_n: int = 2
    buckets: int = 10_000
    seed: int = 7
    min_words: int = 20
    percent: int = 25
    band: int = 16


# --- CRC-32 over GF(2) -----------------------------------------------------------------

def _tables(images: np.ndarray) -> np.ndarray:
    """A linear map on 32 bits, given by the images of the single bits, as four byte tables."""
    out = np.zeros((4, 256), np.uint32)
    values = np.arange(256)
    for bit in range(32):
        out[bit // 8] ^= np.where(values >> (bit % 8) & 1, images[bit], 0).astype(np.uint32)
    return out


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


@cache
def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Shift tables for 0.._SHORT-1 zero bytes, and for _SHORT * 2**k zero bytes."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    # One zero byte, taken from the library: crc(x + zero) xor crc(zero) is linear in crc(x).
    one = np.array([zlib.crc32(b"\0", int(b)) ^ zlib.crc32(b"\0") for b in bits], np.uint32)
    step, images, short = _tables(one), bits, []
    for _ in range(_SHORT):
        short.append(_tables(images))
        images = _apply(step, images)
    doubled = []
    while len(doubled) < 40:
        doubled.append(_tables(images))
        images = _apply(doubled[-1], images)
    return np.concatenate([t.ravel() for t in short]), doubled


def shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each CRC's share in the CRC of a text with so many more bytes behind it."""
    short, doubled = _shifts()
    base = (zeros % _SHORT) * 1024
    out = short[base + (crc & 255)]
    out ^= short[base + 256 + (crc >> 8 & 255)]
    out ^= short[base + 512 + (crc >> 16 & 255)]
    out ^= short[base + 768 + (crc >> 24)]
    rest = zeros // _SHORT
    for k in range(int(rest.max(initial=0)).bit_length()):
        far = np.flatnonzero(rest >> k & 1)
        out[far] = _apply(doubled[k], out[far])
    return out


def prefix_crcs(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Running CRC and number of bytes after each word of the normalised document."""
    folded = (text or b"").translate(_FOLD)
    crc, at, start = 0, 0, 0
    crcs, ends = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    while start < len(folded):
        stop = start + _SLICE
        if stop < len(folded):
            # Cut before a separator; a word longer than a slice stays whole.
            cut = folded.rfind(b" ", start + 1, stop)
            stop = cut if cut > 0 else folded.find(b" ", stop)
            stop = len(folded) if stop < 0 else stop
        pieces = _PIECE.findall(b" " + b" ".join(folded[start:stop].split()))
        running = []
        for piece in pieces:
            crc = zlib.crc32(piece, crc)
            running.append(crc)
        crcs.append(np.array(running, np.uint32))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)).cumsum()
        ends.append(at + lengths)
        at = int(ends[-1][-1]) if len(pieces) else at
        start = stop
    return np.concatenate(crcs), np.concatenate(ends)


def ngram_crcs(crcs: np.ndarray, ends: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """CRCs of all n-grams of the documents laid end to end, and the places of their first words.

    first: place of the first word of each word's document.
    """
    words = np.arange(len(crcs))
    heads = words[: max(len(words) - n + 1, 0)]
    heads = heads[first[heads] == first[heads + n - 1]] if len(heads) else heads
    opens = heads == first[heads]
    before = np.where(opens, 0, crcs[heads - 1]).astype(np.uint32)
    at = np.where(opens, 0, ends[heads - 1]) + 1
    # The separator before the gram belongs to the prefix.
    before = np.array(_space()[0][(before & 255)] ^ before >> 8 ^ _space()[1], np.uint32)
    last = heads + n - 1
    return crcs[last] ^ shifted(before, ends[last] - at), heads


@cache
def _space() -> tuple[np.ndarray, np.uint32]:
    """Low-byte table of one more separator, and the constant part of it."""
    zero = zlib.crc32(b" ")
    return np.array([zlib.crc32(b" ", b) ^ zero for b in range(256)], np.uint32), np.uint32(zero)


# --- scan, counts, weights ---------------------------------------------------------------

def _scan_batch(texts: list, options: ImportanceOptions) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Words and features of each text, and the buckets of all features, text after text."""
    scans = [prefix_crcs(t) for t in texts]
    words = np.array([len(c) for c, _ in scans], np.int64)
    starts = words.cumsum() - words
    crcs, ends = np.concatenate([c for c, _ in scans]), np.concatenate([e for _, e in scans])
    doc = np.repeat(np.arange(len(texts)), words)
    first = starts[doc]
    per_n = [np.maximum(words - n, 0) for n in range(options.max_n)]
    features = sum(per_n)
    base = features.cumsum() - features
    out = np.zeros(int(features.sum()), _kind(options))
    for n, amount in enumerate(per_n, start=1):
        gram, heads = ngram_crcs(crcs, ends, first, n)
        out[base[doc[heads]] + heads - first[heads]] = gram % options.buckets
        base = base + amount
    return words, features, out


def _kind(options: ImportanceOptions) -> np.dtype:
    return np.dtype("<u2" if options.buckets <= 1 << 16 else "<u4")


def scanned(docs: DataFrame, options: ImportanceOptions = ImportanceOptions(), key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_features, buckets: little-endian numbers), one scan of each text."""
    width = _kind(options).itemsize

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 200):
            words, features, buckets = _scan_batch(batch["text"].to_pylist(), options)
            offsets = np.zeros(len(features) + 1, np.int32)
            np.cumsum(features * width, out=offsets[1:])
            lists = pa.Array.from_buffers(pa.binary(), len(features), [None, pa.py_buffer(offsets), pa.py_buffer(buckets)])
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(words), pa.array(features), lists],
                                             [key, "n_words", "n_features", "buckets"])

    bare = pick(docs, key, "text").withColumn("text", F.col("text").cast("binary"))
    kind = bare.schema[key].dataType.simpleString()
    return bare.mapInArrow(scan, f"{key} {kind}, n_words long, n_features long, buckets binary")


def _flat(column: pa.Array, kind: np.dtype) -> np.ndarray:
    """All numbers of a binary column, row after row."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]].view(kind)


def bucket_counts(scan: DataFrame, options: ImportanceOptions = ImportanceOptions()) -> DataFrame:
    """(bucket, n): features per bucket, added up within each task before the shuffle."""
    kind = _kind(options)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(options.buckets, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_flat(batch["buckets"], kind), minlength=options.buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    return scan.select("buckets").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, options: ImportanceOptions = ImportanceOptions()) -> np.ndarray:
    """Gain of each bucket in thousandths, from the counts of two tables; at most `buckets` rows come here."""
    s, t = [0] * options.buckets, [0] * options.buckets
    for counts, into in ((corpus, s), (target, t)):
        for bucket, n in counts.collect():
            into[bucket] = n
    all_s, all_t = sum(s) + options.buckets, sum(t) + options.buckets
    return np.array([
        math.floor(1000 * math.log(float(b + 1) * float(all_s) / (float(a + 1) * float(all_t)))) for a, b in zip(s, t)
    ], np.int64)


def weighted(scan: DataFrame, gain: np.ndarray, options: ImportanceOptions = ImportanceOptions(), key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_features, weight): the mean gain of each document's features, rounded down."""
    kind = _kind(options)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            n = batch["n_features"].to_numpy()
            sums = np.zeros(int(n.sum()) + 1, np.int64)
            np.cumsum(gain[_flat(batch["buckets"], kind)], out=sums[1:])
            stops = n.cumsum()
            weight = (sums[stops] - sums[stops - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch[key], batch["n_words"], batch["n_features"], pa.array(weight)],
                                             [key, "n_words", "n_features", "weight"])

    kind_of_key = scan.schema[key].dataType.simpleString()
    return scan.mapInArrow(weigh, f"{key} {kind_of_key}, n_words long, n_features long, weight long")


# --- draw --------------------------------------------------------------------------------

def gumbel(key: Column, seed: int) -> Column:
    """Seeded Gumbel noise of an id, in thousandths, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def drawn(scored: DataFrame, options: ImportanceOptions = ImportanceOptions(), key: str = "doc_id") -> DataFrame:
    """Adds `rank` to a stored (key, n_words, n_features, weight, score): 1, 2, ... for drawn rows.

    Rows are counted per band of scores; a row's rank is the count of all higher bands plus
    its place within its own, so no task sorts more than one band.
    """
    in_pool = F.col("n_words") >= options.min_words
    banded = scored.withColumn("band", F.floor(F.col("score") / options.band).cast("long"))
    amounts = sorted(banded.filter(in_pool).groupBy("band").count().collect(), reverse=True)
    wanted, before, above = options.percent * sum(n for _, n in amounts) // 100, [], 0
    for band, n in amounts:
        if above < wanted:
            before.append((band, above))
        above += n
    spark = scored.sparkSession
    # Bands hold `band` scores each and scores are bounded, so this table is small at any size.
    heads = F.broadcast(spark.createDataFrame(before, "band long, above long"))
    order = Window.partitionBy("band").orderBy(F.desc("score"), F.asc_nulls_first(key), "n_features", "weight")
    lowest = before[-1][0] if before else None
    reached = in_pool & (F.col("band") >= F.lit(lowest)) if before else F.lit(False)
    ranked = banded.filter(reached).join(heads, "band").withColumn("place", F.col("above") + F.row_number().over(order))
    columns = [key, "n_features", "weight", "score"]
    return ranked.select(*columns, F.when(F.col("place") <= wanted, F.col("place")).cast("long").alias("rank")).union(
        banded.filter(~reached).select(*columns, F.lit(None).cast("long").alias("rank"))
    )


def resample(docs: DataFrame, target: DataFrame, options: ImportanceOptions = ImportanceOptions(), key: str = "doc_id") -> DataFrame:
    """Every document with (key, n_features, weight, score, rank); rank is null for documents not drawn.

    target: any table with a `text` column that shows the wanted distribution.
    """
    scan = stored(scanned(docs, options, key), "importance-scan")
    wanted = scanned(pick(target, "text").withColumn("item", F.lit(0)), options, "item")
    gain = gains(bucket_counts(scan, options), bucket_counts(wanted, options), options)
    scored = weighted(scan, gain, options, key).withColumn("score", F.col("weight") + gumbel(F.col(key), options.seed))
    return drawn(stored(scored, "importance-scores"), options, key)
