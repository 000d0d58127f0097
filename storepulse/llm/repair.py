"""Token-id files: Re-Pair grammar compression per shard, with random access.

Texts are put in ascending id order by a range shuffle, encoded, and cut into shards of
about `shard_ids` ids. A shard is one row of a Parquet table with a binary block:

    magic, counts | alphabet | rules (left, right) | expansion length of each rule
    | first symbol of each document | first id of each document | symbols

Symbols below the alphabet size are ids; each further one is a rule that stands for a pair
of earlier symbols. Rules never cross a document's end, so one document, or any range of
ids, is decoded from its own symbols alone; the stored lengths tell where a range begins.

Frequent pairs are replaced in rounds. A round counts all pairs of the `counted` most
frequent symbols exactly (a frequent pair consists of frequent symbols) and replaces, most
frequent first, every pair that cannot overlap one chosen before it.

Defined cases: a null or empty text has the end id alone; null document ids sort first;
rows with the same id are all written, ordered by a hash of their text; a text longer than
a shard gets a longer shard of its own; an empty table gives no shards; extra columns are
ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storepulse.llm.bpe import ByteBpe, FragmentEncoder
from storepulse.llm.common import WORTH, fresh_path, gathered, pick, small_batches

MAGIC = b"RPG1"
HEAD = struct.Struct("<4sIIIQQ")
SHARDS = "part int, shard int, n_docs int, n_tokens long, doc_ids array<bigint>, block binary"


@dataclass(frozen=True)
class RepairOptions:
    end_id: int = 0
    shard_ids: int = 1 << 20
    counted: int = 1024
    min_count: int = 24
    min_gain: float = 0.01
    rounds: int = 16


# --- grammar ----------------------------------------------------------------------------

def compress(ids: np.ndarray, lengths: np.ndarray, options: RepairOptions = RepairOptions()) -> bytes:
    """The block of one shard. ids: all documents in order; lengths: ids of each document."""
    ids = np.ascontiguousarray(ids, np.uint32)
    present = np.bincount(ids, minlength=1) > 0
    alphabet = np.flatnonzero(present).astype(np.uint32)
    local = np.cumsum(present, dtype=np.int64).astype(np.int32)
    # Symbol 0 marks a document's end while rules are made, so no pair crosses it.
    ends = np.cumsum(lengths)
    seq = np.insert(local[ids], ends, 0) if len(ids) else np.zeros(len(lengths), np.int32)
    lefts, rights, total = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], len(alphabet) + 1
    for _ in range(options.rounds):
        seq, left, right = _round(seq, total, options)
        if not len(left):
            break
        lefts.append(left)
        rights.append(right)
        total += len(left)
        if len(seq) > (1 - options.min_gain) * (len(seq) + _saved(seq, total - len(left), total)):
            break
    left, right = np.concatenate(lefts) - 1, np.concatenate(rights) - 1
    marks = np.flatnonzero(seq == 0)
    starts = np.r_[0, marks - np.arange(len(marks))].astype(np.uint32)
    symbols = seq[seq != 0] - 1
    size = _lengths(len(alphabet), left, right)
    first_ids = np.r_[0, ends].astype(np.uint64)
    wide = np.uint16 if total <= 1 << 16 else np.uint32
    head = HEAD.pack(MAGIC, len(alphabet), len(left), np.dtype(wide).itemsize, len(lengths), len(symbols))
    return b"".join([
        head, alphabet.tobytes(), left.astype(np.uint32).tobytes(), right.astype(np.uint32).tobytes(),
        size[len(alphabet):].astype(np.uint32).tobytes(), starts.tobytes(), first_ids.tobytes(), symbols.astype(wide).tobytes(),
    ])


def _saved(seq: np.ndarray, low: int, high: int) -> int:
    return int(((seq >= low) & (seq < high)).sum())


def _round(seq: np.ndarray, total: int, options: RepairOptions):
    """Replace one set of pairs that cannot overlap; returns the shorter sequence and the new rules."""
    none = np.zeros(0, np.int32)
    if len(seq) < 2:
        return seq, none, none
    counts = np.bincount(seq, minlength=total)
    counts[0] = 0
    width = min(options.counted, total - 1)
    top = np.argpartition(-counts, width - 1)[:width] if width else none
    top = top[counts[top] >= options.min_count]
    if not len(top):
        return seq, none, none
    least = max(options.min_count, int(counts[top].min()) if len(top) == options.counted else 0)
    a = len(top)
    rank = np.full(total, a, np.int32)
    rank[top] = np.arange(a, dtype=np.int32)
    # Pairs as numbers; in those with a symbol that is not counted, one digit is `a`.
    w = a + 1
    r = rank[seq] if w * w < 1 << 31 else rank[seq].astype(np.int64)
    pair = r[:-1] * w
    pair += r[1:]
    flat = np.bincount(pair, minlength=w * w).reshape(w, w)[:a, :a].ravel()
    best = np.flatnonzero(flat >= least)
    best = best[np.argsort(-flat[best], kind="stable")]
    firsts, seconds, chosen = set(), set(), []
    for p in best.tolist():
        x, y = divmod(p, a)
        if x in seconds or y in firsts or (x == y and x in firsts):
            continue
        firsts.add(x)
        seconds.add(y)
        chosen.append(p)
        if x == y:  # nothing else may begin or end with it
            firsts.add(y)
            seconds.add(x)
    if not chosen:
        return seq, none, none
    x, y = np.divmod(np.array(chosen), a)
    made = np.zeros(w * w, np.int32)
    made[x * w + y] = np.arange(total, total + len(chosen), dtype=np.int32)
    new = made[pair]
    at = np.flatnonzero(new)
    if (x == y).any():
        # In a run of one symbol every second pair is taken.
        runs = np.flatnonzero(seq[at] == seq[at + 1])
        begins = np.r_[True, np.diff(at[runs]) > 1] if len(runs) else np.zeros(0, bool)
        run = np.maximum.accumulate(np.where(begins, np.arange(len(runs)), 0)) if len(runs) else runs
        at = np.delete(at, runs[(np.arange(len(runs)) - run) % 2 == 1])
    out = seq.copy()
    out[at] = new[at]
    keep = np.ones(len(seq), bool)
    keep[at + 1] = False
    return out[keep], top[x].astype(np.int32), top[y].astype(np.int32)


def _lengths(alphabet: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    size = [1] * alphabet
    for x, y in zip(left.tolist(), right.tolist()):
        size.append(size[x] + size[y])
    return np.array(size, np.int64)


class Shard:
    """Random access to a block."""

    def __init__(self, block: bytes):
        magic, n_alpha, n_rules, wide, n_docs, n_symbols = HEAD.unpack_from(block)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEAD.size

        def take(kind, n):
            nonlocal at
            found = np.frombuffer(block, kind, n, at)
            at += found.nbytes
            return found

        self.n_docs = n_docs
        alphabet, left, right = take(np.uint32, n_alpha), take(np.uint32, n_rules), take(np.uint32, n_rules)
        self.sizes = np.r_[np.ones(n_alpha, np.int64), take(np.uint32, n_rules).astype(np.int64)]
        self.starts, self.first_ids = take(np.uint32, n_docs + 1), take(np.uint64, n_docs + 1)
        self.symbols = take(np.uint16 if wide == 2 else np.uint32, n_symbols)
        self.expanded = [x.tobytes() for x in alphabet]
        for x, y in zip(left.tolist(), right.tolist()):
            self.expanded.append(self.expanded[x] + self.expanded[y])

    def document_bytes(self, i: int) -> bytes:
        """Ids of one document as little-endian unsigned 32-bit integers."""
        own = self.symbols[self.starts[i]:self.starts[i + 1]]
        return b"".join(map(self.expanded.__getitem__, own.tolist()))

    def document(self, i: int) -> np.ndarray:
        return np.frombuffer(self.document_bytes(i), np.uint32)

    def ids(self) -> np.ndarray:
        """All ids of the shard, documents in order."""
        flat, sizes = np.frombuffer(b"".join(self.expanded), np.uint32), self.sizes[self.symbols]
        begins = (self.sizes.cumsum() - self.sizes)[self.symbols]
        return flat[gathered(begins, sizes)]

    def id_range(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the shard; only the symbols that overlap the range are expanded."""
        reach = np.cumsum(self.sizes[self.symbols])
        start, stop = max(start, 0), min(stop, int(reach[-1]) if len(reach) else 0)
        if start >= stop:
            return np.zeros(0, np.uint32)
        low, high = np.searchsorted(reach, start, "right"), np.searchsorted(reach, stop, "left") + 1
        before = int(reach[low - 1]) if low else 0
        got = np.frombuffer(b"".join(map(self.expanded.__getitem__, self.symbols[low:high].tolist())), np.uint32)
        return got[start - before:stop - before]


# --- encoding with the library ----------------------------------------------------------

# Bytes that a space character may hold or begin with in UTF-8; fragments with one are looked at closely.
_SPACED = np.isin(np.arange(256), [*range(33), 127, 0xC2, 0xE1, 0xE2, 0xE3])


class LibraryEncoder(FragmentEncoder):
    """Ids by the `tokenizers` library. Fragments between forced cuts are encoded once and
    remembered in Arrow arrays; a text with a special token goes to the library as it is."""

    group, signs = 1 << 24, True

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # Spark runs the tasks side by side; threads of the library would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = ByteBpe(path)
        self.token_size = spec.token_size
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        super().__init__(spec.cut, spec.special)

    def forget(self) -> None:
        self.known = pa.array([], pa.binary())
        self.known_ids, self.known_sizes = np.zeros(0, np.uint32), np.zeros(0, np.int32)

    @property
    def held(self) -> int:
        """Bytes remembered; looking up takes about as many again for a while."""
        return self.known.nbytes + self.known_ids.nbytes + self.known_sizes.nbytes

    def compute_whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.library.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, np.uint32).tobytes() for e in encoded]

    def _looked_up(self, fragments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Fragments met before come from memory, the others from the library."""
        if self.held > self.remembered:
            self.forget()
        at = pc.index_in(fragments, value_set=self.known)
        new = fragments.filter(at.is_null())
        new_ids, new_sizes = self.compute_all(new)
        # Places behind the known ones are those of the new fragments, in their order.
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        place[place < 0] = len(self.known) + np.arange(len(new))
        ids, sizes = np.concatenate([self.known_ids, new_ids]), np.concatenate([self.known_sizes, new_sizes])
        begins = sizes.cumsum(dtype=np.int64) - sizes
        found = sizes[place].astype(np.int64)
        data = ids[gathered(begins[place], found)]
        short = pc.less_equal(pc.binary_length(new), WORTH).to_numpy(zero_copy_only=False)
        if short.all():
            self.known_ids, self.known_sizes = ids, sizes
        else:
            keep = np.repeat(short, new_sizes)
            self.known_ids = np.concatenate([self.known_ids, new_ids[keep]])
            self.known_sizes = np.concatenate([self.known_sizes, new_sizes[short]])
            new = new.filter(pa.array(short))
        self.known = pa.concat_arrays([self.known, new])
        return data, found

    def compute_all(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Encode fragments not met before as one text, each after its own space or a line feed.

        Without space characters inside, a fragment has forced cuts on both sides there; the
        bytes of the tokens tell whose ids are whose. Other fragments are encoded one by one.
        Returns all ids end to end, and how many each fragment has.
        """
        if not len(new):
            return np.zeros(0, np.uint32), np.zeros(0, np.int32)
        bounds = np.frombuffer(new.buffers()[1], np.int32, len(new) + 1, 4 * new.offset)
        codes = np.frombuffer(new.buffers()[2], np.uint8, bounds[-1])
        spaced = codes[bounds[:-1]] == 32
        begins, stops = bounds[:-1] + spaced, bounds[1:]
        odd = np.append(0, _SPACED[codes].cumsum(dtype=np.int32))
        plain = (odd[stops] == odd[begins]) & (begins < stops)
        for i in np.flatnonzero(~plain).tolist():
            word = new[i].as_py().decode()[int(spaced[i]):]
            plain[i] = word.split() == [word]
        others = self.compute_whole([x.decode() for x in new.filter(pa.array(~plain)).to_pylist()])
        shown, lead = new.filter(pa.array(plain)), pa.array(~spaced[plain])
        sizes = np.zeros(len(new), np.int32)
        ids = np.zeros(0, np.uint32)
        if len(shown):
            joined = pc.binary_join_element_wise(pc.if_else(lead, pa.scalar(b"\n"), pa.scalar(b"")), shown, pa.scalar(b""))
            ends = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1, 4 * joined.offset)
            whole = joined.buffers()[2].to_pybytes()[ends[0]:ends[-1]].decode()
            all_ids = np.frombuffer(self.compute_whole([whole])[0], np.uint32)
            reach = np.append(0, self.token_size[all_ids].cumsum())
            skip, stops = ~spaced[plain], ends[1:] - ends[0]
            starts = ends[:-1] - ends[0] + skip
            first, last = np.searchsorted(reach, starts), np.searchsorted(reach, stops)
            if (reach[last] != stops).any() or (reach[first] != starts).any():
                raise ValueError("a token reaches over a forced cut")
            # Only the line feeds set in before fragments are left out.
            keep = np.ones(len(all_ids), bool)
            keep[first[skip] - 1] = False
            ids, sizes[plain] = all_ids[keep], last - first
        if others:
            sizes[~plain] = [len(x) // 4 for x in others]
            both = np.zeros(int(sizes.sum()), np.uint32)
            from_others = np.repeat(~plain, sizes)
            both[from_others], both[~from_others] = np.frombuffer(b"".join(others), np.uint32), ids
            ids = both
        return ids, sizes


@lru_cache(maxsize=1)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


# --- Spark ------------------------------------------------------------------------------

def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts, some megabytes at a time: a fragment is looked up once per group."""
    names, texts, size = [], [], 0
    for batch in small_batches(batches):
        names += batch.column(0).to_pylist()
        texts += [t or "" for t in batch.column(1).to_pylist()]
        size += batch.column(1).nbytes
        if size >= LibraryEncoder.group:
            yield names, texts
            names, texts, size = [], [], 0
    if names:
        yield names, texts


def write_shards(docs: DataFrame, path: str, encoder: Callable[[], Callable[[list[str]], list[bytes]]],
                 options: RepairOptions = RepairOptions(), key: str = "doc_id", text: str = "text") -> str:
    """Encode all texts in ascending key order and write the shard table to `path`."""
    base = pick(docs, key, text).withColumn("tie", F.xxhash64(text))
    ordered = base.repartitionByRange(key, "tie").sortWithinPartitions(key, "tie").select(key, text)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, shard = encoder(), TaskContext.get().partitionId(), 0
        end = np.uint32(options.end_id).tobytes()
        keys, held, size = [], [], 0

        def flush():
            lengths = np.fromiter(map(len, held), np.int64, len(held)) // 4
            block = compress(np.frombuffer(b"".join(held), np.uint32), lengths, options)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(held)], pa.int32()),
                    pa.array([int(lengths.sum())], pa.int64()), pa.array([keys], pa.list_(pa.int64())),
                    pa.array([block], pa.binary()),
                ],
                ["part", "shard", "n_docs", "n_tokens", "doc_ids", "block"],
            )

        for names, texts in _gathered(batches):
            for k, ids in zip(names, encode(texts)):
                keys.append(k)
                held.append(ids + end)
                size += len(held[-1])
                if size >= 4 * options.shard_ids:
                    yield flush()
                    keys, held, size, shard = [], [], 0, shard + 1
        if held:
            yield flush()

    ordered.mapInArrow(pack, SHARDS).write.parquet(path)
    return path


def read_documents(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Decode every document of a shard table: (key, start, n_tokens, ids_crc32)."""
    shards = spark.read.schema(SHARDS).parquet(path)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            row = batch.to_pylist()[0]
            shard = Shard(row["block"])
            first, n = shard.first_ids.astype(np.int64), shard.n_docs
            data, bounds = memoryview(shard.ids()).cast("B"), (4 * first).tolist()
            crc = [zlib.crc32(data[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * n, pa.int32()),
                    pa.array([row["shard"]] * n, pa.int32()), pa.array(first[:-1]), pa.array(np.diff(first)),
                    pa.array(crc, pa.int64()),
                ],
                [key, "part", "shard", "inner", "n_tokens", "ids_crc32"],
            )

    rows = shards.select("part", "shard", "doc_ids", "block").mapInArrow(
        unpack, f"{key} bigint, part int, shard int, inner long, n_tokens long, ids_crc32 long"
    )
    # Shards before a shard: first over parts (one row per written task), then inside a part.
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    inside = shards.select(
        "part", "shard", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).alias("before_shard"),
    )
    bases = inside.join(before, "part").select("part", "shard", (F.col("before_part") + F.col("before_shard")).alias("base"))
    return rows.join(bases, ["part", "shard"]).select(
        key, (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32",
    )


def token_files(docs: DataFrame, tokenizer_path: str, options: RepairOptions = RepairOptions()) -> DataFrame:
    """Encode by the library, write the shards, read them back."""
    spark = docs.sparkSession
    path = write_shards(docs, fresh_path(spark, "tokens"), lambda: library_encoder(tokenizer_path), options)
    return read_documents(spark, path)
