"""Jaccard join of documents by word n-grams, as a blocked sparse matrix product.

Rows of the incidence matrix are documents, columns are hashed n-grams. The product of the
matrix with its transpose counts common n-grams; only entries that can reach the threshold
are ever computed:

1. Equal sets are one row (`node`, a hash of the set). Column counts go into a sketch of
   fixed size, which orders the columns from rare to common; any order is correct.
2. A pair with Jaccard >= t shares l columns among the first n - ceil(t n) + l of each row in
   that order (the size-derived bound), so only these entries are shuffled by column. An entry
   whose column has no other row of a size within the bound ends there, as most do, and so
   does every row with fewer than l such entries (l by the smallest partner it may have):
   rows that share a passage only. l grows with n (`longer`).
3. Rows that share columns are put into the same block: in each column a row is led by the
   smallest row within the bound, and it follows the one that leads it in most columns. A
   block holds at most about `block_entries` entries; a large group has several. A row also
   visits those other blocks that hold a row with which it shares such a column and whose
   size is within the bound.
4. A task multiplies one block at a time: it adds up full overlaps of rows through an index
   of the block's columns and keeps pairs with overlap / union >= t. Rows already linked leave
   the block's index, so a group costs about as much as its size, and only one link per
   connected row is handed on, never all pairs of a group.

Components of the links give each document the smallest id it can reach. Hashes have 64
bits; at 3e10 different texts about 25 pairs of texts would be expected to share a hash.

Defined cases: a null text, or one without words, has no n-grams and is its own component; a
text with fewer words than n has one n-gram, all of it; repeated rows are copies; a row with
a null id shares the component of documents with equal n-grams, and has a null one where no
such document has an id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.llm.common import Remembered, components, let_go, pick, small_batches, stored, tucked

SKETCH_BITS = 24  # counters of the column sketch: 16 million, one byte each when they reach the tasks
SKETCH_PARTS = 64
FILTER_BITS = 26  # bits of the filter for the ids whose texts are fetched: 8 MB
SETS = "doc_id long, n long, node long, part int, counts binary"
ENTRIES = "gram long, node long, n int"
ODD = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)], np.uint64)


@dataclass(frozen=True)
class JoinOptions:
    words: int = 5
    percent: int = 75  # links have 100 * overlap >= percent * union
    block_entries: int = 1_000_000
    longer: int = 8  # percent of a row's n-grams by which its first entries are lengthened

    def needed(self, n):
        """Smallest overlap of a linked pair in which one side has n n-grams."""
        return (n * self.percent + 99) // 100

    def first_shared(self, n):
        """How many of a row's first entries two linked rows share at least, as far as this row can tell."""
        return n * self.longer // 100 + 1

    def prefix(self, n):
        """First entries of a row: any `needed` common n-grams have `first_shared` of them among these."""
        return n - self.needed(n) + self.first_shared(n)

    def fewest(self, n):
        """First entries that a row shares with any partner at least; the smallest partner decides."""
        return self.first_shared(self.needed(n))


def _word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Shingler:
    """Text -> sorted distinct n-gram hashes. Hashes of words are remembered."""

    def __init__(self, words: int):
        self.words, self.known = words, Remembered(_word_hash)

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.lower and bytes.split know exactly the ASCII letters and spaces the definition names.
        words = (text or "").encode().lower().split()
        n, k = len(words), self.words
        if not n:
            return np.zeros(0, np.uint64)
        if n < k:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, n)
        total = h[: n - k + 1] * ODD[0]
        for i in range(1, k):
            total += h[i:n - k + 1 + i] * ODD[i]
        total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(total ^ (total >> np.uint64(32)))


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def sets_and_counts(docs: DataFrame, options: JoinOptions, key: str, text: str) -> DataFrame:
    """One row per document (id, n, node), and per task the counters of its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, counts = Shingler(options.words), np.zeros(1 << SKETCH_BITS, np.uint16)
        for batch in small_batches(batches):
            sets = [shingle(t) for t in batch.column(1).to_pylist()]
            if not sets:
                continue
            np.add.at(counts, slots(np.concatenate(sets)), 1)
            none = [None] * len(sets)
            yield _batch(
                batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.binary()),
            )
        # One byte per counter is enough for an order: a task that met a column 255 times says "often".
        parts = [
            (i, zlib.compress(np.minimum(c, 255).astype(np.uint8).tobytes(), 1))
            for i, c in enumerate(np.split(counts, SKETCH_PARTS)) if c.any()
        ]
        none = pa.array([None] * len(parts), pa.int64())
        yield _batch(none, none, none, pa.array([i for i, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary()))
        del counts, shingle, parts
        let_go()

    def _batch(*columns):
        return pa.RecordBatch.from_arrays(list(columns), ["doc_id", "n", "node", "part", "counts"])

    return pick(docs, key, text).mapInArrow(run, SETS)


def column_levels(counts: DataFrame) -> np.ndarray:
    """Sum the tasks' counters; a logarithmic level per counter comes to the driver (a fixed 16 MB)."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in small_batches(batches, 16):
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.frombuffer(zlib.decompress(packed), np.uint8).astype(np.uint32)
                sums[part] = sums[part] + got if part in sums else got
        levels = [np.minimum(np.log2(1.0 + s) * 10, 255).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["part", "levels"])

    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint8)
    summed = counts.repartition("part").mapInArrow(run, "part int, levels binary")
    for row in summed.collect():
        out[row["part"]] = np.frombuffer(row["levels"], np.uint8)
    return out.ravel()


def rare_entries(docs: DataFrame, levels, options: JoinOptions, text: str) -> DataFrame:
    """(gram, node, n): the first entries of every row in the order rare to common."""

    def run(batches):
        shingle, level, seen = Shingler(options.words), levels.value, set()
        for batch in small_batches(batches, 500):
            grams, nodes, sizes, many = [], [], [], []
            for t in batch.column(0).to_pylist():
                hashes = shingle(t)
                if not len(hashes) or (node := node_of(hashes)) in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(node)
                sizes.append(len(hashes))
                first = options.prefix(len(hashes))
                if first < len(hashes):
                    order = (level[slots(hashes)].astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16))
                    hashes = hashes[np.argpartition(order, first - 1)[:first]]
                grams.append(hashes)
                nodes.append(node)
                many.append(len(hashes))
            if grams:
                columns = (np.concatenate(grams).view(np.int64), np.repeat(np.array(nodes, np.int64), many), np.repeat(np.array(sizes, np.int32), many))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "node", "n"])
        del shingle, seen
        let_go()

    return pick(docs, text).mapInArrow(run, ENTRIES)


SHARED = ENTRIES + ", lead long"


def leaders(grams: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """For entries sorted by column and size, the place of the entry that leads each: the first of
    its column, or the first after it that is too large for the leader before."""
    places = np.arange(len(grams))
    lead = np.maximum.accumulate(np.where(np.r_[True, grams[1:] != grams[:-1]], places, 0))
    while True:
        far = 100 * sizes[lead].astype(np.int64) < percent * sizes.astype(np.int64)
        if not far.any():
            return lead
        first = far & np.r_[True, ~(far[:-1] & (lead[1:] == lead[:-1]))]
        lead = np.maximum.accumulate(np.where(first, places, lead))


def shared_entries(entries: DataFrame, options: JoinOptions) -> DataFrame:
    """Entries whose column holds another row of a size within the bound, each once, with the
    row that leads it there.

    In a column sorted by size, the nearest sizes are neighbours, so a look at the entry
    before and the entry after is enough; only one entry and its leader are ever held back.
    """
    percent = options.percent

    def run(batches):
        held, ahead, kept_last = None, None, False
        for batch in batches:
            g, v, n = (batch.column(k).to_numpy() for k in range(3))
            if held is not None:
                g, v, n = (np.r_[x, y] for x, y in zip(held, (g, v, n)))
            if not len(g):
                continue
            new = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])]
            g, v, n = g[new], v[new], n[new]
            after = (g[1:] == g[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64))
            stays = np.r_[kept_last if held is not None else False, after] | np.r_[after, False]
            # The leader of the entry held back goes on leading.
            before = 0 if ahead is None else 1
            lg, lv, ln = (g, v, n) if ahead is None else (np.r_[x, y] for x, y in zip(ahead, (g, v, n)))
            lead = leaders(lg, ln, percent)
            by = lv[lead][before:]
            held, kept_last = (g[-1:], v[-1:], n[-1:]), bool(stays[-1])
            ahead = tuple(x[lead[-1:]] for x in (lg, lv, ln))
            yield _entries(*(x[:-1][stays[:-1]] for x in (g, v, n, by)))
        if held is not None and kept_last:
            yield _entries(*held, ahead[1])

    def _entries(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "node", "n", "lead"])

    return entries.repartition("gram").sortWithinPartitions("gram", "n", "node").mapInArrow(run, SHARED)


class Block:
    """The rows of one block and an index of their columns."""

    def __init__(self, options: JoinOptions):
        self.options = options
        self.nodes, self.sets = [], []
        self.labels = None

    def add(self, node: int, hashes: np.ndarray) -> None:
        if not self.nodes or self.nodes[-1] != node:
            self.nodes.append(node)
            self.sets.append(hashes)

    def _index(self, rows: np.ndarray) -> None:
        sizes = self.sizes[rows]
        columns = np.concatenate([self.sets[r] for r in rows.tolist()])
        owner = np.repeat(rows, sizes)
        order = np.argsort(columns, kind="stable")
        self.owner = owner[order]
        self.columns, first = np.unique(columns[order], return_index=True)
        self.first = np.r_[first, len(columns)]

    def _linked(self, hashes: np.ndarray) -> np.ndarray:
        """Indexed rows whose overlap with the given set reaches the threshold."""
        at = np.searchsorted(self.columns, hashes)
        at = at[(at < len(self.columns)) & (self.columns[np.minimum(at, len(self.columns) - 1)] == hashes)]
        low, many = self.first[at], self.first[at + 1] - self.first[at]
        if not len(at):
            return np.zeros(0, np.int64)
        inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        overlap = np.bincount(self.owner[np.repeat(low, many) + inner], minlength=len(self.sets))
        union = len(hashes) + self.sizes - overlap
        return np.flatnonzero((overlap > 0) & (100 * overlap >= self.options.percent * union))

    def close(self) -> list[tuple[int, int]]:
        """Components inside the block, as links of each row to the first row of its component.

        Rows reached leave the index, which is rebuilt whenever half of it has gone.
        """
        n = len(self.sets)
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.labels = np.full(n, -1)
        self._index(np.arange(n))
        indexed, out = n, []
        for start in range(n):
            if self.labels[start] >= 0:
                continue
            self.labels[start], waiting = start, [start]
            while waiting:
                row = waiting.pop()
                found = self._linked(self.sets[row])
                found = found[self.labels[found] < 0]
                self.labels[found] = start
                waiting += found.tolist()
                out += [(self.nodes[x], self.nodes[start]) for x in found.tolist()]
                alive = np.flatnonzero(self.labels < 0)
                if len(alive) and 2 * len(alive) < indexed:
                    self._index(alive)
                    indexed = len(alive)
                elif not len(alive):
                    waiting = []
        self._index(np.arange(n))
        return out

    def visit(self, node: int, hashes: np.ndarray) -> list[tuple[int, int]]:
        """Links of a visitor, one for each component of the block that it reaches."""
        return [(node, self.nodes[x]) for x in np.unique(self.labels[self._linked(hashes)]).tolist()]


def multiply(dealt: DataFrame, options: JoinOptions) -> DataFrame:
    """(a, b): links found in the blocks."""
    ordered = dealt.repartition("block", "slice").sortWithinPartitions("block", "slice", "role", F.desc("central"), "node")

    def run(batches):
        key, block, links, last = None, None, [], None
        for batch in small_batches(batches, 256):
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for i, (name, part, role, node) in enumerate(zip(*columns)):
                if (name, part) != key:
                    if block is not None and block.labels is None:
                        links += block.close()
                    key, block, last = (name, part), Block(options) if role == 0 else None, None
                if block is None:
                    continue
                hashes = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint64)
                if role == 0:
                    block.add(node, hashes.copy())
                elif node != last:
                    if block.labels is None:
                        links += block.close()
                    links += block.visit(node, hashes)
                    last = node
            if len(links) > 10_000:
                yield _links(links)
                links = []
        if block is not None and block.labels is None:
            links += block.close()
        yield _links(links)
        del block
        let_go()

    def _links(links):
        table = np.array(links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], ["a", "b"])

    return ordered.select("block", "slice", "role", "node", "hashes").mapInArrow(run, "a long, b long")


def place_rows(shared: DataFrame, nodes: DataFrame, options: JoinOptions) -> DataFrame:
    """(node, doc_id, block, slice, central, visits): where every row goes that can have a partner.

    A row's block is named by the row that leads it in most columns. Rows with too few shared
    columns for any partner are left out here.
    """
    needed = F.floor((F.col("n") * options.percent + 99) / 100)
    first_columns = F.col("n") - needed + F.floor(F.col("n") * options.longer / 100) + 1
    fewest = F.floor(needed * options.longer / 100) + 1
    led = (
        shared.groupBy("node", "n", "lead").agg(F.count(F.lit(1)).alias("m"))
        .groupBy("node", "n").agg(F.sum("m").alias("m"), F.max(F.struct("m", "lead"))["lead"].alias("block"))
        .filter(F.col("m") >= fewest)
    )
    named = stored(
        led.join(nodes.select("node", "doc_id"), "node")
        .select("node", "doc_id", "n", (F.col("m") / first_columns).alias("central"), "block"),
        "ngram-rows",
    )
    # A leader is smaller than whom it leads, so following ends; each pass doubles the reach until
    # rows that follow one another are in one block. A leader that was left out keeps its name.
    while True:
        leads = named.select(F.col("node").alias("block"), F.col("block").alias("root"))
        followed = named.join(leads, "block", "left").withColumn("moved", F.col("root") != F.col("block"))
        named = stored(followed.withColumn("block", F.coalesce("root", "block")).drop("root"), "ngram-named")
        if named.filter("moved").isEmpty():
            named = named.drop("moved")
            break
        named = named.drop("moved")
    slices = named.groupBy("block").agg(F.ceil(F.sum("n") / options.block_entries).cast("int").alias("slices"))
    dealt = named.join(slices, "block").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    crowds = dealt.groupBy("block", "slice").agg(F.count(F.lit(1)).alias("crowd"))
    placed = stored(
        dealt.join(crowds, ["block", "slice"]).select("node", "doc_id", "n", "central", "block", "slice", "crowd"), "ngram-placed")
    # Which other blocks hold a row that shares a first column and is of a fitting size. Rows go
    # to fuller blocks, so that a large group is visited and does not travel. One shuffle by
    # column serves both sides.
    block = F.struct("crowd", "block", "slice")
    here = shared.select("gram", "node", "n").join(placed.select("node", block.alias("own")), "node").repartition("gram")
    held = here.groupBy("gram", F.col("own").alias("there")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    visits = (
        here.join(held, "gram").filter(F.col("own") < F.col("there"))
        .filter((100 * F.col("most") >= options.percent * F.col("n")) & (100 * F.col("n") >= options.percent * F.col("least")))
        .select("node", "there").distinct()
    )
    visits = stored(visits, "ngram-visits")
    # A row alone in its block that visits nothing and is not visited can have no partner.
    met = visits.select("there.block", "there.slice").distinct().withColumn("met", F.lit(True))
    goes = visits.groupBy("node").agg(F.collect_list("there").alias("visits"))
    found = placed.join(met, ["block", "slice"], "left").join(goes, "node", "left")
    found = found.filter("crowd > 1 or met or visits is not null")
    return stored(found.select("node", "doc_id", "block", "slice", "central", "visits"), "ngram-active")


def _bits(ids: np.ndarray) -> np.ndarray:
    mixed = ids.astype(np.int64).view(np.uint64) * ODD[0]
    return (mixed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def id_filter(ids: DataFrame):
    """A test that is true for all given ids and for few others: one bit per hash value.

    Its size is fixed, so it may be sent to every task; more ids only make it less selective.
    """
    width = (1 << FILTER_BITS) // SKETCH_PARTS

    def mark(batches):
        marks = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
        for batch in batches:
            at = _bits(batch.column(0).to_numpy(zero_copy_only=False))
            np.bitwise_or.at(marks, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        rows = [(i, zlib.compress(m.tobytes(), 1)) for i, m in enumerate(np.split(marks, SKETCH_PARTS)) if m.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["part", "bits"])

    def merge(batches):
        pieces: dict[int, np.ndarray] = {}
        for batch in small_batches(batches, 16):
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.frombuffer(zlib.decompress(packed), np.uint8)
                pieces[part] = pieces[part] | got if part in pieces else got
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(pieces), pa.int32()), pa.array([p.tobytes() for p in pieces.values()], pa.binary())], ["part", "bits"]
        )

    schema = "part int, bits binary"
    bits = np.zeros((SKETCH_PARTS, width // 8), np.uint8)
    for row in ids.mapInArrow(mark, schema).repartition("part").mapInArrow(merge, schema).collect():
        bits[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    sent = ids.sparkSession.sparkContext.broadcast(bits.ravel())
    del bits
    let_go()

    @F.arrow_udf("boolean")
    def maybe(ids: pa.Array) -> pa.Array:
        at = _bits(ids.fill_null(0).to_numpy(zero_copy_only=False))
        return pa.array((sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return maybe


def deal_rows(docs: DataFrame, placed: DataFrame, options: JoinOptions, key: str, text: str) -> DataFrame:
    """Sets of the placed rows, one for the own block and one for each visit."""
    texts = pick(docs, key, text).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("body"))
    # Only texts that may be needed are shuffled to meet their places.
    wanted = texts.filter(id_filter(placed.select("doc_id").filter("doc_id is not null"))(F.col("doc_id")))
    fetched = wanted.join(placed, "doc_id").select("body", "node", "block", "slice", "central", "visits")
    schema = "block long, slice int, role int, central double, node long, hashes binary"

    def run(batches):
        shingle = Shingler(options.words)
        for batch in small_batches(batches, 200):
            out = []
            for row in batch.to_pylist():
                hashes = shingle(row["body"])
                if node_of(hashes) != row["node"]:
                    continue  # another text under the same id
                packed = hashes.tobytes()
                out.append((row["block"], row["slice"], 0, row["central"], row["node"], packed))
                out += [(v["block"], v["slice"], 1, 0.0, row["node"], packed) for v in row["visits"] or ()]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.binary())
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "slice", "role", "central", "node", "hashes"]
            )
        del shingle
        let_go()

    return fetched.mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, options: JoinOptions = JoinOptions(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for every row."""
    spark = docs.sparkSession
    first = stored(sets_and_counts(docs, options, key, text), "ngram-sets")
    rows = first.filter("part is null").select("doc_id", "n", "node")
    levels = spark.sparkContext.broadcast(column_levels(first.filter("part is not null").select("part", "counts")))
    let_go()
    shared = stored(shared_entries(rare_entries(docs, levels, options, text), options), "ngram-shared")
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    placed = place_rows(shared, nodes, options)
    links = stored(multiply(deal_rows(docs, placed, options, key, text), options), "ngram-links")
    joined = stored(components(links, "ngram-components"), "ngram-joined")
    smallest = (
        joined.join(nodes.select(F.col("node").alias("id"), "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    )
    classes = joined.join(smallest, "component").select(F.col("id").alias("node"), F.col("component_id").alias("linked"))
    known = nodes.join(classes, "node", "left").select("node", F.coalesce("linked", "doc_id").alias("component_id"))
    return rows.join(known, "node", "left").select(
        F.col("doc_id").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def first_of_each(docs: DataFrame, options: JoinOptions = JoinOptions(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are the smallest id of their group, as they were; rows without an id stay.

    Of rows that agree in id and text one stays, the first by a hash of all its columns.
    """
    kept = near_duplicates(docs, options, key, text).filter(F.col(key) == F.col("component_id")).select(F.col(key).alias("key")).distinct()
    rows = tucked(docs, key=key, text=text)
    rows = rows.select("row", "key", F.xxhash64("text").alias("hash"), F.xxhash64("row").alias("tie"))
    one = rows.join(kept, "key", "left_semi").groupBy("key", "hash").agg(F.min_by("row", "tie").alias("row"))
    return one.select("row.*").union(rows.filter(F.col("key").isNull()).select("row.*"))
