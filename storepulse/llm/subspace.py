"""Embedding near-duplicates by a pigeonhole join over subspaces.

Vectors of length one with cosine >= t differ by a squared distance of at most 2 - 2t. After
a rotation the components are split into blocks of few dimensions, each with its share of
that budget; a pair within the whole budget is within the share of at least one block. So
each block is range-joined alone, and the union of what the blocks find is verified on the
original vectors: no link is lost.

The range join of a block cuts its two first dimensions into cells as wide as the block's
radius. A vector meets the vectors of its own cell and of half of the neighbouring cells, so
every close pair of cells is compared once. Cells with many vectors are split into chunks.
A pair that several blocks find counts in the first of them only; whether a block finds a
pair depends on the two vectors alone, because all sums run in a fixed order.

Equal vectors are joined once, with their number. A task hands on, per vector, the number of
its links and one link to the group it belongs to, so groups are never expanded into pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing and are their own component; vectors of different length do not link; repeated
rows are separate vectors that link with each other; a null id stays a row of its own with
a null component; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.llm.common import components, pick, small_batches, stored
from storepulse.llm.vectors import row_dots, usable

CELLS = "length int, block int, x int, y int"
DEALT = CELLS + ", chunk int, role int, id long, members long, vector array<double>"
LINKS = "id long, links long, other long"
VERIFIED = 50_000  # candidate pairs that are verified at a time


@dataclass(frozen=True)
class SubspaceOptions:
    cosine: float = 0.9
    block_size: int = 16
    chunk_rows: int = 8192
    seed: int = 17


@lru_cache(maxsize=8)
def rotation(length: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((length, length)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=8)
def blocks(length: int, options: SubspaceOptions) -> tuple:
    """(first, last, budget) per block; budgets are in proportion to the dimensions."""
    n = max(1, round(length / options.block_size))
    edges = np.linspace(0, length, n + 1).astype(int)
    whole = 2 - 2 * options.cosine + 1e-9
    return tuple((a, b, whole * (b - a) / length) for a, b in zip(edges, edges[1:]))


def rotated(vectors: np.ndarray, options: SubspaceOptions) -> np.ndarray:
    """Unit vectors, rotated; every row is computed the same way in every task."""
    unit = vectors / np.sqrt(row_dots(vectors, vectors))[:, None]
    turn = rotation(vectors.shape[1], options.seed)
    out = np.zeros_like(unit)
    for k in range(unit.shape[1]):
        out += unit[:, k:k + 1] * turn[k]
    return out


def cells_of(z: np.ndarray, first: int, last: int, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers in the first two dimensions of a block."""
    width = np.sqrt(budget) * (1 + 1e-9)
    x = np.floor(z[:, first] / width).astype(np.int64)
    y = np.floor(z[:, first + 1] / width).astype(np.int64) if last - first > 1 else np.zeros(len(z), np.int64)
    return x, y


def _by_length(batch: pa.RecordBatch, vector: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) for each vector length in a batch."""
    column = batch.column(vector)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield rows, flat.reshape(len(rows), int(n))


def count_cells(vectors: DataFrame, options: SubspaceOptions) -> DataFrame:
    """(length, block, x, y, n): how many vectors each cell holds."""

    def run(batches):
        for batch in small_batches(batches):
            for _, v in _by_length(batch, 0):
                z = rotated(v, options)
                for block, (a, b, budget) in enumerate(blocks(v.shape[1], options)):
                    x, y = cells_of(z, a, b, budget)
                    same = [np.full(len(v), c, np.int32) for c in (v.shape[1], block)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c.astype(np.int32)) for c in (*same, x, y)], ["length", "block", "x", "y"]
                    )

    return vectors.select("vector").mapInArrow(run, CELLS).groupBy("length", "block", "x", "y").agg(F.count(F.lit(1)).alias("n"))


def deal(vectors: DataFrame, chunks: dict, options: SubspaceOptions) -> DataFrame:
    """Every vector to its own chunk (role 0) and as a visitor (role 1) to the chunks it must meet."""
    half = ((1, -1), (1, 0), (1, 1), (0, 1))

    def run(batches):
        for batch in small_batches(batches, 500):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, v in _by_length(batch, 2):
                z, own_ids, length = rotated(v, options), ids[rows], v.shape[1]
                out = []
                for block, (a, b, budget) in enumerate(blocks(length, options)):
                    xs, ys = cells_of(z, a, b, budget)
                    for i, (x, y) in enumerate(zip(xs.tolist(), ys.tolist())):
                        n = chunks.get((length, block, x, y), 1)
                        mine = int(own_ids[i]) % n
                        out.append((block, x, y, mine, 0, i))
                        out += [(block, x, y, c, 1, i) for c in range(mine + 1, n)]
                        for dx, dy in half:
                            key = (length, block, x + dx, y + dy)
                            out += [(block, x + dx, y + dy, c, 1, i) for c in range(chunks.get(key, 0))]
                table = np.array(out, np.int32).T
                at = pa.array(rows[table[5]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(table.shape[1], length, np.int32)), *(pa.array(table[k]) for k in range(5)),
                        batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at),
                    ],
                    ["length", "block", "x", "y", "chunk", "role", "id", "members", "vector"],
                )

    return vectors.select("id", "members", "vector").mapInArrow(run, DEALT)


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give a[i] and b[i] the same, smallest label, and so on for all that share a label."""
    while True:
        low = np.minimum(labels[a], labels[b])
        if (labels[a] == low).all() and (labels[b] == low).all():
            return
        for side in (labels[a], labels[b]):
            np.minimum.at(labels, side, low)
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


class Chunk:
    """The vectors of one chunk, met by batches of others."""

    def __init__(self, length: int, block: int, options: SubspaceOptions):
        self.options, self.block, self.spans = options, block, blocks(length, options)
        self.ids, self.members, self.vectors = [], [], []
        self.ready = False

    def add(self, ids, members, vectors) -> None:
        self.ids.append(ids)
        self.members.append(members)
        self.vectors.append(vectors)

    def _prepare(self) -> None:
        self.ids, self.members, self.vectors = map(np.concatenate, (self.ids, self.members, self.vectors))
        self.left = self._sides(self.vectors)[0]
        self.links = np.zeros(len(self.ids), np.int64)
        self.labels = np.arange(len(self.ids))
        self.ready = True

    def _sides(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two forms of the vectors' block whose product is the squared distance, nearly."""
        a, b, _ = self.spans[self.block]
        turn = rotation(vectors.shape[1], self.options.seed)[:, a:b]
        z = (vectors @ turn) / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
        square, one = (z * z).sum(1)[:, None], np.ones((len(z), 1))
        return np.hstack([-2 * z, square, one]).astype(np.float32), np.hstack([z, one, square]).astype(np.float32)

    def _pairs(self, vectors: np.ndarray, right: np.ndarray, low: int, high: int, upper: bool):
        """(own row, other row) of verified links between own rows low..high and the others.

        The product finds candidates with some slack; a pair counts by sums in a fixed order.
        """
        budget = self.spans[self.block][2]
        i, j = np.nonzero(self.left[low:high] @ right.T <= np.float32(budget * 1.0001 + 1e-5))
        i += low
        if upper:
            i, j = i[j < i], j[j < i]
        found = [self._verified(vectors, i[k:k + VERIFIED], j[k:k + VERIFIED]) for k in range(0, len(i), VERIFIED)]
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))

    def _verified(self, vectors: np.ndarray, i: np.ndarray, j: np.ndarray):
        own, at_i = np.unique(i, return_inverse=True)
        others, at_j = np.unique(j, return_inverse=True)
        x, y = self.vectors[own], vectors[others]
        z, w = rotated(x, self.options), rotated(y, self.options)
        keep = np.ones(len(i), bool)
        for k, (a, b, budget) in enumerate(self.spans[: self.block + 1]):
            gap = z[at_i, a:b] - w[at_j, a:b]
            within = row_dots(gap, gap) <= budget
            keep &= within if k == self.block else ~within
        i, j, at_i, at_j = i[keep], j[keep], at_i[keep], at_j[keep]
        norms = np.sqrt(row_dots(x, x))[at_i] * np.sqrt(row_dots(y, y))[at_j]
        linked = row_dots(x[at_i], y[at_j]) / norms >= self.options.cosine
        return i[linked], j[linked]

    def inner(self) -> None:
        """Links among the own vectors."""
        self._prepare()
        right = self._sides(self.vectors)[1]
        for low in range(0, len(self.ids), 512):
            high = min(low + 512, len(self.ids))
            i, j = self._pairs(self.vectors[:high], right[:high], low, high, True)
            np.add.at(self.links, i, self.members[j])
            np.add.at(self.links, j, self.members[i])
            join_labels(self.labels, i, j)

    def meet(self, ids, members, vectors) -> pa.RecordBatch:
        """Links with a batch of visitors; returns what the visitors gain."""
        i, j = self._pairs(vectors, self._sides(vectors)[1], 0, len(self.ids), False)
        np.add.at(self.links, i, members[j])
        gained = np.zeros(len(ids), np.int64)
        np.add.at(gained, j, self.members[i])
        hosts = np.full(len(ids), len(self.ids))
        np.minimum.at(hosts, j, i)
        join_labels(self.labels, i, hosts[j])
        seen = np.flatnonzero(gained)
        return self._rows(ids[seen], gained[seen], self.ids[hosts[seen]])

    def rest(self) -> pa.RecordBatch:
        seen = np.flatnonzero(self.links)
        return self._rows(self.ids[seen], self.links[seen], self.ids[self.labels[seen]])

    @staticmethod
    def _rows(ids, links, other) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(x.astype(np.int64), pa.int64()) for x in (ids, links, other)], ["id", "links", "other"]
        )


def range_join(dealt: DataFrame, options: SubspaceOptions) -> DataFrame:
    """(id, links, other): links a vector found in one chunk, and a member of the group it joins there."""
    key = ("length", "block", "x", "y", "chunk")
    ordered = dealt.repartition(*key).sortWithinPartitions(*key, "role")

    def run(batches):
        current, chunk = None, None
        for batch in small_batches(batches, 1024):
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for part in np.split(np.arange(len(keys)), cuts):
                here, role = tuple(keys[part[0], :5].tolist()), keys[part[0], 5]
                piece = batch.slice(int(part[0]), len(part))
                ids, members = (piece.column(k).to_numpy(zero_copy_only=False) for k in (6, 7))
                vectors = piece.column(8).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                if here != current:
                    if chunk is not None:
                        if not chunk.ready:
                            chunk.inner()
                        yield chunk.rest()
                    current, chunk = here, Chunk(here[0], here[1], options) if role == 0 else None
                if chunk is None:
                    continue  # visitors to a chunk that no vector lives in
                if role == 0:
                    chunk.add(ids, members, vectors)
                else:
                    if not chunk.ready:
                        chunk.inner()
                    yield chunk.meet(ids, members, vectors)
        if chunk is not None:
            if not chunk.ready:
                chunk.inner()
            yield chunk.rest()

    return ordered.mapInArrow(run, LINKS)


def near_duplicates(embeddings: DataFrame, options: SubspaceOptions = SubspaceOptions(),
                    key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) for every row."""
    rows = pick(embeddings, key, vector).select(F.col(key).alias("own"), F.col(vector).cast("array<double>").alias("vector"))
    fit = usable(F.col("vector")) & F.col("own").isNotNull()
    alike = stored(
        rows.filter(fit).groupBy("vector").agg(F.min("own").cast("long").alias("id"), F.count(F.lit(1)).alias("members")), "vectors"
    )
    # The cells cover a unit ball with a fixed width, so their number has a bound that the
    # parameters give, whatever the number of vectors; their counts may reach the driver.
    cells = count_cells(alike, options).collect()
    chunks = {(c["length"], c["block"], c["x"], c["y"]): -(-c["n"] // options.chunk_rows) for c in cells}
    found = stored(range_join(deal(alike, chunks, options), options), "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.filter("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")), "vector-components")
    classes = alike.join(links, "id", "left").join(joined, "id", "left").select(
        "vector", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    linked = rows.filter(fit).join(classes, "vector").select("own", "n_links", "component_id")
    alone = rows.filter(~fit).select("own", F.lit(0).cast("long").alias("n_links"), F.col("own").cast("long").alias("component_id"))
    every = linked.union(alone)
    return every.select(
        F.col("own").alias(key), "n_links", "component_id",
        F.coalesce(F.col("own") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
