"""Nearest neighbours by inner product: vantage-point trees, one per shard.

Vectors are dealt to shards of about `shard_rows` by a hash of their id; every query visits
every shard and the shards' best lists are merged. For the tree, inner product becomes a
distance: with one more component sqrt(M^2 - |x|^2), M the largest norm of the shard, the
nearest point by distance has the largest inner product. A subtree is skipped when, by the
triangle inequality, all of it is farther than `factor` times the distance of the worst
kept neighbour. factor = 1 makes the search exact; below 1 it skips more.

Queries reach a shard as a stream of small batches, so a task holds one shard and one
batch whatever the number of queries. Equal vectors of a shard are one point with its
smallest ids; no more of them can ever be among the nearest.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and
rows with a null id, take no part; vectors only meet vectors of their own length; a repeated
row (same id, same vector) counts once; an id is never its own neighbour; ties go to the
smaller id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storepulse.llm.common import pick, small_batches
from storepulse.llm.vectors import matrix, row_dots, usable

FOUND = "query_id long, vec_id long, score double"
# Products closer than this may swap by rounding; such candidates are all kept until the exact score decides.
ROUNDING = 1e-9


@dataclass(frozen=True)
class TreeOptions:
    neighbours: int = 20
    factor: float = 1.0
    shard_rows: int = 1 << 14
    leaf_rows: int = 256
    query_batch: int = 512
    seed: int = 13


class Tree:
    """Vantage-point tree over the distinct vectors of a shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, options: TreeOptions):
        self.options = options
        points, group = np.unique(vectors, axis=0, return_inverse=True)
        group = group.ravel()
        order = np.lexsort((ids, group))
        ids, group = ids[order], group[order]
        first = np.r_[True, (ids[1:] != ids[:-1]) | (group[1:] != group[:-1])]
        ids, group = ids[first], group[first]
        place = np.arange(len(ids)) - np.searchsorted(group, group)
        smallest = place <= options.neighbours
        self.ids, self.group = ids[smallest], group[smallest]
        self.ids_from = np.searchsorted(self.group, np.arange(len(points) + 1))
        self.points = points
        norms = (points**2).sum(1)
        self.reach = norms.max()
        self.lifted = np.c_[points, np.sqrt(np.maximum(self.reach - norms, 0))]
        self.random = np.random.default_rng(options.seed)
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        """Node: (rows,) for a leaf, else (vantage point, child, least, most, child, least, most)."""
        if len(rows) > self.options.leaf_rows:
            eye = self.lifted[self.random.choice(rows)]
            far = np.sqrt(((self.lifted[rows] - eye) ** 2).sum(1))
            inner = far <= np.median(far)
            if not inner.all():
                parts = []
                for side in (inner, ~inner):
                    parts += [self._build(rows[side]), far[side].min(), far[side].max()]
                self.nodes.append((eye, *parts))
                return len(self.nodes) - 1
        self.nodes.append((rows,))
        return len(self.nodes) - 1

    def search(self, query_ids: np.ndarray, queries: np.ndarray) -> pa.RecordBatch:
        """Nearest ids per query, best first, with exact scores."""
        o = self.options
        wide = min(o.neighbours + 9, len(self.points))
        self.q, self.norm = queries, (queries**2).sum(1)
        self.best = np.full((len(queries), wide), -np.inf)
        self.at = np.full((len(queries), wide), -1)
        # The query's own point may be among the best, so one more than asked must be known.
        self.kept = min(o.neighbours + 1, wide) - 1
        self._visit(self.root, np.arange(len(queries)))
        row, point = np.nonzero(self.at >= 0)
        point = self.at[row, point]
        # More near ties than the spare places hold: take all of them from the whole shard.
        worst = self.best[:, self.kept]
        crowded = np.flatnonzero((self.best[:, -1] >= worst - ROUNDING) & (wide < len(self.points)) & np.isfinite(worst))
        for i in crowded.tolist():
            more = np.flatnonzero(self.points @ queries[i] >= worst[i] - ROUNDING)
            keep = row != i
            row, point = np.r_[row[keep], np.full(len(more), i)], np.r_[point[keep], more]
        return self._ranked(query_ids, row, point)

    def _visit(self, node: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        found = self.nodes[node]
        if len(found) == 1:
            self._leaf(found[0], rows)
            return
        eye, near, near_low, near_high, far, far_low, far_high = found
        away = np.sqrt(np.maximum(self.norm[rows] + self.reach - 2 * (self.q[rows] @ eye[:-1]), 0))
        inside = away <= (near_high + far_low) / 2
        # Each query first goes to its own side, then to the other one if that can hold better points.
        self._visit(near, rows[inside])
        self._visit(far, rows[~inside])
        for child, low, high, other in ((far, far_low, far_high, inside), (near, near_low, near_high, ~inside)):
            mine, d = rows[other], away[other]
            least = np.maximum(np.maximum(d - high, low - d), 0)
            worst = np.sqrt(np.maximum(self.norm[mine] + self.reach - 2 * self.best[mine, self.kept], 0))
            self._visit(child, mine[least <= self.options.factor * worst + ROUNDING])

    def _leaf(self, points: np.ndarray, rows: np.ndarray) -> None:
        products = self.q[rows] @ self.points[points].T
        wide = self.best.shape[1]
        both = np.c_[self.best[rows], products]
        where = np.c_[self.at[rows], np.broadcast_to(points, products.shape)]
        top = np.argpartition(-both, wide - 1, axis=1)[:, :wide]
        both, where = np.take_along_axis(both, top, 1), np.take_along_axis(where, top, 1)
        order = np.argsort(-both, axis=1, kind="stable")
        self.best[rows] = np.take_along_axis(both, order, 1)
        self.at[rows] = np.take_along_axis(where, order, 1)

    def _ranked(self, query_ids: np.ndarray, row: np.ndarray, point: np.ndarray) -> pa.RecordBatch:
        score = row_dots(self.q[row], self.points[point])
        many = self.ids_from[point + 1] - self.ids_from[point]
        start = np.repeat(self.ids_from[point], many)
        inner = np.arange(len(start)) - np.repeat(np.cumsum(many) - many, many)
        row, score, ids = np.repeat(row, many), np.repeat(score, many), self.ids[start + inner]
        other = ids != query_ids[row]
        row, score, ids = row[other], score[other], ids[other]
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        top = np.arange(len(row)) - np.searchsorted(row, row) < self.options.neighbours
        return pa.RecordBatch.from_arrays(
            [pa.array(query_ids[row[top]]), pa.array(ids[top]), pa.array(score[top])], ["query_id", "vec_id", "score"]
        )


def search_shards(options: TreeOptions):
    """Stream of rows sorted by (length, shard, role, id), points before queries -> found rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, points, asked, last = None, None, [], [], None

        def answer():
            nonlocal asked
            ids, vectors = np.array([i for i, _ in asked]), np.stack([v for _, v in asked])
            asked = []
            return tree.search(ids, vectors)

        for batch in small_batches(batches, options.query_batch):
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_pylist() for i in range(4)]
            # Rows of one length only are stacked, so each is taken as its own array.
            vectors = batch.column(4)
            for i, (length, shard, role, vec_id) in enumerate(zip(*columns)):
                if (length, shard) != key:
                    if asked:
                        yield answer()
                    key, tree, points, last = (length, shard), None, [], None
                vector = np.array(vectors[i].values.to_numpy(zero_copy_only=False), np.float64)
                if role == 0:
                    points.append((vec_id, vector))
                elif points or tree is not None:
                    if tree is None:
                        tree = Tree(np.array([x for x, _ in points]), np.stack([v for _, v in points]), options)
                        points = []
                    if last is None or last[0] != vec_id or not np.array_equal(last[1], vector):
                        asked.append((vec_id, vector))
                        last = (vec_id, vector)
                    if len(asked) >= options.query_batch:
                        yield answer()
        if asked:
            yield answer()

    return run


def nearest(vectors: DataFrame, is_query: Column, options: TreeOptions = TreeOptions(),
            key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for every row that `is_query` (a condition on `id`) picks."""
    rows = pick(vectors, key, vector).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("length", F.size("vector"))
    shards = max(1, -(-rows.count() // options.shard_rows))
    points = rows.select(
        "length", F.pmod(F.xxhash64("id", F.lit(options.seed)), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("role"), "id", "vector"
    )
    asked = rows.filter(is_query).select(
        "length", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("role"), "id", "vector"
    )
    dealt = points.union(asked).repartition("length", "shard").sortWithinPartitions("length", "shard", "role", "id")
    found = dealt.mapInArrow(search_shards(options), FOUND)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= options.neighbours).select("query_id", "rank", "vec_id", "score")
