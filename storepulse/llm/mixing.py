"""Mix sources to target sizes by fitting subset sums.

Each source gets a share of all sizes by its weight, at most `cap` times its own size; what
a source cannot take is dealt again to the others by weight. A source's whole copies come
first. What is left of its target is a budget smaller than the source: documents are counted
by exact size, a proportional number of each size is taken for all but the last
`knapsack_words` words, and a bounded knapsack over the documents still available fills the
rest, exactly where their sizes allow it, else to the nearest sum on either side. Where that
misses, whole copies are given up and fitted anew, so that a document may come 0 to `cap`
times. Which documents of a size are taken once more is decided by a seeded hash, so reruns
agree.

Only counts per (source, size) reach Python, one source at a time: as many rows as a source
has different sizes, whatever its number of documents.

Defined cases: a null text has size 0 and is taken 0 words; a null source is a source of its
own, sorted last; repeated rows are separate documents; with no words at all every target
is 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storepulse.llm.common import WORD, pick, stored, tucked

FIT = "source string, size long, source_size long, target double, copies int, n long, extra long"


@dataclass(frozen=True)
class MixOptions:
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)  # by position of the source in code point order, repeating
    cap: int = 3
    seed: int = 11
    knapsack_words: int = 1 << 16  # budget that the knapsack fills; the rest is taken in proportion
    ranked_together: int = 5_000  # documents of one size that are sorted in one group


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, options: MixOptions) -> DataFrame:
    """(source, source_size, target) from one row per source.

    A source is at its cap when its cap is below its share of what the sources with a lower
    cap per weight leave over; sorted by cap per weight, that is one running sum.
    """
    order = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(options.weights)))
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, options.weights)), (order + 1).cast("int")))
    weighted = weighted.withColumn("most", F.lit(float(options.cap)) * F.col("source_size"))
    every = Window.partitionBy()
    up_to = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    left = F.sum("source_size").over(every) - (F.sum("most").over(up_to) - F.col("most"))
    weight_left = F.sum("weight").over(every) - (F.sum("weight").over(up_to) - F.col("weight"))
    marked = weighted.withColumn("full", F.col("most") * weight_left <= F.col("weight") * left)
    free = F.sum("source_size").over(every) - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(every)
    free_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("full"), F.col("most")).otherwise(free * F.col("weight") / free_weight)
    return marked.select("source", "source_size", target.alias("target"))


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, knapsack_words: int, seed: int = 0) -> np.ndarray:
    """How many documents of each size to take so that the sum of their sizes is the budget, or
    as near to it as the sizes allow; of two equally near sums the lower one. 0 <= budget."""
    # The order in which the knapsack tries sizes is drawn by the seed, so none is preferred.
    order = np.random.default_rng(seed).permutation(len(sizes))
    size, have = [int(x) for x in sizes[order]], [int(x) for x in counts[order]]
    total = sum(s * c for s, c in zip(size, have))
    share = max(0, min(budget, total) - knapsack_words)
    take = [c * share // total if total else 0 for c in have]
    left = budget - sum(s * t for s, t in zip(size, take))
    # Largest fraction lost by rounding down first, until the knapsack can fill the rest.
    for i in sorted(range(len(size)), key=lambda i: -(have[i] * share % total) if total else 0):
        if left > knapsack_words and 0 < size[i] <= left and take[i] < have[i]:
            take[i] += 1
            left -= size[i]
    for i, s in enumerate(size):
        if left > knapsack_words and s > 0:
            more = min(have[i] - take[i], (left - knapsack_words) // s)
            take[i] += more
            left -= more * s
    # Bounded knapsack: bit b of `reach` says that b words can be made of the items so far. A
    # sum above the budget is of use while nearer to it than taking nothing.
    most = min(2 * left, left + max(size, default=0))
    items, reach, goal, bound = [], 1, 1 << left, (2 << most) - 1
    for i, s in enumerate(size):
        spare = min(have[i] - take[i], most // s) if s else 0
        part = 1
        while spare > 0 and not reach & goal:
            part = min(part, spare)
            items.append((i, part, reach))
            reach |= (reach << (s * part)) & bound
            spare -= part
            part *= 2
    at = (reach & (2 * goal - 1)).bit_length() - 1
    above = reach >> left
    if above and (above & -above).bit_length() - 1 < left - at:
        at = left + (above & -above).bit_length() - 1
    for i, part, before in reversed(items):
        if not before >> at & 1:
            take[i] += part
            at -= part * size[i]
    out = np.zeros(len(size), np.int64)
    out[order] = take
    return out


def fit_copies(sizes: np.ndarray, counts: np.ndarray, wanted: int, cap: int, knapsack_words: int, seed: int = 0) -> np.ndarray:
    """How many copies of documents of each size to take, at most `cap` of each document, for a
    sum as near to `wanted` as they allow.

    Whole copies of the source come first, so that documents are taken about equally often.
    Where the sizes then miss the target, one whole copy after the other is given up and
    fitted again together with the rest.
    """
    whole = int((sizes * counts).sum())
    copies = min(cap, wanted // whole) if whole else 0
    best, gap = copies * counts, abs(wanted - copies * whole)
    # First one copy more of some documents, then all that `cap` leaves over fewer whole copies.
    for given, more in [(copies, min(1, cap - copies)), *((c, cap - c) for c in range(copies, -1, -1))]:
        if not gap:
            break
        units = given * counts + fit_budget(sizes, more * counts, max(wanted - given * whole, 0), knapsack_words, seed)
        off = abs(int((sizes * units).sum()) - wanted)
        if off < gap:
            best, gap = units, off
    return best


def mix(docs: DataFrame, options: MixOptions = MixOptions(), key: str = "doc_id") -> DataFrame:
    """(key, source, size, source_size, target, copies): how often the mix takes each document."""
    seed, knapsack, cap = options.seed, options.knapsack_words, options.cap
    sized = stored(
        pick(docs, key, "source", "text").select(
            key, "source", words(F.col("text")).alias("size"), F.xxhash64(F.col(key).cast("string"), F.lit(seed)).alias("draw")
        ),
        "mix-sizes",
    )
    counted = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    by_source = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = targets(by_source, options)
    same = F.col("h.source").eqNullSafe(F.col("t.source"))
    whole = counted.alias("h").join(goals.alias("t"), same).select("h.source", "h.size", "h.n", "t.source_size", "t.target")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")  # the same order on every run
        source_size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        n = group["n"].to_numpy()
        units = fit_copies(group["size"].to_numpy(), n, int(round(target)), cap, knapsack, seed)
        group = group.assign(copies=(units // n).astype(np.int32), extra=units % n)
        return group[["source", "size", "source_size", "target", "copies", "n", "extra"]]

    plan = stored(whole.groupBy("source").applyInPandas(fit, FIT), "mix-plan")
    planned = sized.alias("d").join(
        plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size"))
    ).select(f"d.{key}", "d.source", "d.size", "d.draw", "p.source_size", "p.target", "p.copies", "p.n", "p.extra")
    # Rank by hash inside (source, size); large groups are cut into slices by the hash first,
    # so that no sort ever holds more than about `ranked_together` documents.
    slices = F.ceil(F.col("n") / options.ranked_together)
    planned = planned.withColumn("slice", F.pmod(F.col("draw"), slices))
    before = (
        planned.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("m"))
        .withColumn("before", F.sum("m").over(Window.partitionBy("source", "size").orderBy("slice")) - F.col("m"))
        .select(F.col("source").alias("s_source"), F.col("size").alias("s_size"), F.col("slice").alias("s_slice"), "before")
    )
    in_slice = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("draw", key))
    ranked = planned.withColumn("place", in_slice).join(
        before,
        F.col("source").eqNullSafe(F.col("s_source")) & (F.col("size") == F.col("s_size")) & (F.col("slice") == F.col("s_slice")),
    )
    chosen = (F.col("before") + F.col("place") <= F.col("extra")).cast("int")
    return ranked.select(key, "source", "size", "source_size", "target", (F.col("copies") + chosen).alias("copies"))


def mixed_rows(docs: DataFrame, options: MixOptions = MixOptions(), key: str = "doc_id") -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it.

    Rows are matched by id, source and size; rows that share all three are numbered on both
    sides, since the mix treats them alike.
    """
    alike = ("key", "source", "size")
    place = F.row_number().over(Window.partitionBy(*alike).orderBy("tie"))
    taken = mix(docs, options, key).select(F.col(key).alias("key"), "source", "size", "copies")
    taken = taken.withColumn("tie", F.col("copies")).withColumn("place", place).filter("copies > 0").alias("t")
    rows = tucked(docs, key=key, source="source", text="text")
    rows = rows.select("row", "key", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    rows = rows.withColumn("place", place).alias("r")
    same = F.lit(True)
    for c in (*alike, "place"):
        same &= F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}"))
    return (
        rows.join(taken, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth")).select("row.*")
    )


def taken_words(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    return mixed.select(key, "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
