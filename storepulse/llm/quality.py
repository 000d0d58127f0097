"""Quality rules: base limits on text statistics, then a learned decision list.

Main path: DataFrame functions only. Each whole text is read once, for its statistics. The
list is learned by sequential covering: a rule is a conjunction of thresholds, grown on one
part of the labelled rows by the information gain of each added threshold, pruned on the
other part to the beginning with the best margin, and kept if precise enough there; rows it
covers are taken out and the next rule is grown. The result is an ordered list of readable
conditions, written out as one Spark conditional expression.

All counts of a step come from one aggregation over rows whose statistics are replaced by
bins; at most (statistics x bins) rows reach the driver. Learning uses about `fit_rows`
labelled rows, those with a small hash of the id; statistics cover every text.

Defined cases: a null or empty text, or one without a word, has zero statistics and fails the
base limits; labels that are null, no 0 or 1, or of unknown ids are left out; with one label
only that label is the verdict, with none everything that passes the limits is kept; repeated
rows are judged alike, repeated labels count each; an empty table gives an empty result; extra
columns are ignored. Windows of eight words are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storepulse.llm.common import UPPER, pick, stored

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?"
DIGITS = "0123456789"
WINDOW = 8


@dataclass(frozen=True)
class QualityOptions:
    """Base limits, and how the list is learned.

    fit_rows: labelled rows used for learning, about; bins: candidate thresholds per statistic
    and label; min_precision: share of right hits a rule needs on the pruning part; min_hits:
    rows it has to cover there.
    """

    min_words: int = 20
    max_repeat_percent: int = 30
    fit_rows: int = 200_000
    bins: int = 16
    max_rules: int = 12
    max_conditions: int = 4
    min_precision: float = 0.9
    min_hits: int = 3
    seed: int = 11


# --- statistics ----------------------------------------------------------------------------

def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also where the body is evaluated per element."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def word_list(text: Column) -> Column:
    """Runs of anything but the six blank characters."""
    return F.array_remove(F.split(F.translate(text, BLANKS[1:], " " * 5), " ", -1), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of words which occurs twice or more, each word counted once."""

    def hashes(h: Column) -> Column:
        heads = F.slice(h, F.lit(1), F.greatest(F.size(h) - (window - 1), F.lit(0)))
        return F.transform(heads, lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, window))))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct(
            (a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    def repeats(w: Column) -> Column:
        """Places of windows that stand next to an equal one once sorted."""
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        equal = lambda p, j, x: F.coalesce(F.get(p, j)["h"] == x["h"], F.lit(False))
        beside = _let(pairs, lambda p: F.filter(p, lambda x, j: equal(p, j - 1, x) | equal(p, j + 1, x)))
        return F.sort_array(F.transform(beside, lambda x: x["i"]))

    # Most texts repeat nothing; only the others are sorted.
    counted = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(repeats(w)))
    word_hashes = F.transform(words, lambda x: F.xxhash64(x))
    return _let(word_hashes, lambda h: _let(hashes(h), counted)).cast("long")


def statistics(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, counts) of every whole text, one row per row."""
    count = lambda characters: (F.length("text") - F.length(_without(F.col("text"), characters))).cast("long")
    base = pick(docs, key, "text").withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    parts = base.withColumns({"words": word_list(F.col("text")), "lines": lines})
    size = lambda c: F.size(c).cast("long")
    return parts.select(
        key, size("words").alias("n_words"), count(BLANKS).alias("n_blanks"), F.length("text").cast("long").alias("n_chars"),
        count(SYMBOLS).alias("n_symbols"), size("lines").alias("n_lines"), size(F.array_distinct("lines")).alias("n_distinct_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"), size(F.array_distinct("words")).alias("n_distinct_words"),
        count(UPPER).alias("n_capitals"), count(DIGITS).alias("n_digits"), count(MARKS).alias("n_marks"),
    ).withColumns({
        "word_chars": F.col("n_chars") - F.col("n_blanks"), "n_dup_lines": F.col("n_lines") - F.col("n_distinct_lines"),
    })


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def measures() -> dict[str, Column]:
    """What rules speak about: readable ratios of the counts."""
    return {
        "words": F.col("n_words").cast("double"), "word_length": _share("word_chars", "n_words"),
        "symbols_per_word": _share("n_symbols", "n_words"), "repeated_line_share": _share("n_dup_lines", "n_lines"),
        "repeated_word_share": _share("n_repeat_words", "n_words"), "distinct_word_share": _share("n_distinct_words", "n_words"),
        "capital_share": _share("n_capitals", "word_chars"), "digit_share": _share("n_digits", "word_chars"),
        "marks_per_word": _share("n_marks", "n_words"), "words_per_line": _share("n_words", "n_lines"),
    }


def base_failed(options: QualityOptions = QualityOptions()) -> Column:
    return (F.col("n_words") < options.min_words) | (
        100 * F.col("n_repeat_words") > options.max_repeat_percent * F.col("n_words"))


# --- decision list ---------------------------------------------------------------------------

@dataclass(frozen=True, order=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def holds(self, found: dict[str, Column]) -> Column:
        return found[self.measure] > self.threshold if self.above else found[self.measure] <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first that fits gives `verdict`, no rule gives its opposite."""

    rules: tuple[tuple[Condition, ...], ...] = ()
    verdict: bool = False
    found: dict = field(default_factory=measures, compare=False, repr=False)

    def kept(self) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("boolean"))
        for rule in self.rules:
            fits = F.lit(True)
            for condition in rule:
                fits = fits & condition.holds(self.found)
            out = out.when(fits, F.lit(self.verdict))
        return out.otherwise(F.lit(not self.verdict))

    def __str__(self) -> str:
        name = {True: "keep", False: "drop"}
        lines = [f"{'if' if i == 0 else 'else if'} {' and '.join(map(str, r))}: {name[self.verdict]}" for i, r in enumerate(self.rules)]
        return "\n".join([*lines, f"{'else: ' if lines else ''}{name[not self.verdict]}"])


def fit(rows: DataFrame, options: QualityOptions = QualityOptions(), found: dict[str, Column] | None = None) -> DecisionList:
    """Learn a list from (label 0 or 1, columns that the measures need)."""
    found = found or measures()
    names = list(found)
    labelled = rows.filter(F.col("label").isin(0, 1)).select(
        (F.col("label") == 1).alias("good"), *(found[n].alias(n) for n in names),
        F.pmod(F.xxhash64(F.lit(options.seed), *found.values()), F.lit(3)).alias("part"),
    )
    labelled = stored(labelled, "quality-labelled")
    # Equal texts have equal measures and fall into one part, so pruning sees no copy of a grown row.
    shares = [F.lit((i + 0.5) / options.bins) for i in range(options.bins)]
    summary = labelled.groupBy("good").agg(
        F.count(F.lit(1)).alias("n"), *(F.percentile(n, F.array(*shares)).alias(n) for n in names)).collect()
    amounts = {r["good"]: r["n"] for r in summary}
    if len(amounts) < 2:
        return DecisionList(verdict=not next(iter(amounts), True), found=found)
    # Rules describe the rarer label.
    target = amounts[True] < amounts[False]
    cuts = {n: sorted({x for r in summary for x in r[n]}) for n in names}
    bins = F.array(*(_bin(F.col(n), cuts[n]) for n in names))
    counted = stored(
        labelled.select(bins.alias("bins"), (F.col("good") == target).alias("hit"), (F.col("part") > 0).alias("grow"))
        .groupBy("bins", "hit", "grow").agg(F.count(F.lit(1)).alias("n")), "quality-bins")
    rules: list[tuple[Condition, ...]] = []
    left = F.lit(True)
    while len(rules) < options.max_rules:
        steps = _grow(counted.filter(left & F.col("grow")), len(names), options)
        steps = _prune(counted.filter(left & ~F.col("grow")), steps, options)
        if not steps:
            break
        rules.append(tuple(Condition(names[m], above, cuts[names[m]][k]) for m, above, k in steps))
        left = left & ~_all(steps)
    return DecisionList(tuple(rules), target, found)


# A step of a rule on binned rows: (place of the measure, above, place of the threshold).
Step = tuple[int, bool, int]


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many thresholds lie below the value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: t < value))


def _holds(step: Step) -> Column:
    measure, above, k = step
    place = F.col("bins")[measure]
    return place > k if above else place <= k


def _all(steps: list[Step]) -> Column:
    out = F.lit(True)
    for step in steps:
        out = out & _holds(step)
    return out


def _grow(rows: DataFrame, width: int, options: QualityOptions) -> list[Step]:
    """Add the threshold of most gain until no miss is left, nothing gains, or the rule is full."""
    steps: list[Step] = []
    while len(steps) < options.max_conditions:
        per_bin: dict[int, dict[int, list[int]]] = {m: {} for m in range(width)}
        table = rows.filter(_all(steps)).select(F.posexplode("bins").alias("measure", "bin"), "hit", "n")
        for r in table.groupBy("measure", "bin", "hit").agg(F.sum("n").alias("n")).collect():
            per_bin[r["measure"]].setdefault(r["bin"], [0, 0])[r["hit"]] += r["n"]
        misses, hits = (sum(v[i] for v in per_bin[0].values()) for i in (0, 1))
        if not hits or not misses:
            break
        before, best = math.log2(hits / (hits + misses)), (0.0, None)
        for measure, counts in per_bin.items():
            below = [0, 0]
            for k in sorted(counts)[:-1]:
                below = [below[0] + counts[k][0], below[1] + counts[k][1]]
                for above, (n, p) in ((False, below), (True, [misses - below[0], hits - below[1]])):
                    gain = p * (math.log2(p / (p + n)) - before) if p else 0.0
                    if gain > best[0] + 1e-9:
                        best = (gain, (measure, above, k))
        if best[1] is None:
            break
        steps.append(best[1])
    return steps


def _prune(rows: DataFrame, steps: list[Step], options: QualityOptions) -> list[Step]:
    """The beginning of the rule with the best margin on other rows; nothing if that is too weak."""
    if not steps:
        return []
    row = rows.agg(*(
        F.coalesce(F.sum(F.when(_all(steps[:k]) & (F.col("hit") == hit), F.col("n"))), F.lit(0)).alias(f"{name}{k}")
        for k in range(1, len(steps) + 1) for name, hit in (("p", True), ("n", False))
    )).first()
    choices = [(row[f"p{k}"], row[f"n{k}"], k) for k in range(1, len(steps) + 1)]
    margin = lambda p, n: (p - n) / (p + n) if p + n else -1.0
    p, n, k = max(choices, key=lambda c: (margin(c[0], c[1]), c[0], -c[2]))
    enough = p >= options.min_hits and p >= options.min_precision * (p + n)
    return steps[:k] if enough else []


def labelled_statistics(stats: DataFrame, labels: DataFrame, options: QualityOptions = QualityOptions(), key: str = "doc_id") -> DataFrame:
    """Statistics of about `fit_rows` labelled rows that pass the base limits, with `label`.

    labels: (key, label). Rows are taken by a hash of the id, so reruns agree.
    """
    known = pick(labels, key, "label").filter(F.col(key).isNotNull() & F.col("label").isin(0, 1))
    share = min(1.0, options.fit_rows / max(known.count(), 1))
    taken = F.pmod(F.xxhash64(key, F.lit(options.seed)), F.lit(1 << 20)) < math.ceil(share * (1 << 20))
    return stats.filter(~base_failed(options)).join(known.filter(taken), key)


def judge(docs: DataFrame, labels: DataFrame, options: QualityOptions = QualityOptions(), key: str = "doc_id") -> DataFrame:
    """(key, statistics, base_failed, kept) of every document; labels: (key, label 1 = good)."""
    stats = stored(statistics(docs, key), "quality-statistics")
    rules = fit(labelled_statistics(stats, labels, options, key), options)
    failed = base_failed(options)
    return stats.withColumns({"base_failed": failed, "kept": ~failed & rules.kept()})
