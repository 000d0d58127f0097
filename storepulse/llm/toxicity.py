"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

The features of a whole text: densities of a lexicon and of its word beginnings, how near
its hits stand to a second-person word, shares of capital words and letters, punctuation
and obfuscation rates. The lexicon is learned: words, freed from obfuscation, and word
beginnings whose document counts differ most between the two labels. Learning rows are
split by a hash into parts for the lexicon, the trees and the calibration, so no part is
judged on what the part before it has memorised.

All learning uses at most `fit_rows` labelled rows, those with the smallest hash of the id;
this bounded table alone is broadcast. Features are counted where the rows are; trees and
calibration are Spark's own.

Defined cases: a null text is scored as an empty one; labels that are null are left out; if
no row or only one label can be learned from, every score is the share of label 1 (0.0
without labels); repeated rows score alike; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storepulse.llm.common import Remembered, let_go, list_array, pick, small_batches, stored, tucked

# Words that address someone.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti contigo usted ustedes vosotros os tuyo tuya".split()
)
# Characters that stand for a letter in disguised words.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "_": "", "-": "", ".": ""})
NEAR = 5
BEGINNING = 5
FEATURES = (
    "words", "lexicon_density", "lexicon_hits", "strong_density", "beginning_density", "beginning_hits", "distinct_hits",
    "second_person_density", "hits_near_second_person", "capital_words", "capital_letters", "exclamations", "questions",
    "punctuation_runs", "obfuscated_words",
)
WORD_HIT, STRONG, START, PERSON, CAPITAL, DISGUISED = 1, 2, 4, 8, 16, 32


@dataclass(frozen=True)
class ToxicityOptions:
    fit_rows: int = 40_000
    lexicon_size: int = 4_000
    min_evidence: float = 12.0  # log-likelihood ratio a lexicon entry needs
    trees: int = 20
    depth: int = 4
    seed: int = 3


def plain_word(word: str) -> tuple[str, bool]:
    """Lower-case word without the punctuation around it, and whether letters were disguised."""
    core = word.strip(".,;:!?\"'()[]{}«»¿¡…-–").lower()
    if core.isalpha():
        return core, False
    shown = core.translate(DISGUISE)
    letters = [ch.isalpha() for ch in core]
    # Half of it letters, or letters and signs in turn; "10th" alone has one change.
    changes = sum(a != b for a, b in zip(letters, letters[1:]))
    mixed = 2 * sum(letters) >= len(core) or sum(letters) >= 2 and changes >= 3
    disguised = shown.isalpha() and mixed and not all(letters)
    return (shown if disguised else core), disguised


@dataclass
class Lexicon:
    """Entry -> log-odds of label 1; beginnings are stored with a trailing star."""

    odds: dict[str, float]
    strong: float = 2.0
    _codes: Remembered = field(default=None, repr=False)

    def __post_init__(self):
        self._codes = Remembered(self._code)

    def __getstate__(self):
        return {"odds": self.odds, "strong": self.strong}

    def __setstate__(self, state):
        self.__init__(**state)

    def _code(self, word: str) -> int:
        """What a word is, as bits; a word is looked at once per worker."""
        core, disguised = plain_word(word)
        found = self.odds.get(core)
        code = 0 if found is None else WORD_HIT | (STRONG if found >= self.strong else 0)
        if len(core) >= BEGINNING and core[:BEGINNING] + "*" in self.odds:
            code |= START
        if core in SECOND_PERSON:
            code |= PERSON
        if len(core) > 1 and word.isupper():
            code |= CAPITAL
        return code | (DISGUISED if disguised else 0)

    def features(self, text: str) -> list[float]:
        words = text.split()
        n = len(words)
        codes = np.fromiter(map(self._codes.__getitem__, words), np.uint8, n)
        count = lambda bit: int(np.count_nonzero(codes & bit))
        hits = np.flatnonzero(codes & (WORD_HIT | START))
        persons = np.flatnonzero(codes & PERSON)
        near = 0
        if len(hits) and len(persons):
            after = np.searchsorted(persons, hits)
            gap = np.minimum(
                np.abs(persons[np.minimum(after, len(persons) - 1)] - hits), np.abs(persons[np.maximum(after - 1, 0)] - hits)
            )
            near = int((gap <= NEAR).sum())
        per, letters = max(n, 1), max(len(text), 1)
        capitals = len(_CAPITALS.findall(text)) if len(text) else 0
        return [
            float(np.log1p(n)), count(WORD_HIT) / per, float(np.log1p(count(WORD_HIT))), count(STRONG) / per,
            count(START) / per, float(np.log1p(count(START))), float(len({plain_word(words[i])[0] for i in hits.tolist()})),
            len(persons) / per, near / max(len(hits), 1), count(CAPITAL) / per, capitals / letters,
            text.count("!") / letters, text.count("?") / letters, len(_RUNS.findall(text)) / per, count(DISGUISED) / per,
        ]


_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_RUNS = re.compile(r"[!?.]{2,}")


def _entries(rows: DataFrame) -> DataFrame:
    """(entry, toxic, clean): document counts of words and beginnings. Each task adds up its own first."""

    def count(batches):
        toxic, clean = Counter(), Counter()

        def flush():
            names = list(toxic.keys() | clean.keys())
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([clean[x] for x in names], pa.int64())],
                ["entry", "toxic", "clean"],
            )

        for batch in small_batches(batches):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cores = {plain_word(w)[0] for w in set((text or "").split())}
                (toxic if label else clean).update(cores | {c[:BEGINNING] + "*" for c in cores if len(c) >= BEGINNING})
            if len(toxic) + len(clean) > 100_000:
                yield flush()
                toxic, clean = Counter(), Counter()
        yield flush()
        let_go()

    parts = rows.select("text", "label").mapInArrow(count, "entry string, toxic long, clean long")
    return parts.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(rows: DataFrame, options: ToxicityOptions) -> Lexicon:
    """The entries with the most evidence for label 1, by log-likelihood ratio of document counts."""
    all_toxic, all_clean = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1)) - F.coalesce(F.sum("label"), F.lit(0))).first()
    if not all_toxic or not all_clean:
        return Lexicon({})
    n = float(all_toxic + all_clean)
    base = all_toxic / n
    seen = F.col("toxic") + F.col("clean")
    share = F.col("toxic") / seen
    part = lambda k, p, q: F.when(k > 0, k * F.log(p / q)).otherwise(0.0)
    evidence = 2 * (part(F.col("toxic"), share, F.lit(base)) + part(F.col("clean"), 1 - share, F.lit(1 - base)))
    odds = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) - float(np.log(base / (1 - base)))
    best = (
        _entries(rows).filter("toxic > 1").withColumns({"evidence": evidence, "odds": odds})
        .filter((share > F.lit(base)) & (F.col("evidence") >= options.min_evidence) & (F.col("odds") >= 1.0) & (F.col("entry") != ""))
        .orderBy(F.desc("evidence"), "entry").limit(options.lexicon_size)
    )
    return Lexicon({r["entry"]: r["odds"] for r in best.select("entry", "odds").collect()})


def featured(lexicon: Lexicon, text: Column) -> Column:
    """array<double> of FEATURES."""

    @F.arrow_udf("array<double>")
    def extract(texts: pa.Array) -> pa.Array:
        found = [lexicon.features(t or "") for t in texts.to_pylist()]
        flat = np.array(found, np.float64).ravel()
        return list_array(flat, np.full(len(found), len(FEATURES), np.int64), pa.float64())

    return extract(text)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: object = None
    calibration: object = None
    constant: float = 0.0


def fit(docs: DataFrame, labels: DataFrame, options: ToxicityOptions = ToxicityOptions(), key: str = "doc_id") -> ToxicityModel:
    """docs: (key, text); labels: (key, label 0 or 1). Every given label may be learned from."""
    drawn = F.xxhash64(F.col(key).cast("string"), F.lit(options.seed))
    chosen = (
        pick(labels, key, "label").filter("label is not null").withColumn("drawn", drawn)
        .orderBy("drawn", key, "label").limit(options.fit_rows)
    )
    # At most fit_rows small rows, so they may be broadcast; the texts stay where they are.
    rows = stored(
        pick(docs, key, "text").join(F.broadcast(chosen), key)
        .select("text", F.col("label").cast("int").alias("label"), F.pmod(F.shiftright("drawn", 7), F.lit(4)).alias("part")),
        "toxicity-fit",
    )
    counts = {(r["part"], r["label"]): r["n"] for r in rows.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones = sum(n for (_, y), n in counts.items() if y)
    constant = ones / max(sum(counts.values()), 1)
    lexicon = learn_lexicon(rows.select("text", "label"), options)
    if not all(sum(counts.get((p, y), 0) for p in (0, 1, 2)) for y in (0, 1)):
        return ToxicityModel(lexicon, constant=constant)
    # Each half is described by the lexicon of the other half, as unseen texts will be.
    halves = [rows.filter(F.col("part") % 2 == h) for h in (0, 1)]
    described = [
        halves[h].select(
            "part", F.col("label").cast("double").alias("label"),
            featured(learn_lexicon(halves[1 - h].select("text", "label"), options), F.col("text")).alias("dense"),
        )
        for h in (0, 1)
    ]
    dense = stored(described[0].union(described[1]), "toxicity-features").withColumn("features", array_to_vector("dense"))
    trees = GBTClassifier(maxIter=options.trees, maxDepth=options.depth, seed=options.seed).fit(dense.filter("part < 3"))
    calibration = None
    if all(counts.get((3, y)) for y in (0, 1)):
        margin = trees.transform(dense.filter("part = 3")).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
        calibration = IsotonicRegression(featuresCol="margin", predictionCol="score").fit(margin)
    return ToxicityModel(lexicon, trees, calibration, constant)


def _score(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """Adds tox_score from `body`; the only other column is `row`."""
    if model.trees is None:
        return rows.withColumn("tox_score", F.lit(float(model.constant)))
    out = model.trees.transform(rows.withColumn("features", array_to_vector(featured(model.lexicon, F.col("body")))))
    if model.calibration is None:
        return out.select("row", vector_to_array("probability")[1].alias("tox_score"))
    out = model.calibration.transform(out.withColumn("margin", vector_to_array("rawPrediction")[1]))
    return out.select("row", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("tox_score"))


def scored(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tox_score), 0 to 1."""
    rows = pick(docs, key, text).select(F.struct(key).alias("row"), F.col(text).alias("body"))
    return _score(rows, model).select("row.*", "tox_score")


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows scored below the threshold, as they were."""
    return _score(tucked(docs, body=text), model).filter(F.col("tox_score") < threshold).select("row.*")
