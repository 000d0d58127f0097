"""Language by hierarchical discrimination.

First the family is predicted, then one linear support vector machine per pair of languages
of that family separates its members; pairs vote, and margins break ties. All machines work
on the same features, shares of hashed byte trigrams of the whole lower-cased text, so a
score is the mean weight of a text's trigrams and long texts need no more memory than a
block of `BLOCK` trigrams.

The machines are fitted on the driver from a bounded sample (`per_language` rows of each
language in expectation, drawn by a hash of the id); predictions run where the rows are.

Defined cases: a null text, or one without a letter, is `und` with score 0; training rows
without language are left out; without any training row everything is `und`; with one
language that one is predicted with score 1; languages outside the list below form a family
of their own; repeated rows are predicted alike; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storepulse.llm.common import let_go, pick, small_batches, tucked

# Families of languages by code.
FAMILIES = {
    "germanic": ("da", "de", "en", "fy", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
BITS = 15
BLOCK = 1 << 18
SPREAD = np.array([40503, 30011, 52361], np.uint32)  # odd factors that spread a trigram's bytes


@dataclass(frozen=True)
class LanguageOptions:
    per_language: int = 800
    rounds: int = 60
    penalty: float = 1e-3
    seed: int = 5


def _flatten() -> np.ndarray:
    """Bytes as features see them: whatever is no letter becomes one space."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = [b if chr(b).isalpha() else 32 for b in range(128)]
    return table


FLAT = _flatten()


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of ` text `, in order."""
    raw = FLAT[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)].astype(np.uint32)
    h = raw[:-2] * SPREAD[0] + raw[1:-1] * SPREAD[1] + raw[2:] * SPREAD[2]
    return ((h ^ (h >> np.uint32(BITS))) & np.uint32((1 << BITS) - 1)).astype(np.int32)


@dataclass
class Machine:
    """Decides between two labels; a positive margin says the first."""

    first: str
    second: str
    column: int


@dataclass
class LanguageModel:
    languages: dict[str, list[str]]  # family -> its languages
    machines: list[Machine]  # between families, and between languages of one family
    weights: np.ndarray  # hashed trigram x machine
    bias: np.ndarray
    slope: np.ndarray  # margins times this are log-odds

    def margins(self, text: str) -> np.ndarray:
        """Mean weight of the text's trigrams per machine, block by block."""
        total, n = np.zeros(self.weights.shape[1]), 0
        for start in range(0, max(len(text), 1), BLOCK):
            grams = trigrams(text[start:start + BLOCK])
            total += self.weights[grams].sum(0, dtype=np.float64)
            n += len(grams)
        return total / max(n, 1) + self.bias

    def choose(self, labels: list[str], odds: np.ndarray) -> tuple[str, float]:
        """Winner by votes, then by summed log-odds; its probability against its closest rival."""
        votes, sums = dict.fromkeys(labels, 0), dict.fromkeys(labels, 0.0)
        worst = dict.fromkeys(labels, np.inf)
        for m in self.machines:
            if m.first in votes and m.second in votes:
                for label, z in ((m.first, odds[m.column]), (m.second, -odds[m.column])):
                    votes[label] += z > 0
                    sums[label] += z
                    worst[label] = min(worst[label], z)
        best = max(labels, key=lambda x: (votes[x], sums[x], x))
        return best, 1.0 if len(labels) == 1 else float(1 / (1 + np.exp(-np.clip(worst[best], -30, 30))))

    def predict(self, text: str) -> tuple[str, float]:
        odds = self.margins(text) * self.slope
        family, sure = self.choose(sorted(self.languages), odds)
        language, surer = self.choose(self.languages[family], odds)
        return language, sure * surer


def _fit_machine(idx: list[np.ndarray], val: list[np.ndarray], y: np.ndarray, options: LanguageOptions):
    """Linear SVM with squared hinge loss by accelerated gradient steps; classes weigh the same."""
    cols, vals = np.concatenate(idx), np.concatenate(val)
    rows = np.repeat(np.arange(len(idx)), [len(i) for i in idx])
    n, size = len(idx), 1 << BITS
    scale = 1 / np.sqrt((vals**2).sum() / n)
    vals = vals * scale
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w, b, old_w, old_b = np.zeros(size), 0.0, np.zeros(size), 0.0
    # A row's norm bounds the curvature; rows of peaky texts need the larger bound.
    norms = np.bincount(rows, vals**2, n)
    step = 1 / (2 * ((share * (norms + 1)).sum()) + options.penalty)
    for t in range(options.rounds * 4):
        k = t / (t + 3)
        u, c = w + k * (w - old_w), b + k * (b - old_b)
        slack = np.maximum(0, 1 - y * (np.bincount(rows, vals * u[cols], n) + c))
        pull = -2 * share * slack * y
        old_w, old_b = w, b
        w = u - step * (np.bincount(cols, vals * pull[rows], size) + options.penalty * u)
        b = c - step * pull.sum()
    margin = np.abs(np.bincount(rows, vals * w[cols], n) + b)
    return w * scale, b, 6 / max(float(np.median(margin)), 1e-9)


def _sample(train: DataFrame, key: str, options: LanguageOptions) -> DataFrame:
    """A hash-drawn share of each language, `per_language` rows in expectation; all of a rare one."""
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(options.seed)), F.lit(1 << 20)) / float(1 << 20)
    keep = F.lit(False)
    for lang, n in sorted(counts.items()):
        keep = F.when(F.col("lang") == lang, draw < options.per_language / n).otherwise(keep)
    return train.filter(keep)


def fit(train: DataFrame, key: str = "doc_id", options: LanguageOptions = LanguageOptions()) -> LanguageModel:
    """train: (key, text, lang). Counts all rows, fits on the sample."""
    rows = pick(train, key, "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))

    def featured(batches):
        for batch in small_batches(batches):
            idx, val = [], []
            for text in batch.column(1).to_pylist():
                counts = np.zeros(1 << BITS)
                for start in range(0, len(text), BLOCK):
                    counts += np.bincount(trigrams(text[start:start + BLOCK]), minlength=1 << BITS)
                at = np.flatnonzero(counts)
                idx.append(at.astype(np.int32))
                val.append((counts[at] / counts.sum()).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))],
                ["id", "lang", "idx", "val"],
            )

    sample = _sample(rows, key, options).select(F.col(key).cast("string").alias("id"), "text", "lang")
    got = sample.mapInArrow(featured, "id string, lang string, idx array<int>, val array<float>").toArrow()
    got = got.sort_by([("id", "ascending")])  # sums then run in the same order every time
    lang = np.array(got["lang"].to_pylist(), object)
    idx = [x.values.to_numpy().astype(np.int64) for x in got["idx"]]
    val = [x.values.to_numpy().astype(np.float64) for x in got["val"]]
    del got
    families: dict[str, list[str]] = {}
    for code in sorted(set(lang)):
        families.setdefault(FAMILY_OF.get(code, f"({code})"), []).append(code)
    family = np.array([FAMILY_OF.get(x, f"({x})") for x in lang], object)
    tasks = [(a, b, family) for a, b in combinations(sorted(families), 2)]
    tasks += [(a, b, lang) for members in families.values() for a, b in combinations(members, 2)]
    machines, weights, bias, slope = [], [], [], []
    for a, b, of in tasks:
        own = [i for i in range(len(of)) if of[i] in (a, b)]
        y = np.array([1.0 if of[i] == a else -1.0 for i in own])
        w, c, s = _fit_machine([idx[i] for i in own], [val[i] for i in own], y, options)
        machines.append(Machine(a, b, len(machines)))
        weights.append(w)
        bias.append(c)
        slope.append(s)
    table = np.stack(weights, 1).astype(np.float32) if weights else np.zeros((1 << BITS, 0), np.float32)
    del idx, val, weights
    let_go()  # the driver's Python, too, lives on
    return LanguageModel(families, machines, table, np.array(bias), np.array(slope))


def predicted(model: LanguageModel, text: Column) -> Column:
    """struct(lang, score) of a text column."""
    if not model.languages:
        return F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    shared = model

    @F.arrow_udf("lang string, score double")
    def guess(texts: pa.Array) -> pa.Array:
        found = [shared.predict(t) if t else ("und", 0.0) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([x for x, _ in found], pa.string()), pa.array([float(y) for _, y in found], pa.float64())],
            ["lang", "score"],
        )

    return guess(text)


def _identify(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds lang_pred and lang_score from `body`; texts without a letter are und."""
    written = F.coalesce(F.col("body").rlike(r"\p{L}"), F.lit(False))
    found = rows.withColumn("found", predicted(model, F.when(written, F.col("body"))))
    return found.withColumns({
        "lang_pred": F.when(written, F.col("found.lang")).otherwise("und"),
        "lang_score": F.when(written, F.col("found.score")).otherwise(0.0),
    })


def identified(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, lang_score)."""
    rows = pick(docs, key, text).select(F.struct(key).alias("row"), F.col(text).alias("body"))
    return _identify(rows, model).select("row.*", "lang_pred", "lang_score")


def in_known_language(docs: DataFrame, model: LanguageModel, min_score: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose language is known well enough, as they were; und rows go."""
    found = _identify(tucked(docs, body=text), model)
    return found.filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= min_score)).select("row.*")
