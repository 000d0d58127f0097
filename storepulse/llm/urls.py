"""URL filters: gradient-boosted trees on lexical features, below a list of host rules.

Main path: DataFrame functions and Spark's own tree learner only. A rule decides first, the
longest that fits; other URLs get the verdict of the trees, which are trained from labelled
URLs on length, depth, digit ratio, entropy, parameter counts and suffix statistics.

Defined cases: a null URL or one without "://" has empty host and path and is judged by the
trees; repeated rows are judged alike; with no labelled URL, or with one label only, the
trees are replaced by that label (allow when there is none); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storepulse.llm.common import lower_ascii, pick, stored

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "hyphens",
    "entropy", "params", "query_length", "has_fragment", "is_https", "suffix_odds", "domain_odds",
)


@dataclass(frozen=True)
class UrlModel:
    """Trees, iterations and the bound on the labelled URLs the trees are fitted on.

    The suffix statistics count every labelled URL; `fit_rows` bounds the tree fit alone
    (the rows with the smallest hash are taken, so reruns agree).
    """

    fit_rows: int = 20_000
    trees: int = 20
    depth: int = 4
    smoothing: float = 4.0
    seed: int = 7


def host_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; NULL without one. The rules are a short list
    given as a parameter, so they are one expression inside the scan."""
    rule = verdict = F.when(F.lit(False), F.lit(""))
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        site, _, rest = text.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith("/" + rest)
        rule, verdict = rule.when(fits, F.lit(text)), verdict.when(fits, F.lit(kind))
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits per character: each distinct character's share, from what is left without it."""
    n = F.length(text)
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda ch: (n - F.length(F.replace(text, ch, F.lit("")))) / n)
    total = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return F.when(n > 0, total).otherwise(0.0)


def lexical(df: DataFrame) -> DataFrame:
    """Adds the lexical features to (url, host, path, ...)."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    ratio = lambda c: F.when(F.length(c) > 0, F.length(F.regexp_replace(c, "[^0-9]", "")) / F.length(c)).otherwise(0.0)
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    parts = F.split("host", r"\.")
    return df.withColumns({
        "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"),
        "depth": count(F.col("path"), "/"), "labels": count(F.col("host"), "."),
        "digit_ratio": ratio(url), "host_digit_ratio": ratio(F.col("host")), "hyphens": count(url, "-"),
        "entropy": _entropy(url),
        "params": F.when(query == "", 0).otherwise(count(query, "&") + 1), "query_length": F.length(query),
        "has_fragment": url.contains("#").cast("int"), "is_https": url.startswith("https://").cast("int"),
        "suffix": F.element_at(parts, -1),
        "domain": F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "."),
    })


def _odds(labelled: DataFrame, key: str, model: UrlModel) -> DataFrame:
    """Smoothed log-odds of `block` per key over all labelled URLs."""
    k = model.smoothing
    return labelled.groupBy(key).agg(
        F.log((F.sum("label") + k / 2) / (F.count("label") - F.sum("label") + k / 2)).alias(f"{key}_odds")
    )


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, model: UrlModel = UrlModel(),
          key: str = "page_id") -> DataFrame:
    """Verdict per row: (key, host, path, rule, verdict, block_score).

    labelled: (url, label 1 = block), by default the pages that a rule decides.
    """
    host, path = host_path(F.col("url"))
    base = pick(pages, key, "url").withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "ruled": verdict})
    if labelled is None:
        train = base.filter("ruled is not null").withColumn("label", (F.col("ruled") == "block").cast("double"))
    else:
        train = pick(labelled, "url", "label").filter("label is not null").withColumns({"host": host, "path": path})
        train = train.withColumn("label", F.col("label").cast("double"))
    train = lexical(train)
    counts = {row["label"]: row["n"] for row in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        only = 1.0 if 1.0 in counts else 0.0
        scored = base.withColumn("block_score", F.lit(only))
    else:
        stats = {k: stored(_odds(train, k, model), f"url-{k}") for k in ("suffix", "domain")}

        def dense(df: DataFrame) -> DataFrame:
            for k, odds in stats.items():
                df = df.join(odds, k, "left")
            return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
                df.fillna(0.0, ["suffix_odds", "domain_odds"])
            )

        sample = train.orderBy(F.xxhash64("url", F.lit(model.seed)), "url").limit(model.fit_rows)
        fit_on = stored(dense(sample).select("features", "label"), "url-fit")
        trees = GBTClassifier(maxIter=model.trees, maxDepth=model.depth, seed=model.seed, maxBins=64).fit(fit_on)
        scored = trees.transform(dense(lexical(base))).withColumn("block_score", vector_to_array("probability")[1])
    decided = F.coalesce(F.col("ruled"), F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select(key, "host", "path", "rule", decided.alias("verdict"), "block_score")

