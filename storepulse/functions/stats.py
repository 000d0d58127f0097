"""Statistical column expressions and exact quantiles that scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, NULL when whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def pct(part: Column, whole: Column) -> Column:
    return F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double"))


def wilson_interval(hits: Column, trials: Column, z: float) -> tuple[Column, Column]:
    """Wilson score interval of a proportion; NULL bounds when there are no trials."""
    n = trials.cast("double")
    share = F.try_divide(hits.cast("double"), n)
    z2 = F.lit(z * z)
    scale = F.lit(1.0) + F.try_divide(z2, n)
    middle = (share + F.try_divide(z2, n * 2)) / scale
    spread = F.sqrt(F.try_divide(share * (F.lit(1.0) - share), n) + F.try_divide(z2, n * n * 4))
    half = F.lit(z) * spread / scale
    return middle - half, middle + half


def interpolated(value: str, probs: Sequence[float]) -> Column:
    """Exact linearly interpolated quantiles of a column with few distinct values.

    Spark keeps one counter per distinct value, so use it for day counts, for
    backtest errors and the like, and `exact_quantiles` for open-ended amounts.
    """
    return F.percentile(F.col(value).cast("double"), [float(p) for p in probs])


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    accuracy: int = 10_000,
    margin: float = 0.001,
    also: Sequence[Column] = (),
) -> DataFrame:
    """Exact linearly interpolated quantiles of one column over any number of rows.

    Pass 1 brackets every quantile with a bounded sketch whose rank error is at most
    1/accuracy, and computes the aggregates in `also` on the way. Pass 2 counts the values
    inside each bracket, the rows on either side, and the nearest value on either side, so a
    quantile next to its bracket is exact too; a rank farther outside raises an error. Only
    the slice of a bracket that holds the rank is sorted. Returns one row (q, also...), q an
    array in the order of `probs`, empty when there is no value.
    """
    if margin < 5.0 / accuracy:
        raise ValueError("margin must exceed the sketch error")
    slices = 1024
    probs = [float(p) for p in probs]
    k = len(probs)
    edges = [max(p - margin, 0.0) for p in probs] + [min(p + margin, 1.0) for p in probs]
    rows = df.withColumn("_v", F.col(value).cast("double"))
    first = rows.agg(
        F.count("_v").alias("_n"), F.percentile_approx("_v", edges, accuracy).alias("_s"), *also
    )
    extra = [c for c in first.columns if c not in ("_n", "_s")]
    # One subquery, attached once; every later step reads its fields from the rows.
    info = first.select(F.struct("_n", "_s", *extra).alias("info")).scalar()
    span = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col("info._s")[i].alias("lo"), F.col("info._s")[k + i].alias("hi")) for i in range(k)
    ]))
    spans = rows.filter("_v is not null").select("_v", info.alias("info")).select("_v", "info", span.alias("b")).select(
        "_v", "info", "b.*"
    )
    side = F.when(F.col("_v") < F.col("lo"), -1).when(F.col("_v") > F.col("hi"), 1).otherwise(0)
    width = F.col("hi") - F.col("lo")
    place = F.when(side != 0, F.when(side < 0, 0).otherwise(slices + 1)).when(width > 0, F.least(
        F.floor((F.col("_v") - F.col("lo")) / width * slices) + 1, F.lit(slices)
    )).otherwise(1)
    # Rows beside a bracket share one slot each: their number and the value next to the bracket.
    counts = spans.groupBy(
        "i", side.alias("side"), place.cast("int").alias("slice"), F.when(side == 0, F.col("_v")).alias("at")
    ).agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.first("info").alias("info"))
    per_slice = counts.groupBy("i", "slice").agg(F.sum("c").alias("c"), F.first("info._n").alias("n"))
    position = F.element_at(F.array(*map(F.lit, probs)), F.col("i") + 1) * (F.col("n") - 1)
    # A bracket has at most 1026 slices, so this window is small whatever the data.
    upto = F.sum("c").over(Window.partitionBy("i").orderBy("slice"))
    wanted = (
        per_slice.withColumns({"pos": position, "before": upto - F.col("c")})
        .filter((F.ceil("pos") >= F.col("before")) & (F.floor("pos") < F.col("before") + F.col("c")))
        .select(F.col("i").alias("j"), F.col("slice").alias("part"), "pos", "before")
    )
    inside = counts.join(wanted, (F.col("i") == F.col("j")) & (F.col("slice") == F.col("part")))
    ranked = inside.withColumn(
        "after", F.col("before") + F.sum("c").over(Window.partitionBy("i", "slice").orderBy("at"))
    ).withColumn("start", F.col("after") - F.col("c"))

    def value_at(rank: Column) -> Column:
        here = (F.col("start") <= rank) & (rank < F.col("after"))
        beside = F.when(F.col("side") < 0, F.when(rank == F.col("after") - 1, F.col("high"))).when(
            F.col("side") > 0, F.when(rank == F.col("start"), F.col("low"))
        ).otherwise(F.col("at"))
        return F.max(F.when(here, beside))

    found = ranked.groupBy("i").agg(
        F.max("pos").alias("pos"), value_at(F.floor("pos")).alias("a"), value_at(F.ceil("pos")).alias("b"),
        F.first("info").alias("info"),
    )
    outside = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
    point = F.when(F.col("a").isNull() | F.col("b").isNull(), outside).otherwise(
        F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.floor("pos"))
    )
    q = F.transform(F.sort_array(F.collect_list(F.struct("i", point.alias("q")))), lambda s: s["q"])
    return found.agg(q.alias("q"), F.first("info").alias("info")).select("q", *[f"info.{c}" for c in extra])


def quartile_score(value: Column, edges: Column) -> Column:
    """1 to 4 by right-closed quartile bins; ties share a bin, equal edges merge downwards."""
    return (
        F.when(value <= edges[0], 1).when(value <= edges[1], 2).when(value <= edges[2], 3)
        .when(value.isNotNull(), 4)
    )


def right_closed_band(value: Column, bands: Sequence[tuple[str, float]]) -> Column:
    """Label of the first band whose upper edge is not exceeded; NULL outside (0, last]."""
    label = F.when(value <= 0, F.lit(None).cast("string"))
    for name, upper in bands:
        label = label.when(value <= F.lit(upper), F.lit(name))
    return label


def fixed_histogram(df: DataFrame, value: str, bins: int, clip_upper: float | None = None) -> DataFrame:
    """Equal-width histogram over the observed range; the last bin is closed on both sides."""
    x = F.col(value).cast("double")
    if clip_upper is not None:
        x = F.when(x.isNotNull(), F.least(x, F.lit(float(clip_upper))))
    rows = df.select(x.alias("x")).filter(F.col("x").isNotNull())
    span = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).filter(F.col("lo").isNotNull())
    flat = F.col("lo") == F.col("hi")
    span = span.select(
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    edges = span.select(F.struct("lo", "hi").alias("e")).scalar()
    slot = F.least(F.width_bucket("x", edges["lo"], edges["hi"], F.lit(bins)), F.lit(bins))
    counts = rows.groupBy(slot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every_bin = span.select(
        "lo", ((F.col("hi") - F.col("lo")) / bins).alias("width"),
        F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"),
    )
    return every_bin.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("width") * (F.col("bin") - 1)).alias("bin_from"),
        (F.col("lo") + F.col("width") * F.col("bin")).alias("bin_to"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    )
