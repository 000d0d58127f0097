"""Fits of short series in column expressions: damped trend and least squares.

A series is one array, or one row per point of it; its length is the number of calendar weeks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations_with_replacement, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Search bounds of the damped-trend parameters.
SMOOTHING_BOUNDS = (1e-4, 1 - 1e-4)
DAMPING_BOUNDS = (0.8, 0.995)
# First grid (level weight, trend weight as a share of it, damping) and the number of times the
# neighbourhood of its best point is searched with half the steps: in all directions at first,
# then along the axes only.
GRID = (9, 5, 4)
HALVINGS = 8
ALL_WAYS = 3
# A regressor whose part that others do not explain is smaller than this share is left out.
DEPENDENT = 1e-10


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


# --- damped trend --------------------------------------------------------------------------

def _even(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * i / (n - 1) for i in range(n)]


def first_grid() -> list[tuple[float, float, float]]:
    """(level weight, share of the trend weight, damping) of every point of the first grid."""
    return list(product(_even(*SMOOTHING_BOUNDS, GRID[0]), _even(0.0, 1.0, GRID[1]), _even(*DAMPING_BOUNDS, GRID[2])))


def first_steps() -> tuple[float, float, float]:
    return ((SMOOTHING_BOUNDS[1] - SMOOTHING_BOUNDS[0]) / (GRID[0] - 1), 1.0 / (GRID[1] - 1),
            (DAMPING_BOUNDS[1] - DAMPING_BOUNDS[0]) / (GRID[2] - 1))


def _started(y: Column, p: Column) -> Column:
    """Run level and trend through the series; the sums that give the best start state.

    In the error form one step needs the next prediction and its damped trend alone: with the
    error e, the damped trend becomes phi * (d + alpha * beta * e) and the prediction grows by
    alpha * e and that. Both are affine in the start level and trend, so three runs describe
    every start: the data (a), a unit level (u) and a unit trend (v) without data.
    """
    alpha, phi = p["alpha"], p["phi"]
    gain = alpha * F.greatest(alpha * p["share"], F.lit(SMOOTHING_BOUNDS[0]))
    zero, one = F.lit(0.0), F.lit(1.0)
    names = ("pa", "da", "pu", "du", "pv", "dv", "uu", "uv", "vv", "ue", "ve", "ee")

    def state(*values: Column) -> Column:
        return F.struct(*(v.alias(n) for n, v in zip(names, values, strict=True)))

    def moved(predicted: Column, drift: Column, error: Column) -> tuple[Column, Column]:
        turned = phi * (drift + gain * error)
        return predicted + alpha * error + turned, turned

    def step(s: Column, value: Column) -> Column:
        e, u, v = value - s["pa"], s["pu"], s["pv"]
        runs = [c for p, d, error in ((s["pa"], s["da"], e), (u, s["du"], -u), (v, s["dv"], -v)) for c in moved(p, d, error)]
        return state(*runs, s["uu"] + u * u, s["uv"] + u * v, s["vv"] + v * v, s["ue"] + u * e, s["ve"] + v * e, s["ee"] + e * e)

    start = state(zero, zero, one, zero, phi * one, phi * one, *[zero] * 6)

    def best_start(s: Column) -> Column:
        # A series too short to tell level and trend apart starts without a trend.
        det = s["uu"] * s["vv"] - s["uv"] * s["uv"]
        alone = det <= F.lit(DEPENDENT) * s["uu"] * s["vv"]
        level = F.when(alone, s["ue"] / s["uu"]).otherwise((s["ue"] * s["vv"] - s["ve"] * s["uv"]) / det)
        trend = F.when(alone, F.lit(0.0)).otherwise((s["ve"] * s["uu"] - s["ue"] * s["uv"]) / det)
        return F.struct(
            (s["ee"] - level * s["ue"] - trend * s["ve"]).alias("sse"), alpha.alias("alpha"), p["share"].alias("share"),
            phi.alias("phi"), level.alias("level"), trend.alias("trend"))

    return _let(F.aggregate(y, start, step), best_start)


def _clipped(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def _around(best: Column, steps: Sequence[float], all_ways: bool) -> Column:
    """The best point and its neighbours one step away, inside the bounds."""
    def point(i: int, j: int, k: int) -> Column:
        return F.struct(
            _clipped(best["alpha"] + i * steps[0], *SMOOTHING_BOUNDS).alias("alpha"),
            _clipped(best["share"] + j * steps[1], 0.0, 1.0).alias("share"),
            _clipped(best["phi"] + k * steps[2], *DAMPING_BOUNDS).alias("phi"))

    return F.array(*(point(*m) for m in product((-1, 0, 1), repeat=3) if all_ways or sum(map(abs, m)) <= 1))


def damped_trend(y: Column) -> Column:
    """Additive damped trend of an array by least squares: struct(phi, level, trend, fitted).

    The trend weight is at most the level weight. A grid over the three smoothing parameters is
    refined around its best point; of points with the same error the one with the smallest
    parameters is taken. `level` and `trend` are the state after the last value.
    """
    grid = F.array(*(F.struct(F.lit(a).alias("alpha"), F.lit(s).alias("share"), F.lit(f).alias("phi")) for a, s, f in first_grid()))

    def least(points: Column, values: Column) -> Column:
        return F.array_min(F.transform(points, lambda p: _started(values, p)))

    def refined(values: Column) -> Column:
        best, steps = least(grid, values), first_steps()
        for i in range(HALVINGS):
            steps = tuple(x / 2 for x in steps)
            best = closer(best, steps, i < ALL_WAYS, values)
        return _let(best, lambda b: _run(values, b))

    def closer(best: Column, steps: Sequence[float], all_ways: bool, values: Column) -> Column:
        return _let(best, lambda b: least(_around(b, steps, all_ways), values))

    return _let(y, refined)


def _run(y: Column, best: Column) -> Column:
    """Run from the best start state; fitted values in order and the last state."""
    alpha, phi = best["alpha"], best["phi"]
    gain = alpha * F.greatest(alpha * best["share"], F.lit(SMOOTHING_BOUNDS[0]))
    start = F.struct((best["level"] + phi * best["trend"]).alias("next"), (phi * best["trend"]).alias("drift"),
                     F.array().cast("array<double>").alias("fitted"))

    def step(s: Column, value: Column) -> Column:
        error = value - s["next"]
        drift = phi * (s["drift"] + gain * error)
        return F.struct((s["next"] + alpha * error + drift).alias("next"), drift.alias("drift"),
                        F.concat(s["fitted"], F.array(s["next"])).alias("fitted"))

    return _let(F.aggregate(y, start, step), lambda s: F.struct(
        phi.alias("phi"), (s["next"] - s["drift"]).alias("level"), (s["drift"] / phi).alias("trend"), s["fitted"].alias("fitted")))


def damped_ahead(fit: Column, step: Column) -> Column:
    """Forecast so many steps after the last value."""
    reach = fit["phi"] * (F.lit(1.0) - F.pow(fit["phi"], step)) / (F.lit(1.0) - fit["phi"])
    return fit["level"] + reach * fit["trend"]


# --- least squares ---------------------------------------------------------------------------

def gram_columns(x: Sequence[str], y: str) -> dict[str, Column]:
    """Products whose sums over any set of rows are all that least squares needs; sums of parts add up."""
    out = {f"_g{i}_{j}": F.col(x[i]) * F.col(x[j]) for i, j in combinations_with_replacement(range(len(x)), 2)}
    return out | {f"_r{i}": F.col(x[i]) * F.col(y) for i in range(len(x))}


def solve(df: DataFrame, n: int, into: str) -> DataFrame:
    """Adds the coefficients `into`0..n-1 from columns _g<i>_<j> and _r<i> with the summed products.

    The regressors are cleared of those before them in order (Cholesky without roots). One that
    depends on those before it, like a flag that never occurs, gets the coefficient 0.
    """
    first = {f"_d{j}": F.col(f"_g{j}_{j}") for j in range(n)}
    df = df.withColumns(first)
    for j in range(n - 1):
        pivot = F.col(f"_g{j}_{j}")
        share = {k: F.when(pivot > DEPENDENT * F.col(f"_d{j}"), F.col(f"_g{j}_{k}") / pivot).otherwise(0.0) for k in range(j + 1, n)}
        df = df.withColumns({f"_f{j}_{k}": c for k, c in share.items()})
        changed = {f"_r{k}": F.col(f"_r{k}") - F.col(f"_f{j}_{k}") * F.col(f"_r{j}") for k in range(j + 1, n)}
        for k in range(j + 1, n):
            for m in range(k, n):
                changed[f"_g{k}_{m}"] = F.col(f"_g{k}_{m}") - F.col(f"_f{j}_{k}") * F.col(f"_g{j}_{m}")
        df = df.withColumns(changed)
    for j in reversed(range(n)):
        rest = F.col(f"_r{j}")
        for k in range(j + 1, n):
            rest = rest - F.col(f"_g{j}_{k}") * F.col(f"{into}{k}")
        pivot = F.col(f"_g{j}_{j}")
        df = df.withColumn(f"{into}{j}", F.when(pivot > DEPENDENT * F.col(f"_d{j}"), rest / pivot).otherwise(0.0))
    return df.drop(*(c for c in df.columns if c[:2] in ("_g", "_r", "_f", "_d") and c[2:3].isdigit()))
