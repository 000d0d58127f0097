"""Weekly forecasting for one or many series, backtests, intervals and the monthly plan.

A series is a frame (keys..., week, value) with Monday weeks; without keys it is one
series. All models run for all series and folds in the same jobs, as column expressions:
one ordered pass over a series gives its state at every origin, the running sums that the
regression needs and the values that the damped trend folds over. A series is as long as the
calendar has weeks, whatever the number of orders.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storepulse.functions.calendar import holiday_flags, week_start
from storepulse.functions.fitting import damped_ahead, damped_trend, gram_columns, solve
from storepulse.functions.joins import attach, match
from storepulse.functions.stats import interpolated, ratio
from storepulse.rules import Rules

BASELINES = ("naive", "ma4")
FITTED = ("holt_damped", "reg_trend")
MODELS = BASELINES + FITTED


def relative_error(actual: Column, predicted: Column) -> Column:
    """(actual - predicted) / predicted. A forecast of zero misses a sale by an infinite share,
    and gives NULL, which quantiles skip, when nothing was sold."""
    miss = actual - predicted
    return F.when(predicted != 0, miss / predicted).when(miss != 0, F.signum(miss) * F.lit(float("inf")))


def weekly_series(daily: DataFrame, r: Rules, value: str = "gross_revenue", keys: Sequence[str] = ()) -> DataFrame:
    """Sum a gap-free daily table into Monday weeks; incomplete weeks are left out."""
    weeks = (
        daily.filter(F.col("order_date") >= F.lit(r.week_start_from))
        .groupBy(*keys, week_start("order_date").alias("week"))
        .agg(F.sum(value).cast("double").alias("value"), F.count(F.lit(1)).alias("days"))
    )
    return weeks.filter(F.col("days") == 7).drop("days")


def _ordered(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("week")


def _baseline_state(series: DataFrame, models: Sequence[str], r: Rules, keys: Sequence[str]) -> DataFrame:
    """Per week: what each baseline would forecast from here on, and its residual spread so far.

    Adds `states`, an array of (model, forecast, resid_sd), and `_last` for the final week.
    """
    w = _ordered(keys)
    before = w.rowsBetween(-4, -1)
    level = {"naive": F.col("value"), "ma4": F.avg("value").over(w.rowsBetween(-3, 0))}
    residual = {
        "naive": F.col("value") - F.lag("value").over(w),
        "ma4": F.when(F.count("value").over(before) == 4, F.col("value") - F.avg("value").over(before)),
    }
    recent = w.rowsBetween(1 - r.residual_window, 0)
    named = series.withColumns({f"_level_{m}": level[m] for m in models}).withColumns(
        {f"_resid_{m}": residual[m] for m in models}
    )
    states = [
        F.struct(F.lit(m).alias("model"), F.col(f"_level_{m}").alias("forecast"),
                 F.stddev_pop(f"_resid_{m}").over(recent).alias("resid_sd"))
        for m in models
    ]
    return named.select(
        *series.columns, F.array(*states).alias("states"), F.lead("week").over(w).isNull().alias("_last")
    )


def _baselines(series: DataFrame, models: Sequence[str], h: int, r: Rules, keys: Sequence[str]) -> DataFrame:
    last = _baseline_state(series, models, r, keys).filter("_last")
    steps = last.select(*keys, "week", "states", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"))
    return steps.select(
        *keys, "step", F.date_add("week", F.col("step") * 7).alias("week"), F.inline("states")
    ).select(*keys, "model", "step", "week", "forecast", "resid_sd")


# Regressors of the trend: constant, week number, its logarithm, and the two holiday flags.
TREND = ("_one", "_t", "_log_t", "black_friday_week", "christmas_week")
HOLIDAY = 3  # place of the Black Friday flag among them


def _trend_columns(df: DataFrame, number: Column) -> DataFrame:
    """Adds the regressors to rows with a `week`; `number` counts the weeks of a series from 0."""
    t = number.cast("double")
    return holiday_flags(df).withColumns({"_one": F.lit(1.0), "_t": t, "_log_t": F.log1p(t)})


def _origins(series: DataFrame, models: Sequence[str], r: Rules, keys: Sequence[str], folds: int, ahead: int) -> DataFrame:
    """One row per origin with what the log models learn from the weeks up to it.

    Origins are the last weeks of `folds` folds, and with `ahead` the last week of the series
    as fold 0. All of them come from one ordered pass: `past` holds the values so far, the
    products of the regressors are running sums, `recent` the latest weeks. Series with a
    week that is not positive are left out, as logarithms need positive values.
    """
    so_far = _ordered(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _numbered(series, keys).filter("positive")
    state = {"past": F.collect_list("value").over(so_far)} if "holt_damped" in models else {}
    if "reg_trend" in models:
        rows = _trend_columns(rows.withColumn("_y", F.ln("value")), F.col("_i") - 1)
        state |= {name: F.sum(product).over(so_far) for name, product in gram_columns(TREND, "_y").items()}
        state["recent"] = F.collect_list(F.struct("value", *TREND)).over(_ordered(keys).rowsBetween(1 - r.residual_window, 0))
    if folds:
        state["actuals"] = F.collect_list("value").over(_ordered(keys).rowsBetween(1, r.horizon))
    back = F.col("_n") - r.horizon - F.col("_i")
    fold = F.when(F.lit(bool(folds)) & (back >= 0) & (back % r.fold_step == 0) & (back < folds * r.fold_step), F.floor(back / r.fold_step) + 1)
    last = F.when(F.lit(bool(ahead)) & (F.col("_i") == F.col("_n")), F.lit(0))
    at = rows.withColumns(state).withColumn("fold", F.explode(F.array_compact(F.array(fold.cast("int"), last))))
    return at.filter("fold is not null")


def _fitted(series: DataFrame, models: Sequence[str], r: Rules, keys: Sequence[str], folds: int, ahead: int) -> DataFrame:
    """(keys, fold, model, step, week, actual, forecast, resid_sd, multiplier) of every origin and step."""
    rows = _origins(series, models, r, keys, folds, ahead)
    none = F.lit(None).cast("double")
    actual = F.when(F.col("fold") > 0, F.col("actuals")[F.col("step") - 1]) if folds else none
    steps = F.explode(F.sequence(F.lit(1), F.when(F.col("fold") == 0, F.lit(ahead)).otherwise(F.lit(r.horizon))))
    if not keys:
        # One series sits in one partition; its origins can be fitted side by side.
        rows = rows.repartition(r.folds + 1, "fold")
    parts = []
    for model in models:
        if model == "holt_damped":
            fit = damped_trend(F.transform("past", lambda v: F.ln(v)))
            fits = rows.withColumn("fit", fit)
            missed = F.zip_with("past", "fit.fitted", lambda v, f: v - F.exp(f))
            fits = fits.withColumn("resid_sd", _spread(F.slice(missed, F.greatest(F.size("past") - r.residual_window, F.lit(0)) + 1, r.residual_window)))
            out = fits.withColumn("step", steps).withColumn("week", F.date_add("week", F.col("step") * 7))
            point, lift = F.exp(damped_ahead(F.col("fit"), F.col("step"))), none
        else:
            fits = solve(rows, len(TREND), "_c")
            line = lambda x: sum((F.col(f"_c{i}") * x(c) for i, c in enumerate(TREND)), F.lit(0.0))
            fits = fits.withColumn("resid_sd", _spread(F.transform("recent", lambda w: w["value"] - F.exp(line(lambda c: w[c])))))
            future = fits.drop(*TREND).withColumn("step", steps).withColumn("week", F.date_add("week", F.col("step") * 7))
            out = _trend_columns(future, F.col("_i") - 1 + F.col("step"))
            point, lift = F.exp(line(F.col)), F.exp(f"_c{HOLIDAY}")
        parts.append(out.select(
            *keys, "fold", F.lit(model).alias("model"), "step", "week", actual.alias("actual"), point.alias("forecast"),
            "resid_sd", lift.alias("multiplier")))
    return reduce(DataFrame.unionByName, parts)


def _spread(values: Column) -> Column:
    """Population standard deviation of an array."""
    n = F.size(values)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    mean = F.transform(F.array(total(values) / n), lambda m: F.sqrt(total(F.transform(values, lambda x: (x - m) * (x - m))) / n))
    return mean[0]


def _split(models: Sequence[str]) -> tuple[list[str], list[str]]:
    unknown = [m for m in models if m not in MODELS]
    if unknown:
        raise ValueError(f"unknown model {unknown}; use {MODELS}")
    return [m for m in models if m in BASELINES], [m for m in models if m in FITTED]


def forecasts(series: DataFrame, models: Sequence[str], h: int, r: Rules, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, model, step, week, forecast, resid_sd) for the h weeks after each series' last week.

    Series with a non-positive week get no rows from the two log models.
    """
    base, fitted = _split(models)
    parts = []
    if base:
        parts.append(_baselines(series, base, h, r, keys))
    if fitted:
        parts.append(_fitted(series, fitted, r, keys, 0, h).drop("fold", "actual", "multiplier"))
    return reduce(DataFrame.unionByName, parts)


def forecast(series: DataFrame, model: str, h: int, r: Rules, keys: Sequence[str] = ()) -> DataFrame:
    """One model, with the residual interval."""
    return residual_interval(forecasts(series, [model], h, r, keys), r)


def residual_interval(points: DataFrame, r: Rules) -> DataFrame:
    """80% band from the spread of the latest residuals, widening with the root of the step."""
    reach = F.lit(r.z80) * F.col("resid_sd") * F.sqrt("step")
    return points.withColumns({
        "lower_80": F.greatest(F.col("forecast") - reach, F.lit(0.0)),
        "upper_80": F.col("forecast") + reach,
    })


def _numbered(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    whole = Window.partitionBy(*keys)
    return series.withColumns({
        "_i": F.row_number().over(_ordered(keys)),
        "_n": F.count(F.lit(1)).over(whole),
        "positive": F.min("value").over(whole) > 0,
    })


def _in_folds(numbered: DataFrame, r: Rules, first: str) -> DataFrame:
    """Repeat each week for every fold it belongs to; `_ahead` counts weeks after the origin.

    Rows are multiplied by the folds after the only shuffle, and later groupings by keys
    and fold reuse its partitioning. `first` limits how far back a fold reaches.
    """
    folded = numbered.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(r.folds))))
    cut = (F.col("_n") - r.horizon - (F.col("fold") - 1) * r.fold_step).cast("int")
    folded = folded.withColumn("_cut", cut).withColumn("_ahead", F.col("_i") - F.col("_cut"))
    return folded.filter((F.col("_cut") >= 1) & (F.col("_ahead") <= r.horizon)).filter(first)


def rolling_origin_folds(series: DataFrame, r: Rules, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, fold, week, value, is_test, step, positive): training and test rows of every origin.

    Fold 1 ends `horizon` weeks before the last week; each further fold ends `fold_step`
    weeks earlier.
    """
    ahead = F.col("_ahead")
    return _in_folds(_numbered(series, keys), r, "true").select(
        *keys, "fold", "week", "value", (ahead > 0).alias("is_test"), F.when(ahead > 0, ahead).alias("step"),
        "positive",
    )


def _baseline_errors(series: DataFrame, models: Sequence[str], r: Rules, keys: Sequence[str]) -> DataFrame:
    # A fold needs its origin week, which carries the forecasts, and its test weeks.
    state = _baseline_state(_numbered(series, keys), models, r, keys)
    rows = _in_folds(state, r, "_ahead >= 0")
    at_origin = F.max(F.when(F.col("_ahead") == 0, F.col("states"))).over(Window.partitionBy(*keys, "fold"))
    tests = rows.withColumn("states", at_origin).filter(F.col("_ahead") > 0)
    return tests.select(
        *keys, "fold", F.col("_ahead").alias("step"), "week", F.col("value").alias("actual"), F.inline("states")
    )


def backtest_errors(series: DataFrame, models: Sequence[str], r: Rules, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, model, fold, step, week, actual, forecast, pct_err) for every origin and step.

    The log models take part only for series that are positive throughout, so that each
    model is judged on all folds of a series or on none.
    """
    base, fitted = _split(models)
    columns = [*keys, "model", "fold", "step", "week", "actual", "forecast"]
    parts = []
    if base:
        parts.append(_baseline_errors(series, base, r, keys).select(columns))
    if fitted:
        parts.append(_fitted(series, fitted, r, keys, r.folds, 0).select(columns))
    errors = reduce(DataFrame.unionByName, parts)
    return errors.withColumn("pct_err", relative_error(F.col("actual"), F.col("forecast")))


def backtest_summary(errors: DataFrame, r: Rules, keys: Sequence[str] = ()) -> DataFrame:
    """Per series and model, unrounded: wape_pct, the period_err_* quantiles of the error of
    whole test periods, and the step_err_* quantiles of single weeks."""
    fold = Window.partitionBy(*keys, "model", "fold")
    total, predicted = F.sum("actual").over(fold), F.sum("forecast").over(fold)
    scored = errors.withColumn("_period", F.when(F.col("step") == 1, relative_error(total, predicted)))
    out = scored.groupBy(*keys, "model").agg(
        ratio(F.lit(100.0) * F.sum(F.abs(F.col("actual") - F.col("forecast"))), F.sum("actual")).alias("wape_pct"),
        interpolated("_period", r.interval_probs).alias("period"),
        interpolated("pct_err", r.interval_probs).alias("steps"),
    )
    return out.select(
        *keys, "model", "wape_pct",
        F.col("period")[0].alias("period_err_p10"), F.col("period")[1].alias("period_err_p90"),
        F.col("steps")[0].alias("step_err_p10"), F.col("steps")[1].alias("step_err_p90"),
    )


SUMMARY = ("wape_pct", "period_err_p10", "period_err_p90")


def rounded_summary(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The report form: three decimals, half to even. The monthly plan uses these values."""
    return summary.select(*keys, "model", *[F.bround(c, 3).alias(c) for c in SUMMARY])


def backtest(
    series: DataFrame, models: Sequence[str], r: Rules, keys: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(summary, step errors); order the summary by wape_pct for the league table."""
    errors = backtest_errors(series, models, r, keys)
    return backtest_summary(errors, r, keys), errors


def _best(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summary rows of the winners. A series has a handful of models, so the window is tiny."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("wape_pct", "model"))
    ranked = summary.filter(F.col("wape_pct").isNotNull()).withColumn("_place", place)
    return ranked.filter(F.col("_place") == 1).drop("_place")


def select_best_model(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, model) with the lowest WAPE per series; equal WAPE goes to the first name."""
    return _best(summary, keys).select(*keys, "model")


def calibrated_interval(points: DataFrame, summary: DataFrame, r: Rules, keys: Sequence[str] = ()) -> DataFrame:
    """80% band from the pooled step errors of the same model in the backtest.

    Beyond the tested horizon the band widens with the root of step / horizon. Points of
    models that the summary lacks are left out.
    """
    by = [*keys, "model"]
    return _banded(match(points, summary.select(*by, "step_err_p10", "step_err_p90"), by), r)


def _banded(points: DataFrame, r: Rules) -> DataFrame:
    widen = F.sqrt(F.greatest(F.col("step") / F.lit(float(r.horizon)), F.lit(1.0)))
    point = F.col("forecast")
    return points.withColumns({
        "lower_80": F.greatest(point * (F.lit(1.0) + F.col("step_err_p10") * widen), F.lit(0.0)),
        "upper_80": point * (F.lit(1.0) + F.col("step_err_p90") * widen),
    }).drop("step_err_p10", "step_err_p90")


def _scored(series: DataFrame, r: Rules, models: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Forecasts of every model, each row with the model's backtest figures.

    Backtest and final forecast are rows of one frame (the final one is fold 0), and the
    figures are windows over it: as many rows per series and model as there are folds and
    weeks to forecast.
    """
    base, fitted = _split(models)
    columns = [*keys, "model", "fold", "step", "week", "actual", "forecast", "multiplier"]
    none = F.lit(None).cast("double")
    parts = []
    if base:
        parts.append(_baseline_errors(series, base, r, keys).withColumn("multiplier", none).select(columns))
        final = _baselines(series, base, r.forecast_weeks, r, keys)
        parts.append(final.withColumns({"fold": F.lit(0), "actual": none, "multiplier": none}).select(columns))
    if fitted:
        parts.append(_fitted(series, fitted, r, keys, r.folds, r.forecast_weeks).select(columns))
    rows = reduce(DataFrame.unionByName, parts)
    model, fold = Window.partitionBy(*keys, "model"), Window.partitionBy(*keys, "model", "fold")
    test = F.col("fold") > 0
    total, predicted = F.sum("actual").over(fold), F.sum("forecast").over(fold)
    rows = rows.withColumns({
        "_step": F.when(test, relative_error(F.col("actual"), F.col("forecast"))),
        "_period": F.when(test & (F.col("step") == 1), relative_error(total, predicted)),
        "_miss": F.when(test, F.abs(F.col("actual") - F.col("forecast"))),
    })
    steps, periods = (interpolated(c, r.interval_probs).over(model) for c in ("_step", "_period"))
    rows = rows.withColumns({
        "wape_pct": ratio(F.lit(100.0) * F.sum("_miss").over(model), F.sum("actual").over(model)),
        "_steps": steps, "_periods": periods,
    })
    return rows.filter(~test).select(
        *keys, "model", "step", "week", "forecast", "multiplier", "wape_pct",
        F.col("_steps")[0].alias("step_err_p10"), F.col("_steps")[1].alias("step_err_p90"),
        F.col("_periods")[0].alias("period_err_p10"), F.col("_periods")[1].alias("period_err_p90"),
    )


def best_forecast(
    series: DataFrame, r: Rules, models: Sequence[str] = MODELS, keys: Sequence[str] = ()
) -> DataFrame:
    """Forecast of each series' best model with the calibrated band, in whole money units,
    together with the model's rounded period errors and the holiday multiplier of the trend
    regression (NULL without that model), which the monthly plan needs."""
    every = Window.partitionBy(*keys)
    first = F.min(F.when(F.col("wape_pct").isNotNull(), F.struct("wape_pct", "model"))).over(every)
    rows = _scored(series, r, models, keys).withColumns(
        {"_best": first["model"], "multiplier": F.max("multiplier").over(every)}
    )
    banded = _banded(rows.filter(F.col("model") == F.col("_best")).drop("_best", "wape_pct"), r)
    whole = {c: F.bround(c, 0) for c in ("forecast", "lower_80", "upper_80")}
    return banded.withColumns(whole | {c: F.bround(c, 3) for c in ("period_err_p10", "period_err_p90")})


def weekly_forecast(
    series: DataFrame, r: Rules, models: Sequence[str] = MODELS, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, model, step, week, forecast, lower_80, upper_80) of the best model per series."""
    return best_forecast(series, r, models, keys).drop("period_err_p10", "period_err_p90", "multiplier")


def holiday_multiplier(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, multiplier): Black Friday week relative to a normal week in the trend regression."""
    last = _origins(series, ["reg_trend"], Rules(), keys, 0, 1)
    return solve(last, len(TREND), "_c").select(*keys, F.exp(f"_c{HOLIDAY}").alias("multiplier"))


def monthly_plan(best: DataFrame, multiplier: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Spread weekly forecasts over days, lift the Black Friday week, sum complete months.

    `best` comes from best_forecast: rounded forecasts, period errors and multiplier of each
    series. A given `multiplier` frame takes the place of theirs; a series without one gets
    no lift.
    """
    errors = ["period_err_p10", "period_err_p90"]
    if multiplier is None:
        lifted = holiday_flags(best.select(*keys, "week", "forecast", "multiplier", *errors))
    else:
        lifted = attach(holiday_flags(best.select(*keys, "week", "forecast", *errors)), multiplier, keys)
    base = F.col("forecast") / 7
    lift = F.when(F.col("black_friday_week") == 1, F.coalesce("multiplier", F.lit(1.0))).otherwise(1.0)
    days = lifted.select(
        *keys, *errors, base.alias("base"), (base * lift).alias("lifted"),
        F.explode(F.sequence("week", F.date_add("week", 6))).alias("date"),
    )
    months = days.groupBy(*keys, F.trunc("date", "month").alias("month")).agg(
        F.sum("base").alias("base"), F.sum("lifted").alias("lifted"), F.count(F.lit(1)).alias("days"),
        *[F.max(c).alias(c) for c in errors],
    ).filter(F.col("days") == F.dayofmonth(F.last_day("month")))
    plan = F.col("lifted")
    low, high = (plan * (F.lit(1.0) + F.col(c)) for c in errors)
    return months.select(
        *keys, "month", F.bround("base", 0).alias("base"), F.bround(plan, 0).alias("base_with_uplift"),
        F.bround(low, 0).alias("low_p10"), F.bround(high, 0).alias("high_p90"),
    )
