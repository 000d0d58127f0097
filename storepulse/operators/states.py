"""Measures from partial states: many slicers, and totals, from one scan of a fact.

A state table holds one row per combination of slicers (its grain) with parts that can be
merged: sums and counts, and for distinct counts and quantiles either all values with their
numbers (exact, the default) or sketches (`approximate`: HyperLogLog for distinct counts, KLL
for quantiles). Any grouping of the slicers is then a merge of state rows, and ratios are
taken after it. State tables can be kept per month or day and merged whenever a slicer asks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storepulse.functions.stats import ratio

# Sketch sizes: relative error of a distinct count about 1.6 % (one standard deviation), error of a
# quantile's rank about 1.3 %.
LG_K = 12
KLL_K = 200


@dataclass(frozen=True)
class Part:
    """A mergeable part of a measure: the sum or count of an expression, its distinct values, or
    the numbers whose quantile is asked for."""

    kind: str
    value: Callable[[], Column]
    p: float = 0.5

    @property
    def wide(self) -> bool:
        return self.kind in ("distinct", "quantile")


@dataclass(frozen=True)
class Measure:
    """Table, parts, and the result from the merged parts."""

    table: str
    parts: Mapping[str, Part]
    result: Callable[[Mapping[str, Column]], Column]


def _single(table: str, name: str, part: Part) -> Measure:
    return Measure(table, {name: part}, lambda m: m[name])


_REVENUE = Part("sum", lambda: F.when(F.col("is_revenue_order"), F.col("gross_revenue")))
# Order ids are unique in the order fact, persons in their dimension: counting rows counts them.
_ORDERS = Part("count", lambda: F.when(F.col("is_revenue_order"), F.col("order_id")))
_LEADS = Part("count", lambda: F.lit(1))
_WON = Part("count", lambda: F.when(F.col("is_won"), 1))
_ACTIVATED = Part("count", lambda: F.when(F.col("is_activated"), 1))
_PEOPLE = Part("count", lambda: F.col("customer_unique_id"))
_REPEAT = Part("count", lambda: F.when(F.col("is_repeat_customer"), F.col("customer_unique_id")))

STATE_MEASURES: dict[str, Measure] = {
    "gross_revenue": Measure("fct_orders", {"revenue": _REVENUE}, lambda m: m["revenue"].cast("double")),
    "revenue_orders": _single("fct_orders", "orders", _ORDERS),
    "average_order_value": Measure(
        "fct_orders", {"revenue": _REVENUE, "orders": _ORDERS}, lambda m: ratio(m["revenue"].cast("double"), m["orders"])),
    "buyers": _single("fct_orders", "buyer", Part(
        "distinct", lambda: F.when(F.col("is_revenue_order"), F.col("customer_unique_id")))),
    "median_order_value": _single("fct_orders", "order_value", Part(
        "quantile", lambda: F.when(F.col("is_revenue_order"), F.col("gross_revenue").cast("double")))),
    "mqls": _single("fct_lead_funnel", "leads", _LEADS),
    "won_deals": _single("fct_lead_funnel", "won", _WON),
    "activated_sellers": _single("fct_lead_funnel", "activated", _ACTIVATED),
    "lead_to_win_rate": Measure("fct_lead_funnel", {"leads": _LEADS, "won": _WON}, lambda m: ratio(m["won"], m["leads"])),
    "win_to_activation_rate": Measure(
        "fct_lead_funnel", {"won": _WON, "activated": _ACTIVATED}, lambda m: ratio(m["activated"], m["won"])),
    "median_days_to_close": _single("fct_lead_funnel", "days", Part("quantile", lambda: F.col("days_to_close").cast("double"))),
    "customers": _single("dim_customers", "people", _PEOPLE),
    "repeat_customer_rate": Measure(
        "dim_customers", {"people": _PEOPLE, "repeat": _REPEAT}, lambda m: ratio(m["repeat"], m["people"])),
    "active_sellers": _single("fct_seller_monthly", "seller", Part(
        "distinct", lambda: F.when(F.col("is_active"), F.col("seller_id")))),
}


def _parts(names: Sequence[str]) -> tuple[str, dict[str, Part]]:
    unknown = [n for n in names if n not in STATE_MEASURES]
    if unknown:
        raise ValueError(f"unknown measure {unknown}")
    tables = {STATE_MEASURES[n].table for n in names}
    if len(tables) != 1:
        raise ValueError(f"measures of one call must share a table, got {sorted(tables)}")
    return tables.pop(), {part: how for n in names for part, how in STATE_MEASURES[n].parts.items()}


def measure_states(
    names: Sequence[str], tables: Mapping[str, DataFrame], grain: Sequence[str], approximate: bool = False,
    where: Column | str | None = None,
) -> DataFrame:
    """One scan of the fact: a row per combination of the `grain` columns with the parts of the measures.

    Exact distinct counts and quantiles make the grain finer by their values; with
    `approximate` they are sketches of a fixed size instead.
    """
    table, parts = _parts(names)
    df = tables[table] if where is None else tables[table].filter(where)
    keys = [F.col(c) for c in grain]
    aggregates = []
    for name, part in parts.items():
        value = part.value()
        if part.kind == "sum":
            aggregates.append(F.sum(value).alias(f"s_{name}"))
        elif part.kind == "count":
            aggregates.append(F.count(value).alias(f"s_{name}"))
        elif approximate:
            sketch = F.hll_sketch_agg(value, LG_K) if part.kind == "distinct" else F.kll_sketch_agg_double(value, KLL_K)
            aggregates.append(sketch.alias(f"s_{name}"))
        else:
            keys.append(value.alias(f"v_{name}"))
            aggregates.append(F.count(value).alias(f"s_{name}"))
    return df.groupBy(*keys).agg(*aggregates)


def _merged(name: str, part: Part, exact: bool) -> Column:
    state = F.col(f"s_{name}")
    if part.kind in ("sum", "count"):
        return F.sum(state)
    if part.kind == "distinct":
        if exact:
            return F.countDistinct(F.col(f"v_{name}"))
        return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(state)), F.lit(0).cast("bigint"))
    if exact:
        # Values that are NULL have the count 0 and do not weigh.
        return F.percentile(F.col(f"v_{name}"), part.p, F.when(F.col(f"v_{name}").isNull(), F.lit(0)).otherwise(state))
    merged = F.kll_merge_agg_double(state, KLL_K)
    return F.when(F.kll_sketch_get_n_double(merged) > 0, F.kll_sketch_get_quantile_double(merged, F.lit(part.p)))


def from_states(
    states: DataFrame, names: Sequence[str], grains: Sequence[Sequence[str]], approximate: bool = False
) -> DataFrame:
    """Measures for several groupings at once, all from one scan of the state table.

    One row per group of each list in `grains` (the empty list is the total). `grain` names
    the columns that a row is grouped by; the other slicers are NULL in it.
    """
    _, parts = _parts(names)
    columns = list(dict.fromkeys(c for g in grains for c in g))
    merged = {name: _merged(name, part, not approximate) for name, part in parts.items()}
    results = [STATE_MEASURES[n].result(merged).alias(n) for n in names]
    if not columns:
        return states.agg(*results).select(F.lit("").alias("grain"), *names)
    named = F.concat_ws("+", *(F.when(F.grouping(c) == 0, F.lit(c)) for c in columns)).alias("grain")
    grouped = states.groupingSets([[F.col(c) for c in g] for g in grains], *(F.col(c) for c in columns))
    return grouped.agg(named, *results).select("grain", *columns, *names)


def measures_by_grains(
    names: Sequence[str], tables: Mapping[str, DataFrame], grains: Sequence[Sequence[str]], approximate: bool = False,
    where: Column | str | None = None,
) -> DataFrame:
    """Several measures at several groupings, with totals, from one scan of the fact."""
    columns = list(dict.fromkeys(c for g in grains for c in g))
    return from_states(measure_states(names, tables, columns, approximate, where), names, grains, approximate)
