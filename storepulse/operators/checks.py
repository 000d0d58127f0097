"""Data tests. Each `check_*` returns violating rows, so an empty result means a pass."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storepulse.operators.marts import window_revenue
from storepulse.operators.quality import reconciliation_issue
from storepulse.rules import Rules


def check_unique(df: DataFrame, column: str) -> DataFrame:
    """Non-NULL values that occur more than once."""
    return (
        df.filter(F.col(column).isNotNull()).groupBy(column)
        .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    )


def check_not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def check_accepted_values(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    """Values outside the list, with their row counts."""
    return (
        df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values)).groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def check_relationships(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose non-NULL key has no parent; returns the key, once per row."""
    keys = child.filter(F.col(column).isNotNull()).select(F.col(column).alias("_key"))
    known = parent.select(F.col(parent_column).alias("_key"))
    return keys.join(known, "_key", "left_anti").withColumnRenamed("_key", column)


def check_unique_combination(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key tuples that occur more than once; NULLs form a group of their own."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def check_daily_reconciles(daily: DataFrame, orders_fact: DataFrame, r: Rules) -> DataFrame:
    """One row when the daily series and the order fact have different totals."""
    missing = F.lit(None).cast("double")
    amount = F.col("gross_revenue").cast("decimal(38,2)")
    totals = daily.agg(F.sum(amount).cast("double").alias("daily_total")).withColumn("fact_total", missing)
    fact = window_revenue(orders_fact).agg(F.sum(amount).cast("double").alias("fact_total"))
    totals = totals.unionByName(fact.withColumn("daily_total", missing))
    both = totals.agg(F.max("daily_total").alias("daily_total"), F.max("fact_total").alias("fact_total"))
    return both.filter(F.abs(F.col("daily_total") - F.col("fact_total")) > r.daily_tolerance)


def check_funnel_monotonic(funnel: DataFrame) -> DataFrame:
    """Leads that reached a stage without the one before it."""
    skipped = (F.col("is_activated") & ~F.col("is_won")) | (F.col("is_retained") & ~F.col("is_activated"))
    return funnel.filter(skipped).select("mql_id")


def check_payment_recon_rate(orders_fact: DataFrame, r: Rules) -> DataFrame:
    """One row with the share of unreconciled revenue orders when it exceeds the limit."""
    share = orders_fact.filter("is_revenue_order").agg(
        F.try_divide(F.lit(100.0) * F.count(reconciliation_issue(r)), F.count(F.lit(1))).alias("pct")
    )
    return share.filter(F.col("pct") > r.recon_warn_pct).select(F.round("pct", 2).alias("pct_unreconciled"))


@dataclass(frozen=True)
class Check:
    """A named check. `violations` maps the tables to violating rows."""

    name: str
    violations: Callable[[Mapping[str, DataFrame]], DataFrame]
    severity: str = "error"


@dataclass(frozen=True)
class Key:
    """A column that must be unique and never NULL."""

    table: str
    column: str


@dataclass(frozen=True)
class Required:
    """Columns that must never be NULL."""

    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Accepted:
    """A column whose values must be in a list; each other value is a failure."""

    table: str
    column: str
    values: tuple[object, ...]


@dataclass(frozen=True)
class References:
    """A column whose values must be keys of a parent; each row without one is a failure."""

    table: str
    column: str
    parent: str
    parent_column: str
    severity: str = "error"


@dataclass(frozen=True)
class UniqueTogether:
    """Columns whose tuples must be unique; NULLs form a group of their own."""

    table: str
    columns: tuple[str, ...]


Spec = Check | Key | Required | Accepted | References | UniqueTogether


@dataclass(frozen=True)
class Profile:
    """A smaller frame that answers some tests of a table: one row per value of `column`, with
    the number of the table's `rows` and, per column in `nulls`, how many of them are NULL."""

    frame: DataFrame
    column: str
    rows: str
    nulls: Mapping[str, str]


@dataclass(frozen=True)
class _Test:
    """One line of the report: what is marked, and how the marks of a key count as failures."""

    name: str
    failures: str
    severity: str = "error"


# How many failures a key with n rows and p parents means.
_FAILURES = {
    "repeated": "if(n > 1, 1, 0)",
    "rows": "n",
    "values": "if(n > 0, 1, 0)",
    "orphans": "if(p = 0, n, 0)",
}


def _outcome(name: Column, severity: str, failures: Column) -> list[Column]:
    bad = "warn" if severity == "warn" else "fail"
    return [
        name.alias("check"),
        F.lit(severity).alias("severity"),
        failures.cast("bigint").alias("failures"),
        F.when(failures > 0, bad).otherwise("pass").alias("status"),
    ]


def _check_outcome(spec: Check, tables: Mapping[str, DataFrame]) -> DataFrame:
    count = spec.violations(tables).agg(F.count(F.lit(1)).alias("n"))
    return count.select(*_outcome(F.lit(spec.name), spec.severity, F.col("n")))


def _text(*columns: str) -> Column:
    """A value or tuple as text that is equal only for equal tuples; NULL is told from any text."""
    parts = [F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-"))
             for v in (F.col(c).cast("string") for c in columns)]
    return F.col(columns[0]).cast("string") if len(columns) == 1 else F.concat(*parts)


class _Plan:
    """Tests and, per table, the marks that its rows leave for them."""

    def __init__(self, profiles: Mapping[str, Sequence[Profile]]):
        self.tests: list[_Test] = []
        self.marks: dict[str, list[Column]] = {}
        self.profile_marks: list[tuple[Profile, Column]] = []
        self.profiles = profiles

    def _test(self, name: str, failures: str, severity: str = "error") -> int:
        self.tests.append(_Test(name, failures, severity))
        return len(self.tests) - 1

    @staticmethod
    def _mark(test: int, key: Column, when: Column, n: Column | int = 1, p: int = 0) -> Column:
        count = F.lit(n) if isinstance(n, int) else n
        return F.when(when, F.struct(
            F.lit(test).alias("test"), key.alias("key"), count.cast("bigint").alias("n"), F.lit(p).cast("bigint").alias("p")))

    def _leave(self, table: str, mark: Column) -> None:
        self.marks.setdefault(table, []).append(mark)

    def not_null(self, table: str, column: str) -> None:
        test = self._test(f"{table}.{column}:not_null", "rows")
        for profile in self.profiles.get(table, ()):
            if column in profile.nulls:
                n = F.col(profile.nulls[column])
                self.profile_marks.append((profile, self._mark(test, F.lit(""), n > 0, n)))
                return
        self._leave(table, self._mark(test, F.lit(""), F.col(column).isNull()))

    def add(self, spec: Spec) -> None:
        if isinstance(spec, Key):
            test = self._test(f"{spec.table}.{spec.column}:unique", "repeated")
            self._leave(spec.table, self._mark(test, _text(spec.column), F.col(spec.column).isNotNull()))
            self.not_null(spec.table, spec.column)
        elif isinstance(spec, Required):
            for column in spec.columns:
                self.not_null(spec.table, column)
        elif isinstance(spec, Accepted):
            test, value = self._test(f"{spec.table}.{spec.column}:accepted_values", "values"), F.col(spec.column)
            self._leave(spec.table, self._mark(test, _text(spec.column), value.isNotNull() & ~value.isin(*spec.values)))
        elif isinstance(spec, UniqueTogether):
            test = self._test(f"{spec.table}:unique_combination", "repeated")
            self._leave(spec.table, self._mark(test, _text(*spec.columns), F.lit(True)))
        elif isinstance(spec, References):
            test = self._test(f"{spec.table}.{spec.column}:relationships", "orphans", spec.severity)
            key, known = _text(spec.column), F.col(spec.column).isNotNull()
            self._leave(spec.parent, self._mark(test, _text(spec.parent_column), F.col(spec.parent_column).isNotNull(), 0, 1))
            for profile in self.profiles.get(spec.table, ()):
                if profile.column == spec.column:
                    self.profile_marks.append((profile, self._mark(test, key, known, F.col(profile.rows))))
                    return
            self._leave(spec.table, self._mark(test, key, known))
        else:
            raise TypeError(f"unknown check {spec!r}")

    def outcome(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        """One scan per table or profile, one shuffle by (test, key) for all of them."""
        sources = [(tables[name], marks) for name, marks in self.marks.items()]
        for profile in {id(p): p for p, _ in self.profile_marks}.values():
            sources.append((profile.frame, [m for p, m in self.profile_marks if p is profile]))
        left = [df.select(F.inline(F.array_compact(F.array(*marks)))) for df, marks in sources]
        keys = reduce(DataFrame.unionByName, left).groupBy("test", "key").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
        failures = F.lit(0).cast("bigint")
        for kind, rule in _FAILURES.items():
            places = [i for i, t in enumerate(self.tests) if t.failures == kind]
            if places:
                failures = F.when(F.col("test").isin(*places), F.expr(rule)).otherwise(failures)
        found = keys.groupBy("test").agg(F.sum(failures).alias("failures"))
        spark = found.sparkSession
        lines = spark.createDataFrame(
            [(i, t.name, t.severity) for i, t in enumerate(self.tests)], "test int, check string, severity string")
        count = F.coalesce("failures", F.lit(0).cast("bigint"))
        bad = F.when(F.col("severity") == "warn", "warn").otherwise("fail")
        return lines.join(found, "test", "left").select(
            "check", "severity", count.alias("failures"), F.when(count > 0, bad).otherwise("pass").alias("status"))


def run_checks(
    tables: Mapping[str, DataFrame], specs: Sequence[Spec], profiles: Mapping[str, Sequence[Profile]] | None = None
) -> DataFrame:
    """One row per check: (check, severity, failures, status).

    Tests on keys, values and NULLs are planned together: a row of a table leaves one mark for
    each test that it bears on (for NULLs and lists only when it fails), all marks of all
    tables meet in one shuffle by (test, key), and marks are added up before it. A table is
    scanned once for all its tests, and not at all for those that one of its `profiles`
    answers. Checks given as functions are counted on their own.
    """
    plan, parts = _Plan(profiles or {}), []
    for spec in specs:
        if isinstance(spec, Check):
            parts.append(_check_outcome(spec, tables))
        else:
            plan.add(spec)
    if plan.tests:
        parts.insert(0, plan.outcome(tables))
    return reduce(DataFrame.unionByName, parts)


def standard_checks(r: Rules) -> list[Spec]:
    """The checks declared for the staging and mart tables."""
    return [
        Key("stg_orders", "order_id"),
        Key("stg_customers", "customer_id"),
        Key("stg_sellers", "seller_id"),
        Key("stg_leads", "mql_id"),
        Key("stg_closed_deals", "mql_id"),
        Key("fct_orders", "order_id"),
        Key("fct_daily_revenue", "order_date"),
        Key("dim_customers", "customer_unique_id"),
        Key("dim_sellers", "seller_id"),
        Key("fct_lead_funnel", "mql_id"),
        Required("stg_customers", ("customer_unique_id",)),
        Required("stg_order_items", ("item_price",)),
        Accepted("stg_orders", "order_status", r.order_statuses),
        Accepted("dim_sellers", "lifecycle_status", r.lifecycle_statuses),
        References("stg_order_items", "order_id", "stg_orders", "order_id"),
        References("stg_closed_deals", "mql_id", "stg_leads", "mql_id"),
        UniqueTogether("fct_seller_monthly", ("seller_id", "month")),
        Check("daily_revenue_matches_orders",
              lambda t: check_daily_reconciles(t["fct_daily_revenue"], t["fct_orders"], r)),
        Check("funnel_stages_are_monotonic", lambda t: check_funnel_monotonic(t["fct_lead_funnel"])),
        Check("payment_reconciliation_rate",
              lambda t: check_payment_recon_rate(t["fct_orders"], r),
              severity="warn"),
    ]
