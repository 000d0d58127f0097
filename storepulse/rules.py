"""Business rules shared by every operator.

One frozen object carries all thresholds, so that no operator hides a constant
and two runs with different rules can live in one session.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from decimal import Decimal


@dataclass(frozen=True)
class Rules:
    # The published defaults of the analysis; override per run.
    first_month: dt.date = dt.date(2016, 9, 1)
    analysis_end: dt.date = dt.date(2018, 8, 19)
    window_end_exclusive: bool = False
    non_revenue_statuses: tuple[str, ...] = ("canceled", "unavailable")
    order_statuses: tuple[str, ...] = (
        "delivered", "shipped", "canceled", "unavailable",
        "invoiced", "processing", "created", "approved",
    )
    lifecycle_statuses: tuple[str, ...] = ("active", "churned", "never_sold")
    churn_days: int = 60
    retained_months: int = 3

    payment_tolerance: Decimal = Decimal("1.00")
    recon_warn_pct: float = 2.0
    daily_tolerance: float = 0.01
    volume_lookback: int = 28
    volume_min_median: float = 20.0
    volume_ratio: float = 0.3
    volume_report_since: dt.date = dt.date(2018, 6, 1)

    week_start_from: dt.date = dt.date(2017, 1, 2)
    horizon: int = 4
    folds: int = 10
    fold_step: int = 2
    forecast_weeks: int = 15
    residual_window: int = 26
    z80: float = 1.2816
    interval_probs: tuple[float, float] = (0.1, 0.9)

    maturity_days: int = 120
    z95: float = 1.96
    min_segment_won: int = 15
    min_origin_leads: int = 50
    hist_clip: float = 200.0
    hist_bins: int = 40

    customer_cohort_min: int = 500
    seller_cohort_min: int = 40
    repurchase_days: int = 180
    churn_from: dt.date = dt.date(2017, 3, 1)
    churn_until: dt.date | None = None
    size_bands: tuple[tuple[str, float], ...] = field(
        default=(("1-2 orders", 2), ("3-10", 10), ("11-50", 50), ("50+", 1e9))
    )

    @property
    def end_month(self) -> dt.date:
        return self.analysis_end.replace(day=1)

    @property
    def cohort_ages(self) -> range:
        """Every age a cohort can have: months from the first month of data to the end month."""
        months = (self.end_month.year - self.first_month.year) * 12 + self.end_month.month - self.first_month.month
        return range(months + 1)

    @property
    def last_full_month(self) -> dt.date:
        """Latest month that lies wholly inside the analysis window."""
        if self.churn_until is not None:
            return self.churn_until
        next_day = self.analysis_end + dt.timedelta(days=1)
        if next_day.day == 1:
            return self.end_month
        return (self.end_month - dt.timedelta(days=1)).replace(day=1)

    @property
    def window_limit(self) -> dt.datetime:
        """Midnight that closes the analysis window."""
        return dt.datetime.combine(self.analysis_end, dt.time()) + dt.timedelta(days=1)

    @property
    def end_timestamp(self) -> dt.datetime:
        return dt.datetime.combine(self.analysis_end, dt.time())

    def days_before_end(self, days: int) -> dt.date:
        return self.analysis_end - dt.timedelta(days=days)
