"""Frozen scalars of the analyses, as parameters."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class Params:
    """Dates, windows and thresholds; every operator takes what it needs from here."""

    as_of: date = date(2026, 9, 21)
    train_cutoff: date = date(2024, 9, 30)
    horizon_days: int = 365
    dormancy_months: int = 24
    coterm_window_days: int = 90
    coverage_window_days: int = 365
    renewal_lookahead_days: int = 365
    shift_window_days: int = 730
    shift_delta: float = 0.30
    adoption_floor: float = 0.40
    session_gap_days: int = 45
    hot_share: float = 0.02
    seed: int = 20260921
    #: day counts of a month and a year in recency figures
    month_days: float = 30.4375
    year_days: float = 365.25


DEFAULT = Params()
