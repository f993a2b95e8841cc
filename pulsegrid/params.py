"""Parameters of the operators as frozen dataclasses; every default can be replaced."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Automation:
    day_views_min: int = 500
    mobile_share_max: float = 0.05
    flat_hourly_mean_min: float = 200.0
    flat_cv_max: float = 0.15

    @property
    def floor(self) -> float:
        """Day views below which neither rule can hold."""
        return min(self.day_views_min, 24 * self.flat_hourly_mean_min)


@dataclass(frozen=True)
class Baseline:
    lookback_days: int = 28
    min_observations: int = 7
    prior_min_days_seen: int = 7
    prior_sample_mod: int = 1


@dataclass(frozen=True)
class Spike:
    r1_ratio: float = 5.0
    r2_ratio: float = 3.0
    min_views: int = 100
    r3_threshold: float = 8.0
    r3_candidate: float = 6.0
    mad_scale: float = 1.4826


@dataclass(frozen=True)
class Events:
    min_languages: int = 3
    window_hours: int = 6
    breadth_hours: int = 24
    new_event_gap_hours: int = 24
    r3_threshold: float = 8.0
    single_language_share: float = 0.95
    tiers: tuple[tuple[int, str], ...] = ((20, "planetary"), (5, "international"), (2, "noticed"))


@dataclass(frozen=True)
class Bursts:
    min_edits: int = 5
    min_editors: int = 3
    window_minutes: int = 30
    ratio: float = 8.0
    new_page_minutes: int = 60
    new_page_edits: int = 5
    new_page_editors: int = 2
    cooldown_hours: int = 6
    group_minutes: int = 120
    baseline_hours: int = 168
    baseline_min_hours: int = 24
