"""Settings of crawling, extraction and planning."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Settings:
    """Fixed defaults; every one can be replaced by with_()."""

    min_delay: float = 2.0
    request_timeout: int = 20
    respect_robots: bool = True
    cap_per_group: int = 30
    cap_per_domain: int = 80
    cap_pages_run: int = 300
    cap_paginate: int = 3
    allow_external: bool = False
    max_cycles: int = 4
    max_steps_per_plan: int = 6
    fast_path_pages: int = 8
    budget_tokens: int = 400_000
    budget_fetches: int = 400
    budget_renders: int = 400
    render_breaker: bool = True
    render_breaker_min: int = 10
    render_breaker_ratio: float = 0.7
    max_age_days: float = 7.0
    samples_per_group: int = 5
    singles_cap: int = 40
    group_min: int = 4
    synth_html_cap: int = 45_000
    extract_text_cap: int = 9_000
    outlines_per_plan: int = 4
    mode: str = "auto"

    def with_(self, **changes) -> Settings:
        return replace(self, **changes)
