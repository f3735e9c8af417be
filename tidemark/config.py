"""Review parameters in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: (metric, operator, threshold): the gate is off when the metric meets the condition or is missing.
# Conventional limits.
GATE_RULES = (
    ("psi_score", ">", 0.25),
    ("rolling_sharpe", "<", 0.0),
    ("auc_1w", "<", 0.50),
    ("active_drawdown", "<", -0.15),
)


@dataclass(frozen=True)
class ReviewConfig:
    benchmark: str = "SPY"
    start: str = "2015-01-02"
    end: str = "2026-08-28"
    oot_start: str = "2022-01-03"
    universe_size: int = 3000
    universe_asof: str = "2026-09-15"
    exchanges: tuple[str, ...] = ("NMS", "NYQ", "NGM", "NCM", "ASE")
    top_n: int = 50
    cost_bps: float = 10.0
    min_price: float = 5.0
    min_adv: float = 5_000_000.0
    mom_lookback: int = 252
    mom_skip: int = 21
    gbm_days: int = 730
    gbm_min_obs: int = 454
    gbm_steps: int = 63
    gbm_years: float = 0.25
    sessions_per_year: int = 252
    weekly_lookbacks: tuple[int, ...] = (63, 126, 252)
    weekly_horizon: int = 5
    mature_sessions: int = 65
    monitor_window: int = 52
    monitor_lag: int = 2
    dev_weeks: int = 104
    psi_buckets: int = 10
    bootstrap_n: int = 5000
    bootstrap_block: int = 13
    n_perm: int = 500
    n_trials: int = 17
    weeks_per_year: int = 52
    seed: int = 42
    rules: tuple[tuple[str, str, float], ...] = field(default=GATE_RULES)

    def with_(self, **changes) -> ReviewConfig:
        return replace(self, **changes)


#: For the star-schema fixture: its dates, price level and small draws.
FIXTURE = ReviewConfig(
    start="1995-02-06", end="2001-08-31", oot_start="1998-01-05", top_n=5, min_price=1500.0, min_adv=3000.0,
    bootstrap_n=200, n_perm=50, universe_size=100, universe_asof="2001-08-31",
)
