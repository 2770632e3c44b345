"""Run parameters. Defaults are the fixed values every published result is defined with."""

from __future__ import annotations

from dataclasses import dataclass, field
from statistics import NormalDist


@dataclass(frozen=True)
class Method:
    """One forecasting method: reweighted history ("history") or delta-normal ("normal")."""

    name: str
    label: str
    kind: str
    decay: float | None = None


@dataclass(frozen=True)
class Shock:
    """Selectors are ANDed, absent ones match everything; exactly one of pct / pp is given."""

    asset_class: str | None = None
    desk: str | None = None
    ids: tuple[str, ...] | None = None
    pct: float | None = None
    pp: float | None = None


@dataclass(frozen=True)
class Scenario:
    """A hypothetical scenario: named shocks that add up in log space (or points, for yields)."""

    id: str
    name: str
    short: str
    shocks: tuple[Shock, ...]


@dataclass(frozen=True)
class PastWindow:
    """A historical stress window; it ends on a date or a number of market days after its start."""

    id: str
    name: str
    short: str
    start: str
    end: str | None = None
    market_days: int | None = None


# Method names, display labels, decays.
METHODS = (
    Method("hs_equal", "Historical simulation, equal weights", "history", None),
    Method("hs_weighted", "Historical simulation, age-weighted", "history", 0.995),
    Method("parametric", "Parametric (delta-normal, EWMA)", "normal", 0.94),
)


@dataclass(frozen=True)
class RiskRules:
    """Fixed values of the risk run."""

    window_days: int = 1260
    confidence: tuple[float, ...] = (0.95, 0.99)
    es_confidence: float = 0.975
    market_day_min_share: float = 0.5
    ffill_limit: int = 5
    base_currency: str = "GBP"
    methods: tuple[Method, ...] = METHODS
    primary: str = "hs_equal"
    traffic_light_days: int = 250
    backtest_start: str | None = None  # first tested date; None tests every day that has a forecast
    bump: float = 1e-4
    concentration_share: float = 0.10
    var_move_share: float = 0.10
    independence_p: float = 0.05

    def method(self, name: str) -> Method:
        return next(m for m in self.methods if m.name == name)


@dataclass(frozen=True)
class ControlRules:
    """Fixed values of the data-quality controls."""

    warn_after_bdays: int = 1
    fail_after_bdays: int = 3
    ewma_lambda: float = 0.94
    z_threshold: float = 6.0
    min_history: int = 60
    min_observations: int = 750
    window_years: int = 5
    cross_source_pct: float = 0.75
    revision_pct: float = 0.1
    revision_grace_bdays: int = 5
    yield_range: tuple[float, float] = (-2.0, 25.0)
    reconciliation_tolerance: float = 1e-6
    sla_deadline: str = "07:30"
    finished_at: str = "07:05"  # local time at which a run counts as done when it is not told
    sla_zone: str = "Europe/London"
    gap_lookback_bdays: int = 20
    gap_min_peers: int = 3
    gap_peer_share: float = 0.75
    roll_threshold_pct: float = 2.0
    dividend_tolerance_bp: float = 1.0


@dataclass(frozen=True)
class StudyRules:
    """Fixed values of the disclosure and volatility study."""

    categories: tuple[str, ...] = ("interest_rates", "equity_prices", "currency_rates", "commodity_prices")
    absolute_moves: tuple[str, ...] = ("interest_rates",)
    windows: tuple[tuple[str, int], ...] = (("1y", 250), ("2y", 500), ("5y", 1260))
    min_share: float = 0.9
    min_quarters: int = 8
    correlation_rows: int = 250
    correlation_min_rows: int = 225
    interval_z: float = 1.96


@dataclass(frozen=True)
class RunConfig:
    risk: RiskRules = field(default_factory=RiskRules)
    controls: ControlRules = field(default_factory=ControlRules)
    study: StudyRules = field(default_factory=StudyRules)
    fx_map: tuple[tuple[str, str], ...] = (("USD", "USD"), ("EUR", "EUR"), ("JPY", "JPY"))
    past_windows: tuple[PastWindow, ...] = ()
    scenarios: tuple[Scenario, ...] = ()


def measure_name(kind: str, level: float) -> str:
    """VaR95, VaR99, ES975."""
    return f"VaR{round(level * 100)}" if kind == "VaR" else f"ES{round(level * 1000)}"


def normal_quantile(level: float) -> float:
    return NormalDist().inv_cdf(level)


def normal_density(x: float) -> float:
    return NormalDist().pdf(x)
