"""The daily run: stored stage tables and one lazily planned frame per result on top of them.

Each stage (quotes, market data, calendar, value moves, book, ...) is written once as Parquet in the
run's store, on storage all executors share, and read back. That cuts the lineage at every stage: a
lost executor repeats at most one stage, plans stay small, and the optimizer sees real table sizes, so
it broadcasts a side only when its stored size is below the session's threshold.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.config import PastWindow, RunConfig, Scenario, Shock
from tidemark.functions import dates as D
from tidemark.functions.stats import whole_sum
from tidemark.operators import backtest as B
from tidemark.operators import controls as C
from tidemark.operators import explain as E
from tidemark.operators import panel, positions, pricing, returns, risk, stress
from tidemark.plans import warehouse as wh
from tidemark.plans.stages import StagedRun, stage
from tidemark.sources import tables

# Scenarios placed inside the quote history of the order tables (1995-2001).
PAST_WINDOWS = (
    PastWindow("before_history", "Window before the loaded history", "Before history", "1990-03-01", market_days=20),
    PastWindow("autumn_1998", "Autumn sell-off, 1998", "Autumn 1998", "1998-08-14", market_days=20),
    PastWindow("spring_2000", "Spring reversal, 2000", "Spring 2000", "2000-03-10", end="2000-04-14"),
    PastWindow("late_2001", "Last weeks of the history", "Late 2001", "2001-10-06", end="2002-03-29"),
)
SCENARIOS = (
    Scenario("curve_falls", "Every yield falls by 40 basis points", "Yields 40bp lower", (Shock(asset_class="rates", pp=-0.4),)),
    Scenario("supply_squeeze", "Commodities gain 30% while long yields rise by 25 basis points", "Supply squeeze", (
        Shock(asset_class="commodity", pct=30.0), Shock(ids=("Brand#17", "Brand#20"), pp=0.25))),
    Scenario("overseas_slump", "Equities abroad lose 22%, foreign currencies gain 3%", "Slump abroad", (
        Shock(desk="US Equities", pct=-22.0), Shock(asset_class="fx", pct=3.0))),
    Scenario("one_name", "A single equity loses half of its value", "One name halves", (Shock(ids=("Brand#11",), pct=-50.0),)),
)
ORDER_CONFIG = RunConfig(
    fx_map=(("USD", "Brand#21"), ("EUR", "Brand#22"), ("JPY", "Brand#23")),
    past_windows=PAST_WINDOWS, scenarios=SCENARIOS)


class DailyRun(StagedRun):
    """All tables of one run date over one set of order tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, cfg: RunConfig = ORDER_CONFIG, as_of: str | None = None,
                 store: str | None = None, finished: dt.datetime | None = None):
        super().__init__(spark, "daily-run", store)
        self.sf_dir, self.cfg, self._as_of, self._finished = sf_dir, cfg, as_of, finished

    # --- stored tables ---------------------------------------------------------------------------

    @stage()
    def instruments(self) -> DataFrame:
        return wh.instruments(self.spark, self.sf_dir)

    @stage()
    def kinds(self) -> DataFrame:
        return wh.daily_kinds(self.spark, self.sf_dir)

    @stage("kinds")
    def marks(self) -> DataFrame:
        return wh.daily_marks(self.kinds)

    @cached_property
    def raw(self) -> DataFrame:
        return wh.raw_quotes(self.marks, self.instruments)

    @stage("marks", "instruments")
    def market(self) -> DataFrame:
        mapped = tables.map_series(self.raw, self.instruments)
        return tables.keep_last(mapped, ["instrument_id", "date"]).drop("load_seq")

    @cached_property
    def cross_checks(self) -> DataFrame:
        return wh.cross_checks(self.instruments)

    @stage("marks", "instruments")
    def references(self) -> DataFrame:
        uses = tables.reference_map(self.instruments, self.cross_checks, "px")
        mapped = tables.map_references(wh.second_sources(self.marks, self.instruments), uses)
        return tables.keep_last(mapped, ["instrument_id", "purpose", "date"]).drop("load_seq")

    @stage("marks", "instruments")
    def dividends(self) -> DataFrame:
        mapped = tables.map_dividends(self.raw, self.instruments)
        return tables.keep_last(mapped, ["instrument_id", "ex_date"]).drop("load_seq")

    @cached_property
    def trades(self) -> DataFrame:
        return wh.trades(self.marks)

    @cached_property
    def lineage(self) -> DataFrame:
        return wh.lineage(self.marks)

    # --- run date and calendar -------------------------------------------------------------------

    @stage("market", "instruments")
    def all_days(self) -> DataFrame:
        return panel.market_days(self.market, self.instruments, F.lit("9999-12-31").cast("date"),
                                 self.cfg.risk.market_day_min_share)

    @cached_property
    def _last_two(self) -> list:
        days = self.all_days if self._as_of is None else self.all_days.filter(F.col("date") <= self._as_of)
        rows = days.orderBy(F.col("ord").desc()).limit(2).collect()
        if not rows or (self._as_of and rows[0]["date"] != dt.date.fromisoformat(self._as_of)):
            raise ValueError(f"{self._as_of or 'the run date'} is not a market day in the data")
        return rows

    @cached_property
    def as_of(self) -> dt.date:
        return self._last_two[0]["date"]

    @cached_property
    def previous(self) -> dt.date:
        return self._last_two[1]["date"]

    @cached_property
    def k(self) -> int:
        return self._last_two[0]["ord"]

    @property
    def _as_of_col(self):
        return F.lit(self.as_of)

    @property
    def days(self) -> DataFrame:
        """Market days up to the run date."""
        return self.all_days.filter(F.col("date") <= self._as_of_col)

    @stage("market", "all_days")
    def filled(self) -> DataFrame:
        return panel.filled_levels(self.market, self._as_of_col, self.cfg.risk.ffill_limit)

    @cached_property
    def levels(self) -> DataFrame:
        return panel.on_market_days(self.filled, self.days)

    def _returns(self, stress_series: bool) -> DataFrame:
        series = returns.driving_series(self.levels, self.references, self.instruments, self.days, self._as_of_col,
                                        self.cfg.risk.ffill_limit, stress_series)
        return returns.factor_returns(series, self.dividends)

    @stage("filled", "references", "dividends", "instruments")
    def factor_moves(self) -> DataFrame:
        """Factor returns; stored because attaching the FX factor reads them twice."""
        return self._returns(stress_series=False)

    @stage("filled", "references", "dividends", "instruments")
    def stress_moves(self) -> DataFrame:
        """Factor returns with stress proxies taking precedence."""
        return self._returns(stress_series=True)

    @stage("factor_moves", "instruments")
    def moves(self) -> DataFrame:
        return pricing.value_moves(self.factor_moves, self.attributes, self.cfg.risk.bump)

    @stage("moves")
    def calendar(self) -> DataFrame:
        return returns.completeness(self.days, self.moves, self.instruments)

    # --- valuation -------------------------------------------------------------------------------

    @cached_property
    def attributes(self) -> DataFrame:
        return pricing.priced_as(self.instruments, self.cfg)

    @stage("filled", "instruments")
    def values(self) -> DataFrame:
        """Unit values on market days."""
        return pricing.unit_values(self.levels, self.attributes, ["ord", "date"])

    @stage("filled", "instruments")
    def daily_values(self) -> DataFrame:
        """Unit values on every weekday."""
        return pricing.unit_values(self.filled, self.attributes, ["date"])

    @stage("marks", "all_days")
    def positions(self) -> DataFrame:
        return positions.positions_from_trades(self.trades, self._as_of_col)

    @stage("positions", "all_days")
    def holdings(self) -> DataFrame:
        return positions.holdings_on(self.days, self.positions)

    @stage("values", "holdings")
    def book(self) -> DataFrame:
        """(k, date, instrument_id, desk, quantity, unit_value, mv) of every market day and instrument.

        Each instrument is spread over the ordinals from the first on, so it has its days before its first price or trade too.

        A position without a price has a null value, and so has every sum over it: the day's profit, its
        forecast and its stress. An empty position is worth zero, priced or not.
        """
        every = self.instruments.select("instrument_id", "desk", F.explode(F.sequence(F.lit(0), F.lit(self.k))).alias("ord"))
        rows = (every.join(self.values.select("ord", "instrument_id", "unit_value"), ["ord", "instrument_id"], "left")
                .join(self.holdings.select("ord", "instrument_id", "quantity"), ["ord", "instrument_id"], "left")
                .withColumn("quantity", F.coalesce("quantity", F.lit(0.0))).join(self.days.select("ord", "date"), "ord"))
        return rows.select(F.col("ord").alias("k"), "date", "instrument_id", "desk", "quantity", "unit_value",
                           F.when(F.col("quantity") == 0, 0.0).otherwise(F.col("quantity") * F.col("unit_value")).alias("mv"))

    # --- risk today ------------------------------------------------------------------------------

    @cached_property
    def scenarios(self) -> DataFrame:
        return risk.scenario_moves(self.moves, self.calendar)

    def _aged(self, cube: DataFrame) -> DataFrame:
        return risk.with_age(cube, self.calendar, self.cfg.risk.window_days)

    @cached_property
    def today(self) -> DataFrame:
        return self.book.filter(F.col("k") == self.k)

    @stage("book", "calendar")
    def desk_cube(self) -> DataFrame:
        cube = risk.scenario_cube(self.today, self.scenarios, ["desk"], self.cfg.risk.window_days)
        return self._aged(cube)

    @stage("book", "calendar")
    def total_cube(self) -> DataFrame:
        return self._aged(risk.scenario_cube(self.today, self.scenarios, [], self.cfg.risk.window_days))

    @stage("total_cube")
    def totals(self) -> DataFrame:
        return risk.measures(self.total_cube, ["k"], self.cfg.risk).drop("k")

    @stage("desk_cube", "total_cube")
    def desks(self) -> DataFrame:
        return risk.desk_measures(self.desk_cube, self.total_cube, self.cfg.risk)

    @stage("totals", "desks")
    def risk_results(self) -> DataFrame:
        """(method, measure, scope, scope_id, value)."""
        whole = self.totals.select("method", "measure", F.lit("total").alias("scope"), F.lit("book").alias("scope_id"), "value")
        parts = self.desks.unpivot(["desk"], ["VaR99_standalone", "ES975_contribution"], "measure", "value")
        return whole.unionByName(parts.select(F.lit(self.cfg.risk.primary).alias("method"), "measure", F.lit("desk").alias("scope"),
                                              F.col("desk").alias("scope_id"), "value"))

    # --- backtest --------------------------------------------------------------------------------

    @cached_property
    def forecasts(self) -> DataFrame:
        cube = risk.scenario_cube(self.book, self.scenarios, [], self.cfg.risk.window_days)
        return risk.measures(self._aged(cube), ["k"], self.cfg.risk)

    @stage("book", "calendar")
    def backtest(self) -> DataFrame:
        held = self.holdings.select(F.col("ord").alias("k")).distinct()
        return B.backtest_rows(self.calendar, held, self.forecasts, B.realised_pnl(self.book, self.moves),
                               self.cfg.risk.backtest_start)

    @stage("backtest")
    def backtest_summary(self) -> DataFrame:
        return B.backtest_summary(self.backtest, self.cfg.risk)

    # --- explain ---------------------------------------------------------------------------------

    @stage("holdings", "values", "calendar")
    def coalitions(self) -> DataFrame:
        held = self.holdings.filter(F.col("ord").isin(self.k, self.k - 1))
        vals = self.values.filter(F.col("ord").isin(self.k, self.k - 1))
        on = lambda frame, d: frame.filter(F.col("ord") == d)
        four = E.four_books(on(held, self.k), on(held, self.k - 1), on(vals, self.k), on(vals, self.k - 1))
        w = self.cfg.risk.window_days
        pnl = (self.scenarios.filter(F.col("s") >= max(1, self.k - w)).join(four, "instrument_id")
               .groupBy("p", "l", "s").agg(whole_sum(F.col("mv") * F.col("growth")).alias("pnl")))
        return E.coalition_cube(pnl, self.calendar, self.k, w)

    @cached_property
    def coalition_values(self) -> DataFrame:
        return E.coalition_measures(self.coalitions, self.cfg.risk)

    @stage("coalitions")
    def var_explain(self) -> DataFrame:
        return E.shapley_shares(self.coalition_values, ["VaR99", "ES975"])

    @cached_property
    def recent_trades(self) -> DataFrame:
        return E.trades_between(self.trades, F.lit(self.previous), self._as_of_col,
                                self.values.filter(F.col("ord") == self.k))

    # --- stress ----------------------------------------------------------------------------------

    @stage("all_days")
    def windows(self) -> DataFrame:
        return stress.resolve_windows(stress.windows_frame(self.spark, self.cfg.past_windows), self.days)

    @stage("windows", "stress_moves")
    def stress_factors(self) -> DataFrame:
        """Cumulative factor moves along every window."""
        dense = returns.dense_returns(self.days, self.stress_moves, self.instruments)
        return stress.path_moves(self.windows, dense)

    @stage("stress_factors", "book")
    def stress_path(self) -> DataFrame:
        return stress.historical_positions(self.stress_factors, self.attributes, self.today)

    @stage("stress_path")
    def historical(self) -> DataFrame:
        return stress.historical_summary(self.windows, self.stress_path, self.days)

    @cached_property
    def shocks(self) -> DataFrame:
        return stress.shocks_frame(self.spark, self.cfg.scenarios)

    @cached_property
    def hypothetical_positions(self) -> DataFrame:
        hits = stress.require_valid(self.shocks, stress.shock_hits(self.shocks, self.instruments))
        moved = stress.shock_moves(hits, self.instruments, self.shocks)
        return stress.shocked_pnl(moved, self.attributes, self.today, ["scenario"]).select(
            "scenario", "instrument_id", "desk", "pnl")

    @stage("stress_path", "book")
    def stress_positions(self) -> DataFrame:
        """End-of-window and instant-shock P&L per position."""
        past = stress.end_positions(self.stress_path, self.windows).withColumn("kind", F.lit("historical"))
        return past.unionByName(self.hypothetical_positions.withColumn("kind", F.lit("hypothetical")))

    # --- controls --------------------------------------------------------------------------------

    def control_frames(self) -> list[Callable[[], DataFrame]]:
        """The fourteen data controls and the deadline, in their fixed order."""
        rules, d, dim = self.cfg.controls, self._as_of_col, self.instruments
        market, refs = self.market, self.references
        return [
            lambda: C.raw_duplicates(tables.map_series(self.raw, dim)), lambda: C.invalid_values(market, dim, d, rules),
            lambda: C.missing_prices(C.last_seen(market, dim, d), rules), lambda: C.stale_prices(C.last_seen(market, dim, d), d, rules),
            lambda: C.interior_gaps(market, dim, d, rules), lambda: C.return_outliers(market, dim, d, rules),
            lambda: C.cross_source(refs, market, self.cross_checks, d, rules), lambda: C.futures_roll(market, refs, d, rules),
            lambda: C.dividend_adjustment(market, self.dividends, dim, d, rules),
            lambda: C.revisions(C.find_revisions(wh.market_data(self.marks, dim, "kept"), market, rules.revision_pct), d, rules),
            lambda: C.history_sufficiency(market, dim, d, rules),
            lambda: C.position_reconciliation(self.positions, self.trades, d, rules),
            lambda: C.position_coverage(self.positions, dim, self.filled, d),
            lambda: C.lineage_complete(market, self.lineage, d), lambda: C.reporting_sla(self.finished(), rules).select(*C.COLUMNS)]

    def finished(self) -> DataFrame:
        """(run_id, as_of, finished) of this run: the instant given, else the configured time of the next weekday."""
        local = F.to_timestamp(F.concat(D.business_shift(self._as_of_col, 1).cast("string"), F.lit(f" {self.cfg.controls.finished_at}:00")))
        at = F.lit(self._finished).cast("timestamp") if self._finished else F.to_utc_timestamp(local, self.cfg.controls.sla_zone)
        return self.spark.range(1).select(F.lit("run").alias("run_id"), self._as_of_col.alias("as_of"), at.alias("finished"))

    @cached_property
    def controls(self) -> DataFrame:
        """One row per control. They are independent, so they run side by side, each into its own folder."""
        self.ready("market", "references", "dividends", "positions", "filled")

        def write(job: tuple[int, Callable[[], DataFrame]]) -> tuple[str, StructType]:
            frame, path = job[1](), f"{self.store}/controls/{job[0]:02d}"
            tables.write_table(frame, path)
            return path, frame.schema

        with ThreadPoolExecutor(7) as pool:
            written = list(pool.map(write, enumerate(self.control_frames())))
        return self.spark.read.schema(written[0][1]).parquet(*[path for path, _ in written])


_RUNS: dict[tuple, DailyRun] = {}


def daily_run(spark: SparkSession, sf_dir: str, cfg: RunConfig = ORDER_CONFIG) -> DailyRun:
    """The run of this session and folder; its stored stages are shared by all queries."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, cfg)
    if key not in _RUNS:
        _RUNS[key] = DailyRun(spark, sf_dir, cfg)
    return _RUNS[key]


def release_runs() -> None:
    """Forget every stored stage, so that the next query starts cold."""
    _RUNS.clear()
