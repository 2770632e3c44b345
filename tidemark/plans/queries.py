"""Every operator as a named query over the given tables. Keys are grouped as in the operator inventory.

Each function takes a :class:`~tidemark.plans.daily.DailyRun` and returns one frame. Money is reported in
millions to four decimals and ratios to six, so that sums taken in another order compare equal.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import Shock, Scenario
from tidemark.functions.stats import half_up
from tidemark.operators import backtest as B
from tidemark.operators import controls as C
from tidemark.operators import explain as E
from tidemark.operators import panel, positions, pricing, returns, risk, stress
from tidemark.operators import tail as T
from tidemark.plans import warehouse as wh
from tidemark.plans.daily import DailyRun, daily_run
from tidemark.session import shared_folder
from tidemark.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[DailyRun], DataFrame]) -> Callable[[DailyRun], DataFrame]:
    """Register a function of a daily run under its own name."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(daily_run(spark, sf_dir))
    return fn


def mm(column: Column | str) -> Column:
    """Money in millions."""
    return half_up((F.col(column) if isinstance(column, str) else column) / 1e6, 4)


def ratio(column: Column | str, digits: int = 6) -> Column:
    return half_up(F.col(column) if isinstance(column, str) else column, digits)


# --- Stored tables (S7-S15, A7, U1, U6) ------------------------------------------------------------


@query
def market_data_daily(run: DailyRun) -> DataFrame:
    """Symbol mapping and unit scaling of raw quotes."""
    return run.market.select("instrument_id", "date", ratio("close").alias("close"), "fetch_id")


@query
def reference_fanout(run: DailyRun) -> DataFrame:
    """One series serving several instruments and purposes."""
    return run.references.select("instrument_id", "purpose", "source", "ticker", "date", ratio("value").alias("value"))


@query
def dividend_extract(run: DailyRun) -> DataFrame:
    """S9."""
    return run.dividends.select("instrument_id", "ex_date", ratio("amount").alias("amount"))


def _two_loads(run: DailyRun) -> DataFrame:
    """Every quote loaded twice: first from the retained line items, then from all of them."""
    first = wh.market_data(run.marks, run.instruments, "kept").withColumn("load_seq", F.lit(1))
    second = wh.market_data(run.marks, run.instruments, "all").withColumn("load_seq", F.lit(2))
    return first.unionByName(second)


@query
def dedupe_keep_last(run: DailyRun) -> DataFrame:
    """The last loaded row per key."""
    rows = tables.keep_last(_two_loads(run), ["instrument_id", "date"])
    return rows.select("instrument_id", "date", "close", "load_seq")


@query
def keyed_upsert(run: DailyRun) -> DataFrame:
    """Incoming rows replace stored ones by key."""
    stored = wh.market_data(run.marks, run.instruments, "all").select("instrument_id", "date", "close", F.lit("stored").alias("origin"))
    incoming = wh.market_data(run.marks, run.instruments, "f").select("instrument_id", "date", "close", F.lit("incoming").alias("origin"))
    return tables.upsert(stored, incoming, ["instrument_id", "date"])


@query
def replace_date_range(run: DailyRun) -> DataFrame:
    """Stored trades up to the cut are replaced by a new book."""
    cut = F.lit("1998-12-31").cast("date")
    stored = run.trades.select("trade_id", "trade_date", "instrument_id", "quantity")
    renewed = stored.filter(F.col("trade_date") <= cut).withColumn("quantity", F.col("quantity") * 2)
    return tables.replace_up_to(stored, renewed, "trade_date", cut)


@query
def append_only_results(run: DailyRun) -> DataFrame:
    """Two runs appended to one partitioned results table, read back."""
    path = shared_folder(run.spark, "risk-results")
    for run_id in ("run-1", "run-2"):
        tables.append_table(run.totals.withColumn("run_id", F.lit(run_id)), path, partition="run_id")
    return run.spark.read.parquet(path).select("run_id", "method", "measure", mm("value").alias("value"))


@query
def partition_overwrite(run: DailyRun) -> DataFrame:
    """S12, S14 at the sink: only the years present in the new rows are overwritten."""
    path = shared_folder(run.spark, "trades-by-year")
    rows = run.trades.select("instrument_id", "trade_date", "quantity", F.year("trade_date").alias("year"))
    tables.write_table(rows, path, partition="year")
    tables.write_table(rows.filter("year >= 2000").withColumn("quantity", F.lit(0.0)), path, partition="year")
    return (run.spark.read.parquet(path).groupBy(F.col("year").cast("int").alias("year"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity")))


@query
def run_log_status(run: DailyRun) -> DataFrame:
    """Newest status per run from appended events."""
    events = wh.table(run.spark, run.sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.to_date("ts").alias("as_of"), F.col("event_type").alias("status"), F.col("ts").alias("at"))
    log = tables.run_log(events)
    return log.select("run_id", "as_of", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"),
                      F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished_at"), "status")


@query
def sql_view_scan(run: DailyRun) -> DataFrame:
    """A predicate and projection over a registered frame."""
    return tables.sql_over(run.spark, run.market, "market_data_view", f"""
        SELECT instrument_id, count(*) AS n, max(date) AS last FROM market_data_view
        WHERE date <= DATE '{run.as_of}' GROUP BY instrument_id""")


# --- Panels and returns (R1-R5, W2-W5, J9, J11, J12) -------------------------------------------------


@query
def ffill_panel(run: DailyRun) -> DataFrame:
    """Levels on every weekday, short gaps filled."""
    return run.filled.select("date", "instrument_id", ratio("level").alias("level"))


@query
def market_day_calendar(run: DailyRun) -> DataFrame:
    """R4, W13, J9."""
    return run.days.select(F.col("ord").cast("bigint").alias("ord"), "date")


@query
def proxy_panel(run: DailyRun) -> DataFrame:
    """Proxies filled on the union calendar, on market days."""
    rows = panel.proxy_levels(run.references, run.days, F.lit(run.as_of), run.cfg.risk.ffill_limit, ["return_proxy", "stress_proxy"])
    return rows.select("purpose", "instrument_id", "date", ratio("level").alias("level"))


@query
def dividend_panel(run: DailyRun) -> DataFrame:
    """Dividends summed per ex-date, market days only, zero elsewhere."""
    paid = run.dividends.groupBy("instrument_id", F.col("ex_date").alias("date")).agg(F.sum("amount").alias("amount"))
    return (run.levels.join(paid, ["instrument_id", "date"], "left")
            .select("date", "instrument_id", ratio(F.coalesce("amount", F.lit(0.0))).alias("amount")))


@query
def factor_returns(run: DailyRun) -> DataFrame:
    """R5, P10, W3."""
    return run.factor_moves.select("date", "instrument_id", ratio("r").alias("r"))


@query
def stress_factor_returns(run: DailyRun) -> DataFrame:
    """R5 with stress proxies taking precedence."""
    return run.stress_moves.select("date", "instrument_id", ratio("r").alias("r"))


@query
def total_return(run: DailyRun) -> DataFrame:
    """Price and total return of equities on consecutive market days with a dividend."""
    paid = run.dividends.select("instrument_id", F.col("ex_date").alias("date"), "amount")
    by_day = W.partitionBy("instrument_id").orderBy("ord")
    rows = run.levels.join(run.instruments.filter("asset_class = 'equity'").select("instrument_id"), "instrument_id", "left_semi")
    before = F.when(F.lag("ord").over(by_day) == F.col("ord") - 1, F.lag("level").over(by_day))
    both = rows.join(paid, ["instrument_id", "date"], "left").select(
        "date", "instrument_id", returns.log_return(F.col("level"), before).alias("price_return"),
        returns.log_return(F.col("level"), before, F.col("amount")).alias("total_return"))
    return both.filter("total_return is not null").select(
        "date", "instrument_id", ratio("price_return").alias("price_return"), ratio("total_return").alias("total_return"))


@query
def vendor_return_gap(run: DailyRun) -> DataFrame:
    """Own dividend-adjusted return against the vendor's."""
    rows = C.dividend_gaps(run.market, run.dividends, run.instruments, F.lit(run.as_of))
    return rows.filter("pos > 1").select("instrument_id", "date", ratio("paid").alias("paid"), ratio("diff").alias("diff"))


@query
def complete_scenario_days(run: DailyRun) -> DataFrame:
    """P5: days on which every factor moved, with their running count."""
    return run.calendar.select("date", "complete", F.col("c").cast("bigint").alias("c"))


# --- Valuation and positions (R6-R8, R18, R31, J13, J15, W9) -----------------------------------------


@query
def unit_values(run: DailyRun) -> DataFrame:
    """R6, J15, J8."""
    return run.daily_values.filter("unit_value is not null").select("date", "instrument_id", ratio("unit_value").alias("unit_value"))


@query
def value_moves(run: DailyRun) -> DataFrame:
    """Log value move per scenario day and instrument."""
    return run.moves.filter("x is not null").select("date", "instrument_id", ratio("x").alias("x"))


@query
def shocked_levels(run: DailyRun) -> DataFrame:
    """today's levels under every past return."""
    now = run.levels.filter(F.col("ord") == run.k).select("instrument_id", "level")
    rows = run.moves.select("date", "instrument_id", "r").join(now, "instrument_id").join(
        run.instruments.select("instrument_id", "quote"), "instrument_id")
    return rows.select("date", "instrument_id", ratio(pricing.shocked_level(F.col("level"), F.col("r"), F.col("quote")), 4).alias("level"))


@query
def positions_from_trades(run: DailyRun) -> DataFrame:
    """Running total of trades on every weekday."""
    return run.positions.select("as_of", "instrument_id", "quantity")


@query
def asof_positions(run: DailyRun) -> DataFrame:
    """Last snapshot on or before each quote date; snapshots taken on Fridays only."""
    fridays = run.positions.filter(F.weekday("as_of") == 4)
    dates = run.market.select("date").distinct()
    at = positions.latest_at_or_before(dates, fridays.select("as_of"), "date", "as_of").filter("as_of is not null")
    return at.join(fridays, "as_of").select("date", "as_of", "instrument_id", "quantity")


@query
def sized_quantities(run: DailyRun) -> DataFrame:
    """Quantity worth one million per instrument number on the run date."""
    targets = run.instruments.select("instrument_id", (F.substring_index("instrument_id", "#", -1).cast("double") * 1e6).alias("target"))
    values = run.values.filter(F.col("ord") == run.k).select("instrument_id", "unit_value")
    sized = positions.sized_quantities(targets, values)
    return sized.select("instrument_id", "target", ratio("quantity", 4).alias("quantity"))


@query
def holdings_market_value(run: DailyRun) -> DataFrame:
    """Market value of every market day and instrument."""
    return run.book.select("date", "instrument_id", "quantity", mm("mv").alias("mv"))


# --- Risk today (R9-R21, A10, A14, A25, A26, P13) ----------------------------------------------------


@query
def scenario_pnl(run: DailyRun) -> DataFrame:
    """Desk P&L of today's book under every scenario of the window."""
    dates = run.calendar.select(F.col("ord").alias("s"), "date")
    return run.desk_cube.join(dates, "s").select("date", "desk", mm("pnl").alias("pnl"))


@query
def desk_pnl_rollup(run: DailyRun) -> DataFrame:
    """A10: desk and total P&L per scenario in one grouping-sets pass."""
    rows = run.desk_cube.rollup("s", "desk").agg(F.sum("pnl").alias("pnl"), F.grouping_id().alias("g")).filter("g <= 1")
    dates = run.calendar.select(F.col("ord").alias("s"), "date")
    return rows.join(dates, "s").select("date", F.when(F.col("g") == 1, "total").otherwise(F.col("desk")).alias("desk"), mm("pnl").alias("pnl"))


@query
def scenario_weights(run: DailyRun) -> DataFrame:
    """Weight of every scenario by method."""
    rows = risk.weighted(run.total_cube, run.cfg.risk).join(run.calendar.select(F.col("ord").alias("s"), "date"), "s")
    names = {f"w_{m.name}": m.name for m in run.cfg.risk.methods}
    long = rows.unpivot(["date"], list(names), "w", "weight")
    return long.select("date", F.replace("w", F.lit("w_"), F.lit("")).alias("method"), ratio("weight", 9).alias("weight"))


def _totals(run: DailyRun, method: str) -> DataFrame:
    return run.totals.filter(F.col("method") == method).select("measure", mm("value").alias("value"))


@query
def var_es_equal(run: DailyRun) -> DataFrame:
    """R9, R10, R16, A14, O1, W11."""
    return _totals(run, "hs_equal")


@query
def var_es_weighted(run: DailyRun) -> DataFrame:
    """R9, R10, R13."""
    return _totals(run, "hs_weighted")


@query
def parametric_var(run: DailyRun) -> DataFrame:
    """R15, A26, F5."""
    return _totals(run, "parametric")


@query
def es_contrib_desk(run: DailyRun) -> DataFrame:
    """R11."""
    return run.desks.select("desk", mm("ES975_contribution").alias("es_contribution"))


@query
def var_standalone_desk(run: DailyRun) -> DataFrame:
    """R12."""
    return run.desks.select("desk", mm("VaR99_standalone").alias("var99"))


@query
def tail_scenarios(run: DailyRun) -> DataFrame:
    """Scenarios with weight in the ES tail, equal weights."""
    w = f"w_{run.cfg.risk.primary}"
    rows = T.cumulate(risk.weighted(run.total_cube, run.cfg.risk), ["k"], [w]).withColumn("t", T.tail_weight(w, 0.975))
    return rows.filter("t > 1e-12").join(run.calendar.select(F.col("ord").alias("s"), "date"), "s").select(
        "date", mm("loss").alias("loss"), ratio("t", 9).alias("tail_weight"))


@query
def risk_results_long(run: DailyRun) -> DataFrame:
    """Every measure as one row."""
    return run.risk_results.select("method", "measure", "scope", "scope_id", mm("value").alias("value"))


@query
def var_ten_day(run: DailyRun) -> DataFrame:
    """R20."""
    return risk.horizon_scaled(run.totals).select("method", mm("scaled").alias("scaled"))


@query
def diversification_benefit(run: DailyRun) -> DataFrame:
    """R21."""
    rows = risk.diversification_benefit(run.desks, run.totals, run.cfg.risk.primary)
    return rows.select(mm("standalone").alias("standalone"), mm("total").alias("total"), mm("benefit").alias("benefit"))


@query
def ewma_cov(run: DailyRun) -> DataFrame:
    """Covariance of factor pairs over the window."""
    ages = run.total_cube.select("s", "age", "n")
    rows = run.moves.select(F.col("ord").alias("s"), "instrument_id", "r").join(ages, "s")
    return risk.ewma_covariance(rows, 0.94).select("a_id", "b_id", ratio("cov").alias("cov"))


@query
def run_summary(run: DailyRun) -> DataFrame:
    """Run date, scenario counts, dropped scenarios, first scenario."""
    lo = max(1, run.k - run.cfg.risk.window_days + 1)
    window = run.calendar.filter(F.col("ord").between(lo, run.k))
    return window.agg(F.max("date").alias("as_of"), F.min("date").alias("first_scenario"),
                      F.count(F.when(F.col("complete"), 1)).alias("n_scenarios"),
                      F.count(F.when(~F.col("complete"), 1)).alias("dropped"))


# --- Backtest (B1-B8, A19, A20, F2-F4, W17, W19) -----------------------------------------------------


@query
def rolling_backtest(run: DailyRun) -> DataFrame:
    """Every market day with a forecast from the day before."""
    return run.backtest.select("date", "method", mm("var95").alias("var95"), mm("var99").alias("var99"), mm("pnl").alias("pnl"))


@query
def exceptions(run: DailyRun) -> DataFrame:
    """B2."""
    flag99, flag95 = B.exception(F.col("pnl"), F.col("var99")), B.exception(F.col("pnl"), F.col("var95"))
    return run.backtest.select("date", "method", flag99.alias("exception_99"), flag95.alias("exception_95")).filter(
        "exception_99 + exception_95 > 0")


@query
def exceptions_by_method(run: DailyRun) -> DataFrame:
    """A20."""
    counts = B.transitions(run.backtest)
    return counts.select("method", "level", "n", "exceptions", ratio(F.col("n") * F.col("p")).alias("expected"),
                         ratio(F.col("exceptions") / F.col("n")).alias("rate"))


@query
def exception_transitions(run: DailyRun) -> DataFrame:
    """A19."""
    return B.transitions(run.backtest).select("method", "level", "n00", "n01", "n10", "n11")


def _tests(run: DailyRun) -> DataFrame:
    return B.coverage_tests(B.transitions(run.backtest))


@query
def kupiec(run: DailyRun) -> DataFrame:
    """B3, F2, F3."""
    return _tests(run).select("method", "level", ratio("kupiec_lr", 4).alias("lr"), ratio("kupiec_p").alias("p"))


@query
def christoffersen(run: DailyRun) -> DataFrame:
    """B4, F2, F3."""
    return _tests(run).select("method", "level", ratio("christoffersen_lr", 4).alias("lr"), ratio("christoffersen_p").alias("p"))


@query
def joint_coverage(run: DailyRun) -> DataFrame:
    """B5, F3."""
    return _tests(run).select("method", "level", ratio("cc_p").alias("p"))


@query
def traffic_light(run: DailyRun) -> DataFrame:
    """B6, F4."""
    return B.recent_zone(run.backtest, run.cfg.risk).select("method", "last_n", "last_exceptions", "zone", "plus_factor")


@query
def traffic_light_table(run: DailyRun) -> DataFrame:
    """Zone of every running exception count within each 250-day block of the backtest."""
    seq = run.backtest.withColumn("rn", F.row_number().over(W.partitionBy("method").orderBy("date")) - 1)
    block = seq.withColumn("block", F.floor(F.col("rn") / 250)).groupBy("method", "block").agg(
        F.count(F.lit(1)).alias("n"), F.sum(B.exception(F.col("pnl"), F.col("var95"))).alias("x"))
    zoned = block.withColumn("zone", B.zone(F.col("n"), F.col("x"), 0.05))
    return zoned.select("method", F.col("block").cast("bigint").alias("block"), "n", "x", "zone")


@query
def backtest_last_250(run: DailyRun) -> DataFrame:
    """W17."""
    return B.last_days(run.backtest, 250).select("date", "method", mm("var99").alias("var99"), mm("pnl").alias("pnl"))


@query
def backtest_worst_day(run: DailyRun) -> DataFrame:
    """A13."""
    return B.worst_days(run.backtest).select("method", "worst_day", mm("worst_pnl").alias("worst_pnl"))


@query
def backtest_summary(run: DailyRun) -> DataFrame:
    """B7."""
    return run.backtest_summary.select(
        "method", "n", "exceptions", ratio("expected").alias("expected"), ratio("kupiec_p").alias("kupiec_p"),
        ratio("christoffersen_p").alias("christoffersen_p"), "last_n", "last_exceptions", "zone", "plus_factor",
        "worst_day", mm("worst_pnl").alias("worst_pnl"), "exceptions_95", ratio("expected_95").alias("expected_95"),
        ratio("kupiec_p_95").alias("kupiec_p_95"), ratio("christoffersen_p_95").alias("christoffersen_p_95"))


@query
def mark_to_market_recheck(run: DailyRun) -> DataFrame:
    """Revalued against marked P&L, per day."""
    rows = B.mark_to_market_check(run.holdings, run.values, run.moves, run.dividends, run.instruments)
    return rows.select("date", mm("revalued").alias("revalued"), mm("marked").alias("marked"))


@query
def var_by_computed_day(run: DailyRun) -> DataFrame:
    """Each forecast on the day it was computed, today's appended."""
    by_day = W.partitionBy("method").orderBy("date")
    begins = run.holdings.agg(F.min("date")).scalar()  # the first forecast was made when the book began
    shifted = run.backtest.select("method", F.coalesce(F.lag("date").over(by_day), begins).alias("computed_on"), "var99")
    now = run.totals.filter("measure = 'VaR99'").select("method", F.lit(run.as_of).alias("computed_on"), F.col("value").alias("var99"))
    return shifted.unionByName(now).select("method", "computed_on", mm("var99").alias("var99"))


@query
def var_history_wide(run: DailyRun) -> DataFrame:
    """One column per method, explicit value list."""
    names = [m.name for m in run.cfg.risk.methods]
    wide = run.backtest.groupBy("date").pivot("method", names).agg(F.first("var99"))
    return wide.select("date", *[mm(n).alias(n) for n in names])


# --- Explain (R22-R25, J20) --------------------------------------------------------------------------


@query
def coalition_values(run: DailyRun) -> DataFrame:
    """VaR99 and ES97.5 of the eight coalitions."""
    return run.coalition_values.select("p", "l", "w", mm("VaR99").alias("var99"), mm("ES975").alias("es975"))


@query
def var_explain(run: DailyRun) -> DataFrame:
    """R22."""
    return run.var_explain.select("measure", "component", mm("value").alias("value"))


@query
def var_setting_day(run: DailyRun) -> DataFrame:
    """R23."""
    return E.var_setting_day(run.coalitions, run.coalition_values).select("state", "date", mm("pnl").alias("pnl"))


@query
def window_entered_left(run: DailyRun) -> DataFrame:
    """R24, J20, U4."""
    return E.entered_and_left(run.coalitions).select("change", "date", mm("pnl").alias("pnl"))


@query
def trades_since_previous(run: DailyRun) -> DataFrame:
    """R25, A3, P2."""
    return run.recent_trades.select("instrument_id", "quantity", mm("value").alias("value"))


# --- Stress (R26-R30, P6, P7, W10, O2) ---------------------------------------------------------------


@query
def stress_windows(run: DailyRun) -> DataFrame:
    """R26, J13."""
    return run.windows.select("scenario", "name", "first_date", "last_date", "available")


@query
def stress_hist_path(run: DailyRun) -> DataFrame:
    """Book P&L on every day of every window."""
    totals = run.stress_path.groupBy("scenario", "ord").agg(F.sum("pnl").alias("pnl")).join(run.days, "ord")
    return totals.select("scenario", "date", mm("pnl").alias("pnl"))


@query
def stress_historical(run: DailyRun) -> DataFrame:
    """End P&L, worst point, missing data."""
    return run.historical.select("scenario", "available", mm("pnl").alias("pnl"), mm("worst_pnl").alias("worst_pnl"), "worst_date", F.col("n_no_data").cast("double").alias("n_no_data"))


@query
def stress_no_data(run: DailyRun) -> DataFrame:
    """Instruments with a missing move inside an available window."""
    gaps = run.stress_path.filter("gap").groupBy("scenario", "instrument_id").agg(F.count(F.lit(1)).alias("days"))
    return gaps.select("scenario", "instrument_id", "days")


@query
def shock_vector(run: DailyRun) -> DataFrame:
    """The summed move of every instrument."""
    hits = stress.shock_hits(run.shocks, run.instruments)
    return stress.shock_moves(hits, run.instruments, run.shocks).select("scenario", "instrument_id", ratio("r").alias("r"))


@query
def stress_hypothetical(run: DailyRun) -> DataFrame:
    """R29."""
    return run.hypothetical_positions.groupBy("scenario").agg(F.sum("pnl").alias("pnl")).select("scenario", mm("pnl").alias("pnl"))


@query
def stress_by_desk(run: DailyRun) -> DataFrame:
    """Desks and total, both kinds."""
    return stress.by_desk(run.stress_positions).select("scenario", "desk", mm("pnl").alias("pnl"))


@query
def stress_top3(run: DailyRun) -> DataFrame:
    """O2."""
    return stress.largest_losses(run.stress_positions).select("scenario", "rank", "instrument_id", mm("pnl").alias("pnl"))


@query
def shock_guards(run: DailyRun) -> DataFrame:
    """Shocks that select nothing or use the wrong unit, found against the instruments."""
    wrong = (Scenario("bad_unit", "", "", (Shock(asset_class="rates", pct=5.0), Shock(asset_class="equity", pp=1.0))),
             Scenario("bad_selector", "", "", (Shock(desk="No such desk", pct=5.0), Shock(asset_class="fx", pct=-1.0))))
    shocks = stress.shocks_frame(run.spark, wrong)
    errors = stress.check_shocks(shocks, stress.shock_hits(shocks, run.instruments))
    return errors.groupBy("scenario", "shock", "error").agg(F.count(F.lit(1)).alias("n"))


# --- Controls (C1-C16) -------------------------------------------------------------------------------


def _control(name: str) -> None:
    def fn(run: DailyRun) -> DataFrame:
        return run.controls.filter(F.col("control") == name).select(*C.COLUMNS)
    fn.__name__ = f"ctl_{name}"
    query(fn)


for _name in ("raw_duplicates", "invalid_values", "missing_prices", "stale_prices", "interior_gaps", "return_outliers", "cross_source",
              "futures_roll", "dividend_adjustment", "revisions", "history_sufficiency", "position_reconciliation", "position_coverage",
              "lineage_complete"):
    _control(_name)


@query
def ctl_reporting_sla(run: DailyRun) -> DataFrame:
    """Every event as a run finished at its time, reporting on three days before."""
    events = wh.table(run.spark, run.sf_dir, "events").select(
        F.col("event_id").alias("run_id"), F.date_sub(F.to_date("ts"), F.pmod("event_id", F.lit(3)).cast("int")).alias("as_of"), F.col("ts").cast("timestamp").alias("finished"))
    return C.reporting_sla(events, run.cfg.controls)


@query
def controls_overall(run: DailyRun) -> DataFrame:
    """Worst status of the run."""
    return C.overall_status(run.controls)


@query
def controls_histogram(run: DailyRun) -> DataFrame:
    """A23."""
    return run.controls.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def fault_duplicates(run: DailyRun) -> DataFrame:
    """C1, A6 on quotes loaded twice."""
    return C.raw_duplicates(_two_loads(run))


@query
def fault_invalid_values(run: DailyRun) -> DataFrame:
    """C2 on closes shifted down by 700, so that low prices turn negative and yields leave their range."""
    shifted = run.market.withColumn("close", F.col("close") - 700)
    return C.invalid_values(shifted, run.instruments, F.lit(run.as_of), run.cfg.controls)


def _late_feed(run: DailyRun) -> DataFrame:
    """Each instrument's feed stops as many days before the run date as its number; number 25 never arrives."""
    n = F.substring_index("instrument_id", "#", -1).cast("int")
    return run.market.filter((F.col("date") <= F.date_sub(F.lit(run.as_of), n)) & (n < 25))


@query
def fault_missing(run: DailyRun) -> DataFrame:
    """C3, A1, F7 on feeds that stopped."""
    return C.missing_prices(C.last_seen(_late_feed(run), run.instruments, F.lit(run.as_of)), run.cfg.controls)


@query
def fault_stale(run: DailyRun) -> DataFrame:
    """C4 on feeds that stopped."""
    d = F.lit(run.as_of)
    return C.stale_prices(C.last_seen(_late_feed(run), run.instruments, d), d, run.cfg.controls)


@query
def price_lags(run: DailyRun) -> DataFrame:
    """Newest date and weekday lag per instrument on feeds that stopped."""
    seen = C.last_seen(_late_feed(run), run.instruments, F.lit(run.as_of))
    return seen.select("instrument_id", "last", F.col("lag").cast("double").alias("lag"))


@query
def fault_outliers(run: DailyRun) -> DataFrame:
    """C5 with a unit glitch on the run date: prices a hundredfold."""
    jump = F.when((F.col("date") == F.lit(run.as_of)) & F.col("instrument_id").isin("Brand#2", "Brand#9", "Brand#13"), 1e9).otherwise(1.0)
    glitch = run.market.withColumn("adj_close", F.col("adj_close") * jump)
    return C.return_outliers(glitch, run.instruments, F.lit(run.as_of), run.cfg.controls)


@query
def ewma_sigma(run: DailyRun) -> DataFrame:
    """today's move and the decaying volatility before it."""
    scores = C.outlier_scores(run.market, run.instruments, F.lit(run.as_of), run.cfg.controls)
    return scores.select("instrument_id", ratio("r").alias("r"), ratio("sigma").alias("sigma"))


@query
def fault_gaps(run: DailyRun) -> DataFrame:
    """The peers' feed made dense, one instrument keeps its own holes."""
    dense = run.filled.filter(F.col("instrument_id") != "Brand#7").select("instrument_id", "date")
    own = run.market.filter(F.col("instrument_id") == "Brand#7").select("instrument_id", "date")
    rules = replace(run.cfg.controls, gap_lookback_bdays=500)
    return C.interior_gaps(dense.unionByName(own), run.instruments, F.lit(run.as_of), rules)


@query
def gap_days(run: DailyRun) -> DataFrame:
    """Every gap day with its peers' share, over the whole history."""
    rules = replace(run.cfg.controls, gap_lookback_bdays=5000)
    rows = C.gap_days(run.market, run.instruments, F.lit(run.as_of), rules)
    return rows.select("instrument_id", "date", ratio("share").alias("share"))


@query
def revised_rows(run: DailyRun) -> DataFrame:
    """Incoming closes that differ from stored ones."""
    changed = C.find_revisions(wh.market_data(run.marks, run.instruments, "kept"), run.market, run.cfg.controls.revision_pct)
    return changed.select("instrument_id", "date", ratio("old_close").alias("old_close"), ratio("new_close").alias("new_close"))


@query
def fault_recent_revisions(run: DailyRun) -> DataFrame:
    """C7 when only recent history changed."""
    recent = F.col("date") > F.date_sub(F.lit(run.as_of), 5)
    new = run.market.withColumn("close", F.when(recent, F.col("close") * 1.01).otherwise(F.col("close")))
    changed = C.find_revisions(new, run.market, run.cfg.controls.revision_pct)
    return C.revisions(changed, F.lit(run.as_of), run.cfg.controls)


@query
def fault_position_break(run: DailyRun) -> DataFrame:
    """One desk's snapshot moved without a trade."""
    home = F.col("instrument_id").isin("Brand#3", "Brand#4")
    moved = run.positions.withColumn("quantity", F.when((F.col("as_of") == F.lit(run.as_of)) & home, F.col("quantity") + 500).otherwise(F.col("quantity")))
    return C.position_reconciliation(moved, run.trades, F.lit(run.as_of), run.cfg.controls)


@query
def position_reconcile_rows(run: DailyRun) -> DataFrame:
    """Previous, traded and current quantity."""
    return C.reconcile(run.positions, run.trades, F.lit(run.as_of)).select("instrument_id", "prev", "traded", "cur")


@query
def fault_no_snapshot(run: DailyRun) -> DataFrame:
    """No snapshot for the run date."""
    earlier = run.positions.filter(F.col("as_of") < F.lit(run.as_of))
    return C.position_reconciliation(earlier, run.trades, F.lit(run.as_of), run.cfg.controls)


@query
def fault_uncovered(run: DailyRun) -> DataFrame:
    """Holdings whose feed stopped long ago."""
    d = F.lit(run.as_of)
    filled = panel.filled_levels(_late_feed(run), d, run.cfg.risk.ffill_limit)
    return C.position_coverage(run.positions, run.instruments, filled, d)


@query
def fault_orphans(run: DailyRun) -> DataFrame:
    """One fetch missing from the lineage."""
    return C.lineage_complete(run.market, run.lineage.filter("fetch_id <> 'src-F'"), F.lit(run.as_of))


@query
def lineage_used(run: DailyRun) -> DataFrame:
    """Lineage records the data refers to."""
    used = run.lineage.join(run.market.select("fetch_id").distinct(), "fetch_id", "left_semi")
    return used.select("fetch_id", "sha256", "n_rows")
