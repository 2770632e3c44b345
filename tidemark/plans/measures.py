"""The 31 report measures as functions of marts.

Each takes the marts and returns a small frame: one row, or one per slice. ``method`` is the report's
slicer with the primary method as its default.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.stats import half_up
from tidemark.operators.backtest import last_days
from tidemark.plans.marts import Marts

MEASURES: dict[str, Callable[..., DataFrame]] = {}


def measure(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    MEASURES[fn.__name__] = fn
    return fn


def _m(x: Column) -> Column:
    return half_up(x / 1e6, 4).alias("value")


def _primary(marts: Marts) -> str:
    return marts.run.cfg.risk.primary


def _risk_total(marts: Marts, name: str) -> DataFrame:
    rows = marts.fact_risk.filter((F.col("method") == _primary(marts)) & (F.col("measure") == name) & (F.col("scope") == "total"))
    return rows.agg(_m(F.sum("value_base")))


@measure
def total_var99(marts: Marts) -> DataFrame:
    """M1."""
    return _risk_total(marts, "VaR99")


@measure
def total_var95(marts: Marts) -> DataFrame:
    """M2."""
    return _risk_total(marts, "VaR95")


@measure
def total_es975(marts: Marts) -> DataFrame:
    """M3."""
    return _risk_total(marts, "ES975")


@measure
def es_contribution(marts: Marts) -> DataFrame:
    """M4, by desk."""
    rows = marts.fact_risk.filter((F.col("measure") == "ES975_contribution") & (F.col("scope") == "desk"))
    return rows.groupBy(F.col("scope_id").alias("desk")).agg(_m(F.sum("value_base")))


@measure
def var_change(marts: Marts) -> DataFrame:
    """M5."""
    pick = lambda c: F.sum(F.when((F.col("measure") == "VaR99") & (F.col("component") == c), F.col("value_base")))
    return marts.fact_var_explain.agg(_m(pick("current") - pick("previous")))


@measure
def var_change_by_cause(marts: Marts) -> DataFrame:
    """M6."""
    rows = marts.fact_var_explain.filter((F.col("measure") == "VaR99") & F.col("component").isin("positions", "levels", "window"))
    return rows.groupBy("component_label").agg(_m(F.sum("value_base")))


def _latest(marts: Marts) -> DataFrame:
    newest = marts.fact_position_daily.agg(F.max("date")).scalar()
    return marts.fact_position_daily.filter(F.col("date") == newest)


@measure
def gross_exposure(marts: Marts) -> DataFrame:
    """M7."""
    return _latest(marts).agg(_m(F.sum(F.abs("market_value_base"))))


@measure
def net_market_value(marts: Marts) -> DataFrame:
    """M8, by date."""
    return marts.fact_position_daily.groupBy("date").agg(_m(F.sum("market_value_base")))


@measure
def market_value_today(marts: Marts) -> DataFrame:
    """M9, by instrument name."""
    return _latest(marts).join(marts.dim_instrument, "instrument_id").groupBy("name").agg(_m(F.sum("market_value_base")))


@measure
def share_of_gross(marts: Marts) -> DataFrame:
    """M10, by desk; the denominator ignores the slice."""
    rows = _latest(marts).join(marts.dim_instrument.select("instrument_id", "desk"), "instrument_id")
    gross = rows.agg(F.sum(F.abs("market_value_base"))).scalar()
    return rows.groupBy("desk").agg(half_up(F.try_divide(F.sum(F.abs("market_value_base")), gross), 6).alias("value"))


def slices(marts: Marts, dims: tuple[str, ...] = ("desk", "asset_class", "currency")) -> DataFrame:
    """(date, dims, gross, net, share_of_gross) of every slice, ``All`` where a dimension is not filtered.

    One pass: grouping sets over the position facts, aggregated before the shuffle. The share's denominator is the gross of its date with the
    slice's own filters removed, which is the row of the same date in which no dimension is left.
    """
    rows = marts.fact_position_daily.join(marts.dim_instrument.select("instrument_id", *dims), "instrument_id")
    sets = [["date", *(d for i, d in enumerate(dims) if mask >> i & 1)] for mask in range(1 << len(dims))]
    totals = rows.groupingSets(sets, "date", *dims).agg(
        F.sum(F.abs("market_value_base")).alias("gross"), F.sum("market_value_base").alias("net"), *(F.grouping(d).alias(f"_{d}") for d in dims))
    whole = F.max(F.when(sum(F.col(f"_{d}") for d in dims) == len(dims), F.col("gross"))).over(W.partitionBy("date"))
    return totals.select("date", *(F.when(F.col(f"_{d}") == 1, "All").otherwise(F.col(d)).alias(d) for d in dims), "gross", "net",
                         F.try_divide(F.col("gross"), whole).alias("share_of_gross"))


@measure
def scenario_pnl(marts: Marts) -> DataFrame:
    """M11."""
    return marts.dim_scenario.groupBy("scenario_name").agg(_m(F.sum("pnl_base")))


@measure
def worst_point(marts: Marts) -> DataFrame:
    """M12; null for instant shocks."""
    return marts.dim_scenario.groupBy("scenario_name").agg(_m(F.sum("worst_point_base")))


@measure
def worst_scenario(marts: Marts) -> DataFrame:
    """M13, text."""
    low = marts.dim_scenario.agg(F.min(F.struct("pnl_base", "scenario_name")).alias("x"))
    return low.select(F.concat(F.col("x.scenario_name"), F.lit(": "), F.format_string("%,.1f", half_up(F.col("x.pnl_base") / 1e6, 1)), F.lit("m")).alias("value"))


def _selected(marts: Marts, method: str | None) -> DataFrame:
    return marts.fact_backtest.filter(F.col("method") == (method or _primary(marts)))


@measure
def exceptions(marts: Marts, method: str | None = None) -> DataFrame:
    """M14."""
    return _selected(marts, method).agg(F.sum("exception_99").alias("value"))


@measure
def days_tested(marts: Marts, method: str | None = None) -> DataFrame:
    """M15."""
    return _selected(marts, method).agg(F.count(F.lit(1)).alias("value"))


@measure
def expected_exceptions(marts: Marts, method: str | None = None) -> DataFrame:
    """M16."""
    return _selected(marts, method).agg(half_up(F.count(F.lit(1)) * 0.01, 6).alias("value"))


@measure
def exception_rate(marts: Marts, method: str | None = None) -> DataFrame:
    """M17."""
    return _selected(marts, method).agg(half_up(F.try_divide(F.sum("exception_99"), F.count(F.lit(1))), 6).alias("value"))


@measure
def zone_last_250(marts: Marts, method: str | None = None) -> DataFrame:
    """Fixed cut-offs of the 250-day table, unlike the backtest's own zone."""
    x = F.col("x")
    count = last_days(_selected(marts, method), 250).agg(F.sum("exception_99").alias("x"))
    name = F.when(x <= 4, "Green").when(x <= 9, "Yellow").otherwise("Red")
    return count.select(F.concat(name, F.lit(" ("), x, F.lit(" exceptions)")).alias("value"))


@measure
def daily_pnl(marts: Marts) -> DataFrame:
    """M19, by date."""
    return marts.fact_backtest.filter(F.col("method") == _primary(marts)).groupBy("date").agg(_m(F.sum("pnl")))


@measure
def minus_var99(marts: Marts, method: str | None = None) -> DataFrame:
    """M20, by date."""
    return _selected(marts, method).groupBy("date").agg(_m(-F.sum("var99")))


def _checks(marts: Marts, *statuses: str) -> Column:
    return F.count(F.when(F.col("status").isin(*statuses), 1))


@measure
def checks_passed(marts: Marts) -> DataFrame:
    """M21."""
    return marts.fact_controls.agg(_checks(marts, "PASS", "INFO").alias("value"))


@measure
def warnings(marts: Marts) -> DataFrame:
    """M22."""
    return marts.fact_controls.agg(_checks(marts, "WARN").alias("value"))


@measure
def failures(marts: Marts) -> DataFrame:
    """M23."""
    return marts.fact_controls.agg(_checks(marts, "FAIL").alias("value"))


@measure
def data_checks(marts: Marts) -> DataFrame:
    """M24, text."""
    return marts.fact_controls.agg(F.concat(_checks(marts, "PASS", "INFO"), F.lit(" passed, "), _checks(marts, "WARN"), F.lit(" warnings, "),
                                            _checks(marts, "FAIL"), F.lit(" failed")).alias("value"))


def _published(marts: Marts) -> DataFrame:
    return marts.fact_disclosed_var.filter((F.col("measure") == "average") & (F.col("horizon") == "quarter"))


def _by_quarter(marts: Marts, column: str) -> DataFrame:
    return _published(marts).groupBy("period_end").agg(F.sum(column).alias("value"))


@measure
def disclosed_total(marts: Marts) -> DataFrame:
    """M25, by quarter."""
    return _by_quarter(marts, "total")


@measure
def disclosed_interest_rates(marts: Marts) -> DataFrame:
    """M26, by quarter."""
    return _by_quarter(marts, "interest_rates")


@measure
def disclosed_equity_prices(marts: Marts) -> DataFrame:
    """M27, by quarter."""
    return _by_quarter(marts, "equity_prices")


@measure
def disclosed_currency_rates(marts: Marts) -> DataFrame:
    """M28, by quarter."""
    return _by_quarter(marts, "currency_rates")


@measure
def disclosed_commodity_prices(marts: Marts) -> DataFrame:
    """M29, by quarter."""
    return _by_quarter(marts, "commodity_prices")


@measure
def latest_quarter_total(marts: Marts) -> DataFrame:
    """M30."""
    rows = _published(marts)
    newest = rows.agg(F.max("period_end")).scalar()
    return rows.filter(F.col("period_end") == newest).agg(F.sum("total").alias("value"))


@measure
def quarters_published(marts: Marts) -> DataFrame:
    """M31."""
    return _published(marts).agg(F.count(F.lit(1)).alias("value"))
