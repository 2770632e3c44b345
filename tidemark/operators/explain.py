"""Day-over-day explanation of VaR and ES."""

from __future__ import annotations

from itertools import product
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import RiskRules
from tidemark.operators import tail as T

# The three causes, in the order of the coalition flags p, l, w.
CAUSES = ("positions", "levels", "window")


def four_books(now: DataFrame, before: DataFrame, values_now: DataFrame, values_before: DataFrame) -> DataFrame:
    """(p, l, instrument_id, mv): quantities of either day valued at the levels of either day.

    Flag 1 means today. A position without a value is null, an empty one zero. The scenario window is the third choice and needs no book of its own.
    """
    q = (now.select("instrument_id", F.col("quantity").alias("q1"))
         .join(before.select("instrument_id", F.col("quantity").alias("q0")), "instrument_id", "full"))
    rows = (q.join(values_now.select("instrument_id", F.col("unit_value").alias("v1")), "instrument_id", "left")
            .join(values_before.select("instrument_id", F.col("unit_value").alias("v0")), "instrument_id", "left"))
    quantity = lambda p: F.coalesce(F.col(f"q{p}"), F.lit(0.0))
    books = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(l).alias("l"),
                               F.when(quantity(p) == 0, 0.0).otherwise(quantity(p) * F.col(f"v{l}")).alias("mv"))
                      for p, l in product((0, 1), (0, 1))])
    return rows.select("instrument_id", F.explode(books).alias("b")).select("instrument_id", "b.*")


def coalition_cube(pnl: DataFrame, calendar: DataFrame, k: int, window_days: int) -> DataFrame:
    """Scenario P&L of all eight coalitions: each book under today's and yesterday's window.

    ``pnl``: p, l, s, pnl over both windows.
    """
    def lo(end: int) -> int:
        return max(1, end - window_days + 1)

    counts = {w: calendar.agg(
        F.max(F.when(F.col("ord") == end, F.col("c"))).alias("_ck"),
        F.max(F.when(F.col("ord") == lo(end) - 1, F.col("c"))).alias("_cb")) for w, end in ((1, k), (0, k - 1))}
    parts = []
    for w, end in ((1, k), (0, k - 1)):
        ck, cb = counts[w].select("_ck").scalar(), counts[w].select("_cb").scalar()
        parts.append(pnl.filter(F.col("s").between(lo(end), end)).join(
            calendar.select(F.col("ord").alias("s"), "date", F.col("c").alias("_cs")), "s")
            .select("p", "l", F.lit(w).alias("w"), "s", "date", "pnl", (ck - F.col("_cs")).alias("age"), (ck - cb).alias("n")))
    return parts[0].unionByName(parts[1])


def coalition_measures(cube: DataFrame, rules: RiskRules) -> DataFrame:
    """(p, l, w, VaR99, ES975) by the primary method, which must be a history method."""
    method = rules.method(rules.primary)
    if method.kind != "history":
        raise ValueError("VaR explain needs a historical-simulation primary method")
    ready = cube.withColumn("wt", T.scenario_weight(method, F.col("age"), F.col("n")))
    return (T.cumulate(ready, ["p", "l", "w"], ["wt"]).groupBy("p", "l", "w")
            .agg(T.value_at_risk("wt", 0.99).alias("VaR99"),
                 T.expected_shortfall("wt", rules.es_confidence).alias("ES975")))


def _coefficient(flag: str) -> Column:
    """Weight of a coalition's value in one player's Shapley share (three players)."""
    others = [f for f in ("p", "l", "w") if f != flag]
    size = F.col(others[0]) + F.col(others[1])
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(2 - k) / factorial(3)) for k in range(3)]), size + 1)
    return F.when(F.col(flag) == 1, weight).otherwise(-weight)


def shapley_shares(values: DataFrame, measure_columns: list[str]) -> DataFrame:
    """(measure, component, value): previous, the three shares, current.

    A share is linear in the eight coalition values, so it is one weighted sum.
    """
    size = F.col("p") + F.col("l") + F.col("w")
    terms = [("previous", F.when(size == 0, 1.0).otherwise(0.0))]
    terms += [(cause, _coefficient(flag)) for cause, flag in zip(CAUSES, ("p", "l", "w"))]
    terms += [("current", F.when(size == 3, 1.0).otherwise(0.0))]
    rows, aggs = [], []
    for measure in measure_columns:
        for component, weight in terms:
            name = f"{measure}_{component}"
            aggs.append(F.sum(weight * F.col(measure)).alias(name))
            rows.append(F.struct(F.lit(measure).alias("measure"), F.lit(component).alias("component"),
                                 F.col(name).alias("value")))
    return values.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def var_setting_day(cube: DataFrame, values: DataFrame) -> DataFrame:
    """(state, date, pnl): first scenario whose loss is (close to) the VaR, before and after."""
    end_states = cube.filter((F.col("p") == F.col("l")) & (F.col("l") == F.col("w")))
    var = values.select("p", "l", "w", F.col("VaR99").alias("v"))
    near = F.abs(-F.col("pnl") - F.col("v")) <= 1e-8 + 1e-5 * F.abs(F.col("v"))
    first = (end_states.join(var, ["p", "l", "w"]).filter(near).groupBy("p")
             .agg(F.min(F.struct("s", "date", "pnl")).alias("f")))
    return first.select(F.when(F.col("p") == 1, "current").otherwise("previous").alias("state"),
                        F.col("f.date").alias("date"), F.col("f.pnl").alias("pnl"))


def entered_and_left(cube: DataFrame) -> DataFrame:
    """(change, date, pnl): scenarios in only one of the two windows, on today's book and levels."""
    today = cube.filter((F.col("p") == 1) & (F.col("l") == 1))
    new, old = today.filter(F.col("w") == 1), today.filter(F.col("w") == 0)
    entered = new.join(old.select("date"), "date", "left_anti").select(F.lit("entered").alias("change"), "date", "pnl")
    left = old.join(new.select("date"), "date", "left_anti").select(F.lit("left").alias("change"), "date", "pnl")
    return entered.unionByName(left)


def trades_between(trades: DataFrame, after: Column, until: Column, values: DataFrame) -> DataFrame:
    """(instrument_id, quantity, value): trades in (after, until] at today's unit value."""
    net = (trades.filter((F.col("trade_date") > after) & (F.col("trade_date") <= until))
           .groupBy("instrument_id").agg(F.sum("quantity").alias("quantity")))
    return (net.join(values.select("instrument_id", "unit_value"), "instrument_id", "left")
            .select("instrument_id", "quantity", (F.col("quantity") * F.col("unit_value")).alias("value")))
