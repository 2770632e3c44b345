"""Scenario weights, Value-at-Risk and Expected Shortfall.

Every ordered pass is over one group of at most ``window_days`` scenarios (one valuation day, desk or
coalition), after instruments have been summed away. Equal and decaying weights share one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.config import Method

TOLERANCE = 1e-12


def scenario_weight(method: Method, age: Column, n: Column) -> Column:
    """Probability of the scenario that is ``age`` retained rows older than the newest of ``n``.

    Closed form of the normalised decay, so no window over the scenarios is needed.
    """
    if method.decay is None:
        return F.lit(1.0) / n
    decay = F.lit(method.decay)
    return F.pow(decay, age) * (1 - decay) / (1 - F.pow(decay, n))


def cumulate(scenarios: DataFrame, groups: list[str], weights: list[str]) -> DataFrame:
    """Add the loss and, per weight column w, the cumulative weight up to (w_to) and before (w_from) the row.

    Losses ascend; ties are broken by scenario order, oldest first.
    """
    order = W.partitionBy(*groups).orderBy(F.col("loss"), F.col("s"))
    out = scenarios.withColumn("loss", -F.col("pnl"))
    sums = []
    for w in weights:
        sums.append(F.sum(w).over(order.rowsBetween(W.unboundedPreceding, 0)).alias(f"{w}_to"))
        sums.append(F.coalesce(F.sum(w).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias(f"{w}_from"))
    return out.select("*", *sums)


def _reached(cumulative: Column, level: float) -> Column:
    return cumulative >= level - TOLERANCE


def value_at_risk(w: str, level: float) -> Column:
    """Smallest loss whose cumulative weight reaches ``level`` (aggregate over a cumulated group)."""
    return F.coalesce(F.min(F.when(_reached(F.col(f"{w}_to"), level), F.col("loss"))), F.max("loss"))


def tail_weight(w: str, level: float) -> Column:
    """Full weight beyond VaR, the part above ``level`` at VaR, nothing before."""
    return (F.when(_reached(F.col(f"{w}_from"), level), F.col(w))
            .when(_reached(F.col(f"{w}_to"), level), F.greatest(F.col(f"{w}_to") - level, F.lit(0.0)))
            .otherwise(F.lit(0.0)))


def expected_shortfall(w: str, level: float) -> Column:
    return F.sum(tail_weight(w, level) * F.col("loss")) / (1 - level)
