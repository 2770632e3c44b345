"""Positions from trades, sizing, and as-of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import dates as D


def positions_from_trades(trades: DataFrame, as_of: Column) -> DataFrame:
    """(as_of, instrument_id, quantity) on every weekday from an instrument's first trade.

    Trades are summed per day before the running total, and each total is exploded over the weekdays
    until the next trade, so a busy instrument costs one row per day, not one per trade.
    """
    daily = (trades.filter(F.col("trade_date") <= as_of).groupBy("instrument_id", "trade_date")
             .agg(F.sum("quantity").alias("traded")))
    by_day = W.partitionBy("instrument_id").orderBy("trade_date")
    first = D.business_ordinal(F.col("trade_date"))
    until = F.coalesce(D.business_ordinal(F.lead("trade_date").over(by_day)), D.business_ordinal(as_of) + 1) - 1
    held = daily.select("instrument_id", F.sum("traded").over(by_day.rowsBetween(W.unboundedPreceding, 0)).alias(
        "quantity"), first.alias("first"), until.alias("until")).filter(F.col("until") >= F.col("first"))
    spread = held.select(F.explode(F.sequence("first", "until")).alias("b"), "instrument_id", "quantity")
    return spread.select(D.business_date(F.col("b")).alias("as_of"), "instrument_id", "quantity")


def latest_at_or_before(moments: DataFrame, marks: DataFrame, moment: str, mark: str) -> DataFrame:
    """As-of join of two date sets: each ``moment`` with the last ``mark`` at or before it, or null.

    Both sides are distinct dates, so the single ordered pass is over calendar rows only.
    """
    both = (moments.select(F.col(moment).alias("at"), F.lit(None).cast("date").alias("seen")).distinct()
            .unionByName(marks.select(F.col(mark).alias("at"), F.col(mark).alias("seen")).distinct()))
    merged = both.groupBy("at").agg(F.max("seen").alias("seen"), F.max(F.col("seen").isNull()).alias("asked"))
    upto = W.orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (merged.select("at", F.max("seen").over(upto).alias(mark), "asked").filter("asked")
            .select(F.col("at").alias(moment), mark))


def holdings_on(days: DataFrame, positions: DataFrame) -> DataFrame:
    """(ord, date, instrument_id, quantity): the last snapshot at or before each day.

    An instrument missing from that snapshot is simply absent (zero).
    """
    snapshot = latest_at_or_before(days, positions, "date", "as_of").filter("as_of is not null")
    return (days.select("ord", "date").join(snapshot, "date").join(positions, "as_of")
            .select("ord", "date", "instrument_id", "quantity"))


def sized_quantities(targets: DataFrame, values: DataFrame) -> DataFrame:
    """Quantity that gives each instrument its target value; a missing price is an error."""
    usable = F.coalesce(F.col("unit_value"), F.raise_error(
        F.concat(F.lit("cannot size the book, no price for "), F.col("instrument_id"))).cast("double"))
    return (targets.join(values, "instrument_id", "left")
            .select("instrument_id", "target", (F.col("target") / usable).alias("quantity")))
