"""Daily factor returns by instrument kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.panel import proxy_levels
from tidemark.operators.pricing import is_absolute_quote


def log_return(now: Column, before: Column, paid: Column | None = None) -> Column:
    """ln((now + paid) / before); null where it is not defined."""
    return F.ln(F.try_divide(now + paid if paid is not None else now, before))


def vendor_style_return(now: Column, before: Column, paid: Column) -> Column:
    """ln(now / (before - paid)): the convention of an adjusted close (W5); null where nothing is left after the dividend."""
    return F.ln(F.try_divide(now, before - paid))


def driving_series(levels: DataFrame, references: DataFrame, instruments: DataFrame, days: DataFrame,
                   as_of: Column, limit: int, stress: bool = False) -> DataFrame:
    """One series per instrument that its returns are taken from.

    Precedence: stress proxy (only when ``stress`` and it has data), return proxy, own level.
    """
    purposes = ["return_proxy", "stress_proxy"] if stress else ["return_proxy"]
    proxies = proxy_levels(references, days, as_of, limit, purposes)
    pick = F.when(F.col("returns_proxy").isNotNull(), F.lit("return_proxy")).otherwise(F.lit("level"))
    choice = instruments.select("instrument_id", "asset_class", "quote", "returns_proxy", "stress_proxy")
    if stress:
        loaded = (references.filter((F.col("purpose") == "stress_proxy") & (F.col("date") <= as_of))
                  .select("instrument_id", F.lit(True).alias("loaded")).distinct())
        choice = choice.join(loaded, "instrument_id", "left")
        pick = F.when(F.col("stress_proxy").isNotNull() & F.col("loaded"), F.lit("stress_proxy")).otherwise(pick)
    choice = choice.select("instrument_id", "asset_class", "quote", pick.alias("purpose"))
    own = levels.select(F.lit("level").alias("purpose"), "instrument_id", "ord", "date", "level")
    return own.unionByName(proxies).join(choice, ["instrument_id", "purpose"])


def factor_returns(series: DataFrame, dividends: DataFrame) -> DataFrame:
    """(ord, date, instrument_id, r); only rows with a return are kept, a missing row is a missing return.

    Equities earn the dividend, yields move in points, everything else in logs; proxies are always logs.
    A return needs the *previous market day*, so a hole in the series leaves two returns missing.
    """
    paid = (dividends.groupBy("instrument_id", F.col("ex_date").alias("date")).agg(F.sum("amount").alias("paid")))
    by_day = W.partitionBy("instrument_id").orderBy("ord")
    before, follows = F.lag("level").over(by_day), F.lag("ord").over(by_day) == F.col("ord") - 1
    own = F.col("purpose") == "level"
    move = (F.when(own & (F.col("asset_class") == "equity"),
                   log_return(F.col("level"), before, F.coalesce(F.col("paid"), F.lit(0.0))))
            .when(own & is_absolute_quote(F.col("quote")), F.col("level") - before)
            .otherwise(log_return(F.col("level"), before)))
    return (series.join(paid, ["instrument_id", "date"], "left")
            .select("ord", "date", "instrument_id", F.when(follows, move).alias("r"))
            .filter(F.col("r").isNotNull() & ~F.isnan("r")))


def completeness(days: DataFrame, returns: DataFrame, instruments: DataFrame) -> DataFrame:
    """Market calendar with ``complete`` (every factor moved) and ``c``, complete rows so far.

    The first row has no return and never counts. One ordered pass over dates only.
    """
    wanted = instruments.select(F.count(F.lit(1)).alias("n")).scalar()
    seen = returns.groupBy("ord").agg(F.count("r").alias("n"))
    full = F.coalesce(F.col("n"), F.lit(0)) == wanted
    return (days.join(seen, "ord", "left")
            .select("ord", "date", (full & (F.col("ord") > 0)).alias("complete"))
            .withColumn("c", F.sum(F.col("complete").cast("int")).over(
                W.orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)).cast("int")))


def dense_returns(days: DataFrame, returns: DataFrame, instruments: DataFrame) -> DataFrame:
    """Every (market day, instrument) with its return or null: what a stress path needs.

    Rows are generated per instrument from the last ordinal, not by joining with the calendar.
    """
    last = days.select(F.max("ord").alias("n")).scalar()
    grid = instruments.select("instrument_id", F.explode(F.sequence(F.lit(0), last)).alias("ord"))
    return grid.join(returns.select("ord", "instrument_id", "r"), ["ord", "instrument_id"], "left")
