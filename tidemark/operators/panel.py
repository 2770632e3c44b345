"""Price panels in long form: carried-forward levels, market days, proxies (R1, R2, R4; W2, J11, J12).

A panel is never a dense grid here. Each observation is valid for an interval of calendar rows,
from its own row up to the fill limit or the row before the next observation, and is exploded over
that interval. One shuffle by instrument; no cross join with the calendar, no null rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import dates as D


def usable(value: Column) -> Column:
    """Missing is NULL, never NaN: NaN would compare as the largest number."""
    return value.isNotNull() & ~F.isnan(value)


def spread_forward(obs: DataFrame, keys: list[str], row: str, limit: int, last_row: Column) -> DataFrame:
    """Forward fill by at most ``limit`` rows: explode each observation over the rows it is valid for.

    ``row`` is the observation's calendar row number; it is replaced by each valid row number.
    """
    following = F.lead(row).over(W.partitionBy(*keys).orderBy(row))
    return (obs.withColumn("_until", F.least(F.col(row) + limit, following - 1, last_row))
            .filter(F.col("_until") >= F.col(row))  # sequence() would count down
            .withColumn(row, F.explode(F.sequence(F.col(row), F.col("_until"))))
            .drop("_until"))


def filled_levels(market: DataFrame, as_of: Column, limit: int, field: str = "close") -> DataFrame:
    """(instrument_id, date, level) on every weekday up to ``as_of``, gaps of up to ``limit`` days filled.

    Weekend observations are dropped before filling.
    """
    obs = (market.filter((F.col("date") <= as_of) & D.is_business_day(F.col("date")) & usable(F.col(field)))
           .select("instrument_id", D.business_ordinal(F.col("date")).alias("b"), F.col(field).alias("level")))
    return (spread_forward(obs, ["instrument_id"], "b", limit, D.business_ordinal(as_of))
            .select("instrument_id", D.business_date(F.col("b")).alias("date"), "level"))


def market_days(market: DataFrame, instruments: DataFrame, as_of: Column, min_share: float) -> DataFrame:
    """(ord, date): weekdays on which enough instruments have a real (unfilled) row.

    The ordinal needs one ordered pass, over the distinct dates only.
    """
    wanted = instruments.select((F.count(F.lit(1)) * F.lit(min_share)).alias("n")).scalar()
    days = (market.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
            .filter((F.col("n") >= wanted) & D.is_business_day(F.col("date")) & (F.col("date") <= as_of)))
    return days.select((F.row_number().over(W.orderBy("date")) - 1).alias("ord"), "date")


def on_market_days(panel: DataFrame, days: DataFrame) -> DataFrame:
    """Restrict a filled panel to market days; filling comes first, so order matters."""
    return panel.join(days, "date")


def proxy_levels(references: DataFrame, days: DataFrame, as_of: Column, limit: int,
                 purposes: list[str]) -> DataFrame:
    """(purpose, instrument_id, ord, date, level): proxy series on market days (R2).

    The fill runs over the union of market days and the purpose's own dates, so a proxy date outside
    the market calendar can feed the fill and uses up its limit.
    """
    refs = (references.filter(F.col("purpose").isin(purposes) & (F.col("date") <= as_of) & usable(F.col("value")))
            .select("purpose", "instrument_id", "date", F.col("value").alias("level")))
    own_dates = refs.select("purpose", "date").distinct()
    purpose_days = days.withColumn("purpose", F.explode(F.array(*[F.lit(p) for p in purposes])))
    union = (own_dates.join(purpose_days, ["purpose", "date"], "full")
             .withColumn("u", F.row_number().over(W.partitionBy("purpose").orderBy("date"))))
    obs = refs.join(union.select("purpose", "date", "u"), ["purpose", "date"]).drop("date")
    spread = spread_forward(obs, ["purpose", "instrument_id"], "u", limit, F.col("u") + limit)
    return (spread.join(union.filter(F.col("ord").isNotNull()), ["purpose", "u"])
            .select("purpose", "instrument_id", "ord", "date", "level"))
