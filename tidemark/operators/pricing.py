"""Valuation in the base currency and full revaluation through log value moves.

A unit is worth local value / FX rate, where a price is its own local value, a yield prices a
zero-coupon bond and an FX unit is worth 1 / rate. Under a scenario every unit value is multiplied by
exp(x), so P&L = market value * (exp(x) - 1) and revaluing a book is one equi-join and a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import RunConfig

QUOTES = ("price", "yield_pct", "fx")


def fx_instrument(cfg: RunConfig, currency: Column, quote: Column) -> Column:
    """The instrument that converts ``currency`` to base; null for base-currency items and FX itself."""
    pairs = [F.lit(v) for pair in cfg.fx_map for v in pair]
    mapped = F.create_map(*pairs)[currency] if pairs else F.lit(None).cast("string")
    missing = F.raise_error(F.concat(F.lit("no FX instrument for currency "), currency)).cast("string")
    return (F.when((quote == "fx") | (currency == cfg.risk.base_currency), F.lit(None).cast("string"))
            .otherwise(F.coalesce(mapped, missing)))


def priced_as(instruments: DataFrame, cfg: RunConfig) -> DataFrame:
    """Instrument attributes that decide its value: quote, tenor, FX instrument. Unknown quotes fail."""
    checked = F.when(F.col("quote").isin(*QUOTES), F.col("quote")).otherwise(
        F.raise_error(F.concat(F.lit("unknown quote "), F.col("quote"))).cast("string"))
    return instruments.select("instrument_id", "asset_class", "desk", checked.alias("quote"), "tenor_years",
                              fx_instrument(cfg, F.col("currency"), F.col("quote")).alias("fx_id"))


def attach_fx(frame: DataFrame, attributes: DataFrame, value: str, on: list[str]) -> DataFrame:
    """Add quote attributes and the same row's FX value as ``fx``.

    The FX side holds one row per currency instrument and ``on`` key; its size is known to the
    optimizer, which broadcasts it or falls back to a skew-handled shuffle join.
    """
    currencies = attributes.select(F.col("fx_id").alias("instrument_id")).distinct().filter("instrument_id is not null")
    fx = (frame.join(currencies, "instrument_id", "left_semi")
          .select(*on, F.col("instrument_id").alias("fx_id"), F.col(value).alias("fx")))
    return frame.join(attributes, "instrument_id").join(fx, [*on, "fx_id"], "left")


def unit_value(level: Column, quote: Column, tenor: Column, needs_fx: Column, fx: Column) -> Column:
    local = F.when(quote == "price", level).when(quote == "yield_pct", F.exp(-level / 100 * tenor))
    return F.when(quote == "fx", 1 / level).when(needs_fx, local / fx).otherwise(local)


def unit_values(levels: DataFrame, attributes: DataFrame, on: list[str]) -> DataFrame:
    """Levels plus ``unit_value``; null when the level or the needed FX rate is missing."""
    return (attach_fx(levels, attributes, "level", on)
            .withColumn("unit_value", unit_value(F.col("level"), F.col("quote"), F.col("tenor_years"),
                                                 F.col("fx_id").isNotNull(), F.col("fx"))))


def value_move(r: Column, quote: Column, tenor: Column, needs_fx: Column, fx: Column) -> Column:
    """Log move of the unit value for a factor move ``r`` and its FX factor move."""
    own = (F.when(quote == "price", r).when(quote == "yield_pct", -r * tenor / 100).when(quote == "fx", -r))
    return F.when(needs_fx, own - fx).otherwise(own)


def shocked_level(level: Column, r: Column, quote: Column) -> Column:
    """Level after a move: points for yields, relative otherwise."""
    return F.when(quote == "yield_pct", level + r).otherwise(level * F.exp(r))


def bump_sensitivity(quote: Column, tenor: Column, h: float) -> Column:
    """Relative value change per unit of a small one-sided bump of the own factor."""
    return (F.when(quote == "price", F.lit(h)).when(quote == "yield_pct", -tenor * h / 100)
            .when(quote == "fx", F.lit(-h)))


def value_moves(returns: DataFrame, attributes: DataFrame, h: float) -> DataFrame:
    """(ord, date, instrument_id, x, growth, linear): the table every risk figure reads.

    growth = exp(x) - 1 revalues in full; linear is the first-order move by bumped sensitivities,
    own factor and FX factor separately.
    """
    needs_fx = F.col("fx_id").isNotNull()
    own = F.expm1(bump_sensitivity(F.col("quote"), F.col("tenor_years"), h)) / h * F.col("r")
    other = F.when(needs_fx, F.expm1(F.lit(-h)) / h * F.col("fx")).otherwise(0.0)
    return (attach_fx(returns, attributes, "r", ["ord"])
            .withColumn("x", value_move(F.col("r"), F.col("quote"), F.col("tenor_years"), needs_fx, F.col("fx")))
            .select("ord", "date", "instrument_id", "r", "x", F.expm1("x").alias("growth"),
                    (own + other).alias("linear")))


def is_absolute_quote(quote: Column) -> Column:
    """Yields move in points, everything else in logs."""
    return quote == "yield_pct"
