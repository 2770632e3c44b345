"""Historical and hypothetical stress tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import PastWindow, Scenario
from tidemark.functions.stats import whole_sum
from tidemark.operators.positions import latest_at_or_before
from tidemark.operators.pricing import attach_fx, is_absolute_quote, value_move

WINDOW_SCHEMA = "scenario string, name string, short string, start string, until string, market_days int"
SHOCK_SCHEMA = ("scenario string, name string, short string, shock int, asset_class string, desk string, "
                "ids array<string>, pct double, pp double")


def windows_frame(spark: SparkSession, windows: tuple[PastWindow, ...]) -> DataFrame:
    rows = [(w.id, w.name, w.short, w.start, w.end, w.market_days) for w in windows]
    return (spark.createDataFrame(rows, WINDOW_SCHEMA)
            .withColumn("start", F.col("start").cast("date")).withColumn("until", F.col("until").cast("date")))


def shocks_frame(spark: SparkSession, scenarios: tuple[Scenario, ...]) -> DataFrame:
    rows = [(s.id, s.name, s.short, j, k.asset_class, k.desk, list(k.ids) if k.ids is not None else None, k.pct, k.pp)
            for s in scenarios for j, k in enumerate(s.shocks)]
    return spark.createDataFrame(rows, SHOCK_SCHEMA)


def resolve_windows(windows: DataFrame, days: DataFrame) -> DataFrame:
    """Add first/last ordinal and dates; null when the loaded history does not cover the window.

    A window without a day after its start, such as one past the data, is not available.

    Starts on the last market day at or before the start; an end date past the data clips to the last
    day, a number of market days does not.
    """
    at = days.select("date", "ord")
    start = latest_at_or_before(windows.select("start"), at, "start", "date")
    until = latest_at_or_before(windows.filter("until is not null").select("until"), at, "until", "date")
    named = (windows.join(start.withColumnRenamed("date", "first_date"), "start", "left")
             .join(at.select(F.col("date").alias("first_date"), F.col("ord").alias("first_ord")), "first_date", "left")
             .join(until.withColumnRenamed("date", "end_date"), "until", "left")
             .join(at.select(F.col("date").alias("end_date"), F.col("ord").alias("end_ord")), "end_date", "left"))
    last = F.coalesce(F.col("end_ord"), F.col("first_ord") + F.col("market_days"))
    placed = named.withColumn("last_ord", last).drop("end_date", "end_ord")
    return (placed.join(at.select(F.col("ord").alias("last_ord"), F.col("date").alias("last_date")), "last_ord", "left")
            .withColumn("available", F.coalesce(F.col("last_date").isNotNull() & (F.col("last_ord") > F.col("first_ord")), F.lit(False)))
            .select("scenario", "name", "short", "first_ord", "first_date", "last_ord", "last_date", "available"))


def path_moves(resolved: DataFrame, dense: DataFrame) -> DataFrame:
    """(scenario, ord, instrument_id, r, gap): cumulative factor moves after the start close.

    A missing move counts as zero and is flagged. Ordered per scenario and instrument.
    """
    span = (resolved.filter("available")
            .select("scenario", F.explode(F.sequence(F.col("first_ord") + 1, F.col("last_ord"))).alias("ord"))
            .filter(F.col("ord") > 0))
    upto = W.partitionBy("scenario", "instrument_id").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (span.join(dense, "ord")
            .select("scenario", "ord", "instrument_id", F.sum(F.coalesce(F.col("r"), F.lit(0.0))).over(upto).alias("r"),
                    F.col("r").isNull().alias("gap")))


def shocked_pnl(path: DataFrame, attributes: DataFrame, book: DataFrame, on: list[str]) -> DataFrame:
    """Revalue today's book under factor moves ``r`` keyed by ``on`` and instrument; null for an unpriced position."""
    moved = attach_fx(path, attributes, "r", on)
    x = value_move(F.col("r"), F.col("quote"), F.col("tenor_years"), F.col("fx_id").isNotNull(), F.col("fx"))
    return (moved.withColumn("growth", F.expm1(x)).join(book.select("instrument_id", "mv"), "instrument_id", "left")
            .withColumn("pnl", F.col("mv") * F.col("growth") + 0.0))


def historical_positions(path: DataFrame, attributes: DataFrame, book: DataFrame) -> DataFrame:
    """(scenario, ord, instrument_id, desk, pnl, gap) along every path day."""
    return (shocked_pnl(path, attributes, book, ["scenario", "ord"])
            .select("scenario", "ord", "instrument_id", "desk", "pnl", "gap"))


def historical_summary(resolved: DataFrame, path: DataFrame, days: DataFrame) -> DataFrame:
    """End P&L, worst point and its first date, instruments without data (R27). One row per window."""
    totals = path.groupBy("scenario", "ord").agg(whole_sum(F.col("pnl")).alias("pnl")).join(days.select("ord", "date"), "ord")
    ends = totals.groupBy("scenario").agg(F.max_by("pnl", "ord").alias("pnl"),
                                          F.min(F.when(F.col("pnl").isNotNull(), F.struct("pnl", "ord", "date"))).alias("w"))
    gaps = (path.filter("gap").select("scenario", "instrument_id").distinct().groupBy("scenario")
            .agg(F.count(F.lit(1)).alias("n_no_data")))
    return (resolved.join(ends, "scenario", "left").join(gaps, "scenario", "left")
            .select("scenario", "name", "short", "available", "first_date", "last_date", "pnl",
                    F.col("w.pnl").alias("worst_pnl"), F.col("w.date").alias("worst_date"),
                    F.when(F.col("available"), F.coalesce("n_no_data", F.lit(0))).alias("n_no_data")))


def shock_hits(shocks: DataFrame, instruments: DataFrame) -> DataFrame:
    """Shocks matched with the instruments they select; absent selectors match everything.

    Asset class is expanded to equality so that the match is an equi-join: a shock without one is
    exploded over the distinct asset classes.
    """
    classes = instruments.agg(F.collect_set("asset_class").alias("classes"))
    full = shocks.withColumn("class", F.explode(F.when(
        F.col("asset_class").isNotNull(), F.array("asset_class")).otherwise(classes.scalar())))
    i = instruments.select("instrument_id", F.col("asset_class").alias("class"), F.col("desk").alias("i_desk"), "quote")
    keep = ((F.col("desk").isNull() | (F.col("desk") == F.col("i_desk")))
            & (F.col("ids").isNull() | F.array_contains("ids", F.col("instrument_id"))))
    return full.join(i, "class").filter(keep)


def check_shocks(shocks: DataFrame, hits: DataFrame) -> DataFrame:
    """Shocks with an error message: nothing selected, or the wrong unit for a factor."""
    empty = (shocks.join(hits.select("scenario", "shock"), ["scenario", "shock"], "left_anti")
             .select("scenario", "shock", F.lit("selects no instruments").alias("error")))
    absolute = is_absolute_quote(F.col("quote"))
    unit = hits.filter((F.col("pp").isNotNull() & ~absolute) | (F.col("pp").isNull() & absolute)).select(
        "scenario", "shock", F.when(absolute, "pct shock on a yield, use pp").otherwise("pp shock on a price").alias("error"))
    return empty.unionByName(unit.distinct())


def shock_moves(hits: DataFrame, instruments: DataFrame, shocks: DataFrame) -> DataFrame:
    """(scenario, instrument_id, r): the summed move of every instrument, zero where not shocked.

    Wrong units raise while the moves are computed.
    """
    absolute = is_absolute_quote(F.col("quote"))
    wrong = F.raise_error(F.concat(F.lit("wrong shock unit for "), F.col("instrument_id"))).cast("double")
    move = (F.when(F.col("pp").isNotNull(), F.when(absolute, F.col("pp")).otherwise(wrong))
            .otherwise(F.when(absolute, wrong).otherwise(F.log1p(F.col("pct") / 100))))
    scenarios = shocks.agg(F.collect_set("scenario")).scalar()
    every = instruments.select("instrument_id", F.explode(scenarios).alias("scenario"))
    hit = hits.withColumn("move", move).groupBy("scenario", "instrument_id").agg(F.sum("move").alias("r"))
    return (every.join(hit, ["scenario", "instrument_id"], "left")
            .select("scenario", "instrument_id", F.coalesce("r", F.lit(0.0)).alias("r")))


def require_valid(shocks: DataFrame, hits: DataFrame) -> DataFrame:
    """Pass the hits through, failing the query when a shock selects nothing."""
    missing = shocks.join(hits.select("scenario", "shock"), ["scenario", "shock"], "left_anti")
    n = missing.agg(F.count(F.lit(1))).scalar()
    return hits.filter(F.when(n == 0, True).otherwise(F.raise_error(F.lit("a shock selects no instruments")).cast("boolean")))


def by_desk(position_pnl: DataFrame) -> DataFrame:
    """(scenario, desk, pnl) with a 'total' row per scenario."""
    return (position_pnl.rollup("scenario", "desk").agg(whole_sum(F.col("pnl")).alias("pnl"), F.grouping_id().alias("g"))
            .filter(F.col("g") <= 1)
            .select("scenario", F.when(F.col("g") == 1, "total").otherwise(F.col("desk")).alias("desk"), "pnl"))


def largest_losses(position_pnl: DataFrame, k: int = 3) -> DataFrame:
    """(scenario, rank, instrument_id, pnl): the k smallest P&Ls, positive or not (O2)."""
    order = W.partitionBy("scenario").orderBy(F.col("pnl").asc_nulls_last(), "instrument_id")
    return (position_pnl.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("scenario", "rank", "instrument_id", "pnl"))


def end_positions(path: DataFrame, resolved: DataFrame) -> DataFrame:
    """Position P&L on the last day of each window."""
    ends = resolved.filter("available").select("scenario", F.col("last_ord").alias("ord"))
    return path.join(ends, ["scenario", "ord"]).select("scenario", "instrument_id", "desk", "pnl")
