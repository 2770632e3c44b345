"""Rolling backtest and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.config import RiskRules
from tidemark.functions import stats as S
from tidemark.functions.stats import whole_sum

# Plus factors of the 250-day table, by number of exceptions.
PLUS_FACTORS = {5: 0.40, 6: 0.50, 7: 0.65, 8: 0.75, 9: 0.85}


def realised_pnl(book: DataFrame, moves: DataFrame) -> DataFrame:
    """(ord, pnl): yesterday's positions and levels under today's moves."""
    today = moves.select((F.col("ord") - 1).alias("k"), F.col("ord"), "instrument_id", "growth")
    return (book.join(today, ["k", "instrument_id"]).groupBy("ord")
            .agg(whole_sum(F.col("mv") * F.col("growth")).alias("pnl")))


def backtest_rows(calendar: DataFrame, held: DataFrame, forecasts: DataFrame, realised: DataFrame,
                  start: str | None = None) -> DataFrame:
    """(date, method, var95, var99, pnl): forecast from data up to the day before (B1).

    A day is tested when every factor moved on it and a position snapshot existed the day before
    (``held``: ordinals with one). A forecast that cannot be valued leaves nulls.
    """
    days = calendar.filter("complete")
    if start:
        days = days.filter(F.col("date") >= F.lit(start).cast("date"))
    days = days.join(held.select((F.col("k") + 1).alias("ord")), "ord", "left_semi")
    wide = (forecasts.groupBy((F.col("k") + 1).alias("ord"), "method")
            .agg(F.max(F.when(F.col("measure") == "VaR95", F.col("value"))).alias("var95"),
                 F.max(F.when(F.col("measure") == "VaR99", F.col("value"))).alias("var99")))
    return (days.select("ord", "date").join(realised, "ord", "left").join(wide, "ord")
            .select("date", "method", "var95", "var99", "pnl"))


def exception(pnl: Column, var: Column) -> Column:
    """1 when the loss is strictly larger than the forecast (B2)."""
    return F.when(-pnl > var, 1).otherwise(0)


def kupiec(n: Column, x: Column, p: float) -> Column:
    """Likelihood ratio of the proportion-of-failures test; null without observations."""
    share = x / n
    null = S.x_log_y(n - x, F.lit(1 - p)) + S.x_log_y(x, F.lit(p))
    alt = S.x_log_y(n - x, 1 - share) + S.x_log_y(x, share)
    return F.when(n > 0, -2 * (null - alt))


def christoffersen(n00: Column, n01: Column, n10: Column, n11: Column) -> Column:
    """Likelihood ratio of the independence test; 0 when no exception follows any day."""
    share = (n01 + n11) / (n00 + n01 + n10 + n11)
    after_calm = F.when(n00 + n01 > 0, n01 / (n00 + n01)).otherwise(0.0)
    after_hit = F.when(n10 + n11 > 0, n11 / (n10 + n11)).otherwise(0.0)
    null = S.x_log_y(n00 + n10, 1 - share) + S.x_log_y(n01 + n11, share)
    alt = (S.x_log_y(n00, 1 - after_calm) + S.x_log_y(n01, after_calm)
           + S.x_log_y(n10, 1 - after_hit) + S.x_log_y(n11, after_hit))
    return F.when(n01 + n11 == 0, 0.0).otherwise(-2 * (null - alt))


def zone(n: Column, x: Column, p: float = 0.01) -> Column:
    """Traffic-light zone from the binomial probability."""
    cdf = S.binomial_cdf(x, n, p)
    return (F.when((x > 0) & (cdf >= 0.9999 - 1e-9), "red").when(cdf >= 0.95 - 1e-9, "yellow").otherwise("green"))


def plus_factor(n: Column, x: Column, zone_name: Column) -> Column:
    """Capital plus factor, defined for 250 observations only."""
    table = F.create_map(*[F.lit(v) for pair in PLUS_FACTORS.items() for v in pair])
    return F.when(n == 250, F.when(zone_name == "green", 0.0).when(zone_name == "red", 1.0).otherwise(
        table[x.cast("int")]))


def transitions(rows: DataFrame) -> DataFrame:
    """Per method and level: observations, exceptions and the four transition counts.

    The first day is only a previous state. One ordered pass per method over its tested days.
    """
    by_day = W.partitionBy("method").orderBy("date")
    flags = rows.select("date", "method", "pnl", exception(F.col("pnl"), F.col("var99")).alias("e99"),
                        exception(F.col("pnl"), F.col("var95")).alias("e95"))
    both = flags.select("date", "method", "e99", "e95", F.lag("e99").over(by_day).alias("p99"),
                        F.lag("e95").over(by_day).alias("p95"))
    long = both.select("method", F.explode(F.array(
        F.struct(F.lit("99").alias("level"), F.lit(0.01).alias("p"), F.col("e99").alias("e"), F.col("p99").alias("b")),
        F.struct(F.lit("95").alias("level"), F.lit(0.05).alias("p"), F.col("e95").alias("e"), F.col("p95").alias("b")),
    )).alias("x")).select("method", "x.*")
    pair = lambda b, e: F.count(F.when((F.col("b") == b) & (F.col("e") == e), 1))
    return (long.groupBy("method", "level", "p")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("exceptions"), pair(0, 0).alias("n00"),
                 pair(0, 1).alias("n01"), pair(1, 0).alias("n10"), pair(1, 1).alias("n11")))


def coverage_tests(counts: DataFrame) -> DataFrame:
    """Kupiec, Christoffersen and joint test per method and level."""
    n, x = F.col("n"), F.col("exceptions")
    by_level = F.when(F.col("level") == "99", kupiec(n, x, 0.01)).otherwise(kupiec(n, x, 0.05))
    ind = christoffersen(F.col("n00"), F.col("n01"), F.col("n10"), F.col("n11"))
    return (counts.withColumn("expected", n * F.col("p")).withColumn("kupiec_lr", by_level)
            .withColumn("christoffersen_lr", ind)
            .withColumn("kupiec_p", S.chi2_upper_1(F.col("kupiec_lr")))
            .withColumn("christoffersen_p", S.chi2_upper_1(F.col("christoffersen_lr")))
            .withColumn("cc_p", S.chi2_upper_2(F.col("kupiec_lr") + F.col("christoffersen_lr")))
            .select("method", "level", "n", "exceptions", "expected", "kupiec_lr", "kupiec_p", "christoffersen_lr",
                    "christoffersen_p", "cc_p"))


def last_days(rows: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` rows of every method."""
    recent = W.partitionBy("method").orderBy(F.col("date").desc())
    return rows.withColumn("_rn", F.row_number().over(recent)).filter(F.col("_rn") <= n).drop("_rn")


def recent_zone(rows: DataFrame, rules: RiskRules) -> DataFrame:
    """Exceptions, zone and plus factor over the last days."""
    tail = (last_days(rows, rules.traffic_light_days).groupBy("method")
            .agg(F.count(F.lit(1)).alias("last_n"),
                 F.sum(exception(F.col("pnl"), F.col("var99"))).alias("last_exceptions")))
    named = tail.withColumn("zone", zone(F.col("last_n"), F.col("last_exceptions")))
    return named.withColumn("plus_factor", plus_factor(F.col("last_n"), F.col("last_exceptions"), F.col("zone")))


def worst_days(rows: DataFrame) -> DataFrame:
    """Worst P&L and its first date per method."""
    worst = rows.filter("pnl is not null").groupBy("method").agg(
        F.min(F.struct("pnl", "date")).alias("w"))
    return worst.select("method", F.col("w.date").alias("worst_day"), F.col("w.pnl").alias("worst_pnl"))


def backtest_summary(rows: DataFrame, rules: RiskRules) -> DataFrame:
    """One row per method: the tests at 99% and (suffix _95) at 95%, recent zone, worst day."""
    both = coverage_tests(transitions(rows))
    tests = both.filter(F.col("level") == "99").drop("level")
    lower = both.filter(F.col("level") == "95").drop("level", "n")
    tests = tests.join(lower.select("method", *(F.col(c).alias(f"{c}_95") for c in lower.columns if c != "method")), "method")
    return tests.join(recent_zone(rows, rules), "method").join(worst_days(rows), "method")


def mark_to_market_check(holdings: DataFrame, values: DataFrame, moves: DataFrame, dividends: DataFrame,
                         instruments: DataFrame) -> DataFrame:
    """Per day, P&L by revaluation against change in value plus dividends, for instruments without a proxy."""
    plain = instruments.filter(F.col("returns_proxy").isNull()).select("instrument_id")
    today = values.select("ord", "date", "instrument_id", F.col("unit_value").alias("uv1"), "level")
    before = values.select((F.col("ord") + 1).alias("ord"), "instrument_id", F.col("unit_value").alias("uv0"))
    held = holdings.select((F.col("ord") + 1).alias("ord"), "instrument_id", "quantity")
    paid = dividends.groupBy("instrument_id", F.col("ex_date").alias("date")).agg(F.sum("amount").alias("paid"))
    move = moves.select("ord", "instrument_id", "growth")
    equity = instruments.filter(F.col("asset_class") == "equity").select("instrument_id", F.lit(True).alias("equity"))
    rows = (held.join(plain, "instrument_id", "left_semi").join(before, ["ord", "instrument_id"])
            .join(today, ["ord", "instrument_id"]).join(move, ["ord", "instrument_id"])
            .join(paid, ["instrument_id", "date"], "left").join(equity, "instrument_id", "left"))
    income = F.when(F.col("equity"), F.coalesce(F.col("paid"), F.lit(0.0)) * F.col("uv1") / F.col("level")).otherwise(0.0)
    return (rows.groupBy("date")
            .agg(F.sum(F.col("quantity") * F.col("uv0") * F.col("growth")).alias("revalued"),
                 F.sum(F.col("quantity") * (F.col("uv1") - F.col("uv0") + income)).alias("marked")))
