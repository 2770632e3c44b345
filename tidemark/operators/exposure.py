"""Exposure tables, attention rules and headline facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import RiskRules


def position_table(book: DataFrame, instruments: DataFrame) -> DataFrame:
    """Market value and share of gross of every position today.

    The denominator is a one-row aggregate, not a window over all positions.
    """
    gross = book.agg(F.sum(F.abs("mv"))).scalar()
    return book.join(instruments.select("instrument_id", "name"), "instrument_id").select(
        "instrument_id", "name", "desk", "mv", (F.abs("mv") / gross).alias("share_of_gross"))


def desk_exposure(book: DataFrame) -> DataFrame:
    """(desk, long, short, net, positions) with a 'total' row."""
    mv = F.col("mv")
    return (book.rollup("desk").agg(F.sum(F.when(mv > 0, mv).otherwise(0.0)).alias("long"), F.sum(F.when(mv < 0, mv).otherwise(0.0)).alias("short"),
                                    F.sum("mv").alias("net"), F.count("mv").alias("positions"), F.grouping_id().alias("g"))
            .select(F.when(F.col("g") == 1, "total").otherwise(F.col("desk")).alias("desk"), "long", "short", "net", "positions"))


def attention_items(positions: DataFrame, explain: DataFrame, summary: DataFrame, controls: DataFrame, rules: RiskRules) -> DataFrame:
    """(rule, subject, value, threshold): everything above its review level."""
    top = positions.orderBy(F.col("share_of_gross").desc(), "instrument_id").limit(1).filter(
        F.col("share_of_gross") > rules.concentration_share).select(
        F.lit("concentration").alias("rule"), F.col("instrument_id").alias("subject"), F.col("share_of_gross").alias("value"),
        F.lit(rules.concentration_share).alias("threshold"))
    pick = lambda c: F.max(F.when(F.col("component") == c, F.col("value")))
    ends = explain.filter(F.col("measure") == "VaR99").agg(pick("current").alias("cur"), pick("previous").alias("prev"))
    change = (F.col("cur") - F.col("prev"))
    moved = ends.filter(F.abs(change) > rules.var_move_share * F.col("prev")).select(
        F.lit("var_move").alias("rule"), F.lit("VaR99").alias("subject"), (change / F.col("prev")).alias("value"),
        F.lit(rules.var_move_share).alias("threshold"))
    zones = summary.filter(F.col("zone") != "green").select(
        F.concat(F.lit("zone_"), F.col("zone")).alias("rule"), F.col("method").alias("subject"), F.col("last_exceptions").cast("double").alias("value"),
        F.col("last_n").cast("double").alias("threshold"))
    clustered = summary.filter((F.col("method") == rules.primary) & (F.col("christoffersen_p") < rules.independence_p)).select(
        F.lit("independence").alias("rule"), F.col("method").alias("subject"), F.col("christoffersen_p").alias("value"),
        F.lit(rules.independence_p).alias("threshold"))
    flagged = controls.filter(F.col("status").isin("WARN", "FAIL")).select(
        F.concat(F.lit("control_"), F.lower("status")).alias("rule"), F.col("control").alias("subject"), F.col("n_affected").cast("double").alias("value"),
        F.lit(0.0).alias("threshold"))
    out = top
    for part in (moved, zones, clustered, flagged):
        out = out.unionByName(part)
    return out


def headline_facts(totals: DataFrame, desks: DataFrame, explain: DataFrame, historical: DataFrame, hypothetical: DataFrame,
                   worst_positions: DataFrame, rules: RiskRules) -> DataFrame:
    """(fact, subject, value): the numbers a daily summary quotes.

    ``hypothetical``: scenario, pnl. ``worst_positions``: scenario, rank, instrument_id of historical scenarios.
    """
    level = lambda m: totals.filter((F.col("method") == rules.primary) & (F.col("measure") == m)).select("value").scalar()
    causes = explain.filter((F.col("measure") == "VaR99") & ~F.col("component").isin("previous", "current"))
    driver = causes.agg(F.max_by(F.struct("component", "value"), F.abs("value")).alias("x")).select(
        F.lit("largest_driver").alias("fact"), F.col("x.component").alias("subject"), F.col("x.value").alias("value"))
    shares = desks.select("desk", (F.col("ES975_contribution") / level("ES975")).alias("share"))
    ranked = shares.orderBy(F.col("share").desc(), "desk").limit(2).agg(
        F.sort_array(F.collect_list(F.struct("share", "desk")), asc=False).alias("r"))
    leaders = ranked.select(F.explode(F.array(
        F.struct(F.lit("largest_desk_share").alias("fact"), F.get("r", F.lit(0)).alias("x")),
        F.struct(F.lit("second_desk_share").alias("fact"), F.get("r", F.lit(1)).alias("x")))).alias("f")).select(
        "f.fact", F.col("f.x.desk").alias("subject"), F.col("f.x.share").alias("value"))
    reducing = shares.agg(F.min(F.struct("share", "desk")).alias("x")).filter("x.share < 0").select(
        F.lit("reducing_desk").alias("fact"), F.col("x.desk").alias("subject"), F.col("x.share").alias("value"))
    available = historical.filter("available")
    worst = available.agg(F.min(F.struct("pnl", "scenario", "worst_pnl")).alias("x"))
    worst_rows = worst.select(F.explode(F.array(
        F.struct(F.lit("worst_historical").alias("fact"), F.col("x.scenario").alias("subject"), F.col("x.pnl").alias("value")),
        F.struct(F.lit("worst_historical_point").alias("fact"), F.col("x.scenario").alias("subject"), F.col("x.worst_pnl").alias("value")),
        F.struct(F.lit("worst_historical_var_multiple").alias("fact"), F.col("x.scenario").alias("subject"),
                 (F.abs("x.pnl") / level("VaR99")).alias("value")))).alias("f")).select("f.*")
    shock = hypothetical.agg(F.min(F.struct("pnl", "scenario")).alias("x")).select(
        F.lit("worst_hypothetical").alias("fact"), F.col("x.scenario").alias("subject"), F.col("x.pnl").alias("value"))
    common = worst_positions.filter("rank = 1").agg(F.count_distinct("instrument_id").alias("n"), F.max("instrument_id").alias("id")).select(
        F.lit("common_top_loss").alias("fact"), F.when(F.col("n") == 1, F.col("id")).alias("subject"), F.col("n").cast("double").alias("value"))
    out = driver
    for part in (leaders, reducing, worst_rows, shock, common):
        out = out.unionByName(part)
    return out
