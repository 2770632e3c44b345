"""Scenario P&L cubes and the measures read from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import RiskRules, measure_name, normal_density, normal_quantile
from tidemark.functions.stats import whole_sum
from tidemark.operators import tail as T


BLOCK = 256  # ordinals to a block of the band join


def window_start(k: Column, window_days: int) -> Column:
    """First ordinal of the window ending at ``k``; row 0 has no return and never enters."""
    return F.greatest(F.lit(1), k - window_days + 1)


def scenario_moves(moves: DataFrame, calendar: DataFrame) -> DataFrame:
    """Moves of complete scenario days only, ordinal renamed to ``s``."""
    complete = calendar.filter("complete").select("ord")
    return moves.join(complete, "ord").select(F.col("ord").alias("s"), "instrument_id", "growth", "linear")


def scenario_cube(book: DataFrame, scenarios: DataFrame, groups: list[str], window_days: int) -> DataFrame:
    """P&L of every group under every scenario of its window.

    ``book`` has the groups, the valuation ordinal ``k``, instrument_id and mv. The join is on the
    instrument with the window as a residual; instruments are summed before anything is sorted.
    Scenarios are laid out by ``s`` first: when the book side is small enough to be broadcast, all
    instruments of a scenario meet in one task and the sum needs no further shuffle; otherwise the join
    shuffles by instrument and block and the partial sums shrink the (k, s) shuffle. The number of tasks is given
    because the input is small for the work it causes: sized by bytes it would run in one task.

    Both sides carry a block of ``BLOCK`` ordinals in the key, a valuation day once for each block of its window: a day
    meets about one window of scenarios, however long the history, and no instrument is a hot key.
    """
    tasks = int(scenarios.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = lambda ord_: F.floor(ord_ / BLOCK).cast("int")
    laid_out = scenarios.repartition(tasks, "s").withColumn("_block", block(F.col("s")))
    spread = book.withColumn("_block", F.explode(F.sequence(block(window_start(F.col("k"), window_days)), block(F.greatest(F.col("k"), F.lit(1))))))
    inside = F.col("s").between(window_start(F.col("k"), window_days), F.col("k"))
    keys = list(dict.fromkeys([*groups, "k", "s"]))
    return (laid_out.join(spread, ["instrument_id", "_block"]).filter(inside)
            .groupBy(*keys)
            .agg(whole_sum(F.col("mv") * F.col("growth")).alias("pnl"),
                 whole_sum(F.col("mv") * F.col("linear")).alias("linear")))


def with_age(cube: DataFrame, calendar: DataFrame, window_days: int) -> DataFrame:
    """Add ``n`` (retained scenarios of the window) and ``age`` (retained rows newer than this one).

    Both come from the running count on the calendar, a table of dates.
    """
    counts = calendar.select("ord", "c")
    before = window_start(F.col("k"), window_days) - 1
    return (cube.withColumn("_before", before)
            .join(counts.select(F.col("ord").alias("k"), F.col("c").alias("_ck")), "k")
            .join(counts.select(F.col("ord").alias("_before"), F.col("c").alias("_cb")), "_before")
            .join(counts.select(F.col("ord").alias("s"), F.col("c").alias("_cs")), "s")
            .withColumn("n", F.col("_ck") - F.col("_cb")).withColumn("age", F.col("_ck") - F.col("_cs"))
            .drop("_before", "_ck", "_cb", "_cs"))


def weighted(cube: DataFrame, rules: RiskRules) -> DataFrame:
    """One weight column per method, named w_<method>."""
    return cube.select("*", *[T.scenario_weight(m, F.col("age"), F.col("n")).alias(f"w_{m.name}") for m in rules.methods])


def measures(aged: DataFrame, groups: list[str], rules: RiskRules) -> DataFrame:
    """(groups..., method, measure, value) for every method: two VaR levels and one ES."""
    history = [m for m in rules.methods if m.kind == "history"]
    normal = [m for m in rules.methods if m.kind == "normal"]
    cum = T.cumulate(weighted(aged, rules), groups, [f"w_{m.name}" for m in history])
    aggs, rows = [], []

    def emit(method: str, measure: str, column: Column) -> None:
        name = f"{method}_{measure}"
        aggs.append(column.alias(name))
        rows.append(F.struct(F.lit(method).alias("method"), F.lit(measure).alias("measure"), F.col(name).alias("value")))

    for m in history:
        for level in rules.confidence:
            emit(m.name, measure_name("VaR", level), T.value_at_risk(f"w_{m.name}", level))
        emit(m.name, measure_name("ES", rules.es_confidence), T.expected_shortfall(f"w_{m.name}", rules.es_confidence))
    for m in normal:
        sigma = F.sqrt(F.sum(F.col(f"w_{m.name}") * F.col("linear") * F.col("linear")))
        for level in rules.confidence:
            emit(m.name, measure_name("VaR", level), normal_quantile(level) * sigma)
        es = rules.es_confidence
        emit(m.name, measure_name("ES", es), sigma * normal_density(normal_quantile(es)) / (1 - es))
    return (cum.groupBy(*groups).agg(*aggs)
            .select(*groups, F.explode(F.array(*rows)).alias("row")).select(*groups, "row.*"))


def desk_measures(desk_cube: DataFrame, total_cube: DataFrame, rules: RiskRules) -> DataFrame:
    """(desk, VaR99_standalone, ES975_contribution) by the primary method.

    Contributions use the total's tail weights, so they add up to the total ES.
    """
    w = f"w_{rules.primary}"
    es = rules.es_confidence
    alone = (T.cumulate(weighted(desk_cube, rules), ["desk"], [w]).groupBy("desk")
             .agg(T.value_at_risk(w, 0.99).alias("VaR99_standalone")))
    tails = (T.cumulate(weighted(total_cube, rules), ["k"], [w])
             .select("s", T.tail_weight(w, es).alias("t")).filter("t > 0"))
    parts = (desk_cube.join(tails, "s").groupBy("desk")
             .agg((F.sum(F.col("t") * -F.col("pnl")) / (1 - es)).alias("ES975_contribution")))
    return alone.join(parts, "desk", "left")


def horizon_scaled(totals: DataFrame, days: int = 10) -> DataFrame:
    """VaR times the square root of the horizon."""
    return (totals.filter(F.col("measure") == "VaR99")
            .select("method", (F.col("value") * (days ** 0.5)).alias("scaled")))


def diversification_benefit(desks: DataFrame, totals: DataFrame, primary: str) -> DataFrame:
    """Sum of stand-alone desk VaRs, total VaR and their difference."""
    whole = totals.filter((F.col("method") == primary) & (F.col("measure") == "VaR99"))
    alone = desks.agg(F.sum("VaR99_standalone").alias("standalone"))
    return alone.select("standalone", whole.select("value").scalar().alias("total")).withColumn(
        "benefit", F.col("standalone") - F.col("total"))


def _block_products(key: tuple, group: pa.Table) -> pa.Table:
    """Products of two blocks of factors: one matrix product."""
    ids, side, vectors = group.column("id").to_pylist(), group.column("side").to_numpy(), np.array(group.column("v").to_pylist())
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    product = vectors[left] @ vectors[right].T
    rows, cols = np.divmod(np.arange(product.size), len(right))
    a, b = np.array(ids, dtype=object)[left][rows], np.array(ids, dtype=object)[right][cols]
    keep = (a <= b) if key[0].as_py() == key[1].as_py() else np.ones(len(a), dtype=bool)
    turn = a > b
    return pa.table({"a_id": pa.array(np.where(turn, b, a)[keep], pa.string()), "b_id": pa.array(np.where(turn, a, b)[keep], pa.string()), "cov": product.ravel()[keep]})


def ewma_covariance(returns: DataFrame, decay: float, block: int = 512) -> DataFrame:
    """Zero-mean decaying covariance of factor pairs.

    ``returns`` has s, instrument_id, r, age, n of complete scenario days. Each factor becomes one vector over the window, weighted by
    the root of the scenario's weight. Factors are dealt into blocks of about ``block``, as many as their number asks for; a task takes one
    pair of blocks, two matrices of block x window numbers, and multiplies them whole. Both the work of a task and what it holds are
    bounded for any number of factors. The matrix is only built when it is asked for; the parametric sigma uses the linear P&L per
    scenario instead.
    """
    w = F.pow(F.lit(decay), F.col("age")) * (1 - decay) / (1 - F.pow(F.lit(decay), F.col("n")))
    blocks = max(1, -(-returns.select("instrument_id").distinct().count() // block))
    ordered = F.array_sort(F.collect_list(F.struct("s", "wr")))
    vectors = (returns.withColumn("wr", F.col("r") * F.sqrt(w)).groupBy("instrument_id").agg(ordered.alias("v"))
               .select(F.col("instrument_id").alias("id"), F.col("v.wr").alias("v"), F.pmod(F.hash("instrument_id"), F.lit(blocks)).alias("own")))
    left = vectors.select(F.col("own").alias("ba"), F.explode(F.sequence("own", F.lit(blocks - 1))).alias("bb"), "id", F.lit(0).alias("side"), "v")
    right = vectors.select(F.explode(F.sequence(F.lit(0), "own")).alias("ba"), F.col("own").alias("bb"), "id", F.lit(1).alias("side"), "v")
    return left.unionByName(right).groupBy("ba", "bb").applyInArrow(_block_products, "a_id string, b_id string, cov double")
