"""Stored tables in parts: digests, replaced ranges, empty reruns, failed loads; the backtest carried from day to day."""

import os

import pytest
from conftest import day
from pyspark.sql import functions as F

from tidemark.plans import pipeline
from tidemark.plans.daily import DailyRun
from tidemark.sources import tables
from tidemark.sources.parts import PartedTable

SCHEMA = "id string, day date, v double"
SF = "/root/testdata/sf0.01"


def rows_of(spark, *rows):
    return spark.createDataFrame([(i, day(d), float(v)) for i, d, v in rows], SCHEMA)


def table_at(spark, path):
    return PartedTable(spark, str(path), rows_of(spark).schema, ("id", "day"), "day")


def held(table):
    return sorted((r.id, str(r.day), r.v) for r in table.read().collect())


FIRST = (("a", "2020-01-06", 1), ("b", "2020-01-07", 2), ("a", "2020-02-03", 3), ("a", "2020-03-02", 4), ("b", "2020-03-20", 5))


def test_equal_months_are_not_touched_and_only_differing_ones_are_read(spark, tmp_path):
    table = table_at(spark, tmp_path / "t")
    assert table.read().count() == 0 and table.upsert(rows_of(spark)).parts == []
    assert table.upsert(rows_of(spark, *FIRST)).parts == [202001, 202002, 202003]
    again = table.upsert(rows_of(spark, *FIRST).repartition(3))
    assert not again and table.listing()[0] == 1
    news = rows_of(spark, *FIRST[:2], ("a", "2020-02-03", 3), ("a", "2020-03-02", 4.5), ("b", "2020-03-20", 5), ("c", "2020-04-01", 6))
    found = table.compare(news)
    assert found.touched == [202003, 202004]
    assert all("part=202003" in name for name in table.read(found.touched).inputFiles())
    change = table.upsert(news)
    assert change.parts == [202003, 202004] and change.first_day == day("2020-03-02")
    assert held(table) == [("a", "2020-01-06", 1.0), ("a", "2020-02-03", 3.0), ("a", "2020-03-02", 4.5), ("b", "2020-01-07", 2.0), ("b", "2020-03-20", 5.0), ("c", "2020-04-01", 6.0)]
    # a delivery of one row of a month keeps the others of it
    assert table.upsert(rows_of(spark, ("b", "2020-03-20", 7))).first_day == day("2020-03-20")
    assert ("a", "2020-03-02", 4.5) in held(table) and ("b", "2020-03-20", 7.0) in held(table)


def test_a_replaced_range_can_empty_months(spark, tmp_path):
    table = table_at(spark, tmp_path / "t")
    table.upsert(rows_of(spark, *FIRST))
    change = table.replace_range(rows_of(spark, ("z", "2020-02-04", 9)), last=day("2020-03-10"))
    assert change.parts == [202001, 202002, 202003] and change.first_day == day("2020-01-06")
    assert held(table) == [("b", "2020-03-20", 5.0), ("z", "2020-02-04", 9.0)] and sorted(table.listing()[1]) == [202002, 202003]
    table.replace_range(rows_of(spark), first=day("2020-03-01"))
    assert held(table) == [("z", "2020-02-04", 9.0)]
    assert not table.replace_range(rows_of(spark), first=day("2021-01-01"))
    table.replace_range(rows_of(spark))
    assert held(table) == [] and table.listing()[1] == {}
    table.upsert(rows_of(spark, *FIRST[:1]))
    assert held(table) == [("a", "2020-01-06", 1.0)]


def test_a_failed_load_changes_nothing(spark, tmp_path):
    table = table_at(spark, tmp_path / "t")
    table.upsert(rows_of(spark, *FIRST))
    before = held(table)
    broken = rows_of(spark, *FIRST).withColumn("v", F.when(F.col("day") > F.lit(day("2020-03-05")), F.raise_error(F.lit("no such row")).cast("double")).otherwise(F.col("v") + 1))
    with pytest.raises(Exception, match="no such row"):
        table.upsert(broken)
    assert held(table) == before
    # the same, when rows were written already and the list was not
    (rows_of(spark, ("q", "2020-01-06", 0)).withColumn("part", F.lit(202001)).write.partitionBy("part").parquet(f"{table.path}/rows/v2"))
    assert held(table) == before
    table.upsert(rows_of(spark, ("a", "2020-01-06", 8)))
    assert ("a", "2020-01-06", 8.0) in held(table) and not any(r[0] == "q" for r in held(table))


def test_of_equal_keys_one_stays_and_tables_without_days_have_buckets(spark, tmp_path):
    table = PartedTable(spark, str(tmp_path / "k"), spark.createDataFrame([], "id string, v double").schema, ("id",))
    table.upsert(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0)], "id string, v double"))
    assert sorted(map(tuple, table.read().collect())) == [("a", 2.0), ("b", 1.0)]
    assert table.replace_range(spark.createDataFrame([("c", 1.0)], "id string, v double")) and [tuple(r) for r in table.read().collect()] == [("c", 1.0)]


def test_results_of_a_rerun_replace_also_when_there_are_none(spark, tmp_path):
    path = str(tmp_path / "results")
    for run_id in ("r1", "r2"):
        tables.replace_rows(rows_of(spark, *FIRST), path, as_of=day("2020-03-20"), run_id=run_id)
    tables.replace_rows(rows_of(spark), path, as_of=day("2020-03-20"), run_id="r1")
    kept = spark.read.parquet(path)
    assert [(r.run_id, r["count"]) for r in kept.groupBy("run_id").count().collect()] == [("r2", 5)] and str(kept.first().as_of) == "2020-03-20"
    with pytest.raises(ValueError, match="cannot name"):
        tables.replace_rows(rows_of(spark), path, run_id="../r1")


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_backtest_days_are_carried_until_something_before_them_changes(spark, tmp_path):
    run = DailyRun(spark, SF)
    before = DailyRun(spark, SF, as_of=str(run.previous))
    shared = {n: getattr(run, n) for n in ("marks", "instruments", "market", "references", "dividends", "all_days")}
    before._done |= shared
    store = str(tmp_path / "store")
    first = pipeline.carried_backtest(before, store, pipeline.load(before, store).changed_from)
    n = first.rows.count()
    loaded = pipeline.load(run, store)
    assert loaded.changed_from > before.as_of and loaded.revisions.count() == 0
    assert {p for name in ("market_data", "trades") for p in loaded.changes[name].parts} == {run.as_of.year * 100 + run.as_of.month}
    second = pipeline.carried_backtest(run, store, loaded.changed_from)
    assert second.computed_from == run.as_of and second.rows.count() == n + 3
    assert not any(pipeline.load(run, store).changes.values()) and pipeline.carried_backtest(run, store, None).computed_from is None
    key = lambda r: (str(r.date), r.method)
    full = {key(r): (r.var95, r.var99, r.pnl) for r in run.backtest.collect()}
    stored = {key(r): (r.var95, r.var99, r.pnl) for r in second.rows.collect()}
    assert stored.keys() == full.keys()
    for k, values in full.items():
        assert all(a == b or abs(a - b) <= 1e-6 * max(1.0, abs(a)) for a, b in zip(values, stored[k]))
    # a price three hundred market days back is corrected: all days from there on are computed again, and none before
    changed_day = run.all_days.filter(F.col("ord") == run.k - 300).first()["date"]
    name = run.market.filter(F.col("date") == F.lit(changed_day)).agg(F.min("instrument_id").alias("i")).first()["i"]
    late = DailyRun(spark, SF)
    late._done |= {n: v for n, v in shared.items() if n not in ("market", "all_days")} | {"market": run.market.withColumn(
        "close", F.when((F.col("date") == F.lit(changed_day)) & (F.col("instrument_id") == name), F.col("close") * 1.01).otherwise(F.col("close")))}
    loaded = pipeline.load(late, store)
    assert loaded.changed_from == changed_day and loaded.revisions.count() == 1
    third = pipeline.carried_backtest(late, store, loaded.changed_from)
    assert third.computed_from >= changed_day
    full = {key(r): (r.var95, r.var99, r.pnl) for r in late.backtest.collect()}
    stored = {key(r): (r.var95, r.var99, r.pnl) for r in third.rows.collect()}
    assert stored.keys() == full.keys() and all(a == b or abs(a - b) <= 1e-6 * max(1.0, abs(a)) for k in full for a, b in zip(full[k], stored[k]))
