"""The driver contract, and the queries against their oracles on the smallest table set that has market days."""

import os

import pytest

import __spark_entry__ as contract
from checks.all_oracles import ORACLES
from checks.compare import compare, connect
from tidemark.plans import pipeline
from tidemark.plans.daily import DailyRun
from tidemark.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"
#: These store whole runs; tests/test_stored.py has smaller cases of the same.
LONG = {"two_day_store", "backtest_carried", "daily_pipeline", "export_counts"}
KEYS = sorted(set(ORACLES) - LONG)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, key):
    ok, note = compare(spark, connect(SF), SF, key, contract.queries()[key], contract.oracle_sql()[key])
    assert ok, note


@pytest.mark.skipif(not os.path.isdir(contract.SMOKE_DIR), reason="needs the given tables")
def test_flagship_query(spark):
    rows = contract.entry(spark).collect()
    assert len({(r.instrument_id, r.date) for r in rows}) == len(rows) > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_run_date_must_be_a_market_day_and_errors_are_logged(spark, tmp_path):
    run = DailyRun(spark, SF, as_of="2001-11-04")
    with pytest.raises(ValueError, match="not a market day"):
        pipeline.execute(run, "r9", str(tmp_path / "results"))
    log = pipeline.run_log(spark, str(tmp_path / "results")).first()
    assert (log.run_id, log.status) == ("r9", "ERROR") and log.finished_at is not None
