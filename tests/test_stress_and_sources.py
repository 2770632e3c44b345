import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import day
from tidemark.config import PastWindow, RunConfig, Scenario, Shock
from tidemark.operators import positions, pricing, stress
from tidemark.sources import files, tables


def shocked(spark, instruments, *shocks):
    frame = stress.shocks_frame(spark, (Scenario("s", "s", "s", shocks),))
    hits = stress.require_valid(frame, stress.shock_hits(frame, instruments))
    return {r.instrument_id: r.r for r in stress.shock_moves(hits, instruments, frame).collect()}


def test_shocks_that_meet_add_up(spark, instruments):
    got = shocked(spark, instruments, Shock(asset_class="equity", pct=12.0), Shock(ids=("N7", "TIN"), asset_class="rates", pp=-0.3), Shock(desk="Overseas", pct=-40.0), Shock(asset_class="fx", pct=2.0))
    assert got == pytest.approx({"OAK": np.log(1.12), "ELM": np.log(1.12) + np.log(0.6), "TIN": 0.0, "N7": -0.3, "EURO": np.log(1.02)})


def test_wrong_unit_and_empty_selector_fail(spark, instruments):
    with pytest.raises(Exception, match="wrong shock unit"):
        shocked(spark, instruments, Shock(asset_class="rates", pct=5.0))
    with pytest.raises(Exception, match="wrong shock unit"):
        shocked(spark, instruments, Shock(asset_class="fx", pp=5.0))
    with pytest.raises(Exception, match="selects no instruments"):
        shocked(spark, instruments, Shock(desk="Nowhere", pct=5.0), Shock(asset_class="fx", pct=1.0))


def test_windows_clip_or_are_unavailable(spark):
    days = spark.createDataFrame([(k, day("2020-01-06") + dt.timedelta(days=k)) for k in range(20)], "ord int, date date")
    windows = stress.windows_frame(spark, (
        PastWindow("early", "", "", "2019-01-01", market_days=5), PastWindow("dates", "", "", "2020-01-08", end="2020-01-10"),
        PastWindow("clipped", "", "", "2020-01-20", end="2021-01-01"), PastWindow("too_long", "", "", "2020-01-20", market_days=10)))
    got = {r.scenario: r for r in stress.resolve_windows(windows, days).collect()}
    assert not got["early"].available and not got["too_long"].available
    assert (got["dates"].first_ord, got["dates"].last_ord) == (2, 4) and got["clipped"].last_ord == 19


def test_a_window_without_a_day_after_its_start_is_unavailable(spark, instruments):
    days = spark.createDataFrame([(k, day("2020-01-06") + dt.timedelta(days=k)) for k in range(10)], "ord int, date date")
    windows = stress.resolve_windows(stress.windows_frame(spark, (PastWindow("past", "p", "p", "2024-01-01", end="2024-02-01"), PastWindow("last", "l", "l", "2020-01-15", end="2020-03-01"))), days)
    assert not any(r.available for r in windows.collect())
    dense = spark.createDataFrame([(k, "OAK", 0.01) for k in range(10)], "ord int, instrument_id string, r double")
    assert stress.path_moves(windows, dense).count() == 0


def test_missing_moves_count_as_zero_and_are_reported(spark, instruments):
    cfg = RunConfig(fx_map=(("EUR", "EURO"),))
    days = spark.createDataFrame([(k, day("2019-09-02") + dt.timedelta(days=k)) for k in range(4)], "ord int, date date")
    moves = {("OAK", 1): 0.03, ("OAK", 2): -0.20, ("OAK", 3): 0.06, ("N7", 3): -0.02}                # all else missing
    dense = spark.createDataFrame([(k, i, moves.get((i, k))) for k in range(4) for i in ("OAK", "ELM", "TIN", "N7", "EURO")], "ord int, instrument_id string, r double")
    book = spark.createDataFrame([("OAK", 300.0), ("ELM", -80.0), ("TIN", 20.0), ("N7", 1000.0), ("EURO", 0.0)], "instrument_id string, mv double")
    windows = stress.resolve_windows(stress.windows_frame(spark, (PastWindow("w", "w", "w", "2019-09-02", end="2019-09-05"),)), days)
    attributes = pricing.priced_as(instruments, cfg)
    path = stress.historical_positions(stress.path_moves(windows, dense), attributes, book)
    got = stress.historical_summary(windows, path, days).first()
    assert got.pnl == pytest.approx(300 * np.expm1(-0.11) + 1000 * np.expm1(0.02 * 0.07)) and got.worst_pnl == pytest.approx(300 * np.expm1(-0.17))
    assert got.worst_date == day("2019-09-04") and got.n_no_data == 4
    ends = stress.end_positions(path, windows)
    desks = {r.desk: r.pnl for r in stress.by_desk(ends).collect()}
    assert sum(v for k, v in desks.items() if k != "total") == pytest.approx(desks["total"])
    assert [r.instrument_id for r in stress.largest_losses(ends, 2).orderBy("rank").collect()] == ["OAK", "ELM"]
    unpriced = book.withColumn("mv", F.when(F.col("instrument_id") != "TIN", F.col("mv")))
    path = stress.historical_positions(stress.path_moves(windows, dense), attributes, unpriced)
    assert stress.historical_summary(windows, path, days).first().pnl is None
    assert {r.desk: r.pnl is None for r in stress.by_desk(stress.end_positions(path, windows)).collect()} == {"Forest": False, "Overseas": False, "Metals": True, "Gilts": False, "Cash": False, "total": True}


def test_positions_are_running_trades(spark):
    trades = spark.createDataFrame([("A", day("2020-01-03"), 5.0), ("A", day("2020-01-03"), 1.0), ("A", day("2020-01-05"), -2.0), ("A", day("2020-01-08"), 1.0)],
                                   "instrument_id string, trade_date date, quantity double")
    got = {str(r.as_of): r.quantity for r in positions.positions_from_trades(trades, F.lit(day("2020-01-09"))).collect()}
    assert got == {"2020-01-03": 6.0, "2020-01-06": 4.0, "2020-01-07": 4.0, "2020-01-08": 5.0, "2020-01-09": 5.0}


def test_sizing_needs_a_price(spark):
    targets = spark.createDataFrame([("A", 100.0), ("B", 50.0)], "instrument_id string, target double")
    values = spark.createDataFrame([("A", 4.0), ("B", None)], "instrument_id string, unit_value double")
    assert positions.sized_quantities(targets.filter("instrument_id = 'A'"), values).first().quantity == 25.0
    with pytest.raises(Exception, match="no price for B"):
        positions.sized_quantities(targets, values).collect()


# --- sources -----------------------------------------------------------------------------------------


def test_named_month_csv_with_crlf_and_blanks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"DATE,AAA,BBB\r\n24 Sep 2026,5.2068,1.3220\r\n25 Sep 2026,5.2416,\r\n")
    got = {(r.ticker, str(r.date)): r.close for r in files.read_wide_named_months(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {("AAA", "2026-09-24"): 5.2068, ("BBB", "2026-09-24"): 1.3220, ("AAA", "2026-09-25"): 5.2416}
    (tmp_path / "b.csv").write_text("<html>error</html>\n")
    with pytest.raises(ValueError, match="not the expected CSV"):
        files.read_wide_named_months(spark, str(tmp_path / "b.csv"))


def test_iso_csv_with_dots_and_start(spark, tmp_path):
    for header in ("observation_date", "DATE"):
        (tmp_path / "f.csv").write_text(f"{header},DDD\n2026-09-24,4.10\n2026-09-25,.\n2026-09-28,4.15\n")
        rows = files.read_wide_iso(spark, str(tmp_path / "f.csv"), "2026-09-25").collect()
        assert [(r.ticker, str(r.date), r.close) for r in rows] == [("DDD", "2026-09-28", 4.15)]


def test_long_csv_without_and_with_dividends(spark, tmp_path):
    (tmp_path / "old.csv").write_text("ticker,date,close,adj_close\nA,2026-09-24,1.5,1.4\nA,2026-09-25,,\n")
    rows = files.read_long(spark, str(tmp_path / "old.csv")).collect()
    assert [(r.close, r.dividend) for r in rows] == [(1.5, 0.0)]
    (tmp_path / "new.csv").write_text("ticker,date,close,adj_close,dividend\nA,2026-09-24,1.5,1.4,\nA,2026-09-25,1.6,1.5,0.2\n")
    assert sorted(r.dividend for r in files.read_long(spark, str(tmp_path / "new.csv")).collect()) == [0.0, 0.2]


def test_fingerprints_are_of_the_bytes_on_disk(spark, tmp_path):
    for stamp, line in (("20260928T000000", b""), ("20260929T000000", b"A,2026-09-24,1\r\n")):
        folder = tmp_path / stamp
        folder.mkdir()
        (folder / "px.csv").write_bytes(b"ticker,date,close\r\n" + line)
    (folder / "px.request.txt").write_text("series=A")
    got = {r.n_rows: r for r in files.lineage_records(spark, str(tmp_path)).collect()}
    sha = hashlib.sha256((folder / "px.csv").read_bytes()).hexdigest()
    assert (got[1].source, got[1].sha256, got[1].fetch_id, got[1].request) == ("px", sha, f"px-{sha[:12]}", "series=A")
    assert got[0].request == "unknown"
    names = files.file_names(spark, str(tmp_path))
    assert files.newest_files(names, str(tmp_path), ["px"]).first().path.endswith("20260929T000000/px.csv")
    with pytest.raises(Exception, match="no landed raw data for cb"):
        files.newest_files(names, str(tmp_path), ["px", "cb"]).collect()


def test_keep_last_upsert_and_range_replacement(spark):
    rows = spark.createDataFrame([("A", 1, 10.0, 1), ("A", 1, 11.0, 2), ("B", 1, 5.0, 1)], "id string, d int, v double, load_seq int")
    assert {r.id: r.v for r in tables.keep_last(rows, ["id", "d"]).collect()} == {"A": 11.0, "B": 5.0}
    stored = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "id string, v double")
    new = spark.createDataFrame([("B", 9.0), ("C", 3.0)], "id string, v double")
    assert {r.id: r.v for r in tables.upsert(stored, new, ["id"]).collect()} == {"A": 1.0, "B": 9.0, "C": 3.0}
    assert tables.upsert(stored, new.limit(0), ["id"]).count() == 2
    old = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "d int, v string")
    fresh = spark.createDataFrame([(1, "y")], "d int, v string")
    assert sorted((r.d, r.v) for r in tables.replace_up_to(old, fresh, "d", F.lit(2)).collect()) == [(1, "y"), (3, "x")]


def test_run_log_keeps_the_error_path(spark):
    at = lambda h: dt.datetime(2026, 9, 30, h)
    events = spark.createDataFrame([("r1", AS := day("2026-09-29"), "STARTED", at(5)), ("r1", AS, "PASS", at(6)), ("r2", AS, "STARTED", at(7)), ("r2", AS, "ERROR", at(8)),
                                    ("r3", AS, "STARTED", at(9))], "run_id string, as_of date, status string, at timestamp_ntz")
    got = {r.run_id: (r.status, r.finished_at) for r in tables.run_log(events).collect()}
    assert got == {"r1": ("PASS", at(6)), "r2": ("ERROR", at(8)), "r3": ("STARTED", None)}


def test_reference_series_may_serve_several_purposes(spark, instruments):
    dim = instruments.withColumn("returns_proxy", F.when(F.col("instrument_id") == "OAK", "P")).withColumn("stress_proxy", F.when(F.col("instrument_id") == "ELM", "px:P"))
    checks = spark.createDataFrame([("USD", "px", "P")], "instrument_id string, source string, ticker string")
    raw = spark.createDataFrame([("px", "P", day("2026-09-29"), 1.0, "f", 1)], "source string, ticker string, date date, close double, fetch_id string, load_seq int")
    got = tables.map_references(raw, tables.reference_map(dim, checks, "px")).collect()
    assert {(r.instrument_id, r.purpose) for r in got} == {("USD", "cross_check"), ("OAK", "return_proxy"), ("ELM", "stress_proxy")}


def test_upsert_keeps_keys_unique(spark):
    stored = spark.createDataFrame([("A", 1, 1.0, 1), ("B", 1, 2.0, 1)], "id string, day int, v double, load_seq int")
    incoming = spark.createDataFrame([("A", 1, 5.0, 2), ("A", 1, 4.0, 3), ("C", 1, 9.0, 2)], "id string, day int, v double, load_seq int")
    got = {(r.id, r.day): r.v for r in tables.upsert(stored, incoming, ["id", "day"]).collect()}
    assert got == {("A", 1): 4.0, ("B", 1): 2.0, ("C", 1): 9.0}
    bare = tables.upsert(stored.drop("load_seq"), incoming.drop("load_seq"), ["id", "day"])
    assert bare.count() == 3 and bare.filter("id = 'A'").first().v == 5.0
    assert tables.upsert(stored, incoming.limit(0), ["id", "day"]).count() == 2


def test_a_bad_byte_does_not_fail_the_scan(spark, tmp_path):
    (tmp_path / "good.txt").write_bytes("<p>caf\u00e9</p>".encode())
    (tmp_path / "bad.txt").write_bytes(b"<p>caf\xe9 12\xff</p>")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["good.txt"].html == "<p>caf\u00e9</p>" and got["bad.txt"].html == "<p>caf 12</p>"
    assert got["bad.txt"].sha256 == hashlib.sha256(b"<p>caf\xe9 12\xff</p>").hexdigest()


def test_files_with_different_headers_are_not_merged_by_position(spark, tmp_path):
    (tmp_path / "a.csv").write_text("DATE,AAA\n2001-01-02,1.5\n")
    (tmp_path / "b.csv").write_text("DATE,BBB\n2001-01-02,7.5\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_wide_iso(spark, str(tmp_path), "2000-01-01").collect()


def test_sql_over_leaves_no_view(spark):
    frame = spark.createDataFrame([(1,), (2,)], "x int")
    assert tables.sql_over(spark, frame, "for_one_statement", "select sum(x) as s from for_one_statement").first().s == 3
    assert not spark.catalog.tableExists("for_one_statement")
