"""Long windows from exact running sums, decaying variance over holes, blocked covariance, files of several headers."""

import dataclasses
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import day
from pyspark.sql import functions as F

from tidemark.config import StudyRules
from tidemark.functions.stats import fisher_bound
from tidemark.operators import controls as C
from tidemark.operators import risk
from tidemark.operators import volstudy as V
from tidemark.plans.queries import ratio
from tidemark.sources import files


def test_decaying_variance_over_holes_is_that_of_pandas(spark):
    rng = np.random.default_rng(5)
    series = {}
    for name in "abcdef":
        r = rng.normal(size=400)
        r[rng.random(400) < {"a": 0.0, "b": 0.1, "c": 0.9}.get(name, 0.4)] = np.nan
        series[name] = r
    series["e"][:30] = np.nan
    series["f"][-30:] = np.nan
    rows = [(k, i, None if np.isnan(v) and i % 2 else float(v)) for k, r in series.items() for i, v in enumerate(r)]
    got = {r.id: r.variance for r in C.decayed_variance(spark.createDataFrame(rows, "id string, pos int, r double"), ["id"], "pos", 0.94).collect()}
    for k, r in series.items():
        assert got[k] == pytest.approx(pd.Series(r ** 2).ewm(alpha=0.06, adjust=False).mean().iloc[-1], rel=1e-12)


def test_outlier_scores_with_missing_and_broken_prices(spark, instruments):
    rng = np.random.default_rng(6)
    days = pd.bdate_range("2020-01-01", periods=300)
    prices = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 300)))
    holes = prices.copy()
    holes[[50, 51, 120, 200, 297]] = np.nan
    rows = [("OAK", d.date(), float(p)) for d, p in zip(days, holes)] + [("ELM", d.date(), -1.0 if i == 40 else float(p)) for i, (d, p) in enumerate(zip(days, prices))]
    frame = spark.createDataFrame(rows, "instrument_id string, date date, adj_close double")
    from tidemark.config import ControlRules

    got = {r.instrument_id: r for r in C.outlier_scores(frame, instruments, F.lit(days[-1].date()), ControlRules()).collect()}
    for name, values in (("OAK", holes), ("ELM", np.where(np.arange(300) == 40, np.nan, prices))):
        r = np.diff(np.log(values))
        sigma = np.sqrt(pd.Series(r ** 2).ewm(alpha=1 - ControlRules().ewma_lambda, adjust=False).mean().shift(1).iloc[-1])
        assert got[name].sigma == pytest.approx(sigma, rel=1e-12) and got[name].r == pytest.approx(r[-1], rel=1e-12)


def test_trailing_deviation_and_correlation_are_those_of_pandas(spark):
    rng = np.random.default_rng(7)
    n = 1500
    days = [dt.date(2010, 1, 1) + dt.timedelta(i) for i in range(n)]
    rules = StudyRules()
    levels = {c: 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n))) for c in rules.categories}
    rows = [(d, c, float(v)) for c, path in levels.items() for i, (d, v) in enumerate(zip(days, path)) if not (c == "equity_prices" and i % 7 == 3)]
    frame = spark.createDataFrame(rows, "date date, category string, level double")
    got = {(r.window, r.category, r.date): r.vol for r in V.trailing_vol(frame, rules).collect()}
    for c in ("equity_prices", "currency_rates"):
        path = pd.Series(levels[c], index=days)
        if c == "equity_prices":
            path = path[[i % 7 != 3 for i in range(n)]]
        move = np.log(path / path.shift()).reindex(days)
        for name, size in rules.windows:
            want = move.rolling(size, min_periods=int(size * rules.min_share)).std()
            for d, w in want.items():
                g = got[name, c, d]
                assert (g is None) == bool(np.isnan(w)) and (g is None or g == pytest.approx(w, rel=1e-9))
    corr = {r.date: r["corr"] for r in V.rolling_correlation(frame, "equity_prices", "interest_rates", rules).collect()}
    both = pd.DataFrame({"a": pd.Series(levels["equity_prices"], index=days), "b": pd.Series(levels["interest_rates"], index=days)})
    both.loc[[d for i, d in enumerate(days) if i % 7 == 3], "a"] = np.nan
    moves = pd.DataFrame({"x": np.log(both.a / both.a.shift()), "y": -(both.b - both.b.shift())}).dropna()
    want = moves.x.rolling(rules.correlation_rows, min_periods=rules.correlation_min_rows).corr(moves.y)
    assert corr.keys() == set(want.index)
    for d, w in want.items():
        assert (corr[d] is None) == bool(np.isnan(w)) and (corr[d] is None or corr[d] == pytest.approx(w, rel=1e-8))


def test_a_constant_series_has_no_deviation_after_a_large_move(spark):
    rules = dataclasses.replace(StudyRules(), windows=(("w", 20),))
    levels = [1.0, 1e6] + [1e6] * 60
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(i), "equity_prices", v) for i, v in enumerate(levels)]
    got = [r.vol for r in V.trailing_vol(spark.createDataFrame(rows, "date date, category string, level double"), rules).filter("category = 'equity_prices'").orderBy("date").collect()]
    assert got[-1] == 0.0 and got[-1 - 20] == 0.0 and got[20] > 1  # nothing of what has left the window remains


def test_covariance_of_many_factors(spark):
    rng = np.random.default_rng(8)
    scenarios, factors = 40, 700
    x = rng.normal(size=(scenarios, factors))
    rows = pd.DataFrame({"s": np.repeat(np.arange(1, scenarios + 1), factors), "instrument_id": np.tile([f"f{i:04d}" for i in range(factors)], scenarios), "r": x.ravel()})
    rows["age"], rows["n"] = scenarios - rows.s, scenarios
    frame = spark.createDataFrame(rows)
    w = 0.94 ** np.arange(scenarios - 1, -1, -1)
    want = (x * (w / w.sum())[:, None]).T @ x
    got = risk.ewma_covariance(frame, 0.94, block=64).toPandas()
    assert len(got) == factors * (factors + 1) // 2 == len(got.drop_duplicates(["a_id", "b_id"])) and (got.a_id <= got.b_id).all()
    at = lambda c: c.str[1:].astype(int).to_numpy()
    assert np.abs(want[at(got.a_id), at(got.b_id)] - got["cov"].to_numpy()).max() < 1e-12


def test_files_of_several_headers_in_one_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ticker,date,close,adj_close\nA,2020-01-01,1.5,1.4\nA,2020-01-02,,1\n")
    (tmp_path / "b.csv").write_text("ticker,date,close,adj_close,dividend\nB,2020-01-01,2.5,2.4,0.3\nB,2020-01-02,2.6,2.5,\n")
    (tmp_path / "c d.csv").write_text('date,"dividend","ticker",adj_close,close,note\n2020-01-03,0.7,C,3.4,3.5,"x, y"\n')
    got = {(r.ticker, str(r.date)): (r.close, r.adj_close, r.dividend) for r in files.read_long(spark, str(tmp_path)).collect()}
    assert got == {("A", "2020-01-01"): (1.5, 1.4, 0.0), ("B", "2020-01-01"): (2.5, 2.4, 0.3), ("B", "2020-01-02"): (2.6, 2.5, 0.0), ("C", "2020-01-03"): (3.5, 3.4, 0.7)}
    assert sorted(map(len, files.header_groups(spark, str(tmp_path)).values())) == [1, 1, 1]
    (tmp_path / "e.csv").write_text("day,price\n2020-01-01,1\n")
    with pytest.raises(ValueError, match="no header"):
        files.read_long(spark, str(tmp_path))
    assert day("2020-01-01") == dt.date(2020, 1, 1)


def test_export_counts_while_writing(spark, tmp_path):
    assert files.export_csv(spark.range(37).repartition(5), str(tmp_path / "x")) == 37
    assert files.export_csv(spark.range(0), str(tmp_path / "y")) == 0


def test_files_over_the_limit_are_hashed_as_they_stream(spark, tmp_path):
    import hashlib

    contents = {"a": b"ticker,close\nA,1\n", "b": b"no line feed at the end", "c": b"\n\nx\r\n\n", "d": b"\xef\xbb\xbfwith a mark\nand two lines", "e": b"\xef\xbb\xbf\xff bad bytes\n",
                "f": b"".join(b"line %d\n" % i for i in range(60_000)), "g": b"\n"}
    for stamp in ("s1", "s 2"):
        (tmp_path / stamp).mkdir()
        for name, content in contents.items():
            (tmp_path / stamp / f"{name}.csv").write_bytes(content + (b"more\n" if stamp == "s1" else b""))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")  # the large file has several splits
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "5")
    try:
        got = {(r.stamp.replace("%20", " "), r.source): r.sha256 for r in files.fingerprints(spark, str(tmp_path), whole_limit=5).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {(stamp, n): hashlib.sha256(c + (b"more\n" if stamp == "s1" else b"")).hexdigest() for stamp in ("s1", "s 2") for n, c in contents.items()}
    whole = {r.path: r.sha256 for r in files.fingerprints(spark, str(tmp_path)).collect()}
    assert sorted(whole.values()) == sorted(got.values())


def _quarter_ends(n):
    return [d.date() for d in pd.date_range("1995-03-31", periods=n, freq="QE")]


def test_a_disclosed_var_that_never_changes_has_no_correlation(spark):
    """Large tables have equal means in every quarter after rounding; ``corr`` divided by their zero variance."""
    ends = _quarter_ends(12)
    quarters = spark.createDataFrame([(d, 25.0, 24.0 + i % 3, 25.0, 25.0) for i, d in enumerate(ends)],
                                     "period_end date, interest_rates double, equity_prices double, currency_rates double, commodity_prices double")
    vols = spark.createDataFrame([(w, d, c, 0.1 + 0.01 * (i * k % 5)) for k, w in ((2, "1y"), (3, "2y")) for c in StudyRules().categories for i, d in enumerate(ends)],
                                 "window string, period_end date, category string, vol double")
    fit = V.with_interval(V.vol_fit(quarters, vols, StudyRules()), StudyRules())
    rows = {(r.category, r.window): r for r in fit.collect()}
    assert len(rows) == 8
    flat = rows["interest_rates", "1y"]
    assert flat.quarters == 11 and flat.elasticity == 0.0
    assert all(np.isnan(flat[c]) for c in ("corr_changes", "corr_levels", "ci_lo", "ci_hi"))
    v, s = (np.log([x(i) for i in range(12)]) for x in (lambda i: 24.0 + i % 3, lambda i: 0.1 + 0.01 * (i * 3 % 5)))
    assert rows["equity_prices", "2y"].corr_changes == pytest.approx(np.corrcoef(np.diff(v), np.diff(s))[0, 1], abs=1e-12)
    assert rows["equity_prices", "2y"].corr_levels == pytest.approx(np.corrcoef(v, s)[0, 1], abs=1e-12)
    best = {r.category: r for r in V.best_windows(fit).collect()}
    assert np.isnan(best["interest_rates"].corr_changes) and best["interest_rates"].overlap
    assert not np.isnan(best["equity_prices"].corr_changes)
    shown = fit.select("category", ratio("corr_changes").alias("c")).filter("category = 'interest_rates'").collect()
    assert all(np.isnan(r.c) for r in shown)  # not 0


def test_a_constant_share_has_no_correlation_however_it_is_split(spark):
    """Merging means of equal values leaves an error of rounding, so ``corr`` gave noise, or failed, by the number of tasks."""
    for rows, parts in ((22, 2), (33, 3), (22, 1)):  # 0.4 / 11 * 11 is not 0.4
        flat = spark.range(0, rows, 1, parts).select((F.col("id") * 0 + 0.4).cast("double").alias("share"), (F.col("id") * 7 % 5 * 0.01).cast("double").alias("corr"))
        row = V.diversification_summary(flat).first()
        assert (row.lowest, row.highest, row.quarters) == (0.4, 0.4, rows) and np.isnan(row["corr"])
    frame = spark.createDataFrame([(d, 0.4, 0.01 * (i * 7 % 5)) for i, d in enumerate(_quarter_ends(25))] + [(dt.date(2010, 3, 31), 0.9, None)], "period_end date, share double, corr double")
    varied = frame.withColumn("share", F.col("share") + F.when(F.month("period_end") == 3, 0.01).otherwise(0.0))
    kept = varied.filter("corr is not null").toPandas()
    assert V.diversification_summary(varied).first()["corr"] == pytest.approx(np.corrcoef(kept["share"], kept["corr"])[0, 1], abs=1e-12)
    assert V.diversification_summary(frame.filter("corr is null")).first()["corr"] is None


def test_the_interval_of_three_pairs_is_open(spark):
    """z / sqrt(n - 3) divided by zero; a constant series has NaN, and neither is rounded to a number."""
    rows = spark.createDataFrame([(0.5, 3), (0.5, 4), (float("nan"), 3), (float("nan"), 9), (1.0, 9), (None, 9)], "r double, n long")
    got = rows.select(*(ratio(fisher_bound(F.col("r"), F.col("n"), z)).alias(f"z{i}") for i, z in enumerate((-1.96, 1.96)))).collect()
    assert tuple(got[0]) == (-1.0, 1.0)
    assert tuple(got[1]) == tuple(np.round(np.tanh(np.arctanh(0.5) + np.array([-1.96, 1.96])), 6))
    assert all(np.isnan(x) for row in got[2:4] for x in row)
    assert tuple(got[4]) == (1.0, 1.0) and tuple(got[5]) == (None, None)


def test_an_index_over_quarters_without_volatility(spark):
    """VaR / 0 failed. As in the SQL, it is infinite, and an index that starts there is NaN; a category without any correlation has its index too."""
    ends = _quarter_ends(12)
    quarters = spark.createDataFrame([(d, 25.0, 24.0 + i % 3, 25.0, 25.0) for i, d in enumerate(ends)],
                                     "period_end date, interest_rates double, equity_prices double, currency_rates double, commodity_prices double")
    still = {("interest_rates", 5), ("currency_rates", 0)}
    vols = spark.createDataFrame([("1y", d, c, 0.0 if (c, i) in still else 0.1 + 0.01 * (i * 3 % 5)) for c in StudyRules().categories for i, d in enumerate(ends)],
                                 "window string, period_end date, category string, vol double")
    fit = V.with_interval(V.vol_fit(quarters, vols, StudyRules()), StudyRules())
    rows = V.implied_index(quarters, vols, V.best_windows(fit), StudyRules()).select("category", "period_end", ratio("implied", 4).alias("implied"))
    got = {c: [r.implied for r in rows.filter(F.col("category") == c).orderBy("period_end").collect()] for c in StudyRules().categories}
    assert [len(v) for v in got.values()] == [12] * 4
    assert got["interest_rates"][:5] == pytest.approx([10.0 / (0.1 + 0.01 * (i * 3 % 5)) for i in range(5)], abs=1e-4) and got["interest_rates"][5] == np.inf
    assert np.isnan(got["currency_rates"][0]) and got["currency_rates"][1:] == [0.0] * 11
    assert got["commodity_prices"][0] == 100.0 and all(np.isfinite(got["commodity_prices"] + got["equity_prices"]))
