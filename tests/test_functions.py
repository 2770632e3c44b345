import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import stats as S
from tidemark.functions import text as X
from tidemark.operators import backtest as B


def test_business_days_match_numpy_and_pandas(spark):
    starts = pd.date_range("1999-12-20", periods=24)
    rows = [(a.date(), (a + pd.Timedelta(days=g)).date()) for a in starts for g in (0, 1, 2, 5, 9)]
    frame = spark.createDataFrame(rows, "a date, b date")
    got = frame.select("a", "b", D.business_lag(F.col("a"), F.col("b")).alias("lag"), D.business_shift(F.col("a"), -3).alias("back"),
                       D.business_shift(F.col("a"), 1).alias("next"), D.business_date(D.business_ordinal(F.col("a"))).alias("same")).collect()
    for r in got:
        assert r.lag == np.busday_count(r.a, r.b)
        assert pd.Timestamp(r.back) == pd.Timestamp(r.a) - pd.offsets.BDay(3)
        assert pd.Timestamp(r.next) == pd.Timestamp(r.a) + pd.offsets.BDay(1)
        if r.a.weekday() < 5:
            assert r.same == r.a


def test_quarter_ends(spark):
    rows = spark.createDataFrame([(dt.date(2026, 8, 3),), (dt.date(2026, 6, 30),), (dt.date(2026, 1, 1),)], "d date")
    got = rows.select(D.previous_quarter_end(F.col("d")).alias("p"), D.quarter_end(F.col("d")).alias("q")).collect()
    assert [str(r.p) for r in got] == ["2026-06-30", "2026-03-31", "2025-12-31"]
    assert [str(r.q) for r in got] == ["2026-09-30", "2026-06-30", "2026-03-31"]


@pytest.mark.parametrize("x, p", [(0.0, 1.0), (0.5, 0.4795001221869535), (3.841458820694124, 0.05), (6.634896601021214, 0.01),
                                  (30.0, 4.320463057827488e-08), (65.0, 7.48e-16)])
def test_chi_square_tail(spark, x, p):
    got = spark.range(1).select(S.chi2_upper_1(F.lit(x)).alias("p")).first().p
    assert got == pytest.approx(p, abs=2e-15 if x > 50 else 1e-12)


def test_binomial_cdf_against_direct_sum(spark):
    from math import comb
    for n, x, p in ((250, 4, 0.01), (250, 0, 0.01), (37, 9, 0.05), (10, 10, 0.05)):
        got = spark.range(1).select(S.binomial_cdf(F.lit(x), F.lit(n), p).alias("c")).first().c
        assert got == pytest.approx(sum(comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(x + 1)), rel=1e-10)


def test_kupiec_without_exceptions(spark):
    row = spark.range(1).select(B.kupiec(F.lit(250), F.lit(0), 0.01).alias("lr")).withColumn("p", S.chi2_upper_1(F.col("lr"))).first()
    assert row.lr == pytest.approx(-500 * np.log(0.99))
    assert row.p == pytest.approx(0.02497, abs=1e-4)
    assert spark.range(1).select(B.kupiec(F.lit(0), F.lit(0), 0.01).alias("lr")).first().lr is None


def test_zone_table(spark):
    want = {**{x: ("green", 0.0) for x in range(5)}, 5: ("yellow", 0.40), 6: ("yellow", 0.50), 7: ("yellow", 0.65), 8: ("yellow", 0.75),
            9: ("yellow", 0.85), 10: ("red", 1.0), 12: ("red", 1.0)}
    rows = spark.createDataFrame([(x,) for x in want], "x int").withColumn("zone", B.zone(F.lit(250), F.col("x")))
    rows = rows.withColumn("plus", B.plus_factor(F.lit(250), F.col("x"), F.col("zone"))).collect()
    assert {r.x: (r.zone, r.plus) for r in rows} == want
    assert spark.range(1).select(B.plus_factor(F.lit(100), F.lit(0), F.lit("green")).alias("p")).first().p is None


def test_independence_separates_clustered_from_spread(spark):
    rows = []
    for name, hits in (("spread", {50, 150, 250, 350, 450}), ("clustered", {200, 201, 202, 203, 204}), ("none", set())):
        rows += [(name, dt.date(2000, 1, 1) + dt.timedelta(days=k), 1.0, 1.0, -2.0 if k in hits else 0.0) for k in range(500)]
    frame = spark.createDataFrame(rows, "method string, date date, var95 double, var99 double, pnl double")
    p = {r.method: r.christoffersen_p for r in B.coverage_tests(B.transitions(frame)).filter("level = '99'").collect()}
    assert p["none"] == 1.0 and p["clustered"] < 0.01 < p["spread"]


def test_accounting_numbers_and_markup(spark):
    cells = ["$ 1,234", "(70)", "(70", "12.5", "n/a", "", "$", "1 2"]
    got = spark.createDataFrame([(c,) for c in cells], "c string").select(X.accounting_number(F.col("c")).alias("n")).collect()
    assert [r.n for r in got] == [1234.0, -70.0, -70.0, 12.5, None, None, None, None]
    html = spark.createDataFrame([("<b>Diversification</b>\n<i>&nbsp;effect</i> &amp; more",)], "h string")
    assert html.select(X.strip_markup(F.col("h")).alias("t")).first().t.strip() == "Diversification effect & more"


def test_character_references_are_decoded_once(spark):
    from tidemark.functions.text import strip_markup

    cases = {"&#8194;a": " a", "&#8208;": "\u2010", "&#x24;12": "$12", "caf&eacute;&nbsp;x": "caf\u00e9 x", "&amp;lt;": "&lt;", "&#38;amp;": "&amp;", "&nosuch; &#0; &#xD800;": "&nosuch; &#0; &#xD800;",
             "<b>1&#x1F600;</b>": " 1\U0001f600 ", "a & b": "a & b"}
    frame = spark.createDataFrame(list(cases.items()), "html string, want string")
    for r in frame.select("html", "want", strip_markup(F.col("html")).alias("got")).collect():
        assert r.got.replace("\u2002", " ") == r.want, r.html


def test_a_sum_with_a_missing_value_is_missing(spark):
    from tidemark.functions.stats import whole_sum

    frame = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", None)], "g string, v double")
    assert {r.g: r.s for r in frame.groupBy("g").agg(whole_sum(F.col("v")).alias("s")).collect()} == {"a": 3.0, "b": None}
