"""Filing tables on small hand-written HTML in the layouts real filings show."""

import pytest

from tests.conftest import day
from tidemark.operators import disclosure as X

ROWS = [("Interest rates", [82, 85, 79]), ("Equity prices", [65, 55, 48]), ("Currency rates", [19, 15, 23]), ("Commodity prices", [30, 31, 15]),
        ("Diversification effect", [-76, -74, -67]), ("Total", [120, 112, 98])]


def table(heads, rows, open_brackets=False, split=False):
    tr = lambda cells: "<tr>" + "".join(f"<TD class='x'>{c}</TD>" for c in cells) + "</tr>\n"
    body = "".join(tr(h) for h in heads)
    for label, nums in rows:
        if split and label.startswith("Diversification"):
            label = "Diversification</font> <font>effect"
        body += tr([label] + [(f"({-n}" if open_brackets else f"({-n})") if n < 0 else f"$ {n}" for n in nums])
    return f"<Table>{body}</TABLE>"


def parse(spark, html, form, filed):
    return X.parse_filings(spark.createDataFrame([("a", form, day(filed), html)], "accession string, form string, filed date, html string")).collect()


def test_first_column_identity_and_header(spark):
    html = table([["Three Months Ended"], ["June", "March", "June"]], ROWS)
    got = sorted(parse(spark, html + html, "10-Q", "2026-08-03"), key=lambda r: r.measure)
    assert [r.measure for r in got] == ["average", "period_end"] and [r.horizon for r in got] == ["quarter", "day"]
    assert (got[0].interest_rates, got[0].diversification, got[0].total, got[0].identity_gap) == (82, -76, 120, 0)
    assert got[0].period_end == day("2026-06-30") and got[0].header == "Three Months Ended / June | March | June"


def test_footnotes_open_brackets_and_split_phrase(spark):
    rows = [(k if k != "Diversification effect" else "Diversification effect 1", v[:1]) for k, v in ROWS]
    got = parse(spark, table([["Three Months"]], rows, open_brackets=True), "10-K", "2014-02-28")
    assert got[0].diversification == -76 and got[0].horizon == "year"
    assert len(parse(spark, table([["x"]], ROWS, split=True), "10-Q", "2026-08-03")) == 1


def test_incomplete_and_unrelated_tables_are_ignored(spark):
    other = "<table><tr><td>Total</td><td>5</td></tr></table>"
    assert parse(spark, other + table([["x"]], ROWS[:-1]), "10-Q", "2026-08-03") == []


@pytest.mark.parametrize("heads, n", [(["March", "December", "March"], 1), (["March", "March"], 0)])
def test_first_quarter_filing_gives_the_fourth_quarter(spark, heads, n):
    html = table([["Three Months Ended"], heads], ROWS)
    q4 = [r for r in parse(spark, html + html, "10-Q", "2026-05-01") if r.column == 2]
    assert len(q4) == n
    if n:
        assert q4[0].period_end == day("2025-12-31") and q4[0].total == 112


def test_reprint_classes(spark):
    v = lambda x: {c: float(x) for c in X.CATEGORIES}
    schema = "period_end date, c1 struct<" + ",".join(f"{c}:double" for c in X.CATEGORIES) + ">, c2 struct<" + ",".join(f"{c}:double" for c in X.CATEGORIES) + ">"
    rows = [(day("2025-06-30"), v(1), None), (day("2025-09-30"), v(2), v(1)), (day("2026-06-30"), v(3), v(9))]
    classes = lambda rs: {str(r.period_end): r["class"] for r in X.reprint_classes(spark.createDataFrame(rs, schema)).collect()}
    assert classes(rows) == {"2025-06-30": "no_reference", "2025-09-30": "prior_quarter", "2026-06-30": "no_reference"}
    rows[0] = (day("2025-06-30"), v(5), None)
    assert classes(rows + [(day("2026-03-31"), v(4), None)])["2026-06-30"] == "unmatched"


def test_confidence_phrase_across_markup(spark):
    docs = spark.createDataFrame([("a", "10-Q", day("2026-08-03"), "at a 95%&nbsp;<b>confidence</b> level"), ("b", "10-Q", day("2026-08-03"), "at 99%")],
                                 "accession string, form string, filed date, html string")
    assert {r.accession: r.states_95 for r in X.states_confidence(docs).collect()} == {"a": True, "b": False}


def test_a_row_of_many_cells_is_read_to_its_end(spark):
    wide = "<tr><td>Total</td>" + "".join(f"<td>{k}</td>" for k in range(1, 1201)) + "</tr>"
    frame = spark.createDataFrame([("a", "10-Q", day("2026-08-03"), f"<table><tr><td>Diversification effect</td></tr>{wide}</table>")],
                                  "accession string, form string, filed date, html string")
    lines = X.parsed_rows(X.candidate_tables(frame)).first().lines
    assert [len(x.nums) for x in lines if x.category == "total"] == [1200] and lines[1].nums[-1] == 1200.0
