"""Risk tables in filings: extraction, reprint check, phrase flag.

A document is parsed inside its own row with array functions; the only shuffles are by accession
(tables of one filing) and by quarter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions.text import accounting_number, all_matches, strip_markup

# Row labels of the published table, as prefix patterns, in this order.
CATEGORY_LABELS = (("interest_rates", "^interest rates"), ("equity_prices", "^equity prices"), ("currency_rates", "^currency rates"),
                   ("commodity_prices", "^commodity prices"), ("diversification", "^diversification effect"), ("total", "^total"))
CATEGORIES = [name for name, _ in CATEGORY_LABELS]
PHRASE = r"(?i)Diversification\s+effect"
CONFIDENCE = r"95% confidence level|95% one-day VaR"


def candidate_tables(filings: DataFrame) -> DataFrame:
    """(accession, form, filed, t, table): every table whose text contains the phrase."""
    tables = filings.select("accession", "form", "filed", F.posexplode(all_matches(F.col("html"), "<table.*?</table>")).alias("t", "table"))
    return tables.filter(strip_markup(F.col("table")).rlike(PHRASE))


def _cells(row: Column) -> Column:
    cleaned = F.transform(all_matches(row, r"<t[dh][^>]*>(.*?)</t[dh]>", 1), lambda c: F.trim(strip_markup(c)))
    return F.filter(cleaned, lambda c: ~c.isin("", "$", ")", "%"))


def _category(cells: Column) -> Column:
    label = F.lower(F.trim(F.regexp_replace(F.get(cells, F.lit(0)), r"\s*\d+$", "")))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(CATEGORY_LABELS):
        out = F.when(label.rlike(pattern), name).otherwise(out)
    return out


def parsed_rows(tables: DataFrame) -> DataFrame:
    """Add ``lines``: per table row its category, its numbers and its text; empty rows dropped."""
    with_cells = tables.withColumn("_rows", F.filter(
        F.transform(all_matches(F.col("table"), "<tr.*?</tr>"), _cells), lambda c: F.size(c) > 0))
    line = lambda c: F.struct(
        _category(c).alias("category"),
        F.filter(F.transform(F.slice(c, 2, F.size(c)), accounting_number), lambda x: x.isNotNull()).alias("nums"),
        F.array_join(c, " | ").alias("text"))
    return with_cells.withColumn("lines", F.transform("_rows", line)).drop("_rows", "table")


def column_values(rows: DataFrame, column: int) -> DataFrame:
    """Six categories from the given number column, header and identity gap; incomplete tables drop out.

    The first row with enough numbers wins per category; the header is the text before the first value.
    """
    has = lambda r: F.size(r["nums"]) > column
    value = lambda name: F.get(F.get(F.filter("lines", lambda r: (r["category"] == name) & has(r)), F.lit(0))["nums"], F.lit(column))
    taken = F.transform("lines", lambda r: r["category"].isNotNull() & has(r))
    first = F.array_position(taken, True)
    header = F.filter(F.transform("lines", lambda r, i: F.when(r["category"].isNull() & (i + 1 < first), r["text"])), lambda x: x.isNotNull())
    wide = rows.select("accession", "form", "filed", "t", *[value(c).alias(c) for c in CATEGORIES],
                       F.array_join(header, " / ").alias("header"))
    gap = sum((F.col(c) for c in CATEGORIES[:-1]), F.lit(0.0)) - F.col("total")
    complete = F.lit(True)
    for c in CATEGORIES:
        complete = complete & F.col(c).isNotNull()
    return wide.filter(complete).withColumn("identity_gap", gap)


def parse_filings(filings: DataFrame) -> DataFrame:
    """One row per published column of interest.

    The first two parsed tables are the average and the period end. A first-quarter filing whose header
    reads March, December also gives the previous fourth quarter in its second column.
    """
    rows = parsed_rows(candidate_tables(filings))
    order = W.partitionBy("accession").orderBy("t")
    first = column_values(rows, 0).withColumn("rank", F.row_number().over(order)).filter("rank <= 2")
    period = D.previous_quarter_end(F.col("filed"))
    average = F.col("rank") == 1
    main = first.select(
        "accession", "form", "filed", period.alias("period_end"), F.when(average, "average").otherwise("period_end").alias("measure"),
        F.when(average, F.when(F.col("form") == "10-K", "year").otherwise("quarter")).otherwise("day").alias("horizon"),
        F.lit(1).alias("column"), *CATEGORIES, "identity_gap", F.substring("header", 1, 300).alias("header"))
    months = F.slice(F.regexp_extract_all(F.col("lead_header"), F.lit("(March|June|September|December)"), F.lit(1)), 1, 2)
    lead = first.filter("rank = 1").select("accession", F.col("header").alias("lead_header"))
    lowest = rows.groupBy("accession").agg(F.min("t").alias("t"))
    second = (column_values(rows, 1).join(lowest, ["accession", "t"]).join(lead, "accession")
              .filter((F.col("form") == "10-Q") & (F.month(period) == 3) & (F.array_join(months, ",") == "March,December")))
    q4 = second.select(
        "accession", "form", "filed", D.previous_quarter_end(period).alias("period_end"), F.lit("average").alias("measure"),
        F.lit("quarter").alias("horizon"), F.lit(2).alias("column"), *CATEGORIES, "identity_gap", F.substring("header", 1, 300).alias("header"))
    return main.unionByName(q4)


def first_two_columns(filings: DataFrame) -> DataFrame:
    """(accession, period_end, c1, c2): both leading columns of each quarterly filing's first table."""
    quarterly = filings.filter(F.col("form") == "10-Q")
    rows = parsed_rows(candidate_tables(quarterly))
    lowest = rows.groupBy("accession").agg(F.min("t").alias("t"))
    one, two = column_values(rows, 0), column_values(rows, 1)
    pack = F.struct(*CATEGORIES)
    base = quarterly.select("accession", D.previous_quarter_end(F.col("filed")).alias("period_end"))
    pick = lambda frame, name: frame.join(lowest, ["accession", "t"]).select("accession", pack.alias(name))
    return base.join(pick(one, "c1"), "accession", "left").join(pick(two, "c2"), "accession", "left")


def reprint_classes(columns: DataFrame) -> DataFrame:
    """(period_end, class): which earlier filing the second column reprints."""
    by_quarter = columns.select("period_end", "c1", "c2")
    prior = by_quarter.select(F.col("period_end").alias("pq"), F.col("c1").alias("pc"))
    yearly = by_quarter.select(F.col("period_end").alias("py"), F.col("c1").alias("yc"))
    joined = (by_quarter.withColumn("pq", D.previous_quarter_end(F.col("period_end")))
              .withColumn("py", D.quarter_end(F.add_months("period_end", -12)))
              .join(prior.withColumn("has_pq", F.lit(True)), "pq", "left").join(yearly.withColumn("has_py", F.lit(True)), "py", "left"))
    cls = (F.when(F.col("c2").isNull(), "no_reference")
           .when(F.col("has_pq") & F.col("c2").eqNullSafe(F.col("pc")), "prior_quarter")
           .when(F.col("has_py") & F.col("c2").eqNullSafe(F.col("yc")), "same_quarter_last_year")
           .when((F.month("period_end") == 3) | F.col("has_pq").isNull() | F.col("has_py").isNull(), "no_reference")
           .otherwise("unmatched"))
    return joined.select("period_end", cls.alias("class"))


def states_confidence(filings: DataFrame) -> DataFrame:
    """(accession, form, filed, states_95)."""
    return filings.select("accession", "form", "filed", strip_markup(F.col("html")).rlike(CONFIDENCE).alias("states_95"))


def filing_lineage(filings: DataFrame, parsed: DataFrame) -> DataFrame:
    """(accession, form, filed, sha256, tables_parsed): the hash is that of the landed bytes."""
    counts = parsed.groupBy("accession").agg(F.count(F.lit(1)).alias("tables_parsed"))
    return (filings.select("accession", "form", "filed", "sha256")
            .join(counts, "accession", "left").withColumn("tables_parsed", F.coalesce("tables_parsed", F.lit(0))))


def quarterly_averages(parsed: DataFrame) -> DataFrame:
    """(period_end, six categories): published quarterly averages."""
    return parsed.filter((F.col("measure") == "average") & (F.col("horizon") == "quarter")).select("period_end", *CATEGORIES)


def missing_quarters(quarters: DataFrame) -> DataFrame:
    """Quarter ends between the first and last that were not published."""
    span = quarters.agg(F.min("period_end").alias("lo"), F.max("period_end").alias("hi"))
    months = span.select(F.explode(F.sequence(F.trunc("lo", "quarter"), F.trunc("hi", "quarter"), F.expr("interval 3 months"))).alias("q"))
    return months.select(D.quarter_end(F.col("q")).alias("period_end")).join(quarters.select("period_end"), "period_end", "left_anti")
