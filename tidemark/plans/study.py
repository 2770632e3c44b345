"""The disclosure and volatility study over the order tables: filings are written from quarterly
aggregates as HTML, read back, parsed, and set against benchmark volatility."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import RunConfig
from tidemark.functions import dates as D
from tidemark.operators import disclosure as X
from tidemark.operators import volstudy as V
from tidemark.plans import warehouse as wh
from tidemark.plans.daily import daily_run
from tidemark.plans.stages import StagedRun, stage
from tidemark.sources import files

LABELS = (("interest_rates", "Interest rates"), ("equity_prices", "Equity prices"), ("currency_rates", "Currency rates"),
          ("commodity_prices", "Commodity prices"), ("diversification", "Diversification effect"), ("total", "Total"))
EPISODES = (("Winter 1998", "1997-12-31", "1998-03-31"), ("Second half 1998", "1998-06-30", "1998-12-31"),
            ("Spring 2000", "2000-03-31", "2000-06-30"), ("Spring 2001", "2001-03-31", "2001-06-30"))


def _number(x: Column, quirky: Column) -> Column:
    """'$ 12' or '(12)'; a quirky document forgets the closing bracket."""
    body = F.format_string("%.0f", F.abs(x))
    return F.when(x < 0, F.concat(F.lit("("), body, F.when(quirky, "").otherwise(")"))).otherwise(F.concat(F.lit("$ "), body))


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>\n"))


def write_filings(disclosed: DataFrame) -> DataFrame:
    """(accession, form, filed, html): one document per quarter, with the irregularities real filings show.

    Second columns: March prints the previous quarter, June too, September the same quarter a year ago.
    June has a footnote digit and an open bracket, September splits the phrase with markup, even years
    state the confidence level.
    """
    cats = X.CATEGORIES
    month, year = F.month("period_end"), F.year("period_end")
    earlier = disclosed.select(F.col("period_end").alias("ref"), F.struct(*cats).alias("old"))
    ref = F.when(month == 9, D.quarter_end(F.add_months("period_end", -12))).otherwise(D.previous_quarter_end(F.col("period_end")))
    rows = disclosed.withColumn("ref", ref).join(earlier, "ref", "left")
    june, september = month == 6, month == 9
    heads = F.when(month == 3, F.array(F.lit("March"), F.lit("December"))).otherwise(
        F.array(F.date_format("period_end", "MMMM"), F.date_format("ref", "MMMM")))

    def table(bump: float, second: bool) -> Column:
        out = [F.lit('<TABLE border="0">\n'), _row(F.lit("Three&nbsp;Months Ended")), _row(heads[0], heads[1])]
        for name, label in LABELS:
            add = bump if name in ("interest_rates", "total") else 0.0
            text = F.lit(label) if name != "diversification" else (
                F.when(june, "Diversification effect 1").when(september, "Diversification</font> <font>effect").otherwise(label))
            old = F.when(F.col("old").isNotNull(), F.concat(F.lit("<td>"), _number(F.col("old")[name], june), F.lit("</td>"))).otherwise("")
            out.append(F.concat(F.lit("<tr><td><font>"), text, F.lit("</font></td><td></td><td>"), _number(F.col(name) + add, june),
                                F.lit("</td>"), old if second else F.lit(""), F.lit("</tr>\n")))
        return F.concat(*out, F.lit("</TABLE>\n"))

    level = F.when(year % 2 == 0, "one-day horizon at a 95%&nbsp;confidence <b>level</b>").otherwise("one-day horizon at a 99% level")
    html = F.concat(F.lit("<html><p>Risk &amp; capital: "), level, F.lit("</p><table><tr><td>Other</td><td>1</td></tr></table>\n"),
                    table(0.0, True), table(1.0, False), F.lit("<table><tr><td>Diversification effect of funding</td></tr></table></html>"))
    return rows.select(F.concat(F.lit("F-"), F.date_format("period_end", "yyyyMM")).alias("accession"),
                       F.when(month == 12, "10-K").otherwise("10-Q").alias("form"), F.date_add("period_end", 35).alias("filed"),
                       html.alias("html"))


SINCE = "1990-01-01"  # filings before this day are not asked for


class Study(StagedRun):
    """Stages of the study, stored like those of the daily run, whose one scan of the line items it shares."""

    def __init__(self, spark: SparkSession, sf_dir: str, cfg: RunConfig, store: str | None = None):
        super().__init__(spark, "study", store)
        self.sf_dir, self.cfg, self.rules = sf_dir, cfg, cfg.study

    @stage()
    def disclosed(self) -> DataFrame:
        return wh.disclosed(self.spark, self.sf_dir)

    @stage("disclosed")
    def filings(self) -> DataFrame:
        return write_filings(self.disclosed)

    @cached_property
    def landed(self) -> str:
        """Filings landed as one file per document, with the index pages next to them."""
        root = f"{self.store}/landed"
        (self.filings.select("accession", F.regexp_replace("html", "\n", " ").alias("value")).write.mode("overwrite")
         .partitionBy("accession").text(f"{root}/documents"))
        entry = F.concat(F.lit("<entry><accession-number>"), F.col("accession"), F.lit("</accession-number><filing-type>"), F.col("form"),
                         F.lit("</filing-type><filing-date>"), F.col("filed").cast("string"), F.lit("</filing-date></entry>"))
        amended = F.regexp_replace(entry, "</filing-type>", "/A</filing-type>")
        self.filings.select(F.concat(F.lit("<feed>"), entry, amended, F.lit("</feed>")).alias("value")).write.mode("overwrite").text(f"{root}/index")
        return root

    @cached_property
    def documents(self) -> DataFrame:
        """(accession, html, sha256) read back from the landed files."""
        docs = files.read_documents(self.spark, f"{self.landed}/documents")
        return docs.select(F.regexp_extract("path", r"accession=([^/]+)/", 1).alias("accession"), "html", "sha256")

    @cached_property
    def manifest(self) -> DataFrame:
        index = self.spark.read.option("wholetext", True).text(f"{self.landed}/index").withColumnRenamed("value", "text")
        return files.filing_manifest(index, ["10-Q", "10-K"], SINCE)

    @cached_property
    def landed_filings(self) -> DataFrame:
        """(accession, form, filed, html, sha256): the documents that landed and are in the manifest."""
        return self.documents.join(self.manifest, "accession")

    @stage("filings")
    def parsed(self) -> DataFrame:
        return X.parse_filings(self.landed_filings)

    @stage("parsed")
    def quarters(self) -> DataFrame:
        return X.quarterly_averages(self.parsed)

    @stage()
    def levels(self) -> DataFrame:
        return V.benchmark_panel(wh.benchmarks(daily_run(self.spark, self.sf_dir, self.cfg).kinds), wh.BENCHMARK_CATEGORY)

    @stage("levels")
    def vol(self) -> DataFrame:
        return V.trailing_vol(self.levels, self.rules)

    @stage("vol")
    def quarterly_vol(self) -> DataFrame:
        return V.quarterly_vol(self.vol)

    @stage("quarters", "quarterly_vol")
    def fit(self) -> DataFrame:
        return V.with_interval(V.vol_fit(self.quarters, self.quarterly_vol, self.rules), self.rules)

    @cached_property
    def correlation(self) -> DataFrame:
        return V.rolling_correlation(self.levels, "equity_prices", "interest_rates", self.rules)

    @stage("quarters", "levels")
    def diversification(self) -> DataFrame:
        return V.diversification(self.quarters, self.correlation, self.rules)

    @stage("quarters", "quarterly_vol")
    def episodes(self) -> DataFrame:
        pairs = self.spark.createDataFrame(list(EPISODES), "name string, `from` string, `to` string").select(
            "name", F.col("from").cast("date").alias("from"), F.col("to").cast("date").alias("to"))
        return V.episodes(self.quarters, self.quarterly_vol, pairs, self.rules)


_STUDIES: dict[tuple, Study] = {}


def study_of(spark: SparkSession, sf_dir: str, cfg: RunConfig) -> Study:
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, cfg)
    if key not in _STUDIES:
        _STUDIES[key] = Study(spark, sf_dir, cfg)
    return _STUDIES[key]


def release_studies() -> None:
    _STUDIES.clear()
