"""Queries over files, exposures, marts, measures, filings and the volatility study."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import disclosure as X
from tidemark.operators import exposure
from tidemark.operators import stress
from tidemark.operators import volstudy as V
from tidemark.plans import pipeline
from tidemark.plans import warehouse as wh
from tidemark.plans.daily import DailyRun
from tidemark.plans.marts import Marts
from tidemark.plans.measures import MEASURES, slices
from tidemark.plans.queries import mm, query, ratio, var_by_computed_day
from tidemark.plans.study import Study, study_of
from tidemark.session import shared_folder
from tidemark.sources import files, tables
from tidemark.sources.parts import PartedTable


def _study(run: DailyRun) -> Study:
    return study_of(run.spark, run.sf_dir, run.cfg)


def _marts(run: DailyRun) -> Marts:
    if not hasattr(run, "_marts"):
        run._marts = Marts(run, _study(run))
    return run._marts


# --- Exposures, attention, headline facts (R33-R35, A11, A12, O3, O5, F26) ---------------------------


@query
def position_table(run: DailyRun) -> DataFrame:
    """R33, A12, W20, J22."""
    rows = exposure.position_table(run.today, run.instruments)
    return rows.select("instrument_id", "name", "desk", mm("mv").alias("mv"), ratio("share_of_gross").alias("share_of_gross"))


@query
def top_positions(run: DailyRun) -> DataFrame:
    """The ten largest by absolute value."""
    rows = exposure.position_table(run.today, run.instruments).orderBy(F.abs("mv").desc(), "instrument_id").limit(10)
    return rows.select("instrument_id", mm("mv").alias("mv"), ratio("share_of_gross").alias("share_of_gross"))


@query
def desk_exposure(run: DailyRun) -> DataFrame:
    """A11."""
    return exposure.desk_exposure(run.today).select("desk", mm("long").alias("long"), mm("short").alias("short"), mm("net").alias("net"), "positions")


@query
def attention_items(run: DailyRun) -> DataFrame:
    """R34."""
    rows = exposure.attention_items(exposure.position_table(run.today, run.instruments), run.var_explain, run.backtest_summary, run.controls, run.cfg.risk)
    return rows.select("rule", "subject", ratio("value", 4).alias("value"), "threshold")


@query
def headline_facts(run: DailyRun) -> DataFrame:
    """R35, O7, O4."""
    hypothetical = run.hypothetical_positions.groupBy("scenario").agg(F.sum("pnl").alias("pnl"))
    worst = stress.largest_losses(run.stress_positions.filter("kind = 'historical'"), 1)
    rows = exposure.headline_facts(run.totals, run.desks, run.var_explain, run.historical, hypothetical, worst, run.cfg.risk)
    money = F.col("fact").isin("largest_driver", "worst_historical", "worst_historical_point", "worst_hypothetical")
    return rows.select("fact", "subject", F.when(money, mm("value")).otherwise(ratio("value", 4)).alias("value"))


def _payload(rows: DataFrame, section: str, item: str, **fields: Column) -> DataFrame:
    """(section, item, payload): the fields as one JSON object of texts, in their order; a null is left out."""
    return rows.select(F.lit(section).alias("section"), F.col(item).cast("string").alias("item"), F.to_json(F.struct(*(f.cast("string").alias(n) for n, f in fields.items()))).alias("payload"))


def _text(value: Column | str) -> Column:
    """Money in millions to four decimals; null stays null."""
    amount = mm(value)
    return F.when(amount.isNotNull(), F.format_string("%.4f", amount))


@query
def run_payload(run: DailyRun) -> DataFrame:
    """what a page about the run shows, one JSON object per item: totals, explanation, desks, stress, history, VaR by day computed, largest positions, controls.

    Sections are rows, so nothing is gathered to build the whole; a page joins them as it needs them.
    """
    primary = run.cfg.risk.primary
    totals = run.totals.filter(F.col("method") == primary).groupBy(F.lit("totals").alias("item")).pivot("measure", ["VaR95", "VaR99", "ES975"]).agg(F.first("value"))
    parts = ("previous", "positions", "levels", "window", "current")
    explain = run.var_explain.groupBy("measure").pivot("component", list(parts)).agg(F.first("value"))
    scenarios = _marts(run).dim_scenario
    summary = run.backtest_summary.select("method", "zone", "last_n", "last_exceptions")
    shares = exposure.position_table(run.today, run.instruments).orderBy(F.abs("mv").desc(), "instrument_id").limit(10)
    computed = var_by_computed_day(run).groupBy("computed_on").pivot("method", [m.name for m in run.cfg.risk.methods]).agg(F.first("var99"))
    number = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c)))
    sections = [
        _payload(totals, "totals", "item", var95=_text("VaR95"), var99=_text("VaR99"), es975=_text("ES975")),
        _payload(explain, "explain", "measure", **{c: _text(c) for c in parts}),
        _payload(run.desks, "desk", "desk", var=_text("VaR99_standalone"), es=_text("ES975_contribution")),
        _payload(scenarios, "stress", "scenario_name", kind=F.col("kind"), window=F.col("window"), pnl=_text("pnl_base"), worst=_text("worst_point_base"), largest=F.col("largest_loss")),
        _payload(run.backtest.filter(F.col("method") == primary), "history", "date", pnl=_text("pnl"), var99=_text("var99")),
        _payload(computed, "var_history", "computed_on", **{m.name: number(m.name) for m in run.cfg.risk.methods}),
        _payload(summary, "backtest", "method", zone=F.col("zone"), days=F.col("last_n"), exceptions=F.col("last_exceptions")),
        _payload(shares, "position", "instrument_id", name=F.col("name"), desk=F.col("desk"), mv=_text("mv"), share=F.format_string("%.4f", ratio("share_of_gross", 4))),
        _payload(_marts(run).fact_controls, "control", "control_label", status=F.col("status"), affected=F.col("n_affected"))]
    return reduce(DataFrame.unionByName, sections)


# --- Landed files (S1-S6, S16-S20, F13, F15, F16) ----------------------------------------------------


def _wide(run: DailyRun, source: str) -> DataFrame:
    rows = run.raw.filter(F.col("source") == source)
    tickers = sorted(r["ticker"] for r in run.instruments.filter(F.col("source") == source).select("ticker").collect())
    return rows.groupBy("date").pivot("ticker", tickers).agg(F.first("close"))


@query
def csv_named_month_dates(run: DailyRun) -> DataFrame:
    """Wide CSV written from the quotes, read back."""
    wide = _wide(run, "cb")
    path = shared_folder(run.spark, "wide-named")
    wide.select(F.date_format("date", "dd MMM yyyy").alias("DATE"), *[c for c in wide.columns if c != "date"]).write.option("header", True).csv(path)
    return files.read_wide_named_months(run.spark, path).select("ticker", "date", ratio("close").alias("close"))


@query
def csv_iso_dates(run: DailyRun) -> DataFrame:
    """Missing values as '.', a lower date bound."""
    wide = _wide(run, "fed")
    path = shared_folder(run.spark, "wide-iso")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit(".")).alias(c) for c in wide.columns if c != "date"]
    wide.select(F.col("date").cast("string").alias("observation_date"), *cells).write.option("header", True).csv(path)
    return files.read_wide_iso(run.spark, path, "1996-07-01").select("ticker", "date", ratio("close").alias("close"))


@query
def csv_long_dividends(run: DailyRun) -> DataFrame:
    """S3: long CSV with missing dividends."""
    path = shared_folder(run.spark, "long")
    rows = run.raw.filter("source = 'px'").select("ticker", "date", "close", "adj_close", F.when(F.col("dividend") > 0, F.col("dividend")).alias("dividend"))
    rows.write.option("header", True).csv(path)
    return files.read_long(run.spark, path).select("ticker", "date", ratio("close").alias("close"), ratio("dividend").alias("dividend"))


@query
def csv_long_without_dividends(run: DailyRun) -> DataFrame:
    """S3: files written before dividends were requested."""
    path = shared_folder(run.spark, "long-old")
    run.raw.filter("source = 'px'").select("ticker", "date", "close", "adj_close").write.option("header", True).csv(path)
    return files.read_long(run.spark, path).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("dividend").alias("dividend"))


@query
def csv_long_mixed_headers(run: DailyRun) -> DataFrame:
    """S3: files of every source in one folder, old ones without dividends and some with their columns in another order."""
    path = shared_folder(run.spark, "long-mixed")
    old, new = F.col("date") < "1997-01-01", F.col("date") >= "1999-01-01"
    for keep, columns in ((old, ("ticker", "date", "close", "adj_close")), (~old & ~new, ("ticker", "date", "close", "adj_close", "dividend")), (new, ("date", "dividend", "ticker", "adj_close", "close"))):
        run.raw.filter(keep).select(*columns).write.mode("append").option("header", True).csv(path)
    rows = files.read_long(run.spark, path)
    return rows.select("ticker", "date", ratio("close").alias("close"), ratio("adj_close").alias("adj_close"), ratio("dividend").alias("dividend"))


@query
def csv_two_level_header(run: DailyRun) -> DataFrame:
    """S4: 'measure|ticker' columns stacked."""
    path = shared_folder(run.spark, "two-level")
    wide = None
    for m in ("close", "adj_close", "dividend"):
        tickers = sorted(r["ticker"] for r in run.instruments.filter("source = 'px'").select("ticker").collect())
        part = run.raw.filter("source = 'px'").groupBy("date").pivot("ticker", tickers).agg(F.first(m))
        part = part.select("date", *[F.col(t).alias(f"{m}|{t}") for t in tickers])
        wide = part if wide is None else wide.join(part, "date")
    wide.write.option("header", True).csv(path)
    return files.read_two_level(run.spark, path).select("ticker", "date", ratio("close").alias("close"), ratio("dividend").alias("dividend"))


def _landed(run: DailyRun) -> str:
    """Raw files of three sources in two dated folders; the older one holds the years before 2000 only."""
    if not hasattr(run, "_landing"):
        root = shared_folder(run.spark, "landing")
        for stamp, keep in (("20010101T000000", F.col("date") < "2000-01-01"), ("20011105T000000", F.lit(True))):
            for source in ("px", "cb", "fed"):
                rows = run.raw.filter((F.col("source") == source) & keep)
                rows.select("ticker", "date", "close", "adj_close", "dividend").repartition(2, "ticker").write.option("header", True).csv(f"{root}/{stamp}/{source}.csv")
        run._landing = root
    return run._landing


@query
def raw_lineage(run: DailyRun) -> DataFrame:
    """Hash, fetch id and rows of the landed files, per folder and source."""
    records = files.lineage_records(run.spark, _landed(run), "part-*.csv")
    stamp = F.regexp_extract("raw_path", r"/([^/]+)/[^/]+\.csv/", 1)
    whole = records.groupBy(stamp.alias("stamp"), "source", "request").agg(
        F.sum("n_rows").alias("n_rows"), F.min(F.length("sha256") == 64).alias("hashed"),
        F.min(F.col("fetch_id") == F.concat("source", F.lit("-"), F.substring("sha256", 1, 12))).alias("named"))
    return whole


@query
def latest_raw_files(run: DailyRun) -> DataFrame:
    """The newest folder per source, parsed."""
    root = _landed(run)
    newest = files.newest_files(files.file_names(run.spark, root, "part-*.csv"), root, ["px", "cb", "fed"])
    rows = files.read_long(run.spark, [r["path"] for r in newest.collect()])
    return rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last"))


@query
def filing_documents(run: DailyRun) -> DataFrame:
    """Landed documents read as bytes, decoded and hashed."""
    docs = _study(run).documents
    return docs.select("accession", (F.sha2(F.encode("html", "UTF-8"), 256) == F.col("sha256")).alias("same_bytes"),
                       (F.col("html").startswith("<html>") & F.rtrim("html").endswith("</html>\n")).alias("complete"))


@query
def filing_manifest(run: DailyRun) -> DataFrame:
    """Index pages to filings, amendments dropped."""
    return _study(run).manifest.select("accession", "form", "filed")


@query
def export_counts(run: DailyRun) -> DataFrame:
    """Every mart exported, and its rows as counted by the write itself."""
    counts = _marts(run).export(shared_folder(run.spark, "export"))
    return run.spark.createDataFrame(list(counts.items()), "mart string, n long")


@query
def filing_lineage_export(run: DailyRun) -> DataFrame:
    """The lineage of filings after export and typed load."""
    marts, folder = _marts(run), shared_folder(run.spark, "export")
    files.export_csv(marts.filing_lineage, f"{folder}/filing_lineage")
    rows = marts.load_exported(folder, "filing_lineage")
    return rows.select("accession", "form", "filed", "tables_parsed", F.length("sha256").alias("hash_length"))


@query
def measures_by_slice(run: DailyRun) -> DataFrame:
    """Gross, net and share of gross for every date and every slice of desk, asset class and currency, from one pass."""
    rows = slices(_marts(run))
    return rows.select("date", "desk", "asset_class", "currency", mm("gross").alias("gross"), mm("net").alias("net"), ratio("share_of_gross").alias("share_of_gross"))


@query
def export_round_trip(run: DailyRun) -> DataFrame:
    """The risk fact after export and typed load."""
    marts, folder = _marts(run), shared_folder(run.spark, "export")
    files.export_csv(marts.fact_risk, f"{folder}/fact_risk")
    return marts.load_exported(folder, "fact_risk").select("date", "method", "measure", "scope", "scope_id", mm("value_base").alias("value"))


@query
def daily_pipeline(run: DailyRun) -> DataFrame:
    """A whole run stored under a run id; rows per stored table, and its status."""
    finished = dt.datetime.combine(run.as_of, dt.time(23, 0), tzinfo=dt.timezone.utc)
    done = pipeline.execute(run, "run-1", shared_folder(run.spark, "results"), clock=lambda: finished)
    out = None
    for name in pipeline.TABLES:
        rows = run.spark.read.parquet(f"{done.store}/{name}").filter(F.col("run_id") == "run-1")
        one = rows.agg(F.lit(name).alias("stored"), F.count(F.lit(1)).cast("string").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out.unionByName(pipeline.run_log(run.spark, done.store).select(F.lit("status").alias("stored"), F.col("status").alias("value")))


#: A row of each stored table as text, in whole units, so that digests do not depend on how numbers are printed.
ROW_TEXT = {
    "market_data": "concat_ws('|', instrument_id, CAST(date AS STRING), CAST(CAST(floor(close * 1000000 + 0.5) AS BIGINT) AS STRING))",
    "reference_prices": "concat_ws('|', instrument_id, purpose, CAST(date AS STRING), CAST(CAST(floor(value * 1000000 + 0.5) AS BIGINT) AS STRING))",
    "dividends": "concat_ws('|', instrument_id, CAST(ex_date AS STRING), CAST(CAST(floor(amount * 1000000 + 0.5) AS BIGINT) AS STRING))",
    "positions": "concat_ws('|', instrument_id, CAST(as_of AS STRING), CAST(CAST(quantity AS BIGINT) AS STRING))",
    "trades": "concat_ws('|', instrument_id, CAST(trade_date AS STRING), CAST(CAST(quantity AS BIGINT) AS STRING))",
    "lineage": "fetch_id",
    "instruments": "concat_ws('|', instrument_id, desk, currency)",
}


def _early(run: DailyRun) -> DailyRun:
    """The run of the day before, on what had arrived by then: the retained line items."""
    early = DailyRun(run.spark, run.sf_dir, run.cfg, as_of=str(run.previous))
    early._done |= {"marks": run.marks, "instruments": run.instruments, "all_days": run.all_days,
                    "market": wh.market_data(run.marks, run.instruments, "kept").select(*run.market.columns)}
    return early


def _digest(rows: DataFrame, text: str) -> tuple[int, int]:
    """Rows, and a sum over hashes of them."""
    found = rows.select(F.conv(F.substring(F.md5(F.expr(text)), 1, 8), 16, 10).cast("long").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h")).first()
    return found["n"], found["h"] or 0


EMPTIED = (dt.date(1996, 5, 1), dt.date(1996, 5, 31))


@query
def two_day_store(run: DailyRun) -> DataFrame:
    """Rows and digest of every stored table after each step.

    A day loaded from an early delivery, the next from the full one, that one again, and a book that has no trade in one month any more.
    """
    store, out = shared_folder(run.spark, "two-days"), []

    def taken(step: str, names: tuple[str, ...], day: DailyRun) -> None:
        out.extend((step, name, *_digest(pipeline.loaded_table(day, store, name).read(), ROW_TEXT[name])) for name in names)

    for step, day in (("first day", _early(run)), ("second day", run), ("second day again", run)):
        changed = pipeline.load(day, store).revisions
        taken(step, tuple(ROW_TEXT), day)
        out.append((step, "revisions", changed.count(), 0))
    trades = pipeline.loaded_table(run, store, "trades")
    trades.replace_range(trades.read().filter(~F.col("trade_date").between(*EMPTIED)), last=run.as_of)
    taken("a month empty", ("trades",), run)
    return run.spark.createDataFrame(out, "step string, stored string, n long, digest long")


@query
def changed_months(run: DailyRun) -> DataFrame:
    """Of two deliveries of the same history, the months that a load reads and writes, found by digest alone."""
    table = PartedTable(run.spark, shared_folder(run.spark, "months"), run.market.schema, ("instrument_id", "date"), "date")
    table.upsert(run.market)
    market = run.market.withColumn("close", F.when((F.col("instrument_id") == "Brand#12") & (F.month("date") == 2), F.col("close") + 1).otherwise(F.col("close")))
    change = table.upsert(market)
    months = run.spark.createDataFrame([(k,) for k in change.parts], "month int")
    rows = table.read(change.parts).groupBy(F.date_format("date", "yyyyMM").cast("int").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("close") * 10_000 + 0.5)).alias("close"))
    return months.join(rows, "month").select("month", "n", "close")


@query
def stored_range_replaced(run: DailyRun) -> DataFrame:
    """A stored book replaced up to a day by one that has no trade in one month; what is left by month."""
    cut = dt.date(1998, 6, 15)
    table = PartedTable(run.spark, shared_folder(run.spark, "book"), run.trades.schema, ("trade_id",), "trade_date")
    table.upsert(run.trades)
    renewed = run.trades.filter((F.col("trade_date") <= F.lit(cut)) & ~F.col("trade_date").between(*EMPTIED)).withColumn("quantity", F.col("quantity") * 2)
    table.replace_range(renewed, last=cut)
    return table.read().groupBy(F.date_format("trade_date", "yyyyMM").cast("int").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


@query
def rerun_without_rows(run: DailyRun) -> DataFrame:
    """Results of two runs stored, then one of them again with no row: it has none afterwards, the other keeps its own."""
    path = shared_folder(run.spark, "results")
    for run_id in ("run-1", "run-2"):
        tables.replace_rows(run.totals, path, as_of=run.as_of, run_id=run_id)
    tables.replace_rows(run.totals.limit(0), path, as_of=run.as_of, run_id="run-1")
    return run.spark.read.parquet(path).select("run_id", "method", "measure", mm("value").alias("value"))


@query
def backtest_carried(run: DailyRun) -> DataFrame:
    """B1: the backtest of the day before stored, then only the newest day computed and added."""
    store = shared_folder(run.spark, "carried")
    before = DailyRun(run.spark, run.sf_dir, run.cfg, as_of=str(run.previous))
    before._done |= {name: getattr(run, name) for name in ("marks", "instruments", "market", "references", "dividends", "all_days")}
    for day in (before, run):
        done = pipeline.carried_backtest(day, store, pipeline.load(day, store).changed_from)
    return done.rows.select("date", "method", mm("var95").alias("var95"), mm("var99").alias("var99"), mm("pnl").alias("pnl"))


# --- Filings (X1-X7, X19, X21) -----------------------------------------------------------------------


@query
def filings_parsed(run: DailyRun) -> DataFrame:
    """Every extracted column."""
    return _study(run).parsed


@query
def filings_fourth_quarters(run: DailyRun) -> DataFrame:
    """X3."""
    return _study(run).parsed.filter(F.col("column") == 2).select("accession", "period_end", "total")


@query
def filings_identity_gap(run: DailyRun) -> DataFrame:
    """Largest gap between parts and total, and tables parsed."""
    return _study(run).parsed.agg(F.max(F.abs("identity_gap")).alias("largest_gap"), F.count(F.lit(1)).alias("tables"))


@query
def filing_columns(run: DailyRun) -> DataFrame:
    """X5."""
    rows = X.first_two_columns(_study(run).filings)
    return rows.select("accession", "period_end", F.col("c1.total").alias("total_1"), F.col("c2.total").alias("total_2"))


@query
def reprint_check(run: DailyRun) -> DataFrame:
    """X6, J18."""
    return X.reprint_classes(X.first_two_columns(_study(run).filings))


@query
def phrase_flag(run: DailyRun) -> DataFrame:
    """X7, P8, F18."""
    return X.states_confidence(_study(run).filings).groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.count_if("states_95").alias("states_95"))


@query
def filing_lineage(run: DailyRun) -> DataFrame:
    """X21."""
    rows = X.filing_lineage(_study(run).landed_filings, _study(run).parsed)
    return rows.select("accession", "form", "filed", "tables_parsed", (F.length("sha256") == 64).alias("hashed"))


@query
def missing_quarters(run: DailyRun) -> DataFrame:
    """Quarters without a published average when fourth quarters are taken from annual reports only."""
    first_columns = _study(run).parsed.filter("column = 1 and measure = 'average' and horizon = 'quarter'")
    return X.missing_quarters(first_columns.select("period_end"))


# --- Volatility study (X8-X18, X20) ------------------------------------------------------------------


@query
def benchmark_panel(run: DailyRun) -> DataFrame:
    """X8, A9."""
    return _study(run).levels.select("date", "category", ratio("level").alias("level"))


@query
def trailing_vol(run: DailyRun) -> DataFrame:
    """X9, W7."""
    return _study(run).vol.filter("vol is not null").select("window", "date", "category", ratio("vol").alias("vol"))


@query
def quarterly_vol(run: DailyRun) -> DataFrame:
    """X10, A15, F11."""
    return _study(run).quarterly_vol.select("window", "period_end", "category", ratio("vol").alias("vol"))


@query
def vol_fit(run: DailyRun) -> DataFrame:
    """X11, J10, W14, W15, A17, A18."""
    return _study(run).fit.select("category", "window", "quarters", *[ratio(c).alias(c) for c in ("corr_changes", "corr_levels", "elasticity")])


@query
def fisher_interval(run: DailyRun) -> DataFrame:
    """X12, F6."""
    return _study(run).fit.select("category", "window", ratio("ci_lo").alias("ci_lo"), ratio("ci_hi").alias("ci_hi"))


@query
def best_window(run: DailyRun) -> DataFrame:
    """X13, A13."""
    return V.best_windows(_study(run).fit).select("category", "window", ratio("corr_changes").alias("corr_changes"), "overlap")


@query
def implied_index(run: DailyRun) -> DataFrame:
    """X14, W16."""
    s = _study(run)
    rows = V.implied_index(s.quarters, s.quarterly_vol, V.best_windows(s.fit), s.rules)
    return rows.select("category", "period_end", ratio("implied", 4).alias("implied"))


@query
def rolling_correlation(run: DailyRun) -> DataFrame:
    """W8."""
    return _study(run).correlation.filter("corr is not null").select("date", ratio("corr").alias("corr"))


@query
def diversification_share(run: DailyRun) -> DataFrame:
    """X15."""
    return _study(run).diversification.select("period_end", ratio("share").alias("share"), ratio("corr").alias("corr"))


@query
def diversification_summary(run: DailyRun) -> DataFrame:
    """X15, A17."""
    rows = V.diversification_summary(_study(run).diversification)
    return rows.select(ratio("lowest").alias("lowest"), ratio("highest").alias("highest"), ratio("corr").alias("corr"), "quarters")


@query
def episodes(run: DailyRun) -> DataFrame:
    """X16, U6."""
    pct = ("var_change_pct", "vol_change_pct", "residual_pct")
    return _study(run).episodes.select("name", "category", "window", "var_from", "var_to", *[ratio(c).alias(c) for c in pct])


@query
def residual_range(run: DailyRun) -> DataFrame:
    """X17."""
    return V.residual_range(_study(run).episodes).select("name", "category", ratio("lowest").alias("lowest"), ratio("highest").alias("highest"))


@query
def yearly_means(run: DailyRun) -> DataFrame:
    """X18, A16."""
    return V.yearly_means(_study(run).quarters, X.CATEGORIES).select(F.col("year").cast("bigint").alias("year"), *[ratio(c).alias(c) for c in X.CATEGORIES])


@query
def yearly_extremes(run: DailyRun) -> DataFrame:
    """X18, A13, A21."""
    s = _study(run)
    rows = V.yearly_extremes(s.quarters, s.rules, "interest_rates")
    return rows.select(F.col("lowest_year").cast("bigint").alias("lowest_year"), ratio("lowest_total").alias("lowest_total"),
                       F.col("highest_year").cast("bigint").alias("highest_year"), ratio("highest_total").alias("highest_total"), "led", "quarters")


@query
def normal_rescale(run: DailyRun) -> DataFrame:
    """X20, F5."""
    rows = V.normal_rescale(_study(run).quarters, "1999-07-01", "1999-12-31")
    return rows.select(ratio("mean").alias("mean"), ratio("one_day_99").alias("one_day_99"), ratio("rescaled").alias("rescaled"))


# --- Marts (M0.1-M0.13) ------------------------------------------------------------------------------

_MONEY = {"dim_scenario": ("pnl_base", "worst_point_base"), "fact_position_daily": ("market_value_base",), "fact_backtest": ("var95", "var99", "pnl"),
          "fact_risk": ("value_base",), "fact_stress": ("pnl_base",), "fact_var_explain": ("value_base",)}
_RATIO = {"fact_position_daily": ("unit_value_base",), "fact_benchmark_vol": ("interest_rates", "equity_prices", "currency_rates", "commodity_prices")}


def _mart(name: str) -> None:
    def fn(run: DailyRun) -> DataFrame:
        frame = getattr(_marts(run), name)
        money, small = _MONEY.get(name, ()), _RATIO.get(name, ())
        return frame.select(*[mm(c).alias(c) if c in money else ratio(c).alias(c) if c in small else F.col(c) for c in frame.columns])
    fn.__name__ = f"mart_{name}"
    query(fn)


for _name in Marts.NAMES:
    if _name != "filing_lineage":  # filing_lineage_export
        _mart(_name)


# --- Measures (M1-M31) -------------------------------------------------------------------------------


def _measure(name: str) -> None:
    def fn(run: DailyRun) -> DataFrame:
        return MEASURES[name](_marts(run))
    fn.__name__ = f"measure_{name}"
    query(fn)


for _name in MEASURES:
    _measure(_name)


@query
def measure_zone_every_method(run: DailyRun) -> DataFrame:
    """M14-M18 with the slicer on each method in turn."""
    out = None
    for m in run.cfg.risk.methods:
        one = MEASURES["zone_last_250"](_marts(run), m.name).select(F.lit(m.name).alias("method"), "value")
        out = one if out is None else out.unionByName(one)
    return out
