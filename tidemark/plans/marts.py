"""Star schema: five dimensions, six facts and two study facts (M0.1-M0.13)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions.text import signed_amount
from tidemark.operators import backtest as B
from tidemark.operators import disclosure as X
from tidemark.operators import stress
from tidemark.plans.daily import DailyRun
from tidemark.plans.study import Study
from tidemark.sources import files

# Display labels and orders.
CONTROL_LABELS = {
    "raw_duplicates": "Duplicate source rows", "invalid_values": "Invalid values", "missing_prices": "Missing prices",
    "stale_prices": "Stale prices", "interior_gaps": "Gaps inside series", "futures_roll": "Futures roll check",
    "dividend_adjustment": "Dividend adjustment check", "return_outliers": "Unusual moves", "cross_source": "Cross-source check",
    "revisions": "Historical revisions", "history_sufficiency": "History for VaR", "position_reconciliation": "Position reconciliation",
    "position_coverage": "Positions priced", "lineage_complete": "Data lineage recorded", "reporting_sla": "Reporting SLA"}
COMPONENT_LABELS = {"previous": ("Previous day", 0), "positions": ("Trades", 1), "levels": ("Market moves", 2),
                    "window": ("Scenario window rolled", 3), "current": ("Today", 4)}
STATUS_RANK = {"FAIL": 1, "WARN": 2, "INFO": 3, "PASS": 4}


def _lookup(values: dict, key: str):
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])[F.col(key)]


class Marts:
    """Marts of one daily run and one study, planned lazily."""

    def __init__(self, run: DailyRun, study: Study):
        self.run, self.study = run, study
        self.as_of = F.lit(run.as_of)

    @cached_property
    def dim_instrument(self) -> DataFrame:
        return self.run.instruments.select("instrument_id", "name", "asset_class", "desk", "currency", "quote", "source", "ticker", "tenor_years")

    @cached_property
    def dim_desk(self) -> DataFrame:
        return self.run.instruments.select("desk").distinct()

    @cached_property
    def dim_method(self) -> DataFrame:
        risk = self.run.cfg.risk
        rows = [(m.name, m.label, i) for i, m in enumerate(risk.methods)]
        frame = self.run.spark.createDataFrame(rows, "method string, label string, method_order int")
        primary = F.col("method") == risk.primary
        return frame.select("method", F.when(primary, F.concat("label", F.lit(" (primary)"))).otherwise(F.col("label")).alias("method_label"),
                            primary.cast("int").alias("is_primary"), "method_order")

    @cached_property
    def dim_scenario(self) -> DataFrame:
        """Available scenarios; the two largest losses are listed only when negative."""
        losses = stress.largest_losses(self.run.stress_positions, 2).filter("pnl < 0").groupBy("scenario").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(
                F.col("instrument_id"), F.lit(" "), signed_amount(F.col("pnl") / 1e6, 2), F.lit("m")).alias("text")))), lambda x: x["text"]), ", ").alias("l"))
        day = lambda c: F.date_format(c, "dd MMM yyyy")
        past = self.run.historical.filter("available").select(
            "scenario", F.col("short").alias("scenario_name"), F.col("name").alias("description"), F.lit("Historical").alias("kind"),
            F.concat(day("first_date"), F.lit(" to "), day("last_date")).alias("window"), F.col("pnl").alias("pnl_base"), F.col("worst_pnl").alias("worst_point_base"))
        totals = self.run.hypothetical_positions.groupBy("scenario").agg(F.sum("pnl").alias("pnl_base"))
        named = self.run.shocks.select("scenario", "short", "name").distinct()
        instant = totals.join(named, "scenario").select(
            "scenario", F.col("short").alias("scenario_name"), F.col("name").alias("description"), F.lit("Hypothetical").alias("kind"),
            F.lit("Instant shock").alias("window"), "pnl_base", F.lit(None).cast("double").alias("worst_point_base"))
        return past.unionByName(instant).join(losses, "scenario", "left").withColumn("largest_loss", F.coalesce("l", F.lit("none"))).drop("l")

    @cached_property
    def dim_date(self) -> DataFrame:
        first = self.run.positions.agg(F.min("as_of").alias("lo"))
        days = first.select(F.explode(F.sequence(F.col("lo"), self.as_of)).alias("date")).filter(D.is_business_day(F.col("date")))
        return days.select("date", F.year("date").alias("year"), F.quarter("date").alias("quarter"), F.month("date").alias("month"),
                           F.date_format("date", "MMM").alias("month_name"), F.date_format("date", "E").alias("weekday"))

    @cached_property
    def fact_position_daily(self) -> DataFrame:
        values = self.run.daily_values.select("date", "instrument_id", "unit_value")
        rows = self.run.positions.withColumnRenamed("as_of", "date").join(values, ["date", "instrument_id"], "left")
        return rows.select("date", "instrument_id", "quantity", F.col("unit_value").alias("unit_value_base"),
                           (F.col("quantity") * F.col("unit_value")).alias("market_value_base"))

    @cached_property
    def fact_backtest(self) -> DataFrame:
        return self.run.backtest.select("date", "method", "var95", "var99", "pnl", B.exception(F.col("pnl"), F.col("var99")).alias("exception_99"),
                                        B.exception(F.col("pnl"), F.col("var95")).alias("exception_95"))

    @cached_property
    def fact_risk(self) -> DataFrame:
        return self.run.risk_results.select(self.as_of.alias("date"), "method", "measure", "scope", "scope_id", F.col("value").alias("value_base"))

    @cached_property
    def fact_stress(self) -> DataFrame:
        kinds = self.run.stress_positions.select("scenario", "kind").distinct()
        names = self.dim_scenario.select("scenario", "scenario_name")
        rows = stress.by_desk(self.run.stress_positions).join(kinds, "scenario").join(names, "scenario", "left")
        return rows.select(self.as_of.alias("date"), "scenario", "kind", "desk", F.col("pnl").alias("pnl_base"),
                           F.coalesce("scenario_name", "scenario").alias("scenario_name"))

    @cached_property
    def fact_var_explain(self) -> DataFrame:
        labels = {k: v[0] for k, v in COMPONENT_LABELS.items()}
        orders = {k: v[1] for k, v in COMPONENT_LABELS.items()}
        return self.run.var_explain.select(self.as_of.alias("date"), F.lit(self.run.previous).alias("prev_date"), "measure", "component",
                                           F.col("value").alias("value_base"), _lookup(labels, "component").alias("component_label"),
                                           _lookup(orders, "component").alias("component_order"))

    @cached_property
    def fact_controls(self) -> DataFrame:
        return self.run.controls.select(self.as_of.alias("date"), "control", "status", "n_affected", "detail",
                                        F.coalesce(_lookup(CONTROL_LABELS, "control"), F.col("control")).alias("control_label"),
                                        F.coalesce(_lookup(STATUS_RANK, "status"), F.lit(9)).alias("status_rank"))

    @cached_property
    def fact_disclosed_var(self) -> DataFrame:
        return self.study.parsed.select("accession", "form", "filed", "period_end", "measure", "horizon", "column", *X.CATEGORIES, "identity_gap")

    @cached_property
    def fact_benchmark_vol(self) -> DataFrame:
        wide = self.study.quarterly_vol.groupBy("window", "period_end").pivot("category", list(self.study.rules.categories)).agg(F.first("vol"))
        return wide.select("window", "period_end", *self.study.rules.categories)

    @cached_property
    def filing_lineage(self) -> DataFrame:
        """Where every disclosed figure comes from: the landed document, its hash, and how many tables it gave."""
        return X.filing_lineage(self.study.landed_filings, self.study.parsed)

    NAMES = ("dim_instrument", "dim_desk", "dim_method", "dim_scenario", "dim_date", "fact_position_daily", "fact_backtest", "fact_risk",
             "fact_stress", "fact_var_explain", "fact_controls", "fact_disclosed_var", "fact_benchmark_vol", "filing_lineage")

    def export(self, folder: str) -> dict[str, int]:
        """Write every mart as CSV, side by side; rows by mart, counted while writing, so that each mart is read once."""
        frames = [(name, getattr(self, name)) for name in self.NAMES]
        with ThreadPoolExecutor(6) as pool:
            counts = list(pool.map(lambda item: files.export_csv(item[1], f"{folder}/{item[0]}"), frames))
        return dict(zip(self.NAMES, counts))

    def load_exported(self, folder: str, name: str) -> DataFrame:
        """Read one exported mart with its own schema."""
        return files.load_csv(self.run.spark, f"{folder}/{name}", getattr(self, name).schema)
