"""One run stored under its run id: the day loaded, results stored, controls with the reporting deadline, run log."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators import backtest as B
from tidemark.operators import controls as C
from tidemark.operators import risk, stress
from tidemark.plans.daily import DailyRun
from tidemark.sources import tables
from tidemark.sources.parts import Change, PartedTable

TABLES = ("risk_results", "backtest", "stress_results", "var_explain", "control_results")
STAGES = ("risk_results", "stress_positions", "var_explain", "controls")


@dataclass(frozen=True)
class StoredRun:
    run_id: str
    store: str
    status: str


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def _event(run: DailyRun, run_id: str, store: str, as_of: dt.date | None, status: str, at: dt.datetime) -> None:
    """A row update of the run log is an appended event."""
    row = [(run_id, as_of, status, at.astimezone(dt.timezone.utc).replace(tzinfo=None))]
    tables.append_table(run.spark.createDataFrame(row, "run_id string, as_of date, status string, at timestamp_ntz"), f"{store}/run_log")


def run_log(spark: SparkSession, store: str) -> DataFrame:
    """One row per run with its newest status."""
    return tables.run_log(spark.read.parquet(f"{store}/run_log"))


#: Stored tables a day is loaded into: keys, and the day whose month is their part (buckets of keys without one).
LOADED = {"market_data": (("instrument_id", "date"), "date"), "reference_prices": (("instrument_id", "purpose", "date"), "date"),
          "dividends": (("instrument_id", "ex_date"), "ex_date"), "positions": (("as_of", "instrument_id"), "as_of"), "trades": (("trade_id",), "trade_date"),
          "lineage": (("fetch_id",), None), "instruments": (("instrument_id",), None)}
REPLACED = ("positions", "trades")
EARLIEST = dt.date(1800, 1, 1)  # before any day


@dataclass(frozen=True)
class Loaded:
    """The changed history of a load, what it did to each table, and the first day of which anything is new."""

    revisions: DataFrame
    changes: dict[str, Change]

    @property
    def changed_from(self) -> dt.date | None:
        if self.changes["instruments"]:
            return EARLIEST
        days = [c.first_day for name, c in self.changes.items() if c and name in ("market_data", "reference_prices", "dividends", "trades")]
        return min((d for d in days if d), default=None)


def loaded_table(run: DailyRun, store: str, name: str) -> PartedTable:
    """A stored table of :data:`LOADED`, with the columns that the run has for it."""
    keys, day = LOADED[name]
    return PartedTable(run.spark, f"{store}/{name}", incoming(run)[name].schema, keys, day)


def incoming(run: DailyRun) -> dict[str, DataFrame]:
    """What the run read, up to its date."""
    cut = F.lit(run.as_of)
    return {"market_data": run.market.filter(F.col("date") <= cut), "reference_prices": run.references.filter(F.col("date") <= cut),
            "dividends": run.dividends.filter(F.col("ex_date") <= cut), "positions": run.positions.filter(F.col("as_of") <= cut),
            "trades": run.trades.filter(F.col("trade_date") <= cut), "lineage": run.lineage, "instruments": run.instruments}


def load(run: DailyRun, store: str) -> Loaded:
    """Bring what the run read into the stored tables, up to its date.

    Market data, references, dividends and lineage are upserted, positions and trades up to the date and all instruments are replaced. Months
    are compared by digest first, so a day that only adds rows reads and writes its own month. Changed rows are found against what
    earlier days stored, in the months that differ, and kept in ``revisions``.
    """
    rows = incoming(run)
    run.ready("market", "references", "dividends", "positions", "instruments")
    market = loaded_table(run, store, "market_data")
    found = market.compare(rows["market_data"])
    differing = rows["market_data"].filter(market.part().isin(found.touched)) if found.touched else rows["market_data"].limit(0)
    changed = C.find_revisions(differing, market.read(found.touched), run.cfg.controls.revision_pct).select("instrument_id", "date", "old_close", "new_close")
    tables.replace_rows(changed, f"{store}/revisions", as_of=run.as_of)  # an empty result too replaces what a load of this day found before

    def bring(name: str) -> Change:
        table = loaded_table(run, store, name)
        if name == "market_data":
            return table.upsert(rows[name], found)
        if name in REPLACED:
            return table.replace_range(rows[name], last=run.as_of)
        return table.replace_range(rows[name]) if name == "instruments" else table.upsert(rows[name])

    with ThreadPoolExecutor(len(LOADED)) as pool:
        changes = dict(zip(LOADED, pool.map(bring, LOADED)))
    return Loaded(run.spark.read.schema(changed.schema).parquet(tables.owned_folder(f"{store}/revisions", as_of=run.as_of)), changes)


@dataclass(frozen=True)
class Carried:
    """Backtest rows, and the first day for which they were computed now (none: all of them were stored)."""

    rows: DataFrame
    computed_from: dt.date | None


def carried_backtest(run: DailyRun, store: str, changed_from: dt.date | None) -> Carried:
    """The rolling backtest, of which only days that no earlier run stored are computed (B1).

    A stored forecast stands as long as nothing before its day changed: computing starts after the last stored day, or on the first day a load
    changed. The cube then has those days only, over one window of scenarios before the first of them. Other settings have another table.
    """
    rules, settings = run.cfg.risk, hashlib.sha256(repr(run.cfg).encode()).hexdigest()[:16]
    columns = StructType.fromDDL("date date, method string, var95 double, var99 double, pnl double")
    table = PartedTable(run.spark, f"{store}/backtest_days/{settings}", columns, ("date", "method"), "date")
    parts = table.listing()[1]
    last = table.read([max(parts)]).agg(F.max("date").alias("d")).first()["d"] if parts else None
    start = min([d for d in (last + dt.timedelta(1) if last else EARLIEST, changed_from) if d], default=EARLIEST)
    ahead = run.calendar.filter("complete").filter(F.col("date") >= F.lit(start)).agg(F.min("ord").alias("k"), F.min("date").alias("d")).first()
    if ahead["k"] is None:
        if parts and start <= last:
            table.replace_range(run.spark.createDataFrame([], columns), first=start)
        return Carried(table.read(), None)
    first = max(ahead["k"] - 1, 0)
    book, oldest = run.book.filter(F.col("k") >= first), max(1, first - rules.window_days + 1)
    cube = risk.scenario_cube(book, run.scenarios.filter(F.col("s") >= oldest), [], rules.window_days)
    forecasts = risk.measures(risk.with_age(cube, run.calendar, rules.window_days), ["k"], rules)
    held = run.holdings.filter(F.col("ord") >= first).select(F.col("ord").alias("k")).distinct()
    moved = run.moves.filter(F.col("ord") > first)
    rows = B.backtest_rows(run.calendar.filter(F.col("ord") > first), held, forecasts, B.realised_pnl(book, moved), rules.backtest_start)
    rows = run._store("carried", rows.select(*columns.fieldNames()))
    table.replace_range(rows, first=start)
    return Carried(table.read(), ahead["d"])


def result_tables(run: DailyRun, backtest: DataFrame) -> dict[str, DataFrame]:
    """The result rows of a run, without run id and date."""
    kinds = run.stress_positions.select("scenario", "kind").distinct()
    return {"risk_results": run.risk_results, "backtest": backtest,
            "stress_results": stress.by_desk(run.stress_positions).join(kinds, "scenario"),
            "var_explain": run.var_explain.withColumn("prev_date", F.lit(run.previous))}


def execute(run: DailyRun, run_id: str, store: str, clock: Callable[[], dt.datetime] = _now) -> StoredRun:
    """Load the day into the stored tables, compute everything and store it under ``run_id``.

    Revisions, and the lineage of every row, are those of the stored history; backtest days that an earlier run stored are carried. A run stored again under its id replaces its own rows. Risk is computed even when controls fail; the status says so. An error is logged and raised again.
    """
    _event(run, run_id, store, None, "STARTED", clock())
    try:
        as_of = run.as_of
        loaded = load(run, store)
        run.ready(*STAGES)
        results = result_tables(run, carried_backtest(run, store, loaded.changed_from).rows)
        keep = lambda name, rows: tables.replace_rows(rows, f"{store}/{name}", as_of=as_of, run_id=run_id)
        with ThreadPoolExecutor(len(results)) as pool:
            list(pool.map(lambda item: keep(*item), results.items()))
        finished = clock()
        done = run.spark.createDataFrame([(run_id, as_of, finished.astimezone(dt.timezone.utc).replace(tzinfo=None))],
                                         "run_id string, as_of date, finished timestamp_ntz")
        sla = C.reporting_sla(done.withColumn("finished", F.col("finished").cast("timestamp")), run.cfg.controls).select(*C.COLUMNS)
        revised = C.revisions(loaded.revisions, F.lit(as_of), run.cfg.controls)
        recorded = C.lineage_complete(loaded_table(run, store, "market_data").read(), loaded_table(run, store, "lineage").read(), F.lit(as_of))
        own = run.controls.filter("control not in ('reporting_sla', 'revisions', 'lineage_complete')").select(*C.COLUMNS)
        checks = own.unionByName(revised.select(*C.COLUMNS)).unionByName(recorded.select(*C.COLUMNS)).unionByName(sla)
        keep("control_results", checks)
        status = C.overall_status(checks).first()["status"]
        _event(run, run_id, store, as_of, status, finished)
        return StoredRun(run_id, store, status)
    except Exception:
        _event(run, run_id, store, None, "ERROR", clock())
        raise
