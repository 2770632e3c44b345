"""Keyed, append-only and range-replaced tables, and symbol mapping of raw series."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def keep_last(rows: DataFrame, keys: list[str], sequence: str = "load_seq") -> DataFrame:
    """The row with the highest load sequence per key.

    Row order does not exist in a distributed frame, so "last" is an explicit column. The maximum of a
    struct is combined map-side: a key with any number of copies sends one row per task.
    """
    rest = [c for c in rows.columns if c not in keys and c != sequence]
    newest = rows.groupBy(*keys).agg(F.max(F.struct(sequence, *rest)).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in (sequence, *rest)]).select(*rows.columns)


def map_series(raw: DataFrame, instruments: DataFrame) -> DataFrame:
    """Primary series: (source, ticker) to instrument, prices times the unit scale (S7). Duplicates are kept."""
    dim = instruments.select("source", "ticker", "instrument_id", "price_scale")
    return raw.join(dim, ["source", "ticker"]).select(
        "instrument_id", "date", (F.col("close") * F.col("price_scale")).alias("close"),
        (F.col("adj_close") * F.col("price_scale")).alias("adj_close"), "fetch_id", "load_seq")


def map_dividends(raw: DataFrame, instruments: DataFrame) -> DataFrame:
    """Rows that paid a dividend, in the instrument's unit."""
    dim = instruments.select("source", "ticker", "instrument_id", "price_scale")
    return (raw.filter(F.coalesce("dividend", F.lit(0.0)) > 0).join(dim, ["source", "ticker"])
            .select("instrument_id", F.col("date").alias("ex_date"),
                    (F.col("dividend") * F.col("price_scale")).alias("amount"), "fetch_id", "load_seq"))


def reference_map(instruments: DataFrame, cross_checks: DataFrame, proxy_source: str) -> DataFrame:
    """(source, ticker, instrument_id, purpose): every use of a series beside its own instrument."""
    checks = cross_checks.select("source", "ticker", "instrument_id", F.lit("cross_check").alias("purpose"))
    proxies = instruments.filter("returns_proxy is not null").select(
        F.lit(proxy_source).alias("source"), F.col("returns_proxy").alias("ticker"), "instrument_id",
        F.lit("return_proxy").alias("purpose"))
    parts = F.split("stress_proxy", ":", 2)
    stress = instruments.filter("stress_proxy is not null").select(
        parts[0].alias("source"), parts[1].alias("ticker"), "instrument_id", F.lit("stress_proxy").alias("purpose"))
    return checks.unionByName(proxies).unionByName(stress)


def map_references(raw: DataFrame, uses: DataFrame) -> DataFrame:
    """Reference prices; one series may serve several instruments and purposes."""
    return raw.join(uses, ["source", "ticker"]).select(
        "instrument_id", "purpose", "source", "ticker", "date", F.col("close").alias("value"), "fetch_id", "load_seq")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with incoming ones replacing them by key.

    Of several incoming rows with one key the one loaded last stays (without ``load_seq`` the largest), so keys
    stay unique. Untouched rows pass a left-anti join; no incoming rows leave the table as it is.
    """
    if "load_seq" in incoming.columns:
        newest = keep_last(incoming, keys)
    else:
        rest = [c for c in incoming.columns if c not in keys]
        newest = incoming.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))
    return stored.join(incoming.select(*keys), keys, "left_anti").unionByName(newest.select(*stored.columns))


def replace_up_to(stored: DataFrame, incoming: DataFrame, column: str, cut: Column) -> DataFrame:
    """Drop stored rows up to a date, add the new ones."""
    return stored.filter(F.col(column) > cut).unionByName(incoming.select(*stored.columns))


def write_table(frame: DataFrame, path: str, partition: str | None = None, mode: str = "overwrite") -> None:
    """Write Parquet; with a partition column, overwrite only the partitions present in the frame."""
    writer = frame.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def append_table(frame: DataFrame, path: str, partition: str | None = None) -> None:
    """Append-only results."""
    write_table(frame, path, partition, mode="append")


def read_stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table stored at a path, empty where nothing was stored yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def owned_folder(path: str, **owner: object) -> str:
    """The folder of one owner's rows, as partition discovery reads it. Values are plain names or dates."""
    for value in owner.values():
        if not re.fullmatch(r"[A-Za-z0-9._-]+", str(value)):
            raise ValueError(f"{value!r} cannot name a folder of stored rows")
    return "/".join([path, *(f"{k}={v}" for k, v in owner.items())])


def replace_rows(rows: DataFrame, path: str, **owner: object) -> None:
    """Store the rows of one owner, for instance a date and a run; whatever it had stored before is gone, also if no row comes now.

    The owner is given, not read from the rows, so an empty result replaces as well, and nothing of other owners is read or written.
    """
    rows.drop(*owner).write.mode("overwrite").parquet(owned_folder(path, **owner))


def run_log(events: DataFrame) -> DataFrame:
    """One row per run from its appended events: the newest status and its time.

    ``events``: run_id, as_of, status, at. A row update becomes an appended event; any outcome follows a start.
    """
    return events.groupBy("run_id").agg(
        F.max("as_of").alias("as_of"), F.min("at").alias("started_at"),
        F.max(F.when(F.col("status") != "STARTED", F.col("at"))).alias("finished_at"),
        F.max(F.struct((F.col("status") != "STARTED").alias("over"), "at", "status")).alias("_last")).select(
        "run_id", "as_of", "started_at", "finished_at", F.col("_last.status").alias("status"))


def sql_over(spark: SparkSession, frame: DataFrame, name: str, query: str) -> DataFrame:
    """Register a frame for one SQL statement (S11). The statement is resolved at once, so the view does not outlive it."""
    frame.createOrReplaceTempView(name)
    try:
        return spark.sql(query)
    finally:
        spark.catalog.dropTempView(name)
