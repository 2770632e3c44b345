"""Readers of landed text, CSV and HTML files, and typed exports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import all_matches, strip_markup

LONG_COLUMNS = ["ticker", "date", "close", "adj_close"]


def lenient_text(content: str) -> Column:
    """UTF-8 bytes as text; bytes that are no character are left out, they do not fail the scan."""
    return F.replace(F.make_valid_utf8(F.col(content).cast("string")), F.lit("\ufffd"), F.lit(""))


def _csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text; typing is explicit in the parsers."""
    return spark.read.option("header", True).option("enforceSchema", False).csv(path)


def _melted(wide: DataFrame, date_column: str, day: Column) -> DataFrame:
    """One row per date and series; cells that are no number are missing and dropped."""
    series = [c for c in wide.columns if c != date_column]
    long = wide.select(day.alias("date"), *series).unpivot(["date"], series, "ticker", "cell")
    close = F.col("cell").try_cast("double")
    return (long.select("ticker", "date", close.alias("close"), close.alias("adj_close"))
            .filter(F.col("close").isNotNull() & ~F.isnan("close")).select(*LONG_COLUMNS))


def read_wide_named_months(spark: SparkSession, path: str) -> DataFrame:
    """Wide CSV whose first header is DATE, with dates like '24 Sep 2026' (S1, F13)."""
    wide = _csv(spark, path)
    if wide.columns[0].strip() != "DATE":
        raise ValueError(f"not the expected CSV: the header starts with {wide.columns[0]!r}")
    return _melted(wide, wide.columns[0], F.to_date(wide.columns[0], "dd MMM yyyy"))


def read_wide_iso(spark: SparkSession, path: str, start: str | None = None) -> DataFrame:
    """Wide CSV with ISO dates under either of two headers; '.' and blanks are missing."""
    wide = _csv(spark, path)
    column = "observation_date" if "observation_date" in wide.columns else "DATE"
    long = _melted(wide, column, F.to_date(column))
    return long if start is None else long.filter(F.col("date") >= F.lit(start).cast("date"))


def header_groups(spark: SparkSession, path: str | list[str], wanted: tuple[str, ...] = ("ticker", "date", "close"), glob: str = "*.csv") -> dict[str, list[str]]:
    """Files by their header line: the line that names all ``wanted`` columns. A file without one fails.

    One scan of the files as text, filtered as it goes; of each file one line comes back.
    """
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
             .select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff|[\"\r]", "").alias("line")))
    names = F.transform(F.split("line", ","), F.trim)
    found = lines.groupBy("file").agg(F.max(F.when(F.size(F.array_except(F.array(*map(F.lit, wanted)), names)) == 0, F.col("line"))).alias("header"))
    groups: dict[str, list[str]] = {}
    for r in found.collect():  # one row per file, whose names the driver lists to read them anyway
        if r["header"] is None:
            raise ValueError(f"no header with {', '.join(wanted)} in {r['file']}")
        groups.setdefault(r["header"], []).append(unquote(r["file"]))
    return groups


def read_long(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Long CSV; the dividend column may be absent, a missing dividend is zero (S3).

    Files of one read may differ in their columns and in the order of these: they are grouped by header, each group is one scan.
    """
    out = None
    for _, files in sorted(header_groups(spark, path).items()):
        one = _parse_long(_csv(spark, sorted(files)))
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], "ticker string, date date, close double, adj_close double, dividend double") if out is None else out


def _parse_long(raw: DataFrame) -> DataFrame:
    raw = raw.toDF(*(c.strip().lstrip("\ufeff") for c in raw.columns))
    paid = F.col("dividend").try_cast("double") if "dividend" in raw.columns else F.lit(None).cast("double")
    close = F.col("close").try_cast("double")
    adjusted = F.col("adj_close").try_cast("double") if "adj_close" in raw.columns else close
    return (raw.select("ticker", F.to_date("date").alias("date"), close.alias("close"), adjusted.alias("adj_close"), F.coalesce(paid, F.lit(0.0)).alias("dividend"))
            .filter(F.col("close").isNotNull() & ~F.isnan("close")))


def read_two_level(spark: SparkSession, path: str, separator: str = "|") -> DataFrame:
    """Wide CSV with 'measure|ticker' headers to one row per date and ticker."""
    wide = _csv(spark, path)
    series = [c for c in wide.columns if separator in c]
    long = wide.unpivot(["date"], series, "name", "cell")
    parts = F.split("name", f"\\{separator}", 2)
    pick = lambda m: F.max(F.when(F.col("measure") == m, F.col("cell").try_cast("double")))
    return (long.select(F.to_date("date").alias("date"), parts[0].alias("measure"), parts[1].alias("ticker"), "cell")
            .groupBy("date", "ticker")
            .agg(pick("close").alias("close"), pick("adj_close").alias("adj_close"), pick("dividend").alias("dividend"))
            .filter("close is not null").select("ticker", "date", "close", "adj_close", F.coalesce("dividend", F.lit(0.0)).alias("dividend")))


# <stamp>/<source>.csv, either one file or a folder of parts.
_LANDED = r"/([^/]+)/([^/]+?)\.csv(?:/[^/]+)?$"


def file_names(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """(path, stamp, source) of landed files in dated folders; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
            .select("path", F.regexp_extract("path", _LANDED, 1).alias("stamp"), F.regexp_extract("path", _LANDED, 2).alias("source")))


def newest_files(names: DataFrame, root: str, expected: list[str]) -> DataFrame:
    """(source, path): the landed file or folder with the newest stamp per source (S6); a source without one fails."""
    wanted = names.sparkSession.createDataFrame([(s,) for s in expected], "source string")
    newest = names.groupBy("source").agg(F.max("stamp").alias("stamp"))
    none = F.raise_error(F.concat(F.lit("no landed raw data for "), F.col("source"))).cast("string")
    return wanted.join(newest, "source", "left").select(
        "source", F.concat(F.lit(root), F.lit("/"), F.coalesce("stamp", none), F.lit("/"), F.col("source"), F.lit(".csv")).alias("path"))


BOM = b"\xef\xbb\xbf"


def _line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each file from its lines in order. The reader leaves out line feeds and a leading byte order mark; the file's size tells which were there."""
    done: list[tuple[str, str]] = []
    path, size, seen, hashes = None, 0, 0, None

    def close() -> None:
        plain, marked = hashes
        missing = size - seen
        mine = marked if missing >= len(BOM) else plain
        if missing % len(BOM):
            mine.update(b"\n")
        done.append((path, mine.hexdigest()))

    for batch in batches:
        for file, length, line in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "line"))):
            if file != path:
                if path is not None:
                    close()
                path, size, seen, hashes = file, length, 0, (hashlib.sha256(), hashlib.sha256(BOM))
            else:
                line = b"\n" + line
            seen += len(line)
            for h in hashes:
                h.update(line)
    if path is not None:
        close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["path", "sha256"])


def streamed_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sha256) of files of any size: read as lines in parallel, hashed in order as they stream by. No more than a batch of lines is held."""
    lines = (spark.read.option("lineSep", "\n").text(paths)
             .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"),
                     F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("line")))
    ordered = lines.repartition("path").sortWithinPartitions("path", "start", "row").select("path", "size", "line")
    return ordered.mapInArrow(_line_hashes, "path string, sha256 string")


def fingerprints(spark: SparkSession, root: str, glob: str = "*.csv", whole_limit: int = 1 << 30) -> DataFrame:
    """(path, stamp, source, fetched_at, sha256, fetch_id): hash of the exact bytes of every landed file.

    Files up to ``whole_limit`` bytes are hashed whole where they are read; a larger one, which no row can hold, is hashed as a stream of its lines.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    columns = ("path", F.col("modificationTime").alias("fetched_at"))
    hashed = found.filter(F.col("length") <= whole_limit).select(*columns, F.sha2("content", 256).alias("sha256"))
    large = found.filter(F.col("length") > whole_limit).select(*columns)
    names = [r["path"] for r in large.select("path").collect()]  # contents are not read; each is over the limit, so they are few
    if names:
        streamed = streamed_hashes(spark, [unquote(n) for n in names]).withColumn("_name", F.regexp_replace(F.url_decode("path"), "^file:/+", "/")).drop("path")
        hashed = hashed.unionByName(large.withColumn("_name", F.regexp_replace(F.url_decode("path"), "^file:/+", "/")).join(streamed, "_name").drop("_name"))
    source = F.regexp_extract("path", _LANDED, 2)
    return hashed.select("path", F.regexp_extract("path", _LANDED, 1).alias("stamp"), source.alias("source"), "fetched_at", "sha256",
                         F.concat(source, F.lit("-"), F.substring("sha256", 1, 12)).alias("fetch_id"))


def lineage_records(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """(fetch_id, source, request, fetched_at, raw_path, sha256, n_rows) of every landed file.

    The request is the text kept beside the file as <source>.request.txt, or 'unknown'.
    """
    notes = (spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.request.txt").text(root)
             .select(F.col("value").alias("request"), F.col("_metadata.file_path").alias("note")))
    asked = notes.select("request", F.regexp_extract("note", r"/([^/]+)/([^/]+)\.request\.txt$", 1).alias("stamp"),
                         F.regexp_extract("note", r"/([^/]+)/([^/]+)\.request\.txt$", 2).alias("source"))
    name = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("name")
    rows = rows_per_file(spark, root, glob).select(name, "n_rows")
    both = fingerprints(spark, root, glob).select("*", name).join(rows, "name", "left").join(asked, ["stamp", "source"], "left")
    return both.select("fetch_id", "source", F.coalesce("request", F.lit("unknown")).alias("request"), "fetched_at",
                       F.col("path").alias("raw_path"), "sha256", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def rows_per_file(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """(path, n_rows): data rows of every landed CSV, header excluded."""
    lines = (spark.read.option("header", False).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
             .select(F.col("_metadata.file_path").alias("path"), "value").filter(F.length("value") > 0))
    return lines.groupBy("path").agg((F.count(F.lit(1)) - 1).alias("n_rows"))


def read_documents(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """(path, html, sha256): whole documents, bytes that are no UTF-8 replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", lenient_text("content").alias("html"), F.sha2("content", 256).alias("sha256"))


def filing_manifest(index: DataFrame, forms: list[str], since: str) -> DataFrame:
    """(accession, form, filed) from landed index pages: exact form types only, filed on or after a date.

    ``index`` has one page per row in ``text``; amendments carry another form type and are dropped.
    """
    entries = index.select(F.explode(all_matches(F.col("text"), r"<entry>.*?</entry>")).alias("e"))

    def tag(name: str) -> Column:
        return F.trim(strip_markup(F.regexp_extract("e", f"(?is)<{name}>(.*?)</{name}>", 1)))

    found = entries.select(tag("accession-number").alias("accession"), tag("filing-type").alias("form"),
                           F.to_date(tag("filing-date")).alias("filed"))
    return found.filter(F.col("form").isin(*forms) & (F.col("filed") >= F.lit(since).cast("date"))).distinct()


def export_csv(frame: DataFrame, path: str) -> int:
    """One folder of CSV parts per table, dates as yyyy-MM-dd; the number of rows, counted as they are written."""
    dated = [F.date_format(f.name, "yyyy-MM-dd").alias(f.name) if f.dataType.typeName() == "date" else F.col(f.name)
             for f in frame.schema.fields]
    seen = Observation()
    frame.select(*dated).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("header", True).csv(path)
    return seen.get["n"]


def load_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Typed load of an exported table; an empty cell is null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)
