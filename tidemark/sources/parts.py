"""Tables kept in parts, a month of days each or a bucket of keys, with a digest of every part.

A table is the newest list of its parts: the folder each lies in, its rows and the digest of them. A load compares the digests of what comes
in with those on the list before it reads any history, merges the parts that differ, writes them beside the old ones and then adds one
new list. So a reader never sees half a load, a load that failed has changed nothing, and a part that comes in empty is off the list.
One load at a time writes to a table. The list has one row per part, at most a few thousand; it is all that meets on the driver.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from tidemark.sources.tables import read_stored, upsert

LIST = StructType().add("part", IntegerType()).add("folder", StringType()).add("n", LongType()).add("digest", StringType()).add("version", LongType())
BUCKETS = 16


def _months(days: tuple[dt.date | None, dt.date | None]) -> tuple[float, float]:
    low, high = (None if d is None else d.year * 100 + d.month for d in days)
    return (-math.inf if low is None else low), (math.inf if high is None else high)


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyyMM").cast("int")


@dataclass(frozen=True)
class Part:
    folder: str
    n: int
    digest: str


@dataclass(frozen=True)
class Comparison:
    """The list as it is, and the parts that a load has to look at."""

    version: int
    parts: dict[int, Part]
    touched: list[int]


@dataclass(frozen=True)
class Change:
    """What a load did: parts written or gone, and the first day on which a row differs."""

    parts: list[int] = field(default_factory=list)
    first_day: dt.date | None = None

    def __bool__(self) -> bool:
        return bool(self.parts)


@dataclass(frozen=True)
class PartedTable:
    """A stored table with unique ``keys``; parts are months of ``day``, or buckets of the keys without one."""

    spark: SparkSession
    path: str
    schema: StructType
    keys: tuple[str, ...]
    day: str | None = None

    def part(self) -> Column:
        return month_of(F.col(self.day)) if self.day else F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int")

    def listing(self) -> tuple[int, dict[int, Part]]:
        """The newest version and its parts."""
        lists = read_stored(self.spark, f"{self.path}/list", LIST)
        version = lists.agg(F.max("version").alias("v")).first()["v"] or 0
        rows = lists.filter(F.col("version") == version).filter("part is not null").collect()
        return version, {r["part"]: Part(r["folder"], r["n"], r["digest"]) for r in rows}

    def _rows_of(self, parts: list[Part]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{p.folder}" for p in parts))

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """The table, or some parts of it: only their folders are in the plan."""
        known = self.listing()[1]
        return self._rows_of([p for k, p in sorted(known.items()) if parts is None or k in parts])

    def _digests(self, rows: DataFrame, part: Column) -> dict[int, tuple[int, str]]:
        """Rows and digest by part; neither depends on the order of rows or the layout of files."""
        names = self.schema.fieldNames()
        found = rows.groupBy(part.alias("part")).agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*names)).alias("x"), F.sum(F.xxhash64(F.lit(1), *names).cast("decimal(38,0)")).alias("s"))
        return {r["part"]: (r["n"], f"{r['n']}:{r['x']}:{r['s']}") for r in found.collect()}

    def compare(self, rows: DataFrame, replaced: tuple[dt.date | None, dt.date | None] | None = None) -> Comparison:
        """Which parts a load of ``rows`` touches, from digests alone.

        A part that comes in with the rows it has is not touched. Parts of a replaced range that do not come in at all are.
        """
        version, known = self.listing()
        coming = self._digests(rows.select(*self.schema.fieldNames()), self.part())
        touched = {k for k, (_, digest) in coming.items() if k not in known or known[k].digest != digest}
        if replaced:
            low, high = _months(replaced)
            touched |= {k for k in known if low <= k <= high and k not in coming}
        return Comparison(version, known, sorted(touched))

    def upsert(self, rows: DataFrame, found: Comparison | None = None) -> Change:
        """Rows replace stored ones by key."""
        found = found or self.compare(rows)
        return self._write(rows, found, self._rows_of([found.parts[k] for k in found.touched if k in found.parts]))

    def replace_range(self, rows: DataFrame, first: dt.date | None = None, last: dt.date | None = None) -> Change:
        """Stored rows between two days give way to ``rows``, whatever months these leave empty (S14). Only months at the ends are read.

        Without days, the table then holds ``rows`` and no others.
        """
        found = self.compare(rows, (first, last))
        low, high = _months((first, last))
        ends = self._rows_of([found.parts[k] for k in found.touched if k in found.parts and not (first is None or low < k) & (last is None or k < high)])
        outside = F.lit(False)
        if first is not None:
            outside |= F.col(self.day) < F.lit(first)
        if last is not None:
            outside |= F.col(self.day) > F.lit(last)
        return self._write(rows, found, ends.filter(outside))

    def _write(self, rows: DataFrame, found: Comparison, kept: DataFrame) -> Change:
        if not found.touched:
            return Change()
        names, version = self.schema.fieldNames(), found.version + 1
        inside = rows.select(*names).filter(self.part().isin(found.touched))
        folder = f"rows/v{version}"
        merged = upsert(kept, inside, list(self.keys)).withColumn("part", self.part())
        merged.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{folder}")  # what a failed load left there is in no list
        written = read_stored(self.spark, f"{self.path}/{folder}", StructType(list(self.schema.fields)).add("part", IntegerType()))
        now = self._digests(written, F.col("part"))
        changed = [k for k in found.touched if k not in now or k not in found.parts or now[k][1] != found.parts[k].digest]
        changed = [k for k in changed if k in now or k in found.parts]
        if not changed:
            return Change()
        parts = {k: p for k, p in found.parts.items() if k not in changed} | {k: Part(f"{folder}/part={k}", *now[k]) for k in changed if k in now}
        before = self._rows_of([found.parts[k] for k in changed if k in found.parts])
        first = self._first_difference(before, written.filter(F.col("part").isin(changed)).select(*names)) if self.day else None
        rows_of_list = [(k, p.folder, p.n, p.digest, version) for k, p in parts.items()] or [(None, None, None, None, version)]
        self.spark.createDataFrame(rows_of_list, LIST).coalesce(1).write.mode("append").partitionBy("version").parquet(f"{self.path}/list")
        return Change(changed, first)

    def _first_difference(self, before: DataFrame, after: DataFrame) -> dt.date | None:
        """The first day of a row that came, went or changed."""
        names = self.schema.fieldNames()
        both = before.select(*self.keys, F.col(self.day).alias("_day"), F.xxhash64(*names).alias("_h"), F.lit(1).alias("_n")).unionByName(
            after.select(*self.keys, F.col(self.day).alias("_day"), F.xxhash64(*names).alias("_h"), F.lit(1).alias("_n")))
        odd = both.groupBy(*self.keys).agg(F.min("_day").alias("_day"), F.min("_h").alias("_least"), F.max("_h").alias("_most"), F.sum("_n").alias("_n"))
        return odd.filter("_n <> 2 or _least <> _most").agg(F.min("_day").alias("d")).first()["d"]
