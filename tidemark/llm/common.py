"""Helpers shared by the text operators: reading, storing, slicing batches by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_folder

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written to the folder that all executors share and read back: its lineage ends there."""
    path = shared_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(value: Column) -> Column:
    """A-Z lower-cased, every other character as it is. ``lower`` alone would change letters like É."""
    return F.when(F.octet_length(value) == F.char_length(value), F.lower(value)).otherwise(F.translate(value, UPPER, LOWER))


def line_key(line: Column) -> Column:
    """A line stripped of white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def key_hash(key: Column) -> list[Column]:
    """128 bits of a key as two longs: 64 would collide among the lines of a large corpus."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


def slices(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...] = ("text",), max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose texts are about ``max_bytes`` together: whole rows, at least one.

    Python objects made from a text take many times its bytes, so a task's memory follows this bound
    (and its longest single text), not Arrow's batch size.
    """
    for batch in batches:
        sizes = sum((pc.fill_null(pc.cast(pc.binary_length(batch.column(c)), pa.int64()), 0).to_numpy(zero_copy_only=False) for c in columns))
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)
