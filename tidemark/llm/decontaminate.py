"""Benchmark decontamination: one Aho-Corasick automaton over the test items' windows, texts scanned once."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored

#: Every byte that is not part of a word becomes a space; A-Z become a-z; bytes from 0x80 belong to words.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The same words in the text as it was written.
WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(NORMAL).split() if text else []


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            items, found = [], []
            for item, text in zip(part.column("item_id").to_pylist(), part.column("text").to_pylist()):
                words = words_of(text)
                own = {b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
                items += [item] * len(own)
                found += [w.decode() for w in own]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(found, pa.string())], ["item_id", "window"])
    return run


def item_windows(items: DataFrame, width: int = 10) -> DataFrame:
    """(window, item_ids): runs of ``width`` words, or all words of a shorter item. Items without an id are left out."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null")
    found = rows.mapInArrow(_windows(width), "item_id long, window string")
    return found.groupBy("window").agg(F.collect_set("item_id").alias("item_ids"))


def build(windows: list[tuple[str, list[int]]]) -> ahocorasick.Automaton:
    """The automaton of the windows, each between spaces so that only whole words match."""
    automaton = ahocorasick.Automaton()
    for window, item_ids in windows:
        automaton.add_word(f" {window} ", (window.count(" ") + 1, tuple(item_ids)))
    automaton.make_automaton()
    return automaton


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def scan_text(automaton: ahocorasick.Automaton, text: str | None) -> tuple[int, list[tuple[int, int]], list[int]]:
    """(number of words, word ranges that are hit, ids of the items found)."""
    words = words_of(text)
    if not words or not len(automaton):
        return len(words), [], []
    normal = (b" " + b" ".join(words) + b" ").decode()
    found = list(automaton.iter(normal))
    if not found:
        return len(words), [], []
    # the space after word i stands at ends[i]; a match ends at such a space
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in normal.split()), dtype=np.int64))
    last = np.searchsorted(ends, [at for at, _ in found])
    ranges = merged([(int(i) + 1 - n, int(i) + 1) for i, (_, (n, _)) in zip(last, found)])
    return len(words), ranges, sorted({item for _, (_, ids) in found for item in ids})


def _scan(automaton_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of.value
        pair = pa.list_(pa.list_(pa.int64()))
        for part in slices(batches, ("_text",)):
            counts, ranges, items, spans = [], [], [], []
            for text in part.column("_text").to_pylist():
                n, hit, ids = scan_text(automaton, text)
                places = [m.span() for m in WORD.finditer(text)] if hit else []
                counts.append(n)
                ranges.append(hit)
                items.append(ids)
                spans.append([(places[a][0], places[b - 1][1]) for a, b in hit])
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), part.column("_row"), pa.array(counts, pa.int64()), pa.array(ranges, pair), pa.array(items, pa.list_(pa.int64())),
                 pa.array(spans, pair)], ["_id", "_row", "n_words", "ranges", "items", "spans"])
    return run


def find_items(docs: DataFrame, items: DataFrame, width: int = 10, block_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the words that lie inside any window of a test item.

    Returns ``doc_id``, ``n_words``, ``n_hit``, ``items`` (ids of the items found, sorted) and ``spans``
    (start and end of every hit passage in the text as given, code points, end exclusive).

    Defined cases: a null or empty text has no words and no hit; items that repeat an id are one item, items
    without an id or without words take no part; with an empty benchmark nothing is hit. Repeated rows
    are judged each for itself. Other columns of ``docs`` and ``items`` are not read.

    Scale: texts are scanned where they lie, without a shuffle. What is broadcast is an automaton of windows of
    at most ``block_bytes`` characters; a larger benchmark is dealt over several automata by the hash of the
    window, each scanned in turn, and the hits of a text are united. The windows of a document that
    hits are bounded by its own words.
    """
    spark = docs.sparkSession
    windows = stored(item_windows(items, width), "item-windows")
    total = windows.agg(F.sum(F.char_length("window") + 2)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    schema = f"_id {kind}, _row long, n_words long, ranges array<array<long>>, items array<long>, spans array<array<long>>"
    parts = []
    for block in range(blocks):
        mine = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block) if blocks > 1 else windows
        automaton = build([(w.window, sorted(w.item_ids)) for w in mine.toLocalIterator()])
        parts.append(rows.mapInArrow(_scan(spark.sparkContext.broadcast(automaton)), schema))
    found = parts[0]
    if blocks > 1:
        found = _united(parts)
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return found.select(F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), "items", "spans")


def _united(parts: list[DataFrame]) -> DataFrame:
    """The hits of all blocks by row of text; rows that repeat id and text stay as many as they were."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)

    def union(name: str):
        flat = F.array_sort(F.flatten(F.collect_list(name)))
        grow = F.aggregate(flat, F.expr("cast(array() as array<array<bigint>>)"), lambda done, r: F.when(
            (F.size(done) > 0) & (r[0] <= F.element_at(done, -1)[1]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(F.element_at(done, -1)[0], F.greatest(F.element_at(done, -1)[1], r[1])))),
        ).otherwise(F.concat(done, F.array(r))))
        return grow.alias(name)

    grouped = every.groupBy("_id", "_row").agg(F.max("n_words").alias("n_words"), (F.count("*") / len(parts)).cast("int").alias("times"),
                                               union("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), union("spans"))
    return grouped.withColumn("_again", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "_again")
