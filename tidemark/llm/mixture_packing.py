"""Packing into windows of fixed size that hold every source in its target share, by deficit round-robin.

Each source is a queue of tokens. Before a window is filled, every source that still has tokens earns its share of the window as a deficit;
in turn, sources take what they have earned, in slices of at least ``min_piece`` tokens, and the few tokens left of the window go, on credit, to
those of them that are owed most. What a source has earned and not taken, or taken ahead, is carried to the next window. So after any
number of windows a source is never off its target by more than about a slice, as long as all sources last.

A source's queue is its documents in the order they are stored; where a document begins in it is a running sum, taken inside each
stored part and over the parts. Time is counted in packed tokens, and a source's queue moves at its share of them, so the
part of each queue that belongs to a block of time is known before anything is packed: it lies between two points of the queue, and a document
that spans such a point is cut there. Every block so holds its sources in the target proportions, to a token; that fraction of a token
is the deficit it hands to the next one. A block is packed by one task.

What is stored and shuffled: the ids, two bytes each for a vocabulary below 65,536, written once and dealt once; then one row per piece.
Blocks are bounded in tokens, whatever a source or a document holds: a hot source or a very long document spans many. Defined cases: a null or empty text is its closing id
alone, a null source is a source of its own, rows that repeat are packed each for itself, an empty table gives an empty one,
a document longer than a window is cut as any other. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored
from tidemark.llm.packing import closed, encoder

END = 2  # closes every document
WINDOW = 4096
MIN_PIECE = 64
BLOCK_TOKENS = 2_000_000


def _tokenize(path: str, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        met: dict[str | None, int] = {}
        for part in slices(batches, ("_text",)):
            every, bounds = closed(*own.encode_flat(part.column("_text").to_pylist()), END)
            lengths, before = np.diff(bounds), []
            for source, n in zip(part.column("_source").to_pylist(), lengths.tolist()):
                before.append(met.get(source, 0))
                met[source] = before[-1] + n
            data = every.astype(width)
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds.astype("<i8") * data.itemsize), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_source"), ids.cast(pa.binary()), pa.array(lengths), pa.array(before, pa.int64())],
                                             ["_id", "_source", "ids", "n", "_before"])
    return run


def token_rows(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, str]:
    """Every document's closed ids, stored with the tokens of its source before it in its part, and the number format they are in."""
    from tokenizers import Tokenizer

    width = "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    schema = f"_id {dict(rows.dtypes)['_id']}, _source string, ids binary, n long, _before long"
    return stored(rows.mapInArrow(_tokenize(tokenizer_path, width), schema).withColumn("_part", F.spark_partition_id()), "mixture-tokens"), width


# --- the course of the queues

Course = list[tuple[str, int, int, int, int, float]]


def courses(totals: Mapping[str, int], weights: Mapping[str, float]) -> tuple[Course, int, int]:
    """How named sources move: (source, phase, from, to, tokens packed before, tokens taken for each one packed), then the next phase and time.

    A phase ends when a source is empty; the others then share what it took.
    """
    at, now, phase, out = dict.fromkeys(totals, 0), 0, 0, []
    while live := [s for s, n in totals.items() if at[s] < n and weights[s] > 0]:
        share = {s: weights[s] / sum(weights[x] for x in live) for s in live}
        empty = min(live, key=lambda s: (totals[s] - at[s]) / share[s])
        span = (totals[empty] - at[empty]) / share[empty]
        packed = 0
        for s in live:
            to = totals[s] if s == empty else min(totals[s], at[s] + int(span * share[s]))
            if to > at[s]:
                out.append((s, phase, at[s], to, now, share[s]))
            packed, at[s] = packed + to - at[s], to
        now, phase = now + packed, phase + 1
    return out, phase, now


def _placed(tokens: DataFrame, targets: Mapping[str, float] | None, block_tokens: int) -> DataFrame:
    """The rows of ``tokens``, cut into the blocks that their part of the queue belongs to."""
    held = tokens.groupBy("_part", "_source").agg(F.sum("n").alias("_held"))
    offsets = held.select(F.col("_part").alias("_p"), F.col("_source").alias("_s"), (F.sum("_held").over(Window.partitionBy("_source").orderBy("_part")) - F.col("_held")).alias("_offset"))
    sources = held.groupBy("_source").agg(F.sum("_held").alias("_all"))
    weights = {s: float(w) for s, w in (targets or {}).items() if w > 0}
    named = F.col("_source").isin(*weights) if weights else F.lit(False)
    named = F.coalesce(named, F.lit(False))
    course, phase, now = courses({r["_source"]: r["_all"] for r in sources.filter(named).collect()}, weights) if weights else ([], 0, 0)
    rest = sources.filter(~named)
    whole = rest.agg(F.sum("_all").alias("n")).first()["n"] or 1
    ways = rest.select(F.col("_source").alias("_w"), F.lit(phase).alias("_phase"), F.lit(0).cast("long").alias("_from"), F.col("_all").alias("_to"), (F.col("_all") / F.lit(float(whole))).alias("_rate"))
    if course:
        ways = ways.unionByName(tokens.sparkSession.createDataFrame([(s, p, a, b, r) for s, p, a, b, _, r in course], "_w string, _phase int, _from long, _to long, _rate double"))
    # a row for each stored part and source, written first: its real size decides whether the ids have to be shuffled for it
    queues = stored(offsets.join(ways, F.col("_s").eqNullSafe(F.col("_w"))).drop("_w"), "mixture-queues")
    own = (tokens.join(queues, (F.col("_part") == F.col("_p")) & F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_lo", F.col("_offset") + F.col("_before"))
           .filter((F.col("_lo") < F.col("_to")) & (F.col("_lo") + F.col("n") > F.col("_from"))))
    first, last = F.greatest("_lo", "_from"), F.least(F.col("_lo") + F.col("n"), F.col("_to"))
    block = lambda x: F.floor((x - F.col("_from")) / F.col("_rate") / F.lit(block_tokens))
    exact = lambda b: b * F.lit(float(block_tokens)) * F.col("_rate")
    cut = lambda b: F.least(F.col("_to"), F.col("_from") + F.floor(exact(b)))
    spread = own.select("*", F.explode(F.sequence(F.greatest(block(first) - 1, F.lit(0)), block(last) + 1)).alias("_block"))
    parts = spread.select("*", F.greatest(first, cut(F.col("_block"))).alias("_a"), F.least(last, cut(F.col("_block") + 1)).alias("_z"),
                          (exact(F.col("_block")) - F.floor(exact(F.col("_block")))).alias("_owed")).filter("_a < _z")
    return parts.select("_id", "_source", "ids", "_phase", "_block", "_owed", F.col("_a").alias("_at"), (F.col("_a") - F.col("_lo")).alias("start"), (F.col("_z") - F.col("_a")).alias("n"), F.col("n").alias("doc_tokens"))


# --- one block

class Queue:
    """The documents of a source end to end; tokens are taken from its front."""

    def __init__(self, documents: list[int], lengths: np.ndarray):
        self.documents, self.lengths = documents, lengths
        self.at, self.start = 0, 0

    def take(self, count: int) -> Iterator[tuple[int, int, int]]:
        """(document, start, length) of the next ``count`` tokens."""
        while count:
            doc = self.documents[self.at]
            length = min(count, int(self.lengths[doc]) - self.start)
            yield doc, self.start, length
            count, self.start = count - length, self.start + length
            if self.start == self.lengths[doc]:
                self.at, self.start = self.at + 1, 0


def round_robin(totals: np.ndarray, weights: np.ndarray, owed: np.ndarray, window: int = WINDOW, min_piece: int = MIN_PIECE) -> Iterator[list[tuple[int, int]]]:
    """(source, tokens) of each window in turn; the last one may hold less. ``owed`` is what each source has earned before."""
    left, owed, first, sources = totals.astype(np.int64).copy(), owed.astype(np.float64).copy(), 0, len(totals)
    while (live := np.flatnonzero(left > 0)).size:
        room = int(min(window, left.sum()))
        share = weights[live] if weights[live].sum() > 0 else left[live].astype(np.float64)
        owed[live] += room * share / share.sum()
        served: dict[int, int] = {}
        turn = live[np.argsort((live - first) % sources, kind="stable")]
        for s in turn[owed[turn] >= np.minimum(min_piece, left[turn])]:
            count = int(min(owed[s], left[s], room))
            if count >= 1:
                served[int(s)] = count
                owed[s] -= count
                left[s] -= count
                room -= count
        taking = np.zeros(sources, dtype=bool)
        taking[list(served)] = True
        for s in turn[np.lexsort((-owed[turn], ~taking[turn]))]:
            if not room:
                break
            count = int(min(left[s], room, max(min_piece, np.ceil(owed[s]))))
            if count:
                served[int(s)] = served.get(int(s), 0) + count
                owed[s] -= count
                left[s] -= count
                room -= count
        while room:  # only sources that owe are left: the one that owes least goes on
            open_ = np.flatnonzero(left > 0)
            s = int(open_[np.argmax(owed[open_])])
            count = int(min(left[s], room))
            served[s] = served.get(s, 0) + count
            owed[s] -= count
            left[s] -= count
            room -= count
        first = (first + 1) % sources
        yield list(served.items())


def powers_of_two(rest: int, window: int = WINDOW) -> list[int]:
    """Lengths of the sequences that hold ``rest`` tokens: windows, then one for each binary digit."""
    return [window] * (rest // window) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if (rest % window) >> b & 1]


def lay_out(documents: list[tuple[int, int, int]], window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset): the pieces laid end to end and cut where a sequence ends."""
    sizes = powers_of_two(sum(length for _, _, length in documents), window)
    out, k, offset = [], 0, 0
    for doc, start, length in documents:
        while length:
            count = min(length, sizes[k] - offset)
            out.append((doc, start, count, k, offset))
            start, length, offset = start + count, length - count, offset + count
            if offset == sizes[k]:
                k, offset = k + 1, 0
    return out


def _pack_block(window: int, min_piece: int, width: str):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_source", "ascending"), ("_at", "ascending")])
        lengths, starts, owed, whole = (rows.column(c).to_numpy() for c in ("n", "start", "_owed", "doc_tokens"))
        source = rows.column("_source").to_pylist()
        first = [i for i in range(len(source)) if i == 0 or source[i] != source[i - 1]]
        queues = [Queue(list(range(a, b)), lengths) for a, b in zip(first, [*first[1:], len(source)])]
        totals = np.add.reduceat(lengths, first)
        taken = [piece for served in round_robin(totals, totals.astype(np.float64), owed[first], window, min_piece) for s, count in served for piece in queues[s].take(count)]
        pieces = lay_out(taken, window)
        size, ids = np.dtype(width).itemsize, rows.column("ids").to_pylist()
        crc = [zlib.crc32(np.frombuffer(ids[d], width, length, start * size).astype("<u4")) for d, start, length, _, _ in pieces]
        doc, start, length, sequence, offset = (np.array(c, dtype=np.int64) for c in zip(*pieces))
        number = rows.column("_phase")[0].as_py() << 48 | rows.column("_block")[0].as_py() << 20
        return pa.table({"_id": rows.column("_id").take(pa.array(doc)), "_source": rows.column("_source").take(pa.array(doc)), "start": starts[doc] + start, "length": length,
                         "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": whole[doc], "sequence_id": number + sequence, "offset": offset})
    return run


def pack_mixture(docs: DataFrame, tokenizer_path: str, targets: Mapping[str, float] | None = None, window: int = WINDOW, min_piece: int = MIN_PIECE,
                 block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per piece: the id, ``source``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    ``targets`` maps a source to its weight; without it, sources weigh what they hold. When a named source is empty the others share
    its part; sources it does not name follow at the end, in their own proportions, as every document is packed. Only the totals of
    named sources meet on the driver. ``window`` is a power of two.
    """
    if window & (window - 1):
        raise ValueError("the window has to be a power of two")
    tokens, width = token_rows(docs, tokenizer_path, id_col, text_col, source_col)
    size = 2 if width == "<u2" else 4
    parts = _placed(tokens, targets, block_tokens)
    cut = F.expr(f"substring(ids, cast(start * {size} + 1 as int), cast(n * {size} as int))")
    schema = f"_id {dict(tokens.dtypes)['_id']}, _source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = parts.withColumn("ids", cut).groupBy("_phase", "_block").applyInArrow(_pack_block(window, min_piece, width), schema)
    return packed.withColumnsRenamed({"_id": id_col, "_source": source_col})
