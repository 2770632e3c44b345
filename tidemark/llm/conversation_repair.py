"""Conversations brought back to user and assistant in turn, by the cheapest edits.

A conversation is repaired when its role initials match ``(s?(ua)+)?``. Each row is kept, given the other role or
deleted, and empty rows may be inserted anywhere; a path through these choices is a path in a graph whose nodes are
(row, letters inserted before it, state of the pattern). An edge weighs one integer: its high digits are the cost, its low digits
the letter of the edit at the place that belongs to it. A row has a slot of fixed width, for the letters inserted before it and
its own; places not used are zero. Two strings of edits that agree up to some letter fill their places alike up to it, so the
order of the integers is the order by cost and then by letters, a string before its continuations. The least path is the
answer; nothing breaks ties afterwards.

Long conversations are cut into blocks of at most ``BLOCK`` rows. A block is solved on its own for each pair of states at its ends;
what the blocks around it need to know of it is a cost and the rank of its letters among those from the same state, one small
integer for each pair. Blocks are solved in parallel, chained by those integers, and spelled out in parallel.

Rows are ordered by turn, nulls first, then by role and by hash of the text. Only facts (hashes, fault, initial) are
sorted over the whole table; texts are shuffled once, by conversation, and read there as a stream. So memory does not grow with a
conversation, but for its string of edits, which is one cell of the result; its rows pass one task, as a digest of
them in order must.

Defined cases: a null role or text is one space, null turns come first and are no turn of ``gaps``, null ids are one conversation,
rows repeated in full are duplicates of the first, an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WHITE, key_hash, stored

BLOCK_BITS = 8
BLOCK = 1 << BLOCK_BITS
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Letters in ASCII order; zero is an empty place.
LETTERS = {1: "D", 2: "I", 3: "K", 4: "R"}
D, I, K, R = 1, 2, 3, 4
PLACE, INSERTS = 3, 2
SLOT = PLACE * (INSERTS + 1)
#: States of the pattern: nothing yet, a system row, a user row waiting for its answer, an answered one.
STATES = range(4)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The one role that may be inserted, or given to a row, in each state.
NEXT = {0: "user", 1: "user", 2: "assistant", 3: "user"}
AFTER = {q: STEP[q, NEXT[q][0]] for q in STATES}
#: Rows to insert at the end of a conversation until it may end.
TO_END = {0: 0, 1: 2, 2: 1, 3: 0}
#: A row as one character: its initial (x for any other) in lower case, upper case if truncated, a digit if it has to go.
INITIALS = "suax"
SYMBOL = {**{c: (c, False, 0) for c in INITIALS}, **{c.upper(): (c, False, TRUNCATED) for c in INITIALS}, **{str(i): (c, True, 0) for i, c in enumerate(INITIALS)}}
LEGAL = {"su", "ua", "au"}
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


# --- one block

def solve(symbols: str) -> list[int | None]:
    """The least weight from each state before the block to each after it, 4 x 4; none where there is no path."""
    width = SLOT * len(symbols)
    out: list[int | None] = []
    for start in STATES:
        now = {start: 0}
        for i, symbol in enumerate(symbols):
            initial, must_go, extra = SYMBOL[symbol]
            after: dict[int, int] = {}
            layer = now
            for j in range(INSERTS + 1):
                place = width - SLOT * i - PLACE * (j + 1)
                gone, kept, turned, put = (DELETE << width) + (D << place), (extra << width) + (K << place), (REROLE + extra << width) + (R << place), (INSERT << width) + (I << place)
                inserted: dict[int, int] = {}
                for q, weight in layer.items():
                    ways = [(q, weight + gone)]
                    if not must_go:
                        ways.append((AFTER[q], weight + turned))
                        if (q, initial) in STEP:
                            ways.append((STEP[q, initial], weight + kept))
                    for to, total in ways:
                        if total < after.get(to, total + 1):
                            after[to] = total
                    if weight + put < inserted.get(AFTER[q], weight + put + 1):
                        inserted[AFTER[q]] = weight + put
                layer = inserted
            now = after
        out += [now.get(q) for q in STATES]
    return out


_solve_short = lru_cache(100_000)(solve)


def solved(symbols: str) -> list[int | None]:
    """Short conversations repeat each other; those are solved once."""
    return _solve_short(symbols) if len(symbols) <= 24 else solve(symbols)


def moves(symbols: str) -> list[int]:
    """For each pair of states 4 x cost + the rank of the letters among those from the same state; -1 without a path."""
    out, low = [], (1 << SLOT * len(symbols)) - 1
    found = solved(symbols)
    for start in STATES:
        own = found[4 * start:4 * start + 4]
        order = sorted(w & low for w in own if w is not None)
        out += [-1 if w is None else (w >> SLOT * len(symbols)) * 4 + order.index(w & low) for w in own]
    return out


def spelled(symbols: str, start: int, end: int) -> str:
    """The letters of the least path between two states."""
    weight = solved(symbols)[4 * start + end]
    places = (weight >> shift & (1 << PLACE) - 1 for shift in range(SLOT * len(symbols) - PLACE, -1, -PLACE))
    return "".join(LETTERS[p] for p in places if p)


def chained(tables: list[list[int]]) -> tuple[int, list[int]]:
    """The cost of a conversation and the states at the ends of its blocks, first and last included."""
    ahead = [INSERT * TO_END[q] for q in STATES]
    choices = []
    for table in reversed(tables):
        least = [min(((table[4 * q + to] + 4 * ahead[to], to) for to in STATES if table[4 * q + to] >= 0)) for q in STATES]
        choices.append([to for _, to in least])
        ahead = [weight >> 2 for weight, _ in least]
    path = [0]
    for choice in reversed(choices):
        path.append(choice[path[-1]])
    return ahead[0], path


def illegal_pairs(symbols: str) -> int:
    initials = [SYMBOL[s][0] for s in symbols]
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


# --- over the table

def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the faults that a hash of conversation and turn plants: dropped, emptied, without full stops, doubled, said by the user."""
    fault = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), fault.alias("_fault"), role.alias("role"), text.alias("text")).filter("_fault <> 0")
    return plain.select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                        F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                        F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy")).drop("_copy")


def _spoken(rows: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).select("*", *key_hash(F.col("text")))


def _fault_of(first: Column) -> Column:
    return F.when(F.col("blank"), "b").when(~first, "d").when(F.col("cut"), "t").otherwise("")


def row_facts(rows: DataFrame) -> DataFrame:
    """One row per row of a conversation, without its text: ``conv_id``, ``turn``, ``fault``, ``symbol`` and ``pos``, which rises in order.

    Equal rows are counted before anything is shuffled. Which text of a conversation came earlier is a minimum per role and hash; only
    texts that came more than once are joined back.
    """
    inner = F.rtrim(F.col("text"), F.lit(WHITE))
    facts = stored(_spoken(rows).select("conv_id", "turn", "role", "h1", "h2", (inner == "").alias("blank"), (~F.right(inner, F.lit(1)).isin(".", "!", "?")).alias("cut"))
                   .groupBy("conv_id", "turn", "role", "h1", "h2", "blank", "cut").agg(F.count(F.lit(1)).alias("n")), "conversation-facts")
    again = (facts.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("h1").alias("_1"), F.col("h2").alias("_2"))
             .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("turn")).alias("_first")).filter("_n > 1"))
    met = facts.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")), "left")
    first = F.col("_n").isNull() | F.col("turn").eqNullSafe(F.col("_first.turn"))
    each = met.select("conv_id", "turn", "role", "h1", "h2", "blank", "cut", first.alias("_new"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("x")
    fault = _fault_of(F.col("_new") & (F.col("copy") == 1))
    symbol = (F.when(F.col("fault") == "t", F.upper(F.col("initial"))).when(F.col("fault") == "", F.col("initial"))
              .otherwise(F.translate(F.col("initial"), INITIALS, "0123")))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "h1", "h2", "copy")]
    return stored(each.select("conv_id", "turn", "role", "h1", "h2", "copy", fault.alias("fault"), initial.alias("initial"))
                  .repartitionByRange(*order).sortWithinPartitions(*order)
                  .select("conv_id", "turn", "fault", symbol.alias("symbol"), F.monotonically_increasing_id().alias("pos")), "conversation-rows")


def _with_moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        symbols = batch.column("symbols").to_pylist()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([moves(s) for s in symbols], pa.list_(pa.int64())), pa.array([illegal_pairs(s) for s in symbols], pa.int64())],
                                         [*batch.schema.names, "moves", "pairs"])


def _judged(blocks: list[dict]) -> tuple[list[int], list[int]]:
    """Figures of a conversation and the states between its blocks, from what its blocks say of themselves."""
    cost, path = chained([b["moves"] for b in blocks])
    ends = [(SYMBOL[a["symbols"][-1]][0] + SYMBOL[b["symbols"][0]][0]) not in LEGAL for a, b in zip(blocks, blocks[1:])]
    turns = [b for b in blocks if b["first"] is not None]
    distinct = sum(b["turns"] for b in turns) - sum(a["last"] == b["first"] for a, b in zip(turns, turns[1:]))
    gaps = turns[-1]["last"] - turns[0]["first"] + 1 - distinct if turns else 0
    return [gaps, *(sum(b[k] for b in blocks) for k in ("blank", "duplicate", "truncated")), sum(b["pairs"] for b in blocks) + sum(ends), cost], path


def _with_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, number, symbols, starts, ends = [], [], [], [], []
        figures: list[list[int | None]] = []
        for i, blocks in enumerate(batch.column("blocks").to_pylist()):
            stats, path = _judged(blocks)
            for k, block in enumerate(blocks):
                at.append(i)
                number.append(k)
                symbols.append(block["symbols"])
                starts.append(path[k])
                ends.append(path[k + 1])
                figures.append(stats if k + 1 == len(blocks) else [None] * len(STATS))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id").take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(symbols, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()),
             *(pa.array([f[j] for f in figures], pa.int64()) for j in range(len(STATS)))], ["conv_id", "k", "symbols", "start", "end", *STATS])


def _with_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        symbols, starts, ends, last = (batch.column(c).to_pylist() for c in ("symbols", "start", "end", "cost"))
        letters = [spelled(s, a, b) + ("" if c is None else "I" * TO_END[b]) for s, a, b, c in zip(symbols, starts, ends, last)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("k"), pa.array(letters, pa.string()), *(batch.column(c) for c in STATS)], ["conv_id", "k", "letters", *STATS])


def decide(rows: DataFrame) -> DataFrame:
    """Per conversation: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost`` and ``audit``, the letters of the edits in order."""
    facts = row_facts(rows)
    kind = dict(facts.dtypes)["conv_id"]
    held = F.array_sort(F.collect_list(F.struct("pos", "symbol", "turn")))
    turns = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())
    blocks = (facts.groupBy("conv_id", F.shiftright("pos", BLOCK_BITS).alias("block"))
              .agg(held.alias("rows"), *(F.count_if(F.col("fault") == f).alias(n) for f, n in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))))
              .select("conv_id", "block", F.array_join(F.transform("rows", lambda r: r["symbol"]), "").alias("symbols"), "blank", "duplicate", "truncated",
                      F.array_min(turns).alias("first"), F.array_max(turns).alias("last"), F.size(F.array_distinct(turns)).cast("long").alias("turns")))
    own = "symbols string, blank long, duplicate long, truncated long, first long, last long, turns long, moves array<long>, pairs long"
    moved = blocks.mapInArrow(_with_moves, f"conv_id {kind}, block long, {own}")
    whole = moved.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", *moved.columns[2:]))).alias("blocks"))
    figures = ", ".join(f"{s} long" for s in STATS)
    parts = whole.mapInArrow(_with_states, f"conv_id {kind}, k int, symbols string, start int, end int, {figures}").repartition("conv_id", "k")
    spelt = parts.mapInArrow(_with_letters, f"conv_id {kind}, k int, letters string, {figures}")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "letters"))), lambda p: p["letters"]), "")
    return spelt.groupBy("conv_id").agg(*(F.max(s).alias(s) for s in STATS), audit.alias("audit"))


class Reading:
    """A conversation read row by row beside its letters: yields the rows it has after the edits."""

    def __init__(self, letters: str):
        self.letters, self.at, self.state = letters, 0, 0

    def _put(self) -> tuple[str, bytes, bytes]:
        role, self.state = NEXT[self.state], AFTER[self.state]
        self.at += 1
        return "I", role.encode(), b""

    def row(self, role: bytes, text: bytes) -> Iterator[tuple[str, bytes, bytes]]:
        while self.letters[self.at] == "I":
            yield self._put()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "R":
            role, self.state = NEXT[self.state].encode(), AFTER[self.state]
        elif letter == "K":
            self.state = STEP[self.state, role[:1].decode()]
        if letter != "D":
            yield letter, role, text

    def end(self) -> Iterator[tuple[str, bytes, bytes]]:
        while self.at < len(self.letters):
            yield self._put()


def _in_order(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every conversation as a run of rows in one partition: first its letters, then its rows in order. The only shuffle of texts."""
    heads = decisions.select("conv_id", F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "binary"), ("h1", "long"), ("h2", "long"), ("text", "binary"))), "audit")
    spoken = _spoken(rows).select("conv_id", F.lit(1).alias("kind"), "turn", F.col("role").cast("binary").alias("role"), "h1", "h2", F.col("text").cast("binary").alias("text"), F.lit(None).cast("string").alias("audit"))
    return (heads.unionByName(spoken).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "h1", "h2")
            .select("conv_id", "kind", "turn", "role", "text", "audit"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, object, object]]:
    """(id, row, turn) for each row after the edits, the turn null where it was inserted; (id, None, None) where a conversation ends."""
    reading, current = None, None
    for batch in batches:
        for conv, kind, turn, role, text, audit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text", "audit"))):
            if kind == 0:
                if reading:
                    yield from ((current, row, None) for row in reading.end())
                    yield current, None, None
                reading, current = Reading(audit), conv
            else:
                yield from ((current, row, None if row[0] == "I" else turn) for row in reading.row(role, text))
    if reading:
        yield from ((current, row, None) for row in reading.end())
        yield current, None, None


def _flushed(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(zip(*rows), types)], names)


def _emit(conv_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, position = [], 0, 0
        names, types = ["conv_id", "position", "edit", "turn", "role", "text"], [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for conv, row, turn in _runs(batches):
            if row is None:
                position = 0
                continue
            held.append((conv, position, row[0], turn, row[1].decode(errors="replace"), row[2].decode(errors="replace")))
            position, size = position + 1, size + len(row[2]) + 64
            if size > 4 << 20:
                yield _flushed(held, names, types)
                held, size = [], 0
        if held:
            yield _flushed(held, names, types)
    return run


def _digest(conv_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest, any_row = [], hashlib.sha256(), False
        for conv, row, _ in _runs(batches):
            if row is None:
                held.append((conv, digest.hexdigest()))
                digest, any_row = hashlib.sha256(), False
                if len(held) >= 10_000:
                    yield _flushed(held, ["conv_id", "repaired_sha256"], [conv_type, pa.string()])
                    held = []
                continue
            digest.update((b"\n" if any_row else b"") + row[1] + b":" + row[2])
            any_row = True
        if held:
            yield _flushed(held, ["conv_id", "repaired_sha256"], [conv_type, pa.string()])
    return run


def _arrow_type(frame: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(frame.schema[name].dataType)


def repaired(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of each conversation after its edits: ``conv_id``, ``position``, ``edit``, ``turn`` (null if inserted), ``role``, ``text``."""
    ordered = _in_order(rows, decisions)
    return ordered.mapInArrow(_emit(_arrow_type(ordered, "conv_id")), f"conv_id {dict(ordered.dtypes)['conv_id']}, position long, edit string, turn long, role string, text string")


def digests(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's repaired ``role:text`` rows, joined by line feeds, computed as they stream by."""
    ordered = _in_order(rows, decisions)
    return ordered.mapInArrow(_digest(_arrow_type(ordered, "conv_id")), f"conv_id {dict(ordered.dtypes)['conv_id']}, repaired_sha256 string")


def repair_report(rows: DataFrame) -> DataFrame:
    """Every conversation of ``rows`` after :func:`damaged`: its figures, its edits and the digest of what they leave."""
    hurt = damaged(rows)
    decisions = stored(decide(hurt), "conversation-edits")
    done = decisions.join(digests(hurt, decisions).withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    ids = rows.select(F.col("conv_id").alias("_c")).distinct()
    nothing = hashlib.sha256().hexdigest()
    return ids.join(done, F.col("_c").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_c").alias("conv_id"), *(F.coalesce(s, F.lit(0)).alias(s) for s in STATS), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
