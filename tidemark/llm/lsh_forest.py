"""MinHash near-duplicates by an LSH forest: sorted signature orders, neighbours by common prefix, links confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored

SHINGLE = 5
TREES = 32  # sorted orders; each begins with four hash values of its own
HASHES = 4 * TREES
FIRST = 16  # orders whose direct neighbours are linked before all orders are searched
NEIGHBOURS = 8  # to each side of a document in an order
#: A sketch has two bits of every hash value. At a Jaccard similarity of 0.75 a pair agrees in 104 of 128 on average, with a deviation of 4.4.
MAYBE, STRONG = 85, 115
SKETCH = ("s1", "s2", "s3", "s4")
_EVEN = np.uint64(0x5555555555555555)
PICK_ROUNDS = 3
BUCKETS = 1 << 18  # counters of shingle frequencies in crowds

_U = np.uint64
with np.errstate(over="ignore"):
    _BASE = _U(0x9E3779B97F4A7C15)
    _INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of the input."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each white-space separated word: differences of one running polynomial, so all words at once."""
    raw = np.frombuffer(data, dtype=np.uint8)
    space = np.concatenate([[True], _SPACE[raw], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    run = np.concatenate([[_U(0)], np.cumsum((raw.astype(np.uint64) + _U(1)) * _powers(_BASE, len(raw))[:-1], dtype=np.uint64)])
    return mix((run[ends] - run[starts]) * _powers(_INVERSE, len(raw))[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashed five-word shingles of a text, sorted; a shorter text is one shingle, none without words."""
    words = word_hashes(text.encode().lower()) if text else np.zeros(0, dtype=np.uint64)  # bytes.lower changes A-Z only
    n = min(SHINGLE, len(words))
    if not n:
        return words
    total = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total = mix(total * _BASE + words[k:len(words) - n + 1 + k])
    return np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The MinHash values. They are mixed again: a least value has few random bits in front."""
    least = np.full(HASHES, ~_U(0))
    for at in range(0, len(shingles), 4096):
        part = shingles[at:at + 4096]
        least = np.minimum(least, (part[:, None] * _A + _B).min(axis=0))
    return mix(least)


def tree_keys(values: np.ndarray) -> np.ndarray:
    """Four 16-bit hash values to a long: key t begins order t and goes on with key t + 1."""
    four = (values >> _U(48)).reshape(TREES, 4)
    return ((four[:, 0] << _U(48)) | (four[:, 1] << _U(32)) | (four[:, 2] << _U(16)) | four[:, 3]).view(np.int64)


def sketch(values: np.ndarray) -> list[int]:
    """Two bits of each hash value, in four longs."""
    two = np.stack([(values >> _U(1)) & _U(1), values & _U(1)], axis=1).astype(np.uint8)
    return np.packbits(two.ravel()).view(">i8").tolist()


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, ("text",), 1 << 20):
        sizes, fp1, fp2, sketches, keys = [], [], [], [[], [], [], []], []
        for text in part.column("text").to_pylist():
            own = shingle_set(text)
            sizes.append(len(own))
            if not len(own):
                for x in (fp1, fp2, *sketches, keys):
                    x.append(None)
                continue
            mixed = mix(own + _BASE)
            fp1.append(int(mixed.sum(dtype=np.uint64).view(np.int64)))
            fp2.append(int(np.bitwise_xor.reduce(mix(mixed)).view(np.int64)))
            values = signature(own)
            for x, bits in zip(sketches, sketch(values)):
                x.append(bits)
            keys.append(tree_keys(values).tolist())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, fp1, fp2, *sketches)), pa.array(keys, pa.list_(pa.int64()))],
                                         ["doc_id", "n_shingles", "fp1", "fp2", *SKETCH, "keys"])


def _unlike(x: np.ndarray) -> np.ndarray:
    """How many of a long's 32 bit pairs are not zero."""
    x = x.view(np.uint64)
    return np.bitwise_count((x | (x >> _U(1))) & _EVEN).astype(np.int64)


def near_pairs(rows: dict[str, np.ndarray], width: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one sorted order (left place, right place, hash values equal in the sketch) worth confirming: those of different ``root``.

    Two rows are neighbours if they stand at most ``width`` apart and share the order's first four hash values or
    more. How deep the common prefix of close neighbours is follows from how crowded the region is, because rows
    that share more stand closer. Past the next row a pair is of use only where the chain between them has a weak
    member: rows of a strong chain come together through their direct neighbours.
    """
    n = len(rows["rep"])
    left, right, same = [], [], []
    weak = np.ones(n, dtype=np.int64)
    for j in range(1, min(width, n - 1) + 1):
        i = np.arange(n - j)
        near = (rows["k1"][:-j] == rows["k1"][j:]) & (rows["tree"][:-j] == rows["tree"][j:])
        equal = 128 - sum(_unlike(rows[s][:-j] ^ rows[s][j:]) for s in SKETCH)
        apart = rows["root"][:-j] != rows["root"][j:]
        if j == 1:
            weak[:-1] = ~(near & (equal >= STRONG) | ~apart)
            before = np.concatenate([[0], np.cumsum(weak)])
        keep = near & apart & (equal >= MAYBE) & ((before[i + j] > before[i]) | (j == 1))
        left.append(i[keep])
        right.append(i[keep] + j)
        same.append(equal[keep])
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none), np.concatenate(same or none)


def crowded(rows: dict[str, np.ndarray], width: int) -> np.ndarray:
    """The rows of a sorted order that stand in a longer run of one first key than ``width``: not all of their pairs are neighbours."""
    n = len(rows["rep"])
    if n <= width:
        return np.zeros(0, dtype=np.int64)
    far = (rows["k1"][:-width] == rows["k1"][width:]) & (rows["tree"][:-width] == rows["tree"][width:])
    begins, after = np.zeros(n + 1, dtype=np.int64), np.flatnonzero(far)
    np.add.at(begins, after, 1)
    np.add.at(begins, after + width + 1, -1)
    return np.flatnonzero(np.cumsum(begins[:-1]) > 0)


_COLS = ("tree", "k1", "k2", *SKETCH, "rep", "root")
_PAIR = ("a", "b", "same", "ra", "rb")
_OUT = "border int, place long, tree int, " + ", ".join(f"{c} long" for c in (*_COLS[1:], *_PAIR))


def _emit(border: np.ndarray, place: np.ndarray, rows: dict[str, np.ndarray] | None, pairs: dict[str, np.ndarray] | None = None) -> pa.RecordBatch:
    n = len(place)
    empty = lambda kind: pa.nulls(n, kind)
    cols = [pa.array(rows[c].astype(np.int32 if c == "tree" else np.int64)) if rows else empty(pa.int32() if c == "tree" else pa.int64()) for c in _COLS]
    pair = [pa.array(pairs[c].astype(np.int64)) if pairs else empty(pa.int64()) for c in _PAIR]
    names = ["border", "place", *_COLS, *_PAIR]
    return pa.RecordBatch.from_arrays([pa.array(border.astype(np.int32)), pa.array(place.astype(np.int64)), *cols, *pair], names)


def _pairs(rows: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray, same: np.ndarray) -> dict[str, np.ndarray]:
    """The pairs by id, the lesser one first, each with its root."""
    turn = rows["rep"][left] > rows["rep"][right]
    x, y = np.where(turn, right, left), np.where(turn, left, right)
    return {"a": rows["rep"][x], "b": rows["rep"][y], "same": same, "ra": rows["root"][x], "rb": rows["root"][y]}


def _with_crowd(pairs: dict[str, np.ndarray], rows: dict[str, np.ndarray], width: int) -> dict[str, np.ndarray]:
    """``pairs``, and each crowded row once as a pair of itself. Direct neighbours alone (``width`` 1) have no such rows."""
    if width < 2:
        return pairs
    own = np.unique(rows["rep"][crowded(rows, width)])
    more = {"a": own, "b": own, "same": np.zeros_like(own), "ra": own, "rb": own}
    return {c: np.concatenate([pairs[c], more[c]]) for c in _PAIR}


def _pair_rows(rows: dict[str, np.ndarray], fresh_from: int, width: int) -> pa.RecordBatch:
    """Pairs with the right row at ``fresh_from`` or later: earlier ones were sent with the batch before."""
    left, right, same = near_pairs(rows, width)
    new = right >= fresh_from
    pairs = _with_crowd(_pairs(rows, left[new], right[new], same[new]), rows, width)
    zero = np.zeros(len(pairs["a"]), dtype=np.int64)
    return _emit(zero, zero, None, pairs)


def _neighbours(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs within a range of sorted rows; its first and last rows too, for the pairs across two ranges."""
        here, held, head, seen = TaskContext.get().partitionId(), None, None, 0
        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _COLS}
            if head is None or len(head["rep"]) < width:
                head = {c: np.concatenate([head[c], rows[c]])[:width] if head else rows[c][:width] for c in _COLS}
            back = len(held["rep"]) if held else 0
            rows = {c: np.concatenate([held[c], rows[c]]) for c in _COLS} if held else rows
            yield _pair_rows(rows, back, width)
            # the chain before the held rows counts as weak: at most a few pairs more
            held = {c: rows[c][-width:] for c in _COLS}
            seen += batch.num_rows
        if seen:
            for rows, side, after in ((head, 1, here), (held, 2, here + 1)):  # the head meets the tail of the range before
                n = len(rows["rep"])
                yield _emit(np.full(n, side), np.full(n, after), rows)
    return run


def _across(width: int):
    def run(key, rows):
        """Pairs between the last rows of a range and the first of the next."""
        import pandas as pd

        rows = rows.sort_values(["border", "tree", "k1", "k2", "rep"], ascending=[False, True, True, True, True], ignore_index=True)
        tail = int((rows["border"] == 2).sum())
        own = {c: rows[c].to_numpy() for c in _COLS}
        left, right, same = near_pairs(own, width)
        cross = (left < tail) & (right >= tail)
        return pd.DataFrame(_with_crowd(_pairs(own, left[cross], right[cross], same[cross]), own, width))
    return run


def candidates(reps: DataFrame, trees: int = TREES, width: int = NEIGHBOURS) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a < b) of different ``root`` at most ``width`` apart in one of the first ``trees`` orders, with the number of
    hash values equal in the sketch; and the ids (rep) of rows in a crowd, whose pairs are not all among them."""
    session = reps.sparkSession
    most = int(session.conf.get("spark.sql.shuffle.partitions")) * 4
    partitions = int(max(1, min(most, reps.count() * trees // 2000)))
    orders = reps.select("rep", "root", *SKETCH, F.posexplode(F.slice("keys", 1, trees)).alias("tree", "k1"), "keys")
    orders = orders.select("tree", "k1", F.element_at("keys", F.pmod(F.col("tree") + 1, F.lit(TREES)) + 1).alias("k2"), *SKETCH, "rep", "root")
    by = ["tree", "k1", "k2", "rep"]
    found = stored(orders.repartitionByRange(partitions, *by).sortWithinPartitions(*by).mapInArrow(_neighbours(width), _OUT), "neighbours")
    within = found.filter("border = 0").select(*_PAIR)
    across = found.filter("border > 0").select("border", "place", *_COLS).groupBy("place").applyInPandas(_across(width), ", ".join(f"{c} long" for c in _PAIR))
    both = within.unionByName(across)
    pairs = both.filter("a < b").groupBy("a", "b", "ra", "rb").agg(F.max("same").alias("same"))
    return pairs, both.filter("a = b").select(F.col("a").alias("rep")).distinct()


def without_crowds(pairs: DataFrame, crowd: DataFrame) -> DataFrame:
    """``pairs``, but of the doubtful ones of two rows of ``crowd`` (rep) only the ``NEIGHBOURS`` likeliest of each component.

    ``crowd_pairs`` looks at all pairs there by an exact bound, so no link depends on these: they bring stray members of a large group
    into it, so that few of its pairs are left to that join. Documents that share a passage and little else stand in crowds, where each
    has up to ``NEIGHBOURS`` such pairs to a side in every order.
    """
    side = lambda c: crowd.select(F.col("rep").alias(c), F.lit(True).alias(f"{c}_in")).hint("merge")
    doubtful = (F.col("same") < STRONG) & F.col("a_in").isNotNull() & F.col("b_in").isNotNull()
    marked = stored(pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumn("doubtful", doubtful).drop("a_in", "b_in"), "crowd-marks")
    likeliest = W.partitionBy(F.greatest("ra", "rb")).orderBy(F.desc("same"), F.least("ra", "rb"), "a", "b")
    some = marked.filter("doubtful").withColumn("place", F.row_number().over(likeliest)).filter(F.col("place") <= NEIGHBOURS).drop("place")
    return marked.filter("not doubtful").unionByName(some).select(*_PAIR)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, ("text",), 4 << 20):
        sets = [shingle_set(t) for t in part.column("text").to_pylist()]
        which, times = np.unique(np.concatenate(sets) % _U(BUCKETS), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int64)), pa.array(times.astype(np.int64))], ["bucket", "times"])


def prefix_of(shingles: np.ndarray, times: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of which a link shares at least one, rarest first: all but the last ceil(``percent`` / 100 of them) - 1."""
    order = np.lexsort((shingles, times[shingles % _U(BUCKETS)]))
    return shingles[order[:len(shingles) + 1 - -(-percent * len(shingles) // 100)]]


def _postings(times_of, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = times_of.value
        for part in slices(batches, ("text",), 1 << 20):
            sets = [shingle_set(t) for t in part.column("text").to_pylist()]
            firsts = [prefix_of(s, times, percent) if len(s) else s for s in sets]
            sizes = np.array([len(f) for f in firsts], dtype=np.int64)
            at = np.repeat(np.arange(len(sets)), sizes)
            pos = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            n = np.array([len(s) for s in sets], dtype=np.int64)[at]
            token = np.concatenate(firsts).view(np.int64)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(token), part.column("rep").take(take), part.column("root").take(take), pa.array(n), pa.array(n - pos)], ["token", "rep", "root", "n", "left"])
    return run


def crowd_pairs(crowd: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b, same, ra, rb) of different ``root`` within ``crowd`` (rep, root): every link is among them.

    A join on the shingles at the front of each set in one order, rare ones first. If the first shingle that two sets share has l and
    m shingles left in them (itself included), they share at most min(l, m), so a link has (100 + percent) * min(l, m) >= percent * (size + size).
    For sets that share a passage and little else, this holds for its shingles just where they are links. The order only has to
    be the same everywhere: frequencies are counted in ``BUCKETS`` buckets by hash, which is all that is broadcast.
    """
    ids = crowd.hint("merge")
    own = stored(texts.withColumnRenamed("doc_id", "rep").join(ids, "rep").select("rep", "root", "text"), "crowd-texts")
    times = np.zeros(BUCKETS, dtype=np.int64)
    counted = own.mapInArrow(_buckets, "bucket long, times long").groupBy("bucket").agg(F.sum("times").alias("times")).filter("times > 1").toArrow()
    times[counted.column("bucket").to_numpy()] = counted.column("times").to_numpy()
    shared = own.sparkSession.sparkContext.broadcast(times)
    posted = stored(own.mapInArrow(_postings(shared, percent), "token long, rep long, root long, n long, left long"), "crowd-shingles")
    # the lesser set of a pair shares a shingle that leaves at least 2 * percent / (100 + percent) of it
    x = posted.filter(F.col("left") * (100 + percent) >= F.col("n") * (2 * percent)).alias("x")
    y = posted.alias("y")
    fits = ((F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & ((F.col("x.n") < F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & (F.col("x.rep") < F.col("y.rep")))
            & (F.least("x.left", "y.left") * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent))
    turn = F.col("x.rep") < F.col("y.rep")
    pick = lambda c, d, name: F.when(turn, F.col(c)).otherwise(F.col(d)).alias(name)
    found = x.join(y.hint("merge"), fits).select(pick("x.rep", "y.rep", "a"), pick("y.rep", "x.rep", "b"), pick("x.root", "y.root", "ra"), pick("y.root", "x.root", "rb"))
    return found.distinct().withColumn("same", F.lit(MAYBE).cast("long"))


def is_link(x: np.ndarray, y: np.ndarray, percent: int = 75) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both) and both > 0


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, ("x", "y"), 1 << 20):
            fine = [is_link(shingle_set(x), shingle_set(y), percent) for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), part.column("hi"), part.column("lo"), pa.array(fine)], ["a", "b", "hi", "lo", "fine"])
    return run


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b, hi, lo) that are links on their full shingle sets, which are made anew from the texts."""
    x = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "hi", "lo", "x", "y")
    return both.mapInArrow(_confirm(percent), "a long, b long, hi long, lo long, fine boolean").filter("fine").select("a", "b", "hi", "lo")


def _to_roots(hooks: DataFrame) -> DataFrame:
    """(hi, lo) with lo < hi, followed to its end by pointer jumping: as many turns as the longest chain has binary digits."""
    hooks = stored(hooks, "hooks")
    while True:
        further = hooks.select(F.col("hi").alias("via"), F.col("lo").alias("next"))
        joined = stored(hooks.join(further, hooks.lo == further.via, "left").select("hi", "lo", "next"), "hooks-ahead")
        if joined.filter("next is not null").isEmpty():
            return hooks
        hooks = joined.select("hi", F.coalesce("next", "lo").alias("lo"))


def _move(rows: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    to = roots.select(F.col("hi").alias("_from"), F.col("lo").alias("_to"))
    moved = rows.join(to, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column))
    return moved.drop("_from", "_to")


def link_components(pairs: DataFrame, texts: DataFrame, percent: int = 75) -> DataFrame:
    """(node, root) of the roots among candidate ``pairs`` (a, b, same, ra, rb): ``node`` is a root so far, ``root`` the least one it is linked with.

    A link inside a component that already stands need not be confirmed. So each turn confirms one pair for each
    component, to the least neighbour component that is likely, and merges; most pairs of a large group of copies
    become internal and drop out. What still crosses after ``PICK_ROUNDS`` turns is confirmed pair by pair, so no
    candidate is lost.
    """
    live = stored(pairs.select("a", "b", "same", "ra", "rb"), "pairs")
    # a merge join at any size: the ids grow with the documents
    ids = live.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().hint("merge")
    texts = stored(texts.join(ids, "doc_id", "left_semi"), "pair-texts")
    labels = live.select(F.explode(F.array("ra", "rb")).alias("node")).distinct().withColumn("root", F.col("node"))
    turn, proven = 0, False
    while not live.isEmpty():
        keyed = live.select("a", "b", "same", F.greatest("ra", "rb").alias("hi"), F.least("ra", "rb").alias("lo"))
        if proven:
            fine = keyed
        elif turn < PICK_ROUNDS:
            likely = F.when(F.col("same") >= STRONG, F.lit(0)).otherwise(-F.col("same"))
            first = F.min(F.struct((F.col("same") < STRONG).alias("w"), likely.alias("s"), "lo", "a", "b"))
            picks = stored(keyed.groupBy("hi").agg(first.alias("p")).select("p.a", "p.b", "hi", "p.lo"), "picks")
            fine = stored(confirm(picks, texts, percent), "links")
            live = live.join(picks.select("a", "b"), ["a", "b"], "left_anti")
        else:
            fine, proven = stored(confirm(keyed, texts, percent), "links"), True
            live = fine.select("a", "b", F.lit(128).cast("long").alias("same"), F.col("hi").alias("ra"), F.col("lo").alias("rb"))
        roots = _to_roots(fine.groupBy("hi").agg(F.min("lo").alias("lo")))
        labels = stored(_move(labels, "root", roots), "labels")
        live = stored(_move(_move(live, "ra", roots), "rb", roots).filter("ra <> rb"), "pairs")
        turn += 1
    return labels


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: the component of documents linked by similar shingle sets.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their sets of five-word shingles;
    ``component_id`` is the least id of the component, ``kept`` marks that document.

    Defined cases: a text without words (or null) has no shingles and is alone; a text of fewer than five words is
    one shingle. Rows that repeat an id are judged each by its own text; copies under one id share its component. A row
    without an id is linked with nothing, its component is null and it is kept. Other columns are not read.

    Scale: equal sets collapse to their least id before anything else (map-side), so groups of exact copies cost one
    row. The orders are sorted as ranges of rows with distinct keys, so that no crowded region meets in one task, and
    pairs across two ranges come from their border rows. The least similarity that matters, 0.75, is a neighbour
    in one of 32 orders with a chance of 1 - (1 - 0.75^4)^32 = 0.999995. Documents in a region more crowded than the
    neighbours looked at are joined on their rare shingles (``crowd_pairs``), so that no pair there depends on its place. Texts are read
    again for these and for pairs to confirm only.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    members = stored(texts.mapInArrow(_describe, "doc_id long, n_shingles long, fp1 long, fp2 long, s1 long, s2 long, s3 long, s4 long, keys array<long>"), "shingles")
    reps = stored(members.filter("n_shingles > 0 and doc_id is not null").groupBy("fp1", "fp2", "n_shingles")
                  .agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in (*SKETCH, "keys"))), "shingle-sets")
    every = texts.filter("doc_id is not null")
    # a large group of near copies comes together by direct neighbours; all orders then pair it with what is outside only
    labels = link_components(candidates(reps.withColumn("root", F.col("rep")), FIRST, 1)[0], every, percent)
    reps = stored(_move(reps.withColumn("root", F.col("rep")), "root", labels.select(F.col("node").alias("hi"), F.col("root").alias("lo"))), "linked-sets")
    pairs, crowd = candidates(reps)
    crowd = stored(crowd, "crowd-ids")
    labels = link_components(without_crowds(pairs, crowd), every, percent)
    reps = stored(_move(reps, "root", labels.select(F.col("node").alias("hi"), F.col("root").alias("lo"))).drop(*SKETCH, "keys"), "searched-sets")
    crowd = stored(reps.join(crowd, "rep", "left_semi").select("rep", "root").distinct(), "crowd")
    labels = link_components(crowd_pairs(crowd, every, percent), every, percent)
    rooted = _move(reps, "root", labels.select(F.col("node").alias("hi"), F.col("root").alias("lo"))).select("fp1", "fp2", "n_shingles", "root")
    own = members.select("doc_id", "n_shingles", "fp1", "fp2")
    found = own.join(rooted, ["fp1", "fp2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return found.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
