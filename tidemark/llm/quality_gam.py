"""Quality classifier: an additive model with pairwise interactions, learned by cyclic boosting of shallow trees.

Each term is a lookup table over the bins of one feature or of two; a score adds one entry per term.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import slices

MAX_ROWS = 20_000  # labelled rows learned from
THRESHOLD = 0.7
FEATURES = ("words", "word_length", "upper", "digit", "symbol", "bang", "bar", "stop", "distinct_words", "same_as_before", "distinct_pairs",
            "words_a_line", "repeated_lines", "wide")
_UPPER, _DIGIT, _SYMBOL, _STOP = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>^~{}[]\\_=", b".,;:?"


def describe(text: str | None) -> tuple[float, ...]:
    """The features of a text; shares are of its bytes or words. An empty text has zeros."""
    raw = (text or "").encode()
    words = raw.lower().split()
    n, size = len(words), max(1, len(raw))
    share = lambda drop: 1 - len(raw.translate(None, drop)) / size if raw else 0.0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = max(1, n - 1)
    return (np.log1p(n), sum(map(len, words)) / max(1, n), share(_UPPER), share(_DIGIT), share(_SYMBOL), share(b"!"), share(b"|"), share(_STOP),
            len(set(words)) / max(1, n), sum(map(eq, words, words[1:])) / pairs, len(set(zip(words, words[1:]))) / pairs,
            np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), len(raw) / max(1, len(text or "")) - 1)


@dataclass
class Gam:
    """``cuts`` of each feature's bins; ``terms`` map one or two features to a table of log-odds."""

    prior: float
    cuts: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    terms: dict[tuple[int, ...], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of every row: one table entry added per term."""
        total = np.full(len(x), self.prior)
        fine, rough = _bins(x, self.cuts), _bins(x, self.coarse)
        for term, values in self.terms.items():
            total += values[fine[term[0]]] if len(term) == 1 else values[rough[term[0]], rough[term[1]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
    return [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]


def _cuts(column: np.ndarray, most: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, most + 1)[1:-1], method="higher")) if len(column) else np.zeros(0)


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray, low: float = 1.0) -> tuple[float, int]:
    """Best gain over cutting a histogram in two, and where (bins below it go left); 0 where no cut helps."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - g.sum()**2 / (h.sum() + 1)
    gain[(left_h < low) | (right_h < low)] = 0
    at = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) and gain[at] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """A tree over the bins of one feature, as a value for each bin."""
    gain, at = _split(g, h) if depth else (0.0, 0)
    if not gain:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _tree2(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A cut along one feature, then along the other on each side; the value of each cell, and the gain."""
    best, most = np.full(g.shape, _leaf(g.sum(), h.sum())), 0.0
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        gain, at = _split(a.sum(axis=1), b.sum(axis=1))
        at = at or a.shape[0] // 2  # an interaction may show at the second cut only
        out, total = np.empty(a.shape), gain
        for part in (slice(0, at), slice(at, None)):
            more, _ = _split(a[part].sum(axis=0), b[part].sum(axis=0))
            out[part] = _tree(a[part].sum(axis=0), b[part].sum(axis=0), 1)
            total += more
        if total > most:
            best, most = (out.T if turned else out), total
    return best, most


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 50, pairs: int = 6, rate: float = 0.15, bins: int = 32, coarse: int = 8) -> Gam:
    """Boost main effects in turn, then the pairs of features that explain most of what is left.

    Without both labels there is nothing to learn: every score is the one label seen, or 1 without labels.
    """
    if not len(y) or y.min() == y.max():
        return Gam(prior=30.0 if not len(y) or y[0] > 0 else -30.0)
    model = Gam(float(np.log((y.mean()) / (1 - y.mean()))), [_cuts(c, bins) for c in x.T], [_cuts(c, coarse) for c in x.T])
    fine, rough = _bins(x, model.cuts), _bins(x, model.coarse)
    total = np.full(len(y), model.prior)

    def pull() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    features = range(x.shape[1])
    for j in features:
        model.terms[(j,)] = np.zeros(len(model.cuts[j]) + 1)
    for _ in range(rounds):
        for j in features:
            g, h = pull()
            n = len(model.cuts[j]) + 1
            step = rate * _tree(np.bincount(fine[j], g, n), np.bincount(fine[j], h, n), 2)
            model.terms[(j,)] += step
            total += step[fine[j]]

    def cells(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        at = rough[a] * shape[1] + rough[b]
        g, h = pull()
        return at, np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(combinations(features, 2), key=lambda p: -_tree2(*cells(*p)[1:])[1])[:pairs]
    for a, b in ranked:
        model.terms[(a, b)] = np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1))
    for _ in range(pair_rounds):
        for a, b in ranked:
            at, g, h = cells(a, b)
            step = rate * _tree2(g, h)[0]
            model.terms[(a, b)] += step
            total += step.ravel()[at]
    return model


def _describe_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, ("_text",)):
        rows = [list(describe(t)) for t in part.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_y"), pa.array(rows, pa.list_(pa.float64()))], ["_id", "_y", "x"])


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Gam:
    """The model, from at most ``max_rows`` labelled documents (those with the least hash of the id).

    Ids with crc32 mod 4 of 2 are held out. An id labelled several times counts once, by its majority (a tie is 0); rows without
    label or id are left out; of documents that repeat an id one is taken. The ids sampled are what is broadcast: their
    number is bounded by ``max_rows``.
    """
    wanted = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 4 != 2))
    sample = (wanted.groupBy(F.col(id_col).alias("_id")).agg((F.avg(F.col(label_col)) > 0.5).cast("double").alias("_y"))
              .orderBy(F.xxhash64("_id"), "_id").limit(max_rows))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(sample), "_id").select("_id", "_y", "_text")
    seen = rows.mapInArrow(_describe_rows, f"_id {dict(rows.dtypes)['_id']}, _y double, x array<double>").groupBy("_id").agg(F.min(F.struct("_y", "x")).alias("r"))
    got = seen.orderBy("_id").select("r.*").toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(FEATURES))
    return fit(x, got["_y"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Gam, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score of every text, each row where it lies: no shuffle. An extra column of that name is replaced."""
    docs = docs.select(*(c for c in docs.columns if c != score_col))
    held = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, (where,)):
            x = np.array([describe(t) for t in part.column(where).to_pylist()], dtype=float).reshape(part.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held.value.score(x))], [*part.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Defined cases: null and empty texts are scored by their zero features; a null id is not held out; repeated rows are
    scored each; an empty table gives an empty one; without labels of both kinds see :func:`fit`.
    """
    scored = score(docs.select("doc_id", "text"), learn(docs, labels, max_rows))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
