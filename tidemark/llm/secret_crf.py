"""Secret scan: fixed formats, and a linear-chain conditional random field that tags tokens as begin, inside or outside."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

#: The given formats. A match that fails its length is dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
NAMES = ("passw", "secret", "token", "api")  # one of these is in any match of ASSIGN, in any case of letters
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
HEX_THIRD = re.compile(r"[0-9a-f]{8}")  # what every third character of a text with a match of HEX has
KINDS = ("assign", "access", "hex")

#: Words, and the signs that assign a value; quotes, brackets and white space only separate.
TOKEN = re.compile(r"""[^\s"'`=:,;()<>{}\[\]]+|[=:]""")
SEPARATORS = "\"'`,;()<>{}[]"  # besides white space
OUT, BEGIN, INSIDE = 0, 1, 2
SIGN = 1  # the shape of a sign
MAX_DOCS = 2_000  # texts learned from: half with a base match, half any
LOOK = 200  # rows looked at first for each text to learn from
MAX_WINDOWS = 20  # of one text
REACH = 6  # tokens to each side of a telling token that a learning window holds
VOCABULARY = 400

Span = tuple[str, int, int]


def assigned(text: str) -> list[re.Match]:
    """Matches of ASSIGN that keep their length. Most texts have no sign or no name, which is seen sooner than that nothing matches."""
    lower = text.lower() if "=" in text or ":" in text else ""
    return [m for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if any(n in lower for n in NAMES) else []


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that keep its length, by start, then kind."""
    found = [("assign", *m.span()) for m in assigned(text)]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)] if HEX_THIRD.search(text[::3]) else []
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def values_of(text: str) -> list[tuple[int, int]]:
    """The parts of the base matches that are the secret itself."""
    return [m.span(2) for m in assigned(text)] + [(a, b) for kind, a, b in base_spans(text) if kind != "assign"]


def tokens_of(text: str) -> list[str]:
    """The texts of the matches of TOKEN, in a fraction of its time."""
    for c in SEPARATORS:
        text = text.replace(c, " ")
    return text.replace("=", " = ").replace(":", " : ").split()


def shape(token: str) -> int:
    """What a token looks like: its kinds of characters, its length, whether letters and digits alternate. Below 512."""
    size = min(7, len(token).bit_length())
    if token.isalpha():
        return 8 + size if token.islower() or token.istitle() else 16 + size if token.isupper() else 24 + size
    if token in ("=", ":"):
        return SIGN
    bare = token.replace(".", "").replace(",", "")
    lower, upper = any(map(str.islower, token)), not token.islower() and any(map(str.isupper, token))
    digit, sign = not bare.isalpha() and any(map(str.isdigit, token)), not bare.isalnum()
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:])) if digit else 0
    return 32 + (((lower * 2 + upper) * 2 + digit) * 2 + sign) * 24 + min(2, turns // 2) * 8 + size


SHAPES = 512


@dataclass
class Crf:
    """Weights of each feature for each tag, and of each pair of tags in a row."""

    words: dict[str, int] = field(default_factory=dict)
    shape: np.ndarray = field(default_factory=lambda: np.zeros((SHAPES, 3)))
    near: np.ndarray = field(default_factory=lambda: np.zeros((3, VOCABULARY + 2, 3)))  # before, two before, after
    file: np.ndarray = field(default_factory=lambda: np.zeros((6, 3)))
    step: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))
    trained: bool = False

    def word(self, token: str) -> int:
        """1 for any word that is not in the vocabulary; 0 is the end of the text."""
        return self.words.get(token.lower(), 1)

    def emissions(self, shapes: np.ndarray, words: np.ndarray, file: np.ndarray | int) -> np.ndarray:
        """(..., tokens, 3) from (..., tokens) of shapes and word numbers."""
        edge = np.zeros((*words.shape[:-1], 2), dtype=words.dtype)
        around = np.concatenate([edge, words, edge], axis=-1)
        n = words.shape[-1]
        return self.shape[shapes] + self.near[0, around[..., 1:1 + n]] + self.near[1, around[..., :n]] + self.near[2, around[..., 3:3 + n]] + np.expand_dims(self.file[file], -2)


def file_feature(signs: np.ndarray | int, digits: np.ndarray | int, tokens: np.ndarray | int) -> np.ndarray:
    """A feature of the whole text, from counts: how much it assigns, and whether digits are common in it."""
    return np.where(signs == 0, 0, np.where(50 * signs < tokens, 1, 2)) * 2 + (20 * digits > tokens)


def file_of(tokens: list[str]) -> int:
    return int(file_feature(sum(t in ("=", ":") for t in tokens), sum(t[0].isdigit() for t in tokens), len(tokens)))


def viterbi(emissions: np.ndarray, step: np.ndarray) -> list[int]:
    """The best tags; inside never follows outside or begins a text."""
    e = emissions.tolist()
    lost = -1e9
    (oo, ob, _), (bo, bb, bi), (io, ib, ii) = step.tolist()  # from and to outside, begin, inside
    o, b, i, back = e[0][OUT], e[0][BEGIN], lost, []
    for out, begin, inside in e[1:]:
        to_out, to_begin, to_inside = (o + oo, b + bo, i + io), (o + ob, b + bb, i + ib), (lost, b + bi, i + ii)
        o, b, i = max(to_out), max(to_begin), max(to_inside)
        back.append((to_out.index(o), to_begin.index(b), to_inside.index(i)))
        o, b, i = o + out, b + begin, i + inside
    tags = [(o, b, i).index(max(o, b, i))]
    for came in reversed(back):
        tags.append(came[tags[-1]])
    return tags[::-1]


class Numbers(dict):
    """Number of each token's sort: tokens of one shape, word and kind of first character are the same to the model. ``sorts`` has them in order; the first is the end of a text."""

    def __init__(self, model: Crf):
        super().__init__()
        self.model, self.sorts = model, {(0, 0, False): 0}

    def __missing__(self, token: str) -> int:
        sort = shape(token), self.model.word(token), token[0].isdigit()
        self[token] = number = self.sorts.setdefault(sort, len(self.sorts))
        return number


def gain(weights: np.ndarray) -> np.ndarray:
    """What begin and inside have over outside."""
    return weights[..., 1:] - weights[..., :1]


def steps_gain(model: Crf) -> float:
    """The most that the steps around a token can add to a tag."""
    return 2 * max(0.0, float((model.step - model.step[OUT, OUT]).max()))


def suspects(model: Crf, texts: list[str | None], numbers: Numbers) -> np.ndarray:
    """Which of the texts can have a tag, found for all tokens of all texts at once. ``numbers`` remembers the tokens seen before.

    Only a token whose best weight inside a secret beats that outside, even with the best steps around it, can
    gain from being tagged; a text without any has no secret and need not be decoded. Nothing is lost by that.
    """
    if not model.trained or not texts:
        return np.zeros(len(texts), dtype=bool)
    ids, sizes = [np.zeros(2, dtype=np.int64)], []  # two ends of a text between any two
    for text in texts:
        tokens = tokens_of(text or "")
        ids += np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens)), ids[0]
        sizes.append(len(tokens))
    at, sizes, sorts = np.concatenate(ids), np.array(sizes), np.array(list(numbers.sorts), dtype=np.int64)
    starts = 2 + np.cumsum(sizes + 2) - (sizes + 2)
    own, (before, two, after) = gain(model.shape)[sorts[:, 0]], gain(model.near)[:, sorts[:, 1]]
    own[0] = -np.inf  # an end has no tag
    score = own[at]
    score[1:] += before[at[:-1]]
    score[2:] += two[at[:-2]]
    score[:-1] += after[at[1:]]
    signs, digits = (np.add.reduceat(x[at].astype(np.int64), starts) for x in (sorts[:, 0] == SIGN, sorts[:, 2]))
    best = np.maximum.reduceat(score, starts) + gain(model.file)[file_feature(signs, digits, sizes)]
    return best.max(axis=1) + steps_gain(model) > -1e-9  # as sums of another order are rounded otherwise


def decode(model: Crf, text: str, shapes: dict[str, int]) -> list[tuple[int, int]]:
    """Spans that the model tags. ``shapes`` remembers the shapes of tokens seen before. What :func:`suspects` leaves out has none."""
    tokens = tokens_of(text)
    if not tokens or not model.trained:
        return []
    for t in tokens:
        if t not in shapes:
            shapes[t] = shape(t)
    emissions = model.emissions(np.array([shapes[t] for t in tokens]), np.array([model.word(t) for t in tokens]), file_of(tokens))
    if not (gain(emissions).max(axis=1) + steps_gain(model) > 0).any():
        return []
    tags = viterbi(emissions, model.step)
    if not any(tags):
        return []
    places = [m.span() for m in TOKEN.finditer(text)]
    spans: list[tuple[int, int]] = []
    for tag, (a, b) in zip(tags, places):
        if tag == BEGIN:
            spans.append((a, b))
        elif tag == INSIDE:
            spans[-1] = (spans[-1][0], b)
    return spans


def windows_of(text: str) -> list[tuple[list[str], list[int], int]]:
    """Learning windows of a text: tokens, tags by the base formats, file feature. Around values, digits and assignments."""
    places = [(m[0], *m.span()) for m in TOKEN.finditer(text)]
    tags, values = [OUT] * len(places), sorted(values_of(text))
    k = 0
    for a, b in values:
        while k < len(places) and places[k][2] <= a:
            k += 1
        first, i = True, k
        while i < len(places) and places[i][1] < b:
            tags[i] = BEGIN if first else INSIDE
            first, i = False, i + 1
    tokens = [p[0] for p in places]
    telling = [i for i, t in enumerate(tokens) if tags[i] or t in ("=", ":") or any(map(str.isdigit, t))] or [len(tokens) // 2]
    file, out, done = file_of(tokens), [], -1
    for i in telling:
        if i > done and tokens and len(out) < MAX_WINDOWS:
            a, done = max(0, i - REACH), min(len(tokens), i + REACH + 1)
            out.append((tokens[a:done], tags[a:done], file))
    return out


def fit(windows: list[tuple[list[str], list[int], int]], rounds: int = 120, rate: float = 0.3, ridge: float = 1e-3) -> Crf:
    """Maximum likelihood by gradient steps (Adam), forward and backward over all windows at once. Without any secret it stays untrained."""
    model = Crf()
    if not any(any(tags) for _, tags, _ in windows):
        return model
    counts = Counter(t.lower() for tokens, _, _ in windows for t in tokens)
    model.words = {w: i + 2 for i, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY])}
    n, width = len(windows), max(len(t) for t, _, _ in windows)
    shapes, words, tags = (np.zeros((n, width), dtype=np.int64) for _ in range(3))
    real, files = np.zeros((n, width), dtype=bool), np.array([f for _, _, f in windows])
    for i, (tokens, own, _) in enumerate(windows):
        k = len(tokens)
        shapes[i, :k], words[i, :k], tags[i, :k], real[i, :k] = [shape(t) for t in tokens], [model.word(t) for t in tokens], own, True
    around = np.concatenate([np.zeros((n, 2), dtype=np.int64), words, np.zeros((n, 2), dtype=np.int64)], axis=1)
    near = (around[:, 1:1 + width], around[:, :width], around[:, 3:3 + width])
    ban = np.zeros((3, 3))
    ban[OUT, INSIDE] = -1e6
    goal = np.eye(3)[tags] * real[..., None]
    parts = [model.shape, model.near, model.file, model.step]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    both = real[:, 1:] & real[:, :-1]
    for turn in range(1, rounds + 1):
        e = model.emissions(shapes, words, files) * real[..., None]
        s = model.step + ban
        add = lambda x, axis: np.log(np.exp(x - (m := x.max(axis=axis, keepdims=True))).sum(axis=axis)) + m.squeeze(axis)
        ahead, behind = np.zeros((n, width, 3)), np.zeros((n, width, 3))
        ahead[:, 0] = e[:, 0] + np.array([0.0, 0.0, -1e6])
        for t in range(1, width):
            ahead[:, t] = np.where(real[:, t, None], add(ahead[:, t - 1, :, None] + s, 1) + e[:, t], ahead[:, t - 1])
        for t in range(width - 2, -1, -1):
            behind[:, t] = np.where(real[:, t + 1, None], add(s + (e[:, t + 1] + behind[:, t + 1])[:, None, :], 2), 0)
        total = add(ahead[:, -1], 1)
        at = np.exp(np.minimum(ahead + behind - total[:, None, None], 0)) * real[..., None]
        pair = ahead[:, :-1, :, None] + s + (e[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        pair = (np.exp(np.minimum(pair, 0)) * both[..., None, None]).sum(axis=(0, 1))
        seen = np.zeros((3, 3))
        np.add.at(seen, (tags[:, :-1][both], tags[:, 1:][both]), 1)
        pull = goal - at
        by = lambda index, rows: np.stack([np.bincount(index.ravel(), pull[..., k].ravel(), rows) for k in range(3)], axis=1)
        grads = [by(shapes, SHAPES), np.stack([by(x, VOCABULARY + 2) for x in near]), by(np.repeat(files, width).reshape(n, width), 6), seen - pair]
        for p, g, m, v in zip(parts, grads, first, second):
            g = g / n - ridge * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    model.trained = True
    return model


def telling(text: Column) -> Column:
    """Whether a text has about what a base match is. As one pattern, all three are tried at every character, which takes longer."""
    signs = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    assigns = signs & text.rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]")
    return assigns | text.rlike("(?i)AKIA[A-Z0-9]{16}") | text.rlike("[0-9a-fA-F]{24}")


def least_ids(rows: DataFrame, kept: Column, n: int, total: int) -> DataFrame:
    """The ``n`` ids of least hash among the kept ones of ``total`` rows.

    They are looked for among ``LOOK`` times as many rows of low hash first, so that a large table is not matched with patterns
    throughout; only where these hold too few ids, among all.
    """
    share = LOOK * n / max(1, total)
    low = F.xxhash64("_id") < int(share * 2**64) - 2**63 if share < 1 else F.lit(True)
    ids = rows.filter(low).filter(kept).select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(n)
    found = ids.collect()
    return least_ids(rows, kept, n, 0) if share < 1 and len(found) < n else rows.sparkSession.createDataFrame(found, ids.schema)


def learn(docs: DataFrame, max_docs: int = MAX_DOCS) -> Crf:
    """The model, from windows of at most ``max_docs`` texts: those of least hash, half of them with a base match.

    The ids sampled are what is broadcast, and bounded by ``max_docs``. Rows without id are not learned from.
    """
    rows, total = docs.select("_id", "_text").filter("_id is not null and _text is not null"), docs.count()
    ids = least_ids(rows, telling(F.col("_text")), max_docs // 2, total).union(least_ids(rows, F.lit(True), max_docs // 2, total)).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, ("_text",)):
            own = [(i, *w) for i, t in zip(part.column("_id").to_pylist(), part.column("_text").to_pylist()) for w in windows_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([str(w[0]) for w in own], pa.string()), pa.array([w[1] for w in own], pa.list_(pa.string())),
                                              pa.array([w[2] for w in own], pa.list_(pa.int32())), pa.array([w[3] for w in own], pa.int32())], ["id", "tokens", "tags", "file"])

    found = rows.join(F.broadcast(ids), "_id").mapInArrow(run, "id string, tokens array<string>, tags array<int>, file int")
    return fit([(tokens, tags, file) for _, tokens, tags, file in sorted(map(tuple, found.collect()))])  # a sort in Spark would read the texts twice


def kind_of(text: str, start: int, end: int) -> str:
    """The kind an added span is listed under: by its characters, else as the value of an assignment."""
    value = text[start:end]
    return "hex" if re.fullmatch("[0-9a-f]+", value) else "access" if re.fullmatch("[A-Z0-9]+", value) else "assign"


def scan_text(model: Crf, text: str | None, shapes: dict[str, int], suspect: bool = True) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): the base ones stay, the model adds those that overlap none of them."""
    base = base_spans(text or "")
    added = [(kind_of(text, a, b), a, b) for a, b in (decode(model, text, shapes) if text and suspect else []) if b - a >= 6 and not any(a < y and x < b for _, x, y in base)]
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row; counts and hash are of the base spans.

    Spans are kind:start:end in code points, end exclusive, by start, then kind, joined by commas.

    Defined cases: a null or empty text has no spans; rows that repeat are scanned each; a text of any length is decoded
    whole; without a single base match in the sample the model adds nothing; an empty table gives an empty one;
    other columns are not read.

    Scale: texts are scanned where they lie, no shuffle; the model (a few thousand weights) is what is broadcast.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    held = docs.sparkSession.sparkContext.broadcast(learn(rows, max_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, numbers, shapes = held.value, Numbers(held.value), {}
        for part in slices(batches, ("_text",)):
            if len(numbers) > 300_000:
                numbers.clear()
                shapes.clear()
            texts = part.column("_text").to_pylist()
            found = [scan_text(model, t, shapes, s) for t, s in zip(texts, suspects(model, texts, numbers))]
            counts = [[sum(k == kind for k, _, _ in base) for base, _ in found] for kind in KINDS]
            yield pa.RecordBatch.from_arrays([part.column("_id"), *(pa.array(c, pa.int64()) for c in counts),
                                              pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([joined(s) for _, s in found], pa.string())],
                                             ["_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = f"_id {dict(rows.dtypes)['_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
