"""Best-fit packing of token sequences, improved by swaps between underfull bins."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored

END = 1  # closes every document
#: Chunks of these characters only are normalised and cut here; any other chunk goes through the whole tokenizer.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
LETTERS = "a-zß-öø-ÿ"
#: The tokenizer's own pre-token pattern, for the characters of PLAIN after lower-casing.
PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")
#: A byte-level model names a byte by its own character if that prints, else by the next one from 256 on.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_NAME = {b: b for b in _PRINTS} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTS)))}


class _Codes(dict):
    """Chunk to its number; an unknown one is encoded as it is met."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.fresh = encode, []

    def __missing__(self, chunk: bytes) -> int:
        self[chunk] = code = len(self)
        self.fresh.append(self.encode(chunk))
        return code


class ChunkEncoder:
    """Ids of white-space separated chunks. No token spans white space, so a text's ids are its chunks' ids in turn.

    Texts repeat their chunks: each distinct one is encoded once and remembered, as are its parts, which chunks that differ in case or
    punctuation share. Of more than ``remember`` chunks those met once only are forgotten, of what is left the half met least.
    Ids are kept as bytes, four each: hundreds of thousands of lists would be walked by every full garbage collection.
    """

    def __init__(self, path: str, remember: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.remember, self.parts = self.tokenizer.model, remember, {}
        self.codes, self.sizes, self.starts, self.hits, self.pool = _Codes(self.encode_chunk), *(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, "<u4"))

    def _forget(self) -> None:
        keep = self.hits > 1
        if keep.sum() > self.remember // 2:
            keep &= self.hits > np.median(self.hits[keep])
        kept = np.flatnonzero(keep)
        names = list(self.codes)
        self.codes = _Codes(self.encode_chunk)
        self.codes.update((names[k], i) for i, k in enumerate(kept.tolist()))
        sizes, starts = self.sizes[kept], self.starts[kept]
        ends = np.cumsum(sizes)
        self.pool = self.pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        self.sizes, self.starts, self.hits = sizes, ends - sizes, self.hits[kept] // 2

    def _encode_part(self, part: str) -> bytes:
        if len(self.parts) > self.remember:
            self.parts.clear()
        name = part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_NAME)
        ids = [t.id for t in self.model.tokenize(name)]
        self.parts[part] = packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed

    def encode_chunk(self, chunk: bytes) -> bytes:
        """Ids as unsigned 32-bit little-endian integers."""
        text = chunk.decode(errors="replace")
        known = self.parts.get
        if chunk.isalpha():  # of ASCII letters only: one part
            part = text.lower()
            return known(part) or self._encode_part(part)
        if PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join([known(part) or self._encode_part(part) for part in PRETOKEN.findall(text.lower())])
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_flat(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and where each text begins; the last bound is the end."""
        if len(self.codes) > self.remember:
            self._forget()
        chunks = [t.split() if t else [] for t in texts]
        counts = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(chunks)), dtype=np.int64, count=int(counts.sum()))
        if fresh := self.codes.fresh:
            sizes = np.fromiter(map(len, fresh), dtype=np.int64, count=len(fresh)) // 4
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.hits = np.concatenate([self.hits, np.zeros(len(fresh), dtype=np.int64)])
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(fresh), dtype="<u4")])
            self.codes.fresh = []
        self.hits += np.bincount(codes, minlength=len(self.hits))
        each = self.sizes[codes]
        ends = np.cumsum(each)
        every = self.pool[np.repeat(self.starts[codes] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        return every, np.concatenate([[0], ends])[np.cumsum(np.concatenate([[0], counts]))]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One per Python worker, which runs many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def closed(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end`` after each text."""
    return np.insert(ids, bounds[1:], np.uint32(end)), bounds + np.arange(len(bounds))


def _cut(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for part in slices(batches, ("_text",)):
            at, piece, start, length, crc = [], [], [], [], []
            every, bounds = closed(*own.encode_flat(part.column("_text").to_pylist()), END)
            for i, (first, last) in enumerate(zip(bounds[:-1], bounds[1:])):
                ids = every[first:last]
                for k, a in enumerate(range(0, len(ids), limit)):
                    cut = ids[a:a + limit]
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(len(cut))
                    crc.append(zlib.crc32(cut.tobytes()))
            yield pa.RecordBatch.from_arrays([part.column("_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                                             ["_id", "piece", "start", "length", "ids_crc32"])
    return run


def cut_documents(docs: DataFrame, tokenizer_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``limit`` tokens: only documents longer than that are cut."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    schema = f"_id {dict(rows.dtypes)['_id']}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(_cut(tokenizer_path, limit), schema).withColumnRenamed("_id", id_col)


def best_fit(lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Longest first, each into the fullest bin that still takes it. Bins are found by a bit mask of their free space."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(limit + 1)]
    mask = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
            bins[b].append(int(i))
        else:
            free, b = limit, len(bins)
            bins.append([int(i)])
        by_free[free - size].append(b)
        mask |= 1 << (free - size)
    return bins


def _best_exchange(sizes: np.ndarray, home: np.ndarray, fill: np.ndarray, donor: int, limit: int) -> tuple[int, list[int], int] | None:
    """(bin, items it takes, item it gives or -1) of the exchange with ``donor`` that moves most tokens to a bin as full or fuller."""
    own = np.flatnonzero(home == donor)
    room = limit - fill
    open_bins = np.flatnonzero((room > 0) & (fill >= fill[donor]) & (np.arange(len(fill)) != donor))
    if not len(open_bins):
        return None
    may = np.zeros(len(fill), dtype=bool)
    may[open_bins] = True
    others = np.flatnonzero(may[home])
    gives = np.concatenate([np.zeros(len(open_bins), dtype=np.int64), sizes[others]])
    bins, rooms = np.concatenate([open_bins, home[others]]), np.concatenate([room[open_bins], room[home[others]]])
    takes = [[a] for a in own] + [[a, b] for i, a in enumerate(own) for b in own[:i]]
    best, gain = None, 0
    for items in takes:
        grow = int(sizes[items].sum()) - gives
        grow[grow > rooms] = 0
        k = int(np.argmax(grow))
        if grow[k] > gain:
            gain, best = int(grow[k]), (int(bins[k]), items, -1 if k < len(open_bins) else int(others[k - len(open_bins)]))
    return best


def improve(bins: list[list[int]], lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Local search: the emptiest bin gives to fuller ones by moves, one-for-one and two-for-one swaps until it is empty.

    An exchange moves net tokens to a bin that is at least as full, so the sum of squared fills grows with
    each and the search ends: at the least number of bins that can hold the tokens, or when a round over all underfull
    bins has emptied none.
    """
    sizes = np.asarray(lengths, dtype=np.int64)
    home = np.empty(len(sizes), dtype=np.int64)
    for b, items in enumerate(bins):
        home[items] = b
    fill = np.bincount(home, weights=sizes, minlength=len(bins)).astype(np.int64)
    least, emptied = -(-int(sizes.sum()) // limit), True
    while emptied and (fill > 0).sum() > least:
        emptied, tried = False, np.zeros(len(bins), dtype=bool)
        while (fill > 0).sum() > least:
            live = np.flatnonzero((fill > 0) & (fill < limit) & ~tried)
            if len(live) < 2:
                break
            donor = int(live[np.argmin(fill[live])])
            while fill[donor] and (deal := _best_exchange(sizes, home, fill, donor, limit)):
                b, takes, give = deal
                home[takes] = b
                net = int(sizes[takes].sum())
                if give >= 0:
                    home[give] = donor
                    net -= int(sizes[give])
                fill[b] += net
                fill[donor] -= net
            tried[donor] = True
            emptied |= not fill[donor]
    order = np.argsort(home, kind="stable")
    return [part.tolist() for part in np.split(order, np.flatnonzero(np.diff(home[order])) + 1)]


def _pack(limit: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "ids_crc32", "start"], ascending=False, ignore_index=True)
        lengths = part["length"].to_numpy()
        bins = improve(best_fit(lengths, limit), lengths, limit)
        order = np.concatenate([np.array(b) for b in bins])
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        out = part.iloc[order].reset_index(drop=True)
        ends = out["length"].groupby(number).cumsum().to_numpy()
        out["offset"] = ends - out["length"].to_numpy()
        out["sequence_id"] = out["_block"].to_numpy().astype(np.int64) * (1 << 32) + number
        return out.drop(columns="_block")
    return run


def pack(pieces: DataFrame, limit: int = 4096, block: int = 10_000) -> DataFrame:
    """``pieces`` (with ``length``, ``ids_crc32``, ``start``) and their place: ``sequence_id`` and ``offset``.

    Sequences are filled within blocks of about ``block`` pieces, dealt out by hash, so no task gets more and the
    number of blocks follows the input; a block wastes less than one sequence, about one in a thousand.

    Defined cases: an empty table gives an empty one; pieces that repeat are packed each for itself; a piece as
    long as ``limit`` fills a sequence alone. Ids play no part in the packing.
    """
    blocks = max(1, -(-pieces.count() // block))
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64(*pieces.columns), F.lit(blocks)).cast("int"))
    schema = ", ".join(f"`{n}` {t}" for n, t in [*pieces.dtypes, ("offset", "long"), ("sequence_id", "long")])
    return dealt.groupBy("_block").applyInPandas(_pack(limit), schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents, tokenized and closed by id 1, in as few sequences of ``limit`` tokens as the search finds.

    Returns one row per piece: the id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``offset``, ``sequence_id``.
    A null or empty text is the closing id alone; other columns are not read. Texts are tokenized where they
    lie and stored as pieces of about 40 bytes; only those are shuffled.
    """
    return pack(stored(cut_documents(docs, tokenizer_path, limit, id_col, text_col), "pieces"), limit)
