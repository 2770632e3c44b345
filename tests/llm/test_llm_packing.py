"""Packing: exact round trip of the tokens, gapless sequences, and the local search."""

import gc
import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_cases import docs_of, edge_docs, empty_docs
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def check_places(rows, limit):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    return len(by)


@pytest.mark.parametrize("limit", [4096, 7])
def test_round_trip(spark, tokenizer, limit):
    texts = ["It's a TEST, isn't it? İstanbul ΣΑΣ naïve ÀÉ", "1234 !!'s ~~ $x=1", "<|endoftext|> é é  nbsp\x1cz", None, "", "word " * 50, "日本語 text — dash", "ß×÷ªº ǅ"]
    rows = packing.pack_documents(docs_of(spark, texts), tokenizer_path(), limit).collect()
    for i, t in enumerate(texts):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // limit)))
        for r in own:
            assert r.start == r.piece * limit and r.length == min(limit, len(ids) - r.start)
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    check_places(rows, limit)


def test_edges(spark):
    docs = edge_docs(spark)
    rows = packing.pack_documents(docs, tokenizer_path(), 100).collect()
    check_places(rows, 100)
    assert sum(r.doc_id == 4 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 3 for r in rows) > 100
    assert packing.pack_documents(empty_docs(spark), tokenizer_path()).count() == 0


def test_blocks_fill_their_sequences(spark):
    rng = np.random.default_rng(1)
    sizes = np.minimum(4096, rng.lognormal(6, 1, 4000).astype(int) + 1)
    pieces = spark.createDataFrame([(i, 0, 0, int(n), i) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(pieces, 4096, block=1000).collect()
    assert sorted(r.doc_id for r in rows) == list(range(4000))
    assert check_places(rows, 4096) <= sizes.sum() / 4096 + 2 * 4


def squares(bins, sizes):
    return sum(int(sizes[b].sum()) ** 2 for b in bins)


def test_swaps_empty_bins_of_any_start():
    rng = np.random.default_rng(7)
    for _ in range(3):
        sizes = rng.integers(100, 2000, 200)
        better = packing.improve([[i] for i in range(200)], sizes, 4096)  # a bin for each
        assert sorted(i for b in better for i in b) == list(range(200)) and all(sizes[b].sum() <= 4096 for b in better)
        assert len(better) <= sizes.sum() / 4096 * 1.08 + 1 and squares(better, sizes) > (sizes ** 2).sum()
    # no piece of the third bin fits anywhere; 40 for 30 fills the first, and 30 then fits into the second
    sizes = np.array([60, 30, 70, 40])
    better = packing.improve([[0, 1], [2], [3]], sizes, 100)
    assert sorted(sorted(sizes[b].tolist()) for b in better) == [[30, 70], [40, 60]]


def test_every_underfull_bin_is_tried():
    # forty bins that nothing can empty lie before the one that a swap empties
    sizes = np.array([51] * 40 + [60, 30, 70, 40])
    better = packing.improve([[i] for i in range(40)] + [[40, 41], [42], [43]], sizes, 100)
    assert len(better) == 42 and all(sizes[b].sum() <= 100 for b in better) and sorted(i for b in better for i in b) == list(range(44))


def test_remembered_ids_cost_the_garbage_collector_nothing():
    """Lists of ids, one for each distinct chunk, were walked by every full collection: the encoder spent over half its time there."""
    own = packing.ChunkEncoder(tokenizer_path())
    texts = [b"Plain words, don't it's re-do 12.5% \xc3\x89t\xc3\xa9", "naïve Ünder ß 東京 <|endoftext|> x".encode(), b"\xff\xfe bad", b"", None, b"Plain plain PLAIN"]
    ids, bounds = own.encode_flat(texts)
    for text, first, last in zip(texts, bounds[:-1], bounds[1:]):
        assert ids[first:last].tolist() == own.tokenizer.encode((text or b"").decode(errors="replace"), add_special_tokens=False).ids
    assert not any(gc.is_tracked(x) for x in own.parts.values()) and not any(gc.is_tracked(own.encode_chunk(c)) for c in own.codes)
