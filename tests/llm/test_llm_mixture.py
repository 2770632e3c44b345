"""Mixture packing: every token once, no padding, windows in the target mixture, deficits carried over blocks."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import docs_of, edge_docs, empty_docs
from tokenizers import Tokenizer

from tidemark.llm import mixture_packing as mixture
from tidemark.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")


def check(rows, window):
    """Sequences without gaps, as long as a window or a power of two; documents without gaps."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= window and at & (at - 1) == 0
    return by


@pytest.mark.parametrize("window, block", [(4096, 2_000_000), (8, 50), (64, 1000)])
def test_round_trip(spark, tokenizer, window, block):
    texts = ["It's a TEST, isn't it?", None, "", "word " * 900, "日本語 text — dash", "one", "two three", "x" * 300] * 3
    docs = spark.createDataFrame([(i, t, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3)
    rows = mixture.pack_mixture(docs, tokenizer_path(), window=window, block_tokens=block, min_piece=4).collect()
    check(rows, window)
    for i, t in enumerate(texts):
        ids = ids_of(tokenizer, t)
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def shares(rows, window):
    whole, by = Counter(), defaultdict(Counter)
    for r in rows:
        by[r.sequence_id][r.source] += r.length
        whole[r.source] += r.length
    return whole, {k: c for k, c in sorted(by.items()) if sum(c.values()) == window}


def test_windows_hold_the_mixture_of_the_whole(spark):
    rng = np.random.default_rng(4)
    sizes = {"a": 900, "b": 300, "c": 60, "d": 3}
    docs = spark.createDataFrame([(i, "w " * int(rng.integers(1, 200)), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, text string, source string").repartition(4)
    rows = mixture.pack_mixture(docs, tokenizer_path(), window=1024, min_piece=16, block_tokens=20_000).collect()
    check(rows, 1024)
    whole, windows = shares(rows, 1024)
    total, run, n = sum(whole.values()), Counter(), 0
    for held in windows.values():
        n += 1
        for s in whole:
            run[s] += held[s]
            assert abs(held[s] - 1024 * whole[s] / total) <= 40, (s, held)
    for s in whole:  # what was carried over all blocks comes out even
        assert abs(run[s] / n / 1024 - whole[s] / total) < 0.01


def test_targets_and_what_runs_dry(spark):
    docs = spark.createDataFrame([(i, "w " * 99, "ab"[i % 2] if i < 400 else "c") for i in range(500)], "doc_id long, text string, source string")
    rows = mixture.pack_mixture(docs, tokenizer_path(), targets={"a": 3, "b": 1}, window=1024, min_piece=16, block_tokens=8192).collect()
    check(rows, 1024)
    whole, windows = shares(rows, 1024)
    assert whole == {"a": 20_000, "b": 20_000, "c": 10_000}
    kinds = Counter(tuple(round(held[s] / 1024, 1) for s in "abc") for held in windows.values())
    assert {k for k, n in kinds.items() if n > 2} <= {(0.8, 0.2, 0.0), (0.7, 0.3, 0.0), (0.7, 0.2, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)} and len(kinds) <= 8
    assert {round(held["a"] / 1024, 2) for held in windows.values() if held["a"] and held["b"]} <= {0.73, 0.74, 0.75, 0.76, 0.77}


def test_courses_share_what_an_empty_source_leaves():
    course, phase, now = mixture.courses({"a": 300, "b": 100, "c": 100}, {"a": 1, "b": 1, "c": 2})
    assert phase == 3 and now == 500 and sum(b - a for _, _, a, b, _, _ in course) == 500
    assert [(s, p, a, b) for s, p, a, b, _, _ in course] == [("a", 0, 0, 50), ("b", 0, 0, 50), ("c", 0, 0, 100), ("a", 1, 50, 100), ("b", 1, 50, 100), ("a", 2, 100, 300)]


def test_round_robin_carries_what_it_owes():
    totals = np.array([5000, 5000, 30])
    served = list(mixture.round_robin(totals, totals.astype(float), np.array([0.0, 0.0, 0.0]), window=100, min_piece=10))
    assert sum(c for w in served for _, c in w) == totals.sum() and all(sum(c for _, c in w) == 100 for w in served[:-1])
    at = [i for i, w in enumerate(served) for s, _ in w if s == 2]
    assert len(at) == 3 and min(b - a for a, b in zip(at, at[1:])) > 20  # ten tokens each time they are earned


def test_edges(spark):
    rows = mixture.pack_mixture(edge_docs(spark), tokenizer_path(), window=128, block_tokens=5000).collect()
    check(rows, 128)
    assert sum(r.length for r in rows if r.doc_id == 4) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 4)
    assert sum(r.doc_id is None and r.start == 0 for r in rows) == 2 and sum(r.doc_id == 3 for r in rows) > 100
    assert mixture.pack_mixture(empty_docs(spark), tokenizer_path()).count() == 0
    same = spark.createDataFrame([(1, "same text", "a")] * 3000, "doc_id long, text string, source string")
    rows = mixture.pack_mixture(same, tokenizer_path(), window=64, block_tokens=1000).collect()
    check(rows, 64)
    assert sum(r.length for r in rows) == 9000 and len({r.sequence_id >> 20 for r in rows}) == 9
    with pytest.raises(ValueError):
        mixture.pack_mixture(docs_of(spark, ["a"]), tokenizer_path(), window=100)
