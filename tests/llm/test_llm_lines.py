"""Line dedup and the line-frequency quality rules against brute force."""

import hashlib
import random
import re
from collections import defaultdict

from llm_cases import edge_docs, empty_docs

from tidemark.llm import line_dedup, line_quality

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def dedup_by_hand(rows, min_chars, min_docs):
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = x.strip(WHITE).translate(LOWER)
            if len(k) >= min_chars and i is not None:
                holders[k].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(h := holders.get(x.strip(WHITE).translate(LOWER), ())) >= min_docs and max(h) != i for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


def test_line_dedup_is_the_brute_force_result(spark):
    rng = random.Random(3)
    pool = [f"Shared line number {i} ÀÉ of some length" for i in range(6)] + ["short", "", "  "]
    change = [lambda x: x, str.upper, lambda x: f"\t {x}\r", lambda x: x + " own"]
    rows = [(i, "\n".join(rng.choice(change)(rng.choice(pool)) for _ in range(rng.randint(0, 9)))) for i in range(40)]
    rows += [(7, rows[7][1]), (7, "Shared line number 1 ÀÉ of some length\nmore"), (None, rows[9][1]), (50, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.drop_shared_lines(frame).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got), key=str) == dedup_by_hand(rows, 20, 3)


def test_line_dedup_edges(spark):
    docs = edge_docs(spark)
    out = line_dedup.drop_shared_lines(docs, min_chars=3, min_docs=2)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str) == dedup_by_hand(rows, 3, 2)
    assert set(out.columns) == set(docs.columns) and out.first()["pos"] == "extra pos"
    assert line_dedup.drop_shared_lines(empty_docs(spark)).count() == 0


def test_a_text_of_many_shared_lines(spark):
    many = "\n".join(f"a line that is long enough, number {i}" for i in range(5000))
    got = {r.doc_id: r for r in line_dedup.drop_shared_lines(spark.createDataFrame([(i, many) for i in range(4)], "doc_id long, text string")).collect()}
    assert [got[i].n_dropped for i in range(4)] == [5000, 5000, 5000, 0] and got[3].text == many and got[0].text == ""


def figures_by_hand(text):
    t = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", t)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i:i + 3])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_base_figures_are_the_brute_force_ones(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b", "c", "dé", "#x|", "<>", "\n", "\t", "e\n"]) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "a a a a", "a b", "  \n"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in line_quality.judge(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == figures_by_hand(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_depleted_documents_are_rejected_by_host(spark):
    own = lambda i: " ".join(f"word{i}n{k}" for k in range(60))
    frame = " ".join(f"menu{k}" for k in range(70))
    rows = [(i, f"{own(i)}\n{frame.upper()}" if i % 2 else f"{own(i)} {own(i + 1000)}\n {frame}", "h") for i in range(40)] + [(100 + i, f"{own(i)}\n{frame}", "other") for i in range(9)]
    got = {r.doc_id: r for r in line_quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].n_removed_words == 70 for i in range(40))
    assert [got[i].kept for i in range(4)] == [True, False, True, False]  # 60 of 130 words are left of the odd ones
    assert all(got[100 + i].kept and got[100 + i].n_removed_words == 0 for i in range(9))  # nine documents are too few


def test_quality_edges(spark):
    docs = edge_docs(spark)
    got = line_quality.judge(docs).collect()
    assert len(got) == docs.count() and not any(r.kept for r in got if r.n_words < 50)
    assert line_quality.judge(empty_docs(spark)).count() == 0


def test_hash_of_kept_text_matches_digest(spark, tmp_path):
    from tidemark.llm.queries import QUERIES

    rows = [(1, "A\nB", "en", "s", 3), (2, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.kept_sha256 for r in QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t, *_ in rows}
