"""Near-duplicates and decontamination against brute force."""

import random
import re

import numpy as np
from llm_cases import docs_of, edge_docs, empty_docs

from tidemark.llm import decontaminate, lsh_forest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_by_hand(text):
    words = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    n = min(5, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def components_by_hand(rows):
    own = [(i, sets_by_hand(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x) in enumerate(own):
        for j, y in own[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in own}


def near_copies(rng, base, n, change):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(change):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_components_are_the_brute_force_ones(spark):
    rng = random.Random(11)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    texts = []
    for size in (2, 2, 3, 5, 8, 60):
        texts += near_copies(rng, prose(rng.choice((80, 150))), size, rng.choice((1, 2, 3)))
    common = prose(60)
    texts += [f"{prose(40)} {common} {prose(40)}" for _ in range(60)]  # a shared passage alone is no link
    texts += [texts[3].upper(), texts[3] + "  ", "tiny one", "Tiny  ONE", "", None] + [prose(90) for _ in range(40)]
    rng.shuffle(texts)
    got = lsh_forest.near_duplicates(docs_of(spark, texts)).collect()
    want = components_by_hand(list(enumerate(texts)))
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(sets_by_hand(texts[r.doc_id])) for r in got)


def test_neighbours_across_ranges_of_the_sort(spark):
    rng = random.Random(2)
    texts = near_copies(rng, " ".join(f"w{i}" for i in range(120)), 300, 1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        got = lsh_forest.near_duplicates(docs_of(spark, texts)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.doc_id: r.component_id for r in got} == components_by_hand(list(enumerate(texts)))


def test_links_inside_a_crowd_and_into_a_group_of_near_copies(spark):
    words = lambda name, n: [f"{name}x{k}" for k in range(n)]
    passage, base = words("p", 100), words("w", 140)
    crowd = [[*passage, *words(f"u{i}", 20)] for i in range(1500)]  # 96 of 136 shingles: 0.71
    for i in range(75):  # 100 of 132: 0.758
        crowd[1499 - i][100:104] = crowd[i][100:104]
    copies = [[*base, *words(f"e{i}", 5)] for i in range(200)]
    outside = [[*words(f"o{i}", 20), *base[20:], *words(f"e{i * 10}", 5)] for i in range(20)]  # 121 of 161 to one copy, 116 of 166 to the others
    texts = [" ".join(w) for w in [*crowd, *copies, *outside]]
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {i: 1500 if i >= 1500 else min(i, 1499 - i) if i >= 1425 else i for i in range(len(texts))}


def test_near_duplicate_edges(spark):
    docs = edge_docs(spark)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in lsh_forest.near_duplicates(docs).collect()), key=str)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = components_by_hand(rows)
    assert got == sorted(((i, len(sets_by_hand(t)), want.get(i), i == want.get(i)) for i, t in rows), key=str)
    assert lsh_forest.near_duplicates(empty_docs(spark)).count() == 0


def test_hashed_sets_have_the_true_sizes_and_signatures_estimate_similarity():
    rng = random.Random(4)
    base = " ".join(f"x{rng.randrange(9000)}" for _ in range(400))
    other = near_copies(rng, base, 1, 12)[0]
    x, y = lsh_forest.shingle_set(base), lsh_forest.shingle_set(other)
    a, b = sets_by_hand(base), sets_by_hand(other)
    assert (len(x), len(np.intersect1d(x, y))) == (len(a), len(a & b))
    assert abs(np.mean(lsh_forest.signature(x) == lsh_forest.signature(y)) - len(a & b) / len(a | b)) < 0.15


def hits_by_hand(text, items, width=10):
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        own = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        n = min(width, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i:i + n] == own[k:k + n] and item is not None:
                    hit |= set(range(i, i + n))
                    found.add(item)
    return len(words), len(hit), sorted(found)


def test_decontamination_is_the_brute_force_result(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["The", "a", "of", "Été", "x1", "naïve", "b"])
    passage = lambda n: " ".join(word() for _ in range(n))
    items = [(i, passage(n)) for i, n in enumerate((14, 11, 10, 3, 2, 25))] + [(3, "of of-of"), (None, passage(12)), (9, None), (10, "--"), (11, passage(12))]
    items += [(12, items[0][1])]
    texts = [passage(30) + "," + items[k % 6][1].upper().replace("É", "É") + "; " + passage(5) + items[(k + 1) % 6][1].replace(" ", " -- ") for k in range(25)] + [passage(200), None, "", items[3][1], "x" + items[3][1]]
    bench = spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id long, text string, window string")
    for block in (32 << 20, 200):  # one automaton, and several
        got = {r.doc_id: r for r in decontaminate.find_items(docs_of(spark, texts), bench, block_bytes=block).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == hits_by_hand(t, items), (block, t)
            inside = [len(re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t[a:b].translate(LOWER))) for a, b in got[i].spans]
            assert sum(inside) == got[i].n_hit  # the offsets hold in the text as given


def test_decontamination_edges(spark):
    docs = edge_docs(spark)
    bench = spark.createDataFrame([(1, "one two three"), (2, "ÀÉ text end")], "item_id long, text string")
    got = decontaminate.find_items(docs, bench).collect()
    assert len(got) == docs.count() and sum(r.n_hit == 3 for r in got) == 5 and all(r.n_hit == 0 for r in got if r.doc_id in (1, 2, 3, 6))
    assert decontaminate.find_items(empty_docs(spark), bench).count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and r["items"] == [] for r in decontaminate.find_items(docs, nothing).collect())
    twice = decontaminate.find_items(docs, bench, block_bytes=10).collect()  # repeated rows stay as many
    assert sorted(map(str, twice)) == sorted(map(str, got))


def test_doubtful_pairs_within_a_crowd_are_few_for_each_component(spark):
    """``crowd_pairs`` looks at these anyway: their number went with the size of a group times its neighbours in all orders."""
    low, strong = lsh_forest.MAYBE, lsh_forest.STRONG
    rows = [(a, b, low + (a + b) % 20, a, b) for a in range(40) for b in range(a + 1, 40)] + [(1, 99, low, 1, 99), (98, 99, low, 98, 99)] + [(2, 39, strong, 2, 39)]
    pairs = spark.createDataFrame(rows, "a long, b long, same long, ra long, rb long")
    kept = [tuple(r) for r in lsh_forest.without_crowds(pairs, spark.range(40).withColumnRenamed("id", "rep")).collect()]
    assert {(1, 99, low, 1, 99), (98, 99, low, 98, 99), (2, 39, strong, 2, 39)} <= set(kept) <= set(rows)
    for hi in range(1, 40):
        of = sorted((r[2] for r in kept if r[4] == hi and r[2] < strong), reverse=True)
        assert of == sorted((r[2] for r in rows if r[4] == hi and r[2] < strong), reverse=True)[:lsh_forest.NEIGHBOURS]
