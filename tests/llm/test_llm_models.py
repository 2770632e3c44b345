"""Quality model, personal data and secrets: held-out accuracy, brute force, exact decoding."""

import hashlib
import itertools
import os
import re

import numpy as np
import pytest
from llm_cases import docs_of, edge_docs, empty_docs
from pyspark.sql import functions as F

from tidemark.llm import pii_boost, quality_gam, secret_crf
from tidemark.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_quality_on_held_out_labels(spark):
    scored = quality_gam.score_documents(table(spark, SF, "documents"), table(spark, SF, "labels"))
    rows = scored.filter("held_out").join(table(spark, SF, "labels"), "doc_id").select("quality", "predicted", "score").collect()
    assert np.mean([r.quality == r.predicted for r in rows]) >= 0.95
    bad, good = ([r.score for r in rows if r.quality == q] for q in (0, 1))
    assert np.mean([g > b for g in good for b in bad]) >= 0.98  # area under the curve


def test_pairs_are_learned_where_no_single_feature_helps():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    flat, model = quality_gam.fit(x[:2000], y[:2000], pairs=0), quality_gam.fit(x[:2000], y[:2000], pairs=2)
    right = lambda m: np.mean((m.score(x[2000:]) > 0.5) == y[2000:])
    assert right(flat) < 0.65 and right(model) > 0.85 and (1, 3) in model.terms
    # a score is the sum of table entries
    term = model.terms[(0,)]
    assert len(term) == len(model.cuts[0]) + 1


def test_quality_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (4, 0), (4, 1), (None, 1), (5, None), (7, 1), (99, 0)], "doc_id long, quality int")
    got = quality_gam.score_documents(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    none = quality_gam.score_documents(docs, labels.limit(0)).collect()
    assert all(r.predicted == 1 for r in none)  # nothing is rejected without evidence
    assert quality_gam.score_documents(empty_docs(spark), labels).count() == 0
    kept = quality_gam.score(docs, quality_gam.fit(np.zeros((0, 14)), np.zeros(0)), score_col="points")
    assert kept.columns == [*docs.columns, "points"] and kept.first()["row"] == "extra row"


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    worth = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
    return sum(worth) % 10 == 0


def personal_by_hand(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), list(PATTERNS).index(kind), m.end()))
    return sorted(out)


TRICKY = ["a@b.c._x@d.e", "..@x-.-a.b", "a@b@c.d", "x@y", "1.2.3.4.5.6.7.8", "999.1.1.1 0001.02.3.255", "1.2.3", "4111 1111-1111 1111", "4111  1111 1111 1111", "49927398716 79927398713", "+1 (800) 555-0100.", "+1+22 333 444 555 66",
          "++49 (0)30.123-45) x", "é@ü.de a@b.é é4111111111111111é", "4111111111111111@x.y", "1" * 300, "@" * 50, "a" * 5000 + "@", "+" + "1 " * 40, "12-34-56-78-90-12-34-56", None, "", "10.0.0.1@host.org"]


def test_base_spans_are_the_brute_force_ones(spark):
    texts = TRICKY + [" ".join(p) for p in itertools.permutations(TRICKY[:4])] + ["é " + "\n".join(filter(None, TRICKY))]
    got = {r.doc_id: r for r in pii_boost.find_personal(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i].base] == personal_by_hand(t), t
        assert {tuple(s) for s in got[i].base} <= {tuple(s) for s in got[i].spans}


def test_trees_add_what_looks_alike_and_leave_other_digits_alone(spark):
    rng = np.random.default_rng(3)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    texts = [f"please call +1 ({digits(3)}) {digits(3)}-{digits(4)} now" for _ in range(60)] + [f"mail to user{i}@host{i}.example.com today" for i in range(60)]
    texts += [f"order {digits(3)} {digits(3)} {digits(4)} was {digits(2)} units" for _ in range(120)]
    extra = ["mail to someone (at) host7.example.com today", "nothing here", "order 123 456 7890 was 11 units"]
    got = {r.doc_id: r for r in pii_boost.find_personal(docs_of(spark, texts + extra)).collect()}
    added = lambda i: [tuple(s) for s in got[i].spans if s not in got[i].base]
    at = len(texts)
    assert added(at + 1) == [] and added(at + 2) == []
    assert all(x[1] == 0 for x in added(at))  # if anything, an address


def test_spans_in_other_forms_are_added(spark):
    rng = np.random.default_rng(4)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def card():
        front = digits(15)
        return next(front + d for d in "0123456789" if luhn(front + d))

    fours = lambda d, sign: sign.join(d[k:k + 4] for k in range(0, 16, 4))
    texts = [f"mail to user{i}@host{i}.example.com today" for i in range(160)] + [f"paid by card {fours(card(), ' ')} today" for _ in range(160)]
    texts += [f"order {digits(3)} {digits(3)} {digits(4)} was {digits(2)} units" for _ in range(160)]
    good = card()
    bad = good[:-1] + str((int(good[-1]) + 1) % 10)
    extra = ["mail to someone [at] host7 [dot] com today", f"paid by card {fours(good, '.')} today", f"paid by card {fours(bad, '.')} today", "order 123 456 7890 was 11 units"]
    got = {r.doc_id: r for r in pii_boost.find_personal(docs_of(spark, texts + extra)).collect()}
    added = [[tuple(s) for s in got[len(texts) + k].spans if s not in got[len(texts) + k].base] for k in range(len(extra))]
    assert added == [[(8, 0, 36)], [(13, 2, 32)], [], []]


def test_trees_and_thresholds_count_every_candidate(spark):
    """Of 45,400 candidates the cards are those of the greatest hashes, which the 20,000 of the least hash left out: nothing was known of cards."""
    base = lambda k, value, before, is_base: [F.lit(0).alias("start"), F.lit(k).alias("kind"), F.char_length(value).alias("end"), value.alias("value"),
                                              F.lit(before).alias("before"), F.lit(is_base).alias("is_base"), F.lit(is_base).alias("over_base")]
    phones = spark.range(45_000).select("id", F.col("id").alias("row"), *base(3, F.format_string("%03d %03d %04d", F.col("id") % 900 + 100, F.lit(555), F.col("id") % 10_000), "was ", False))
    cards = spark.range(100_000, 102_000).select("id", F.col("id").alias("row"), *base(2, F.lit("4111 1111 1111 1111"), "card ", True))
    cards = cards.withColumn("_h", F.xxhash64("id", "row", "start", "kind", "value")).filter("_h > 0").orderBy("_h").limit(400).drop("_h")
    loose = phones.unionByName(cards)
    counted = {(r.kind, r.label): r.n for r in pii_boost.taught_rows(loose).groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()}
    assert counted == {(3, 0.0): 45_000, (2, 1.0): 2 * 400}  # a base span is there in another form too
    assert set(pii_boost.learn(loose).least) == {2}


def test_personal_edges(spark):
    docs = edge_docs(spark)
    got = pii_boost.find_personal(docs).collect()
    assert len(got) == docs.count()
    assert pii_boost.find_personal(empty_docs(spark)).count() == 0


SECRETS = ["password=abc123 x", "API_KEY = 'q/+=.-_9' ", "api-key: abcdefgh", "PassWd\":  \"short", "ſecret=abcdef", "token:abcdef", "AKIA" + "Z" * 16 + " AKIAx", "f" * 24, "f" * 23 + "g", "xAKIA" + "0" * 20 + "y", "secret= \nvalue1", None, "", "a=b token=abcdef token=ghijkl"]


def test_base_secrets_and_joined_hash(spark):
    got = {r.doc_id: r for r in secret_crf.find_secrets(docs_of(spark, SECRETS)).collect()}
    for i, t in enumerate(SECRETS):
        base = secret_crf.base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == kind for k, _, _ in base) for kind in secret_crf.KINDS)
    assert [got[i].n_assign for i in range(6)] == [1, 1, 0, 0, 0, 1] and got[13].n_assign == 2 and got[6].n_access == 1 and got[7].n_hex == 1 and got[8].n_hex == 0


def test_viterbi_finds_the_best_of_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(30):
        e, s = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
        paths = [p for p in itertools.product(range(3), repeat=5) if p[0] != 2 and all(not (a == 0 and b == 2) for a, b in zip(p, p[1:]))]
        worth = lambda p: sum(e[i, t] for i, t in enumerate(p)) + sum(s[a, b] for a, b in zip(p, p[1:]))
        assert tuple(secret_crf.viterbi(e, s)) == max(paths, key=worth)


def test_field_tags_unseen_secrets_and_leaves_prose_alone():
    rng = np.random.default_rng(5)
    code = lambda: "".join(rng.choice(list("0123456789abcdef"), 18))
    prose = lambda: " ".join(rng.choice("the of and was here there when they come back again number 12 2021 at 10:30".split(), 30))
    texts = [f"{prose()} password={code()} {prose()}" for _ in range(80)] + [prose() for _ in range(80)]
    model = secret_crf.fit([w for t in texts for w in secret_crf.windows_of(t)])
    found = sum(bool(secret_crf.decode(model, f"{prose()} credential = {code()} {prose()}", {})) for _ in range(20))
    assert found >= 15 and not any(secret_crf.decode(model, prose(), {}) for _ in range(50))
    text = f"x password={code()} y"
    assert [text[a:b] for a, b in secret_crf.decode(model, text, {})] == [text.split("=")[1].split()[0]]
    shapes = {}
    for t in texts[:40]:  # skipping texts without a telling token changes nothing
        tokens = secret_crf.TOKEN.findall(t)
        full = secret_crf.viterbi(model.emissions(np.array([secret_crf.shape(x) for x in tokens]), np.array([model.word(x) for x in tokens]), secret_crf.file_of(tokens)), model.step)
        assert bool(secret_crf.decode(model, t, shapes)) == any(full)


def test_secret_edges(spark):
    docs = edge_docs(spark)
    got = secret_crf.find_secrets(docs).collect()
    assert len(got) == docs.count() and all(r.spans == "" for r in got)
    assert secret_crf.find_secrets(empty_docs(spark)).count() == 0


ODD = list("aZé1٣²ſK.$\"'`=:,;()<>{}[]\n\x1c\x85\u00a0\u2028") + ["AKIA", "f" * 23, "0A" * 9, "password", "Token", "api_key", "ΟΔΟΣ", "ǅ", "一", " = ", "'s"]


def test_tokens_shapes_and_base_spans_of_odd_texts():
    rng = np.random.default_rng(3)
    for _ in range(4000):
        text = "".join(rng.choice(ODD, rng.integers(0, 12)))
        tokens = secret_crf.TOKEN.findall(text)
        assert secret_crf.tokens_of(text) == tokens
        for t in tokens:
            if not t.isalpha() and t not in ("=", ":"):
                lower, upper, digit = (any(map(f, t)) for f in (str.islower, str.isupper, str.isdigit))
                sign = not t.replace(".", "").replace(",", "").isalnum()
                turns = sum(a.isdigit() != b.isdigit() for a, b in zip(t, t[1:]))
                assert secret_crf.shape(t) == 32 + (((lower * 2 + upper) * 2 + digit) * 2 + sign) * 24 + min(2, turns // 2) * 8 + min(7, len(t).bit_length())
        runs = [("assign", *m.span()) for m in secret_crf.ASSIGN.finditer(text) if len(m[2]) >= 6]
        runs += [(k, *m.span()) for k, p, n in (("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)) for m in re.finditer(p, text) if len(m[0]) >= n]
        assert secret_crf.base_spans(text) == sorted(runs, key=lambda s: (s[1], secret_crf.KINDS.index(s[0])))


def test_telling_texts_are_those_of_one_pattern(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice([*ODD, "akia", "b" * 16, '"', " "], rng.integers(0, 8))) for _ in range(3000)]
    rows = docs_of(spark, texts).select("doc_id", secret_crf.telling(F.col("text")).alias("t"),
                                        F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}").alias("one"))
    got = rows.collect()
    assert all(r.t == r.one for r in got) and 50 < sum(r.t for r in got) < 2950


def test_texts_that_are_not_decoded_have_no_tag():
    """All tokens of a batch are judged at once: any text with a tag is among the suspects, alone or beside others, and prose is not."""
    rng = np.random.default_rng(5)
    prose = lambda: " ".join(rng.choice(["the", "market", "price", "went", "down", "Some", "day.", "in"], 40))
    code = lambda: "".join(rng.choice(list("abcdef0123456789"), 28))
    texts = [f"{prose()} {name} = {code()} {prose()}" for name in ("password", "token", "secret") for _ in range(20)]
    model = secret_crf.fit([w for t in texts for w in secret_crf.windows_of(t)])
    cases = [None, "", " ", "=", code(), f"= {code()}", *(prose() for _ in range(30)), *(f"{prose()} {x}" for x in (code(), "token", "password = x", "K = 1")),
             *("".join(rng.choice([*ODD, " ", code(), "the "], rng.integers(0, 15))) for _ in range(500)), None, *texts[:5], ""]
    numbers = secret_crf.Numbers(model)
    judged = secret_crf.suspects(model, cases, numbers)
    assert judged.tolist() == [bool(secret_crf.suspects(model, [t], secret_crf.Numbers(model))[0]) for t in cases] == secret_crf.suspects(model, cases, numbers).tolist()
    tagged = []
    for t in cases:
        tokens = secret_crf.TOKEN.findall(t or "")
        e = model.emissions(np.array([secret_crf.shape(x) for x in tokens]), np.array([model.word(x) for x in tokens]), secret_crf.file_of(tokens)) if tokens else None
        tagged.append(bool(tokens) and any(secret_crf.viterbi(e, model.step)))
    assert any(tagged) and all(s for s, t in zip(judged, tagged) if t) and not judged[6:36].any()
    assert not secret_crf.suspects(secret_crf.Crf(), cases, secret_crf.Numbers(secret_crf.Crf())).any() and len(secret_crf.suspects(model, [], numbers)) == 0


def test_ids_of_least_hash_however_many_rows_are_looked_at_first(spark, monkeypatch):
    rows = spark.range(600).select((F.col("id") % 400).alias("_id"), F.when(F.col("id") % 7 == 0, "password = x").otherwise("x").alias("_text"))
    every = [r._id for r in rows.select("_id").distinct().orderBy(F.xxhash64("_id")).collect()]
    kept = {r._id for r in rows.filter("_text <> 'x'").collect()}
    for look, n in ((1, 10), (3, 10), (20, 10), (1000, 10), (1, 1000), (2, 0)):
        monkeypatch.setattr(secret_crf, "LOOK", look)
        assert {r._id for r in secret_crf.least_ids(rows, F.lit(True), n, 600).collect()} == set(every[:n])
        got = secret_crf.least_ids(rows, secret_crf.telling(F.col("_text")), n, 600)
        assert sorted(r._id for r in got.collect()) == sorted([i for i in every if i in kept][:n]) and got.schema["_id"].dataType == rows.schema["_id"].dataType
    assert secret_crf.least_ids(rows.limit(0), F.lit(True), 5, 0).count() == 0


def test_hex_digits_are_found_wherever_they_begin():
    for length in range(20, 32):
        for before in range(7):
            for after in ("", "g", "zz z"):
                text = "x" * before + "0123456789abcdef"[before:] + "c" * (length - 16 + before) + after
                want = [("hex", before, before + length)] if length >= 24 else []
                assert secret_crf.base_spans(text) == want and secret_crf.base_spans(text + " é" + text)[:len(want)] == want
