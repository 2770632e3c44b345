"""Conversation repair against an enumeration of edits on plain strings, and on the given table against a plain solver."""

import hashlib
import itertools
import os
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from tidemark.llm import conversation_repair as repair
from tidemark.llm.common import table
from tidemark.llm.queries import QUERIES

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WHITE = " \t\n\x0b\x0c\r"


def legal(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or bool(rest) and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2)


def every_repair(symbols, inserts=2):
    """Least (cost, letters) by trying all edits of all rows and all insertions of up to two rows in each gap."""
    gaps = [g for n in range(inserts + 1) for g in itertools.product("ua", repeat=n)]
    best = None
    ways = []
    for s in symbols:
        initial, must_go, extra = repair.SYMBOL[s]
        ways.append([("D", "", 4)] + ([] if must_go else [("K", initial, extra), ("R", "u", 3 + extra), ("R", "a", 3 + extra)]))
    for edits in itertools.product(*ways):
        for put in itertools.product(gaps, repeat=len(symbols) + 1):
            roles = "".join("".join(g) + e[1] for g, e in zip(put, edits)) + "".join(put[-1])
            if legal(roles):
                cost = sum(e[2] for e in edits) + 3 * sum(map(len, put))
                found = (cost, "".join("I" * len(g) + e[0] for g, e in zip(put, edits)) + "I" * len(put[-1]))
                best = found if best is None or found < best else best
    return best


def plain_repair(symbols):
    """Least (cost, letters) by a recursion on pairs of a number and a string, from the end."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, last, put):
        ways = [(0, "")] if i == len(symbols) and last in ("", "a") else []
        if put < 2:
            for r in "ua":
                if (last, r) in step:
                    c, l = best(i, r, put + 1)
                    ways.append((c + 3, "I" + l))
        if i < len(symbols):
            initial, must_go, extra = repair.SYMBOL[symbols[i]]
            c, l = best(i + 1, last, 0)
            ways.append((c + 4, "D" + l))
            for letter, r, price in (() if must_go else (("K", initial, extra), ("R", "u", 3 + extra), ("R", "a", 3 + extra))):
                if (last, r) in step:
                    c, l = best(i + 1, r, 0)
                    ways.append((c + price, letter + l))
        return min(ways, default=(10 ** 9, ""))

    for i in range(len(symbols), -1, -1):  # from the end, so that no recursion goes deep
        for put in (2, 1, 0):
            for last in ("", "s", "u", "a"):
                best(i, last, put)
    return best(0, "", 0)


def blockwise(symbols, size):
    blocks = [symbols[i:i + size] for i in range(0, len(symbols), size)]
    cost, path = repair.chained([repair.moves(b) for b in blocks])
    return cost, "".join(repair.spelled(b, p, q) for b, p, q in zip(blocks, path, path[1:])) + "I" * repair.TO_END[path[-1]]


def test_weights_against_all_edits():
    alphabet = "suaxSUAX0123"
    for n in (1, 2):
        for symbols in map("".join, itertools.product(alphabet, repeat=n)):
            assert blockwise(symbols, 8) == every_repair(symbols), symbols
    rng = random.Random(3)
    for _ in range(25):
        symbols = "".join(rng.choices(alphabet, k=3))
        assert blockwise(symbols, 8) == every_repair(symbols), symbols


def test_blocks_chain_to_the_same_answer():
    rng = random.Random(5)
    for _ in range(300):
        symbols = "".join(rng.choices("suaxSUAX0123uauaua", k=rng.randint(1, 40)))
        want = plain_repair(symbols)
        for size in (1, 3, 7, 64):
            assert blockwise(symbols, size) == want, (symbols, size)


def by_hand(rows):
    """The contract in plain Python: rows are (conv, turn, role, text) tuples."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        own = convs[conv]
        key = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if key == 1 else "".join(c for c in text if c not in ".!?") if key == 2 else text
        own += [(turn, "user" if key == 4 else role, text)] * (0 if key == 0 else 2 if key == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, symbols, faults = set(), "", defaultdict(int)
        for _, role, text in own:
            bare = text.rstrip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            at = "sua".find(role[:1]) if role[:1] else -1
            at = 3 if at < 0 else at
            symbols += "0123"[at] if fault in ("blank", "duplicate") else "SUAX"[at] if fault else "suax"[at]
        cost, audit = plain_repair(symbols)
        final, last, k = [], "", 0
        following = {"": "user", "s": "user", "u": "assistant", "a": "user"}
        for letter in audit:
            if letter == "I":
                final.append((following[last], ""))
            else:
                _, role, text = own[k]
                k += 1
                if letter != "D":
                    final.append((following[last] if letter == "R" else role, text))
            last = final[-1][0][0] if final else ""
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], pairs, cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in final).encode()).hexdigest())
    return out


def report(frame):
    return {r.conv_id: tuple(r[c] for c in (*repair.STATS, "audit", "repaired_sha256")) for r in frame.collect()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("folder", [SMALL, SF])
def test_query_against_plain_python(spark, folder):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in table(spark, folder, "conversations").collect()]
    assert report(QUERIES["op12_repair"](spark, folder)) == by_hand(rows)


def test_one_long_conversation_over_many_blocks(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system", "tool"]), rng.choice(["Yes.", "No", "", f"Line {t}.", f"Line {t}"])) for t in range(1500)]
    rows += [(2, t, "user" if t % 2 == 0 else "assistant", f"Reply {t}!") for t in range(700)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert report(repair.repair_report(frame)) == by_hand(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "Hello."), (None, None, None, None), (3, None, "user", None), (3, 2, "user", "Same."), (3, 2, "user", "Same."), (3, 2, "user", "Same."),
            (4, 1, "", "x"), (5, -3, "System", " \n\t "), (6, 10, "user", "long " * 200_000 + "end."), (6, 12, "assistant", "Ünï?\x0b"), (7, None, "user", "A."), (7, None, "user", "A.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as pos", "1 as block", "2 as n", "3 as kind", "4 as h1", "5 as audit", "6 as _copy")
    got = report(repair.repair_report(frame))
    assert got == by_hand(rows)
    # a table of which every row is dropped, and no row at all
    gone = [(c, 0, "user", "Hi.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = report(repair.repair_report(spark.createDataFrame(gone, "conv_id long, turn long, role string, text string")))
    assert set(got) == {c for c, *_ in gone} and set(got.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert repair.repair_report(frame.limit(0)).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "user", "And"), (2, 0, "assistant", "Yes?")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in repair.repaired(frame, repair.decide(frame)).orderBy("conv_id", "position").collect()]
    assert got == [(1, 0, "K", 0, "system", "Be kind."), (1, 1, "K", 1, "user", "Hi."), (1, 2, "R", 3, "assistant", "And"),
                   (2, 0, "I", None, "user", ""), (2, 1, "K", 0, "assistant", "Yes?")]
