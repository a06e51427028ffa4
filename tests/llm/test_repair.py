"""Conversation repair against all edits tried one by one, and its corner cases."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from codeq.llm import repair

GRAMMAR = re.compile("(s?(ua)+)?")
COLUMNS = "conv_id long, turn long, role string, text string"


def all_repairs(symbols):
    """(cost, audit) of every row of edits with up to two inserts at a place, least first, by trying all."""
    best = {}
    inserts = ["", "u", "a", "ua", "au"]
    choices = []
    for s in symbols:
        extra = 3 if s.isupper() else 0
        own = [(4, "D", "")]
        if s != "d":
            own += [(extra, "K", s.lower())] + [(3 + extra, "R", r) for r in "ua"]
        choices.append(own)
    for picks in itertools.product(*choices):
        for put in itertools.product(inserts, repeat=len(symbols) + 1):
            roles = put[0] + "".join(p[2] + x for p, x in zip(picks, put[1:], strict=True))
            if GRAMMAR.fullmatch(roles):
                cost = sum(p[0] for p in picks) + 3 * sum(map(len, put))
                audit = "I" * len(put[0]) + "".join(
                    p[1] + "I" * len(x) for p, x in zip(picks, put[1:], strict=True))
                best[audit] = min(cost, best.get(audit, cost))
    return min((c, a) for a, c in best.items())


def test_every_short_signature():
    every = ["".join(x) for n in range(3) for x in itertools.product("suaoUAd", repeat=n)]
    every += ["".join(random.Random(i).choices("suaoSUAOd", k=3 + (i > 55))) for i in range(60)]
    endings = repair.Endings()
    found = {}
    for signature in sorted(set(every), key=lambda s: s[::-1]):
        endings.to(signature[::-1])
        found[signature] = endings.best()
    assert found == {s: all_repairs(s) for s in found}
    assert endings.nodes < sum(map(len, found)), "endings are shared"


def test_long_signatures_share_few_shapes():
    dice, endings = random.Random(3), repair.Endings()
    signature = "".join(dice.choices("suaoSUAOd", k=50_000))
    endings.to(signature[::-1])
    cost, audit = endings.best()
    assert sum(c != "I" for c in audit) == len(signature) and len(endings.shapes) < 400
    own = {"D": 4, "I": 3, "R": 3, "K": 0}
    rows = iter(signature)
    paid = sum(own[c] + (3 if c in "KR" and next(rows).isupper() else 0 * (c in "D" and bool(next(rows))))
               for c in audit)
    assert paid == cost


def plain(rows):
    """One conversation's row by the rules, with the repair found by trying everything."""
    told = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1],
                                       hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    seen, signature, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in told:
        words = text.strip(" \t\n\x0b\x0c\r")
        fault = ("blank" if not words else "duplicate" if (role, text) in seen
                 else "truncated" if words[-1] not in ".!?" else None)
        seen.add((role, text))
        symbol = role[:1] if role[:1] in ("s", "u", "a") else "o"
        signature += symbol if not fault else symbol.upper() if fault == "truncated" else "d"
        if fault:
            faults[fault] += 1
    cost, audit = all_repairs(signature)
    turns = [r[0] for r in told if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(told)]
    out, left, state = [], iter(told), 0
    for edit in audit:
        row = next(left) if edit != "I" else (None, "", "")
        if edit == "D":
            continue
        role = row[1] if edit == "K" else "assistant" if state == 2 else "user"
        state = {"s": 1, "u": 2, "a": 3}[role[0]]
        out.append(f"{role}:{row[2]}")
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **faults,
            "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


@pytest.fixture(scope="module")
def odd_rows():
    dice = random.Random(5)
    texts = ["Yes.", "No!", "well", "", " \t", "a.b", "?", "x" * 100_000 + ".", "Σ…", None, "one\ntwo."]
    rows = [(conv, dice.choice([None, 0, 1, 2, 3, 9, -4]), dice.choice(["user", "assistant", "system", "", None, "tool"]),
             dice.choice(texts)) for conv in [None, 1, 2, 3, 4, 5, 6, 7, 8] for _ in range(dice.randrange(1, 4))]
    return [*rows, rows[0], rows[4]]


def test_against_all_edits(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, COLUMNS).repartition(3)
    got = {r["conv_id"]: r.asDict() for r in repair.repairs(df).collect()}
    groups = {}
    for conv, turn, role, text in odd_rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got == {conv: {"conv_id": conv, **plain(own)} for conv, own in groups.items()}
    turns = repair.repaired_turns(df).collect()
    for conv, row in got.items():
        own = sorted((r for r in turns if r["conv_id"] == conv), key=lambda r: r["place"])
        whole = "\n".join(f"{r['role']}:{r['text']}" for r in own)
        assert hashlib.sha256(whole.encode()).hexdigest() == row["repaired_sha256"]
        assert GRAMMAR.fullmatch("".join(r["role"][0] for r in own))
        assert "".join(r["edit"] for r in own) == row["audit"].replace("D", "")


def test_damage(spark):
    import zlib
    rows = [(c, t, r, "Hi. You?") for c in (None, *range(40)) for t, r in ((None, "system"), (1, "user"), (2, None))]
    want, seen = [], set()
    for conv, turn, role, text in rows:
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        seen.add(what)
        role = "user" if what == 4 else " " if role is None else role
        text = "" if what == 1 else "Hi You" if what == 2 else text
        want += [(conv, turn, role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    got = repair.damaged(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and seen >= set(range(5))


def test_nothing_left_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert repair.repairs(none).count() == 0 and repair.repaired_turns(none).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "A."), (1, 1, "assistant", "B.")], COLUMNS)
    gone = repair.repairs(none, df).first().asDict()
    assert gone == {"conv_id": 1, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0,
                    "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    clashing = df.select("*", *[F.lit("x").alias(c) for c in ("kind", "same", "first", "audit", "signature", "_copy")])
    assert repair.repairs(repair.damaged(clashing), clashing).count() == 1
    assert repair.repairs(clashing).first()["audit"] == "KK"


def test_hot_conversation_in_many_batches(spark):
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"Text {i}.") for i in range(5000)]
    rows += [(8, 0, "user", "Hi."), (8, 1, "assistant", "Hi.")]
    got = {r["conv_id"]: r for r in repair.repairs(spark.createDataFrame(rows, COLUMNS).repartition(4)).collect()}
    assert got[7]["audit"] == "K" * 5000 and got[8]["audit"] == "KK"
    whole = "\n".join(f"{r[2]}:{r[3]}" for r in rows[:5000])
    assert got[7]["repaired_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
