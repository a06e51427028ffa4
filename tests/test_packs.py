"""Scans of large packs against the scan that writes every rule into the plan."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeq.operators import packs, scan
from codeq.plans.corpus import CUSTOM_RULES
from codeq.rules.catalogue import PATTERN_RULES, PatternRule
from codeq.sources.snippets import SNIPPETS

LETTERS = "abcdefghijklmnopqrst"
MANY = tuple(PatternRule(f"M{n:04}", "info", rf"{a}{b}\w*{c}\b", "x", needles=(a + b,)) for n, (a, b, c) in
             enumerate(itertools.product(LETTERS, LETTERS, "eostr")))


@pytest.fixture(scope="module")
def files(make_files):
    texts = [code for _, code in SNIPPETS] + [
        None, "", "\n\n", "eval(x)\nEVAL(y) eval(z)\n", " import os\n eval(1)", "ſet ıf K\nimport ſys",
        "return a\r\nreturn b\n" * 40]
    return make_files({i: (f"f{i}.py", text, f"r{i % 3}") for i, text in enumerate(texts)})


def rows(df):
    return sorted(map(tuple, df.select("review_id", "file_id", "rule_id", "line_start").collect()))


def test_small_pack_equals_scan(files):
    rules = (*PATTERN_RULES, *CUSTOM_RULES)
    found = rows(packs.scan_pack(files, rules))
    assert found and found == rows(scan.scan_rules(files, rules))
    counts = {r["rule_id"]: r["n_matches"] for r in packs.count_pack(files, rules).collect()}
    assert counts == {r["rule_id"]: r["n_matches"] for r in scan.count_rules(files, rules).collect() if r["n_matches"]}


def test_two_thousand_rules(files):
    assert len(MANY) == 2000
    found = rows(packs.scan_pack(files, MANY))
    expected = []
    for low in range(0, 2000, 400):  # tried one text and rule after the other
        table = packs.pack_frame(files.sparkSession, MANY[low:low + 400])
        expected += rows(scan.scan_input(files).join(table, F.regexp_like("clean", F.col("pattern"))).select(
            "review_id", "file_id", "rule_id", F.explode(F.sequence(F.lit(1), F.regexp_count(
                "clean", F.col("pattern")))).alias("line_start")))
    pairs = [r[:3] for r in found]
    assert found and sorted(pairs) == sorted(r[:3] for r in expected)
    few = scan.scan_rules(files, MANY[::40])
    ids = {r.rule_id for r in MANY[::40]}
    assert [r for r in found if r[2] in ids] == rows(few)


def test_the_plan_does_not_grow_and_needs_no_shuffle(files):
    plans = [packs.scan_pack(files, MANY[:n])._jdf.queryExecution().optimizedPlan().toString() for n in (10, 2000)]
    assert len(plans[0].splitlines()) == len(plans[1].splitlines()) < 30
    assert "Exchange hash" not in packs.scan_pack(files, MANY)._jdf.queryExecution().executedPlan().toString()


LED = tuple(PatternRule(f"L{i}", "info", p, "x") for i, p in enumerate((
    "aan[a-z]+[es] ", "aa", "aaa?b", "aab{2,3}?c", "is[a-zk ]*", "ki[0-9]*", "ss+", "aa[ab]*a", "no", "im [a-z]{2}")))


def test_rules_led_by_plain_letters(make_files):
    """They are held to the text where their letters are; no text is repeated for them."""
    dice = random.Random(5)
    parts = ["aa", "a", "b", "bbb", "c", "is", "ıſ", "k", "\u212ai", "İs", "7", " ", "\n", "n", "no", "im ", "é", "\U0001d400", "\ue000"]
    texts = {i: "".join(dice.choice(parts) for _ in range(dice.randrange(40))) for i in range(150)}
    assert all(packs.lead(r.pattern) for r in LED)
    assert not any(packs.lead(p) for p in (r"ab\w", "a", "ab|c", "(ab)c", "^ab", "ab.", "ab[^c]", "aab*+", "a{2}b", "ab(?=c)"))
    files = make_files({i: ("f.txt", t) for i, t in texts.items()})
    tried = scan.scan_input(files).select(F.explode(packs._tried(LED)("clean", "folded")).alias("x"))
    assert tried.count() and not tried.filter("x.lines is null").count()
    found = rows(packs.scan_pack(files, LED))
    assert found == rows(scan.scan_rules(files, LED))
    counts = {r["rule_id"]: r["n_matches"] for r in packs.count_pack(files, LED).collect()}
    assert counts == Counter(r[2] for r in found) and len(counts) >= 8


def test_no_rules_no_files_and_too_many(files, monkeypatch):
    assert packs.scan_pack(files, ()).count() == 0
    assert packs.scan_pack(files.limit(0), MANY).count() == 0
    monkeypatch.setattr(packs, "MOST_CHARS", 100)
    with pytest.raises(ValueError, match="characters"):
        packs.scan_pack(files, MANY)
