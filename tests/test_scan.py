"""The pattern scan against Python's own regular expressions."""

import bisect
import random
import re

import pytest
from pyspark.sql import functions as F

from codeq.operators import scan
from codeq.rules import PATTERN_RULES, PatternRule
from codeq.sources.snippets import SNIPPETS

EDGES = [
    "", "\n", "eval(x)", "x = eval (y)\r\nexec(z)", "literal_eval(x)", "\féval(x) eval\x1c(y)",
    "except:\n\n  except Exception :\n", "bypass  \n\n\n", "pass", "pass\x1c\n", "PRINT(1); pprint(2)",
    "a.append(1)\n b.append(2)\nc.append(3)\nd.append(4)", "ſelect a %s", "SELECT a format(", "paſs",
    "İmport *", "ımport *", "import *", "# \u212aTODO", "#TODO # FIXME # XXX#HACK\n# hack",
    "x == None\ny is not None == z\n", "a == true == false", "eval\n\n(x)\nnoqa NOQA",
    "def f(" + "a" * 79 + ")\ndef g(" + "b" * 80 + ")\ndef h(" + "c,\n" * 40 + ")",
    "lambda a: lambda b: 1 # type:ignore", "ev\ue000al(x) \ue000eval(x)\ue000\nexec\ue001(y)",
    "'SELECT x WHERE' + y\n\"insert z values\"  + k 'Update t set' +",
    "s += 'x'\n'abc' + b += 1\nt + = \"\"", "password = 'a'; db_password='b'\nSECRET = \"\"",
    "global x\nglobal\n\ny", "for  i  in  range(len(x)): pass\nfor é in range(len(", "\u2028eval(\u2029exec(",
    "subprocess.run(a,\nshell=True)\nsubprocess.call(b, shell = true)", "random.choice (x)\x85time.sleep(0)",
]


def expected(texts, rules=PATTERN_RULES):
    """Python's matches; the line of one is found among the places of the line feeds."""
    out = []
    for file_id, text in texts.items():
        feeds = [i for i, c in enumerate(text) if c == "\n"]
        shown = dict(enumerate(text.splitlines()))
        for rule in rules:
            for found in re.compile(rule.pattern, re.I | re.M).finditer(text):
                above = bisect.bisect_left(feeds, found.start())
                out.append((file_id, rule.rule_id, above + 1, shown.get(above, "").strip()[:200]))
    return sorted(out)


def scanned(files, rules=PATTERN_RULES):
    return sorted(tuple(r) for r in scan.scan_rules(files, rules, snippets=True).select(
        "file_id", "rule_id", "line_start", "code_snippet").collect())


def random_texts(n, seed):
    words = ["eval", "(", ")", " ", "\n", "exec", "'", '"', "+", "=", "pass", "print", "SELECT ",
             " WHERE ", "#", "TODO", "é", "\r\n", "\t", "lambda x", "def f", "except", ":", "%s",
             ".append(", "noqa", "==", "True", "None", "global ", "a1", "_", "\x0b", "\u00a0",
             "range(len(", "for i in ", "password", "ſ"]
    dice = random.Random(seed)
    return {i: "".join(dice.choice(words) for _ in range(dice.randrange(1, 60))) for i in range(n)}


def test_edges_equal_python(make_files):
    texts = dict(enumerate(EDGES))
    assert scanned(make_files({i: ("a.txt", t) for i, t in texts.items()})) == expected(texts)


def test_random_texts_equal_python(make_files):
    texts = random_texts(400, 7)
    assert scanned(make_files({i: ("a.txt", t) for i, t in texts.items()})) == expected(texts)


def test_every_rule_fires_on_the_snippets(make_files):
    texts = {i: code for i, (_, code) in enumerate(SNIPPETS)}
    files = make_files({i: ("a.py", t) for i, t in texts.items()})
    found = scanned(files)
    assert found == expected(texts)
    assert {rule for _, rule, _, _ in found} == {r.rule_id for r in PATTERN_RULES}


def test_needles_never_hide_a_match(make_files):
    texts = random_texts(200, 11) | {1000 + i: t for i, t in enumerate(EDGES)}
    files = make_files({i: ("a.txt", t) for i, t in texts.items()})
    bare = [PatternRule(r.rule_id, r.severity, r.pattern, r.title) for r in PATTERN_RULES]
    assert scanned(files, bare) == scanned(files)


def test_counts_are_the_number_of_findings(make_files):
    texts = dict(enumerate(EDGES))
    files = make_files({i: ("a.txt", t) for i, t in texts.items()})
    counts = {r["rule_id"]: r["n_matches"] for r in scan.count_rules(files).collect()}
    assert len(counts) == len(PATTERN_RULES)
    for rule in PATTERN_RULES:
        assert counts[rule.rule_id] == sum(f[1] == rule.rule_id for f in expected(texts))


def test_many_matches_in_one_file(make_files):
    files = make_files({1: ("a.txt", "noqa noqa\n" * 20000)})
    found = scan.scan_rules(files)
    assert found.count() == 40000
    assert found.agg(F.max("line_start")).first()[0] == 20000


def test_enrich_keeps_every_finding(make_files):
    files = make_files({1: ("a.py", "eval(x)\nprint(1)\n")})
    rows = {r["rule_id"]: r for r in scan.enrich(scan.scan_rules(files)).collect()}
    assert rows["SEC001"]["severity"] == "critical" and rows["SEC001"]["category"] == "security"
    assert rows["STYLE004"]["fix_description"].startswith("Replace with")


OWN = [r"\W", r"\S+", r"\d", r"\\s", r"[^\W\d]+", r"[\S]x", r"(?P<a_b>\w)(?P=a_b)", r"^", r"^$", r"$", r"a{,2}b",
       r"x{y}", r"[]a[&]", r"\Bb\B", r"a\Z", r"[\]\-\s]", r"\D\D", r"(?<!\w)e(?=\s)", r"[^\s]{3}", "\\x61|\\u00e9"]


def test_own_patterns_equal_python(make_files):
    words = ["a", "b", "aab", "x{y}", "é", "\u0663", "7", "\\s", "\\", " ", "\n", "\t", "\u00a0", "[", "]", "&", "-",
             "_", "e ", "bbb", "\x1c", "\U0001d400", "中"]
    dice = random.Random(17)
    texts = {i: "".join(dice.choice(words) for _ in range(dice.randrange(0, 25))) for i in range(300)}
    rules = [PatternRule(f"OWN{i:02}", "info", p, "own") for i, p in enumerate(OWN)]
    files = make_files({i: ("a.txt", t) for i, t in texts.items()})
    found = scanned(files, rules)
    for rule in rules:
        # Java's back-references miss letters beyond U+FFFF.
        sure = {i for i, t in texts.items() if "(?P=" not in rule.pattern or max(t, default="") < "\U00010000"}
        assert [f for f in found if f[1] == rule.rule_id and f[0] in sure] == expected(
            {i: texts[i] for i in sorted(sure)}, [rule]), rule.pattern


@pytest.mark.parametrize("pattern", ["(", r"\N{DIGIT ONE}", "(?s)a", "(?#c)a", "(a)?(?(1)b|c)", r"\07"])
def test_faulty_patterns_are_refused_at_once(pattern):
    with pytest.raises((ValueError, re.error)):
        PatternRule("OWN", "info", pattern, "own")


def test_faulty_rules_are_refused_at_once():
    with pytest.raises(ValueError, match="blocker"):
        PatternRule("OWN", "blocker", "a", "own")
    for pattern, needles in (("ab?c", ("ab",)), ("(?:foo|bar)x", ("foo",)), ("(foo)?x", ("foo",)), ("[foo]", ("foo",))):
        with pytest.raises(ValueError, match="need not hold"):
            PatternRule("OWN", "info", pattern, "own", needles=needles)
    PatternRule("OWN", "info", r"(?:foo\s|bar+)x", "own", needles=("foo", "bar"))


def test_needles_that_patterns_show(make_files):
    """A rule without needles has those every match must hold, so texts without them are spared its pattern."""
    assert [r.must_hold for r in map(lambda p: PatternRule("X", "info", p, "x"), (
        r"(\w+)ing\b", r"\D{3}\\s|\S+é\S*", "colou?r", "(ab|cd)ef+", r"a|bc", "(foo)?b", "é*", "[abc]d*", r"\bµß", "(?!ab)c"))] == [
        ("ing",), ("\\s", "é"), ("colo",), ("ef",), (), (), (), (), (), ()]
    bare = [PatternRule(f"B{i}", "info", p, "x") for i, p in enumerate((r"Éa|xK", "å+b", r"\bıs\b|ſi", r"k\b", r"\bi", r"a\bb?", r"(x)\1\b"))]
    dice = random.Random(3)
    texts = {i: "".join(dice.choice(["é", "É", "a", "A", "\u212b", "Å", "b", "K", "\u212a", "x", "ſ", "s", "i", "İ", "ı", " ", "\u0345"])
                        for _ in range(dice.randrange(12))) for i in range(300)}
    assert scanned(make_files({i: ("a.txt", t) for i, t in texts.items()}), bare) == expected(texts, bare)


def test_null_text_has_null_counts_without_needles(make_files):
    given, shown = (PatternRule("N1", "info", "eval", "x", needles=n) for n in (("eval",), ()))
    text = scan.scan_input(make_files({1: ("a.txt", None), 2: ("a.txt", "no"), 3: ("a.txt", "eval")}))
    found = text.select("file_id", *[scan.rule_match_counts([r])["N1"] for r in (given, shown)],
                        F.size(scan.pattern_matches([given])), scan.pattern_matches([shown]).isNull())
    assert sorted(map(tuple, found.collect())) == [(1, 0, None, 0, True), (2, 0, 0, 0, False), (3, 1, 1, 1, False)]
