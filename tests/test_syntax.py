"""Syntax facts and rules on snippets whose findings were worked out by hand."""

from pyspark.sql import functions as F

from codeq.operators import syntax
from codeq.plans.sql import COMPLEXITY, SYNTAX_FINDINGS
from codeq.sources.snippets import SNIPPETS


def found(files, expression=None):
    expression = syntax.syntax_findings() if expression is None else expression
    return syntax.explode_findings(files, expression)


def test_snippets(make_files):
    files = make_files({i: (f"f.{ext}", code) for i, (ext, code) in enumerate(SNIPPETS)})
    got = sorted((r["file_id"], r["rule_id"], r["severity"],
                  None if r["rule_id"] == "SYNTAX001" else r["line_start"])
                 for r in found(files).collect())
    assert got == sorted(SYNTAX_FINDINGS)


def test_complexities(make_files):
    files = make_files({i: ("f.py", code) for i, (ext, code) in enumerate(SNIPPETS) if ext == "py"})
    got = syntax.with_facts(files).select(
        "file_id", syntax.cyclomatic(), syntax.cognitive()).collect()
    assert sorted(tuple(r) for r in got) == sorted(COMPLEXITY)


def test_only_python_has_facts(make_files):
    files = make_files({1: ("a.js", "if x:\n  pass"), 2: ("a.py", "")})
    rows = {r["file_id"]: r["facts"] for r in syntax.with_facts(files).collect()}
    assert rows == {1: None, 2: []}


def test_nesting_is_not_reset_by_functions(make_files):
    code = ("for a in b:\n    def f():\n        while x and y or z:\n            try:\n"
            "                pass\n            except E:\n                if q: pass\n")
    row = syntax.with_facts(make_files({1: ("a.py", code)})).select(
        syntax.cyclomatic(), syntax.cognitive()).first()
    # for, while, except, if and two operands more than one each; 1 + 2 + 1 + 3.
    assert tuple(row) == (7, 7)


def test_messages(make_files):
    code = "def getItem(a, b, c, d, e, f, *, g, h={}):\n    pass\nclass my_box:\n    '''Doc.'''\n"
    rows = {r["rule_id"]: r for r in found(make_files({1: ("a.py", code)})).collect()}
    assert rows["AST001"]["message"] == "Function 'getItem' should be snake_case (e.g., 'get_item')."
    assert rows["AST001"]["code_snippet"] == "def getItem(...)"
    assert rows["AST005"]["message"].startswith("Function 'getItem' has 8 parameters.")
    assert rows["AST006"]["fix_description"] == "Rename to 'MyBox'"
    assert "AST007" not in rows and rows["AST003"]["is_fixable"]


def test_long_functions_keep_their_end(make_files):
    code = "def f():\n    '''Doc.'''\n" + "    x = 1\n" * 60
    row = found(make_files({1: ("a.py", code)})).filter("rule_id = 'AST004'").first()
    assert (row["severity"], row["line_start"], row["line_end"]) == ("warning", 1, 62)
    assert row["message"].startswith("Function 'f' is 61 lines long.")


def test_parser_never_raises():
    assert syntax.file_facts("a\x00b")[0]["kind"] in ("syntax_error", "analysis_error")
    assert syntax.file_facts("-" * 200000 + "1")[0]["kind"] in ("syntax_error", "analysis_error")
    chain = "if a:\n    pass\n" + "elif a:\n    pass\n" * 90
    assert max(f["depth"] for f in syntax.file_facts(chain)) == 90


def test_broken_file_has_no_line_findings(make_files):
    files = make_files({1: ("a.py", "def broken(\n# " + "x" * 300)})
    assert [r["rule_id"] for r in found(files).collect()] == ["SYNTAX001"]


def test_facts_table(make_files):
    rows = syntax.facts_table(make_files({5: ("a.py", "def f(x=[]):\n  if x and y: pass\n")}))
    kinds = [r["kind"] for r in rows.orderBy("node_id").collect()]
    assert kinds == ["function", "if", "boolop"]
    assert rows.filter(F.col("kind") == "function").first()["n_mutable_defaults"] == 1
