"""Imports and what uses them, worked out by hand."""

import pytest

from codeq.operators import bindings

CASES = {
    "plain": ("import os, sys\nos.getcwd()\n", {"sys"}),
    "dotted": ("import a.b.c\nimport d.e as f\na.x\n", {"f"}),
    "from": ("from m import x, y as z\nz\n", {"x"}),
    "star and future": ("from __future__ import annotations\nfrom m import *\n", set()),
    "shadowed by a parameter": ("import os\ndef f(os):\n    return os\n", {"os"}),
    "shadowed by a name": ("import os\ndef f():\n    os = 1\n    return os\n", {"os"}),
    "used below": ("import os\ndef f():\n    def g():\n        return os\n    return g\n", set()),
    "inner import unused": ("import os\ndef f():\n    import os\n    return 1\nos\n", {"os"}),
    "inner import hides": ("import os\ndef f():\n    import os\n    return os\n", {"os"}),
    "class scope": ("import os\nclass A:\n    os = 1\n    def f(self):\n        return os\n", set()),
    "import in a class": ("class A:\n    import os\n    def f(self):\n        return os\n", {"os"}),
    "import used in a class": ("class A:\n    import os\n    x = os\n", set()),
    "global": ("def f():\n    global os\n    import os\ndef g():\n    return os\n", set()),
    "nonlocal": ("def f():\n    import os\n    def g():\n        nonlocal os\n        os = 2\n    return g\n", {"os"}),
    "all": ("import os\nfrom m import x\n__all__ = ['os'] + ['y']\n__all__ += ('x',)\n", set()),
    "all elsewhere": ("import os\ndef f():\n    __all__ = ['os']\n", {"os"}),
    "comprehension": ("import x, y\n[x for x in y]\n", {"x"}),
    "comprehension's first": ("import x\n[x for x in x]\n", set()),
    "default and decorator": ("import a, b\n@a\ndef f(x=b):\n    pass\n", set()),
    "annotations": ("from t import A, B, C, D\nx: 'A' = 1\ndef f(a: B) -> 'C | None': ...\n", {"D"}),
    "not an annotation": ("import os\nx = 'os'\n", {"os"}),
    "except": ("import e\ntry:\n    pass\nexcept E as e:\n    e\n", set()),
    "walrus": ("import n\ndef f(v):\n    return [n for _ in v if (n := 1)]\n", {"n"}),
    "augmented": ("import n\nn += 1\n", set()),
    "deleted": ("import n\ndel n\n", set()),
    "lambda": ("import n, m\nf = lambda n=m: n\n", {"n"}),
    "match": ("import a, b, c\nmatch a:\n    case [b, *c]:\n        pass\n", {"b", "c"}),
    "broken": ("import os\ndef (:\n", set()),
    "twice": ("try:\n    import json\nexcept E:\n    json = None\njson\n", set()),
    "deep": ("import os\nx = " + "(" * 5 + "os" + ")" * 5 + "\n", set()),
}


@pytest.fixture(scope="module")
def facts(spark, make_files):
    files = {i: ("f.py", code) for i, (code, _) in enumerate(CASES.values())}
    files[len(files)] = ("f.js", "import os\n")
    files[len(files)] = ("empty.py", "")
    return bindings.name_facts(make_files(files).repartition(3))


def test_unused(facts):
    got = {}
    for r in bindings.unused_imports(facts).collect():
        got.setdefault(list(CASES)[r["file_id"]], set()).add(r["name"])
    assert got == {name: unused for name, (_, unused) in CASES.items() if unused}


def test_uses_are_counted_in_their_scope(spark, make_files):
    code = "import os\ndef f():\n    import os\n    os; os\nos; os; os\n"
    rows = bindings.import_uses(bindings.name_facts(make_files({1: ("a.py", code)}))).collect()
    assert sorted((r["line_start"], r["n_uses"]) for r in rows) == [(1, 3), (3, 2)]


def test_only_imported_names_leave_the_file():
    facts = bindings.imported_names("import os\n" + "x = 1\ny = x\n" * 50 + "os\n")
    assert [(f["kind"], f["name"]) for f in facts] == [("import", "os"), ("use", "os")]
    assert bindings.imported_names("x = 1\n" * 100) == []


def test_scopes_nest():
    facts = bindings.imported_names("import a\ndef f():\n    a\n    class B:\n        a\n[a for b in a]\n")
    spans = sorted({(f["opened"], f["closed"]) for f in facts})
    assert all(x[1] > y[1] or x[1] < y[0] for x in spans for y in spans if x < y)
