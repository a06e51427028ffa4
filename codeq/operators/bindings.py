"""Imported names of Python files and where they are used.

A small Arrow function lists, per file, the scopes in which names that the file imports are bound or used,
each scope as an interval of the order in which the file is read: one scope lies inside another just when
its interval does. Which binding a use means is then a join of uses and bindings by name and containment, the
innermost first, and an import is unused if no use means its name in its scope.
"""

from __future__ import annotations

import ast
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from codeq.functions.metrics import language

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME_TYPE = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()),  # import, binding or use
    T.StructField("name", T.StringType()),
    T.StructField("lineno", T.IntegerType()),
    T.StructField("opened", T.IntegerType()),
    T.StructField("closed", T.IntegerType()),
    T.StructField("of_class", T.BooleanType()),
]))
_ARROW_NAME = to_arrow_type(NAME_TYPE)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


class _Scope:
    def __init__(self, kind: str, opened: int, parent: _Scope | None):
        self.kind, self.opened, self.parent, self.closed = kind, opened, parent, 0
        self.elsewhere: dict[str, _Scope] = {}  # names declared global or nonlocal

    def of(self, name: str) -> _Scope:
        return self.elsewhere.get(name, self)


class _Names:
    """Reads a tree in the order in which its scopes open and close."""

    def __init__(self, tree: ast.Module):
        self.clock, self.found, self.scopes = 0, [], []
        self.module = self.scope = self._open("module", None)
        self._all(tree.body)
        self._close()

    def _open(self, kind: str, parent: _Scope | None) -> _Scope:
        self.clock += 1
        self.scope = _Scope(kind, self.clock, parent)
        return self.scope

    def _close(self) -> None:
        self.clock += 1
        self.scope.closed = self.clock
        self.scope = self.scope.parent

    def _put(self, kind: str, name: str, line: int, scope: _Scope | None = None) -> None:
        self.found.append((kind, name, line, (scope or self.scope).of(name)))

    def _all(self, nodes) -> None:
        for node in nodes:
            if node is not None:
                self._read(node)

    def _quoted(self, annotation) -> None:
        """An annotation, also one that is quoted."""
        for node in ast.walk(annotation) if annotation is not None else ():
            if isinstance(node, ast.Constant) and isinstance(node.value, str):
                try:
                    self._read(ast.parse(node.value.strip(), mode="eval").body)
                except (SyntaxError, ValueError):
                    pass  # text, not a name
        self._all([annotation])

    def _function(self, node) -> None:
        a = node.args
        every = [*a.posonlyargs, *a.args, *a.kwonlyargs, *([a.vararg] if a.vararg else []), *([a.kwarg] if a.kwarg else [])]
        self._all([*getattr(node, "decorator_list", []), *a.defaults, *a.kw_defaults])
        for arg in every:
            self._quoted(arg.annotation)
        if not isinstance(node, ast.Lambda):
            self._quoted(node.returns)
            self._put("binding", node.name, node.lineno)
        self._open("function", self.scope)
        for arg in every:
            self._put("binding", arg.arg, arg.lineno)
        self._all(node.body if isinstance(node.body, list) else [node.body])
        self._close()

    def _read(self, node: ast.AST) -> None:
        line = getattr(node, "lineno", 0)
        if isinstance(node, FUNCTIONS):
            self._function(node)
        elif isinstance(node, ast.ClassDef):
            self._all([*node.decorator_list, *node.bases, *node.keywords])
            self._put("binding", node.name, line)
            self._open("class", self.scope)
            self._all(node.body)
            self._close()
        elif isinstance(node, COMPREHENSIONS):
            first, *rest = node.generators
            self._read(first.iter)  # belongs to the scope around it
            self._open("comprehension", self.scope)
            self._all([first.target, *first.ifs, *rest])
            self._all([node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt])
            self._close()
        elif isinstance(node, (ast.Global, ast.Nonlocal)):
            outer = self.scope.parent
            while outer is not None and outer.kind == "class":
                outer = outer.parent
            for name in node.names:
                self.scope.elsewhere[name] = self.module if isinstance(node, ast.Global) or outer is None else outer.of(name)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            future = isinstance(node, ast.ImportFrom) and node.module == "__future__"
            for alias in node.names:
                if alias.name != "*" and not future:
                    name = alias.asname or alias.name
                    self._put("import", name if alias.asname or isinstance(node, ast.ImportFrom)
                              else name.split(".")[0], line)
        elif isinstance(node, ast.Name):
            if isinstance(node.ctx, ast.Store):
                scope = self.scope
                self._put("binding", node.id, line, scope)
            else:
                self._put("use", node.id, line)
        elif isinstance(node, ast.NamedExpr):
            self._read(node.value)
            scope = self.scope
            while scope.kind == "comprehension":
                scope = scope.parent
            self._put("binding", node.target.id, line, scope)
        else:
            self._other(node, line)

    def _other(self, node: ast.AST, line: int) -> None:
        if isinstance(node, ast.AugAssign) and isinstance(node.target, ast.Name):
            self._put("use", node.target.id, line)
        if isinstance(node, (ast.Assign, ast.AugAssign, ast.AnnAssign)) and self.scope is self.module:
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            if any(isinstance(x, ast.Name) and x.id == "__all__" for x in targets) and node.value is not None:
                for x in ast.walk(node.value):
                    if isinstance(x, ast.Constant) and isinstance(x.value, str):
                        self._put("use", x.value, line)
        if isinstance(node, ast.AnnAssign):
            self._quoted(node.annotation)
            self._all([node.value, node.target])
            return
        if isinstance(node, (ast.ExceptHandler, ast.MatchAs, ast.MatchStar)) and node.name:
            self._put("binding", node.name, line)
        if isinstance(node, ast.MatchMapping) and node.rest:
            self._put("binding", node.rest, line)
        self._all(ast.iter_child_nodes(node))


def imported_names(source: str) -> list[dict]:
    """Imports, other bindings and uses of the names that a file imports anywhere; none if it doesn't parse."""
    try:
        found = _Names(ast.parse(source)).found
    except (SyntaxError, RecursionError, MemoryError, ValueError):
        return []
    imported = {name for kind, name, _, _ in found if kind == "import"}
    return [{"kind": kind, "name": name, "lineno": line, "opened": scope.opened, "closed": scope.closed,
             "of_class": scope.kind == "class"} for kind, name, line, scope in found if name in imported]


@arrow_udf(NAME_TYPE)
def _names_udf(sources: pa.Array) -> pa.Array:
    return pa.array([None if s is None else imported_names(s) for s in sources.to_pylist()], _ARROW_NAME)


def name_facts(files: DataFrame) -> DataFrame:
    """One row per fact about an imported name of a Python file: its kind, name, line and scope."""
    python = F.when(language(F.col("filename")) == "python", F.col("content"))
    return files.select("review_id", "file_id", F.explode(_names_udf(python)).alias("f")).select(
        "review_id", "file_id", "f.*")


def import_uses(facts: DataFrame) -> DataFrame:
    """Each import with the number of uses that mean its name in its scope: n_uses.

    A use means the innermost scope around it that binds the name; a class only counts for what stands
    right in it. Where a scope binds a name more than once, all its uses count for each import of it. Uses
    are counted per scope before the join, of which the keys are a file's own names.
    """
    at = ["file_id", "name"]
    uses = facts.filter("kind = 'use'").groupBy(*at, F.col("opened").alias("from"), F.col("closed").alias("to")).agg(
        F.count("*").alias("n"))
    scopes = facts.filter("kind <> 'use'").select(*at, "opened", "closed", "of_class").distinct()
    inside = (F.col("opened") <= F.col("from")) & (F.col("to") <= F.col("closed")) & (
        ~F.col("of_class") | (F.col("opened") == F.col("from")))
    meant = uses.join(scopes, at).filter(inside).groupBy(*at, "from").agg(
        F.max("opened").alias("opened"), F.first("n").alias("n"))
    counted = meant.groupBy(*at, "opened").agg(F.sum("n").alias("n_uses"))
    return facts.filter("kind = 'import'").join(counted, [*at, "opened"], "left").select(
        "review_id", "file_id", "name", F.col("lineno").alias("line_start"),
        F.coalesce("n_uses", F.lit(0)).cast("long").alias("n_uses"))


def unused_imports(facts: DataFrame) -> DataFrame:
    """Imports whose name no use means, nor ``__all__``: review_id, file_id, name, line_start.

    Files that don't parse have none; imports of ``*`` and from ``__future__`` are never reported.
    """
    return import_uses(facts).filter("n_uses = 0").drop("n_uses")
