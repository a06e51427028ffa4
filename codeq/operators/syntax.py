"""Syntax facts of Python files, and the rules over them.

One small Arrow function lists the facts of a file (functions, classes, branches) as an array in
the file's row. Everything after that - every rule, both complexities - is a column expression over
that array, so a file's syntax findings need no shuffle and the parser runs once per file.
"""

from __future__ import annotations

import ast
import sys
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from codeq.functions.metrics import language
from codeq.functions.naming import pascal_sql, snake_sql
from codeq.functions.sqltext import fill, literal, struct
from codeq.functions.text import split_lines

FACT_TYPE = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("lineno", T.IntegerType()),
    T.StructField("end_lineno", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("n_args", T.IntegerType()),
    T.StructField("n_mutable_defaults", T.IntegerType()),
    T.StructField("n_bool_values", T.IntegerType()),
    T.StructField("has_docstring", T.BooleanType()),
]))
_ARROW_FACT = to_arrow_type(FACT_TYPE)

# Workers get the parser helper with the job, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KIND = {
    ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class",
    ast.If: "if", ast.For: "for", ast.While: "while", ast.ExceptHandler: "except",
    ast.BoolOp: "boolop",
}
NESTING_KINDS = ("if", "for", "while")
BRANCH_KINDS = ("if", "for", "while", "except")

# Thresholds, names and texts of the syntax rules.
MAX_LINE = 120
LONG_LINE_SNIPPET = 80
SNAKE_NAME = r"\A[a-z_][a-z0-9_]*\z"
PASCAL_NAME = r"\A[A-Z][a-zA-Z0-9]*\z"
TEXTS = {
    "function_name": (
        "Function name not snake_case",
        "Function '{name}' should be snake_case (e.g., '{better}').",
        "Rename to '{better}'"),
    "function_docstring": (
        "Missing docstring",
        "Function '{name}' has no docstring. Add one to explain purpose, args, and return value.",
        'Add a docstring:\n    def {name}(...):\n        """Brief description.\n\n        Args:\n'
        '            param: Description.\n\n        Returns:\n            Description.\n        """'),
    "mutable_default": (
        "Mutable default argument",
        "Function '{name}' uses a mutable default argument (list/dict/set). "
        "This is shared across all calls — use None as default instead.",
        "Use None as default:\n  def func(items=None):\n      if items is None:\n"
        "          items = []\n      ..."),
    "function_long": (
        "Function too long",
        "Function '{name}' is {n} lines long. "
        "Functions over 50 lines are hard to test and maintain. Extract sub-functions.", None),
    "function_longish": (
        "Function somewhat long",
        "Function '{name}' is {n} lines. Consider breaking it down.", None),
    "many_arguments": (
        "Too many function arguments",
        "Function '{name}' has {n} parameters. "
        "More than 7 parameters makes the function hard to use. Use a config dataclass.",
        "Group parameters into a dataclass:\n  @dataclass\n  class Config:\n      field1: str\n"
        "      field2: int\n      ...\n  \n  def func(config: Config): ..."),
    "class_name": (
        "Class name not PascalCase",
        "Class '{name}' should use PascalCase (e.g., '{better}').",
        "Rename to '{better}'"),
    "class_docstring": (
        "Missing class docstring",
        "Class '{name}' has no docstring.",
        'Add:\n    class {name}:\n        """Brief description of this class."""'),
    "long_line": (
        "Line too long",
        "Line {line} is {n} characters (max 120). "
        "Long lines reduce readability. Break it up.", None),
    "cyclomatic_critical": (
        "Very high cyclomatic complexity",
        "Cyclomatic complexity is {n} (threshold: 20). "
        "This code is extremely hard to test. Break into smaller functions.", None),
    "cyclomatic_error": (
        "High cyclomatic complexity",
        "Cyclomatic complexity is {n} (threshold: 10). Refactor to reduce branches.", None),
    "cyclomatic_warning": (
        "Moderate cyclomatic complexity",
        "Cyclomatic complexity is {n}. Consider simplifying.", None),
    "cognitive": (
        "High cognitive complexity",
        "Cognitive complexity is {n}. "
        "Code with high cognitive complexity is hard to read and reason about.", None),
    "syntax_error": (
        "Syntax Error",
        "Python syntax error: {name}. Code cannot be parsed or executed.", None),
}

FINDING_FIELDS = {
    "rule_id": "string", "category": "string", "severity": "string", "title": "string",
    "message": "string", "line_start": "int", "line_end": "int", "code_snippet": "string",
    "is_fixable": "boolean", "fix_description": "string",
}
FINDING_TYPE = "struct<" + ",".join(f"{k}:{v}" for k, v in FINDING_FIELDS.items()) + ">"


def _fact(node: ast.AST, depth: int) -> dict:
    kind = KIND[type(node)]
    fact = {"kind": kind, "lineno": node.lineno, "end_lineno": node.end_lineno, "depth": depth}
    if kind in ("function", "class"):
        fact["name"] = node.name
        fact["has_docstring"] = ast.get_docstring(node, clean=False) is not None
    if kind == "function":
        a = node.args
        fact["n_args"] = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs)
        fact["n_mutable_defaults"] = sum(
            isinstance(d, (ast.List, ast.Dict, ast.Set)) for d in a.defaults + a.kw_defaults)
    if kind == "boolop":
        fact["n_bool_values"] = len(node.values)
    return fact


def file_facts(source: str) -> list[dict]:
    """Facts of one Python file in source order; ``depth`` counts the branches around a node.

    Never raises: a file the parser gives up on is a fact too.
    """
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        return [{"kind": "syntax_error", "name": str(e), "lineno": e.lineno}]
    except (RecursionError, MemoryError, ValueError) as e:
        return [{"kind": "analysis_error", "name": str(e)}]
    facts, stack = [], [(tree, 0)]
    while stack:
        node, depth = stack.pop()
        if type(node) in KIND:
            facts.append(_fact(node, depth))
            depth += facts[-1]["kind"] in NESTING_KINDS
        stack += [(child, depth) for child in reversed(list(ast.iter_child_nodes(node)))]
    return facts


@arrow_udf(FACT_TYPE)
def _facts_udf(sources: pa.Array) -> pa.Array:
    return pa.array([None if s is None else file_facts(s) for s in sources.to_pylist()],
                    _ARROW_FACT)


def with_facts(files: DataFrame) -> DataFrame:
    """Files with ``language`` and ``facts``; facts are null for other languages than Python."""
    named = files.withColumn("language", language(F.col("filename")))
    return named.withColumn(
        "facts", _facts_udf(F.when(F.col("language") == "python", F.col("content"))))


def facts_table(files: DataFrame) -> DataFrame:
    """One row per fact, numbered from 0 in source order."""
    return with_facts(files).select(
        "file_id", F.posexplode("facts").alias("node_id", "f")).select("file_id", "node_id", "f.*")


def _sql_in(kinds: tuple[str, ...]) -> str:
    return ", ".join(literal(k) for k in kinds)


FAILED_SQL = "exists(facts, f -> f.kind in ('syntax_error', 'analysis_error'))"
PARSED_SQL = f"(facts is not null and not {FAILED_SQL})"
CYCLOMATIC_SQL = (
    f"if({FAILED_SQL}, 0L, aggregate(facts, 1L, (total, f) -> total"
    f" + if(f.kind in ({_sql_in(BRANCH_KINDS)}), 1, 0)"
    " + if(f.kind = 'boolop', f.n_bool_values - 1, 0)))"
)
COGNITIVE_SQL = (
    "aggregate(facts, 0L, (total, f) -> total"
    f" + if(f.kind in ({_sql_in(NESTING_KINDS)}), 1 + f.depth, if(f.kind = 'except', 1, 0)))"
)


def parsed() -> Column:
    """Whether the file is Python and parses."""
    return F.expr(PARSED_SQL)


def cyclomatic() -> Column:
    """1 + branches + operands of and/or beyond the first; 0 if the file does not parse."""
    return F.expr(CYCLOMATIC_SQL)


def cognitive() -> Column:
    """Each if, for and while costs 1 + the branches around it; each except costs 1."""
    return F.expr(COGNITIVE_SQL)


def _finding(rule_id: str, category: str, severity: str, text: str, line_start: str = "null",
             line_end: str = "null", code_snippet: str = "null", **values: str) -> str:
    title, message, fix = TEXTS[text]
    texts = {
        "rule_id": literal(rule_id), "category": literal(category), "severity": literal(severity),
        "title": literal(title), "message": fill(message, **values), "line_start": line_start,
        "line_end": line_end, "code_snippet": code_snippet, "is_fixable": literal(fix is not None),
        "fix_description": "null" if fix is None else fill(fix, **values),
    }
    return struct(**{name: f"cast({texts[name]} as {kind})"
                     for name, kind in FINDING_FIELDS.items()})


@dataclass(frozen=True)
class StructureRule:
    """One finding per fact of a kind for which ``where`` holds, or ``times`` findings."""

    rule_id: str
    category: str
    severity: str
    kind: str
    where: str
    text: str
    line_end: str = "null"
    code_snippet: str = "null"
    n: str = "f.lineno"
    times: str | None = None

    def sql(self) -> str:
        better = pascal_sql("f.name") if self.kind == "class" else snake_sql("f.name")
        finding = _finding(self.rule_id, self.category, self.severity, self.text, "f.lineno",
                           self.line_end, self.code_snippet, name="f.name", better=better, n=self.n)
        facts = f"filter(facts, f -> f.kind = {literal(self.kind)} and {self.where})"
        if self.times is None:
            return f"transform({facts}, f -> {finding})"
        return f"flatten(transform({facts}, f -> array_repeat({finding}, {self.times})))"


_PUBLIC = "not startswith(f.name, '_')"
_LENGTH = "(f.end_lineno - f.lineno)"
STRUCTURE_RULES = (
    StructureRule("SYNTAX001", "bug", "critical", "syntax_error", "true", "syntax_error"),
    StructureRule("AST001", "style", "warning", "function",
                  f"not f.name rlike {literal(SNAKE_NAME)} and {_PUBLIC}", "function_name",
                  code_snippet=fill("def {name}(...)", name="f.name")),
    StructureRule("AST002", "documentation", "info", "function",
                  f"not f.has_docstring and {_PUBLIC}", "function_docstring"),
    StructureRule("AST003", "bug", "error", "function", "f.n_mutable_defaults > 0",
                  "mutable_default", times="f.n_mutable_defaults"),
    StructureRule("AST004", "maintainability", "warning", "function", f"{_LENGTH} > 50",
                  "function_long", line_end="f.end_lineno", n=_LENGTH),
    StructureRule("AST004", "maintainability", "info", "function", f"{_LENGTH} between 31 and 50",
                  "function_longish", n=_LENGTH),
    StructureRule("AST005", "maintainability", "warning", "function", "f.n_args > 7",
                  "many_arguments", n="f.n_args"),
    StructureRule("AST006", "style", "warning", "class",
                  f"not f.name rlike {literal(PASCAL_NAME)}", "class_name"),
    StructureRule("AST007", "documentation", "info", "class", "not f.has_docstring",
                  "class_docstring"),
)
_NONE = f"cast(array() as array<{FINDING_TYPE}>)"
_STRUCTURE_SQL = f"concat({', '.join(rule.sql() for rule in STRUCTURE_RULES)})"


def _complexity_sql() -> str:
    def one(rule_id: str, severity: str, text: str, n: str) -> str:
        return f"array({_finding(rule_id, 'complexity', severity, text, n=n)})"

    cc, cog = CYCLOMATIC_SQL, COGNITIVE_SQL
    return (
        f"concat(case when {cc} > 20 then {one('COMP001', 'critical', 'cyclomatic_critical', cc)}"
        f" when {cc} > 10 then {one('COMP001', 'error', 'cyclomatic_error', cc)}"
        f" when {cc} > 7 then {one('COMP001', 'warning', 'cyclomatic_warning', cc)}"
        f" else {_NONE} end,"
        f" if({cog} > 15, {one('COMP002', 'warning', 'cognitive', cog)}, {_NONE}))"
    )


_LONG_LINES_SQL = (
    "transform(filter(transform(lines, (line, i) -> struct(i + 1 as no, line as line)),"
    f" x -> length(x.line) > {MAX_LINE}), x -> " + _finding(
        "AST010", "style", "info", "long_line", "x.no", line="x.no", n="length(x.line)",
        code_snippet=f"concat(left(x.line, {LONG_LINE_SNIPPET}), '...')") + ")"
)


# The functions below read the columns ``facts`` and ``lines``.

def structure_findings() -> Column:
    """Findings about functions and classes, and the one of a file that does not parse."""
    return F.expr(_STRUCTURE_SQL)


def complexity_findings() -> Column:
    """COMP001 and COMP002 of a file that parses."""
    return F.expr(_complexity_sql())


def long_line_findings() -> Column:
    """AST010: lines of more than 120 characters."""
    return F.expr(_LONG_LINES_SQL)


def syntax_findings() -> Column:
    """All findings of a Python file but those of the pattern rules; empty for other files."""
    return F.expr(
        f"if(facts is null, {_NONE}, concat({_STRUCTURE_SQL},"
        f" if({FAILED_SQL}, {_NONE}, concat({_LONG_LINES_SQL}, {_complexity_sql()}))))")


def explode_findings(files: DataFrame, findings: Column) -> DataFrame:
    """One row per finding that an expression over ``facts`` and ``lines`` lists."""
    rows = with_facts(files).withColumn("lines", split_lines(F.col("content")))
    # The concat keeps Catalyst from taking the array for a plain column, for which it would add a
    # "not empty" filter that computes the whole array a second time.
    return (rows.select("review_id", "file_id", F.explode(F.concat(findings)).alias("f"))
            .select("review_id", "file_id", "f.*"))
