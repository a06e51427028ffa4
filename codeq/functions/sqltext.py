"""SQL text for expressions made from many parts.

A rule catalogue as nested function calls takes thousands of round trips to the JVM before the job
even starts; as one text, parsed there, it takes one.
"""

from __future__ import annotations

from collections.abc import Iterable


def literal(value: str | int | float | bool | None) -> str:
    if value is None:
        return "cast(null as string)"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array(values: Iterable) -> str:
    return f"array({', '.join(literal(v) for v in values)})"


def struct(**fields: str) -> str:
    return "struct(" + ", ".join(f"{text} as {name}" for name, text in fields.items()) + ")"


def fill(template: str, **values: str) -> str:
    """The template with each ``{name}`` replaced by the text of an expression."""
    parts, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [literal(head), f"cast({values[name]} as string)"]
    return f"concat({', '.join([*parts, literal(rest)])})"
