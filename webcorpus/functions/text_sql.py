"""Small helpers for writing Spark SQL expressions as text."""

from __future__ import annotations

from collections.abc import Iterable


def quoted(text: str) -> str:
    """``text`` as a SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    for char in "\n\r\t":
        escaped = escaped.replace(char, {"\n": "\\n", "\r": "\\r", "\t": "\\t"}[char])
    return "'" + escaped.replace("\x00", "\\0") + "'"


def one_of(value: str, choices: Iterable[str]) -> str:
    return f"{value} IN ({', '.join(quoted(choice) for choice in choices)})"


def let(value: str, name: str, use: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``use``.

    Without the binding the optimizer may paste a whole chain of regular expressions into every place that
    mentions it, for instance when it pushes a filter down.
    """
    return f"transform(array({value}), {name} -> {use})[0]"
