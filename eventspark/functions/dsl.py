"""Row matchers and column expressions written as plain data.

Matcher: ``{column: value}``, ``{column: {regex: r}}``, ``{column: {present: bool}}``; all entries must hold.
Expression: a column name, a text with ``{column}`` fields, ``{col|str|literal: x}``,
``{extract: {from: e, regex: r, group_index: i}}``, ``{output: e, matcher: m}``, ``{e: {matcher}}``, or a list whose
first non-null member counts.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELD = re.compile(r"\{([^{}]*)\}")
_KINDS = ("col", "str", "literal", "extract")
Compiled = tuple[Column, set[str]]


def check_matcher(m: Any) -> str | None:
    """Why ``m`` is no matcher, or None."""
    if not isinstance(m, dict):
        return f"a matcher must be a dictionary, not {type(m).__name__}"
    for k, v in m.items():
        if not isinstance(k, str):
            return f"matcher columns must be strings, not {k!r}"
        if isinstance(v, dict):
            if len(v) != 1 or next(iter(v)) not in ("regex", "present"):
                return f"the test of '{k}' must have the single key 'regex' or 'present'"
            if "present" in v and not isinstance(v["present"], bool):
                return f"'present' of '{k}' must be true or false"
            if "regex" in v and not isinstance(v["regex"], str):
                return f"'regex' of '{k}' must be a string"
        elif isinstance(v, list):
            return f"the value of '{k}' must not be a list"
    return None


def matcher(m: dict[str, Any]) -> Compiled:
    """The predicate, with three-valued logic, and the columns it needs."""
    if why := check_matcher(m):
        raise ValueError(f"Invalid matcher: {why}")
    tests = []
    for name, v in m.items():
        c = F.col(f"`{name}`")
        if isinstance(v, dict):
            tests.append(c.rlike(v["regex"]) if "regex" in v else (c.isNotNull() if v["present"] else c.isNull()))
        else:
            tests.append(c == F.lit(v))
    return reduce(and_, tests, F.lit(True)), set(m)


def expression(e: Any) -> Compiled:
    """Column and needed columns of an expression; ``ValueError`` if it is none."""
    if isinstance(e, str):
        return _text(e) if _FIELD.search(e) else _column(e)
    if isinstance(e, list):
        if not e:
            raise ValueError("A list of expressions must not be empty")
        parts = [expression(x) for x in e]
        return F.coalesce(*[c for c, _ in parts]), set().union(*[n for _, n in parts])
    if not isinstance(e, dict):
        raise ValueError(f"Not a column expression: {e!r}")
    if set(e) == {"output", "matcher"}:
        return _conditional(e["output"], e["matcher"])
    if len(e) != 1:
        raise ValueError(f"A column expression has one key, not {sorted(map(str, e))}")
    kind, arg = next(iter(e.items()))
    if kind == "col":
        return _column(arg)
    if kind == "str":
        return _text(arg)
    if kind == "literal":
        return (F.array(*[F.lit(x) for x in arg]) if isinstance(arg, list) else F.lit(arg)), set()
    if kind == "extract":
        return _extract(arg)
    if isinstance(arg, dict):
        return _conditional(kind, arg)
    raise ValueError(f"Unknown column expression '{kind}'. Known: {', '.join(_KINDS)}")


def _column(name: Any) -> Compiled:
    if not isinstance(name, str):
        raise ValueError(f"A column name must be a string, not {name!r}")
    return F.col(f"`{name}`"), {name}


def _text(pattern: Any) -> Compiled:
    """Text with fields; null if any field is null."""
    if not isinstance(pattern, str):
        raise ValueError(f"A text expression must be a string, not {pattern!r}")
    need, parts, at = set(), [], 0
    for m in _FIELD.finditer(pattern):
        if m.start() > at:
            parts.append(F.lit(pattern[at : m.start()]))
        parts.append(F.col(f"`{m[1]}`").cast("string"))
        need.add(m[1])
        at = m.end()
    if at < len(pattern) or not parts:
        parts.append(F.lit(pattern[at:]))
    return F.concat(*parts), need


def _extract(arg: Any) -> Compiled:
    """A regex group of an expression; null where the regex doesn't match."""
    if not isinstance(arg, dict) or not {"from", "regex"} <= set(arg) <= {"from", "regex", "group_index"}:
        raise ValueError("'extract' needs 'from' and 'regex', and may have 'group_index'")
    group = arg.get("group_index", 1)
    if not isinstance(arg["regex"], str) or not isinstance(group, int):
        raise ValueError("'regex' must be a string and 'group_index' an integer")
    source, need = expression(arg["from"])
    return F.when(source.rlike(arg["regex"]), F.regexp_extract(source, arg["regex"], group)), need


def _conditional(output: Any, m: Any) -> Compiled:
    test, need = matcher(m)
    value, more = expression(output)
    return F.when(test, value), need | more
