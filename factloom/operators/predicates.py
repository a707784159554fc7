"""The predicate grammar, compiled to Column expressions so filters reach the scan."""

from __future__ import annotations

import re
from collections.abc import Mapping
from re import _parser as grammar

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import glob_regex

LONGEST_PATTERN = 512


def _repeats_nest(parts, inside: bool = False) -> bool:
    """A quantified group holds another repeat, through groups and alternatives."""
    for op, arg in parts:
        kind = str(op)
        if kind.endswith("_REPEAT"):
            if inside or _repeats_nest(arg[2], True):
                return True
        elif kind == "SUBPATTERN" and _repeats_nest(arg[3], inside) or kind == "BRANCH" and any(_repeats_nest(x, inside) for x in arg[1]):
            return True
    return False


def safe_pattern(pattern: str) -> str:
    """The pattern, if it is short, valid and without repeats in repeats, which backtrack."""
    if len(pattern) > LONGEST_PATTERN:
        raise ValueError("pattern too long")
    try:
        parsed = grammar.parse(pattern)
    except re.error as error:
        raise ValueError(f"not a pattern: {error}") from error
    if _repeats_nest(parsed):
        raise ValueError("nested repeats")
    return pattern


def test(column: Column | None, many: bool, op: str, arg: object) -> Column:
    """One operator on a string column, or on any value of an array of strings; missing is false, but for exists: false."""
    if op == "exists":
        there = F.lit(False) if column is None else F.coalesce(F.size(column) > 0, F.lit(False)) if many else column.isNotNull()
        return there if arg else ~there
    among = [str(x) for x in arg] if isinstance(arg, (list, tuple, set, frozenset)) else [str(arg)]
    tests = {
        "equals": lambda c: c == F.lit(str(arg)),
        "in": lambda c: c.isin(among),
        "glob": lambda c: c.rlike(glob_regex(str(arg))),
        "matches": lambda c: c.rlike(safe_pattern(str(arg))),
    }
    if op not in tests:
        raise ValueError(f"unknown operator {op!r}")
    if column is None:
        return F.lit(False)
    return F.coalesce(F.exists(column, tests[op]) if many else tests[op](column), F.lit(False))


def compile_predicate(spec: Mapping, fields: Mapping[str, tuple[Column, bool]]) -> Column:
    """spec: field -> value or {op: argument}; all_of, any_of and none_of hold specs or lists of them; keys are joined by AND."""
    out = F.lit(True)
    for key, value in spec.items():
        if key in ("all_of", "any_of", "none_of"):
            parts = [compile_predicate(p, fields) for p in ([value] if isinstance(value, Mapping) else value)]
            some = F.lit(key == "all_of")
            for part in parts:
                some = some & part if key == "all_of" else some | part
            out = out & (~some if key == "none_of" else some)
        else:
            column, many = fields.get(key, (None, False))
            for op, arg in (value if isinstance(value, Mapping) else {"equals": value}).items():
                out = out & test(column, many, op, arg)
    return out


def values(c: Column, of_json: bool = False) -> Column:
    """A scalar or an array as an array of strings, nulls left out. of_json: the column is JSON text."""
    if not of_json:
        return F.filter(F.array(c.cast("string")), lambda x: x.isNotNull())
    listed = F.from_json(c, "array<string>")
    bare = F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>")
    return F.filter(F.coalesce(F.when(F.ltrim(c).startswith("["), listed).otherwise(bare), F.array().cast("array<string>")), lambda x: x.isNotNull())
