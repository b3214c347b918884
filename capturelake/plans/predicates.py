"""Conditions {field, op, value, negate, case_insensitive} as Columns with two-valued results."""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPARE = {">": "__gt__", "<": "__lt__", "=": "__eq__", "!=": "__ne__", ">=": "__ge__", "<=": "__le__"}
#: Names that graph fields are also known by.
ALIASES = {"total_bytes": "bytes", "packet_count": "packets", "bytes": "total_bytes", "packets": "packet_count"}


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: Any = None
    negate: bool = False
    #: None: equality, prefix, suffix and regular expressions ignore case, LIKE doesn't.
    case_insensitive: bool | None = None


def _type(schema: T.StructType, path: str) -> T.DataType | None:
    kind: T.DataType = schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


def like_pattern(pattern: str) -> str:
    """A LIKE pattern as a whole-text regular expression; % and _ match no line break, a backslash takes the next character as it is."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            out.append(re.escape(pattern[at]))
        else:
            out.append({"%": ".*", "_": "."}.get(c, re.escape(c)))
        at += 1
    return rf"\A(?:{''.join(out)})\z"


def leaf(schema: T.StructType, c: Condition) -> Column:
    """The condition before ``negate``: true or false, never null."""
    field = c.field if _type(schema, c.field) is not None or c.field not in ALIASES else ALIASES[c.field]
    kind = _type(schema, field)
    column = F.col(field) if kind is not None else F.lit(None).cast("string")
    array = isinstance(kind, T.ArrayType)
    return F.coalesce(_test(column, kind, array, c), F.lit(False))


def _test(column: Column, kind: T.DataType | None, array: bool, c: Condition) -> Column:
    no = F.lit(False)
    if c.op in COMPARE:
        try:
            value = float(c.value)
        except (TypeError, ValueError):
            return no
        if array or isinstance(kind, (T.StructType, T.MapType)):
            return no
        number = F.when(column.isNull(), F.lit(0.0)).otherwise(column.cast("string").try_cast("double"))
        return getattr(number, COMPARE[c.op])(F.lit(value))
    if c.op in ("count_gt", "count_lt", "count_eq"):
        size = F.size(column) if array else F.length(column.cast("string"))
        size = F.when(column.isNull(), 0).otherwise(size)
        try:
            value = float(c.value)
        except (TypeError, ValueError):
            return no
        return getattr(size, {"count_gt": "__gt__", "count_lt": "__lt__", "count_eq": "__eq__"}[c.op])(F.lit(value))
    if c.op in ("contains", "contains_all", "contains_any"):
        wanted = [str(v) for v in (c.value if isinstance(c.value, (list, tuple, set)) else [c.value])]
        targets = F.array(*map(F.lit, wanted)).cast("array<string>")
        have = F.transform(column, lambda x: x.cast("string")) if array else F.array(column.cast("string"))
        if c.op == "contains_any":
            return column.isNotNull() & F.arrays_overlap(have, targets)
        return F.when(column.isNull(), F.lit(not wanted)).otherwise(F.size(F.array_except(targets, have)) == 0)
    if c.op in ("is_empty", "not_empty"):
        empty = column.isNull() | (F.size(column) == 0) if array else column.isNull()
        return empty if c.op == "is_empty" else ~empty
    if c.op in ("is_true", "is_false"):
        if kind is None:
            true = no
        elif array:
            true = F.size(column) > 0
        elif isinstance(kind, T.StringType):
            true = F.length(column) > 0
        elif isinstance(kind, T.BooleanType):
            true = column
        else:
            true = column != 0
        true = F.coalesce(true, no)
        return true if c.op == "is_true" else ~true
    if c.op in ("equals", "starts_with", "ends_with", "matches", "like"):
        return _text_test(column, array, c)
    warnings.warn(f"unknown operator {c.op!r}", stacklevel=2)
    return no


def _text_test(column: Column, array: bool, c: Condition) -> Column:
    fold = c.case_insensitive if c.case_insensitive is not None else c.op != "like"
    value = "" if c.value is None else str(c.value)
    if c.op in ("matches", "like"):
        pattern = value if c.op == "matches" else like_pattern(value)
        try:
            re.compile(pattern.replace(r"\z", r"\Z"))
        except re.error:
            return F.lit(False)
        pattern = f"(?i){pattern}" if fold else pattern
        test = lambda x: x.rlike(pattern)
    else:
        to = value.lower() if fold else value
        low = (lambda x: F.lower(x)) if fold else (lambda x: x)
        test = {"equals": lambda x: low(x) == to, "starts_with": lambda x: low(x).startswith(to), "ends_with": lambda x: low(x).endswith(to)}[c.op]
    if array:
        return F.exists(column, lambda x: F.coalesce(test(x.cast("string")), F.lit(False)))
    return test(column.cast("string"))


def compile_conditions(schema: T.StructType, conditions: list[Condition], logic: str = "AND", empty: bool = False) -> Column:
    """All conditions under one connective; without any, ``empty``. Negation turns each leaf, not the connective."""
    if not conditions:
        return F.lit(empty)
    parts = [~leaf(schema, c) if c.negate else leaf(schema, c) for c in conditions]
    return reduce((lambda x, y: x | y) if logic.upper() == "OR" else (lambda x, y: x & y), parts)


def match(items: DataFrame, conditions: list[Condition], logic: str = "AND", sets: Mapping[str, DataFrame] | None = None, id_column: str = "id", empty: bool = False) -> DataFrame:
    """The rows that match. ``in_set`` tests the row's id against a named set (member), by a join; an unknown set has no members."""
    marked, flags = items, []
    for n, c in enumerate(conditions):
        if c.op == "in_set":
            name = f"_set{n}"
            known = (sets or {}).get(str(c.value).lstrip("@"))
            if known is None:
                flag = F.lit(False)
            else:
                members = known.select(F.col("member").alias(f"_member{n}"), F.lit(True).alias(name)).distinct()
                marked = marked.join(members, F.col(id_column) == F.col(f"_member{n}"), "left")
                flag = F.coalesce(F.col(name), F.lit(False))
        else:
            flag = leaf(items.schema, c)
        flags.append(~flag if c.negate else flag)
    if not flags:
        return items.where(F.lit(empty))
    test = reduce((lambda x, y: x | y) if logic.upper() == "OR" else (lambda x, y: x & y), flags)
    return marked.where(test).select(*items.columns)


def field_catalog(df: DataFrame) -> list[tuple[str, str]]:
    """(dotted field, kind) of a frame's schema; kinds: string, numeric, set, boolean."""

    def walk(schema: T.StructType, lead: str):
        for f in schema.fields:
            kind = f.dataType
            if isinstance(kind, T.StructType):
                yield from walk(kind, f"{lead}{f.name}.")
            else:
                name = "set" if isinstance(kind, T.ArrayType) else "boolean" if isinstance(kind, T.BooleanType) else "numeric" if isinstance(kind, T.NumericType) else "string"
                yield f"{lead}{f.name}", name

    return list(walk(df.schema, ""))
