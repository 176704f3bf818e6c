"""Row predicates of search, feedback reports and project lookup."""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkseek.functions.scalars import instant, utc

CONTAINS, NOT_CONTAINS, EQUALS, NOT_EQUALS = "contains", "not_contains", "equals", "not_equals"

KIND_OPERATORS = (CONTAINS, EQUALS, NOT_EQUALS)
NAMESPACE_OPERATORS = (CONTAINS, NOT_CONTAINS, EQUALS, NOT_EQUALS)
TYPE_NAME_OPERATORS = (CONTAINS, NOT_CONTAINS, EQUALS)
FILTER_OPERATORS = {"kind": KIND_OPERATORS, "namespace": NAMESPACE_OPERATORS, "type_name": TYPE_NAME_OPERATORS}

_ESCAPE_PAIR = re.compile(r"\\(.)", re.DOTALL)


def wildcard(value: str) -> str:
    """A caller's value as a LIKE pattern: ``*`` matches any run of characters.

    ``%`` and ``_`` stay live. A backslash escapes the character after it, as in
    Postgres; Spark only accepts escapes of ``%``, ``_`` and the backslash, so
    one before any other character is dropped. A lone trailing backslash, which
    Postgres rejects, stands for itself.
    """
    pattern = value.replace("*", "%")
    tidy = _ESCAPE_PAIR.sub(lambda m: m[0] if m[1] in "%_\\" else m[1], pattern)
    lone = re.fullmatch(r"(?:[^\\]|\\[%_\\])*\\", tidy, re.DOTALL)
    return tidy + "\\" if lone else tidy


def wildcard_column(value: Column) -> Column:
    """``wildcard`` for a column of values."""
    pattern = F.replace(value, F.lit("*"), F.lit("%"))
    tidy = F.regexp_replace(pattern, r"(?s)(\\[%_\\])|\\(.)", "$1$2")
    lone = tidy.rlike(r"(?s)^(?:[^\\]|\\[%_\\])*\\$")
    return F.when(lone, F.concat(tidy, F.lit("\\"))).otherwise(tidy)


def _column(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def check_operator(operator: str, allowed: tuple[str, ...]) -> None:
    if operator not in allowed:
        raise ValueError(f"unknown operator {operator!r}; expected one of {', '.join(allowed)}")


def _text_filter(operator: str, value: str, column: Column, keep_null: bool) -> Column:
    if operator == CONTAINS:
        return column.ilike(wildcard(value))
    if operator == EQUALS:
        return column == F.lit(value)
    miss = ~column.ilike(wildcard(value)) if operator == NOT_CONTAINS else column != F.lit(value)
    return column.isNull() | miss if keep_null else miss


def in_project(project_id: int, column: str | Column = "project_id") -> Column:
    return _column(column) == F.lit(project_id)


def kind_filter(operator: str, value: str, column: str | Column = "kind") -> Column:
    """``kind`` is never null, so its negative form has no null arm."""
    check_operator(operator, KIND_OPERATORS)
    return _text_filter(operator, value, _column(column), keep_null=False)


def namespace_filter(operator: str, value: str, column: str | Column = "namespace") -> Column:
    """Negative forms keep rows without a namespace."""
    check_operator(operator, NAMESPACE_OPERATORS)
    return _text_filter(operator, value, _column(column), keep_null=True)


def type_name_filter(operator: str, value: str, column: str | Column = "type_name") -> Column:
    """Negative form keeps rows without a type name; there is no ``not_equals``."""
    check_operator(operator, TYPE_NAME_OPERATORS)
    return _text_filter(operator, value, _column(column), keep_null=True)


def all_of(*conditions: Column | None) -> Column:
    """AND of the given conditions; absent ones do not take part."""
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, given) if given else F.lit(True)


def min_similarity(minimum: float | None, similarity: str | Column = "similarity") -> Column | None:
    """Threshold on the unrounded similarity; none given means no condition. NaN passes."""
    return None if minimum is None else _column(similarity) >= F.lit(float(minimum))


def in_window(start: datetime, end: datetime, column: str | Column = "created_at", day: str | Column | None = None) -> Column:
    """Both ends belong to the window. ``day``, the UTC day the rows are stored by, prunes folders."""
    inside = _column(column).between(instant(start), instant(end))
    if day is None:
        return inside
    return _column(day).between(F.lit(utc(start).date()), F.lit(utc(end).date())) & inside


def project_name_contains(part: str | Column, column: str | Column = "name") -> Column:
    """Substring match ignoring case, ``%`` and ``_`` live. ``*`` is an ordinary character here."""
    if isinstance(part, Column):
        quoted = F.replace(part, F.lit("*"), F.lit("\u0000"))
        middle = F.replace(wildcard_column(quoted), F.lit("\u0000"), F.lit("*"))
        return F.ilike(_column(column), F.concat(F.lit("%"), middle, F.lit("%")))
    middle = wildcard(part.replace("*", "\u0000")).replace("\u0000", "*")
    return _column(column).ilike(f"%{middle}%")


def project_name_is(name: str, excluding: int | None = None) -> Column:
    """Exact, case-sensitive; optionally ignoring the project with one id."""
    other = None if excluding is None else F.col("id") != F.lit(excluding)
    return all_of(F.col("name") == F.lit(name), other)
