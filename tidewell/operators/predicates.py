"""Predicates as Catalyst columns: keyword suffixes, triples, the metadata filter language, visibility."""

from __future__ import annotations

import operator
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffixes and operator signs.
COMPARE = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}
SIGNS = {"=": "eq", "==": "eq", "!=": "ne", "<>": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}
MAX_DEPTH, MAX_TERMS = 8, 32


def two_valued(c: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(c, F.lit(False))


def compare(column: Column, op: str, value: Any) -> Column:
    """``op`` is a suffix, a sign, is_null, is_not_null, between, in or like.  A null operand never matches."""
    op = SIGNS.get(op, op)
    if op in COMPARE:
        return COMPARE[op](column, value)
    if op == "is_null":
        return column.isNull()
    if op == "is_not_null":
        return column.isNotNull()
    if op == "between":
        return column.between(*value)
    if op == "in":
        return column.isin(*value)
    if op == "like":
        return column.like(str(value).replace("\\", "\\\\"))
    raise ValueError(f"unknown operator {op}")


def keywords(df: DataFrame, **tests: Any) -> list[Column]:
    """``age_gt=30`` and the like; a name without suffix means equality.  Unknown columns are an error."""
    found = []
    for key, value in tests.items():
        name, _, op = key.rpartition("_")
        if key in df.columns or op not in COMPARE:
            name, op = key, "eq"
        if name not in df.columns:
            raise ValueError(f"unknown column {name}")
        found.append(compare(F.col(f"`{name}`"), op, value))
    return found


def all_of(tests: list[Column]) -> Column:
    return reduce(operator.and_, tests, F.lit(True))


def any_of(tests: list[Column]) -> Column:
    return reduce(operator.or_, tests, F.lit(False))


def metadata_filter(spec: dict | None, column: str | None = "metadata", depth: int = 0) -> Column:
    """The JSON filter language over a struct column (``column`` None: top level): and, or, not, {field, op, value}.

    A missing or null field never matches; ``not`` is boolean negation.  At most 8 levels and 32 terms of a list.
    """
    if not spec:
        return F.lit(True)
    if not isinstance(spec, dict) or depth > MAX_DEPTH:
        raise ValueError("invalid metadata filter")
    for key, combine in (("and", all_of), ("or", any_of)):
        if key in spec:
            if not isinstance(spec[key], list) or len(spec[key]) > MAX_TERMS:
                raise ValueError(f"invalid {key} filter")
            return combine([metadata_filter(s, column, depth + 1) for s in spec[key]])
    if "not" in spec:
        return ~metadata_filter(spec["not"], column, depth + 1)
    field, op, value = spec.get("field", ""), spec.get("op", "eq"), spec.get("value")
    if not field or len(field) > 256:
        raise ValueError("invalid metadata filter field")
    actual = F.col(f"{column}.{field}" if column else field)
    if op in ("eq", "ne"):
        return two_valued(compare(actual, op, value))
    if op == "in":
        return two_valued(actual.isin(*value)) if isinstance(value, list) else F.lit(False)
    if op == "contains":
        return two_valued(F.contains(actual, F.lit(value)))
    if op == "contains_element":
        return two_valued(F.array_contains(actual, value))
    if op in ("gt", "gte", "lt", "lte"):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return F.lit(False)
        return two_valued(compare(actual, {"gte": "ge", "lte": "le"}.get(op, op), value))
    raise ValueError("unsupported metadata filter operation")


def visible(df: DataFrame, tenant: str, scopes: list[str], tenant_column: str = "tenant", scope_column: str = "scope", scopes_column: str | None = None) -> DataFrame:
    """Rows of a tenant that are public, in one of ``scopes``, or share an element of ``scopes_column`` with them."""
    ok = (F.col(scope_column) == "public") | F.col(scope_column).isin(*scopes)
    if scopes_column:
        ok = ok | F.arrays_overlap(F.col(scopes_column), F.array(*map(F.lit, scopes)).cast("array<string>"))
    return df.where((F.col(tenant_column) == tenant) & two_valued(ok))
