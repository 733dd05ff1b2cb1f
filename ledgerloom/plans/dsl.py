"""The JSON query language: {Namespace, Table, Columns, Filter, Order, Limit, Distinct}, compiled to DataFrame expressions."""

from __future__ import annotations

import base64
import operator
import re
from collections.abc import Callable, Mapping
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.compat import after, ordered

DEFAULT_LIMIT, MOST = 100, 10_000
_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def _get(d: Mapping, key: str, default=None):
    return next((v for k, v in d.items() if k.lower() == key.lower()), default)


def _typed(df: DataFrame, column: str, value):
    """Numeric-looking text compared with a numeric column is a number."""
    kind = df.schema[column].dataType.typeName()
    if isinstance(value, str) and (kind in ("long", "integer", "double", "short", "float") or kind.startswith("decimal")):
        try:
            return Decimal(value)
        except InvalidOperation:
            return value
    return value


def _member(df: DataFrame, column: str, values, negated: bool) -> Column:
    values = [_typed(df, column, v) for v in values]
    if not values:
        return F.lit(negated)
    out = F.col(column).isin(*values)
    return ~out if negated else out


_COMPARE: dict[str, Callable] = {"greaterthan": operator.gt, "greaterthanorequals": operator.ge, "lessthan": operator.lt, "lessthanorequals": operator.le}


def predicate(df: DataFrame, node: Mapping) -> Column | None:
    """A FilterPredicate or a Conjunction, nested as deep as it comes; an empty conjunction is no condition."""
    kind = str(_get(node, "type", "")).lower()
    if kind == "conjunction":
        parts = [p for p in (predicate(df, x) for x in _get(node, "predicates", []) or []) if p is not None]
        if not parts:
            return None
        return reduce(operator.or_ if str(_get(node, "conjunctionType", "And")).lower() == "or" else operator.and_, parts)
    if kind != "filterpredicate":
        raise ValueError(f"unknown filter type {kind!r}")
    column, name, value = _get(node, "column"), str(_get(node, "filterType", "")).lower(), _get(node, "value")
    if column not in df.columns:
        raise ValueError(f"unknown column {column!r}")
    c = F.col(column)
    if name in ("equals", "notequals"):
        if isinstance(value, list):
            return _member(df, column, value, name == "notequals")
        same = c == F.lit(_typed(df, column, value))
        return ~same if name == "notequals" else same
    if name in _COMPARE:
        return _COMPARE[name](c, F.lit(_typed(df, column, value)))
    if name in ("in", "notin"):
        return _member(df, column, value if isinstance(value, list) else [value], name == "notin")
    if name in ("like", "notlike"):
        return ~c.like(value) if name == "notlike" else c.like(value)
    if name == "ilike":
        return c.ilike(value)
    if name in ("isnull", "isnotnull"):
        return c.isNull() if name == "isnull" else c.isNotNull()
    raise ValueError(f"unknown filter {name!r}")


def cursor_of(values: list) -> str:
    return base64.b64encode(":".join(map(str, values)).encode()).decode()


def read_cursor(text: str | None, n: int) -> list[int] | None:
    """The key values of a cursor; a malformed one is the first page."""
    try:
        parts = [int(x) for x in base64.b64decode(text or "", validate=True).decode().split(":")]
    except ValueError:
        return None
    return parts if len(parts) == n else None


def compile_query(tables: Mapping[tuple[str, str], DataFrame], query: Mapping, keys: list[str], cursor: str | None = None) -> tuple[DataFrame, int]:
    """(rows with one more than the limit, limit). keys are the table's total order, the default one, always selected and what a cursor compares."""
    name = (_get(query, "namespace", ""), _get(query, "table", ""))
    if name not in tables:
        raise ValueError(f"unknown table {name}")
    df = tables[name]
    columns = list(_get(query, "columns") or [])
    if bad := [c for c in columns if not _NAME.match(c) or c not in df.columns]:
        raise ValueError(f"unknown columns {bad}")
    for node in _get(query, "filter") or []:
        if (p := predicate(df, node)) is not None:
            df = df.where(p)
    keys = [k for k in keys if k in df.columns]
    order = [(_get(o, "column"), str(_get(o, "sortOrder", "ASC"))) for o in _get(query, "order") or []] or [(k, "ASC") for k in keys]
    if bad := [c for c, _ in order if c not in df.columns]:
        raise ValueError(f"unknown order columns {bad}")
    order = [(c, "DESC" if d.upper() == "DESC" else "ASC") for c, d in order]
    if cursor and keys and [c for c, _ in order][: len(keys)] == keys and (at := read_cursor(cursor, len(keys))) is not None:
        df = df.where(after(keys, at, order[0][1] == "DESC"))
    limit = _get(query, "limit")
    limit = DEFAULT_LIMIT if limit is None else min(max(int(limit), 1), MOST)
    distinct = bool(_get(query, "distinct", False))
    if columns:
        df = df.select(*dict.fromkeys([*columns, *([] if distinct else keys), *([c for c, _ in order] if not distinct else [])]))
    if distinct:
        df = df.distinct()
        order = [(c, d) for c, d in order if c in df.columns] or [(c, "ASC") for c in df.columns]
    return df.orderBy(*ordered(order)).limit(limit + 1), limit


def page(tables, query: Mapping, keys: list[str], cursor: str | None = None) -> dict:
    """One page as the API returns it: columns, rows, hasMore, nextCursor."""
    df, limit = compile_query(tables, query, keys, cursor)
    rows = df.collect()
    more, rows = len(rows) > limit, rows[:limit]
    have = [k for k in keys if k in df.columns]
    return {"columns": df.columns, "rows": [list(r) for r in rows], "hasMore": more, "nextCursor": cursor_of([rows[-1][k] for k in have]) if more and have else None}
