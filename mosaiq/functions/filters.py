"""Metadata filters compiled to Columns.

{field: value} is equality, a list is membership, {"op": ..., "value": ...} an operator; all are joined by AND.
{"__logic__": "and" | "or", "__clauses__": [{"field", "op", "value"}]} lists clauses. {"__filter_expr__": sql} is
SQL and wins over everything. A null never satisfies an operator other than the null tests; values of another type
than the column are not equal to it and have no order with it.
"""

from __future__ import annotations

import operator
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALIASES = {"==": "=", "eq": "=", "neq": "!=", "ne": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "notin": "not in", "isnull": "is null", "isnotnull": "is not null"}
_ORDER = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
_TEXT = {"like": "like", "ilike": "ilike", "rlike": "rlike"}


def normal_operator(op: str) -> str:
    op = " ".join(str(op).strip().lower().split())
    return ALIASES.get(op, op)


def _comparable(kind: T.DataType, value: Any) -> bool:
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return isinstance(value, (int, float)) and value == value
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    return True


def _number(c: Column, kind: T.DataType) -> Column:
    return c.cast("int") if isinstance(kind, T.BooleanType) else c


def _literal(kind: T.DataType, value: Any) -> Column:
    if isinstance(kind, (T.NumericType, T.BooleanType)) and isinstance(value, bool):
        return F.lit(int(value))
    return F.lit(value)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def clause(df: DataFrame, field: str | None, op: str, value: Any = None) -> Column:
    if not field:
        return F.lit(True)
    op = normal_operator(op)
    if field not in df.columns:
        return F.lit(op == "is null")
    c, kind = df[f"`{field}`"], df.schema[field].dataType
    if op == "is null":
        return c.isNull()
    if op == "is not null":
        return c.isNotNull()
    if op in ("in", "not in"):
        if not isinstance(value, (list, tuple, set)):
            return F.lit(False)
        usable = sorted({v for v in value if v is not None and _comparable(kind, v)}, key=repr)
        inside = _number(c, kind).isin([int(v) if isinstance(v, bool) else v for v in usable]) if usable else F.lit(False)
        return _sure((inside if op == "in" else ~inside) & c.isNotNull())
    if op in _TEXT and isinstance(value, str):
        return _sure(getattr(c.cast("string"), op)(value))
    if op in ("=", "!="):
        if value is None or not _comparable(kind, value):
            return c.isNotNull() if op == "!=" else F.lit(False)
        same = _number(c, kind) == _literal(kind, value)
        return _sure(same if op == "=" else ~same)
    if op in _ORDER and value is not None and _comparable(kind, value):
        return _sure(_ORDER[op](_number(c, kind), _literal(kind, value)))
    return F.lit(False)


def _entry(df: DataFrame, field: str, expected: Any) -> Column:
    if isinstance(expected, dict) and expected.get("op") is not None:
        return clause(df, field, expected["op"], expected.get("value"))
    if isinstance(expected, (list, tuple, set)):
        member = clause(df, field, "in", expected)
        return member | clause(df, field, "is null") if None in expected else member
    return clause(df, field, "is null") if expected is None else clause(df, field, "=", expected)


def compile_filter(df: DataFrame, spec: dict[str, Any] | None) -> Column:
    """The condition of a filter, for the columns of df."""
    if not spec:
        return F.lit(True)
    if spec.get("__filter_expr__"):
        return _sure(F.expr(spec["__filter_expr__"]))
    if "__clauses__" in spec:
        parts = [clause(df, c.get("field"), c.get("op", "="), c.get("value")) for c in spec["__clauses__"]]
        either = str(spec.get("__logic__", "and")).strip().lower() == "or"
        return reduce(operator.or_, parts, F.lit(False)) if either else reduce(operator.and_, parts, F.lit(True))
    return reduce(operator.and_, [_entry(df, k, v) for k, v in spec.items() if not str(k).startswith("__")], F.lit(True))


def combined(df: DataFrame, base: dict[str, Any] | None, cell: dict[str, Any] | None) -> Column:
    """Subset filter and cell filter together; a cell's null value matches null."""
    return compile_filter(df, base) & reduce(operator.and_, [_entry(df, k, v) for k, v in (cell or {}).items()], F.lit(True))


def parse_literal(text: str) -> Any:
    """'x' or "x" to a string, true and false to bool, then int, float, else the text."""
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_list(text: str) -> list[Any]:
    return [parse_literal(x) for x in text.split(",") if x.strip()]


def conditions(rows: list[tuple[str, str, str]]) -> dict[str, Any] | None:
    """Clauses from (field, operator, value text) rows of a form; rows without field or needed value don't count."""
    out = []
    for field, op, text in rows:
        op = normal_operator(op)
        if not field or (op not in ("is null", "is not null") and not (text or "").strip()):
            continue
        value = None if op.startswith("is ") else parse_list(text) if op in ("in", "not in") else parse_literal(text)
        out.append({"field": field, "op": op, "value": value})
    return {"__logic__": "and", "__clauses__": out} if out else None


def _sql_value(value: Any) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def _sql_name(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_]\w*", name, re.ASCII) else "`" + name.replace("`", "``") + "`"


def to_sql(spec: dict[str, Any] | None) -> str | None:
    """The filter as SQL text, for display or for another engine; None for no filter."""
    if not spec:
        return None
    if spec.get("__filter_expr__"):
        return spec["__filter_expr__"]
    either = str(spec.get("__logic__", "and")).strip().lower() == "or"
    clauses = spec.get("__clauses__")
    if clauses is None:
        clauses = [{"field": k, **v} if isinstance(v, dict) else {"field": k, "op": "in" if isinstance(v, (list, tuple, set)) else "=", "value": v} for k, v in spec.items() if not str(k).startswith("__")]
    out = []
    for c in clauses:
        if not c.get("field"):
            continue
        op, value, name = normal_operator(c.get("op", "=")), c.get("value"), _sql_name(c["field"])
        if op in ("is null", "is not null"):
            out.append(f"{name} {op.upper()}")
        elif op in ("in", "not in"):
            values = [v for v in (value if isinstance(value, (list, tuple, set)) else [value]) if v is not None]
            if values:
                out.append(f"{name} {op.upper()} ({', '.join(map(_sql_value, values))})")
        elif value is not None:
            out.append(f"{name} {op.upper() if op in _TEXT else op} {_sql_value(value)}")
    return f" {'OR' if either else 'AND'} ".join(out) or None


def summary(spec: dict[str, Any] | None) -> str:
    return to_sql(spec) or "All data"
