"""Which files a condition can't match, from their statistics alone.

The condition is parsed by Spark's own parser, and texts that are compared with dates or times are read by Spark's own cast in
the session's time zone; every part that is not understood keeps the file.
"""

from __future__ import annotations

import datetime as dt
import decimal
from typing import Any

from pyspark.sql import SparkSession

EPOCH = dt.datetime(1970, 1, 1)


class Literal:
    """A value of a condition with the name of its SQL type."""

    def __init__(self, kind: str, value: Any):
        self.kind, self.value = kind, value


def parse(spark: SparkSession, where: str, kinds: dict[str, str] | None = None) -> tuple:
    """A small tree: (and|or, a, b), (comparison, column, value), (null|notnull, column), or (any,).

    kinds: the logical type of each column. Values come as statistics of that type have them; (any,) if they can't.
    """
    tree = node(spark._jsparkSession.sessionState().sqlParser().parseExpression(where))
    return typed(spark, tree, kinds) if kinds is not None else tree


def columns(tree: tuple) -> set[str]:
    """The columns whose statistics matter."""
    if tree[0] in ("and", "or"):
        return columns(tree[1]) | columns(tree[2])
    return set() if tree[0] == "any" else {tree[1]}


def literal(e: Any) -> Literal:
    """A literal or the sign of one; ValueError if it is something else."""
    kind = e.getClass().getSimpleName()
    if kind == "UnaryMinus":
        x = literal(e.children().apply(0))
        return Literal(x.kind, -x.value)
    if kind != "Literal":
        raise ValueError(kind)
    v, t = e.value(), e.dataType().simpleString()
    if v is None:
        raise ValueError("null")
    if t == "date":
        return Literal(t, EPOCH.date() + dt.timedelta(days=v))
    if t == "timestamp":
        return Literal(t, EPOCH.replace(tzinfo=dt.UTC) + dt.timedelta(microseconds=v))
    if t == "timestamp_ntz":
        return Literal(t, EPOCH + dt.timedelta(microseconds=v))
    if t.startswith("decimal"):
        return Literal("decimal", decimal.Decimal(v.toString()))
    return Literal(t, v.toString() if t == "string" else v)


FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}
COMPARE = {"LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "EqualTo": "="}


def name(e: Any) -> str:
    if e.getClass().getSimpleName() != "UnresolvedAttribute" or e.nameParts().size() != 1:
        raise ValueError("no column")
    return e.nameParts().apply(0)


def node(e: Any) -> tuple:
    kind = e.getClass().getSimpleName()
    try:
        if kind in ("And", "Or"):
            return (kind.lower(), node(e.left()), node(e.right()))
        if kind in COMPARE:
            a, b, op = e.left(), e.right(), COMPARE[kind]
            if b.getClass().getSimpleName() == "UnresolvedAttribute":
                a, b, op = b, a, FLIP[op]
            return (op, name(a), literal(b))
        if kind in ("IsNull", "IsNotNull"):
            return ("null" if kind == "IsNull" else "notnull", name(e.child()))
        if kind == "In":
            parts = [("=", name(e.value()), literal(e.list().apply(i))) for i in range(e.list().size())]
            out = parts[0]
            for p in parts[1:]:
                out = ("or", out, p)
            return out
        if kind == "UnresolvedFunction" and e.nameParts().apply(0) == "between":
            c, lo, hi = (e.arguments().apply(i) for i in range(3))
            return ("and", (">=", name(c), literal(lo)), ("<=", name(c), literal(hi)))
    except (ValueError, AttributeError, TypeError):
        pass
    return ("any",)


NUMBERS = {"int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "int128", "uint128", "decimal"}
FLOATS = {"float32", "float64"}
TIMES = {"timestamp", "timestamp_s", "timestamp_ms", "timestamp_ns"}


def typed(spark: SparkSession, tree: tuple, kinds: dict[str, str]) -> tuple:
    """The tree with values as the columns' statistics have them."""
    if tree[0] in ("and", "or"):
        return (tree[0], typed(spark, tree[1], kinds), typed(spark, tree[2], kinds))
    if tree[0] == "any" or tree[1] not in kinds:
        return ("any",)
    if tree[0] in ("null", "notnull"):
        return tree
    v = fitted(spark, tree[2], kinds[tree[1]])
    return ("any",) if v is None else (tree[0], tree[1], v)


def fitted(spark: SparkSession, x: Literal, kind: str) -> Any:
    """The value that Spark compares a column of this type with; None where the column itself would be cast."""
    if kind == "boolean" or x.kind == "boolean":
        return x.value if kind == x.kind else None
    if kind in FLOATS:
        return float(x.value) if isinstance(x.value, (int, float, decimal.Decimal)) else None
    if kind in NUMBERS:
        # beside a float Spark makes both sides floats: bounds do so too, see may_match
        return x.value if isinstance(x.value, (int, float, decimal.Decimal)) else None
    if kind == "varchar":
        return x.value if x.kind == "string" else None
    if kind == "date":
        return x.value if x.kind == "date" else cast(spark, x, "date") if x.kind == "string" else None
    if kind in TIMES:
        return x.value if x.kind == "timestamp_ntz" else cast(spark, x, "timestamp_ntz") if x.kind == "string" else None
    if kind == "timestamptz":
        if x.kind == "timestamp":
            return x.value
        micros = cast(spark, x, "timestamp") if x.kind in ("string", "date") else None
        return None if micros is None else EPOCH.replace(tzinfo=dt.UTC) + dt.timedelta(microseconds=micros)
    return None


def cast(spark: SparkSession, x: Literal, to: str) -> Any:
    """Spark's own reading of a text or date, without a job; None if there is none. Instants come as microseconds."""
    text = str(x.value).replace("\\", "\\\\").replace("'", "\\'")
    value = f"try_cast({'date' if x.kind == 'date' else ''}'{text}' AS {to})"
    return spark.sql(f"SELECT {f'unix_micros({value})' if to == 'timestamp' else value} AS v").first().v


def may_match(tree: tuple, stats: dict[str, tuple], rows: int) -> bool:
    """stats: (min, max, nulls, and whether there are NaNs, if known) by column name. False only if no row of the file can satisfy the condition."""
    op = tree[0]
    if op == "and":
        return may_match(tree[1], stats, rows) and may_match(tree[2], stats, rows)
    if op == "or":
        return may_match(tree[1], stats, rows) or may_match(tree[2], stats, rows)
    if op == "any" or tree[1] not in stats:
        return True
    lo, hi, nulls, *more = stats[tree[1]]
    if op == "null":
        return nulls is None or nulls > 0
    if nulls is not None and nulls == rows:
        return False
    if op == "notnull" or lo is None or hi is None:
        return True
    v = tree[2]
    if isinstance(v, float) or isinstance(lo, float):
        try:
            a, b, v = float(lo), float(hi), float(v)
        except (TypeError, ValueError):
            return True
        if a != a or b != b or v != v:
            return True
        # bounds leave out NaN, which is greater than all
        nan = isinstance(lo, float) and not (more and more[0] in (False, 0) and more[0] is not None)
        return {"<": a < v, "<=": a <= v, ">": b > v or nan, ">=": b >= v or nan, "=": a <= v <= b}[op]
    try:
        return {"<": lo < v, "<=": lo <= v, ">": hi > v, ">=": hi >= v, "=": lo <= v <= hi}[op]
    except TypeError:
        return True
