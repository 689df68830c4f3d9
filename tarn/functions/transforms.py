"""Partition transforms and defaults as Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from ..types import Column, sql_literal

YEAR_TO_HOUR = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour}


def transform(c: SparkColumn, how: str) -> SparkColumn:
    """identity; calendar year; month 1-12; day of the month; hour 0-23; bucket(n) by Spark's Murmur3 hash.

    Buckets are this engine's own: other clients of the same tables may hash otherwise.
    """
    if how == "identity":
        return c
    if how in YEAR_TO_HOUR:
        return YEAR_TO_HOUR[how](c)
    m = re.fullmatch(r"bucket\((\d+)\)", how)
    if m:
        return F.pmod(F.hash(c), F.lit(int(m[1])))
    raise ValueError(f"unknown partition transform {how!r}")


def with_default(value: SparkColumn, c: Column) -> SparkColumn:
    """Nulls, explicit ones too, become the default; so do those of struct fields and list elements."""
    t = c.data_type
    if t.kind == "struct" and any(has_default(x) for x in t.children):
        value = F.when(value.isNotNull(), F.struct(*[with_default(value.getField(x.name), x).alias(x.name) for x in t.children]))
    elif t.kind == "list" and has_default(t.children[0]):
        value = F.transform(value, lambda e: with_default(e, t.children[0]))
    if c.default_value is None:
        return value
    if isinstance(c.default_value, tuple) and t.kind != "interval":
        dialect, text = c.default_value
        if dialect != "spark":
            raise ValueError(f"the default of {c.name} is an expression of {dialect}")
        return F.coalesce(value, F.expr(text))
    return F.coalesce(value, F.expr(sql_literal(c.default_value, t)))


def has_default(c: Column) -> bool:
    return c.default_value is not None or any(has_default(x) for x in c.data_type.children)
