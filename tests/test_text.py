"""Literals, names, types and changes: no Spark."""

import datetime as dt
import decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tarn import types as t
from tarn.catalog.changes import Applied, conflict, format_changes, parse_changes
from tarn.catalog.options import typed
from tarn.identifiers import TableName, column_path, parts, quote_name, table_name
from tarn.literals import format_value, parse_interval, parse_timestamp, parse_value
from tarn.plans.pruning import may_match
from tarn.sources.storage import join, plain, relative_to, storage_settings
from tarn.types import Column, Partitioning, Schema, parse_type


@pytest.mark.parametrize(
    ("kind", "value", "text"),
    [(t.Boolean(), True, "1"), (t.Int8(), -5, "-5"), (t.UInt64(), 2**64 - 1, str(2**64 - 1)), (t.Float64(), 1.5, "1.5"), (t.Decimal(10, 2), decimal.Decimal("1.20"), "1.20"), (t.Date(), dt.date(2020, 1, 2), "2020-01-02"),
     (t.Timestamp(), dt.datetime(2020, 1, 2, 3, 4, 5), "2020-01-02 03:04:05"), (t.TimestampTz(), dt.datetime(2020, 1, 2, tzinfo=dt.UTC), "2020-01-02T00:00:00+00:00"), (t.Blob(), b"\x01\xff", "01ff"), (t.Varchar(), "a'b", "a'b"),
     (t.Interval(), (14, 86_400_000_001), "1 years 2 months 1 days 00:00:00.000001"), (t.List(t.Int64()), [1, None, 3], "[1, NULL, 3]"), (t.List(t.Varchar()), ["a b", "x", "", "NULL"], "['a b', x, '', 'NULL']"),
     (t.Struct({"a": t.Int64(), "b": t.Varchar()}), {"a": 1, "b": "it's"}, "{'a': 1, 'b': 'it\\'s'}"), (t.Map(t.Varchar(), t.Int64()), {"k": 1, "l": None}, "{k=1, l=NULL}"), (t.List(t.List(t.Int32())), [[1], []], "[[1], []]")],
)
def test_literals(kind, value, text):
    assert format_value(value, kind) == text
    assert parse_value(text, kind) == value


def test_null_and_bad_literals():
    assert format_value(None, t.Int64()) == "NULL" and parse_value("NULL", t.Varchar()) is None
    for text, kind in (("2", t.Boolean()), ("[1", t.List(t.Int64())), ("{'z': 1}", t.Struct({"a": t.Int64()})), ("{NULL=1}", t.Map(t.Varchar(), t.Int64()))):
        with pytest.raises(ValueError):
            parse_value(text, kind)


@given(st.lists(st.none() | st.text(max_size=12).filter(lambda x: x.isprintable()), max_size=5))
def test_list_of_text_round_trip(value):
    assert parse_value(format_value(value, t.List(t.Varchar())), t.List(t.Varchar())) == value


def test_times():
    assert parse_timestamp("2020-01-02 03:04") == dt.datetime(2020, 1, 2, 3, 4)
    assert parse_timestamp("2020-01-02T03:04:05.123456789Z").microsecond == 123456
    assert parse_timestamp("2020-01-02 03:04:05+02").utcoffset() == dt.timedelta(hours=2)
    assert parse_interval("2 days 01:00:00") == (0, 2 * 86_400_000_000 + 3_600_000_000)


@given(st.lists(st.text(min_size=1, max_size=8), min_size=1, max_size=3))
def test_quoted_names(names):
    assert parts(".".join(map(quote_name, names))) == names


def test_names():
    assert table_name("a") == TableName("main", "a") and table_name("s.a") == TableName("s", "a") and str(TableName("s", 'a"b')) == '"s"."a""b"'
    assert column_path("s.a") == ("s", "a") and column_path(["s.a"]) == ("s.a",)
    for bad in ('a."b"', "", "a.", "a.b.c"):
        with pytest.raises(ValueError):
            table_name(bad)


def test_types(spark):
    assert parse_type("decimal(10, 2)") == t.Decimal(10, 2) and str(t.Decimal(10, 2)) == "decimal(10, 2)"
    with pytest.raises(ValueError, match="repeat"):
        Schema([Column("a", t.Int64()), Column("a", t.Int64())])
    assert Schema("a bigint, s struct<x:int>").columns[1].data_type == t.Struct({"x": t.Int32()})
    assert Partitioning(["a", ("b", "year")]).columns[1].transform == "year"
    with pytest.raises(ValueError):
        Partitioning([("a", "week")])


def test_changes():
    made = [Applied("created_table", None, ("s,1", 'a"b')), Applied("inserted_into_table", 3)]
    assert parse_changes(format_changes(made)) == made
    a = lambda k, i=1: Applied(k, i)
    assert conflict(a("altered_table"), a("altered_table"), {}) and conflict(a("deleted_from_table"), a("deleted_from_table"), {}) and conflict(a("merge_adjacent"), a("deleted_from_table"), {})
    assert not conflict(a("inserted_into_table"), a("inserted_into_table"), {}) and not conflict(a("altered_table"), a("altered_table", 2), {}) and not conflict(a("deleted_from_table"), a("inserted_into_table"), {})
    new = Applied("created_table", None, ("main", "t"))
    assert conflict(new, new, {}) and conflict(new, a("dropped_schema", 0), {"main": 0}) and conflict(a("dropped_schema", 0), new, {"main": 0})


def test_options_and_paths():
    assert typed("target_file_size", "512MB") == 512_000_000 and typed("auto_compact", "false") is False
    assert plain("file:///a/b") == "/a/b" and plain("s3://x/y") == "s3a://x/y" and join("a/", "b") == "a/b" and join("a", "/b") == "/b"
    assert relative_to("file:/a/b/c", "/a/b/") == ("c", True) and relative_to("/x", "/a") == ("/x", False)
    assert storage_settings({"aws_access_key_id": "u"}, {"AWS_ACCESS_KEY_ID": "e"})["fs.s3a.access.key"] == "u"


def test_pruning():
    stats = {"x": (10, 20, 0), "s": ("b", "d", 5)}
    for tree, want in ((("=", "x", 9), False), (("=", "x", 10), True), (("<", "x", 10), False), (("<=", "x", 10), True), ((">", "x", 20), False), (("null", "x"), False), (("null", "s"), True), (("=", "s", "a"), False), (("=", "y", 1), True),
                       (("and", ("any",), ("=", "x", 9)), False), (("or", ("any",), ("=", "x", 9)), True), (("=", "x", "text"), True)):
        assert may_match(tree, stats, 10) is want, tree
    assert not may_match(("notnull", "n"), {"n": (None, None, 10)}, 10)
