"""Logical types, columns, schemas and partitionings, and what they are in Spark."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T


@dataclass(frozen=True)
class DataType:
    """A logical type: its kind, parameters and children."""

    kind: str
    args: tuple = ()
    children: tuple[Column, ...] = ()

    def __str__(self) -> str:
        """The text in the catalog; nested types are only named there, children are rows of their own."""
        return f"{self.kind}({', '.join(map(str, self.args))})" if self.args else self.kind

    def __eq__(self, other: object) -> bool:
        return isinstance(other, DataType) and (self.kind, self.args) == (other.kind, other.args) and [(c.name, c.data_type, c.nullable) for c in self.children] == [(c.name, c.data_type, c.nullable) for c in other.children]

    def __hash__(self) -> int:
        return hash((self.kind, self.args))


#: Kinds without parameters, with the class name of each and its Spark type.
FLAT = {
    "boolean": ("Boolean", T.BooleanType()), "int8": ("Int8", T.ByteType()), "int16": ("Int16", T.ShortType()), "int32": ("Int32", T.IntegerType()), "int64": ("Int64", T.LongType()),
    "int128": ("Int128", T.DecimalType(38, 0)), "uint8": ("UInt8", T.ShortType()), "uint16": ("UInt16", T.IntegerType()), "uint32": ("UInt32", T.LongType()), "uint64": ("UInt64", T.DecimalType(20, 0)),
    "uint128": ("UInt128", T.DecimalType(38, 0)), "float32": ("Float32", T.FloatType()), "float64": ("Float64", T.DoubleType()), "date": ("Date", T.DateType()), "varchar": ("Varchar", T.StringType()),
    "blob": ("Blob", T.BinaryType()), "json": ("Json", T.StringType()), "uuid": ("Uuid", T.StringType()), "timestamp": ("Timestamp", T.TimestampNTZType()), "timestamp_s": ("TimestampS", T.TimestampNTZType()),
    "timestamp_ms": ("TimestampMs", T.TimestampNTZType()), "timestamp_ns": ("TimestampNs", T.TimestampNTZType()), "timestamptz": ("TimestampTz", T.TimestampType()),
    "time": ("Time", T.TimeType(6)), "timetz": ("TimeTz", T.StringType()), "interval": ("Interval", T.StructType([T.StructField("months", T.IntegerType()), T.StructField("micros", T.LongType())])),
}

for _kind, (_name, _) in FLAT.items():
    globals()[_name] = (lambda k: lambda: DataType(k))(_kind)


def Decimal(precision: int, scale: int) -> DataType:  # noqa: N802 - types are written like classes
    return DataType("decimal", (precision, scale))


def List(element: DataType | Column) -> DataType:  # noqa: N802
    return DataType("list", (), (replace(element, name="element") if isinstance(element, Column) else Column("element", element),))


def Struct(fields: Iterable[Column] | Mapping[str, DataType]) -> DataType:  # noqa: N802
    return DataType("struct", (), tuple(Schema(fields).columns))


def Map(key: DataType, value: DataType) -> DataType:  # noqa: N802
    return DataType("map", (), (Column("key", key, nullable=False), Column("value", value)))


@dataclass(frozen=True)
class Column:
    """A named column; ``default_value`` is a literal, or (dialect, expression)."""

    name: str
    data_type: DataType
    nullable: bool = True
    tags: dict[str, str] = field(default_factory=dict)
    initial_default: Any = None
    default_value: Any = None
    field_id: int | None = None

    def __hash__(self) -> int:
        return hash((self.name, self.field_id))

    def walk(self, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Column]]:
        """The column and all below it, depth first, with paths."""
        yield (*path, self.name), self
        for c in self.data_type.children:
            yield from c.walk((*path, self.name))


class Schema:
    """Ordered columns with distinct names."""

    def __init__(self, columns: Schema | T.StructType | str | Iterable[Column] | Mapping[str, DataType]):
        if isinstance(columns, Schema):
            columns = columns.columns
        elif isinstance(columns, str):
            columns = from_spark(T.StructType.fromDDL(columns))
        elif isinstance(columns, T.StructType):
            columns = from_spark(columns)
        elif isinstance(columns, Mapping):
            columns = [Column(n, t) for n, t in columns.items()]
        elif type(columns).__module__.startswith("pyarrow"):
            columns = from_arrow(columns)
        self.columns = list(columns)
        names = [c.name for c in self.columns]
        if len(set(names)) < len(names):
            raise ValueError(f"column names repeat: {sorted(n for n in set(names) if names.count(n) > 1)}")

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Schema) and self.columns == other.columns

    def __repr__(self) -> str:
        return "\n".join(f"{c.name}: {c.data_type}{'' if c.nullable else ' not null'}" for c in self.columns)

    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def __getitem__(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)

    def walk(self) -> Iterator[tuple[tuple[str, ...], Column]]:
        for c in self.columns:
            yield from c.walk()

    def spark(self) -> T.StructType:
        return T.StructType([spark_field(c) for c in self.columns])


def parse_type(text: str, children: Iterable[Column] = ()) -> DataType:
    """The type that a catalog text and the columns below it mean."""
    m = re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", text)
    if m:
        return Decimal(int(m[1]), int(m[2]))
    if text in ("list", "struct", "map"):
        return DataType(text, (), tuple(children))
    if text not in FLAT:
        raise ValueError(f"unknown type {text!r}")
    return DataType(text)


def spark_type(t: DataType) -> T.DataType:
    if t.kind == "decimal":
        return T.DecimalType(*t.args)
    if t.kind == "list":
        return T.ArrayType(spark_type(t.children[0].data_type), t.children[0].nullable)
    if t.kind == "map":
        return T.MapType(*(spark_type(c.data_type) for c in t.children))
    if t.kind == "struct":
        return T.StructType([spark_field(c) for c in t.children])
    return FLAT[t.kind][1]


def spark_field(c: Column) -> T.StructField:
    """With the field id, by which Spark matches Parquet columns, and the default for files that lack the column."""
    meta: dict[str, Any] = {}
    if c.field_id is not None:
        meta["parquet.field.id"] = c.field_id
    if c.initial_default is not None:
        meta["EXISTS_DEFAULT"] = sql_literal(c.initial_default, c.data_type)
    if c.tags.get("comment"):
        meta["comment"] = c.tags["comment"]
    return T.StructField(c.name, spark_type(c.data_type), True, meta)


def sql_literal(value: Any, t: DataType) -> str:
    from .literals import format_value

    if value is None:
        return "NULL"
    kind = spark_type(t).simpleString()
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    text = format_value(value, t).replace("\\", "\\\\").replace("'", "\\'")
    return f"CAST('{text}' AS {kind.upper()})" if kind != "string" else f"'{text}'"


def from_spark(s: T.StructType) -> list[Column]:
    return [Column(f.name, from_spark_type(f.dataType), f.nullable, {"comment": f.metadata["comment"]} if "comment" in (f.metadata or {}) else {}) for f in s.fields]


def from_spark_type(t: T.DataType) -> DataType:
    if isinstance(t, T.DecimalType):
        return Decimal(t.precision, t.scale)
    if isinstance(t, T.ArrayType):
        return List(Column("element", from_spark_type(t.elementType), t.containsNull))
    if isinstance(t, T.MapType):
        return Map(from_spark_type(t.keyType), from_spark_type(t.valueType))
    if isinstance(t, T.StructType):
        return DataType("struct", (), tuple(from_spark(t)))
    if isinstance(t, (T.CharType, T.VarcharType)):
        return DataType("varchar")
    for kind in ("boolean", "int8", "int16", "int32", "int64", "float32", "float64", "date", "varchar", "blob", "timestamp", "timestamptz", "time"):
        if type(FLAT[kind][1]) is type(t):
            return DataType(kind)
    raise ValueError(f"{t.simpleString()} has no type in the lake")


def from_arrow(schema) -> list[Column]:
    """Columns of a pyarrow schema; dictionaries are kept as text with their values in the comment tag."""
    import json

    import pyarrow as pa

    def kind(t) -> DataType:
        if pa.types.is_dictionary(t):
            return DataType("varchar")
        if pa.types.is_decimal(t):
            return Decimal(t.precision, t.scale)
        if pa.types.is_timestamp(t):
            return DataType("timestamptz" if t.tz else {"s": "timestamp_s", "ms": "timestamp_ms", "us": "timestamp", "ns": "timestamp_ns"}[t.unit])
        if pa.types.is_struct(t):
            return DataType("struct", (), tuple(Column(f.name, kind(f.type), f.nullable) for f in t))
        if pa.types.is_map(t):
            return Map(kind(t.key_type), kind(t.item_type))
        if pa.types.is_list(t) or pa.types.is_large_list(t):
            return List(Column("element", kind(t.value_type), t.value_field.nullable))
        flat = {"bool": "boolean", "int8": "int8", "int16": "int16", "int32": "int32", "int64": "int64", "uint8": "uint8", "uint16": "uint16", "uint32": "uint32", "uint64": "uint64", "float": "float32", "double": "float64", "date32[day]": "date", "string": "varchar", "large_string": "varchar", "string_view": "varchar", "binary": "blob", "large_binary": "blob", "time64[us]": "time"}
        if str(t) not in flat:
            raise ValueError(f"{t} has no type in the lake")
        return DataType(flat[str(t)])

    return [Column(f.name, kind(f.type), f.nullable, {"comment": json.dumps({"dictionary": str(f.type.value_type)})} if pa.types.is_dictionary(f.type) else {}) for f in schema]


#: Each kind and those it may be promoted to.
PROMOTIONS = {
    **{f"int{b}": {f"int{c}" for c in (16, 32, 64) if c > b} for b in (8, 16, 32)},
    **{f"uint{b}": {f"uint{c}" for c in (16, 32, 64) if c > b} for b in (8, 16, 32)},
    "float32": {"float64"},
}


@dataclass(frozen=True)
class PartitionColumn:
    column: str
    transform: str = "identity"

    def __post_init__(self):
        if not re.fullmatch(r"identity|year|month|day|hour|bucket\(\d+\)", self.transform):
            raise ValueError(f"unknown partition transform {self.transform!r}")


class Partitioning:
    """Ordered partition columns; names, or (name, transform)."""

    def __init__(self, columns: str | Iterable):
        columns = [columns] if isinstance(columns, str) else columns
        self.columns = [c if isinstance(c, PartitionColumn) else PartitionColumn(c) if isinstance(c, str) else PartitionColumn(*c) for c in columns]

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Partitioning) and self.columns == other.columns

    def __repr__(self) -> str:
        return f"Partitioning({[(c.column, c.transform) for c in self.columns]})"
