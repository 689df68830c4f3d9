"""Writing DataFrames: inlined rows, or Parquet files with field ids."""

from __future__ import annotations

import decimal
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog.model import TableDef
from ..catalog.store import new_uuid
from ..errors import InvalidNullValueError
from ..functions.transforms import transform, with_default
from ..plans.scan import encode
from ..sources.footers import FileStats, read_all
from ..sources.storage import Files
from ..types import Column, spark_type

PARTITION = "__partition_"
HIVE_NULL = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class WriteDataFile:
    """A Parquet file to add; statistics are read from its footer if absent. partition_values: by column name."""

    path: str
    statistics: FileStats | None = None
    partition_values: dict[str, Any] | None = None


@dataclass
class WriteInfo:
    """What a caller that writes files itself needs."""

    options: dict[str, Any]
    path: str
    partition_columns: list[str] = field(default_factory=list)

    def generate(self, values: Sequence[Any] = ()) -> str:
        """A new path below the table's; with column=value folders where the option for them is on."""
        folders = "".join(f"{c}={quote(str(v), safe='-_.') if v is not None else 'NULL'}/" for c, v in zip(self.partition_columns, values)) if self.options["hive_file_pattern"] else ""
        return f"{self.path}{folders}tarn-{new_uuid()}.parquet"


def acceptable(have: T.DataType, want: T.DataType) -> bool:
    """Same type, a wider number, or all nulls; a time with a zone never meets one without."""
    order = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
    if have == want or isinstance(have, T.NullType):
        return True
    if type(have) in order and type(want) in order:
        return order.index(type(have)) <= order.index(type(want))
    if isinstance(want, T.DecimalType):
        return type(have) in order or isinstance(have, T.DecimalType) and have.precision - have.scale <= want.precision - want.scale and have.scale <= want.scale
    if isinstance(have, T.FloatType) and isinstance(want, T.DoubleType):
        return True
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return acceptable(have.elementType, want.elementType)
    if isinstance(have, T.MapType) and isinstance(want, T.MapType):
        return acceptable(have.keyType, want.keyType) and acceptable(have.valueType, want.valueType)
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        return have.names == want.names and all(acceptable(a.dataType, b.dataType) for a, b in zip(have, want))
    return False


#: The first value beyond each; Spark has no literal of 64 bits without a sign but a decimal.
UNSIGNED = {"uint8": 2**8, "uint16": 2**16, "uint32": 2**32, "uint64": decimal.Decimal(2**64), "uint128": None}


def prepare(df: DataFrame, t: TableDef) -> DataFrame:
    """Columns by name, in the table's order and types, with defaults for nulls; the names must be the table's."""
    have, want = set(df.columns), {c.name for c in t.columns}
    if have != want or len(df.columns) != len(have):
        raise ValueError(f"columns differ: missing {sorted(want - have)}, unknown {sorted(have - want)}")
    out = []
    for c in t.columns:
        kind, own = spark_type(c.data_type), df.schema[c.name].dataType
        narrow = {"uint8": T.ByteType, "uint16": T.ShortType, "uint32": T.IntegerType}
        if not acceptable(own, kind) and not (c.data_type.kind in narrow and isinstance(own, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))):
            raise ValueError(f"column {c.name} is {own.simpleString()}; the table has {kind.simpleString()}")
        value = F.col(f"`{c.name}`").cast(kind)
        if c.data_type.kind in UNSIGNED:
            end = UNSIGNED[c.data_type.kind]
            fits = (value >= 0) & (value < end) if end is not None else value >= 0
            value = F.when(value.isNull() | fits, value).otherwise(F.raise_error(F.lit(f"{c.name} is out of the range of {c.data_type}")))
        out.append(with_default(value, c).alias(c.name))
    return df.select(*out)


def check_nulls(t: TableDef, has_null: Callable[[Column], bool]) -> None:
    for c in t.columns:
        if not c.nullable and has_null(c):
            raise InvalidNullValueError(f"column {c.name} allows no nulls")


def inline_rows(df: DataFrame, t: TableDef, limit: int) -> list[dict[int, Any]] | None:
    """The encoded rows if there are at most ``limit``: at most one more is fetched."""
    if limit <= 0:
        return None
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    check_nulls(t, lambda c: any(r[c.name] is None for r in rows))
    return [{c.field_id: encode(r[c.name], c) for c in t.columns} for r in rows]


def row_bytes(schema: T.StructType) -> int:
    """A guess of what a row takes in a compressed file."""
    sizes = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 3, T.LongType: 5, T.FloatType: 4, T.DoubleType: 7, T.BooleanType: 1}
    return max(1, sum(sizes.get(type(f.dataType), 24) for f in schema))


#: A target of fewer rows than this, by the guess, makes many files; then rows of a trial are measured, up to TRIAL.
SMALL, TRIAL = 100_000, 4096


def rows_of_a_file(df: DataFrame, options: dict[str, Any]) -> int:
    """How many rows a file of the target size has.

    A guess by types, which may be several times off, is enough for large files.  For small ones the first rows are
    encoded in memory with the table's options, all and then half of them: what the second half adds is the size of a row, and the
    rest is there once a file.
    """
    target = options["target_file_size"]
    guess = max(1, target // row_bytes(df.schema))
    if guess >= SMALL:
        return guess
    try:
        rows = df.limit(min(TRIAL, max(1000, guess))).toArrow()
        if rows.num_rows < 100:
            return guess
        whole, half = encoded_size(rows, options), encoded_size(rows.slice(0, rows.num_rows // 2), options)
    except (pa.ArrowException, PySparkException, NotImplementedError):  # a type, or a compression, that Arrow has no writer for
        return guess
    row = max(whole - half, 1) / (rows.num_rows - rows.num_rows // 2)
    once = max(0, whole - row * rows.num_rows) + len(df.schema.json())  # Spark keeps the schema as JSON in every file
    return max(1, int((target - once) / row)) if target > once else guess


def encoded_size(rows: pa.Table, options: dict[str, Any]) -> int:
    codec, out = {"uncompressed": "none", "lz4_raw": "lz4"}.get(options["parquet_compression"], options["parquet_compression"]), pa.BufferOutputStream()
    level = options["parquet_compression_level"] if codec == "zstd" else None
    pq.write_table(rows, out, row_group_size=options["parquet_row_group_size"], compression=codec, compression_level=level, data_page_version=f"{options['parquet_version']}.0")
    return out.tell()


def write_files(df: DataFrame, t: TableDef, path: str, options: dict[str, Any], apart: bool = False) -> list[WriteDataFile]:
    """Parquet files in a fresh folder of the table; a crash before the commit leaves only orphans there.

    Partition keys are shadow columns, which are not in the files; their source columns are.  Rows of a partition come
    together by a rebalancing shuffle that splits large ones, unless its tasks hold them ``apart`` already.  Only files of the
    committed output are listed.
    """
    spark = df.sparkSession
    folder = f"{path}tarn-{new_uuid()}"
    schema = t.schema().spark()
    names = {c.field_id: c.name for c in t.columns}
    # ids of nested fields come with the type of the cast, those of columns with the alias
    out = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name, metadata={"parquet.field.id": f.metadata["parquet.field.id"]}) for f in schema])
    shadows = []
    for k, (i, how) in enumerate(t.partition):
        shadows.append(f"{PARTITION}{k}")
        out = out.withColumn(shadows[-1], transform(F.col(f"`{names[i]}`"), how).cast("string"))
    if shadows and not apart:
        out = out.hint("rebalance", *shadows)
    floats, nan = [c for c in t.columns if c.data_type.kind in ("float32", "float64")], Observation()
    if floats:  # footers don't say whether there are NaNs, so they are counted on the way
        out = out.observe(nan, *[F.max(F.isnan(f"`{c.name}`")).alias(str(c.field_id)) for c in floats])
    compression = {"uncompressed": "none"}.get(options["parquet_compression"], options["parquet_compression"])
    writer = out.write.option("compression", compression).option("parquet.block.row.count.limit", str(options["parquet_row_group_size"]))
    # every task writes files of its own, so per_thread_output has nothing to switch
    writer = writer.option("parquet.writer.version", f"v{options['parquet_version']}")
    if compression == "zstd":
        writer = writer.option("parquet.compression.codec.zstd.level", str(options["parquet_compression_level"]))
    writer = writer.option("maxRecordsPerFile", str(rows_of_a_file(df.select(*[f"`{f.name}`" for f in schema]), options)))
    (writer.partitionBy(*shadows) if shadows else writer).parquet(folder)
    files = Files(spark)
    paths = [p for p in files.below(folder, len(shadows)) if p.endswith(".parquet")]
    stats = read_all(files, paths, t.columns)
    if floats:
        seen, full = nan.get, sum(s.rows > 0 for s in stats)
        for s in stats:
            for c in floats:  # what was written has none, or the only file has some; of several files it isn't known which
                if c.field_id in s.columns:
                    s.columns[c.field_id].nan = bool(seen[str(c.field_id)]) if not seen[str(c.field_id)] or full == 1 else None
    out_files = []
    for p, s in zip(paths, stats):
        if s.rows:
            found = dict(x.split("=", 1) for x in p.split("/") if x.startswith(PARTITION))
            values = {names[i]: None if found[f"{PARTITION}{k}"] == HIVE_NULL else unquote(found[f"{PARTITION}{k}"]) for k, (i, _) in enumerate(t.partition)}
            out_files.append(WriteDataFile(p, s, values or None))
        else:
            files.delete(p)
    return out_files


def register(spark, files: Sequence[str | WriteDataFile] | str | WriteDataFile, t: TableDef) -> list[WriteDataFile]:
    """Files that exist already, with statistics; nothing is copied. Partition values must be complete or absent."""
    some = [files] if isinstance(files, (str, WriteDataFile)) else list(files)
    some = [WriteDataFile(f) if isinstance(f, str) else f for f in some]
    open_ = [f for f in some if f.statistics is None]
    for f, s in zip(open_, read_all(Files(spark), [f.path for f in open_], t.columns)):
        f.statistics = s
    names = {c.field_id: c.name for c in t.columns}
    keys = {names[i] for i, _ in t.partition}
    for f in some:
        if f.partition_values and set(f.partition_values) != keys:
            raise ValueError(f"{f.path}: partition values of {sorted(f.partition_values)}, the table's keys are {sorted(keys)}")
        check_nulls(t, lambda c: bool((f.statistics.columns.get(c.field_id) or NONE).nulls))
    return some


class NONE:
    nulls = 0
