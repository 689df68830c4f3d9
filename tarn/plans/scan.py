"""From a snapshot's files, deletes and inlined rows to one DataFrame."""

from __future__ import annotations

import contextlib
import decimal
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog.model import ALIVE, Catalog, TableDef
from ..catalog.store import Session
from ..literals import format_value, parse_value
from ..sources.footers import ColumnStats
from ..sources.storage import Files, join
from ..types import Column, DataType, spark_type
from . import pruning

#: Deletes of a scan are broadcast up to so many rows (two words each); more are joined by a shuffle.
BROADCAST_DELETES = 500_000


@dataclass
class DeleteFile:
    id: int
    path: str
    count: int
    begin: int = 0


@dataclass
class ScanDataFile:
    id: int
    path: str
    rows: int
    bytes: int
    row_id_start: int | None
    stats: dict[int, ColumnStats] = field(default_factory=dict)
    deletes: list[DeleteFile] = field(default_factory=list)
    #: positions that the catalog holds itself, and the snapshot that deleted each
    deleted_rows: dict[int, int] = field(default_factory=dict)

    def deleted(self) -> int:
        """Rows that are gone. A delete file holds all positions that were inlined before it, so only later ones add to it."""
        last = max((d.begin for d in self.deletes), default=-1)
        return sum(d.count for d in self.deletes) + sum(b > last for b in self.deleted_rows.values())


@dataclass
class ScanResult:
    """What a table is made of at one snapshot."""

    table: TableDef
    files: list[ScanDataFile]
    #: (row id, values by field id) of inlined rows
    inlined: list[tuple[int, dict[int, Any]]]

    def count(self) -> int:
        """Rows, from the catalog alone."""
        return sum(f.rows - f.deleted() for f in self.files) + len(self.inlined)


# -- inlined values -------------------------------------------------------------------------
# Nested values are JSON in which struct fields go by field id, so renamed, new and dropped fields need no history.


def encode(v: Any, c: Column) -> Any:
    t = c.data_type
    if v is None:
        return None
    if t.kind in ("list", "struct", "map"):
        return json.dumps(plain(v, c))
    if t.kind == "blob":
        return bytes(v)
    if t.kind in ("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32"):
        return int(v)
    return str(v) if t.kind in ("varchar", "json") else format_value(v, t)


def plain(v: Any, c: Column) -> Any:
    t = c.data_type
    if v is None:
        return None
    if t.kind == "list":
        return [plain(x, t.children[0]) for x in v]
    if t.kind == "map":
        return [[plain(k, t.children[0]), plain(x, t.children[1])] for k, x in v.items()]
    if t.kind == "struct":
        v = v.asDict() if hasattr(v, "asDict") else v
        return {str(x.field_id): plain(v.get(x.name), x) for x in t.children}
    return str(v) if t.kind in ("varchar", "json") else format_value(v, t)


def decode(v: Any, c: Column) -> Any:
    t = c.data_type
    if v is None:
        return None
    if t.kind in ("list", "struct", "map"):
        return nested(json.loads(v), c)
    if t.kind == "blob":
        return bytes(v)
    return v if t.kind in ("varchar", "json") else in_spark(parse_value(str(v), t), t)


def in_spark(v: Any, t: DataType) -> Any:
    """Whole numbers that have no type of their own in Spark are decimals there."""
    return decimal.Decimal(v) if t.kind in ("uint64", "int128", "uint128") and v is not None else v


def nested(v: Any, c: Column) -> Any:
    t = c.data_type
    if v is None:
        return None
    if t.kind == "list":
        return [nested(x, t.children[0]) for x in v]
    if t.kind == "map":
        return {nested(k, t.children[0]): nested(x, t.children[1]) for k, x in v}
    if t.kind == "struct":
        return tuple(nested(v[str(x.field_id)], x) if str(x.field_id) in v else x.initial_default for x in t.children)
    return v if t.kind in ("varchar", "json") else in_spark(parse_value(v, t), t)


def inlined_name(prefix: str, table_id: int, schema_version: int) -> str:
    return f"{prefix}inlined_data_{table_id}_{schema_version}"


def deletes_name(prefix: str, table_id: int) -> str:
    return f"{prefix}inlined_delete_{table_id}"


# -- the scan -------------------------------------------------------------------------------


def scan(s: Session, catalog: Catalog, t: TableDef, stats_of: set[str] | None = None) -> ScanResult:
    """The files, deletes and inlined rows of a snapshot; statistics only of the top columns named, of all if None."""
    at, base = (catalog.snapshot.id, catalog.snapshot.id), catalog.path_of(t)
    files = {
        r["data_file_id"]: ScanDataFile(r["data_file_id"], join(base, r["path"]) if r["path_is_relative"] else r["path"], r["record_count"], r["file_size_bytes"], r["row_id_start"])
        for r in s.rows(f"SELECT * FROM {{data_file}} WHERE table_id = ? AND {ALIVE} ORDER BY data_file_id", t.id, *at)
    }
    by_id = t.by_id()
    ids = [c.field_id for c in t.columns if c.name in stats_of] if stats_of is not None else list(by_id)
    if ids and files:
        for r in s.matching(ids, f"SELECT c.* FROM {{file_column_stats}} c JOIN {{data_file}} f ON c.data_file_id = f.data_file_id WHERE f.table_id = ? AND {alive_as('f')} AND c.column_id IN {{ids}}", t.id, *at):
            c = by_id.get(r["column_id"])
            if c is not None and not c.data_type.children:
                # bounds are read by the column's present type, which they were promoted to with the column
                files[r["data_file_id"]].stats[c.field_id] = ColumnStats(r["column_size_bytes"], r["value_count"], r["null_count"], parse_value(r["min_value"], c.data_type), parse_value(r["max_value"], c.data_type), r["contains_nan"])
    for r in s.rows(f"SELECT * FROM {{delete_file}} WHERE table_id = ? AND {ALIVE}", t.id, *at):
        if r["format"] != "parquet":
            raise ValueError(f"delete files of the format {r['format']} can't be read")
        if r["data_file_id"] in files:
            files[r["data_file_id"]].deletes.append(DeleteFile(r["delete_file_id"], join(base, r["path"]) if r["path_is_relative"] else r["path"], r["delete_count"] or 0, r["begin_snapshot"]))
    name = deletes_name(s.store.prefix, t.id)
    if s.has_table(name):
        for r in s.rows(f"SELECT * FROM {name} WHERE begin_snapshot <= ?", at[0]):
            if r["file_id"] in files:
                files[r["file_id"]].deleted_rows.setdefault(r["row_id"], r["begin_snapshot"])
    inlined = []
    for v in s.rows("SELECT * FROM {inlined_data_tables} WHERE table_id = ? ORDER BY schema_version", t.id):
        for r in s.rows(f"SELECT * FROM {v['table_name']} WHERE {ALIVE} ORDER BY row_id", *at):
            inlined.append((r["row_id"], {int(k[1:]): x for k, x in r.items() if k[0] == "c" and k[1:].isdigit()}))
    return ScanResult(t, list(files.values()), sorted(inlined, key=lambda x: x[0]))


def alive_as(alias: str) -> str:
    return ALIVE.replace("begin_", f"{alias}.begin_").replace("(end_", f"({alias}.end_").replace("OR end_", f"OR {alias}.end_")


def count(s: Session, catalog: Catalog, t: TableDef) -> int:
    """Rows of a snapshot, by sums in the catalog database: no file becomes an object here."""
    at = (catalog.snapshot.id, catalog.snapshot.id)
    total = s.rows(f"SELECT SUM(record_count) AS n FROM {{data_file}} WHERE table_id = ? AND {ALIVE}", t.id, *at)[0]["n"] or 0
    total -= s.rows(f"SELECT SUM(d.delete_count) AS n FROM {{delete_file}} d JOIN {{data_file}} f ON d.data_file_id = f.data_file_id WHERE d.table_id = ? AND {alive_as('d')} AND {alive_as('f')}", t.id, *at, *at)[0]["n"] or 0
    name = deletes_name(s.store.prefix, t.id)
    if s.has_table(name):
        later = f"NOT EXISTS (SELECT 1 FROM {{delete_file}} d WHERE d.data_file_id = x.file_id AND d.begin_snapshot >= x.begin_snapshot AND {alive_as('d')})"
        total -= s.rows(f"SELECT COUNT(*) AS n FROM (SELECT DISTINCT x.file_id, x.row_id FROM {name} x JOIN {{data_file}} f ON x.file_id = f.data_file_id WHERE x.begin_snapshot <= ? AND {alive_as('f')} AND {later}) y", at[0], *at, *at)[0]["n"]
    for v in s.rows("SELECT table_name FROM {inlined_data_tables} WHERE table_id = ?", t.id):
        total += s.rows(f"SELECT COUNT(*) AS n FROM {v['table_name']} WHERE {ALIVE}", *at)[0]["n"]
    return int(total)


def inlined_values(result: ScanResult) -> list[tuple]:
    """Rows of the present schema; a column that did not exist yet has its initial default."""
    return [(i, *(decode(values[c.field_id], c) if c.field_id in values else c.initial_default for c in result.table.columns)) for i, values in result.inlined]


@contextlib.contextmanager
def few_listings(spark: SparkSession) -> Iterator[None]:
    """Spark looks files up in as many tasks as there are paths, up to 10,000; here a few for each core, with many paths each."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, old) if old is not None else spark.conf.unset(key)


ROW, FILE, POSITION = "__row_id", "__file", "__position"


def to_df(lake, result: ScanResult, where: str | None = None, include_file_paths: str | None = None, time_zone: str | None = None, hidden: bool = False, alias: str | None = None) -> DataFrame:
    """The table as a DataFrame, fixed to the files of the scan.

    ``where`` leaves out files that it can't match and filters the rest.  Only files with deletes go through the anti-join.
    With ``hidden`` the columns ROW (of inlined rows), FILE and POSITION (of others) come along.  The condition may call the table
    by its name or by ``alias``.
    """
    spark, t = lake.spark, result.table
    schema = t.schema().spark()
    files = result.files
    if where is not None:
        tree = pruning.parse(spark, where, {c.name: c.data_type.kind for c in t.columns})
        top = {c.field_id: c.name for c in t.columns}
        files = [f for f in files if pruning.may_match(tree, {top[i]: (x.min, x.max, x.nulls, x.nan) for i, x in f.stats.items() if i in top}, f.rows)]
    paths = Files(spark)

    def read(some: list[ScanDataFile]) -> DataFrame:
        with few_listings(spark):
            df = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[f.path for f in some])
        extra = [F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias(FILE), F.col("_metadata.row_index").alias(POSITION)] if some else [F.lit(None).cast("string").alias(FILE), F.lit(None).cast("long").alias(POSITION)]
        return df.select(*[f"`{c.name}`" for c in t.columns], *extra)

    clean, dirty = [f for f in files if not f.deleted()], [f for f in files if f.deleted()]
    out = read(clean)
    if dirty:
        gone = spark.read.schema("file_path string, pos long").parquet(*[d.path for f in dirty for d in f.deletes]) if any(f.deletes for f in dirty) else None
        few = [(paths.key(f.path), p) for f in dirty for p in f.deleted_rows]
        if few:
            more = spark.createDataFrame(few, "file_path string, pos long")
            gone = more if gone is None else gone.union(more)
        if sum(f.deleted() for f in dirty) <= BROADCAST_DELETES:
            gone = F.broadcast(gone)
        rest = read(dirty)
        out = out.union(rest.join(gone, (rest[FILE] == gone["file_path"]) & (rest[POSITION] == gone["pos"]), "left_anti"))
    out = out.withColumn(ROW, F.lit(None).cast("long"))
    if result.inlined:
        inline = spark.createDataFrame(inlined_values(result), T.StructType([T.StructField(ROW, T.LongType()), *[T.StructField(c.name, spark_type(c.data_type)) for c in t.columns]]))
        out = out.unionByName(inline.withColumn(FILE, F.lit(None).cast("string")).withColumn(POSITION, F.lit(None).cast("long")))
    if where is not None:
        out = out.alias(alias or t.name).where(where)
    columns = [F.col(f"`{c.name}`") for c in t.columns]
    if include_file_paths:
        columns.append(F.col(FILE).alias(include_file_paths))
    if time_zone:
        columns = [in_zone(x, c, time_zone) for x, c in zip(columns, t.columns)] + columns[len(t.columns) :]
    return out.select(*columns, *([ROW, FILE, POSITION] if hidden else []))


def in_zone(value, c: Column, zone: str):
    """Instants as wall-clock time of a zone; other types, maps too, as they are."""
    t = c.data_type
    if t.kind == "timestamptz":
        return F.convert_timezone(F.current_timezone(), F.lit(zone), value.cast("timestamp_ntz")).alias(c.name)
    if t.kind == "struct":
        return F.when(value.isNotNull(), F.struct(*[in_zone(value.getField(x.name), x, zone).alias(x.name) for x in t.children])).alias(c.name)
    if t.kind == "list":
        return F.transform(value, lambda e: in_zone(e, t.children[0], zone)).alias(c.name)
    return value.alias(c.name)
