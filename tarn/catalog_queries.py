"""Queries for what the catalog does: definitions, transactions, writes by callers, options, literals, names, migrations.

Each works on a lake of its own.  Where the outcome is a fact about the catalog, the query returns the fact as rows.
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lake as lakes
from . import types as t
from .errors import LakeError
from .identifiers import column_path, table_name
from .literals import format_value, parse_value
from .operators.write import WriteDataFile
from .queries import fresh, load, query, source
from .sources.storage import absolute, join, plain, relative_to, storage_settings
from .types import Column, DataType, Schema


def facts(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def refused(f) -> str:
    """The class of the error that f raises; empty if it does not."""
    try:
        f()
    except (LakeError, ValueError) as e:
        return type(e).__name__
    return ""


def nation(spark, sf_dir) -> DataFrame:
    return source(spark, sf_dir, "nation")


# -- reading and writing ---------------------------------------------------------------------


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def read_arrow(spark, sf_dir):
    """The table as Arrow in the driver, and back."""
    table = load(fresh(spark), sf_dir, "nation").to_arrow(where="n_regionkey = 1")
    return spark.createDataFrame(table).select("n_nationkey", "n_name")


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def read_pandas(spark, sf_dir):
    return spark.createDataFrame(load(fresh(spark), sf_dir, "nation").to_pandas()).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("SELECT * FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def write_arrow(spark, sf_dir):
    lake, regions = fresh(spark), source(spark, sf_dir, "region").collect()
    a = lake.create_table("a", nation(spark, sf_dir).schema)
    a.write_arrow(nation(spark, sf_dir).toArrow())
    a.write_arrow(pa.table({"n_nationkey": pa.array([r.r_regionkey for r in regions], pa.int32()), "n_name": [r.r_name for r in regions], "n_regionkey": pa.nulls(len(regions), pa.int32())}))
    return a.to_df()


@query("SELECT *, CAST(0 AS BIGINT) AS n_inlined FROM region")
def sink_lazy(spark, sf_dir):
    """A sink writes files, however few the rows are."""
    a = fresh(spark).create_table("a", source(spark, sf_dir, "region").schema)
    a.sink(source(spark, sf_dir, "region"))
    return a.to_df().withColumn("n_inlined", F.lit(len(a.scan().inlined)).cast("long"))


@query("SELECT * FROM nation WHERE n_regionkey < 3")
def write_closure(spark, sf_dir):
    """The caller writes files where it is told, and the commit takes them in."""
    a = fresh(spark).create_table("a", nation(spark, sf_dir).schema)

    def write(info):
        folder = info.generate() + ".d"
        fields = [F.col(f.name).alias(f.name, metadata=f.metadata) for f in a.schema.spark()]
        nation(spark, sf_dir).where("n_regionkey < 3").select(*fields).write.parquet(folder)
        return [WriteDataFile(f.path) for f in lakes_files(spark, folder)]

    a.write_data(write)
    return a.to_df()


def lakes_files(spark, folder: str) -> list:
    from .sources.storage import Files

    return [f for f in Files(spark).list(folder) if f.path.endswith(".parquet")]


@query("SELECT count(*) AS n_rows, true AS many, true AS full FROM lineitem")
def file_size_target(spark, sf_dir):
    """A small target makes many files, whose rows are those of the table."""
    a = fresh(spark).create_table("a", source(spark, sf_dir, "lineitem").schema)
    a.set_metadata(target_file_size="50kb", parquet_row_group_size=1000, parquet_compression="zstd", parquet_compression_level=5, parquet_version=2)
    a.sink(source(spark, sf_dir, "lineitem"))
    files = a.scan(stats_of=set()).files
    return facts(spark, [(a.to_df().count(), len(files) > 1, sum(f.rows for f in files) == a.count())], "n_rows long, many boolean, full boolean")


@query("SELECT c_mktsegment || ' / 100%=' || (c_custkey % 3) AS p, count(*) AS n, true AS escaped FROM customer GROUP BY 1")
def partition_odd_values(spark, sf_dir):
    """Partition values with blanks, slashes and percent signs."""
    df = source(spark, sf_dir, "customer").select(F.concat("c_mktsegment", F.lit(" / 100%="), F.col("c_custkey") % 3).alias("p"), "c_custkey")
    a = load(fresh(spark), sf_dir, "a", df, partition_by="p")
    kept = {r["partition_value"] for r in a.lake.store.rows("SELECT partition_value FROM {file_partition_value}")}
    return a.to_df().groupBy("p").agg(F.count("*").alias("n")).withColumn("escaped", F.lit(all(" / 100%=" in v for v in kept)))


@query("""SELECT 'l_quantity' AS col, count(*) AS n, CAST(min(l_quantity) AS VARCHAR) AS lo, CAST(max(l_quantity) AS VARCHAR) AS hi FROM lineitem
    UNION ALL SELECT 'l_orderkey', count(*), CAST(min(l_orderkey) AS VARCHAR), CAST(max(l_orderkey) AS VARCHAR) FROM lineitem""")
def table_statistics(spark, sf_dir):
    """Row count and bounds of the whole table, merged from those of many files; a delete lowers the count."""
    lake, df = fresh(spark), source(spark, sf_dir, "lineitem")
    a = lake.create_table("a", df.schema)
    for k in range(3):
        a.append(df.where(F.col("l_orderkey") % 3 == k))
    a.append(df.where("l_orderkey = 1"))
    a.append(df.limit(4).withColumn("l_orderkey", F.lit(-5).cast("long")))
    a.delete_where("l_orderkey = -5")
    n = lake.store.rows("SELECT record_count FROM {table_stats} WHERE table_id = ?", a.id)[0]["record_count"] - df.where("l_orderkey = 1").count()
    found = {r["column_id"]: r for r in lake.store.rows("SELECT * FROM {table_column_stats} WHERE table_id = ?", a.id)}
    ids = {c.name: c.field_id for c in a.schema.columns}
    # bounds of the table only widen: the deleted key still bounds it
    rows = [(c, n, str(found[ids[c]]["min_value"]) if c == "l_quantity" else "0" if found[ids[c]]["min_value"] == "-5" else "?", str(found[ids[c]]["max_value"])) for c in ("l_quantity", "l_orderkey")]
    return facts(spark, rows, "col string, n long, lo string, hi string")


@query("SELECT i, CAST(i AS BIGINT) AS row_id FROM (SELECT unnest(range(12)) AS i)")
def inline_row_order(spark, sf_dir):
    """Inlined rows come in the order of their ids, over several commits."""
    a = fresh(spark).create_table("a", {"i": t.Int64()})
    for k in (0, 4, 8):
        a.append(spark.range(k, k + 4).select(F.col("id").alias("i")))
    return facts(spark, [(values[1], i) for i, values in a.scan().inlined], "i long, row_id long")


SAMPLE = {"boolean": True, "int8": -5, "int16": 300, "int32": 70000, "int64": 2**40, "uint8": 200, "float64": 0.5, "date": dt.date(2020, 2, 29), "timestamp": dt.datetime(2020, 1, 1, 1, 2, 3), "varchar": "a'b, c", "blob": b"\x00\xff"}


@query("SELECT true AS boolean, -5 AS int8, 300 AS int16, 70000 AS int32, 1099511627776 AS int64, 200 AS uint8, 0.5 AS float64, '2020-02-29' AS date, '2020-01-01 01:02:03' AS timestamp, 'a''b, c' AS varchar, '00FF' AS blob, '[1,null]' AS l, 2 AS s, 7 AS m UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL")
def inline_types(spark, sf_dir):
    """Values of every type, and nulls, inlined and read back."""
    schema = Schema([*[Column(k, DataType(k)) for k in SAMPLE], Column("l", t.List(t.Int64())), Column("s", t.Struct({"a": t.Int64()})), Column("m", t.Map(t.Varchar(), t.Int64()))])
    a = fresh(spark).create_table("a", schema)
    a.append(spark.createDataFrame([(*SAMPLE.values(), [1, None], (2,), {"k": 7}), (None,) * (len(SAMPLE) + 3)], schema.spark()))
    text = {"date": F.date_format("date", "yyyy-MM-dd"), "timestamp": F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), "blob": F.hex("blob"), "l": F.when(F.col("l").isNotNull(), F.to_json("l")), "s": F.col("s.a").cast("int"), "m": F.col("m")["k"].cast("int")}
    whole = {"int8": "int", "int16": "int", "uint8": "int"}
    return a.to_df().select(*[(text[c] if c in text else F.col(c).cast(whole[c]) if c in whole else F.col(c)).alias(c) for c in schema.names()])


# -- definitions -----------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('main', 'b'), ('s', 'x'), ('s', 'y')) v(schema_name, table_name)")
def schemas_and_tables(spark, sf_dir):
    """Create, rename and drop; what is listed at the end."""
    lake = fresh(spark)
    for name in ("s", "gone"):
        lake.create_schema(name)
    for name in ("a", "s.x", "s.y", "gone.z", "dropped"):
        lake.create_table(name, {"i": t.Int64()})
    lake.get_table("a").rename("b")
    lake.get_table("dropped").delete()
    lake.delete_schema("gone", cascade=True)
    assert lake.list_schemas() == ["main", "s"] and not lake.has_table("a")
    return facts(spark, [tuple(n) for n in lake.list_tables()], "schema_name string, table_name string")


@query("SELECT * FROM (VALUES ('table', 'owner', 'me'), ('s.k', 'unit', 'm')) v(place, tag, value)")
def tags(spark, sf_dir):
    a = fresh(spark).create_table("a", Schema([Column("s", t.Struct({"k": t.Int64()}))]), tags={"old": "1"})
    a.add_tag("owner", "you")
    a.add_tag("owner", "me")
    a.remove_tag("old")
    a.add_column_tag(["s", "k"], "unit", "m")
    a.add_column_tag(["s", "k"], "gone", "x")
    a.remove_column_tag(["s", "k"], "gone")
    again = lakes.connect(spark, a.lake.store.url).get_table("a")
    return facts(spark, [("table", k, v) for k, v in again.tags.items()] + [("s.k", k, v) for k, v in again.schema["s"].data_type.children[0].tags.items()], "place string, tag string, value string")


@query("SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, 'later') AS n_name FROM nation UNION ALL SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END FROM nation")
def update_default(spark, sf_dir):
    """A new default holds for rows that are written later, in place of explicit nulls too."""
    df = nation(spark, sf_dir).select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("n_name"))
    a = load(fresh(spark), sf_dir, "a", df)
    a.update_column_default("n_name", "later")
    a.append(df)
    a.update_column_default("n_name", None)
    return a.to_df()


@query("SELECT * FROM (VALUES ('forbid where nulls are', 'InvalidNullabilityChangeError'), ('write a null', 'InvalidNullValueError'), ('write many nulls', 'InvalidNullValueError'), ('forbid where none are', ''), ('allow', ''), ('write a null again', '')) v(step, error)")
def nullability(spark, sf_dir):
    a = fresh(spark).create_table("a", Schema([Column("x", t.Int64()), Column("y", t.Int64())]))
    a.append(spark.sql("SELECT 1L AS x, CAST(NULL AS BIGINT) AS y"))
    nulls = lambda n: a.append(spark.range(n).selectExpr("CAST(NULL AS BIGINT) AS x", "id AS y"))
    steps = [("forbid where nulls are", lambda: a.update_column_nullability("y", False)), ("forbid where none are", lambda: a.update_column_nullability("x", False)), ("write a null", lambda: nulls(1)), ("write many nulls", lambda: nulls(30)), ("allow", lambda: a.update_column_nullability("x", True)), ("write a null again", lambda: nulls(1))]
    return facts(spark, [(n, refused(f)) for n, f in steps], "step string, error string")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(NULL AS DOUBLE) AS v FROM nation")
def update_schema(spark, sf_dir):
    """Columns by name: widened, added, removed, all at once."""
    a = load(fresh(spark), sf_dir, "nation")
    a.update_schema(Schema([Column("n_nationkey", t.Int64()), Column("v", t.Float64())]))
    return a.to_df()


@query("SELECT (SELECT count(*) * 2 FROM nation) AS n_rows, (SELECT count(DISTINCT n_regionkey) FROM nation) AS n_values, true AS cleared")
def update_partitioning(spark, sf_dir):
    """Files that were there stay; those that come later are partitioned."""
    a = load(fresh(spark), sf_dir, "nation")
    a.update_partitioning("n_regionkey")
    a.append(nation(spark, sf_dir))
    values = {r["partition_value"] for r in a.lake.store.rows("SELECT partition_value FROM {file_partition_value}")}
    a.update_partitioning(None)
    return facts(spark, [(a.to_df().count(), len(values), a.partitioning is None)], "n_rows long, n_values long, cleared boolean")


@query("SELECT n_nationkey, CAST(NULL AS VARCHAR) AS deep FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def nested_columns(spark, sf_dir):
    """A column inside a struct inside a struct, added and renamed by its path; files without it give null."""
    df = nation(spark, sf_dir)
    a = load(fresh(spark), sf_dir, "a", df.select("n_nationkey", F.struct(F.struct(F.col("n_regionkey").alias("r")).alias("inner")).alias("s")))
    a.add_column(Column("d", DataType("varchar")), parent=column_path("s.inner"))
    a.rename_column("s.inner.d", "deep")
    a.append(df.select("n_nationkey", F.struct(F.struct(F.col("n_regionkey").alias("r"), F.col("n_name").alias("deep")).alias("inner")).alias("s")))
    return a.to_df().select("n_nationkey", F.col("s.inner.deep").alias("deep"))


# -- transactions ----------------------------------------------------------------------------


@query("SELECT *, CAST(2 AS BIGINT) AS n_snapshots FROM region UNION ALL SELECT n_nationkey, n_name, 2 FROM nation")
def transaction_atomic(spark, sf_dir):
    """Two writes of one transaction are one snapshot; one that fails leaves nothing, nor does what is created and dropped."""
    lake, region = fresh(spark), source(spark, sf_dir, "region")
    with lake.transaction(author="a", message="both") as tx:
        a = tx.create_table("a", region.schema)
        a.append(region)
        a.append(nation(spark, sf_dir).select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name")))
        tx.create_table("never", {"i": t.Int64()}).delete()
        assert tx.list_schemas() == ["main"] and [n.name for n in tx.list_tables()] == ["a"]
    try:
        with lake.transaction() as tx:
            tx.table("a").append(region)
            raise ZeroDivisionError
    except ZeroDivisionError:
        pass
    with lake.transaction() as tx:
        tx.create_table("t", {"i": t.Int64()}).delete()
    return lake.get_table("a").to_df().withColumn("n_snapshots", F.lit(len(lake.list_snapshots())).cast("long"))


@query("""SELECT * FROM (VALUES ('append', 'append', true), ('append', 'alter', false), ('alter', 'append', true), ('alter', 'alter', false), ('delete', 'delete', false), ('append', 'delete', true), ('delete', 'append', true),
    ('drop', 'append', true), ('append', 'drop', false), ('drop', 'drop', false), ('create', 'create', false), ('alter', 'drop', false)) v(ours, theirs, committed)""")
def conflict_matrix(spark, sf_dir):
    """Which of two transactions that begin together may commit after the other."""
    lake = fresh(spark)
    lake.set_metadata(data_inlining_row_limit=0)
    rows = spark.range(20).select(F.col("id").alias("x"))
    work = {
        "append": lambda tx: tx.table("a").append(rows), "alter": lambda tx: tx.table("a").add_column(Column(f"c{uuid.uuid4().hex[:6]}", t.Int64())), "delete": lambda tx: tx.table("a").delete_where("x = 1"),
        "drop": lambda tx: tx.table("a").delete(), "create": lambda tx: tx.create_table("new", {"x": t.Int64()}),
    }
    out = []
    for ours, theirs in (("append", "append"), ("append", "alter"), ("alter", "append"), ("alter", "alter"), ("delete", "delete"), ("append", "delete"), ("delete", "append"), ("drop", "append"), ("append", "drop"), ("drop", "drop"), ("create", "create"), ("alter", "drop")):
        for name in [n.name for n in lake.list_tables()]:
            lake.get_table(name).delete()
        lake.create_table("a", {"x": t.Int64()}).append(rows)
        first, second = lake.transaction(), lake.transaction()
        work[theirs](first)
        work[ours](second)
        first.commit()
        out.append((ours, theirs, refused(second.commit) == ""))
    return facts(spark, out, "ours string, theirs string, committed boolean")


@query("SELECT * FROM (VALUES ('readonly append', 'ReadonlyLakeError'), ('pinned append', 'ReadonlyLakeError'), ('pinned rows', 'old'), ('readonly rows', 'new'), ('no snapshot', 'NotFoundError'), ('second lake', 'AlreadyInitializedError'), ('no lake', 'NotInitializedError')) v(what, outcome)")
def access_modes(spark, sf_dir):
    lake = fresh(spark)
    a = load(lake, sf_dir, "nation")
    pinned, follow, n = lake.at(lake.list_snapshots()[0].id), lake.readonly(), a.count()
    a.append(nation(spark, sf_dir))
    rows = lambda x: "old" if x.get_table("nation").count() == n else "new"
    url = lake.store.url
    return facts(spark, [
        ("readonly append", refused(lambda: follow.get_table("nation").append(nation(spark, sf_dir)))), ("pinned append", refused(lambda: pinned.get_table("nation").append(nation(spark, sf_dir)))), ("pinned rows", rows(pinned)), ("readonly rows", rows(follow)),
        ("no snapshot", refused(lambda: lake.at(99))), ("second lake", refused(lambda: lakes.create(spark, url, data_path="/tmp/none"))), ("no lake", refused(lambda: lakes.connect(spark, url + "2"))),
    ], "what string, outcome string")


@query("SELECT * FROM (VALUES ('lake', CAST(50 AS BIGINT)), ('schema', 30), ('table', 0), ('unset', 30), ('other', 50), ('default', 10)) v(scope, inline_limit)")
def option_scopes(spark, sf_dir):
    """An option of a table goes before one of its schema, that before one of the lake, that before the default."""
    lake = fresh(spark)
    lake.create_schema("s")
    a, other = lake.create_table("s.a", {"i": t.Int64()}), lake.create_table("b", {"i": t.Int64()})
    limit = lambda x: x.metadata()["data_inlining_row_limit"]
    out = [("default", limit(a))]
    lake.set_metadata(data_inlining_row_limit=50)
    out.append(("lake", limit(a)))
    lake.set_metadata(schema="s", data_inlining_row_limit=30)
    out.append(("schema", limit(a)))
    a.set_metadata(data_inlining_row_limit=0)
    out += [("table", limit(a)), ("other", limit(other))]
    a.set_metadata(data_inlining_row_limit=None)
    return facts(spark, [*out, ("unset", limit(a))], "scope string, inline_limit long")


#: What each version of the layout brought: statements that take it away again, from the newest on.
OLDER = {
    "0.4": ["ALTER TABLE {data_file} DROP COLUMN schema_version", "ALTER TABLE {file_column_stats} DROP COLUMN contains_nan"],
    "0.3": ["ALTER TABLE {schema_versions} DROP COLUMN table_id", "ALTER TABLE {column} DROP COLUMN default_value_type", "ALTER TABLE {column} DROP COLUMN default_value_dialect"],
    "0.2": ["DROP TABLE {schema_versions}", "ALTER TABLE {metadata} DROP COLUMN scope", "ALTER TABLE {metadata} DROP COLUMN scope_id", *(f"ALTER TABLE {{snapshot_changes}} DROP COLUMN {c}" for c in ("author", "commit_message", "commit_extra_info"))],
    "0.1": [*(f"ALTER TABLE {{{x}}} DROP COLUMN {c}" for x in ("schema", "table") for c in ("path", "path_is_relative")), "UPDATE {partition_column} SET column_id = column_id - 1"],
}


@query("SELECT v AS version, (SELECT count(*) * 2 FROM nation) AS n, 'OutdatedVersionError' AS refused, 'n_regionkey' AS partition_column, (SELECT count(DISTINCT n_regionkey) FROM nation) AS n_values FROM (VALUES ('0.1'), ('0.2'), ('0.3'), ('0.4')) x(v)")
def migrate_catalog(spark, sf_dir):
    """A catalog of each older layout is refused, then brought up to date; its rows and partitioning stay, and it takes new rows."""
    out = []
    for version in OLDER:
        lake = fresh(spark)
        load(lake, sf_dir, "nation", partition_by="n_regionkey")
        with lake.store.writing() as s:
            s.run("""UPDATE {metadata} SET value = ? WHERE "key" = 'version'""", version)
            for v, steps in OLDER.items():
                for text in steps if v >= version else []:
                    s.run(text)
        error = refused(lambda lake=lake: lakes.connect(spark, lake.store.url))
        with lakes.connect(spark, lake.store.url, migrate=True) as new:
            table = new.get_table("nation")
            table.append(nation(spark, sf_dir))
            values = {r["partition_value"] for r in new.store.rows("SELECT partition_value FROM {file_partition_value}")}
            out.append((version, table.to_df().count(), error, table.partitioning.columns[0].column, len(values)))
    return facts(spark, out, "version string, n long, refused string, partition_column string, n_values long")


@query("SELECT * FROM (VALUES ('dry', CAST(3 AS BIGINT)), ('snapshots', 4), ('orphans', 2), ('left', 0)) v(what, n)")
def maintenance_dry_runs(spark, sf_dir):
    """What would go is only listed; files that nothing knows are found."""
    lake = fresh(spark)
    a = load(lake, sf_dir, "nation")
    a.append(nation(spark, sf_dir))
    a.append(nation(spark, sf_dir))
    dry = lake.expire_snapshots(older_than=dt.timedelta(0), dry_run=True)
    spark.range(2).coalesce(2).repartition(2).write.parquet(f"{lake.data_path}main/stray")
    found = lake.delete_orphaned_files(cleanup_all=True, dry_run=True)
    lake.delete_orphaned_files(cleanup_all=True)
    return facts(spark, [("dry", len(dry)), ("snapshots", len(lake.list_snapshots())), ("orphans", len([p for p in found if "stray" in p])), ("left", len(lake.delete_orphaned_files(cleanup_all=True)))], "what string, n long")


# -- texts -----------------------------------------------------------------------------------

LITERALS = [
    (t.Boolean(), True), (t.Int8(), -5), (t.UInt64(), 2**64 - 1), (t.Float64(), 1.5), (t.Decimal(10, 2), decimal.Decimal("1.20")), (t.Date(), dt.date(2020, 1, 2)), (t.Time(), dt.time(3, 4, 5)), (t.Uuid(), "3f2504e0-4f89-41d3-9a0c-0305e82c3301"),
    (t.TimeTz(), "03:04:05+02"), (t.Timestamp(), dt.datetime(2020, 1, 2, 3, 4, 5)), (t.TimestampTz(), dt.datetime(2020, 1, 2, 3, tzinfo=dt.UTC)), (t.Interval(), (14, 86_400_000_001)), (t.Blob(), b"\x01\xff"), (t.Varchar(), "it's"), (t.List(t.Int64()), [1, None, 3]),
    (t.Struct({"a": t.Int64(), "b": t.Varchar()}), {"a": 1, "b": "it's"}), (t.Map(t.Varchar(), t.Int64()), {"k": 1, "l": None}), (t.Varchar(), None),
]


@query(r"""SELECT * FROM (VALUES (1, 'boolean', '1'), (2, 'int8', '-5'), (3, 'uint64', '18446744073709551615'), (4, 'float64', '1.5'), (5, 'decimal(10, 2)', '1.20'), (6, 'date', '2020-01-02'), (7, 'time', '03:04:05'), (8, 'uuid', '3f2504e0-4f89-41d3-9a0c-0305e82c3301'),
    (9, 'timetz', '03:04:05+02'), (10, 'timestamp', '2020-01-02 03:04:05'), (11, 'timestamptz', '2020-01-02T03:00:00+00:00'), (12, 'interval', '1 years 2 months 1 days 00:00:00.000001'), (13, 'blob', '01ff'), (14, 'varchar', 'it''s'), (15, 'list', '[1, NULL, 3]'),
    (16, 'struct', '{''a'': 1, ''b'': ''it\''s''}'), (17, 'map', '{k=1, l=NULL}'), (18, 'varchar', 'NULL')) v(i, kind, literal), (VALUES (true)) w(round_trip)""")
def literals(spark, sf_dir):
    """The catalog's text of a value of each type, and whether it reads back as the value."""
    return facts(spark, [(i, str(k), format_value(v, k), parse_value(format_value(v, k), k) == v) for i, (k, v) in enumerate(LITERALS, 1)], "i int, kind string, literal string, round_trip boolean")


@query("""SELECT * FROM (VALUES ('a', 'main', 'a'), ('s.a', 's', 'a'), ('"s.1"."a""b"', 's.1', 'a"b'), ('a."b"', NULL, 'ValueError'), ('a.b.c', NULL, 'ValueError')) v(name, schema_name, table_name)""")
def identifiers(spark, sf_dir):
    names = ("a", "s.a", '"s.1"."a""b"', 'a."b"', "a.b.c")
    return facts(spark, [(n, None, refused(lambda n=n: table_name(n))) if refused(lambda n=n: table_name(n)) else (n, *table_name(n)) for n in names], "name string, schema_name string, table_name string")


@query("""SELECT * FROM (VALUES ('i', 'int32', 'int'), ('u', 'uint32', 'bigint'), ('s', 'varchar', 'string'), ('d', 'varchar', 'string'), ('n', 'decimal(9, 2)', 'decimal(9,2)'), ('z', 'timestamptz', 'timestamp'), ('m', 'timestamp_ms', 'timestamp_ntz'), ('l', 'list', 'array<double>'), ('t', 'struct', 'struct<x:boolean>'), ('p', 'map', 'map<string,date>')) v(name, kind, spark)""")
def arrow_schema(spark, sf_dir):
    """Types of an Arrow schema in the lake, and what they are in Spark."""
    schema = pa.schema([("i", pa.int32()), ("u", pa.uint32()), ("s", pa.large_string()), ("d", pa.dictionary(pa.int32(), pa.string())), ("n", pa.decimal128(9, 2)), ("z", pa.timestamp("us", "UTC")), ("m", pa.timestamp("ms")), ("l", pa.list_(pa.float64())), ("t", pa.struct([("x", pa.bool_())])), ("p", pa.map_(pa.string(), pa.date32()))])
    own = Schema(schema)
    return facts(spark, [(c.name, str(c.data_type), f.dataType.simpleString()) for c, f in zip(own.columns, own.spark())], "name string, kind string, spark string")


@query("SELECT * FROM (VALUES ('join', 'a/b'), ('absolute', '/b'), ('relative', 'c'), ('outside', '/x'), ('plain', '/a/b'), ('s3', 's3a://x/y'), ('key', 'u'), ('account', 'k')) v(what, path)")
def paths_and_settings(spark, sf_dir):
    azure = storage_settings({"AZURE_STORAGE_ACCOUNT_NAME": "n", "AZURE_STORAGE_ACCOUNT_KEY": "k"}, {})
    assert absolute("/a") and not absolute("a") and os.sep == "/"
    rows = [("join", join("a/", "b")), ("absolute", join("a", "/b")), ("relative", relative_to("file:/a/b/c", "/a/b/")[0]), ("outside", relative_to("/x", "/a")[0]), ("plain", plain("file:///a/b")), ("s3", plain("s3://x/y")),
            ("key", storage_settings({"aws_access_key_id": "u"}, {"AWS_ACCESS_KEY_ID": "e"})["fs.s3a.access.key"]), ("account", azure["fs.azure.account.key.n.dfs.core.windows.net"])]
    return facts(spark, rows, "what string, path string")
