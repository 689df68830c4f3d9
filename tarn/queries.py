"""The registry: one query for each operator of the lake, over the driver's tables, and the same in SQL.

Each builds a lake in a fresh place, loads the tables that it needs, runs the operator and returns a DataFrame.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lake as lakes
from .sources.storage import Files
from .types import Column, DataType
from .types import List as ListOf
from .types import Schema, Struct

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def fresh(spark: SparkSession, zone: str = "UTC") -> lakes.Lake:
    """A lake whose catalog is with the driver, and whose data is in the shared folder that a cluster must name."""
    local = tempfile.mkdtemp(prefix="tarn-lake-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    data = f"{shared.rstrip('/')}/tarn-lake-{uuid.uuid4().hex}" if shared else f"{local}/data"
    return lakes.create(spark, f"sqlite:///{local}/catalog.db", data_path=data, time_zone=zone)


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(lake: lakes.Lake, sf_dir: str, name: str, df: DataFrame | None = None, **kw) -> lakes.LakeTable:
    df = source(lake.spark, sf_dir, name) if df is None else df
    with lake.transaction() as tx:
        tx.create_table(name, df.schema, **kw).append(df)
    return lake.get_table(name)


# -- scans, projections, filters -------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    df = load(fresh(spark), sf_dir, "lineitem").to_df()
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT * FROM orders")
def scan_full(spark, sf_dir):
    return load(fresh(spark), sf_dir, "orders").to_df()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def scan_project_filter(spark, sf_dir):
    return load(fresh(spark), sf_dir, "orders").to_df().where("o_totalprice > 100000").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 200 AND 400 AND o_custkey IS NOT NULL")
def scan_pruned_where(spark, sf_dir):
    lake, df = fresh(spark), source(spark, sf_dir, "orders")
    t = lake.create_table("orders", df.schema)
    for k in range(4):
        t.append(df.where(F.pmod(F.floor(F.col("o_orderkey") / 500), F.lit(4)) == k))
    return t.to_df("o_orderkey BETWEEN 200 AND 400 AND o_custkey IS NOT NULL").select("o_orderkey", "o_custkey")


@query("SELECT *, false AS in_file FROM region UNION ALL SELECT r_regionkey, r_name, false FROM region UNION ALL SELECT n_nationkey, n_name, true FROM nation")
def inline_then_file(spark, sf_dir):
    """Small writes are rows of the catalog, others files; a scan is both, and tells which by the path."""
    lake, region = fresh(spark), source(spark, sf_dir, "region")
    t = load(lake, sf_dir, "region", region)
    t.append(region)
    t.append(source(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name")))
    return t.to_df(include_file_paths="path").select("r_regionkey", "r_name", F.col("path").isNotNull().alias("in_file"))


@query("SELECT vec_id, label, embedding FROM embeddings WHERE label < 3")
def scan_arrays(spark, sf_dir):
    return load(fresh(spark), sf_dir, "embeddings").to_df("label < 3").select("vec_id", "label", "embedding")


@query("SELECT (SELECT count(*) FROM lineitem) AS n_files_rows, (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R') AS n_left")
def count_from_catalog(spark, sf_dir):
    t = load(fresh(spark), sf_dir, "lineitem")
    n = t.count()
    t.delete_where("l_returnflag = 'R'")
    return spark.createDataFrame([(n, t.count())], "n_files_rows long, n_left long")


# -- time travel and snapshots ---------------------------------------------------------------


@query("SELECT * FROM orders WHERE o_orderkey % 2 = 0")
def time_travel_v1(spark, sf_dir):
    lake, df = fresh(spark), source(spark, sf_dir, "orders")
    load(lake, sf_dir, "orders", df.where("o_orderkey % 2 = 0"))
    lake.get_table("orders").append(df.where("o_orderkey % 2 <> 0"))
    lake.get_table("orders").delete_where("o_orderkey < 100")
    return lake.at(1).get_table("orders").to_df()


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)), (1, 1, NULL, NULL), (2, 1, 'me', 'more'), (3, 2, NULL, NULL)) t(snapshot_id, schema_version, author, commit_message)")
def snapshot_log(spark, sf_dir):
    lake = fresh(spark)
    t = load(lake, sf_dir, "nation")
    with lake.transaction(author="me", message="more") as tx:
        tx.table("nation").append(source(spark, sf_dir, "nation"))
    t.rename_column("n_name", "name")
    return lake.snapshots().select("snapshot_id", "schema_version", "author", "commit_message")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def snapshot_of_schema(spark, sf_dir):
    """The newest snapshot of a version of the schema."""
    lake = fresh(spark)
    t = load(lake, sf_dir, "nation")
    t.rename_column("n_name", "name")
    t.append(source(spark, sf_dir, "nation").withColumnRenamed("n_name", "name"))
    return lake.at_schema_version(1).get_table("nation").to_df()


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'created_schema:\"main\"'), (1, 'created_table:\"main\".\"nation\",inserted_into_table:1'), (2, 'altered_table:1'), (3, 'deleted_from_table:1')) t(snapshot_id, changes_made)")
def changes_log(spark, sf_dir):
    lake = fresh(spark)
    t = load(lake, sf_dir, "nation")
    t.rename_column("n_name", "name")
    t.set_metadata(data_inlining_row_limit=0)
    t.delete_where("n_nationkey < 5")
    return lake.snapshots().select("snapshot_id", "changes_made")


# -- deletes ---------------------------------------------------------------------------------


@query("SELECT * FROM lineitem WHERE NOT (l_returnflag = 'R')")
def delete_positional(spark, sf_dir):
    t = load(fresh(spark), sf_dir, "lineitem")
    t.delete_where("l_returnflag = 'R'")
    return t.to_df()


@query("SELECT * FROM lineitem WHERE NOT (l_returnflag = 'R') AND NOT (l_orderkey = 1) AND NOT (l_quantity > 45)")
def delete_inline_plus_file(spark, sf_dir):
    t = load(fresh(spark), sf_dir, "lineitem")
    t.delete_where("l_returnflag = 'R'")
    t.delete_where("l_orderkey = 1")
    t.delete_where("l_quantity > 45")
    return t.to_df()


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders")
def sql_update(spark, sf_dir):
    lake = fresh(spark)
    load(lake, sf_dir, "orders")
    lake.execute_sql("UPDATE orders SET o_totalprice = 0 WHERE o_orderstatus = 'F'")
    return lake.sql("SELECT o_orderkey, o_totalprice FROM orders")


def mixed_deletes(spark, sf_dir, large: str) -> lakes.LakeTable:
    """Few rows deleted in the catalog, then many by a file that takes their place."""
    t = load(fresh(spark), sf_dir, "orders")
    t.delete_where("o_orderkey BETWEEN 1 AND 8")
    t.delete_where(large)
    return t


def with_count(t: lakes.LakeTable) -> DataFrame:
    return t.to_df().withColumn("n_catalog", F.lit(t.count()).cast("long"))


@query("WITH x AS (SELECT * FROM orders WHERE NOT (o_orderkey BETWEEN 1 AND 8) AND NOT (o_orderkey < 300)) SELECT *, (SELECT count(*) FROM x) AS n_catalog FROM x")
def delete_small_then_large(spark, sf_dir):
    return with_count(mixed_deletes(spark, sf_dir, "o_orderkey < 300"))


@query("WITH x AS (SELECT * FROM orders WHERE NOT (o_orderkey BETWEEN 1 AND 8) AND o_orderkey % 3 = 0) SELECT *, (SELECT count(*) FROM x) AS n_catalog, CAST(0 AS BIGINT) AS n_deletes FROM x")
def rewrite_after_mixed_deletes(spark, sf_dir):
    t = mixed_deletes(spark, sf_dir, "o_orderkey % 3 <> 0")
    t.rewrite_data_files(delete_threshold=0.3)
    return with_count(t).withColumn("n_deletes", F.lit(sum(f.deleted() for f in t.scan().files)).cast("long"))


@query("WITH x AS (SELECT * FROM orders WHERE NOT (o_orderkey BETWEEN 1 AND 8) AND o_orderkey % 40 = 0) SELECT *, (SELECT count(*) FROM x) AS n_catalog FROM x")
def checkpoint_after_mixed_deletes(spark, sf_dir):
    t = mixed_deletes(spark, sf_dir, "o_orderkey % 40 <> 0")
    t.lake.checkpoint()
    return with_count(t)


@query("SELECT o_orderkey, o_custkey AS o_totalprice, CAST(floor(o_totalprice) AS BIGINT) AS o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_totalprice, o_custkey FROM orders WHERE o_orderstatus <> 'F'")
def sql_update_swap(spark, sf_dir):
    """All new values come from the old row; texts may hold what looks like syntax."""
    lake = fresh(spark)
    load(lake, sf_dir, "orders")
    lake.execute_sql("UPDATE orders AS o SET o_custkey = CAST(floor(o.o_totalprice) AS BIGINT), o_totalprice = o_custkey WHERE o_orderstatus = 'F' AND o_orderpriority <> 'a, b = where c' -- orders")
    return lake.sql("SELECT o_orderkey, o_totalprice, o_custkey FROM orders")


@query("WITH nation AS (SELECT r_regionkey AS x FROM region) SELECT n.x, r.r_name AS customer FROM nation n JOIN region r ON n.x = r.r_regionkey GROUP BY n.x, r.r_name")
def sql_cte_shadow(spark, sf_dir):
    """A name that a WITH clause defines hides the table; names in comments and of columns are none."""
    lake = fresh(spark)
    for t in ("nation", "region", "customer"):
        load(lake, sf_dir, t)
    return lake.sql("WITH nation AS (SELECT r_regionkey AS x FROM /* of nation */ main.region) SELECT n.x, r.r_name AS customer FROM nation n, -- customer\n region r WHERE n.x = r.r_regionkey GROUP BY n.x, r.r_name")


@query("SELECT * FROM customer WHERE NOT (c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000))")
def sql_delete(spark, sf_dir):
    lake = fresh(spark)
    for t in ("customer", "orders"):
        load(lake, sf_dir, t)
    lake.execute_sql("DELETE FROM customer c WHERE c.c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
    return lake.sql("SELECT * FROM customer")


@query("SELECT n_nationkey + 100 AS id, n_name AS label, CAST(NULL AS INTEGER) AS r FROM nation UNION ALL SELECT r_regionkey, 'it''s, x = 1', 7 FROM region")
def sql_insert_select(spark, sf_dir):
    lake = fresh(spark)
    for t in ("nation", "region"):
        load(lake, sf_dir, t)
    lake.execute_sql("CREATE TABLE x (id INT, label STRING, r INT)")
    lake.execute_sql("INSERT INTO x (label, id) SELECT n_name, n_nationkey + 100 FROM nation")
    lake.execute_sql("INSERT INTO x WITH nation AS (SELECT * FROM region) SELECT r_regionkey, 'it\\'s, x = 1', 7 FROM nation")
    return lake.sql("SELECT * FROM x")


@query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 4 = 1 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 4 = 1 UNION ALL SELECT s_suppkey + 1000000, 'new', 0, NULL FROM supplier WHERE s_suppkey % 10 = 0")
def sql_merge(spark, sf_dir):
    """Updates, deletes and inserts of one MERGE are one commit."""
    lake = fresh(spark)
    t = load(lake, sf_dir, "supplier")
    df = source(spark, sf_dir, "supplier")
    load(lake, sf_dir, "news", df.where("s_suppkey % 2 = 1").select("s_suppkey").union(df.where("s_suppkey % 10 = 0").selectExpr("s_suppkey + 1000000")))
    lake.execute_sql("MERGE INTO supplier s USING news n ON s.s_suppkey = n.s_suppkey WHEN MATCHED AND n.s_suppkey % 4 = 1 THEN UPDATE SET s_acctbal = s.s_acctbal * 2 WHEN MATCHED THEN DELETE WHEN NOT MATCHED THEN INSERT (s_suppkey, s_name, s_nationkey) VALUES (n.s_suppkey, 'new', 0)")
    return t.to_df()


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS label, CAST(NULL AS DOUBLE) AS z FROM nation")
def sql_alter(spark, sf_dir):
    lake = fresh(spark)
    load(lake, sf_dir, "nation")
    for text in ("ALTER COLUMN n_nationkey TYPE BIGINT", "RENAME COLUMN n_nationkey TO id", "RENAME COLUMN n_name TO label", "DROP COLUMN n_regionkey", "ADD COLUMN z DOUBLE", "RENAME TO lands"):
        lake.execute_sql(f"ALTER TABLE nation {text}")
    return lake.sql("SELECT * FROM lands")


# -- types -----------------------------------------------------------------------------------


@contextlib.contextmanager
def zoned(spark: SparkSession, zone: str):
    """Another time zone for as long as Spark resolves a query, which keeps it."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


EPOCH = "CAST(epoch_us(o_orderdate) AS BIGINT)"


def instants(spark, sf_dir, offset: int = 0) -> DataFrame:
    """Orders with their dates as instants: midnights of UTC, or ``offset`` seconds later."""
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    return source(spark, sf_dir, "orders").select("o_orderkey", F.timestamp_seconds(day * 86400 + offset).alias("at"))


@query(f"SELECT o_orderkey, {EPOCH} + 18000000000 AS us FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'")
def scan_pruned_zone(spark, sf_dir):
    """A text is a time of the session's zone, for file pruning too: 1996-12-31 21:00 in Los Angeles is 05:00 in UTC a day later."""
    lake = fresh(spark)
    t = load(lake, sf_dir, "orders", instants(spark, sf_dir, 18000).where("year(at) < 1997").coalesce(1))
    t.sink(instants(spark, sf_dir, 18000).where("year(at) >= 1997").coalesce(1))
    with zoned(spark, "America/Los_Angeles"):
        df = t.to_df("at < '1996-12-31 21:00:00'")
    return df.select("o_orderkey", F.unix_micros("at").alias("us"))


@query(f"SELECT o_orderkey, {EPOCH} AS us, CAST(o_orderdate AS VARCHAR)[:10] AS day FROM orders WHERE o_orderkey < 500 UNION ALL SELECT o_orderkey, {EPOCH}, CAST(o_orderdate AS VARCHAR)[:10] FROM orders WHERE o_orderkey < 5")
def scan_timestamptz(spark, sf_dir):
    """Instants inlined and in files, read back as instants and as wall-clock time of a zone."""
    lake = fresh(spark)
    df = instants(spark, sf_dir)
    t = load(lake, sf_dir, "t", df.where("o_orderkey < 500"))
    t.append(df.where("o_orderkey < 5"))
    wall = t.to_df(time_zone="Europe/London").select(F.col("o_orderkey").alias("k"), F.col("at").alias("wall")).distinct()
    out = t.to_df("at >= timestamp'1900-01-01 00:00:00Z'")
    return out.join(wall, out.o_orderkey == wall.k).select("o_orderkey", F.unix_micros("at").alias("us"), F.date_format("wall", "yyyy-MM-dd").alias("day"))


@query("SELECT n_nationkey * 10 AS a, n_nationkey * 2600 AS b, CAST(n_nationkey AS BIGINT) * 170000000 AS c, CAST(n_nationkey AS DECIMAL(38,0)) * 768614336404564650 AS d FROM nation UNION ALL SELECT 255, 65535, 4294967295, 18446744073709551615")
def scan_unsigned(spark, sf_dir):
    """Integers without a sign up to their largest, inlined and in files."""
    t = fresh(spark).create_table("t", Schema([Column(n, DataType(k)) for n, k in (("a", "uint8"), ("b", "uint16"), ("c", "uint32"), ("d", "uint64"))]))
    n = source(spark, sf_dir, "nation")
    d = "decimal(20,0)"
    t.append(n.select((F.col("n_nationkey") * 10).alias("a"), (F.col("n_nationkey") * 2600).alias("b"), (F.col("n_nationkey").cast("long") * 170000000).alias("c"), (F.col("n_nationkey").cast(d) * F.lit(768614336404564650).cast(d)).cast(d).alias("d")))
    t.append(n.limit(1).select(F.lit(255).alias("a"), F.lit(65535).alias("b"), F.lit(4294967295).alias("c"), F.lit("18446744073709551615").cast(d).alias("d")))
    return t.to_df().select("a", "b", "c", F.col("d").cast("decimal(38,0)").alias("d"))


# -- schema evolution ------------------------------------------------------------------------


@query("SELECT *, 42 AS y, CAST(NULL AS DOUBLE) AS z FROM nation UNION ALL SELECT *, 7, 1.5 FROM nation")
def evolve_add_default(spark, sf_dir):
    lake, df = fresh(spark), source(spark, sf_dir, "nation")
    t = load(lake, sf_dir, "nation", df)
    t.add_column(Column("y", DataType("int32"), initial_default=42))
    t.add_column(Column("z", DataType("float64")))
    t.append(df.withColumn("y", F.lit(7)).withColumn("z", F.lit(1.5)))
    return t.to_df()


@query("SELECT n_nationkey AS id, n_name AS label, n_regionkey FROM nation")
def evolve_rename_column(spark, sf_dir):
    t = load(fresh(spark), sf_dir, "nation")
    t.rename_column("n_nationkey", "id")
    t.rename_column("n_name", "label")
    return t.to_df("id >= 0")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 5000000000, n_name, n_regionkey FROM nation")
def evolve_promote_int(spark, sf_dir):
    lake, df = fresh(spark), source(spark, sf_dir, "nation")
    t = load(lake, sf_dir, "nation", df)
    t.update_column_dtype("n_nationkey", DataType("int64"))
    t.append(df.withColumn("n_nationkey", F.col("n_nationkey") + F.lit(5000000000)))
    return t.to_df()


@query("SELECT n_nationkey, n_regionkey, CAST(NULL AS VARCHAR) AS n_name FROM nation")
def evolve_remove_readd(spark, sf_dir):
    t = load(fresh(spark), sf_dir, "nation")
    t.remove_column("n_name")
    t.add_column(Column("n_name", DataType("varchar")))
    return t.to_df()


@query("SELECT r_regionkey AS k, r_name AS v, CAST(NULL AS INTEGER) AS w FROM region UNION ALL SELECT n_nationkey, n_name, NULL FROM nation")
def nested_struct_reshape(spark, sf_dir):
    """A struct, inlined and in files, with a renamed and an added field."""
    lake = fresh(spark)
    t = lake.create_table("t", Schema([Column("s", Struct([Column("a", DataType("int32")), Column("b", DataType("varchar"))]))]))
    t.append(source(spark, sf_dir, "region").select(F.struct(F.col("r_regionkey").alias("a"), F.col("r_name").alias("b")).alias("s")))
    t.append(source(spark, sf_dir, "nation").select(F.struct(F.col("n_nationkey").alias("a"), F.col("n_name").alias("b")).alias("s")))
    t.rename_column(["s", "b"], "c")
    t.add_column(Column("d", DataType("int32")), parent=["s"])
    return t.to_df().select(F.col("s.a").alias("k"), F.col("s.c").alias("v"), F.col("s.d").alias("w"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'none' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_nationkey END AS n FROM customer")
def default_fill(spark, sf_dir):
    lake = fresh(spark)
    t = lake.create_table("c", Schema([Column("c_custkey", DataType("int64")), Column("c_mktsegment", DataType("varchar"), default_value="none"), Column("l", ListOf(Column("element", DataType("int32"), default_value=-1)))]))
    df = source(spark, sf_dir, "customer")
    t.append(df.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), F.array(F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey"))).alias("l")))
    return t.to_df().select("c_custkey", "c_mktsegment", F.col("l")[0].alias("n"))


# -- partitions and files --------------------------------------------------------------------


def partitioned(table: str, column: str, how: str):
    def run(spark, sf_dir):
        t = load(fresh(spark), sf_dir, table, partition_by=[(column, how)])
        n = spark.createDataFrame([(len({tuple(r.values()) for r in t.lake.store.rows("SELECT partition_value FROM {file_partition_value}")}),)], "n_partitions long")
        return t.to_df().groupBy().agg(F.count("*").alias("n_rows")).crossJoin(n)

    return run


for _how, _sql in (("year", "year"), ("month", "month"), ("day", "day"), ("hour", "hour")):
    QUERIES[f"partition_{_how}"] = partitioned("orders", "o_orderdate", _how)
    ORACLES[f"partition_{_how}"] = f"SELECT count(*) AS n_rows, count(DISTINCT {_sql}(o_orderdate)) AS n_partitions FROM orders"
QUERIES["partition_identity"] = partitioned("lineitem", "l_returnflag", "identity")
ORACLES["partition_identity"] = "SELECT count(*) AS n_rows, count(DISTINCT l_returnflag) AS n_partitions FROM lineitem"
QUERIES["partition_bucket"] = partitioned("orders", "o_orderkey", "bucket(8)")
ORACLES["partition_bucket"] = "SELECT count(*) AS n_rows, CAST(8 AS BIGINT) AS n_partitions FROM orders"


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def register_files(spark, sf_dir):
    """Files that another table's writer made, added without a copy."""
    lake = fresh(spark)
    a = load(lake, sf_dir, "part")
    b = lake.create_table("other", a.schema)
    b.write_data_files([f.path for f in a.scan().files])
    return b.to_df().groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, CAST(count(*) - count(o_custkey) AS BIGINT) AS nulls FROM orders")
def file_column_stats(spark, sf_dir):
    t = load(fresh(spark), sf_dir, "orders")
    files, ids = t.scan().files, {c.name: c.field_id for c in t.schema.columns}
    key, cust = [f.stats[ids["o_orderkey"]] for f in files], [f.stats[ids["o_custkey"]] for f in files]
    return spark.createDataFrame([(min(x.min for x in key), max(x.max for x in key), sum(x.nulls for x in cust))], "lo long, hi long, nulls long")


# -- upkeep ----------------------------------------------------------------------------------


@query("SELECT *, 1 AS n_files FROM supplier")
def merge_adjacent(spark, sf_dir):
    lake, df = fresh(spark), source(spark, sf_dir, "supplier")
    t = lake.create_table("supplier", df.schema)
    t.set_metadata(data_inlining_row_limit=0)
    for k in range(3):
        t.append(df.where(F.col("s_suppkey") % 3 == k))
    t.merge_adjacent_files()
    return t.to_df().withColumn("n_files", F.lit(len(t.scan().files)))


@query("SELECT *, 0 AS n_deletes FROM supplier WHERE s_suppkey % 4 = 0")
def rewrite_deleted(spark, sf_dir):
    lake, df = fresh(spark), source(spark, sf_dir, "supplier")
    t = lake.create_table("supplier", df.schema)
    t.set_metadata(data_inlining_row_limit=0)
    t.append(df)
    t.delete_where("s_suppkey % 4 <> 0")
    t.rewrite_data_files(delete_threshold=0.5)
    return t.to_df().withColumn("n_deletes", F.lit(sum(f.deleted() for f in t.scan().files)))


@query("SELECT *, 0 AS n_inlined FROM region")
def flush_inline(spark, sf_dir):
    t = load(fresh(spark), sf_dir, "region")
    t.flush_inlined()
    return t.to_df().withColumn("n_inlined", F.lit(len(t.scan().inlined)))


@query("SELECT *, CAST(1 AS BIGINT) AS n_snapshots FROM orders WHERE o_orderkey >= 100")
def expire_then_scan(spark, sf_dir):
    import datetime as dt

    lake = fresh(spark)
    t = load(lake, sf_dir, "orders")
    t.delete_where("o_orderkey < 100")
    t.merge_adjacent_files()
    lake.expire_snapshots(older_than=dt.timedelta(0))
    lake.cleanup_old_files(cleanup_all=True)
    lake.delete_orphaned_files(cleanup_all=True)
    return t.to_df().withColumn("n_snapshots", F.lit(len(lake.list_snapshots())).cast("long"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_append(spark, sf_dir):
    """A stream of files into a table, one commit for each batch."""
    import os

    from .streaming.sink import append_stream

    lake, df = fresh(spark), source(spark, sf_dir, "events")
    t = lake.create_table("events", df.schema)
    with_glob = f"{sf_dir}/events.parquet" if os.path.isdir(f"{sf_dir}/events.parquet") else f"{sf_dir}/events.parquet*"
    stream = spark.readStream.schema(df.schema).parquet(with_glob)
    q = append_stream(t, stream, f"{lake.data_path}_checkpoint", availableNow=True)
    q.awaitTermination()
    return t.to_df().groupBy("event_type").agg(F.count("*").alias("n"))


def stream_of(spark, sf_dir, lake, table: str, name: str, t) -> None:
    """All files of a table as a stream with a checkpoint of its own."""
    import os

    from .streaming.sink import append_stream

    path = f"{sf_dir}/{table}.parquet"
    stream = spark.readStream.schema(source(spark, sf_dir, table).schema).parquet(path if os.path.isdir(path) else path + "*")
    append_stream(t, stream, f"{lake.data_path}_checkpoint_{name}", availableNow=True).awaitTermination()


@query("SELECT event_id, count(*) AS n FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events) GROUP BY event_id")
def stream_two_sources(spark, sf_dir):
    """Two streams into one table, and one of them started again, which adds nothing."""
    lake = fresh(spark)
    t = lake.create_table("events", source(spark, sf_dir, "events").schema)
    for name in ("one", "two", "one"):
        stream_of(spark, sf_dir, lake, "events", name, t)
    return t.to_df().groupBy("event_id").agg(F.count("*").alias("n"))


#: Events of a micro-batch, about.
BATCH_EVENTS = 1_000_000


def in_time_order(events: DataFrame, folder: str) -> Iterator[None]:
    """Events into files of about BATCH_EVENTS rows each, in the order of time; at each turn one more is there."""
    n = -(-events.count() // BATCH_EVENTS)
    if n <= 1:
        events.coalesce(1).write.parquet(f"{folder}/a")
        yield
        return
    spark, staged = events.sparkSession, f"{folder}_staged"
    events.repartitionByRange(n, "ts").withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(staged)
    for k in range(n):
        if Files(spark).exists(f"{staged}/part={k}"):
            spark.read.schema(events.schema).parquet(f"{staged}/part={k}").coalesce(1).write.parquet(f"{folder}/a{k:06}")
            yield
    Files(spark).delete(staged)


def append_stream_of(lake, t, out: DataFrame):
    """What a stream has to read by now, to its end."""
    from .streaming.sink import append_stream

    q = append_stream(t, out, f"{lake.data_path}_checkpoint", availableNow=True)
    q.awaitTermination()
    return q


def windowed(spark, sf_dir, shape, delay: str = "1 hour") -> DataFrame:
    """Counts by window of event time over a stream with a watermark; a last event far ahead closes all windows.

    The stream's results are appended to a table of a lake, one commit a batch.  Batches have a bounded size and come in the order of
    time, and the stream ends after each with one that has no rows: that closes windows before the next, which takes up all sessions
    that are still open.
    """
    lake, events = fresh(spark), source(spark, sf_dir, "events").select(F.concat(F.col("ts").cast("timestamp_ntz").cast("string"), F.lit("Z")).cast("timestamp").alias("ts"), "event_type", "value")
    folder = f"{lake.data_path}_in"
    far = events.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    turns = in_time_order(events, folder)
    next(turns)  # the stream needs the folder
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)
    out = stream.withWatermark("ts", delay).groupBy(shape.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("begin"), F.unix_seconds("w.end").alias("finish"), "event_type", "n")
    t = lake.create_table("counts", out.schema)
    append_stream_of(lake, t, out)
    for _ in turns:
        append_stream_of(lake, t, out)
    far.coalesce(1).write.parquet(f"{folder}/b")
    append_stream_of(lake, t, out)
    return t.to_df().where("event_type <> 'end'")


@query("SELECT begin, begin + 3600 AS finish, event_type, count(*) AS n FROM (SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS begin, event_type FROM events) GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    return windowed(spark, sf_dir, F.window("ts", "1 hour"))


@query("SELECT begin, begin + 7200 AS finish, event_type, count(*) AS n FROM (SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) - 3600 * k AS begin, event_type FROM events, (VALUES (0), (1)) x(k)) GROUP BY ALL")
def stream_sliding(spark, sf_dir):
    return windowed(spark, sf_dir, F.window("ts", "2 hours", "1 hour"))


@query("""WITH a AS (SELECT event_type, epoch_us(ts) AS t FROM events), b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY event_type ORDER BY t) < 60000000 THEN 0 ELSE 1 END AS new FROM a),
    c AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM b)
    SELECT event_type, CAST(floor(min(t) / 1000000) AS BIGINT) AS begin, CAST(floor((max(t) + 60000000) / 1000000) AS BIGINT) AS finish, count(*) AS n FROM c GROUP BY event_type, g""")
def stream_session(spark, sf_dir):
    return windowed(spark, sf_dir, F.session_window("ts", "1 minute"))


# -- what Spark brings: relational operators on the lake's tables -----------------------------


def relational(name: str, tables: str, spark_sql: str, oracle: str | None = None):
    """A query in SQL over tables of a lake; ``oracle`` where DuckDB spells it otherwise."""

    def run(spark, sf_dir):
        lake = fresh(spark)
        for t in tables.split():
            load(lake, sf_dir, t)
        return lake.sql(spark_sql)

    QUERIES[name] = run
    ORACLES[name] = oracle or spark_sql


relational("join_inner", "customer orders", "SELECT c.c_name, count(*) AS n, round(sum(o.o_totalprice), 2) AS total FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_name")
relational("join_left", "customer orders", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey")
relational("join_right", "customer orders", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey")
relational("join_full", "nation supplier", "SELECT n.n_name, s.s_suppkey FROM nation n FULL JOIN supplier s ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 5000")
relational("join_semi", "customer orders", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
relational("join_anti", "customer orders", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
relational("join_cross", "region nation", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
relational("join_range", "nation region", "SELECT n.n_nationkey, r.r_regionkey FROM nation n JOIN region r ON n.n_nationkey BETWEEN r.r_regionkey * 5 AND r.r_regionkey * 5 + 6")
relational("agg_distinct", "lineitem", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, count(DISTINCT l_partkey, l_suppkey) AS m FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, count(DISTINCT (l_partkey, l_suppkey)) AS m FROM lineitem GROUP BY l_returnflag")
relational("agg_cube", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
relational("agg_rollup", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
relational("agg_grouping_sets", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
relational("agg_having", "lineitem", "SELECT l_orderkey, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150")
relational("win_row_number", "orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS rn FROM orders")
relational("win_rank", "customer", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS r, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS d, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS t FROM customer", "SELECT c_custkey, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS d, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS t FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)")
relational("win_lag_lead", "orders", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before_key, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after_key, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS first_key FROM orders")
relational("win_frame_rows", "orders", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders")
relational("win_frame_range", "orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS n FROM orders")
relational("sort_limit_topk", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
relational("set_union", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
relational("set_intersect", "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
relational("set_except", "nation supplier", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
relational("fn_string", "customer", "SELECT c_custkey, upper(c_name) AS u, substring(c_name, 2, 4) AS s, length(c_name) AS l, replace(c_mktsegment, 'E', '3') AS r, concat(c_name, '-', c_mktsegment) AS c FROM customer", "SELECT c_custkey, upper(c_name) AS u, substring(c_name, 2, 4) AS s, CAST(length(c_name) AS INTEGER) AS l, replace(c_mktsegment, 'E', '3') AS r, concat(c_name, '-', c_mktsegment) AS c FROM customer")
relational("fn_date", "orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofmonth(o_orderdate) AS d, date_trunc('month', o_orderdate) AS t FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS t FROM orders")
relational("fn_math", "part", "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS q, abs(-p_size) AS a, p_size % 7 AS m, floor(p_retailprice) AS f FROM part", "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS q, abs(-p_size) AS a, p_size % 7 AS m, CAST(floor(p_retailprice) AS BIGINT) AS f FROM part")
relational("fn_array", "embeddings", "SELECT vec_id, size(embedding) AS n, array_max(embedding) AS hi, element_at(embedding, 1) AS head FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, list_max(embedding) AS hi, embedding[1] AS head FROM embeddings")
relational("subquery_exists", "orders lineitem", "SELECT o_orderpriority, count(*) AS n FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 30) GROUP BY o_orderpriority")
relational("cte_case", "lineitem", "WITH x AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY l_orderkey) SELECT r, count(*) AS n FROM x GROUP BY r", "WITH x AS (SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS r FROM lineitem GROUP BY l_orderkey) SELECT r, count(*) AS n FROM x GROUP BY r")


@query("SELECT o.o_orderkey, e.event_id FROM orders o ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY user_id, ts) e ON o.o_custkey = e.user_id AND o.o_orderdate >= e.ts")
def join_asof(spark, sf_dir):
    """The last event of a customer at or before an order: one shuffle of both sides by customer, and a running last value."""
    lake = fresh(spark)
    o, e = load(lake, sf_dir, "orders").to_df(), load(lake, sf_dir, "events").to_df()
    both = o.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.lit(1).alias("side"), "o_orderkey", F.lit(None).cast("long").alias("event_id"))
    both = both.union(e.select("user_id", "ts", F.lit(0), F.lit(None).cast("long"), "event_id"))
    w = Window.partitionBy("k").orderBy("t", "side", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("event_id", F.last("event_id", True).over(w)).where("side = 1").select("o_orderkey", "event_id")


@query("SELECT o_custkey % 10 AS k, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS F, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS O FROM orders GROUP BY 1")
def agg_pivot(spark, sf_dir):
    df = load(fresh(spark), sf_dir, "orders").to_df().withColumn("k", F.col("o_custkey") % 10)
    return df.groupBy("k").pivot("o_orderstatus", ["F", "O"]).agg(F.count("o_orderkey")).na.fill(0)


@query("SELECT l_returnflag, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.5 * count(DISTINCT l_partkey) AS near FROM lineitem GROUP BY l_returnflag")
def agg_approx(spark, sf_dir):
    """Pairs go once first: a sketch is the same without repeats, and one aggregate of both would keep a sketch for every pair."""
    pairs = load(fresh(spark), sf_dir, "lineitem").to_df().select("l_returnflag", "l_partkey").distinct()
    return pairs.groupBy("l_returnflag").agg((F.abs(F.approx_count_distinct("l_partkey") - F.count("l_partkey")) <= 0.5 * F.count("l_partkey")).alias("near"))


relational("fn_map", "orders", "SELECT o_custkey, m['F'] AS f, size(m) AS n, array_join(array_sort(map_keys(m)), ',') AS k FROM (SELECT o_custkey, map_from_entries(collect_list(struct(o_orderstatus, n))) AS m FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus) GROUP BY o_custkey)", "SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN n END) AS f, CAST(count(*) AS INTEGER) AS n, string_agg(o_orderstatus, ',' ORDER BY o_orderstatus) AS k FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus) GROUP BY o_custkey")
relational("fn_json", "events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k, to_json(struct(user_id AS u)) AS j FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{\"u\":' || user_id || '}' AS j FROM events")
relational("win_percent", "customer", "SELECT c_custkey, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS d FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)")
relational("win_nth", "orders", "SELECT o_orderkey, nth_value(o_orderkey, 2) OVER w AS second_key, last_value(o_orderkey) OVER w AS last_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")


@query("SELECT p_partkey, p_size * 2 + length(p_name) AS v FROM part")
def udf_scalar(spark, sf_dir):
    """A function of Python over Arrow batches."""
    @F.pandas_udf("long")
    def weigh(size: pd.Series, name: pd.Series) -> pd.Series:
        return size * 2 + name.str.len()

    return load(fresh(spark), sf_dir, "part").to_df().select("p_partkey", weigh("p_size", "p_name").alias("v"))


@query("SELECT p_brand, CAST(max(p_size) - min(p_size) AS DOUBLE) AS spread FROM part GROUP BY p_brand")
def udf_aggregate(spark, sf_dir):
    """An aggregate of Python; a group's values come together, so it is for groups of a bounded size."""
    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    return load(fresh(spark), sf_dir, "part").to_df().groupBy("p_brand").agg(spread("p_size").alias("spread"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def udf_table(spark, sf_dir):
    """A table function of Python, joined laterally."""

    class Words:
        def eval(self, text: str):
            for w in (text or "").split(" "):
                yield (w,)

    words = F.udtf(Words, returnType="word: string")
    df = load(fresh(spark), sf_dir, "part").to_df()
    return df.lateralJoin(words(F.col("p_name").outer())).select("p_partkey", "word")
