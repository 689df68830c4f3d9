import datetime as dt
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import tarn
from tarn import Column, Schema, errors
from tarn import types as t
from tarn.sources import footers
from tarn.sources.storage import Files
from tarn.streaming.sink import append_stream


@pytest.fixture
def lake(spark, tmp_path):
    return tarn.create(spark, f"sqlite:///{tmp_path}/c.db", data_path=str(tmp_path / "data"))


def numbers(lake, n, first=0):
    return lake.spark.range(first, first + n).select(F.col("id").alias("x"))


def values(df, column="x"):
    return sorted(r[column] for r in df.collect())


def test_create_and_connect(spark, lake):
    url = lake.store.url
    with pytest.raises(errors.AlreadyInitializedError):
        tarn.create(spark, url, data_path="/tmp/none")
    with pytest.raises(errors.NotInitializedError):
        tarn.connect(spark, url + "2")
    with pytest.raises(Exception):
        tarn.connect(spark, url, time_zone="Nowhere/None")
    assert tarn.connect(spark, url).list_schemas() == ["main"]
    assert [s.id for s in lake.list_snapshots()] == [0]


def test_inline_limit_and_files(lake):
    a = lake.create_table("a", {"x": t.Int64()})
    a.append(numbers(lake, 10))
    assert (len(a.scan().files), len(a.scan().inlined)) == (0, 10)
    a.append(numbers(lake, 20))
    assert a.count() == a.to_df().count() == 30 and len(a.scan().inlined) == 10
    b = lake.create_table("b", {"x": t.Int64()})
    b.sink(numbers(lake, 1))
    assert len(b.scan().files) == 1
    b.set_metadata(data_inlining_row_limit=0)
    lake.set_metadata(data_inlining_row_limit=50)
    assert b.metadata()["data_inlining_row_limit"] == 0 and a.metadata()["data_inlining_row_limit"] == 50
    with pytest.raises(ValueError):
        lake.set_metadata(version="2")


def test_inline_types(lake):
    sample = {"boolean": True, "int8": 1, "int64": -(2**40), "uint8": 200, "float64": 1.5, "date": dt.date(2020, 1, 1), "timestamp": dt.datetime(2020, 1, 1, 1), "varchar": "NULL", "blob": b"\0x"}
    rows = [tuple(sample.values()), (None,) * len(sample)]
    schema = Schema([Column(k, t.DataType(k)) for k in sample] + [Column("l", t.List(t.Int64())), Column("s", t.Struct({"a": t.Int64(), "b": t.Varchar()})), Column("m", t.Map(t.Varchar(), t.Int64()))])
    a = lake.create_table("a", schema)
    df = lake.spark.createDataFrame([(*rows[0], [1, None], (1, "q"), {"k": 2}), (*rows[1], None, None, None)], schema.spark())
    a.append(df)
    assert len(a.scan().inlined) == 2
    got = sorted(a.to_df().collect(), key=str)
    assert got == sorted(df.collect(), key=str)


def test_time_travel_and_readonly(lake):
    a = lake.create_table("a", {"x": t.Int64()})
    a.append(numbers(lake, 3))
    a.append(numbers(lake, 3, 3))
    old = lake.at(2)
    assert values(old.get_table("a").to_df()) == [0, 1, 2] and [s.id for s in old.list_snapshots()] == [2]
    with pytest.raises(errors.ReadonlyLakeError):
        old.get_table("a").append(numbers(lake, 1))
    with pytest.raises(ValueError):
        old.get_latest_snapshot()
    follow = lake.readonly()
    a.append(numbers(lake, 1, 6))
    assert follow.get_table("a").count() == 7
    assert lake.at(lake.list_snapshots()[0].time).get_table("a").count() == 7
    with pytest.raises(errors.NotFoundError):
        lake.at(99)


def test_deletes(lake):
    a = lake.create_table("a", {"x": t.Int64()})
    a.append(numbers(lake, 5))
    a.append(numbers(lake, 100, 100))
    a.delete_where("x = 3 OR x = 150")  # into the catalog
    a.delete_where("x >= 120 AND x < 140")  # a file, over the inlined position
    a.delete_where("x >= 180")
    a.delete_where("x > 1000")  # nothing, no snapshot
    want = [0, 1, 2, 4, *(x for x in range(100, 180) if not 120 <= x < 140 and x != 150)]
    assert values(a.to_df()) == want and a.count() == len(want)
    assert values(a.to_df("x > 140")) == [x for x in want if x > 140]
    assert a.rewrite_data_files(delete_threshold=0.01).files_processed > 0
    assert values(a.to_df()) == want and not any(f.deleted() for f in a.scan().files)
    a.flush_inlined()
    a.merge_adjacent_files()
    assert values(a.to_df()) == want and len(a.scan().files) == 1
    assert values(lake.at(2).get_table("a").to_df()) == list(range(5))


def test_pruning_reads_fewer_files(lake):
    a = lake.create_table("a", {"x": t.Int64(), "y": t.Varchar()})
    for k in range(3):
        a.sink(numbers(lake, 50, 100 * k).coalesce(1).withColumn("y", F.lit(f"k{k}")))
    assert len(a.to_df("x BETWEEN 110 AND 120 AND y = 'k1'").inputFiles()) == 1
    assert a.to_df("y IS NULL").inputFiles() == []
    assert len(a.to_df("x % 2 = 0").inputFiles()) == 3


def test_evolution(lake):
    a = lake.create_table("a", Schema([Column("x", t.Int32()), Column("y", t.Varchar())]))
    small, big = [(1, "a")], [(i, "b") for i in range(20)]
    for rows in (small, big):
        a.append(lake.spark.createDataFrame(rows, "x int, y string"))
    a.add_column(Column("z", t.Int64(), initial_default=42))
    a.rename_column("y", "w")
    a.update_column_dtype("x", t.Int64())
    assert {(r.z, r.w) for r in a.to_df().collect()} == {(42, "a"), (42, "b")} and a.to_df("x = 1").count() == 2
    with pytest.raises(errors.InvalidCastError):
        a.update_column_dtype("x", t.Int32())
    a.remove_column("w")
    a.add_column(Column("w", t.Varchar()))
    assert {r.w for r in a.to_df().collect()} == {None} and [c.field_id for c in a.schema.columns] == [1, 3, 4]
    a.update_schema(Schema([Column("x", t.Int64()), Column("v", t.Float64())]))
    assert a.schema.names() == ["x", "v"]
    with pytest.raises(errors.AlreadyExistsError):
        a.rename_column("v", "x")
    with pytest.raises(errors.NotFoundError):
        a.remove_column("nothing")


def test_defaults_and_nulls(lake):
    a = lake.create_table("a", Schema([Column("x", t.Int64(), default_value=10), Column("y", t.Struct([Column("b", t.Int64(), default_value=20)])), Column("l", t.List(Column("element", t.Int64(), default_value=5)))]))
    a.append(lake.spark.createDataFrame([(None, (None,), [1, None]), (1, None, None)], "x long, y struct<b:long>, l array<long>"))
    assert sorted(map(tuple, a.to_df().collect())) == [(1, None, None), (10, (20,), [1, 5])]
    b = lake.create_table("b", Schema([Column("x", t.Int64(), nullable=False)]))
    for n in (1, 30):
        with pytest.raises(errors.InvalidNullValueError):
            b.append(lake.spark.createDataFrame([(None,)] * n, "x long"))
    a.update_column_nullability("x", False)
    with pytest.raises(errors.InvalidNullabilityChangeError):
        a.update_column_nullability("y", False)
    with pytest.raises(ValueError, match="differ"):
        a.append(numbers(lake, 1))


def test_partitions(lake):
    df = lake.spark.createDataFrame([(x, str(x)) for x in (1, 1, 1, 2, 2, 3)], "x long, y string")
    a = lake.create_table("a", df.schema, partition_by="x")
    a.sink(df)
    assert sorted(f.rows for f in a.scan().files) == [1, 2, 3] and a.to_df().count() == 6
    with pytest.raises(ValueError):
        a.remove_column("x")
    a.update_partitioning(None)
    assert a.partitioning is None
    days = lake.spark.createDataFrame([(dt.datetime(2020, 1, 1),), (dt.datetime(2020, 1, 2),), (dt.datetime(2021, 2, 3),), (dt.datetime(2021, 3, 4),)], "x timestamp_ntz")
    for how, n in (("year", 2), ("month", 3), ("day", 4), ("hour", 1)):
        b = lake.create_table(how, days.schema, partition_by=[("x", how)])
        b.sink(days)
        assert len({tuple(r.values()) for r in lake.store.rows("SELECT partition_value FROM {file_partition_value} WHERE table_id = ?", b.id)}) == n


def test_register_and_closure(lake, tmp_path):
    a = lake.create_table("a", {"x": t.Int64()})
    a.sink(numbers(lake, 5))
    b = lake.create_table("b", {"x": t.Int64()})
    b.write_data_files([f.path for f in a.scan().files])
    assert values(b.to_df()) == list(range(5))
    import pyarrow.parquet as pq

    def write(info):
        path = info.generate()
        import os

        os.makedirs(os.path.dirname(path), exist_ok=True)
        pq.write_table(pa.table({"x": [7]}, schema=pa.schema([pa.field("x", pa.int64(), metadata={"PARQUET:field_id": "1"})])), path)
        return [tarn.WriteDataFile(path)]

    b.write_data(write)
    assert values(b.to_df()) == [*range(5), 7]
    bare = tmp_path / "bare.parquet"
    pq.write_table(pa.table({"x": [7]}), bare)
    with pytest.raises(ValueError, match="field ids"):
        b.write_data_files(str(bare))


def test_transactions(lake):
    with lake.transaction(author="me", message="all", extra_info="{}") as tx:
        tx.create_schema("s")
        tx.create_table("s.a", {"x": t.Int64()}).append(numbers(lake, 3))
        gone = tx.create_table("gone", {"x": t.Int64()})
        gone.delete()
    assert len(lake.list_snapshots()) == 2 and lake.get_table("s.a").count() == 3 and not lake.has_table("gone")
    assert lake.snapshots().first().author == "me"
    with pytest.raises(ZeroDivisionError), lake.transaction() as tx:
        tx.create_schema("never")
        1 / 0
    assert lake.list_schemas() == ["main", "s"]
    with lake.transaction() as tx:
        tx.create_table("t", {"x": t.Int64()}).delete()
    assert len(lake.list_snapshots()) == 2
    with pytest.raises(ValueError):
        lake.delete_schema("s")
    lake.delete_schema("s", cascade=True)
    assert len(lake.list_snapshots()) == 3 and lake.list_tables() == []


def test_conflicts(lake):
    a = lake.create_table("a", {"x": t.Int64()})
    one, two = lake.transaction(), lake.transaction()
    one.table("a").append(numbers(lake, 2))
    two.table("a").append(numbers(lake, 2, 2))
    one.commit()
    two.commit()
    assert values(a.to_df()) == [0, 1, 2, 3]
    one, two = lake.transaction(), lake.transaction()
    one.table("a").rename("b")
    two.table("a").add_column(Column("y", t.Int64()))
    one.commit()
    with pytest.raises(errors.TransactionConflictError):
        two.commit()
    assert a.name.name == "b"
    one, two = lake.transaction(), lake.transaction()
    for tx in (one, two):
        tx.create_table("c", {"x": t.Int64()})
    one.commit()
    with pytest.raises(errors.TransactionConflictError):
        two.commit()


def test_many_writers(lake):
    a = lake.create_table("a", {"x": t.Int64()})
    work = [threading.Thread(target=lambda k=k: a.append(numbers(lake, 2, 2 * k))) for k in range(4)]
    for w in work:
        w.start()
    for w in work:
        w.join()
    assert values(a.to_df()) == list(range(8))


def test_expiry(lake):
    a = lake.create_table("a", {"x": t.Int64()})
    a.sink(numbers(lake, 50))
    a.delete_where("x < 10")
    a.delete_where("x < 20")
    a.rewrite_data_files(delete_threshold=0.01)
    assert lake.expire_snapshots() == []
    assert len(lake.expire_snapshots(older_than=dt.timedelta(0), dry_run=True)) == 5
    lake.expire_snapshots(versions=[1, 2])
    assert [s.id for s in lake.list_snapshots()] == [5, 4, 3, 0]
    lake.expire_snapshots(older_than=dt.timedelta(0))
    assert lake.cleanup_old_files() == [] and lake.cleanup_old_files(cleanup_all=True) and not lake.cleanup_old_files(cleanup_all=True)
    assert values(a.to_df()) == list(range(20, 50))
    a.lake.spark.range(3).write.parquet(f"{lake.data_path}main/a/stray")
    assert lake.delete_orphaned_files() == [] and lake.delete_orphaned_files(cleanup_all=True)
    lake.checkpoint()
    assert values(a.to_df()) == list(range(20, 50))


def test_tags_and_names(lake):
    a = lake.create_table("a", Schema([Column("s", t.Struct({"k": t.Int64()}))]), tags={"a": "1"})
    a.add_tag("comment", "text")
    a.add_column_tag(["s", "k"], "unit", "m")
    assert a.tags == {"a": "1", "comment": "text"} and a.schema["s"].data_type.children[0].tags == {"unit": "m"}
    a.remove_tag("a")
    a.remove_column_tag(["s", "k"], "unit")
    assert a.tags == {"comment": "text"} and a.schema["s"].data_type.children[0].tags == {}
    with pytest.raises(errors.NotFoundError):
        a.remove_tag("a")
    a.rename("b")
    assert str(a.name) == '"main"."b"' and lake.has_table("b") and not lake.has_table("a")
    with pytest.raises(errors.AlreadyExistsError):
        lake.create_table("b", {"x": t.Int64()})
    assert lake.create_table("b", {"x": t.Int64()}, if_exists="skip").id == a.id
    a.delete()
    with pytest.raises(errors.NotFoundError):
        a.to_df()


def test_sql(lake):
    lake.execute_sql("CREATE TABLE t (x BIGINT, y STRING)")
    lake.execute_sql("INSERT INTO t VALUES (1, 'a'), (2, 't'), (3, 'c')")
    lake.execute_sql("INSERT INTO t (x) SELECT x + 10 FROM t WHERE y <> 't'")
    assert lake.sql("SELECT sum(t.x) AS s, count(y) AS n FROM t").first() == (1 + 2 + 3 + 11 + 13, 3)
    assert lake.sql("SELECT a.x FROM main.t a JOIN t b ON a.x = b.x WHERE a.y = 't'").collect() == [(2,)]
    lake.execute_sql("DELETE FROM t WHERE x > 10")
    lake.execute_sql("UPDATE t SET y = concat(y, '!') WHERE x = 1")
    assert sorted(lake.sql("SELECT y FROM t").collect()) == [("a!",), ("c",), ("t",)]
    lake.execute_sql("CREATE TABLE u AS SELECT x FROM t")
    lake.execute_sql("ALTER TABLE u RENAME TO v")
    lake.execute_sql("DROP TABLE v")
    assert [n.name for n in lake.list_tables()] == ["t"]


def test_time_zone(lake):
    df = lake.spark.sql("SELECT timestamp'2024-01-01 12:00:00Z' AS x, array(named_struct('at', timestamp'2024-07-01 12:00:00Z')) AS e")
    a = lake.create_table("a", df.schema)
    a.append(df)
    r = a.to_df(time_zone="Europe/Berlin").first()
    assert r.x == dt.datetime(2024, 1, 1, 13) and r.e[0].at == dt.datetime(2024, 7, 1, 14)
    with pytest.raises(ValueError):
        a.append(lake.spark.sql("SELECT timestamp_ntz'2024-01-01 12:00:00' AS x, array(named_struct('at', timestamp'2024-07-01 12:00:00Z')) AS e"))


def test_stream(lake, spark, tmp_path):
    spark.range(30).coalesce(1).write.parquet(str(tmp_path / "in"))
    a = lake.create_table("a", {"id": t.Int64()})
    for _ in range(2):  # the second run finds nothing new
        q = append_stream(a, spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "ck"), availableNow=True)
        q.awaitTermination()
    assert a.count() == 30


def test_migration(lake):
    with lake.store.writing() as s:
        s.run("UPDATE {metadata} SET value = '0.3' WHERE key = 'version'")
        s.run("ALTER TABLE {schema_versions} DROP COLUMN table_id")
    with pytest.raises(errors.OutdatedVersionError):
        tarn.connect(lake.spark, lake.store.url)
    new = tarn.connect(lake.spark, lake.store.url, migrate=True)
    new.create_table("a", {"x": t.Int64()}).append(numbers(lake, 3))
    assert new.get_table("a").count() == 3


def test_mixed_deletes_lose_nothing(lake):
    """A delete file holds the positions that were inlined before it: counts don't add both."""
    for finish in (lambda a: None, lambda a: a.rewrite_data_files(delete_threshold=0.1), lambda a: lake.checkpoint()):
        a = lake.create_table("a", {"x": t.Int64()})
        a.sink(numbers(lake, 30).coalesce(1))
        a.delete_where("x < 10")
        a.delete_where("x < 21")
        a.delete_where("x = 25")
        want = [*range(21, 25), *range(26, 30)]
        assert a.count() == a.scan().count() == len(want) and values(a.to_df()) == want
        assert lake.store.rows("SELECT record_count FROM {table_stats} WHERE table_id = ?", a.id)[0]["record_count"] == len(want)
        finish(a)
        assert a.count() == len(want) and values(a.to_df()) == want
        a.delete_where("true")
        a.rewrite_data_files()
        assert a.count() == a.to_df().count() == 0 and a.scan().files == []
        a.delete()


def test_nan_is_known(lake, spark):
    a = lake.create_table("a", {"x": t.Float64(), "i": t.Int64()})
    flag = lambda: [r["contains_nan"] for r in lake.store.rows("SELECT contains_nan FROM {table_column_stats} WHERE table_id = ? ORDER BY column_id", a.id)]
    a.sink(spark.range(30).selectExpr("id * 0.5D AS x", "id AS i").coalesce(1))
    assert flag() == [0, None] and a.to_df("x > 100").inputFiles() == [] and a.to_df("x > 10").count() == 9
    a.append(spark.sql("SELECT CAST('NaN' AS DOUBLE) AS x, 1L AS i"))
    assert flag()[0] == 1
    a.sink(spark.range(20).selectExpr("CAST(IF(id = 3, 'NaN', '1.0') AS DOUBLE) AS x", "id AS i").coalesce(1))
    assert len(a.to_df("x > 100").inputFiles()) == 1 and a.to_df("x > 100").count() == 2 == a.to_df().where("x > 100").count()
    b = lake.create_table("b", {"x": t.Float64()})
    b.sink(spark.range(0).selectExpr("id * 0.5D AS x"))
    assert b.count() == 0


def test_delete_in_a_transaction(lake):
    a = lake.create_table("a", {"x": t.Int64()})
    a.sink(numbers(lake, 30))
    with lake.transaction() as tx:
        own = tx.table("a")
        own.append(numbers(lake, 20, 5))
        own.delete_where("x < 20")
        with pytest.raises(ValueError, match="already"):
            own.delete_where("x < 25")
    assert values(a.to_df()) == sorted([*range(20, 30), *range(5, 25)]) and a.count() == 30 and len(lake.list_snapshots()) == 4


def test_random_condition_marks_each_row_once(lake):
    a = lake.create_table("a", {"x": t.Int64()})
    a.sink(numbers(lake, 1000))
    a.delete_where("rand() < 0.5")
    assert 0 < a.count() == a.to_df().count() < 1000


def test_pruning_reads_texts_in_the_session_zone(lake, spark):
    a = lake.create_table("a", {"at": t.TimestampTz(), "local": t.Timestamp(), "day": t.Date(), "f": t.Float64(), "d": t.Decimal(5, 2)})
    spark.range(30).selectExpr("timestamp_seconds(1704085200) AS at", "timestamp_ntz'2024-01-01 05:00:00' AS local", "date'2024-01-01' AS day", "0.1D AS f", "CAST(0.1 AS DECIMAL(5,2)) AS d").createOrReplaceTempView("src")
    a.sink(spark.table("src"))
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/Los_Angeles", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            for where in ("at < '2024-01-01 00:00:00'", "at <= timestamp'2024-01-01 05:00:00Z'", "at > '2023-12-31'", "at = date'2024-01-01'", "local < '2024-01-01 06:00'", "local > timestamp_ntz'2024-01-01 05:00:00'", "day = '2024-01-01'", "day < timestamp'2024-01-01 00:00:00Z'", "f = 0.1", "f = 0.1D", "d = 0.1D", "d = 0.1", "f > 1", "at < 'no time'"):
                if where == "at < 'no time'":
                    continue  # an error in Spark itself
                assert a.to_df(where).count() == a.to_df().where(where).count(), (zone, where)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert a.to_df("at < '2024-01-01 00:00:00'").inputFiles() == [] and a.to_df("d > 1").inputFiles() == []
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_two_streams_into_one_table(lake, spark, tmp_path):
    a = lake.create_table("a", {"id": t.Int64()})
    for k in range(2):
        spark.range(30 * k, 30 * k + 30).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        for _ in range(2):
            append_stream(a, spark.readStream.schema("id long").parquet(str(tmp_path / f"in{k}")), str(tmp_path / f"ck{k}"), availableNow=True).awaitTermination()
    assert values(a.to_df(), "id") == list(range(60))
    # a batch whose commit is there already is not added again, though its snapshot is gone
    a.merge_adjacent_files()
    lake.expire_snapshots(older_than=dt.timedelta(0))
    import shutil

    shutil.rmtree(tmp_path / "ck0" / "commits")
    append_stream(a, spark.readStream.schema("id long").parquet(str(tmp_path / "in0")), str(tmp_path / "ck0"), availableNow=True).awaitTermination()
    assert values(a.to_df(), "id") == list(range(60))


def test_sql_by_the_parser(lake):
    lake.execute_sql("CREATE TABLE t (x INT, y INT, s STRING DEFAULT 'd') PARTITIONED BY (s)")
    lake.execute_sql("CREATE TABLE IF NOT EXISTS t (z INT)")
    lake.execute_sql("INSERT INTO t VALUES (1, 10, 'a, b = 1 where'), (2, 20, 'from t')")
    lake.execute_sql("UPDATE t SET x = y, y = x, s = concat(s, ', x = 2 where t') WHERE s IN ('a, b = 1 where') /* t */")
    assert sorted(map(tuple, lake.sql("SELECT * FROM t").collect())) == [(2, 20, "from t"), (10, 1, "a, b = 1 where, x = 2 where t")]
    assert lake.sql("WITH t AS (SELECT 99 AS x) SELECT x FROM t").collect() == [(99,)]
    assert lake.sql("WITH u AS (SELECT x FROM t), t AS (SELECT max(x) AS x FROM u) SELECT x, (SELECT count(*) FROM main.t) AS n FROM t").collect() == [(10, 2)]
    lake.execute_sql("CREATE TABLE grp AS SELECT 'from t' AS grp, 5 AS v")
    assert lake.sql("SELECT grp, count(*) AS n FROM (SELECT s AS grp FROM -- grp\n t) GROUP BY grp").count() == 2
    assert lake.sql("SELECT t.y FROM t JOIN grp ON t.s = grp.grp").collect() == [(20,)]
    lake.execute_sql("MERGE INTO t USING (SELECT 10 AS k UNION ALL SELECT 77) n ON t.x = n.k WHEN MATCHED THEN DELETE WHEN NOT MATCHED THEN INSERT (x, y) VALUES (n.k, 0)")
    assert sorted(map(tuple, lake.sql("SELECT x, y, s FROM t").collect())) == [(2, 20, "from t"), (77, 0, "d")]
    with pytest.raises(ValueError, match="MERGE"):
        lake.execute_sql("MERGE INTO t USING (SELECT 2 AS k UNION ALL SELECT 2) n ON t.x = n.k WHEN MATCHED THEN UPDATE SET y = 1")
    lake.execute_sql("DELETE FROM t AS q WHERE q.x = (SELECT max(x) FROM t)")
    lake.execute_sql("INSERT OVERWRITE t SELECT 3, 4, 'z'")
    assert lake.sql("TABLE t").collect() == [(3, 4, "z")]
    for text in ("ALTER COLUMN x TYPE BIGINT", "ALTER COLUMN y SET NOT NULL", "ADD COLUMN z INT", "DROP COLUMN z", "RENAME COLUMN y TO w"):
        lake.execute_sql(f"ALTER TABLE t {text}")
    assert str(lake.get_table("t").schema["x"].data_type) == "int64" and not lake.get_table("t").schema["w"].nullable
    lake.execute_sql("CREATE SCHEMA IF NOT EXISTS s")
    lake.execute_sql("DROP SCHEMA s CASCADE")
    lake.execute_sql("DROP TABLE IF EXISTS nothing")
    lake.execute_sql("checkpoint;")
    assert not [v for v in lake.spark.catalog.listTables() if v.name.startswith("__lake")]


def test_unsigned_and_old_times(lake, spark, tmp_path):
    a = lake.create_table("a", {"x": t.UInt64()})
    big = 2**64 - 1
    for n in (1, 20):
        a.append(spark.createDataFrame([(str(big - k),) for k in range(n)], "x string").selectExpr("CAST(x AS DECIMAL(20,0)) AS x"))
    assert int(max(r.x for r in a.to_df().collect())) == big and a.to_df(f"x >= {big}").count() == 2
    with pytest.raises(Exception, match="range"):
        a.append(spark.sql("SELECT CAST(-1 AS DECIMAL(20,0)) AS x"))
    b = lake.create_table("b", {"at": t.TimestampTz()})
    old = spark.conf.get("spark.sql.parquet.outputTimestampType")
    try:
        spark.conf.set("spark.sql.parquet.outputTimestampType", "INT96")
        spark.range(3).selectExpr("timestamp_seconds(id) AS at").select(F.col("at").alias("at", metadata={"parquet.field.id": 1})).coalesce(1).write.parquet(str(tmp_path / "old"))
    finally:
        spark.conf.set("spark.sql.parquet.outputTimestampType", old)
    import glob

    b.write_data_files(glob.glob(str(tmp_path / "old" / "*.parquet")))
    assert b.to_df("at >= timestamp'1970-01-01 00:00:01Z'").count() == 2


def test_merge_writes_packs_at_once(lake):
    a = lake.create_table("a", {"x": t.Int64(), "p": t.Int64()}, partition_by="p")
    for k in range(4):
        a.sink(numbers(lake, 20, 20 * k).withColumn("p", F.col("x") % 2))
    before = a.scan()
    got = a.merge_adjacent_files()
    assert (got.files_processed, got.files_created) == (len(before.files), 2) and sorted(f.rows for f in a.scan().files) == [40, 40]
    assert values(a.to_df()) == list(range(80)) and a.count() == 80
    assert lake.at_schema_version(1).snapshot().id == lake.snapshot().id


class Recorder:
    """A connection that notes what it is asked."""

    def __init__(self):
        self.texts, self.description = [], []

    def cursor(self):
        return self

    def execute(self, text, args=()):
        self.texts.append(text)

    def fetchall(self):
        return []

    def close(self):
        pass


def test_dialects():
    from tarn.catalog import store

    for kind in (store.PostgresStore, store.MySqlStore):
        c = Recorder()
        s = kind("mysql://u@h/db")
        s.connect = lambda c=c: c
        s.initialise("/data")
        text = "\n".join(c.texts)
        assert "?" not in text and '"key"' in text and " key " not in text
        if kind is store.MySqlStore:
            assert "VARCHAR" not in text and "DATABASE()" in text
        else:
            assert "current_schema()" in text and store.PostgresStore.blob == "BYTEA"
        many = Recorder()
        store.Session(s, many).insert("tag", [{"object_id": k, "key": "k", "value": "v"} for k in range(50_000)])
        assert len(many.texts) == 3


def test_small_targets_are_met(spark, lake, monkeypatch):
    """Files come near a small target, whatever the types guess; their statistics are the same read by the executors or by the driver."""
    rows = spark.range(0, 40_000, numPartitions=2).selectExpr("id AS x", "'f' AS flag", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id % 99 AS INT)) AS at", "CAST(id % 50 AS DOUBLE) AS q")
    a = lake.create_table("a", rows.schema)
    a.set_metadata(target_file_size="20kb", parquet_row_group_size=1000, parquet_compression="zstd")
    a.sink(rows)
    files = a.scan().files
    sizes = sorted(f.bytes for f in files)
    assert len(files) > 2 and 12_000 < sizes[len(sizes) // 2] < 28_000 and a.count() == a.to_df().count() == 40_000
    driver = footers.read_all(Files(spark), [f.path for f in files], a.definition().columns)
    monkeypatch.setattr(footers, "FEW", 1)
    assert footers.read_all(Files(spark), [f.path for f in files], a.definition().columns) == driver
    folder = files[0].path.rpartition("/")[0]
    assert Files(spark).below(folder) == [f.path for f in Files(spark).list(folder)]
    up, down = folder.rpartition("/")[0], Files(spark).below(folder.rpartition("/")[0], 1)
    assert down == [f.path for f in Files(spark).list(up)] and Files(spark).below(f"{up}/none") == []


def test_look_up_of_many_files_takes_few_tasks(spark, lake):
    a = lake.create_table("a", {"x": t.Int64()})
    for k in range(3):
        a.sink(spark.range(100 * k, 100 * k + 100, numPartitions=20).select(F.col("id").alias("x")))
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.sparkContext.setJobGroup("look-up", "")
    try:
        df = a.to_df()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("look-up")
        stages = [spark.sparkContext.statusTracker().getStageInfo(s) for j in jobs for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(a.scan().files) == 60 and stages and max(s.numTasks for s in stages) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(key) == before and df.count() == 300
