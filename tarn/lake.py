"""The lake: connections, tables, SQL."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Mapping
from typing import Any
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession

from .catalog import model, options
from .catalog.model import Catalog, Snapshot, TableDef
from .catalog.store import MySqlStore, open_store
from .errors import InvalidNullabilityChangeError, NotFoundError, ReadonlyLakeError
from .identifiers import TableName, table_name
from .operators import maintenance as m
from .plans import pruning
from .plans.scan import ScanResult, count, scan, to_df
from .plans.statements import Statement
from .sources.storage import apply_settings, storage_settings
from .transaction import Transaction, TransactionTable
from .types import Column, Partitioning, Schema

#: What scans and writes need of a session; a lake sets it on its own.
#: Instants are written as microseconds: the older form has no statistics.
SETTINGS = {"spark.sql.parquet.fieldId.read.enabled": "true", "spark.sql.parquet.fieldId.write.enabled": "true", "spark.sql.timeType.enabled": "true", "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS"}


def create(spark: SparkSession, catalog_url: str, *, data_path: str, storage_options: Mapping[str, str] | None = None, time_zone: str = "UTC", prefix: str = "lake_") -> Lake:
    """A new lake: an initialised catalog database, and a root for data files."""
    store = open_store(catalog_url, prefix)
    if "://" not in data_path and not data_path.startswith("file:"):
        data_path = os.path.abspath(data_path)
    store.initialise(data_path)
    return Lake(spark, store, storage_options=storage_options, time_zone=time_zone)


def connect(spark: SparkSession, catalog_url: str, *, at: int | dt.datetime | None = None, readonly: bool = False, migrate: bool = False, storage_options: Mapping[str, str] | None = None, time_zone: str = "UTC", prefix: str = "lake_") -> Lake:
    """A lake that exists; ``at`` pins it to a snapshot and makes it read-only."""
    store = open_store(catalog_url, prefix)
    store.check_version(migrate)
    out = Lake(spark, store, readonly=readonly, storage_options=storage_options, time_zone=time_zone)
    return out.at(at) if at is not None else out


class Lake:
    def __init__(self, spark: SparkSession, store, pinned: Snapshot | None = None, readonly: bool = False, storage_options: Mapping[str, str] | None = None, time_zone: str = "UTC"):
        ZoneInfo(time_zone)  # raises if there is no such zone
        self.spark, self.store, self.pinned, self.time_zone = spark, store, pinned, time_zone
        self.is_readonly, self.storage_options = readonly or pinned is not None, storage_options
        self.inlines = not isinstance(store, MySqlStore)
        self.cached: Catalog | None = None
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        apply_settings(spark, storage_settings(storage_options, os.environ))

    def __enter__(self) -> Lake:
        return self

    def __exit__(self, *_: Any) -> None:
        self.disconnect()

    def disconnect(self) -> None:
        """Connections to the catalog live for one operation each, so nothing stays open."""
        self.forget()

    # snapshots

    def at(self, at: int | dt.datetime) -> Lake:
        """The lake as it was: by snapshot id, or at a time."""
        with self.store.reading() as s:
            snapshot = model.snapshot_at(s, at)
        return Lake(self.spark, self.store, snapshot, True, self.storage_options, self.time_zone)

    def at_schema_version(self, version: int) -> Lake:
        """The lake at the newest snapshot with a version of the schema; data of expired snapshots may be gone."""
        with self.store.reading() as s:
            snapshot = model.snapshot_of_schema(s, version)
        return Lake(self.spark, self.store, snapshot, True, self.storage_options, self.time_zone)

    def readonly(self) -> Lake:
        """Follows the newest snapshot, unless pinned, and rejects writes."""
        return Lake(self.spark, self.store, self.pinned, True, self.storage_options, self.time_zone)

    def require_write(self) -> None:
        if self.is_readonly:
            raise ReadonlyLakeError("the connection is read-only")

    def snapshot(self) -> Snapshot:
        if self.pinned:
            return self.pinned
        with self.store.reading() as s:
            return model.latest(s)

    def get_latest_snapshot(self) -> Snapshot:
        if self.pinned:
            raise ValueError(f"the connection is pinned to snapshot {self.pinned.id}")
        return self.snapshot()

    def list_snapshots(self) -> list[Snapshot]:
        """Newest first; a pinned connection sees its own."""
        if self.pinned:
            return [self.pinned]
        with self.store.reading() as s:
            return model.snapshots(s)

    def snapshots(self) -> DataFrame:
        """list_snapshots() with what each says that it did."""
        ids = {x.id for x in self.list_snapshots()}
        rows = self.store.rows("SELECT s.snapshot_id, s.snapshot_time, s.schema_version, c.changes_made, c.author, c.commit_message, c.commit_extra_info FROM {snapshot} s LEFT JOIN {snapshot_changes} c ON s.snapshot_id = c.snapshot_id ORDER BY s.snapshot_id DESC")
        schema = "snapshot_id long, snapshot_time timestamp, schema_version long, changes_made string, author string, commit_message string, commit_extra_info string"
        return self.spark.createDataFrame([(r["snapshot_id"], dt.datetime.fromisoformat(r["snapshot_time"]), *list(r.values())[2:]) for r in rows if r["snapshot_id"] in ids], schema)

    # the catalog

    def catalog(self) -> Catalog:
        """At the newest or pinned snapshot; loaded again only when the snapshot is another."""
        with self.store.reading() as s:
            now = self.pinned or model.latest(s)
            if self.cached is None or self.cached.snapshot.id != now.id:
                self.cached = model.load(s, now)
            return self.cached

    def forget(self) -> None:
        self.cached = None

    @property
    def data_path(self) -> str:
        return self.catalog().data_path

    @staticmethod
    def catalog_path(catalog: Catalog, t: TableDef) -> str:
        return catalog.path_of(t)

    def options(self) -> dict[str, Any]:
        return options.resolve(self.store)

    def metadata(self) -> dict[str, Any]:
        """Options of the whole lake, and the fixed values."""
        fixed = {r["key"]: r["value"] for r in self.store.rows('SELECT "key", value FROM {metadata} WHERE scope IS NULL') if r["key"] in options.FIXED}
        return self.options() | fixed

    def set_metadata(self, *, schema: str | None = None, **opts: Any) -> None:
        """Set options of the lake or of a schema; None unsets one."""
        self.require_write()
        options.set_options(self.store, "schema" if schema else None, self.catalog().schema(schema).id if schema else None, opts)

    def list_schemas(self) -> list[str]:
        return sorted(s.name for s in self.catalog().schemas.values())

    def list_tables(self, schema: str | None = None) -> list[TableName]:
        c = self.catalog()
        if schema is not None:
            c.schema(schema)
        return sorted(n for n in map(c.name_of, c.tables.values()) if schema in (None, n.schema))

    def has_table(self, name: str | tuple) -> bool:
        try:
            self.catalog().table(table_name(name))
        except NotFoundError:
            return False
        return True

    def get_table(self, name: str | tuple) -> LakeTable:
        return LakeTable(self, self.catalog().table(table_name(name)).id)

    table = get_table

    def transaction(self, *, author: str | None = None, message: str | None = None, extra_info: str | None = None) -> Transaction:
        return Transaction(self, author, message, extra_info)

    def create_schema(self, name: str, **kw: Any) -> None:
        with self.transaction() as tx:
            tx.create_schema(name, **kw)

    def delete_schema(self, name: str, *, cascade: bool = False) -> None:
        with self.transaction() as tx:
            tx.delete_schema(name, cascade=cascade)

    def create_table(self, name: str | tuple, schema: Any, **kw: Any) -> LakeTable:
        with self.transaction() as tx:
            tx.create_table(name, schema, **kw)
        return self.get_table(name)

    def refuse_nulls(self, t: TableDef, path: tuple[str, ...], pending: Any) -> None:
        """A column that holds nulls can't forbid them: statistics say so, and where they don't a scan does."""
        c = t.find(path)
        nulls = any((x.statistics.columns.get(c.field_id) and x.statistics.columns[c.field_id].nulls) for x in pending.files) or any(r.get(c.field_id) is None for r in pending.inlined if c.field_id in r) if pending else False
        if not nulls and t.id >= 0 and self.store.rows("SELECT record_count FROM {table_stats} WHERE table_id = ? AND record_count > 0", t.id):
            found = self.store.rows("SELECT contains_null FROM {table_column_stats} WHERE table_id = ? AND column_id = ?", t.id, c.field_id)
            known = found[0]["contains_null"] if found else None
            nulls = bool(known) if known is not None else len(path) > 1 or bool(LakeTable(self, t.id).to_df().where(f"`{path[0]}` IS NULL").limit(1).count())
        if nulls:
            raise InvalidNullabilityChangeError(f"column {'.'.join(path)} holds nulls")

    # SQL

    def register_views(self, prefix: str = "") -> None:
        """Each table as a temporary view: its name, for tables outside main with the schema before it."""
        for n in self.list_tables():
            self.get_table(n).to_df().createOrReplaceTempView(prefix + (n.name if n.schema == "main" else f"{n.schema}_{n.name}"))

    def sql(self, query: str) -> DataFrame:
        """A query of Spark SQL; the lake's tables go by schema.table, or by their name in main."""
        return Statement(self, query).query()

    def execute_sql(self, query: Any) -> None:
        """A statement: INSERT, DELETE, UPDATE, MERGE, CREATE TABLE [AS], DROP, ALTER TABLE, CREATE or DROP SCHEMA, CHECKPOINT, or a query."""
        text = str(query).strip().rstrip(";").strip()
        if text.lower() == "checkpoint":
            self.checkpoint()
        else:
            Statement(self, text).run()

    # upkeep

    def checkpoint(self) -> None:
        self.require_write()
        m.checkpoint(self)

    def expire_snapshots(self, *, versions: list[int] | None = None, older_than: dt.datetime | dt.timedelta | None = None, dry_run: bool = False) -> list[Snapshot]:
        return m.expire_snapshots(self, versions, older_than, dry_run)

    def cleanup_old_files(self, *, cleanup_all: bool = False, older_than: dt.datetime | dt.timedelta | None = None, dry_run: bool = False) -> list[str]:
        return m.cleanup_old_files(self, cleanup_all, older_than, dry_run)

    def delete_orphaned_files(self, *, cleanup_all: bool = False, older_than: dt.datetime | dt.timedelta | None = None, dry_run: bool = False) -> list[str]:
        return m.delete_orphaned_files(self, cleanup_all, older_than, dry_run)

    def merge_adjacent_files(self, **kw: Any) -> list[m.MaintenanceResult]:
        return [self.get_table(n).merge_adjacent_files(**kw) for n in self.list_tables()]

    def rewrite_data_files(self, **kw: Any) -> list[m.MaintenanceResult]:
        return [self.get_table(n).rewrite_data_files(**kw) for n in self.list_tables()]


class LakeTable:
    """A table by id, so it survives renames; each change is a commit of its own."""

    def __init__(self, lake: Lake, i: int):
        self.lake, self.id = lake, i

    def definition(self) -> TableDef:
        t = self.lake.catalog().tables.get(self.id)
        if t is None:
            raise NotFoundError("the table does not exist")
        return t

    @property
    def name(self) -> TableName:
        return self.lake.catalog().name_of(self.definition())

    @property
    def schema(self) -> Schema:
        return self.definition().schema()

    @property
    def partitioning(self) -> Partitioning | None:
        return self.definition().partitioning()

    @property
    def tags(self) -> dict[str, str]:
        return dict(self.definition().tags)

    def metadata(self) -> dict[str, Any]:
        return options.resolve(self.lake.store, self.definition().schema_id, self.id)

    def set_metadata(self, **opts: Any) -> None:
        self.lake.require_write()
        self.definition()
        options.set_options(self.lake.store, "table", self.id, opts)

    # reading

    def scan(self, catalog: Catalog | None = None, stats_of: set[str] | None = None) -> ScanResult:
        """What the table is made of; ``stats_of`` limits the statistics to these columns."""
        catalog = catalog or self.lake.catalog()
        with self.lake.store.reading() as s:
            return scan(s, catalog, catalog.tables[self.id], stats_of)

    def scan_for(self, where: str | None, catalog: Catalog | None = None) -> ScanResult:
        """With statistics of the condition's columns only."""
        return self.scan(catalog, set() if where is None else pruning.columns(pruning.parse(self.lake.spark, where)))

    def to_df(self, where: str | None = None, *, include_file_paths: str | None = None, time_zone: str | None = None) -> DataFrame:
        """The table at the connection's snapshot; later commits don't change it."""
        self.definition()
        zone = time_zone or (self.lake.time_zone if self.lake.time_zone != "UTC" else None)
        return to_df(self.lake, self.scan_for(where), where, include_file_paths, zone)

    def to_arrow(self, **kw: Any):
        return self.to_df(**kw).toArrow()

    def to_pandas(self, **kw: Any):
        return self.to_df(**kw).toPandas()

    def count(self) -> int:
        """From the catalog, without a job."""
        catalog = self.lake.catalog()
        self.definition()
        with self.lake.store.reading() as s:
            return count(s, catalog, catalog.tables[self.id])

    # writing

    def change(self, f) -> None:
        with self.lake.transaction() as tx:
            if self.id not in tx.catalog.tables:
                raise NotFoundError("the table does not exist")
            f(TransactionTable(tx, self.id))

    def append(self, df: DataFrame) -> None:
        self.change(lambda t: t.append(df))

    def sink(self, df: DataFrame) -> None:
        """Like append, but always as files."""
        self.change(lambda t: t.sink(df))

    def write_arrow(self, data) -> None:
        self.append(self.lake.spark.createDataFrame(data))

    def write_data_files(self, files: Any) -> None:
        self.change(lambda t: t.write_data_files(files))

    def write_data(self, f) -> None:
        self.change(lambda t: t.write_data(f))

    def get_write_info(self):
        self.lake.require_write()
        return TransactionTable(self.lake.transaction(), self.id).get_write_info()

    def delete_where(self, where: str) -> None:
        self.change(lambda t: t.delete_where(where))

    # definition

    def delete(self) -> None:
        self.change(lambda t: t.delete())

    def rename(self, new_name: str) -> None:
        self.change(lambda t: t.rename(new_name))

    def add_column(self, column: Column, parent: Any = None) -> None:
        self.change(lambda t: t.add_column(column, parent))

    def remove_column(self, path: Any) -> None:
        self.change(lambda t: t.remove_column(path))

    def rename_column(self, path: Any, new_name: str) -> None:
        self.change(lambda t: t.rename_column(path, new_name))

    def update_column_dtype(self, path: Any, dtype: Any) -> None:
        self.change(lambda t: t.update_column_dtype(path, dtype))

    def update_column_default(self, path: Any, value: Any) -> None:
        self.change(lambda t: t.update_column_default(path, value))

    def update_column_nullability(self, path: Any, nullable: bool) -> None:
        self.change(lambda t: t.update_column_nullability(path, nullable))

    def update_schema(self, schema: Any) -> None:
        self.change(lambda t: t.update_schema(schema))

    def update_partitioning(self, partitioning: Any) -> None:
        self.change(lambda t: t.update_partitioning(partitioning))

    def add_tag(self, key: str, value: str) -> None:
        self.change(lambda t: t.add_tag(key, value))

    def remove_tag(self, key: str) -> None:
        self.change(lambda t: t.remove_tag(key))

    def add_column_tag(self, path: Any, key: str, value: str) -> None:
        self.change(lambda t: t.add_column_tag(path, key, value))

    def remove_column_tag(self, path: Any, key: str) -> None:
        self.change(lambda t: t.remove_column_tag(path, key))

    # upkeep

    def merge_adjacent_files(self, **kw: Any) -> m.MaintenanceResult:
        return m.merge_adjacent_files(self, **kw)

    def rewrite_data_files(self, **kw: Any) -> m.MaintenanceResult:
        return m.rewrite_data_files(self, **kw)

    def flush_inlined(self) -> m.MaintenanceResult:
        return m.flush_inlined(self)
