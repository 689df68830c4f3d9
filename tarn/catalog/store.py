"""The catalog database: its tables, and a store that any DB-API driver can be behind.

Everything is a row with a life from ``begin_snapshot`` to before ``end_snapshot``; the primary key of the snapshot table
is what two commits race for.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import re
import sqlite3
from collections.abc import Iterable, Iterator
from typing import Any
from urllib.parse import urlsplit

from ..errors import AlreadyInitializedError, NotInitializedError, OutdatedVersionError

VERSION = "1.0"
VERSIONS = ("0.1", "0.2", "0.3", "0.4", "1.0")

# The names and columns of the catalog's tables, which every client of a lake reads.
LIFE = "begin_snapshot BIGINT, end_snapshot BIGINT"
TABLES = {
    "metadata": '"key" VARCHAR NOT NULL, value VARCHAR NOT NULL, scope VARCHAR, scope_id BIGINT',
    "snapshot": "snapshot_id BIGINT PRIMARY KEY, snapshot_time VARCHAR, schema_version BIGINT, next_catalog_id BIGINT, next_file_id BIGINT",
    "snapshot_changes": "snapshot_id BIGINT PRIMARY KEY, changes_made VARCHAR, author VARCHAR, commit_message VARCHAR, commit_extra_info VARCHAR",
    "schema": f"schema_id BIGINT, schema_uuid VARCHAR, {LIFE}, schema_name VARCHAR, path VARCHAR, path_is_relative BOOLEAN",
    "schema_versions": "begin_snapshot BIGINT, schema_version BIGINT, table_id BIGINT",
    "table": f"table_id BIGINT, table_uuid VARCHAR, {LIFE}, schema_id BIGINT, table_name VARCHAR, path VARCHAR, path_is_relative BOOLEAN",
    "column": f"column_id BIGINT, {LIFE}, table_id BIGINT, column_order BIGINT, column_name VARCHAR, column_type VARCHAR, initial_default VARCHAR, default_value VARCHAR, nulls_allowed BOOLEAN, parent_column BIGINT, default_value_type VARCHAR, default_value_dialect VARCHAR",
    "column_tag": f'table_id BIGINT, column_id BIGINT, {LIFE}, "key" VARCHAR, value VARCHAR',
    "tag": f'object_id BIGINT, {LIFE}, "key" VARCHAR, value VARCHAR',
    "data_file": f"data_file_id BIGINT PRIMARY KEY, table_id BIGINT, {LIFE}, file_order BIGINT, path VARCHAR, path_is_relative BOOLEAN, file_format VARCHAR, record_count BIGINT, file_size_bytes BIGINT, footer_size BIGINT, row_id_start BIGINT, partition_id BIGINT, schema_version BIGINT",
    "delete_file": f"delete_file_id BIGINT PRIMARY KEY, table_id BIGINT, {LIFE}, data_file_id BIGINT, path VARCHAR, path_is_relative BOOLEAN, format VARCHAR, delete_count BIGINT, file_size_bytes BIGINT, footer_size BIGINT",
    "file_column_stats": "data_file_id BIGINT, table_id BIGINT, column_id BIGINT, column_size_bytes BIGINT, value_count BIGINT, null_count BIGINT, min_value VARCHAR, max_value VARCHAR, contains_nan BOOLEAN",
    "file_partition_value": "data_file_id BIGINT, table_id BIGINT, partition_key_index BIGINT, partition_value VARCHAR",
    "files_scheduled_for_deletion": "data_file_id BIGINT, path VARCHAR, path_is_relative BOOLEAN, schedule_start VARCHAR",
    "inlined_data_tables": "table_id BIGINT, table_name VARCHAR, schema_version BIGINT",
    "partition_info": f"partition_id BIGINT, table_id BIGINT, {LIFE}",
    "partition_column": "partition_id BIGINT, table_id BIGINT, partition_key_index BIGINT, column_id BIGINT, transform VARCHAR",
    "table_stats": "table_id BIGINT PRIMARY KEY, record_count BIGINT, next_row_id BIGINT, file_size_bytes BIGINT",
    "table_column_stats": "table_id BIGINT, column_id BIGINT, contains_null BOOLEAN, contains_nan BOOLEAN, min_value VARCHAR, max_value VARCHAR",
}


class Conflict(Exception):
    """The database says that another commit took the same snapshot id."""


class Store:
    """SQL on the catalog. One connection an operation; ``prefix`` begins every table's name."""

    #: A placeholder of a parameter, and how a write transaction begins.
    mark, begin = "?", "BEGIN IMMEDIATE"
    #: Parameters that a statement may bind, and the type of bytes.
    binds, blob = 32_766, "BLOB"

    def __init__(self, url: str, prefix: str = "lake_"):
        self.url, self.prefix = url, prefix

    def connect(self) -> Any:
        raise NotImplementedError

    def sql(self, text: str) -> str:
        """{table} stands for the table's full name."""
        names = {n: f"{self.prefix}{n}" for n in TABLES}
        for n, full in names.items():
            text = text.replace("{" + n + "}", full)
        return self.typed(text.replace("?", self.mark))

    def typed(self, text: str) -> str:
        """Type names as the database spells them."""
        return text

    def ident(self, name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    @contextlib.contextmanager
    def reading(self) -> Iterator[Session]:
        c = self.connect()
        try:
            yield Session(self, c)
        finally:
            c.close()

    @contextlib.contextmanager
    def writing(self) -> Iterator[Session]:
        c = self.connect()
        try:
            s = Session(self, c)
            s.run(self.begin)
            try:
                yield s
            except BaseException:
                s.run("ROLLBACK")
                raise
            s.run("COMMIT")
        finally:
            c.close()

    def rows(self, text: str, *args: Any) -> list[dict]:
        with self.reading() as s:
            return s.rows(text, *args)

    def conflict(self, e: Exception) -> bool:
        return False

    # the whole lake

    def initialised(self) -> bool:
        return bool(self.tables({f"{self.prefix}metadata"}))

    def tables(self, names: set[str]) -> set[str]:
        raise NotImplementedError

    def initialise(self, data_path: str) -> None:
        if self.initialised():
            raise AlreadyInitializedError("the catalog holds a lake already; connect to it")
        with self.writing() as s:
            for n, columns in TABLES.items():
                s.run(f"CREATE TABLE {self.prefix}{n} ({columns})")
            for n, columns in (("data_file", "table_id"), ("delete_file", "table_id"), ("column", "table_id"), ("file_column_stats", "table_id")):
                s.run(f"CREATE INDEX {self.prefix}{n}_by_table ON {self.prefix}{n} ({columns})")
            path = data_path if data_path.endswith("/") else data_path + "/"
            s.insert("metadata", [{"key": k, "value": v} for k, v in (("version", VERSION), ("created_by", "tarn"), ("data_path", path), ("encrypted", "false"))])
            s.insert("schema", [{"schema_id": 0, "schema_uuid": new_uuid(), "begin_snapshot": 0, "schema_name": "main", "path": "main/", "path_is_relative": True}])
            s.insert("snapshot", [{"snapshot_id": 0, "snapshot_time": now_text(), "schema_version": 0, "next_catalog_id": 1, "next_file_id": 0}])
            s.insert("snapshot_changes", [{"snapshot_id": 0, "changes_made": 'created_schema:"main"'}])

    def check_version(self, migrate: bool = False) -> None:
        if not self.initialised():
            raise NotInitializedError("the catalog holds no lake; create it first")
        version = self.rows("""SELECT value FROM {metadata} WHERE "key" = 'version'""")[0]["value"]
        if version == VERSION:
            return
        if version not in VERSIONS or not migrate:
            raise OutdatedVersionError(f"the catalog has version {version}, this package {VERSION}; connect with migrate=True")
        from .migrations import migrate_from

        migrate_from(self, version)


class Session:
    """One connection with a transaction or without."""

    def __init__(self, store: Store, connection: Any):
        self.store, self.connection = store, connection

    def run(self, text: str, *args: Any) -> Any:
        return self.execute(self.store.sql(text), args)

    def execute(self, text: str, args: Any) -> Any:
        cursor = self.connection.cursor()
        try:
            cursor.execute(text, args)
        except Exception as e:
            if self.store.conflict(e):
                raise Conflict(str(e)) from e
            raise
        return cursor

    def rows(self, text: str, *args: Any) -> list[dict]:
        cursor = self.run(text, *args)
        names = [d[0] for d in cursor.description]
        return [dict(zip(names, r)) for r in cursor.fetchall()]

    def insert(self, table: str, rows: Iterable[dict]) -> None:
        """Rows of one table, many a statement: as many as the database binds parameters for."""
        rows = list(rows)
        if not rows:
            return
        full = table if table not in TABLES else f"{self.store.prefix}{table}"
        names = list(dict.fromkeys(n for r in rows for n in r))
        step, row = max(1, self.store.binds // len(names)), f"({', '.join([self.store.mark] * len(names))})"
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            self.execute(f"INSERT INTO {full} ({', '.join(map(self.store.ident, names))}) VALUES {', '.join([row] * len(part))}", [r.get(n) for r in part for n in names])

    def matching(self, ids: Iterable[Any], text: str, *args: Any, step: int = 500) -> list[dict]:
        """Rows of a query with ``IN {ids}``, some ids at a time."""
        ids, out = list(ids), []
        for k in range(0, len(ids), step):
            part = ids[k : k + step]
            out += self.rows(text.replace("{ids}", "(" + ", ".join("?" * len(part)) + ")"), *args, *part)
        return out

    def run_for(self, ids: Iterable[Any], text: str, *args: Any, step: int = 500) -> None:
        ids = list(ids)
        for k in range(0, len(ids), step):
            part = ids[k : k + step]
            self.run(text.replace("{ids}", "(" + ", ".join("?" * len(part)) + ")"), *args, *part)

    def has_table(self, name: str) -> bool:
        return bool(self.store.tables({name}))


def new_uuid() -> str:
    """A UUID of version 7, whose order is that of time."""
    import os
    import time
    import uuid

    ms = time.time_ns() // 1_000_000
    raw = (ms << 80) | int.from_bytes(os.urandom(10), "big")
    raw = raw & ~(0xF << 76) | (7 << 76)
    return str(uuid.UUID(int=raw & ~(0x3 << 62) | (0x2 << 62)))


def now() -> dt.datetime:
    return dt.datetime.now(dt.UTC)


def now_text() -> str:
    return now().isoformat(timespec="microseconds")


class SqliteStore(Store):
    def connect(self) -> sqlite3.Connection:
        c = sqlite3.connect(self.path, timeout=60, isolation_level=None)
        c.execute("PRAGMA foreign_keys=OFF")
        return c

    @property
    def path(self) -> str:
        return self.url.split(":", 1)[1].removeprefix("///") if self.url.startswith("sqlite:") else self.url

    def tables(self, names: set[str]) -> set[str]:
        return {r["name"] for r in self.rows("SELECT name FROM sqlite_master WHERE type = 'table'")} & names

    def conflict(self, e: Exception) -> bool:
        return isinstance(e, sqlite3.IntegrityError) or "already exists" in str(e)


class ServerStore(Store):
    """PostgreSQL and MySQL through any DB-API driver that is installed."""

    mark, begin, drivers, binds = "%s", "", (), 65_535
    #: What a new connection is told, and the expression for the schema that the lake is in.
    greeting, schema = "", ""

    def connect(self) -> Any:
        import importlib

        for name in self.drivers:
            try:
                module = importlib.import_module(name)
            except ImportError:
                continue
            u = urlsplit(self.url)
            c = module.connect(host=u.hostname, port=u.port or self.port, user=u.username, password=u.password or "", **{self.database: u.path.lstrip("/")})
            if self.greeting:
                c.cursor().execute(self.greeting)
            return c
        raise RuntimeError(f"none of the drivers {', '.join(self.drivers)} is installed")

    def tables(self, names: set[str]) -> set[str]:
        return {r["table_name"] for r in self.rows(f"SELECT table_name AS table_name FROM information_schema.tables WHERE table_schema = {self.schema}")} & names

    def conflict(self, e: Exception) -> bool:
        return type(e).__name__ in ("IntegrityError", "UniqueViolation", "SerializationFailure", "DuplicateTable")


class PostgresStore(ServerStore):
    drivers, port, database, begin = ("psycopg", "psycopg2"), 5432, "dbname", "BEGIN ISOLATION LEVEL REPEATABLE READ"
    schema, blob = "current_schema()", "BYTEA"


class MySqlStore(ServerStore):
    """Without inlining, as small writes need transactional DDL. Its ANSI mode reads "names" and || as the others do."""

    drivers, port, database, begin = ("MySQLdb", "pymysql"), 3306, "database", "START TRANSACTION"
    greeting, schema = "SET SESSION sql_mode = 'ANSI,STRICT_TRANS_TABLES'", "DATABASE()"

    def typed(self, text: str) -> str:
        return re.sub(r"\bVARCHAR\b(?!\()", "TEXT", text)


def open_store(url: str, prefix: str = "lake_") -> Store:
    kind = str(url).split(":", 1)[0].split("+")[0]
    return {"postgresql": PostgresStore, "postgres": PostgresStore, "mysql": MySqlStore}.get(kind, SqliteStore)(str(url), prefix)
