"""The catalog at a snapshot, in memory."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from ..errors import AlreadyExistsError, NotFoundError
from ..identifiers import TableName
from ..literals import format_value, parse_value
from ..types import Column, DataType, PartitionColumn, Partitioning, Schema, parse_type
from .store import Session

ALIVE = "begin_snapshot <= ? AND (end_snapshot > ? OR end_snapshot IS NULL)"


@dataclass(frozen=True)
class Snapshot:
    id: int
    time: dt.datetime
    schema_version: int
    next_catalog_id: int
    next_file_id: int

    @staticmethod
    def of(r: dict) -> Snapshot:
        return Snapshot(r["snapshot_id"], dt.datetime.fromisoformat(r["snapshot_time"]), r["schema_version"], r["next_catalog_id"], r["next_file_id"])


@dataclass
class SchemaDef:
    id: int
    uuid: str
    name: str
    path: str
    relative: bool = True


@dataclass
class TableDef:
    id: int
    uuid: str
    schema_id: int
    name: str
    path: str
    relative: bool
    columns: list[Column] = field(default_factory=list)
    #: (column id, transform) in order, and the id under which files refer to them
    partition: list[tuple[int, str]] = field(default_factory=list)
    partition_id: int | None = None
    tags: dict[str, str] = field(default_factory=dict)
    next_column_id: int = 1

    def schema(self) -> Schema:
        return Schema(self.columns)

    def copy(self) -> TableDef:
        return replace(self, columns=list(self.columns), partition=list(self.partition), tags=dict(self.tags))

    def by_id(self) -> dict[int, Column]:
        return {c.field_id: c for top in self.columns for _, c in top.walk()}

    def partitioning(self) -> Partitioning | None:
        names = {c.field_id: c.name for c in self.columns}
        return Partitioning([PartitionColumn(names[i], t) for i, t in self.partition]) if self.partition else None

    def number(self, c: Column) -> Column:
        """Field ids for a new column and all below it, depth first."""
        own = self.next_column_id
        self.next_column_id += 1
        return replace(c, field_id=own, data_type=replace(c.data_type, children=tuple(self.number(x) for x in c.data_type.children)))

    def find(self, path: tuple[str, ...]) -> Column:
        level: Iterable[Column] = self.columns
        for n in path:
            c = next((x for x in level if x.name == n), None)
            if c is None:
                raise NotFoundError(f"column {'.'.join(path)} does not exist")
            level = c.data_type.children
        return c

    def change(self, path: tuple[str, ...], f: Callable[[Column], Column | None]) -> None:
        """Replace the column at a path by f's result; None removes it."""
        self.find(path)
        self.columns = list(changed(self.columns, path, f))


def changed(columns: Iterable[Column], path: tuple[str, ...], f: Callable[[Column], Column | None]) -> tuple[Column, ...]:
    out = []
    for c in columns:
        if c.name == path[0]:
            c = f(c) if len(path) == 1 else replace(c, data_type=replace(c.data_type, children=changed(c.data_type.children, path[1:], f)))
        if c is not None:
            out.append(c)
    if len({c.name for c in out}) < len(out):
        raise AlreadyExistsError("a column of that name exists")
    return tuple(out)


@dataclass
class Catalog:
    snapshot: Snapshot
    data_path: str
    schemas: dict[int, SchemaDef] = field(default_factory=dict)
    tables: dict[int, TableDef] = field(default_factory=dict)

    def copy(self) -> Catalog:
        return Catalog(self.snapshot, self.data_path, {i: replace(s) for i, s in self.schemas.items()}, {i: t.copy() for i, t in self.tables.items()})

    def schema(self, name: str) -> SchemaDef:
        for s in self.schemas.values():
            if s.name == name:
                return s
        raise NotFoundError(f"schema {name} does not exist")

    def table(self, name: TableName) -> TableDef:
        s = self.schema(name.schema)
        for t in self.tables.values():
            if t.schema_id == s.id and t.name == name.name:
                return t
        raise NotFoundError(f"table {name} does not exist")

    def name_of(self, t: TableDef) -> TableName:
        return TableName(self.schemas[t.schema_id].name, t.name)

    def path_of(self, t: TableDef) -> str:
        s = self.schemas[t.schema_id]
        base = self.data_path + s.path if s.relative else s.path
        return base + t.path if t.relative else t.path


def default_of(text: str | None, kind: str | None, dialect: str | None, t: DataType):
    if text is None:
        return None
    return (dialect, text) if kind == "expression" else parse_value(text, t)


def columns_of(rows: list[dict], tags: dict[int, dict[str, str]]) -> list[Column]:
    below: dict[int | None, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r["column_order"], r["column_id"])):
        below.setdefault(r["parent_column"], []).append(r)

    def build(parent: int | None) -> list[Column]:
        out = []
        for r in below.get(parent, []):
            t = parse_type(r["column_type"], build(r["column_id"]))
            default = default_of(r["default_value"], r["default_value_type"], r["default_value_dialect"], t)
            out.append(Column(r["column_name"], t, bool(r["nulls_allowed"]), tags.get(r["column_id"], {}), default_of(r["initial_default"], None, None, t), default, r["column_id"]))
        return out

    return build(None)


def column_rows(table_id: int, columns: list[Column]) -> dict[int, dict]:
    """Catalog rows by column id, without their lives."""
    out: dict[int, dict] = {}

    def add(c: Column, parent: int | None) -> None:
        expression = isinstance(c.default_value, tuple) and c.data_type.kind != "interval"
        default = None if c.default_value is None else c.default_value[1] if expression else format_value(c.default_value, c.data_type)
        out[c.field_id] = {"column_id": c.field_id, "table_id": table_id, "column_order": c.field_id, "column_name": c.name, "column_type": str(c.data_type), "initial_default": None if c.initial_default is None else format_value(c.initial_default, c.data_type),
                           "default_value": default, "nulls_allowed": c.nullable, "parent_column": parent, "default_value_type": "expression" if expression else "literal", "default_value_dialect": c.default_value[0] if expression else None}
        for x in c.data_type.children:
            add(x, c.field_id)

    for c in columns:
        add(c, None)
    return out


def load(s: Session, snapshot: Snapshot) -> Catalog:
    """The catalog as it was at a snapshot."""
    at = (snapshot.id, snapshot.id)
    data_path = s.rows("""SELECT value FROM {metadata} WHERE "key" = 'data_path' AND scope IS NULL""")[0]["value"]
    out = Catalog(snapshot, data_path)
    for r in s.rows(f"SELECT * FROM {{schema}} WHERE {ALIVE}", *at):
        out.schemas[r["schema_id"]] = SchemaDef(r["schema_id"], r["schema_uuid"], r["schema_name"], r["path"], bool(r["path_is_relative"]))
    columns: dict[int, list[dict]] = {}
    for r in s.rows(f"SELECT * FROM {{column}} WHERE {ALIVE}", *at):
        columns.setdefault(r["table_id"], []).append(r)
    tags: dict[int, dict[int, dict[str, str]]] = {}
    for r in s.rows(f"SELECT * FROM {{column_tag}} WHERE {ALIVE}", *at):
        tags.setdefault(r["table_id"], {}).setdefault(r["column_id"], {})[r["key"]] = r["value"]
    own: dict[int, dict[str, str]] = {}
    for r in s.rows(f"SELECT * FROM {{tag}} WHERE {ALIVE}", *at):
        own.setdefault(r["object_id"], {})[r["key"]] = r["value"]
    # ids are never used again, also not those of columns that are gone
    following = {r["table_id"]: r["m"] + 1 for r in s.rows("SELECT table_id, MAX(column_id) AS m FROM {column} GROUP BY table_id")}
    parts: dict[int, list[dict]] = {}
    for r in s.rows(f"SELECT i.partition_id, i.table_id, c.partition_key_index, c.column_id, c.transform FROM {{partition_info}} i JOIN {{partition_column}} c ON i.partition_id = c.partition_id WHERE i.{ALIVE.replace('OR end', 'OR i.end').replace('(end', '(i.end')}", *at):
        parts.setdefault(r["table_id"], []).append(r)
    for r in s.rows(f"SELECT * FROM {{table}} WHERE {ALIVE}", *at):
        i = r["table_id"]
        keys = sorted(parts.get(i, []), key=lambda p: p["partition_key_index"])
        out.tables[i] = TableDef(i, r["table_uuid"], r["schema_id"], r["table_name"], r["path"], bool(r["path_is_relative"]), columns_of(columns.get(i, []), tags.get(i, {})), [(p["column_id"], p["transform"]) for p in keys], keys[0]["partition_id"] if keys else None, own.get(i, {}), following.get(i, 1))
    return out


def snapshots(s: Session) -> list[Snapshot]:
    """Newest first."""
    return [Snapshot.of(r) for r in s.rows("SELECT * FROM {snapshot} ORDER BY snapshot_id DESC")]


def latest(s: Session) -> Snapshot:
    return Snapshot.of(s.rows("SELECT * FROM {snapshot} ORDER BY snapshot_id DESC LIMIT 1")[0])


def snapshot_of_schema(s: Session, version: int) -> Snapshot:
    """The newest snapshot with a version of the schema.

    If those are all expired, one that reads as the first of them did: its id comes from what schema versions note, and
    its time and next ids mean nothing.
    """
    rows = s.rows("SELECT * FROM {snapshot} WHERE schema_version = ? ORDER BY snapshot_id DESC LIMIT 1", version)
    if rows:
        return Snapshot.of(rows[0])
    first = s.rows("SELECT MIN(begin_snapshot) AS m FROM {schema_versions} WHERE schema_version = ?", version)[0]["m"]
    if first is None:
        raise NotFoundError(f"no snapshot has version {version} of the schema")
    return Snapshot(first, dt.datetime.fromtimestamp(0, dt.UTC), version, 0, 0)


def snapshot_at(s: Session, at: int | dt.datetime) -> Snapshot:
    if isinstance(at, dt.datetime):
        text = (at if at.tzinfo else at.replace(tzinfo=dt.UTC)).astimezone(dt.UTC).isoformat(timespec="microseconds")
        rows = s.rows("SELECT * FROM {snapshot} WHERE snapshot_time <= ? ORDER BY snapshot_time DESC, snapshot_id DESC LIMIT 1", text)
    else:
        rows = s.rows("SELECT * FROM {snapshot} WHERE snapshot_id = ?", at)
    if not rows:
        raise NotFoundError(f"no snapshot at {at}")
    return Snapshot.of(rows[0])
