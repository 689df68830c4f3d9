"""Transactions: a private catalog that a commit compares with the one it began from.

Operations change the private copy and note data changes.  The commit writes the difference between the two catalogs as
versioned rows, in one database transaction: what is created and dropped again leaves no trace, and renames, types and tags
need no statements of their own.  New schemas and tables have negative ids until the commit gives them real ones.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame

from .catalog import changes as ch
from .catalog import model, options
from .catalog.model import SchemaDef, TableDef, column_rows
from .catalog.store import Conflict, Session, new_uuid, now_text
from .errors import AlreadyExistsError, InvalidCastError, InvalidNullabilityChangeError, NotFoundError, TransactionConflictError
from .identifiers import TableName, column_path, table_name
from .literals import format_value
from .operators import write as w
from .plans.scan import deletes_name, inlined_name
from .sources.storage import absolute, relative_to
from .types import PROMOTIONS, Column, DataType, Partitioning, Schema

if TYPE_CHECKING:
    from .lake import Lake

RETRIES = 10
#: Statistics that wait in memory before they are inserted.
MANY_ROWS = 50_000


@dataclass
class TableData:
    """Data changes of one table in a transaction."""

    files: list[w.WriteDataFile] = field(default_factory=list)
    inlined: list[dict[int, Any]] = field(default_factory=list)
    #: (data file id, path, count, bytes); each takes the place of the delete files of its data file
    delete_files: list[tuple[int, str, int, int]] = field(default_factory=list)
    #: (data file id, position)
    deleted: list[tuple[int, int]] = field(default_factory=list)
    ended_files: list[int] = field(default_factory=list)
    ended_inlined: list[int] = field(default_factory=list)
    #: rows that were alive and are deleted
    removed: int = 0
    #: rows that files of compactions hold keep their count in the table's statistics
    kinds: list[str] = field(default_factory=list)
    compaction: bool = False


class Transaction:
    def __init__(self, lake: Lake, author: str | None = None, message: str | None = None, extra_info: str | None = None):
        lake.require_write()
        self.lake, self.info = lake, (author, message, extra_info)
        self.base = lake.catalog()
        self.catalog = self.base.copy()
        self.data: dict[int, TableData] = {}
        self.new_ids = itertools.count(-1, -1)
        #: what else the commit writes into the catalog database, in the same database transaction
        self.notes: list[Callable[[Session], None]] = []
        self.done = False

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind: Any, *_: Any) -> None:
        if kind is None and not self.done:
            self.commit()

    # schemas and tables

    def list_schemas(self) -> list[str]:
        return sorted(s.name for s in self.catalog.schemas.values())

    def list_tables(self, schema: str | None = None) -> list[TableName]:
        return sorted(n for n in map(self.catalog.name_of, self.catalog.tables.values()) if schema in (None, n.schema))

    def create_schema(self, name: str, *, data_path: str | None = None, if_exists: str = "fail") -> None:
        if name in self.list_schemas():
            if if_exists == "skip":
                return
            raise AlreadyExistsError(f"schema {name} exists")
        path = folder(data_path or name)
        i = next(self.new_ids)
        self.catalog.schemas[i] = SchemaDef(i, new_uuid(), name, path, not absolute(path))

    def delete_schema(self, name: str, *, cascade: bool = False) -> None:
        s = self.catalog.schema(name)
        own = [t.id for t in self.catalog.tables.values() if t.schema_id == s.id]
        if own and not cascade:
            raise ValueError(f"schema {name} is not empty")
        for i in own:
            self.drop(i)
        del self.catalog.schemas[s.id]

    def create_table(self, name: str | tuple, schema: Any, *, partition_by: Any = None, data_path: str | None = None, tags: dict[str, str] | None = None, if_exists: str = "fail") -> TransactionTable:
        full = table_name(name)
        s = self.catalog.schema(full.schema)
        if full in self.list_tables(full.schema):
            if if_exists == "skip":
                return self.table(full)
            raise AlreadyExistsError(f"table {full} exists")
        path, i = folder(data_path or full.name), next(self.new_ids)
        t = TableDef(i, new_uuid(), s.id, full.name, path, not absolute(path), tags=dict(tags or {}))
        t.columns = [t.number(c) for c in Schema(schema).columns]
        self.catalog.tables[i] = t
        if partition_by:
            set_partition(t, partition_by)
        return TransactionTable(self, i)

    def table(self, name: str | tuple) -> TransactionTable:
        return TransactionTable(self, self.catalog.table(table_name(name)).id)

    def drop(self, i: int) -> None:
        del self.catalog.tables[i]
        self.data.pop(i, None)

    def of(self, i: int) -> TableData:
        return self.data.setdefault(i, TableData())

    # the commit

    def applied(self) -> list[ch.Applied]:
        """What the commit will say that it did; ids of new things are not known yet, and need not be: nobody else has them."""
        out = []
        b, p = self.base, self.catalog
        for i, s in p.schemas.items():
            if i < 0:
                out.append(ch.Applied("created_schema", None, (s.name,)))
        for i in b.schemas.keys() - p.schemas.keys():
            out.append(ch.Applied("dropped_schema", i))
        for i, t in p.tables.items():
            if i < 0:
                out.append(ch.Applied("created_table", None, tuple(p.name_of(t))))
            elif differs(t, b.tables[i]):
                out.append(ch.Applied("altered_table", i))
                if t.name != b.tables[i].name:
                    out.append(ch.Applied("created_table", None, tuple(p.name_of(t))))
        for i in b.tables.keys() - p.tables.keys():
            out.append(ch.Applied("dropped_table", i))
        for i, d in self.data.items():
            out += [ch.Applied(k, i) for k in dict.fromkeys(d.kinds)]
        return out

    def commit(self) -> int | None:
        """The new snapshot's id; None if nothing changed. Retries while others commit what does not conflict."""
        if self.done:
            raise ValueError("the transaction was committed already")
        ours = self.applied()
        if not ours:
            self.done = True
            return None
        if self.lake.options()["require_commit_message"] and not self.info[1]:
            raise ValueError("this lake requires a commit message")
        for _ in range(RETRIES + 1):
            try:
                with self.lake.store.writing() as s:
                    head = model.latest(s)
                    self.check(s, head, ours)
                    new = Commit(self, s, head).run(ours)
            except Conflict:
                continue
            self.done = True
            self.lake.forget()
            return new
        raise TransactionConflictError(f"other commits came first {RETRIES + 1} times")

    def check(self, s: Session, head: model.Snapshot, ours: list[ch.Applied]) -> None:
        schemas = {x.name: x.id for x in self.base.schemas.values()}
        for r in s.rows("SELECT changes_made FROM {snapshot_changes} WHERE snapshot_id > ? AND snapshot_id <= ? ORDER BY snapshot_id", self.base.snapshot.id, head.id):
            for theirs in ch.parse_changes(r["changes_made"]):
                for own in ours:
                    why = ch.conflict(own, theirs, schemas)
                    if why:
                        raise TransactionConflictError(why)


def differs(t: TableDef, old: TableDef | None) -> bool:
    """Types compare by shape; here nested ids, tags and defaults count too."""
    if old is None:
        return True
    tags = lambda x: {i: c.tags for i, c in x.by_id().items()}
    return (t.name, t.tags, t.partition, tags(t), column_rows(t.id, t.columns)) != (old.name, old.tags, old.partition, tags(old), column_rows(old.id, old.columns))


def folder(path: str) -> str:
    return path if path.endswith("/") else path + "/"


def set_partition(t: TableDef, partitioning: Any) -> None:
    if partitioning is None:
        t.partition, t.partition_id = [], None
        return
    p = partitioning if isinstance(partitioning, Partitioning) else Partitioning(partitioning)
    ids = {c.name: c.field_id for c in t.columns}
    for c in p.columns:
        if c.column not in ids:
            raise NotFoundError(f"column {c.column} does not exist")
    new = [(ids[c.column], c.transform) for c in p.columns]
    if new != t.partition:
        t.partition, t.partition_id = new, None


class Commit:
    """One attempt at writing a transaction's difference into the database, on top of ``head``."""

    def __init__(self, tx: Transaction, s: Session, head: model.Snapshot):
        self.tx, self.s, self.head, self.id = tx, s, head, head.id + 1
        self.next_catalog, self.next_file = head.next_catalog_id, head.next_file_id
        self.real: dict[int, int] = {}

    def catalog_id(self) -> int:
        self.next_catalog += 1
        return self.next_catalog - 1

    def file_id(self) -> int:
        self.next_file += 1
        return self.next_file - 1

    def end(self, table: str, where: str, *args: Any) -> None:
        self.s.run(f"UPDATE {{{table}}} SET end_snapshot = ? WHERE end_snapshot IS NULL AND {where}", self.id, *args)

    def run(self, ours: list[ch.Applied]) -> int:
        s, b, p = self.s, self.tx.base, self.tx.catalog
        taken = {(r["schema_id"], r["table_name"]) for r in s.rows("SELECT schema_id, table_name FROM {table} WHERE end_snapshot IS NULL")} if self.head.id != b.snapshot.id else set()
        for i in b.schemas.keys() - p.schemas.keys():
            self.end("schema", "schema_id = ?", i)
        for i in b.tables.keys() - p.tables.keys():
            for table in ("table", "column", "partition_info", "column_tag", "data_file", "delete_file"):
                self.end(table, "table_id = ?", i)
            self.end("tag", "object_id = ?", i)
        for i, x in p.schemas.items():
            self.real[i] = i if i >= 0 else self.catalog_id()
            if i < 0:
                s.insert("schema", [{"schema_id": self.real[i], "schema_uuid": x.uuid, "begin_snapshot": self.id, "schema_name": x.name, "path": x.path, "path_is_relative": x.relative}])
        changed = []
        for i, t in p.tables.items():
            old = b.tables.get(i)
            self.real[i] = i if i >= 0 else self.catalog_id()
            if differs(t, old):
                if (old is None or old.name != t.name) and (self.real[t.schema_id], t.name) in taken:
                    raise TransactionConflictError(f"table {t.name} was created meanwhile")
                self.table(t, old)
                changed.append(self.real[i])
        version = self.head.schema_version
        if changed or any(a.kind.startswith(("created", "dropped", "altered")) for a in ours):
            version += 1
        s.insert("schema_versions", [{"begin_snapshot": self.id, "schema_version": version, "table_id": i} for i in changed])
        for i in changed:
            self.inlined_table(i, version)
        for i, d in self.tx.data.items():
            if i in p.tables:
                self.data(p.tables[i], d, version)
        texts = [replace(a, id=self.real.get(a.id, a.id)) for a in ours]
        s.insert("snapshot", [{"snapshot_id": self.id, "snapshot_time": now_text(), "schema_version": version, "next_catalog_id": self.next_catalog, "next_file_id": self.next_file}])
        author, message, extra = self.tx.info
        s.insert("snapshot_changes", [{"snapshot_id": self.id, "changes_made": ch.format_changes(texts), "author": author, "commit_message": message, "commit_extra_info": extra}])
        for note in self.tx.notes:
            note(s)
        return self.id

    def table(self, t: TableDef, old: TableDef | None) -> None:
        s, i = self.s, self.real[t.id]
        row = {"table_id": i, "table_uuid": t.uuid, "begin_snapshot": self.id, "schema_id": self.real[t.schema_id], "table_name": t.name, "path": t.path, "path_is_relative": t.relative}
        if old is None or old.name != t.name:
            self.end("table", "table_id = ?", i)
            s.insert("table", [row])
        before, after = column_rows(i, old.columns) if old else {}, column_rows(i, t.columns)
        for k in before:
            if after.get(k) != before[k]:
                self.end("column", "table_id = ? AND column_id = ?", i, k)
        s.insert("column", [r | {"begin_snapshot": self.id} for k, r in after.items() if before.get(k) != r])
        self.tags("tag", {"object_id": i}, old.tags if old else {}, t.tags)
        was, now = old.by_id() if old else {}, t.by_id()
        for k in was.keys() | now.keys():
            self.tags("column_tag", {"table_id": i, "column_id": k}, was[k].tags if k in was else {}, now[k].tags if k in now else {})
        if t.partition != (old.partition if old else []):
            self.end("partition_info", "table_id = ?", i)
            if t.partition:
                t.partition_id = self.catalog_id()
                s.insert("partition_info", [{"partition_id": t.partition_id, "table_id": i, "begin_snapshot": self.id}])
                s.insert("partition_column", [{"partition_id": t.partition_id, "table_id": i, "partition_key_index": k, "column_id": c, "transform": how} for k, (c, how) in enumerate(t.partition)])

    def tags(self, table: str, key: dict[str, int], old: dict[str, str], new: dict[str, str]) -> None:
        where = " AND ".join(f"{k} = ?" for k in key)
        for k in old:
            if new.get(k) != old[k]:
                self.end(table, f'{where} AND "key" = ?', *key.values(), k)
        self.s.insert(table, [key | {"begin_snapshot": self.id, "key": k, "value": v} for k, v in new.items() if old.get(k) != v])

    def inlined_table(self, i: int, version: int) -> None:
        s, t = self.s, next(t for t in self.tx.catalog.tables.values() if self.real[t.id] == i)
        name = inlined_name(s.store.prefix, i, version)
        columns = ", ".join(f"c{c.field_id} {storage_class(c.data_type, s.store.blob)}" for c in t.columns)
        s.run(f"CREATE TABLE {name} (row_id BIGINT, begin_snapshot BIGINT, end_snapshot BIGINT{', ' + columns if columns else ''})")
        s.insert("inlined_data_tables", [{"table_id": i, "table_name": name, "schema_version": version}])

    def data(self, t: TableDef, d: TableData, version: int) -> None:
        s, i, path = self.s, self.real[t.id], self.tx.catalog.path_of(t)
        found = s.rows("SELECT * FROM {table_stats} WHERE table_id = ?", i)
        stats = found[0] if found else {"table_id": i, "record_count": 0, "next_row_id": 0, "file_size_bytes": 0}
        s.run_for(d.ended_files, "UPDATE {data_file} SET end_snapshot = ? WHERE end_snapshot IS NULL AND data_file_id IN {ids}", self.id)
        s.run_for([*d.ended_files, *(f[0] for f in d.delete_files)], "UPDATE {delete_file} SET end_snapshot = ? WHERE end_snapshot IS NULL AND data_file_id IN {ids}", self.id)
        if d.ended_inlined:
            for v in s.rows("SELECT table_name FROM {inlined_data_tables} WHERE table_id = ?", i):
                s.run_for(d.ended_inlined, f"UPDATE {v['table_name']} SET end_snapshot = ? WHERE end_snapshot IS NULL AND row_id IN {{ids}}", self.id)
        names = {c.field_id: c.name for c in t.columns}
        by_id, rows, files, values = t.by_id(), [], [], []
        for f in d.files:
            k = self.file_id()
            p, rel = relative_to(f.path, path)
            st = f.statistics
            files.append({"data_file_id": k, "table_id": i, "begin_snapshot": self.id, "path": p, "path_is_relative": rel, "file_format": "parquet", "record_count": st.rows, "file_size_bytes": st.bytes, "footer_size": st.footer, "row_id_start": stats["next_row_id"], "partition_id": t.partition_id if f.partition_values else None, "schema_version": version})
            if f.partition_values:
                values += [{"data_file_id": k, "table_id": i, "partition_key_index": n, "partition_value": None if f.partition_values[names[c]] is None else str(f.partition_values[names[c]])} for n, (c, _) in enumerate(t.partition)]
            for c, x in st.columns.items():
                if c in by_id:
                    bounds = {"min_value": None if x.min is None else format_value(x.min, by_id[c].data_type), "max_value": None if x.max is None else format_value(x.max, by_id[c].data_type)}
                    rows.append({"data_file_id": k, "table_id": i, "column_id": c, "column_size_bytes": x.size, "value_count": x.values, "null_count": x.nulls, **bounds, "contains_nan": x.nan})
            if len(rows) >= MANY_ROWS:
                s.insert("file_column_stats", rows)
                rows = []
            stats["next_row_id"] += st.rows
            stats["record_count"] += 0 if d.compaction else st.rows
            stats["file_size_bytes"] += st.bytes
        s.insert("data_file", files)
        s.insert("file_partition_value", values)
        s.insert("file_column_stats", rows)
        if d.inlined:
            last = s.rows("SELECT table_name FROM {inlined_data_tables} WHERE table_id = ? ORDER BY schema_version DESC LIMIT 1", i)[0]["table_name"]
            s.insert(last, [{"row_id": stats["next_row_id"] + n, "begin_snapshot": self.id} | {f"c{c}": v for c, v in r.items()} for n, r in enumerate(d.inlined)])
            stats["next_row_id"] += len(d.inlined)
            stats["record_count"] += len(d.inlined)
            self.next_file += 1  # so that what is cached by file id is read anew
        marks = []
        for k, p, n, size in d.delete_files:
            p, rel = relative_to(p, path)
            marks.append({"delete_file_id": self.file_id(), "table_id": i, "begin_snapshot": self.id, "data_file_id": k, "path": p, "path_is_relative": rel, "format": "parquet", "delete_count": n, "file_size_bytes": size})
        s.insert("delete_file", marks)
        stats["record_count"] -= d.removed
        if d.deleted:
            name = deletes_name(s.store.prefix, i)
            s.run(f"CREATE TABLE IF NOT EXISTS {name} (file_id BIGINT, row_id BIGINT, begin_snapshot BIGINT)")
            s.insert(name, [{"file_id": k, "row_id": r, "begin_snapshot": self.id} for k, r in d.deleted])
        s.run("DELETE FROM {table_stats} WHERE table_id = ?", i)
        s.insert("table_stats", [stats])
        self.column_stats(t, d)

    def column_stats(self, t: TableDef, d: TableData) -> None:
        """Bounds and flags of the whole table only ever widen."""
        from .literals import parse_value

        s, i = self.s, self.real[t.id]
        old = {r["column_id"]: r for r in s.rows("SELECT * FROM {table_column_stats} WHERE table_id = ?", i)}
        for c in t.by_id().values():
            if c.data_type.children:
                continue
            seen = [f.statistics.columns[c.field_id] for f in d.files if c.field_id in f.statistics.columns]
            values = [parse_value(str(r[c.field_id]), c.data_type) for r in d.inlined if r.get(c.field_id) is not None and not isinstance(r[c.field_id], bytes)]
            nulls = merge([None if x.nulls is None else x.nulls > 0 for x in seen] + [r.get(c.field_id) is None for r in d.inlined if c.field_id in r])
            if not seen and not d.inlined:
                continue
            is_float = c.data_type.kind in ("float32", "float64")
            nans = merge([x.nan for x in seen] + [any(v != v for v in values)] * bool(d.inlined)) if is_float else None
            values = [v for v in values if v == v]
            was = old.get(c.field_id)
            known = [parse_value(was[k], c.data_type) for k in ("min_value", "max_value")] if was else [None, None]
            low = bound(min, [known[0], *(x.min for x in seen), *values])
            high = bound(max, [known[1], *(x.max for x in seen), *values])
            row = {"table_id": i, "column_id": c.field_id, "contains_null": merge([nulls, *([bool(was["contains_null"])] if was and was["contains_null"] is not None else [])]),
                   "contains_nan": merge([nans, *([None if was["contains_nan"] is None else bool(was["contains_nan"])] if was else [])]) if is_float else None,
                   "min_value": None if low is None else format_value(low, c.data_type), "max_value": None if high is None else format_value(high, c.data_type)}
            s.run("DELETE FROM {table_column_stats} WHERE table_id = ? AND column_id = ?", i, c.field_id)
            s.insert("table_column_stats", [row])


def merge(flags: list[bool | None]) -> bool | None:
    """True if any is; else unknown if any is; else False."""
    return True if True in flags else None if None in flags else False


def bound(f: Callable, values: list) -> Any:
    """The least or greatest that is known; None if they can't be compared."""
    known = [v for v in values if v is not None]
    try:
        return f(known) if known else None
    except TypeError:
        return None


def storage_class(t: DataType, blob: str = "BLOB") -> str:
    """What an inlined value is in the database."""
    if t.kind == "blob":
        return blob
    return "BIGINT" if t.kind in ("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32") else "TEXT"


class TransactionTable:
    """A table inside a transaction; all operations take effect at the commit."""

    def __init__(self, tx: Transaction, i: int):
        self.tx, self.id = tx, i

    @property
    def t(self) -> TableDef:
        t = self.tx.catalog.tables.get(self.id)
        if t is None:
            raise NotFoundError("the table was dropped")
        return t

    @property
    def name(self) -> TableName:
        return self.tx.catalog.name_of(self.t)

    @property
    def schema(self) -> Schema:
        return self.t.schema()

    @property
    def partitioning(self) -> Partitioning | None:
        return self.t.partitioning()

    # data

    def options(self) -> dict[str, Any]:
        t = self.t
        return options.resolve(self.tx.lake.store, t.schema_id if t.schema_id >= 0 else None, t.id if t.id >= 0 else None)

    def get_write_info(self) -> w.WriteInfo:
        names = {c.field_id: c.name for c in self.t.columns}
        return w.WriteInfo(self.options(), self.tx.catalog.path_of(self.t), [names[i] for i, _ in self.t.partition])

    def append(self, df: DataFrame, inline: bool = True) -> None:
        """Few rows go into the catalog, others into files; ``inline=False`` always writes files."""
        opts = self.options()
        prepared = w.prepare(df, self.t)
        rows = w.inline_rows(prepared, self.t, opts["data_inlining_row_limit"]) if inline and self.tx.lake.inlines else None
        if rows is not None:
            self.write_inline(rows)
        else:
            self.add_files(w.write_files(prepared, self.t, self.tx.catalog.path_of(self.t), opts))

    def sink(self, df: DataFrame) -> None:
        self.append(df, inline=False)

    def delete_where(self, where: str) -> None:
        """Delete committed rows; rows that this transaction adds stay. Once a table and transaction: it sees what was committed before."""
        from .operators.delete import delete_rows

        if self.id in self.tx.data and self.tx.data[self.id].removed:
            raise ValueError("the transaction has deleted from this table already")
        if self.id >= 0:
            delete_rows(self, self.tx.lake.get_table(self.name_at_base()).scan_for(where, self.tx.base), where)

    def name_at_base(self) -> TableName:
        return self.tx.base.name_of(self.tx.base.tables[self.id])

    def write_inline(self, rows: list[dict[int, Any]]) -> None:
        if rows:
            d = self.tx.of(self.id)
            d.inlined += rows
            d.kinds.append("inlined_insert")

    def write_data_files(self, files: Any) -> None:
        self.add_files(w.register(self.tx.lake.spark, files, self.t))

    def write_data(self, f: Callable[[w.WriteInfo], Sequence[w.WriteDataFile]]) -> None:
        """f writes files where its argument says and returns them."""
        self.write_data_files(list(f(self.get_write_info())))

    def add_files(self, files: list[w.WriteDataFile]) -> None:
        for f in files:
            w.check_nulls(self.t, lambda c: bool((f.statistics.columns.get(c.field_id) or w.NONE).nulls))
        if files:
            d = self.tx.of(self.id)
            d.files += files
            d.kinds.append("inserted_into_table")

    # definition

    def delete(self) -> None:
        self.t  # noqa: B018 - raises if it is gone
        self.tx.drop(self.id)

    def rename(self, new_name: str) -> None:
        t = self.t
        if new_name == t.name:
            return
        if TableName(self.name.schema, new_name) in self.tx.list_tables():
            raise AlreadyExistsError(f"table {new_name} exists")
        t.name = new_name

    def add_column(self, column: Column, parent: Any = None) -> None:
        t, path = self.t, column_path(parent) if parent else ()
        if len(t.columns) == 0 and path:
            raise NotFoundError("the table has no columns")
        if not column.nullable and column.initial_default is None and t.id >= 0:
            raise InvalidNullabilityChangeError("rows that exist would have a null in it")
        level = t.find(path).data_type.children if path else t.columns
        if any(c.name == column.name for c in level):
            raise AlreadyExistsError(f"column {column.name} exists")
        new = t.number(column)
        if path:
            t.change(path, lambda c: replace(c, data_type=replace(c.data_type, children=(*c.data_type.children, new))))
        else:
            t.columns = [*t.columns, new]

    def remove_column(self, path: Any) -> None:
        t, p = self.t, column_path(path)
        c = t.find(p)
        if c.field_id in {i for i, _ in t.partition}:
            raise ValueError(f"the table is partitioned by {c.name}")
        t.change(p, lambda _: None)

    def rename_column(self, path: Any, new_name: str) -> None:
        self.t.change(column_path(path), lambda c: replace(c, name=new_name))

    def update_column_dtype(self, path: Any, dtype: DataType) -> None:
        t = self.t
        t.change(column_path(path), lambda c: replace(c, data_type=promoted(t, c.data_type, dtype)))

    def update_column_default(self, path: Any, value: Any) -> None:
        """A literal, (dialect, expression), or None for no default."""
        self.t.change(column_path(path), lambda c: replace(c, default_value=value))

    def update_column_nullability(self, path: Any, nullable: bool) -> None:
        p = column_path(path)
        if not nullable:
            self.tx.lake.refuse_nulls(self.t, p, self.tx.of(self.id) if self.id in self.tx.data else None)
        self.t.change(p, lambda c: replace(c, nullable=nullable))

    def update_schema(self, schema: Any) -> None:
        """Columns by name: types, defaults and nullability of those in both; others are removed or added. All or nothing."""
        new, before = Schema(schema), self.tx.catalog.tables[self.id].copy()
        try:
            for c in list(self.t.columns):
                if c.name not in new.names():
                    self.remove_column((c.name,))
            for c in sorted(new.columns, key=lambda c: c.name):
                if c.name not in self.schema.names():
                    self.add_column(c)
                    continue
                old = self.t.find((c.name,))
                if old.data_type != c.data_type:
                    self.update_column_dtype((c.name,), c.data_type)
                if old.default_value != c.default_value:
                    self.update_column_default((c.name,), c.default_value)
                if old.nullable != c.nullable:
                    self.update_column_nullability((c.name,), c.nullable)
        except BaseException:
            self.tx.catalog.tables[self.id] = before
            raise

    def update_partitioning(self, partitioning: Any) -> None:
        set_partition(self.t, partitioning)

    def add_tag(self, key: str, value: str) -> None:
        self.t.tags[key] = value

    def remove_tag(self, key: str) -> None:
        if key not in self.t.tags:
            raise NotFoundError(f"no tag {key}")
        del self.t.tags[key]

    def add_column_tag(self, path: Any, key: str, value: str) -> None:
        self.t.change(column_path(path), lambda c: replace(c, tags={**c.tags, key: value}))

    def remove_column_tag(self, path: Any, key: str) -> None:
        def without(c: Column) -> Column:
            if key not in c.tags:
                raise NotFoundError(f"no tag {key}")
            return replace(c, tags={k: v for k, v in c.tags.items() if k != key})

        self.t.change(column_path(path), without)


def promoted(t: TableDef, old: DataType, new: DataType) -> DataType:
    """Wider numbers; of structs fields may come, go or be promoted; of lists and maps the parts."""
    if old.kind != new.kind or old.args != new.args:
        if new.kind not in PROMOTIONS.get(old.kind, ()):
            raise InvalidCastError(f"{old} can't become {new}")
        return new
    if old.kind == "struct":
        have = {c.name: c for c in old.children}
        out = [replace(have[c.name], data_type=promoted(t, have[c.name].data_type, c.data_type)) if c.name in have else t.number(c) for c in new.children]
        return replace(old, children=tuple(out))
    if old.children:
        return replace(old, children=tuple(replace(a, data_type=promoted(t, a.data_type, b.data_type)) for a, b in zip(old.children, new.children)))
    return old
