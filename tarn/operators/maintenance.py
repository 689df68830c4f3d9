"""Upkeep: compaction, rewriting, flushing, expiry and clean-up."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from ..catalog import model
from ..catalog.store import Session, now, now_text
from ..plans.scan import ScanResult, deletes_name, scan, to_df
from ..sources.storage import Files, join, plain

from . import write as w

if TYPE_CHECKING:
    from ..lake import Lake, LakeTable


@dataclass
class MaintenanceResult:
    table: str
    files_processed: int
    files_created: int


@dataclass
class ExpireResult:
    snapshots: list[int] = field(default_factory=list)
    dry_run: bool = False


# -- files of a table -----------------------------------------------------------------------


#: Packs that one job writes.
PACKS = 256


def merge_adjacent_files(table: LakeTable, max_compacted_files: int | None = None, min_file_size: int | None = None, max_file_size: int | None = None) -> MaintenanceResult:
    """Pack files under the target size into files of about that size.

    Files go together in the order of their rows, within one partition.  Files with deletes wait for
    rewrite_data_files().  A job writes PACKS packs at once, each in a task of its own without a shuffle, so rows keep their order.
    """
    lake = table.lake
    with lake.transaction(message="merge adjacent files") as tx:
        t = tx.table(table.name)
        with lake.store.reading() as s:
            result = scan(s, tx.catalog, t.t, stats_of=set())
            values: dict[int, list] = {}
            for r in s.rows("SELECT * FROM {file_partition_value} WHERE table_id = ? ORDER BY partition_key_index", t.id):
                values.setdefault(r["data_file_id"], []).append(r["partition_value"])
        target = max_file_size or t.options()["target_file_size"]
        small = [f for f in result.files if not f.deleted() and f.bytes < target and f.bytes >= (min_file_size or 0)]
        packs: list[list] = []
        open_: dict[tuple, list] = {}
        for f in sorted(small, key=lambda f: (f.row_id_start or 0, f.id)):
            key = tuple(values.get(f.id, ()))
            pack = open_.setdefault(key, [])
            if pack and sum(x.bytes for x in pack) + f.bytes > target:
                packs.append(pack)
                pack = open_[key] = []
            pack.append(f)
        packs = [p for p in [*packs, *open_.values()] if len(p) > 1]
        taken, n = [], 0
        for p in packs:
            if max_compacted_files is None or n + len(p) <= max_compacted_files:
                taken.append(p)
                n += len(p)
        d, created = tx.of(t.id), 0
        for k in range(0, len(taken), PACKS):
            some = taken[k : k + PACKS]
            files = rewritten(lake, t, reduce(DataFrame.union, [to_df(lake, ScanResult(t.t, pack, [])).coalesce(1) for pack in some]), apart=True)
            d.files += files
            d.ended_files += [f.id for pack in some for f in pack]
            created += len(files)
        if taken:
            d.kinds.append("merge_adjacent")
            d.compaction = True
    return MaintenanceResult(str(table.name), n, created)


def rewritten(lake: Lake, t, df, apart: bool = False) -> list[w.WriteDataFile]:
    return w.write_files(df.select(*[f"`{c.name}`" for c in t.t.columns]), t.t, lake.catalog_path(t.tx.catalog, t.t), t.options(), apart)


def rewrite_data_files(table: LakeTable, delete_threshold: float | None = None) -> MaintenanceResult:
    """Write files anew of which more than a part of the rows is deleted.

    All of them are scanned: counts only pick files, so a file ends without a successor only if its scan has no row.
    """
    lake = table.lake
    with lake.transaction(message="rewrite data files") as tx:
        t = tx.table(table.name)
        threshold = t.options()["rewrite_delete_threshold"] if delete_threshold is None else delete_threshold
        with lake.store.reading() as s:
            result = scan(s, tx.catalog, t.t, stats_of=set())
        picked = [f for f in result.files if f.deleted() and f.deleted() > threshold * f.rows]
        d, created = tx.of(t.id), 0
        if picked:
            files = rewritten(lake, t, to_df(lake, ScanResult(t.t, picked, [])))
            d.files += files
            created = len(files)
        d.ended_files += [f.id for f in picked]
        if picked:
            d.kinds.append("rewrite_delete")
            d.compaction = True
    return MaintenanceResult(str(table.name), len(picked), created)


def flush_inlined(table: LakeTable) -> MaintenanceResult:
    """Inlined rows go into a file; inlined positions of deletes stay, as they have no end in the catalog."""
    lake = table.lake
    with lake.transaction(message="flush inlined rows") as tx:
        t = tx.table(table.name)
        with lake.store.reading() as s:
            result = scan(s, tx.catalog, t.t, stats_of=set())
        if not result.inlined:
            return MaintenanceResult(str(table.name), 0, 0)
        files = rewritten(lake, t, to_df(lake, ScanResult(t.t, [], result.inlined)).coalesce(1))
        d = tx.of(t.id)
        d.files += files
        d.ended_inlined += [i for i, _ in result.inlined]
        d.kinds.append("inline_flush")
        d.compaction = True
    return MaintenanceResult(str(table.name), 0, len(files))


# -- snapshots ------------------------------------------------------------------------------


def span(text: str) -> dt.timedelta:
    m = re.fullmatch(r"\s*(\d+)\s*(second|minute|hour|day|week|month|year)s?\s*", str(text))
    if not m:
        raise ValueError(f"{text!r} is no span of time")
    days = {"day": 1, "week": 7, "month": 30, "year": 365}
    n = int(m[1])
    return dt.timedelta(days=n * days[m[2]]) if m[2] in days else dt.timedelta(**{m[2] + "s": n})


#: Versioned rows that can go once no snapshot reaches them.
VERSIONED = ("schema", "table", "column", "column_tag", "tag", "partition_info")


def unreachable(alias: str) -> str:
    return f"{alias}.end_snapshot IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {{snapshot}} sn WHERE sn.snapshot_id >= {alias}.begin_snapshot AND sn.snapshot_id < {alias}.end_snapshot)"


def expire_snapshots(lake: Lake, versions: list[int] | None = None, older_than: dt.datetime | dt.timedelta | None = None, dry_run: bool = False) -> list[model.Snapshot]:
    """Forget snapshots, never the newest, and all that only they reach; their files are scheduled for deletion.

    Without arguments the option expire_older_than says what goes; if that is not set, nothing does.
    """
    if versions is None and older_than is None:
        text = lake.options()["expire_older_than"]
        if text is None:
            return []
        older_than = span(text)
    if isinstance(older_than, dt.timedelta):
        older_than = now() - older_than
    with lake.store.reading() as s:
        every = model.snapshots(s)
    limit = None if older_than is None else older_than if older_than.tzinfo else older_than.replace(tzinfo=dt.UTC)
    gone = [x for x in every[1:] if (x.id in versions if versions is not None else x.time < limit)]
    if dry_run or not gone:
        return gone
    lake.require_write()
    with lake.store.writing() as s:
        s.run_for([x.id for x in gone], "DELETE FROM {snapshot} WHERE snapshot_id IN {ids}")
        s.run_for([x.id for x in gone], "DELETE FROM {snapshot_changes} WHERE snapshot_id IN {ids}")
        sweep(lake, s)
    lake.forget()
    return gone


def sweep(lake: Lake, s: Session) -> None:
    """Delete what no snapshot reaches any more."""
    base = {}
    for r in s.rows("SELECT t.table_id, t.path, t.path_is_relative, s.path AS schema_path, s.path_is_relative AS schema_relative FROM {table} t JOIN {schema} s ON t.schema_id = s.schema_id"):
        root = join(lake.data_path, r["schema_path"]) if r["schema_relative"] else r["schema_path"]
        base[r["table_id"]] = join(root, r["path"]) if r["path_is_relative"] else r["path"]
    for table, key in (("data_file", "data_file_id"), ("delete_file", "delete_file_id")):
        rows = s.rows(f"SELECT x.* FROM {{{table}}} x WHERE {unreachable('x')}")
        s.insert("files_scheduled_for_deletion", [{"data_file_id": r[key], "path": join(base.get(r["table_id"], lake.data_path), r["path"]) if r["path_is_relative"] else r["path"], "path_is_relative": False, "schedule_start": now_text()} for r in rows])
        s.run_for([r[key] for r in rows], f"DELETE FROM {{{table}}} WHERE {key} IN {{ids}}")
    for table in ("file_column_stats", "file_partition_value"):
        s.run(f"DELETE FROM {{{table}}} WHERE NOT EXISTS (SELECT 1 FROM {{data_file}} f WHERE f.data_file_id = {s.store.prefix}{table}.data_file_id)")
    for table in VERSIONED:
        full = f"{s.store.prefix}{table}"
        s.run(f"DELETE FROM {{{table}}} WHERE {unreachable(full)}")
    s.run("DELETE FROM {partition_column} WHERE NOT EXISTS (SELECT 1 FROM {partition_info} i WHERE i.partition_id = " + f"{s.store.prefix}partition_column.partition_id)")
    for r in s.rows("SELECT * FROM {inlined_data_tables}"):
        s.run(f"DELETE FROM {r['table_name']} WHERE end_snapshot IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {{snapshot}} sn WHERE sn.snapshot_id >= {r['table_name']}.begin_snapshot AND sn.snapshot_id < {r['table_name']}.end_snapshot)")
    alive = {r["table_id"] for r in s.rows("SELECT DISTINCT table_id FROM {table}")}
    dead = {r["table_id"] for r in s.rows("SELECT DISTINCT table_id FROM {schema_versions}")} - alive
    for i in dead:
        for r in s.rows("SELECT table_name FROM {inlined_data_tables} WHERE table_id = ?", i):
            s.run(f"DROP TABLE IF EXISTS {r['table_name']}")
        s.run(f"DROP TABLE IF EXISTS {deletes_name(s.store.prefix, i)}")
        for table in ("inlined_data_tables", "schema_versions", "table_stats", "table_column_stats"):
            s.run(f"DELETE FROM {{{table}}} WHERE table_id = ?", i)


def limit_of(lake: Lake, cleanup_all: bool, older_than: dt.datetime | dt.timedelta | None) -> dt.datetime:
    if cleanup_all:
        return now() + dt.timedelta(days=1)
    if older_than is None:
        older_than = span(lake.options()["delete_older_than"])
    if isinstance(older_than, dt.timedelta):
        return now() - older_than
    return older_than if older_than.tzinfo else older_than.replace(tzinfo=dt.UTC)


def cleanup_old_files(lake: Lake, cleanup_all: bool = False, older_than: dt.datetime | dt.timedelta | None = None, dry_run: bool = False) -> list[str]:
    """Delete files that were scheduled long enough ago; files that are gone already are no error."""
    limit = limit_of(lake, cleanup_all, older_than)
    rows = [r for r in lake.store.rows("SELECT * FROM {files_scheduled_for_deletion}") if dt.datetime.fromisoformat(r["schedule_start"]) < limit]
    if not dry_run and rows:
        lake.require_write()
        files = Files(lake.spark)
        for r in rows:
            files.delete(r["path"])
        with lake.store.writing() as s:
            s.run_for([r["path"] for r in rows], "DELETE FROM {files_scheduled_for_deletion} WHERE path IN {ids}")
    return sorted(r["path"] for r in rows)


def delete_orphaned_files(lake: Lake, cleanup_all: bool = False, older_than: dt.datetime | dt.timedelta | None = None, dry_run: bool = False) -> list[str]:
    """Delete files below the data path that no snapshot, and no schedule, knows."""
    limit = limit_of(lake, cleanup_all, older_than)
    with lake.store.reading() as s:
        base, known = {}, set()
        for r in s.rows("SELECT t.table_id, t.path, t.path_is_relative, s.path AS schema_path, s.path_is_relative AS schema_relative FROM {table} t JOIN {schema} s ON t.schema_id = s.schema_id"):
            root = join(lake.data_path, r["schema_path"]) if r["schema_relative"] else r["schema_path"]
            base[r["table_id"]] = join(root, r["path"]) if r["path_is_relative"] else r["path"]
        for r in s.rows("SELECT table_id, path, path_is_relative FROM {data_file} UNION ALL SELECT table_id, path, path_is_relative FROM {delete_file}"):
            known.add(plain(join(base.get(r["table_id"], lake.data_path), r["path"]) if r["path_is_relative"] else r["path"]))
        known |= {plain(r["path"]) for r in s.rows("SELECT path FROM {files_scheduled_for_deletion}")}
    files = Files(lake.spark)
    gone = [f.path for f in files.list(lake.data_path) if f.path.endswith(".parquet") and f.path not in known and dt.datetime.fromtimestamp(f.modified_ms / 1000, dt.UTC) < limit]
    if not dry_run and gone:
        lake.require_write()
        for p in gone:
            files.delete(p)
    return sorted(gone)


def checkpoint(lake: Lake) -> None:
    """Flush inlined rows, expire snapshots, merge and rewrite files, and delete what nothing needs."""
    for name in lake.list_tables():
        t = lake.get_table(name)
        if t.metadata()["auto_compact"]:
            flush_inlined(t)
            rewrite_data_files(t)
            merge_adjacent_files(t)
    expire_snapshots(lake)
    cleanup_old_files(lake)
    delete_orphaned_files(lake)
