"""Statistics of Parquet files from their footers."""

from __future__ import annotations

import io
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq

from ..types import Column
from .storage import Files, Mounted


@dataclass(slots=True)
class ColumnStats:
    size: int = 0
    values: int = 0
    nulls: int | None = 0
    min: Any = None
    max: Any = None
    nan: bool | None = None


@dataclass(slots=True)
class FileStats:
    rows: int
    bytes: int
    footer: int
    columns: dict[int, ColumnStats] = field(default_factory=dict)


def ids_by_path(schema: pa.Schema) -> dict[str, int]:
    """The field id of each leaf that has one, by its dotted Parquet path."""
    out: dict[str, int] = {}

    def walk(f: pa.Field, path: str, parent: str) -> None:
        found = (f.metadata or {}).get(b"PARQUET:field_id")
        if found is not None:
            out[path] = int(found)
        if pa.types.is_struct(f.type):
            for c in f.type:
                walk(c, f"{path}.{c.name}", path)
        elif pa.types.is_map(f.type):
            walk(f.type.key_field, f"{path}.key_value.key", path)
            walk(f.type.item_field, f"{path}.key_value.value", path)
        elif pa.types.is_list(f.type) or pa.types.is_large_list(f.type):
            walk(f.type.value_field, f"{path}.list.element", path)

    for f in schema:
        walk(f, f.name, "")
    return out


def leaves(columns: Iterable[Column], ids: dict[str, int]) -> dict[str, Column]:
    """The table's column of each leaf path. Structs match by field id; elements, keys and values by their place,

    because Spark writes no ids for those.
    """
    out: dict[str, Column] = {}
    names = {}
    for path, i in ids.items():
        names.setdefault(i, path)

    def walk(c: Column, path: str) -> None:
        if not c.data_type.children:
            out[path] = c
        elif c.data_type.kind == "list":
            walk(c.data_type.children[0], f"{path}.list.element")
        elif c.data_type.kind == "map":
            walk(c.data_type.children[0], f"{path}.key_value.key")
            walk(c.data_type.children[1], f"{path}.key_value.value")
        else:
            for x in c.data_type.children:
                walk(x, names.get(x.field_id, f"{path}.{x.name}"))

    for c in columns:
        if c.field_id in names:
            walk(c, names[c.field_id])
    return out


def read(files: Files | Mounted, path: str, columns: list[Column]) -> FileStats:
    """Rows, sizes, and of each leaf minimum, maximum and nulls over all row groups."""
    guess = 64 << 10
    raw = files.tail(path, guess)
    footer = int.from_bytes(raw[-8:-4], "little")
    if footer + 8 > len(raw):
        raw = files.tail(path, footer + 8)
    meta = pq.read_metadata(io.BytesIO(b"PAR1" + raw[-(footer + 8) :]))
    ids = ids_by_path(meta.schema.to_arrow_schema())
    if not ids and columns:
        raise ValueError(f"{path} has no field ids; write it with the lake's schema")
    known = leaves(columns, ids)
    out = FileStats(meta.num_rows, files.size(path), footer)
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for k in range(group.num_columns):
            chunk = group.column(k)
            c = known.get(chunk.path_in_schema)
            if c is None:
                continue
            s = out.columns.setdefault(c.field_id, ColumnStats())
            s.size += chunk.total_compressed_size
            s.values += chunk.num_values
            # times as INT96 have bounds in no order, so pyarrow refuses to read them
            stats = chunk.statistics if chunk.is_stats_set and chunk.physical_type != "INT96" else None
            s.nulls = None if s.nulls is None or stats is None or not stats.has_null_count else s.nulls + stats.null_count
            if stats is not None and stats.has_min_max:
                lo, hi = stats.min, stats.max
                s.min = lo if s.min is None else min(s.min, lo)
                s.max = hi if s.max is None else max(s.max, hi)
            elif stats is None or s.nulls is None or stats.null_count < chunk.num_values:
                s.min, s.max = UNKNOWN, UNKNOWN
    for s in out.columns.values():
        if s.min is UNKNOWN:
            s.min = s.max = None
    return out


class Unknown:
    """Less and greater than nothing: a group without bounds makes those of the file unknown."""

    def __lt__(self, other: Any) -> bool:
        return True

    __gt__ = __lt__


UNKNOWN = Unknown()


def row_count(files: Files, path: str) -> int:
    """Rows of a file, from its footer alone."""
    raw = files.tail(path, 64 << 10)
    footer = int.from_bytes(raw[-8:-4], "little")
    if footer + 8 > len(raw):
        raw = files.tail(path, footer + 8)
    return pq.read_metadata(io.BytesIO(b"PAR1" + raw[-(footer + 8) :])).num_rows


#: The driver reads so many footers itself; more are dealt out to the executors, SHARE or more a task.
FEW, SHARE = 512, 64


def read_all(files: Files, paths: list[str], columns: list[Column]) -> list[FileStats]:
    """Statistics of files, in their order. The driver reads what executors don't see."""
    found: list[FileStats | None] = [None] * len(paths)
    if len(paths) > FEW:
        def some(part: Iterable[str]) -> list[FileStats | None]:
            return [read(Mounted(), p, columns) if Mounted.has(p) else None for p in part]

        sc = files.spark.sparkContext
        found = sc.parallelize(paths, max(1, min(8 * sc.defaultParallelism, len(paths) // SHARE))).mapPartitions(some).collect()
    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(lambda p, s: s or read(files, p, columns), paths, found))
