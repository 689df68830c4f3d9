"""Options of the lake, its schemas and its tables."""

from __future__ import annotations

from typing import Any

from .store import Store

#: Defaults; an option of a table goes before one of its schema, which goes before one of the lake.
DEFAULTS: dict[str, Any] = {
    "data_inlining_row_limit": 10, "target_file_size": 512 << 20, "parquet_row_group_size": 122_880, "parquet_compression": "snappy", "parquet_compression_level": 3, "parquet_version": 1,
    "hive_file_pattern": True, "rewrite_delete_threshold": 0.95, "auto_compact": True, "delete_older_than": "2 days", "expire_older_than": None, "require_commit_message": False, "per_thread_output": False,
}
FIXED = ("version", "created_by", "data_path", "encrypted", "table")
UNITS = {"b": 1, "kb": 1000, "mb": 1000**2, "gb": 1000**3, "tb": 1000**4, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30, "tib": 1 << 40}


def typed(key: str, value: Any) -> Any:
    if value is None:
        return None
    default = DEFAULTS.get(key)
    if isinstance(default, bool):
        return str(value).lower() in ("true", "1")
    if isinstance(default, int):
        text = str(value).strip().lower().replace(" ", "")
        unit = text.lstrip("0123456789.")
        return int(float(text.removesuffix(unit)) * UNITS[unit]) if unit else int(text)
    return float(value) if isinstance(default, float) else str(value)


def set_options(store: Store, scope: str | None, scope_id: int | None, options: dict[str, Any]) -> None:
    """None removes an option. Options aren't versioned and make no snapshot."""
    for k, v in options.items():
        if k in FIXED:
            raise ValueError(f"the option {k} can't be changed")
        if k not in DEFAULTS:
            raise ValueError(f"there is no option {k}")
        typed(k, v)
    with store.writing() as s:
        for k, v in options.items():
            same = '"key" = ? AND scope IS NULL' if scope is None else '"key" = ? AND scope = ? AND scope_id = ?'
            s.run(f"DELETE FROM {{metadata}} WHERE {same}", *((k,) if scope is None else (k, scope, scope_id)))
            if v is not None:
                s.insert("metadata", [{"key": k, "value": str(v).lower() if isinstance(v, bool) else str(v), "scope": scope, "scope_id": scope_id}])


def resolve(store: Store, schema_id: int | None = None, table_id: int | None = None) -> dict[str, Any]:
    found = store.rows("SELECT * FROM {metadata}")
    pick = lambda scope, i: {r["key"]: r["value"] for r in found if r["scope"] == scope and r["scope_id"] == i}
    out = dict(DEFAULTS) | pick(None, None)
    for scope, i in (("schema", schema_id), ("table", table_id)):
        if i is not None:
            out |= pick(scope, i)
    return {k: typed(k, v) for k, v in out.items()}
