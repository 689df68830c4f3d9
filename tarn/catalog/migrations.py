"""Steps from older layouts of the catalog to the present one, each in one transaction."""

from __future__ import annotations

from .store import TABLES, VERSION, VERSIONS, Session, Store


def add_columns(s: Session, table: str, *columns: str) -> None:
    have = {d[0] for d in s.run(f"SELECT * FROM {s.store.prefix}{table} WHERE 1 = 0").description}
    for c in columns:
        if c.split()[0] not in have:
            s.run(f"ALTER TABLE {s.store.prefix}{table} ADD COLUMN {c}")


def to_0_2(s: Session) -> None:
    """Schemas and tables get paths; partition columns refer to column ids by their rank among a table's columns."""
    add_columns(s, "schema", "path VARCHAR", "path_is_relative BOOLEAN")
    add_columns(s, "table", "path VARCHAR", "path_is_relative BOOLEAN")
    s.run("UPDATE {schema} SET path = schema_name || '/', path_is_relative = TRUE WHERE path IS NULL")
    s.run("UPDATE {table} SET path = table_name || '/', path_is_relative = TRUE WHERE path IS NULL")
    s.run("UPDATE {partition_column} SET column_id = (SELECT r.column_id FROM (SELECT table_id, column_id, ROW_NUMBER() OVER (PARTITION BY table_id ORDER BY column_order) - 1 AS place FROM {column} WHERE parent_column IS NULL AND end_snapshot IS NULL) r WHERE r.table_id = {partition_column}.table_id AND r.place = {partition_column}.column_id)")


def to_0_3(s: Session) -> None:
    """Metadata gets scopes, snapshots authors, and schema versions their first snapshots."""
    add_columns(s, "metadata", "scope VARCHAR", "scope_id BIGINT")
    add_columns(s, "snapshot_changes", "author VARCHAR", "commit_message VARCHAR", "commit_extra_info VARCHAR")
    missing(s, "schema_versions")
    s.run("INSERT INTO {schema_versions} (begin_snapshot, schema_version) SELECT MIN(snapshot_id), schema_version FROM {snapshot} GROUP BY schema_version")


def to_0_4(s: Session) -> None:
    """Schema versions belong to tables; defaults have a type and a dialect."""
    add_columns(s, "schema_versions", "table_id BIGINT")
    add_columns(s, "column", "default_value_type VARCHAR", "default_value_dialect VARCHAR")
    found = s.rows("SELECT v.begin_snapshot, v.schema_version, t.table_id FROM {schema_versions} v JOIN {table} t ON v.begin_snapshot >= t.begin_snapshot AND (t.end_snapshot IS NULL OR v.begin_snapshot < t.end_snapshot) WHERE v.table_id IS NULL")
    s.insert("schema_versions", found)
    s.run("DELETE FROM {schema_versions} WHERE table_id IS NULL")


def to_1_0(s: Session) -> None:
    """Files say with which version of the schema they were written; all tables of the present layout exist."""
    for name in TABLES:
        missing(s, name)
    add_columns(s, "data_file", "schema_version BIGINT")
    add_columns(s, "file_column_stats", "contains_nan BOOLEAN")


def missing(s: Session, table: str) -> None:
    if not s.has_table(f"{s.store.prefix}{table}"):
        s.run(f"CREATE TABLE {s.store.prefix}{table} ({TABLES[table]})")


STEPS = dict(zip(VERSIONS[1:], (to_0_2, to_0_3, to_0_4, to_1_0)))


def migrate_from(store: Store, version: str) -> None:
    for target in VERSIONS[VERSIONS.index(version) + 1 :]:
        with store.writing() as s:
            STEPS[target](s)
            s.run("""UPDATE {metadata} SET value = ? WHERE "key" = 'version'""", target)
    if store.rows("""SELECT value FROM {metadata} WHERE "key" = 'version'""")[0]["value"] != VERSION:
        raise RuntimeError("the migration did not reach the present version")
