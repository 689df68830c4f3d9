"""What commits say that they did, and which of it conflicts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..identifiers import parts, quote_name

# The kinds of changes that snapshots record.
NAMED = ("created_schema", "created_table", "created_view", "created_scalar_macro", "created_table_macro")
NUMBERED = ("inserted_into_table", "deleted_from_table", "inlined_insert", "inlined_delete", "inline_flush", "merge_adjacent", "rewrite_delete", "compacted_table", "dropped_schema", "dropped_table", "dropped_view", "dropped_scalar_macro", "dropped_table_macro", "altered_table", "altered_view")


@dataclass(frozen=True)
class Applied:
    kind: str
    id: int | None = None
    name: tuple[str, ...] = ()

    def __str__(self) -> str:
        return f"{self.kind}:{'.'.join(map(quote_name, self.name)) if self.kind in NAMED else self.id}"


def format_changes(changes: list[Applied]) -> str:
    return ",".join(dict.fromkeys(map(str, changes)))


def parse_changes(text: str | None) -> list[Applied]:
    """Commas inside quoted names don't separate."""
    out = []
    for item in re.findall(r'(?:"(?:[^"]|"")*"|[^,"])+', text or ""):
        kind, _, what = item.partition(":")
        if kind in NAMED:
            out.append(Applied(kind, None, tuple(parts(what))))
        elif kind in NUMBERED:
            out.append(Applied(kind, int(what)))
        else:
            raise ValueError(f"unknown change {item!r}")
    return out


REWRITES = {"compacted_table", "merge_adjacent", "rewrite_delete", "inline_flush"}
DELETES = {"deleted_from_table", "inlined_delete"}
#: By what ours does to a table: what of theirs on the same table conflicts.
TABLE_RULES = {
    "dropped_table": {"dropped_table"},
    "altered_table": {"dropped_table", "altered_table"},
    "inserted_into_table": {"dropped_table", "altered_table"},
    "inlined_insert": {"dropped_table", "altered_table"},
    "deleted_from_table": {"dropped_table", "altered_table", "deleted_from_table"} | REWRITES,
    "inlined_delete": {"dropped_table", "altered_table", "deleted_from_table"} | REWRITES,
    **{r: {"dropped_table"} | DELETES | REWRITES for r in REWRITES},
}


def conflict(ours: Applied, theirs: Applied, schema_of: dict[str, int]) -> str | None:
    """Why ours can't follow theirs, or None. schema_of: ids of schemas by name, as they were when ours began."""
    if ours.kind in NAMED:
        if theirs.kind == ours.kind and theirs.name == ours.name:
            return f"{theirs} was committed meanwhile"
        if len(ours.name) == 2 and theirs.kind == "dropped_schema" and schema_of.get(ours.name[0]) == theirs.id:
            return f"the schema of {ours} was dropped meanwhile"
        return None
    if ours.kind == "dropped_schema":
        if theirs.kind == "dropped_schema" and theirs.id == ours.id:
            return f"{theirs} was committed meanwhile"
        if theirs.kind in ("created_table", "created_view") and schema_of.get(theirs.name[0]) == ours.id:
            return f"{theirs} was committed into a schema that is dropped"
        return None
    if theirs.id == ours.id and theirs.kind in TABLE_RULES.get(ours.kind, ()):
        return f"{theirs} was committed meanwhile, and ours is {ours}"
    return None
