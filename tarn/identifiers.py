"""Names of tables and paths to columns."""

from __future__ import annotations

import re
from typing import NamedTuple


class TableName(NamedTuple):
    schema: str
    name: str

    def __str__(self) -> str:
        return f'{quote_name(self.schema)}.{quote_name(self.name)}'


def quote_name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


PART = r'"((?:[^"]|"")+)"|([^".]+)'


def parts(text: str) -> list[str]:
    """a.b or "a"."b" (a doubled quote stands for one); quoted and bare parts don't mix."""
    found, at = [], 0
    while True:
        m = re.compile(PART).match(text, at)
        if not m:
            raise ValueError(f"{text!r} is no name")
        found.append((m[1].replace('""', '"') if m[1] is not None else m[2], m[1] is not None))
        at = m.end()
        if at == len(text):
            break
        if text[at] != ".":
            raise ValueError(f"{text!r} is no name")
        at += 1
    if len({q for _, q in found}) > 1:
        raise ValueError(f"{text!r} mixes quoted and bare parts")
    return [n for n, _ in found]


def table_name(name: str | tuple | TableName) -> TableName:
    """One part is a table of the schema main."""
    p = list(name) if isinstance(name, (tuple, list)) else parts(name)
    if len(p) == 1:
        return TableName("main", p[0])
    if len(p) != 2:
        raise ValueError(f"{name!r} is no table name")
    return TableName(*p)


def column_path(path: str | tuple | list) -> tuple[str, ...]:
    """A list is a path; a text is parsed, so a dot in it leads to a nested column."""
    return tuple(path) if isinstance(path, (tuple, list)) else tuple(parts(path))
