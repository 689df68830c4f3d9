"""Values as text, for statistics, partition values, defaults and inlined rows."""

from __future__ import annotations

import datetime as dt
import decimal
import re
import uuid
from typing import Any

from .types import DataType

NULL = "NULL"
INTS = {f"{u}int{b}" for u in ("", "u") for b in (8, 16, 32, 64, 128)}


def format_value(v: Any, t: DataType) -> str:
    """The text of a value; null is NULL, so a text that reads NULL can't be told from it."""
    if v is None:
        return NULL
    k = t.kind
    if k == "boolean":
        return "1" if v else "0"
    if k == "blob":
        return bytes(v).hex()
    if k in ("timestamp", "timestamp_s", "timestamp_ms", "timestamp_ns"):
        return v.replace(tzinfo=None).isoformat(sep=" ") if isinstance(v, dt.datetime) else str(v)
    if k == "timestamptz":
        v = v if v.tzinfo else v.replace(tzinfo=dt.UTC)
        return v.astimezone(dt.UTC).isoformat()
    if k == "interval":
        return format_interval(*v)
    if k == "list":
        return "[" + ", ".join(quoted(x, t.children[0].data_type) for x in v) + "]"
    if k == "struct":
        get = v.get if isinstance(v, dict) else lambda n: v[n]
        return "{" + ", ".join(f"{quote(c.name)}: {quoted(get(c.name), c.data_type)}" for c in t.children) + "}"
    if k == "map":
        return "{" + ", ".join(f"{quoted(a, t.children[0].data_type)}={quoted(b, t.children[1].data_type)}" for a, b in v.items()) + "}"
    if k in ("float32", "float64"):
        return repr(float(v))
    return str(v)


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(v: Any, t: DataType) -> str:
    """An element of a nested literal: bare where nothing in it could be misread."""
    text = format_value(v, t)
    if v is None or t.kind in ("list", "struct", "map"):
        return text
    bare = bool(text) and text != NULL and not re.search(r"[\s,\[\]{}()=:'\"\\]", text)
    return text if bare else quote(text)


def parse_value(text: str | None, t: DataType) -> Any:
    if text is None or text == NULL:
        return None
    k = t.kind
    if k == "boolean":
        if text not in ("0", "1"):
            raise ValueError(f"{text!r} is no boolean")
        return text == "1"
    if k in INTS:
        return int(text)
    if k in ("float32", "float64"):
        return float(text)
    if k == "decimal":
        return decimal.Decimal(text)
    if k == "blob":
        return bytes.fromhex(text)
    if k == "date":
        return dt.date.fromisoformat(text)
    if k == "time":
        return dt.time.fromisoformat(text)
    if k in ("timestamp", "timestamp_s", "timestamp_ms", "timestamp_ns"):
        return parse_timestamp(text).replace(tzinfo=None)
    if k == "timestamptz":
        v = parse_timestamp(text)
        return v.astimezone(dt.UTC) if v.tzinfo else v.replace(tzinfo=dt.UTC)
    if k == "uuid":
        return str(uuid.UUID(text))
    if k == "interval":
        return parse_interval(text)
    if k in ("list", "struct", "map"):
        v, at = Nested(text).value(t, 0)
        if text[at:].strip():
            raise ValueError(f"unexpected {text[at:]!r}")
        return v
    return text


def parse_timestamp(text: str) -> dt.datetime:
    """ISO 8601 with a blank or T, with or without seconds, fractions of any length and a zone; or a date alone."""
    m = re.fullmatch(r"(\d{4}-\d{2}-\d{2})(?:[ T](\d{2}:\d{2})(:\d{2})?(?:\.(\d+))?)?\s*(Z|UTC|[+-]\d{2}(?::?\d{2})?)?", text.strip())
    if not m:
        raise ValueError(f"{text!r} is no timestamp")
    day, minutes, seconds, fraction, zone = m.groups()
    zone = "+00:00" if zone in ("Z", "UTC") else zone if not zone or len(zone) != 3 else zone + ":00"
    return dt.datetime.fromisoformat(f"{day}T{minutes or '00:00'}{seconds or ':00'}.{(fraction or '')[:6]:0<6}{zone or ''}")


UNITS = (("years", 12), ("months", 1))


def format_interval(months: int, micros: int) -> str:
    sign, months, micros = ("-" if months < 0 or micros < 0 else ""), abs(months), abs(micros)
    days, rest = divmod(micros, 86_400_000_000)
    seconds, fraction = divmod(rest, 1_000_000)
    return sign + f"{months // 12} years {months % 12} months {days} days {seconds // 3600:02}:{seconds // 60 % 60:02}:{seconds % 60:02}.{fraction:06}"


def parse_interval(text: str) -> tuple[int, int]:
    m = re.fullmatch(r"(-?)(?:(\d+) years?)? ?(?:(\d+) mon(?:th)?s?)? ?(?:(\d+) days?)? ?(?:(\d+):(\d\d):(\d\d)(?:\.(\d{1,6}))?)?", text.strip())
    if not m:
        raise ValueError(f"{text!r} is no interval")
    y, mo, d, h, mi, s = (int(x or 0) for x in m.groups()[1:7])
    sign = -1 if m[1] else 1
    return sign * (12 * y + mo), sign * ((((d * 24 + h) * 60 + mi) * 60 + s) * 1_000_000 + int(f"{m[8] or '':0<6}"))


class Nested:
    """A reader of list, struct and map literals."""

    def __init__(self, text: str):
        self.text = text

    def skip(self, at: int) -> int:
        while at < len(self.text) and self.text[at].isspace():
            at += 1
        return at

    def expect(self, c: str, at: int) -> int:
        at = self.skip(at)
        if self.text[at : at + 1] != c:
            raise ValueError(f"{c!r} expected at {at} of {self.text!r}")
        return self.skip(at + 1)

    def word(self, at: int, stops: str) -> tuple[str, bool, int]:
        """(text, was it quoted, next place)."""
        at = self.skip(at)
        if self.text[at : at + 1] in ("'", '"'):
            end, out, i = self.text[at], [], at + 1
            while i < len(self.text) and self.text[i] != end:
                i += self.text[i] == "\\"
                out.append(self.text[i : i + 1])
                i += 1
            if i >= len(self.text):
                raise ValueError(f"a quote does not end in {self.text!r}")
            return "".join(out), True, self.skip(i + 1)
        i = at
        while i < len(self.text) and self.text[i] not in stops:
            i += 1
        return self.text[at:i].strip(), False, i

    def value(self, t: DataType, at: int) -> tuple[Any, int]:
        at = self.skip(at)
        if t.kind == "list" and self.text[at : at + 1] == "[":
            return self.items("[", "]", at, lambda a: self.value(t.children[0].data_type, a))
        if t.kind == "struct" and self.text[at : at + 1] == "{":
            kinds = {c.name: c.data_type for c in t.children}

            def field(a: int):
                name, _, a = self.word(a, ":")
                if name not in kinds:
                    raise ValueError(f"no field {name!r}")
                v, a = self.value(kinds[name], self.expect(":", a))
                return (name, v), a

            pairs, at = self.items("{", "}", at, field)
            return {n: dict(pairs).get(n) for n in kinds}, at
        if t.kind == "map" and self.text[at : at + 1] == "{":

            def entry(a: int):
                k, a = self.value(t.children[0].data_type, a)
                if k is None:
                    raise ValueError("a map key is NULL")
                v, a = self.value(t.children[1].data_type, self.expect("=", a))
                return (k, v), a

            pairs, at = self.items("{", "}", at, entry)
            return dict(pairs), at
        text, was_quoted, at = self.word(at, ",]}=")
        return (text if was_quoted and t.kind in ("varchar", "json") else parse_value(text, t)) if was_quoted or text != NULL else None, at

    def items(self, begin: str, end: str, at: int, one) -> tuple[list, int]:
        at, out = self.expect(begin, at), []
        while self.text[at : at + 1] != end:
            v, at = one(at)
            out.append(v)
            at = self.skip(at)
            if self.text[at : at + 1] == ",":
                at = self.skip(at + 1)
            elif self.text[at : at + 1] != end:
                raise ValueError(f"{end!r} expected at {at} of {self.text!r}")
        return out, self.skip(at + 1)
