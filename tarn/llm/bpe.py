"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

A merge list has a *sufficient lookahead*: text beyond so many symbols can't change a token any more.  The encoder emits a token
as soon as it is stable, so of a piece of any length it holds a few times that much.  The decoder turns tokens to text by an incremental
state machine.  Beside a text itself and its normalised blocks both use memory that the vocabulary bounds.  What a vocabulary file
says of normalising, cutting and decoding must be one of FORMS; any other file is refused.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import docs_of, map_rows

#: What Unicode calls white space.
SPACE = "\t-\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Characters of a text that are looked at together, cut where white space allows.
BLOCK = 1 << 16
#: Pieces whose tokens are remembered, at most; longer ones than so many characters go through in parts, unremembered.
REMEMBERED, LONG = 250_000, 1 << 12


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files of byte-level models."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


SYMBOLS = byte_symbols()
BYTES = {s: b for b, s in enumerate(SYMBOLS)}


# How the vocabulary files of the two known kinds describe their texts.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "decoder": None,
}
BYTE_FORM = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def narrow(pattern: str) -> re.Pattern:
    """A pattern for texts of code points under 256, in the standard library's engine, which is faster on them."""
    kind = lambda k: "".join(re.escape(c) for c in map(chr, range(256)) if unicodedata.category(c)[0] == k)
    space = "\t-\r \x85\xa0"
    for sign, inner in ((r"\p{L}", kind("L")), (r"\p{N}", kind("N")), (r"\s", space)):
        pattern = in_class(pattern, sign, inner)
    return re.compile(pattern.replace(r"\S", f"[^{space}]"))


def wide(pattern: str) -> regex.Pattern:
    return regex.compile(in_class(pattern, r"\s", SPACE).replace(r"\S", f"[^{SPACE}]"))


def in_class(pattern: str, sign: str, inner: str) -> str:
    """``sign`` replaced by the inner part of a class, in brackets where it does not stand in some already."""
    out, depth, at = [], 0, 0
    while at < len(pattern):
        if pattern.startswith(sign, at):
            out.append(inner if depth else f"[{inner}]")
            at += len(sign)
        else:
            step = 2 if pattern[at] == "\\" else 1
            depth += (pattern[at] == "[") - (pattern[at] == "]") if step == 1 else 0
            out.append(pattern[at : at + step])
            at += step
    return "".join(out)


class Form:
    """How texts become pieces, and tokens text."""

    def __init__(self, spec: dict, path: str):
        own = {k: spec.get(k) for k in WORD_FORM}
        model, added = spec["model"], spec["added_tokens"]
        if own not in (WORD_FORM, BYTE_FORM) or any(model.get(k) != v for k, v in MODEL.items()) or any(t.get(k) != v for t in added for k, v in ADDED.items()):
            raise ValueError(f"{path} normalises, cuts or decodes in a way that is not known here")
        self.words = own == WORD_FORM
        pattern = WORD_PATTERN if self.words else BYTE_PATTERN
        self.wide, self.narrow = wide(pattern), narrow(pattern)

    def pieces(self, block: str) -> Iterable[str]:
        text, pattern = self.normal(block) if self.words else block, self.narrow
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pattern = self.wide
        # a list is faster; a block that white space did not end goes piece by piece
        return pattern.findall(text) if len(text) <= 2 * BLOCK else (m[0] for m in pattern.finditer(text))

    @staticmethod
    def normal(text: str) -> str:
        """Canonical composition, then lower case by code point (so a capital sigma has one lower form)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()


class Merges:
    """A vocabulary and its merges, by token number."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.texts = {i: t for t, i in vocab.items()}
        #: (left, right) to (rank, result)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            self.rank.setdefault((vocab[a], vocab[b]), (r, vocab[a + b]))
        self.length = {i: len(t.removesuffix(suffix)) if suffix and t != suffix else len(t) for i, t in self.texts.items()}
        self.lookahead = self.sufficient_lookahead()

    def sufficient_lookahead(self) -> int:
        """Symbols beyond which text can't change a token.

        Unknown text to the right changes a token only through a chain of merges.  A merge (p, q) that unknown text
        makes or prevents has q at the left edge of what is unknown, and moves that edge over p.  The next merge of
        the chain applies later, so it has a higher rank, and has p or pq at its right.  The longest chain by rank, over
        the whole list in one pass, bounds how far the edge can move; one more token's length covers the token that the
        edge stops in.
        """
        far: dict[int, int] = {}
        for (p, q), (_, pq) in sorted(self.rank.items(), key=lambda x: x[1][0]):
            e = far.get(q, 0) + self.length[p]
            for t in (p, pq):
                if far.get(t, 0) < e:
                    far[t] = e
        return max(far.values(), default=0) + max(self.length.values(), default=1)

    def apply(self, symbols: list[int]) -> list[int]:
        """All merges, lowest rank first, from the left among equals."""
        if len(symbols) > 100:
            return self.apply_many(symbols)
        get, out = self.rank.get, list(symbols)
        ranks = [get(p, NEVER)[0] for p in zip(out, out[1:])]
        while ranks and (low := min(ranks)) < NEVER[0]:
            i = ranks.index(low)
            out[i : i + 2] = [get((out[i], out[i + 1]))[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((out[i - 1], out[i]), NEVER)[0]
            if i < len(ranks):
                ranks[i] = get((out[i], out[i + 1]), NEVER)[0]
        return out


    def apply_many(self, symbols: list[int]) -> list[int]:
        """The same in a time that grows with n log n: pairs wait in a heap, by rank and place; those that are gone are passed over."""
        get, own, n = self.rank.get, list(symbols), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(got[0], i, p) for i, p in enumerate(zip(own, own[1:])) if (got := get(p))]
        heapify(heap)
        while heap:
            _, i, pair = heappop(heap)
            j = after[i]
            if j >= n or own[i] != pair[0] or own[j] != pair[1]:
                continue
            own[i], own[j] = get(pair)[1], GONE
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if got := get((own[i], own[k])):
                    heappush(heap, (got[0], i, (own[i], own[k])))
            h = before[i]
            if h >= 0 and (got := get((own[h], own[i]))):
                heappush(heap, (got[0], h, (own[h], own[i])))
        return [t for t in own if t != GONE]


#: What is left of a symbol that was merged into the one before it.
GONE = -2
#: The rank and result of symbols that do not merge.
NEVER = (1 << 60, -1)


class Remembered(dict):
    """What f gives for a key; keeps the last REMEMBERED keys or up to twice as many, those in use among them."""

    def __init__(self, f):
        self.f, self.old = f, {}

    def __missing__(self, key):
        got = self.old.get(key) if self.old else None
        if got is None:
            got = self.f(key)
        if len(key) <= 64:  # a longer piece is not worth its memory
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


class Encoder:
    """Text to token numbers as the vocabulary file prescribes: normalise, cut into pieces, merge each piece."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.form, model = Form(spec, path), spec["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], pairs, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = self.merges.texts | {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        symbols, vocab, suffix = SYMBOLS, model["vocab"], self.merges.suffix
        self.inner = [vocab.get(s, -1) for s in symbols]
        self.final = [vocab.get(s + suffix, -1) for s in symbols]
        self.piece = Remembered(self.tokens)

    def __reduce__(self):
        raise TypeError("encoders are made where they are used; send the path")

    # one piece

    def stream(self, data: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one piece that comes in parts, each as soon as it is stable; holds about eight times the lookahead."""
        ahead, held, last = self.merges.lookahead, [], None
        for part in data:
            for b in part:
                if last is not None:
                    held.append(self.inner[last])
                last = b
                if len(held) >= 8 * ahead + 64:
                    tokens, beyond, done = self.merges.apply(held), len(held), 0
                    for t in tokens:
                        beyond -= self.merges.length[t]
                        if beyond < ahead:
                            break
                        yield t
                        done += self.merges.length[t]
                    held = held[done:]
        if last is not None:
            held.append(self.final[last])
            yield from self.merges.apply(held)

    def tokens(self, p: str) -> tuple[int, ...]:
        if p[0] == MARK:
            return (self.special[p[1:]],)
        raw = p.encode()
        if len(raw) <= self.merges.lookahead:  # held as a whole anyway
            symbols = [self.inner[b] for b in raw]
            symbols[-1] = self.final[raw[-1]]
            return tuple(t for t in self.merges.apply(symbols) if t >= 0)
        return tuple(self.long(p))

    def long(self, p: str) -> Iterator[int]:
        """Tokens of a piece, which is turned to bytes in parts."""
        return (t for t in self.stream(p[k : k + LONG].encode() for k in range(0, len(p), LONG)) if t >= 0)

    # whole texts

    def blocks(self, text: str) -> Iterator[str]:
        """A text in parts of about BLOCK characters that end where white space begins: no piece, and no composition, is cut."""
        at = 0
        while at < len(text):
            end = at + BLOCK
            if end < len(text):
                m = GAP.search(text, end)
                end = m.start() if m else len(text)
            yield text[at:end] if at or end < len(text) else text
            at = end

    def pieces(self, text: str) -> Iterator[Iterable[str]]:
        """The pieces of each block; a special token is a piece of its own, marked by what no piece begins with."""
        parts = [text] if self.cut is None or not any(s in text for s in self.special) else self.cut.split(text)
        for part in parts:
            if part in self.special:
                yield [MARK + part]
            else:
                for block in self.blocks(part):
                    yield self.form.pieces(block)

    def encode(self, text: str) -> list[int]:
        return [t for block in self.pieces(text) for p in block for t in (self.piece[p] if len(p) <= LONG else self.long(p))]

    def decoder(self) -> Decoder:
        return Decoder(self.texts, self.merges.suffix, self.form.words)


#: No text has this, so it can mark special tokens.
MARK = "\ud800"
GAP = regex.compile(f"(?<=[^{SPACE}])[{SPACE}]")


class Decoder:
    """Token numbers to text, token by token.

    Without a decoder in the vocabulary file tokens' own texts are joined by blanks (``plain``): the state is whether a
    token came before.  Otherwise tokens are bytes of UTF-8, of which an incomplete code point is the state, and the end-of-word mark
    becomes a blank.
    """

    def __init__(self, texts: dict[int, str], suffix: str = "", plain: bool = True):
        self.texts, self.suffix, self.plain, self.started = texts, suffix, plain, False
        self.utf8 = None if plain else codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, token: int) -> str:
        t = self.texts.get(token)
        if t is None:
            return ""
        if self.plain:
            out = " " + t if self.started else t
            self.started = True
            return out
        word = bool(self.suffix) and t.endswith(self.suffix)
        raw = bytes(BYTES[c] for c in (t.removesuffix(self.suffix) if word else t))
        return self.utf8.decode(raw) + " " * word

    def end(self) -> str:
        return "" if self.plain else self.utf8.decode(b"", True)

    def decode(self, tokens: Iterable[int]) -> str:
        return "".join([*map(self.push, tokens), self.end()])


class Digests:
    """Digests of the ids and of the decoded text, piece by piece; what a piece adds to each is remembered."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.known = Remembered(self.added)

    def added(self, piece: str) -> tuple[str, str]:
        return self.told(self.encoder.tokens(piece))

    def told(self, tokens: Sequence[int]) -> tuple[str, str]:
        # the decoder's state between two pieces, which are whole code points, is one bit; each is decoded from the state after a token
        d = self.encoder.decoder()
        d.started = True
        return "".join(f" {t}" for t in tokens), d.decode(tokens)

    def parts(self, text: str) -> Iterator[tuple[str, str]]:
        """What many short pieces add, or a part of a long one."""
        for block in self.encoder.pieces(text):
            if isinstance(block, list) and max(map(len, block), default=0) <= LONG:
                got = [self.known[p] for p in block]
                block = ()
            else:
                got = []
            for p in block:
                if len(p) <= LONG:
                    got.append(self.known[p])
                    continue
                yield "".join([g[0] for g in got]), "".join([g[1] for g in got])
                got, d, tokens = [], self.encoder.decoder(), self.encoder.long(p)
                d.started = True
                while some := list(islice(tokens, LONG)):
                    yield "".join(f" {t}" for t in some), "".join(map(d.push, some))
                yield "", d.end()
            yield "".join([g[0] for g in got]), "".join([g[1] for g in got])

    def text(self, text: str) -> tuple[int, str, str]:
        ids, out, n = hashlib.sha256(), hashlib.sha256(), 0
        for x, y in self.parts(text):
            more = x.count(" ")
            if not n and more:  # no blank before the first token
                x, y = x[1:], y[1:] if self.encoder.form.words else y
            n += more
            ids.update(x.encode())
            out.update(y.encode())
        return n, ids.hexdigest(), out.hexdigest()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text; a null text is empty and has no tokens.

    ``path`` must be readable on the executors: the vocabulary comes with an installed package there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        d = Digests(encoder(path))
        for b in batches:
            for i, t in zip(*(c.to_pylist() for c in b.columns)):
                yield (i, *d.text(t or ""))

    return map_rows(docs_of(df, id_col, (text_col, "text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): token numbers and the text that they decode to; null and empty as in digests()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [e.encode(t or "") for t in part.column(1).to_pylist()]
                text = [e.decoder().decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, ids), pa.int64(), size=len(ids)), pa.array(ids, pa.list_(pa.int32())), pa.array(text)], schema=schema)

    return docs_of(df, id_col, (text_col, "text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")
