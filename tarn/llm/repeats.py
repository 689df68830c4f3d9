"""Removal of repeated byte strings by a distributed prefix-free parse.

Rolling-hash triggers cut texts into phrases.  A phrase's *context* is what windows that start in it can see, so windows are
equal only if their contexts have the same *core*, the bytes at the trigger that all of them see; cores deal contexts to buckets.  A
core that occurs once settles its windows: that is almost all of a text, and is known from hashes alone, as equal cores
have equal hashes.  The bytes of all other contexts go to their bucket.  There distinct contexts are the dictionary, and which of them
each place in the texts has is the parse.  The suffix array of the dictionary, to the depth of a window, with each suffix
repeated for the places that the parse has of its context, is the corpus order of the bucket: neighbours that agree to that depth repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import PACKED, Stage, answers, by_bucket, deal, docs_of, grouped, map_rows, mix64, n_buckets, n_shuffle, pack, text_bytes, unpack

#: Bytes of a chunk of texts, about; a longer text is cut into pieces of so many.
CHUNK = 3 << 20
#: Bytes that the rolling hash of a trigger sees.
TRIGGER = 16
CHUNKS = "chunk long, docs binary, texts binary"

with np.errstate(over="ignore"):
    _rng = np.random.default_rng(2024)
    #: A random value of each byte, and an odd base with its inverse: hashes are sums of value * base^place mod 2^64.
    VALUE = _rng.integers(0, 1 << 64, 256, np.uint64)
    BASE = 0x9E3779B97F4A7C15 | 5
    INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    out = np.ones(max(n, 1), np.uint64)
    k = 1
    with np.errstate(over="ignore"):
        while k < n:
            m = min(k, n - k)
            out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
            k += m
    return out[:n]


class Text:
    """The pieces of a chunk, one after the other, with sums from which any stretch is hashed at once.

    A piece is a text or a part of one: ``own`` bytes, ``before`` them up to a window of the part before, which windows that
    reach into the piece begin in, and ``after`` them what its own windows reach into.
    """

    def __init__(self, docs: bytes, texts: bytes):
        ids, known, self.key, self.number, self.before, self.own, after = unpack(docs, *DOCS)
        self.ids = [i if k else None for i, k in zip(ids.tolist(), known.tolist())]
        (self.bytes,) = unpack(texts, "uint8")
        self.lens = self.before + self.own + after
        self.ends = np.cumsum(self.lens)

    def prepare(self) -> None:
        n = len(self.bytes)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(VALUE[self.bytes] * powers(BASE, n), out=self.sums[1:])
            self.back = powers(INVERSE, n + 1)

    def hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[hi] - self.sums[lo]) * self.back[lo])

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Phrases: (trigger, lo, hi, counts); its windows are those that start at trigger - hi ... trigger - lo.

        The trigger of a window is the place of the least rolling hash (the first of equals) among its first
        width - TRIGGER - ``reach`` places, so it depends on nothing outside the window and each window has one.  Windows that
        begin before a piece's own bytes are phrases of their own, which don't count: the part before has them.
        """
        n, look = len(self.bytes), reach(width)
        if n < width:
            return (np.zeros(0, np.int64),) * 4
        with np.errstate(over="ignore"):
            m = n - TRIGGER + 1
            h = mix64((self.sums[TRIGGER:] - self.sums[:m]) * self.back[:m])
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
        step = 1
        while step < look:  # the least of look places, doubling
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        start = np.arange(n - width + 1)
        begin = self.ends - self.lens
        piece = lambda x: np.repeat(x, self.lens)[: len(start)]
        ok = (start + width <= piece(self.ends)) & (start < piece(begin + self.before + self.own))
        counts = (start >= piece(begin + self.before))[ok]
        start = start[ok]
        trigger = (key[: n - width + 1][ok] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (start[1:] != start[:-1] + 1) | (counts[1:] != counts[:-1])])) if len(start) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(start)) - 1
        return trigger[new], trigger[new] - start[last], trigger[new] - start[new], counts[new].astype(np.int64)

    def phrases(self, width: int) -> Phrases:
        self.prepare()
        t, lo, hi, counts = self.windows(width)
        core = self.hash(t, t + width - reach(width) + 1)
        order = np.lexsort((t, core))
        return Phrases((t - hi)[order], (t - lo + width)[order], counts[order], core[order])


@dataclass
class Phrases:
    """In the order of their cores' hashes: where the contexts begin and end, how many windows' places they count (0 or 1), core."""

    begin: np.ndarray
    end: np.ndarray
    counts: np.ndarray
    core: np.ndarray

    def pick(self, mask: np.ndarray) -> Phrases:
        return Phrases(self.begin[mask], self.end[mask], self.counts[mask], self.core[mask])


def reach(width: int) -> int:
    """Places among which a window's trigger is sought: the largest power of two that leaves half of the rest as core."""
    return max(1, 1 << ((2 * (width - TRIGGER)) // 3).bit_length() - 1)


#: Of each piece: id, whether there is one, number of its text, number of the piece in it or -1 if it is whole, bytes before, own, after.
DOCS = ("int64", "uint8", "int64", "int64", "int64", "int64", "int64")


def chunks(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    size_of = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, n, serial, rows, texts, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def flush() -> tuple:
            docs = pack(*(np.array(x, t) for x, t in zip(zip(*rows), DOCS)))
            return (part << 32) + n, docs, pack(np.frombuffer(b"".join(texts), np.uint8), level=3)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                key, serial = (part << 32) + serial, serial + 1
                for k, at in enumerate(range(0, len(t), size_of) or [0]):
                    before, own = min(at, width), min(size_of, len(t) - at)
                    after = min(width - 1, len(t) - at - own)
                    rows.append((i or 0, i is not None, key, k if len(t) > size_of else -1, before, own, after))
                    texts.append(t[at - before : at + own + after])
                    size += before + own + after
                    if size >= size_of or len(rows) >= 100_000:
                        yield flush()
                        rows, texts, size, n = [], [], 0, n + 1
        if rows:
            yield flush()

    return map_rows(docs_of(df, id_col, (text_col, "text")), run, CHUNKS)


# -- cores ----------------------------------------------------------------------------------


def ask_cores(table: DataFrame, width: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for k in range(b.num_rows):
                chunk, docs, texts = (c[k].as_py() for c in b.columns)
                f = Text(docs, texts).phrases(width)
                for k_, (lo, hi) in enumerate(zip(*by_bucket(f.core, buckets))):
                    if hi > lo:
                        yield k_, chunk, pack(np.diff(f.core[lo:hi], prepend=np.uint64(0)), f.counts[lo:hi].astype(np.uint8), spread=True)

    return map_rows(table.select("chunk", "docs", "texts"), run, PACKED)


def judge_cores(asked: DataFrame) -> DataFrame:
    """One bit for each core that a chunk asked about: whether it occurs more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for k, blobs in grouped(batches):
            parts = [unpack(x, "uint64", "uint8", spread=True) for _, x in blobs]
            core = np.concatenate([np.cumsum(p[0]) for p in parts])
            order = np.argsort(core)
            new = np.concatenate([[True], core[order][1:] != core[order][:-1]])
            group = np.empty(len(core), np.int64)
            group[order] = np.cumsum(new) - 1
            often = (np.bincount(group, np.concatenate([p[1] for p in parts])) > 1)[group]
            at = 0
            for (chunk, _), p in zip(blobs, parts):
                yield k, chunk, pack(np.array([len(p[0])]), np.packbits(often[at : at + len(p[0])]))
                at += len(p[0])

    return map_rows(deal(asked), run, PACKED)


def repeated_cores(f: Phrases, got: list | None) -> Phrases:
    """The phrases whose core occurs more than once."""
    bits = [np.unpackbits(x[1], count=int(x[0][0])) for x in (unpack(g["blob"], "int64", "uint8") for g in sorted(got or [], key=lambda g: g["bucket"]))]
    return f.pick(np.concatenate(bits).astype(bool) if bits else np.zeros(len(f.core), bool))


# -- contexts -------------------------------------------------------------------------------


def distinct(raw: bytes, f: Phrases, buckets: int) -> Iterator[tuple[int, slice, list[bytes], np.ndarray]]:
    """For each bucket: its phrases, their distinct contexts in the order of the first places, and which of these each phrase has."""
    for k, (lo, hi) in enumerate(zip(*by_bucket(f.core, buckets))):
        if hi > lo:
            own: dict[bytes, int] = {}
            which = [own.setdefault(raw[a:z], len(own)) for a, z in zip(f.begin[lo:hi].tolist(), f.end[lo:hi].tolist())]
            yield k, slice(lo, hi), list(own), np.array(which)


def ask_contexts(joined: DataFrame, width: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for k in range(b.num_rows):
                chunk, docs, texts, got = (c[k].as_py() for c in b.columns)
                x = Text(docs, texts)
                f = repeated_cores(x.phrases(width), got)
                for k_, at, contexts, which in distinct(x.bytes.tobytes(), f, buckets):
                    first = np.unique(which, return_index=True)[1]
                    counts = np.bincount(which, f.counts[at]).astype(np.uint32)
                    yield k_, chunk, pack(np.diff(f.core[at][first], prepend=np.uint64(0)), np.array(list(map(len, contexts)), np.uint32), counts, np.frombuffer(b"".join(contexts), np.uint8), level=3, spread=True)

    return map_rows(joined.select("chunk", "docs", "texts", "cores"), run, PACKED)


def suffix_ranks(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The suffix array's ranks of the suffixes of ``data`` that begin at ``starts``, to a depth of ``width``: equal ranks mean
    equal strings, and ranks are in the strings' order.

    By doubling: ranks to a depth of 2 d are those of the pairs of ranks to the depth d, d places apart.
    """
    n = len(data)
    padded, rank = np.concatenate([data, np.zeros(8, np.uint8)]), np.zeros(n, np.uint64)
    for k in range(8):
        rank = rank << np.uint64(8) | padded[k : k + n]
    rank, depth = np.unique(rank, return_inverse=True)[1].astype(np.uint64), 8
    while 2 * depth <= width:
        further = np.concatenate([rank[depth:], np.zeros(min(depth, n), np.uint64)])[:n]
        rank, depth = np.unique(rank << np.uint64(32) | further, return_inverse=True)[1].astype(np.uint64), 2 * depth
    return np.unique(rank[starts] << np.uint64(32) | rank[starts + width - depth], return_inverse=True)[1]


def corpus_order(contexts: list[bytes], counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank, places, context) of each window of each distinct context: its rank in the order of all windows, and at how many
    places of the texts windows of this rank begin.

    The suffix array of the dictionary (``contexts``) is combined with the parse, of which only the number of places of each context matters.
    """
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    n = sizes - width + 1
    own = np.repeat(np.arange(len(contexts)), n)
    starts = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(sizes) - sizes, n)
    rank = suffix_ranks(np.frombuffer(b"".join(contexts), np.uint8), starts, width)
    return rank, np.bincount(rank, counts[own]).astype(np.int64)[rank], own


def repeated_windows(core: np.ndarray, contexts: list[bytes], counts: np.ndarray, width: int) -> np.ndarray:
    """[contexts, words of 64 bits]: bit j of a distinct context says whether its window j begins at two places or more."""
    out = np.zeros((len(contexts), -(-reach(width) // 64) * 64), np.uint8)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts)) - width + 1
    group = np.unique(core, return_inverse=True)[1]
    shared = np.bincount(group)[group] > 1
    alone = ~shared & (counts > 1)  # no other context has its core, so nothing else can have its windows
    out[alone] = np.arange(out.shape[1]) < sizes[alone, None]
    if shared.any():
        at = np.flatnonzero(shared)
        _, places, own = corpus_order([contexts[i] for i in at.tolist()], counts[at], width)
        n = sizes[at]
        out[at[own], np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)] = places > 1
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def judge_contexts(asked: DataFrame, width: int) -> DataFrame:
    """For each context that a chunk asked about, one bit a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for k, blobs in grouped(batches):
            own: dict[bytes, int] = {}
            which, cores, counts = [], [], []
            for _, x in blobs:
                core, sizes, n, raw = unpack(x, "uint64", "uint32", "uint32", "uint8", spread=True)
                raw, ends = raw.tobytes(), np.cumsum(sizes.astype(np.int64))
                which.append(np.array([own.setdefault(raw[z - s : z], len(own)) for z, s in zip(ends.tolist(), sizes.tolist())]))
                cores.append(np.cumsum(core))
                counts.append(n)
            every = np.concatenate(which)
            first = np.unique(every, return_index=True)[1]
            bits = repeated_windows(np.concatenate(cores)[first], list(own), np.bincount(every, np.concatenate(counts)).astype(np.int64), width)
            for (chunk, _), w in zip(blobs, which):
                if bits[w].any():
                    yield k, chunk, pack(bits[w].ravel(), spread=True)

    return map_rows(deal(asked), run, PACKED)


# -- the result -----------------------------------------------------------------------------

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
PIECES = "doc_id long, text long, piece long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def cut(joined: DataFrame, width: int, buckets: int, with_text: bool = False) -> DataFrame:
    """One row a piece; the kept bytes come along of pieces that are part of a text, or with ``with_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for k in range(b.num_rows):
                docs, texts, got, more = (c[k].as_py() for c in b.columns)
                x = Text(docs, texts)
                edge = np.zeros(len(x.bytes) + 1, np.int32)  # +1 where removal begins, -1 where it ends
                if more:
                    f = repeated_cores(x.phrases(width), got)
                    blobs = {m["bucket"]: m["blob"] for m in more}
                    for k_, at, _, which in distinct(x.bytes.tobytes(), f, buckets):
                        if k_ in blobs:
                            bits = unpack(blobs[k_], "uint64", spread=True)[0].reshape(-1, -(-reach(width) // 64))[which]
                            phrase, j = np.nonzero(np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little"))
                            start = f.begin[at][phrase] + j
                            edge[start] += 1  # each window once
                            edge[start + width] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                for n, (i, end) in enumerate(zip(x.ids, x.ends.tolist())):
                    a = end - int(x.lens[n] - x.before[n])
                    g, raw = gone[a : a + int(x.own[n])], x.bytes[a : a + int(x.own[n])]
                    before = bool(gone[a - 1]) if x.before[n] else False
                    spans = int((g & ~np.concatenate([[before], g[:-1]])).sum()) if len(g) else 0
                    kept = raw[~g].tobytes() if g.any() else raw.tobytes()
                    part = x.number[n] >= 0
                    yield i, int(x.key[n]) if part else None, int(x.number[n]) if part else None, len(raw), int(g.sum()), spans, None if part else hashlib.sha256(kept).hexdigest(), kept if part or with_text else None

    return map_rows(joined.select("docs", "texts", "cores", "windows"), run, PIECES)


def whole(pieces: DataFrame, with_text: bool) -> DataFrame:
    """The rows of texts from those of their pieces, which come in order; a task holds one piece at a time, or with the text one text."""
    ddl = RESULT + ", kept binary" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, held, digest, kept = None, None, None, []

        def close() -> tuple:
            return (*held, digest.hexdigest(), *([b"".join(kept)] if with_text else []))

        for b in batches:
            for k in range(b.num_rows):
                i, text, _, n, gone, spans, _, raw = (c[k].as_py() for c in b.columns)
                if text != key:
                    if key is not None:
                        yield close()
                    key, held, digest, kept = text, [i, 0, 0, 0], hashlib.sha256(), []
                held[1:] = [held[1] + n, held[2] + gone, held[3] + spans]
                digest.update(raw)
                if with_text:
                    kept.append(raw)
        if key is not None:
            yield close()

    dealt = pieces.where("text IS NOT NULL").repartition(n_shuffle(pieces.sparkSession), "text").sortWithinPartitions("text", "piece")
    done = pieces.where("text IS NULL").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text)
    return done.union(map_rows(dealt, run, ddl))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, with_text: bool = False) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with ``with_text`` the kept bytes).

    A byte goes if a string of ``width`` bytes that covers it also starts anywhere else, in any document or the same;
    overlaps count, and all copies go, the first too.  Texts are UTF-8 bytes; null is empty; documents shorter than
    ``width`` stay.  A cut may fall inside a code point, so kept bytes are binary.  Rows that repeat an id, or have none,
    are documents of their own.  An empty table gives an empty table.

    Strings are equal if their bytes are: hashes only say which contexts can't be.  What moves is packed: about 6 bytes a
    phrase, then the contexts whose core repeats, each once a chunk.  A passage in a third of all documents is one entry a
    chunk and phrase; nothing is gathered by passage.  A text longer than CHUNK is cut into overlapping pieces, so memory is bounded by
    CHUNK, but for the row itself.
    """
    if width < 3 * TRIGGER:
        raise ValueError(f"strings of under {3 * TRIGGER} bytes have no trigger")
    buckets = n_buckets(df.sparkSession)
    table = Stage(chunks(df, id_col, text_col, width), "repeats-chunks")
    cores = Stage(judge_cores(ask_cores(table.df(), width, buckets)), "repeats-cores", release=True)
    first = table.df().join(answers(cores.df(), "cores"), "chunk")
    windows = Stage(judge_contexts(ask_contexts(first, width, buckets), width), "repeats-windows", release=True)
    last = table.df().join(answers(cores.df(), "cores"), "chunk", "left").join(answers(windows.df(), "windows"), "chunk", "left")
    pieces = Stage(cut(last, width, buckets, with_text), "repeats-pieces")
    for x in (table, cores, windows):
        x.drop()
    return whole(pieces.df(), with_text)
