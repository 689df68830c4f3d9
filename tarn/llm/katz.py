"""LM scoring: a Katz backoff model with Good-Turing discounts, its counts and backoff weights in partitioned tables.

A model of order m scores a token after the m - 1 tokens before it.  Texts become chunks of packed tokens, staged once.  For each
order two packed shuffles follow: grams are dealt by hashes of context and word, so what follows a frequent word is
spread over SPREAD buckets, and counted; then contexts, of which each of these buckets sends a partial sum, are dealt by their own
hash and get their backoff weights.  Both answer each chunk with what it asked for, so nothing is broadcast or collected that grows with
the vocabulary, and a gram that is in every text is one entry a chunk.  Answers number the grams that were seen without gaps; the
contexts of the next order are these numbers.  A chunk then evaluates its tokens from the highest order down.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED, SLICE, Buckets, Stage, answers, arrow_schema, bucket_of, by_bucket, crc_mod, deal, give_back, grouped, map_rows, mix64, n_buckets, pack, slices_of, text_bytes, unpack

#: The order of the query's model.
ORDER = 2
#: Counts up to here are discounted.
K = 5
#: Tokens of a chunk, about.
CHUNK = 800_000
UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Hash of the end of a text; no word contains a blank.
END = xxhash.xxh64_intdigest(b" end", 7)
CHUNKS = "chunk long, vocab binary, tokens binary"


# -- chunks of packed tokens ----------------------------------------------------------------


class Hashes(dict):
    """The hash of each word; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


#: Of each piece: id, whether there is one, held out, number of its text or -1 if it is whole, tokens before its own, all tokens.
DOCS = ("int64", "uint8", "uint8", "int64", "uint8", "int64")


def chunks(df: DataFrame, id_col: str, text_col: str, order: int) -> DataFrame:
    """One row for about CHUNK tokens: the sorted hashes of its words, and pieces as numbers into them.

    A piece is a text, or a part of one of more tokens than CHUNK, with the ``order`` - 1 tokens before it, which are neither counted
    nor scored again.
    """
    fold = F.coalesce(crc_mod(f"`{id_col}`", 7) == 2, F.lit(False))
    own = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), fold.alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    most, size_of = CHUNK, SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        hashes, part, n, serial = Hashes(), TaskContext.get().partitionId(), 0, 0
        rows, toks, size = [], [], 0

        def flush() -> tuple:
            vocab, local = np.unique(np.concatenate(toks), return_inverse=True)
            docs = (np.array(x, t) for x, t in zip(zip(*rows), DOCS))
            return (part << 32) + n, pack(steps(vocab), spread=True), pack(*docs, local.astype(np.uint32), level=3, spread=True)

        def pieces(text: bytes) -> Iterator[tuple[int, np.ndarray, bool]]:
            """(tokens before its own, tokens, whether more follow)"""
            held, count, before = [], 0, 0
            for x in slices_of(text, size_of):
                words = x.translate(UPPER).split()
                held.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
                count += len(words)
                if count >= most + before:
                    t = np.concatenate(held)
                    yield before, t, True
                    before = min(order - 1, len(t))
                    held, count = [t[len(t) - before :]], before
            yield before, np.concatenate([*held, np.array([END], np.uint64)]), False

        for b in batches:
            for i, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2))):
                serial += 1
                for before, t, more in pieces(text):
                    rows.append((i or 0, i is not None, h, (part << 32) + serial if more or before else -1, before, len(t)))
                    toks.append(t)
                    size += len(t)
                    if size >= most:
                        yield flush()
                        rows, toks, size, n = [], [], 0, n + 1
        if rows:
            yield flush()

    return map_rows(own, run, CHUNKS)


@dataclass
class Chunk:
    ids: list
    held: np.ndarray
    text: np.ndarray
    before: np.ndarray
    lens: np.ndarray
    vocab: np.ndarray
    local: np.ndarray

    @staticmethod
    def of(vocab: bytes, tokens: bytes) -> Chunk:
        ids, known, held, text, before, lens, local = unpack(tokens, *DOCS, "uint32", spread=True)
        v = np.cumsum(unpack(vocab, "uint64", spread=True)[0])
        return Chunk([i if k else None for i, k in zip(ids.tolist(), known.tolist())], held.astype(bool), text, before.astype(np.int64), lens, v, local)

    def doc(self) -> np.ndarray:
        """The piece of each token."""
        return np.repeat(np.arange(len(self.lens)), self.lens)

    def own(self) -> np.ndarray:
        """Whether each token is a piece's own."""
        place = np.arange(len(self.local)) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)
        return place >= np.repeat(self.before, self.lens)

    def trained(self) -> np.ndarray:
        return ~self.held[self.doc()] & self.own()


def steps(x: np.ndarray) -> np.ndarray:
    """Each value but the first as the step from the one before it: sorted values compress so."""
    out = x.copy()
    out[1:] -= x[:-1]
    return out


# -- words ----------------------------------------------------------------------------------


def ask_words(table: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for chunk, vocab, tokens in zip(*(c.to_pylist() for c in b.columns)):
                c = Chunk.of(vocab, tokens)
                n = np.bincount(c.local[c.trained()], minlength=len(c.vocab)).astype(np.uint32)
                for k, (lo, hi) in enumerate(zip(*by_bucket(c.vocab, buckets))):
                    if hi > lo:
                        yield k, chunk, pack(steps(c.vocab[lo:hi]), n[lo:hi], spread=True)

    return map_rows(table.select("chunk", "vocab", "tokens"), run, PACKED)


#: Kinds of rows: an answer to a chunk; a part of the table; counts of counts; a partial sum over contexts.
ANSWER, TABLE, COUNTS, PARTIAL = range(4)
KINDS = "kind int, " + PACKED


def count_words(asked: DataFrame) -> DataFrame:
    """Answers: the counts that a chunk asked for, and the words' places among those that were seen in the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for k, blobs in grouped(batches):
            parts = [unpack(x, "uint64", "uint32", spread=True) for _, x in blobs]
            words, inverse = np.unique(np.concatenate([np.cumsum(p[0]) for p in parts]), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
            place = np.cumsum(total > 0)
            at = 0
            for (chunk, _), p in zip(blobs, parts):
                own = inverse[at : at + len(p[0])]
                yield ANSWER, k, chunk, pack(total[own], steps(place[own]), spread=True)
                at += len(p[0])
            yield TABLE, k, 0, pack(steps(words[total > 0]), total[total > 0], spread=True)
            yield COUNTS, k, 0, pack(count_counts(total), np.array([total.sum(), (total > 0).sum()]))

    return map_rows(deal(asked), run, KINDS)


def count_counts(n: np.ndarray) -> np.ndarray:
    """How many entries have the count 0, 1, ... K + 1."""
    return np.bincount(n[n <= K + 1], minlength=K + 2).astype(np.int64)


def discounts(counts: np.ndarray) -> np.ndarray:
    """Katz's factors for counts 0 to K by Good and Turing; 1 beyond.

    Where the counts of counts don't give factors between 0 and 1 (small or odd tables), r / (r + 1) holds for that r.
    """
    d = np.ones(K + 2)
    n = counts.astype(float)
    tail = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        star = (r + 1) * n[r + 1] / n[r] if n[r] else 0.0
        x = (star / r - tail) / (1 - tail) if tail < 1 else 0.0
        d[r] = x if 0 < x < 1 else r / (r + 1)
    return d


@dataclass
class Words:
    """Probabilities of single words from their counts; what discounts free goes to the one unknown word.

    ``seen`` scales all known words: 1, unless no count is discounted; then total / (total + kinds), as in Witten and Bell.
    """

    total: int
    kinds: int
    d: np.ndarray
    seen: float
    unknown: float

    @staticmethod
    def of(counts: np.ndarray, total: int, kinds: int) -> Words:
        d = discounts(counts)
        free = sum(float(counts[r]) * r * (1 - d[r]) for r in range(1, K + 1)) / max(total, 1)
        seen = 1.0 if free > 0 or not total else total / (total + kinds)
        return Words(total, kinds, d, seen, free if free > 0 else 1 - seen if total else 1.0)

    def p(self, c: np.ndarray) -> np.ndarray:
        """The probability of a word with the count c; with 0, of the unknown word."""
        return np.where(c > 0, self.seen * self.d[np.minimum(c, K + 1).astype(np.int64)] * c / max(self.total, 1), self.unknown)


# -- a chunk at each order ------------------------------------------------------------------


@dataclass
class Level:
    """What holds for all grams of an order above one: discounts, and the number of each bucket's first gram, of all grams last."""

    d: np.ndarray
    numbers: np.ndarray


class Walk:
    """The tokens of a chunk: the gram that ends at each and its probability, order by order.

    ``answers`` has, for each order that is known, what the chunk was told: (words,), then (grams, contexts).
    """

    def __init__(self, c: Chunk, words: Words, numbers: np.ndarray, levels: list[Level], answers: list[list], buckets: int):
        self.c, self.words, self.levels, self.answers, self.buckets = c, words, levels, answers, buckets
        parts = [(x["bucket"], *unpack(x["blob"], "int64", "int64", spread=True)) for x in sorted(answers[0], key=lambda x: x["bucket"])]
        self.known = np.concatenate([n for _, n, _ in parts])
        #: the number of each word of the chunk's vocabulary; -1 if training has none of it
        self.word = np.where(self.known > 0, np.concatenate([numbers[k] + np.cumsum(i) - 1 for k, _, i in parts]), -1)
        self.numbers, self.first = numbers, np.cumsum(c.lens) - c.lens

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(number, probability) of the gram of this order that ends at each token; -1 is the number of one never seen.

        The recursion of Katz: a seen gram has its discounted share of its context, any other the weight that the context
        leaves times the probability that the next lower order gives.
        """
        if order == 1:
            return self.word[self.c.local], self.words.p(self.known)[self.c.local]
        gram, p = self.grams(order - 1)
        level, (got, weights) = self.levels[order - 2], self.answers[order - 1]
        context = self.context(gram, order)
        a = self.asked(gram, context, p)
        n, rank = self.told(got, a.bucket, "int64", "int64")
        k = np.full(len(gram), -1)
        k[a.tokens] = a.place
        count = np.where(k >= 0, n[k], 0) if len(n) else np.zeros(len(gram), np.int64)
        at, bucket, _ = self.contexts(context)
        alpha, scale, whole = self.told(weights, bucket, "float64", "float64", "int64")
        own = np.maximum(at, 0)
        seen = (at >= 0) & (whole[own] > 0) if len(whole) else np.zeros(len(gram), bool)
        lower = p * np.where(seen, alpha[own], 1.0) if len(whole) else p
        with np.errstate(divide="ignore", invalid="ignore"):
            share = scale[own] * level.d[np.minimum(count, K + 1)] * count / np.maximum(whole[own], 1) if len(whole) else lower
        number = np.full(len(gram), -1)
        if len(rank) == len(n) and len(n):
            begin = np.concatenate([[True], a.bucket[1:] != a.bucket[:-1]])
            places = level.numbers[a.bucket] + summed(rank, begin) - 1
            number = np.where(count > 0, places[np.maximum(k, 0)], -1)
        return number, np.where(count > 0, share, lower)

    def context(self, gram: np.ndarray, order: int) -> np.ndarray:
        """The number of the gram of one order less before each token; at the first of a text, that of the beginning."""
        before = np.empty_like(gram)
        before[1:] = gram[:-1]
        # what is before a piece that goes on is not known here, and only its own tokens need it
        before[self.first] = np.where(self.c.before > 0, -1, self.numbers[-1] if order == 2 else self.levels[order - 3].numbers[-1])
        return before

    def asked(self, gram: np.ndarray, context: np.ndarray, p: np.ndarray) -> Asked:
        """Distinct grams that training may have: their context and what follows it were seen. In order of bucket, context, word.

        The same chunk gives the same order each time, so answers need no keys.
        """
        tokens = np.flatnonzero((context >= 0) & (gram >= 0))
        heads, head = np.unique(context[tokens], return_inverse=True)
        local = self.c.local[tokens].astype(np.int64)
        code, one, inverse = np.unique(head * np.int64(len(self.word) + 1) + local, return_index=True, return_inverse=True)
        ctx, word = heads[code // (len(self.word) + 1)], self.word[code % (len(self.word) + 1)]
        n = np.bincount(inverse[self.c.trained()[tokens]], minlength=len(code))
        bucket = context_bucket(ctx, self.buckets) * SPREAD + (mix64(mix64(ctx.astype(np.uint64)) ^ word.astype(np.uint64)) % np.uint64(SPREAD)).astype(np.int64)
        # codes are in the order of context and word already, as words are numbered in the order of the vocabulary
        order = by_buckets(bucket, self.buckets)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return Asked(tokens, place[inverse], bucket[order], ctx[order], word[order], n[order], np.where(n > 0, p[tokens[one]], 0.0)[order])

    def contexts(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each token's context or -1, buckets, contexts): distinct ones in order of bucket and number."""
        tokens = np.flatnonzero(context >= 0)
        own, inverse = np.unique(context[tokens], return_inverse=True)
        bucket = context_bucket(own, self.buckets)
        order = by_buckets(bucket, self.buckets)
        place, at = np.empty(len(order), np.int64), np.full(len(context), -1)
        place[order] = np.arange(len(order))
        at[tokens] = place[inverse]
        return at, bucket[order], own[order]

    @staticmethod
    def told(got: list, bucket: np.ndarray, *types: str) -> list[np.ndarray]:
        """Answers put together in the order of their buckets, which is that of the questions."""
        parts = [unpack(x["blob"], *types, spread=True) for x in sorted(got or [], key=lambda x: x["bucket"])]
        return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate(types)]


@dataclass
class Asked:
    """tokens with a question, the place of each one's; bucket, context, word, training count, lower probability of each question."""

    tokens: np.ndarray
    place: np.ndarray
    bucket: np.ndarray
    context: np.ndarray
    word: np.ndarray
    n: np.ndarray
    lower: np.ndarray


def by_buckets(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """The order of buckets; within one, things stay as they are."""
    return np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")


#: Buckets over which the grams of one context are spread.
SPREAD = 16


def context_bucket(context: np.ndarray, buckets: int) -> np.ndarray:
    return bucket_of(mix64(context.astype(np.uint64)), buckets // SPREAD)


def summed(moved: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """What steps() began from, of runs that begin where ``begin`` is true."""
    total = np.cumsum(moved)
    at = np.flatnonzero(begin)
    before = np.concatenate([[0], total[at[1:] - 1]]).astype(total.dtype)
    return total - before[np.cumsum(begin) - 1]


def slices(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of one bucket."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
        if hi > lo:
            yield int(bucket[lo]), slice(lo, hi)


# -- grams and contexts of an order ---------------------------------------------------------


@dataclass
class State:
    """All that tasks need to walk a chunk up to some order: a few numbers a bucket."""

    words: Words
    numbers: np.ndarray
    levels: list[Level]
    buckets: int

    def walks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Walk]]:
        """Columns: chunk, vocab, tokens, words, then grams and contexts of each order."""
        for b in batches:
            for k in range(b.num_rows):
                chunk, vocab, tokens, words, *more = (c[0].as_py() for c in b.slice(k, 1).columns)
                yield chunk, Walk(Chunk.of(vocab, tokens), self.words, self.numbers, self.levels, [words, *zip(more[::2], more[1::2])], self.buckets)


def ask_grams(joined: DataFrame, state: State, order: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for chunk, w in state.walks(batches):
            gram, p = w.grams(order - 1)
            # of single words the counts are sent, which take fewer bytes than their probabilities
            a = w.asked(gram, w.context(gram, order), w.known[w.c.local].astype(float) if order == 2 else p)
            for k, at in slices(a.bucket):
                yield k, chunk, pack(steps(a.context[at]), a.word[at], a.n[at].astype(np.uint32), a.lower[at], level=3, spread=True)
            del w, gram, p, a
            give_back()

    return map_rows(joined, run, PACKED)


def count_grams(asked: DataFrame, numbered: bool, words: Words | None) -> DataFrame:
    """Answers: the count of each gram that a chunk asked for, and with ``numbered`` its place among those that were seen.

    ``words``: lower probabilities are those of single words, whose counts are in their place.

    Partial sums of a bucket, for the bucket of its contexts: context, count, kinds, lower probabilities of its seen grams, and how many of
    these have the counts 1 to K.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for k, blobs in grouped(batches):
            parts = [unpack(x, "int64", "int64", "uint32", "float64", spread=True) for _, x in blobs]
            ctx = np.concatenate([np.cumsum(p[0]) for p in parts])
            word, n, lower = (np.concatenate([p[j] for p in parts]) for j in (1, 2, 3))
            order = np.lexsort((word, ctx))
            new = np.ones(len(order), bool)
            new[1:] = (ctx[order][1:] != ctx[order][:-1]) | (word[order][1:] != word[order][:-1])
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(new) - 1
            total = np.bincount(group, n).astype(np.int64)
            seen, first = total > 0, order[new]
            rank, at = np.cumsum(seen), 0
            for (chunk, _), p in zip(blobs, parts):
                own = group[at : at + len(p[0])]
                yield ANSWER, k, chunk, pack(total[own], steps(rank[own]) if numbered else rank[:0], level=3, spread=True)
                at += len(p[0])
            below = np.maximum.reduceat(lower[order], np.flatnonzero(new))[seen]
            heads, tails = ctx[first][seen], total[seen]
            yield TABLE, k, 0, pack(steps(heads), word[first][seen], tails, spread=True)
            yield COUNTS, k, 0, pack(count_counts(total), np.array([total.sum(), seen.sum()]))
            yield PARTIAL, k // SPREAD, 0, partial(heads, tails, words.p(below) if words else below)

    return map_rows(deal(asked), run, KINDS)


def partial(ctx: np.ndarray, n: np.ndarray, lower: np.ndarray) -> bytes:
    """The sums of seen grams by context, which are in order."""
    own, at = np.unique(ctx, return_inverse=True)
    m = len(own)
    sums = np.bincount(at, n, m).astype(np.int64), np.bincount(at, minlength=m), np.bincount(at, lower, m), *(np.bincount(at[n == r], minlength=m) for r in range(1, K + 1))
    return pack(steps(own), *sums, spread=True)


def ask_contexts(joined: DataFrame, state: State, order: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for chunk, w in state.walks(batches):
            gram, _ = w.grams(order - 1)
            _, bucket, own = w.contexts(w.context(gram, order))
            for k, at in slices(bucket):
                yield ANSWER, k, chunk, pack(steps(own[at]), spread=True)
            del w, gram, bucket, own
            give_back()

    return map_rows(joined, run, KINDS)


SUMS = ("int64", "int64", "int64", "float64", *("int64",) * K)


def weigh_contexts(asked: DataFrame, d: np.ndarray) -> DataFrame:
    """Answers: backoff weight, scale and count of the contexts that a chunk asked for; the table has those of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for k, rows in grouped(batches, "kind"):
            parts = [unpack(x, *SUMS, spread=True) for kind, _, x in rows if kind == PARTIAL]
            ctx, at = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.cumsum(p[0]) for p in parts)]), return_inverse=True)
            add = lambda j: np.bincount(at, np.concatenate([np.zeros(0), *(p[j] for p in parts)]), len(ctx))
            count, kinds, mass = add(1).astype(np.int64), add(2), add(3)
            scale, alpha = backoff(d, count, kinds, mass, np.stack([add(j) for j in range(4, 4 + K)], 1))
            yield TABLE, k, 0, pack(steps(ctx), count, scale, alpha, spread=True)
            # a context that nothing followed in training comes last
            scale, alpha, count = np.append(scale, 1.0), np.append(alpha, 1.0), np.append(count, 0)
            for kind, chunk, x in rows:
                if kind == ANSWER:
                    own = np.cumsum(unpack(x, "int64", spread=True)[0])
                    place = np.searchsorted(ctx, own)
                    place[ctx[np.minimum(place, max(len(ctx) - 1, 0))] != own if len(ctx) else slice(None)] = len(ctx)
                    yield ANSWER, k, chunk, pack(alpha[place], scale[place], count[place], level=3, spread=True)

    return map_rows(deal(asked), run, KINDS)


def backoff(d: np.ndarray, count: np.ndarray, kinds: np.ndarray, mass: np.ndarray, small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale, alpha) of each context: seen pairs have scale * d[c] * c / count, others alpha * p(word).

    Exactly normalised: alpha is what seen pairs leave, over the single-word probability of all words not seen there.
    scale is 1, unless nothing is discounted in a context; then count / (count + kinds) frees something there too.
    A context never seen has alpha 1.
    """
    r = np.arange(1, K + 1)
    free = (small * r * (1 - d[1 : K + 1])).sum(axis=1)
    scale = np.where(free > 0, 1.0, count / np.maximum(count + kinds, 1))
    left = np.where(free > 0, free / np.maximum(count, 1), 1 - scale)
    rest = np.maximum(1 - mass, 1e-300)
    return scale, np.where(count > 0, left / rest, 1.0)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
PIECES = RESULT + ", text long"


def score_chunks(joined: DataFrame, state: State, order: int) -> DataFrame:
    """One row a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, words = arrow_schema(PIECES), state.words
        for _, w in state.walks(batches):
            c, known, own = w.c, w.known, w.c.own()
            token = np.where(own, np.log10(w.grams(order)[1]), 0.0)
            doc, m = c.doc(), len(c.lens)
            base = np.where(own, np.log10((known + 1) / (words.total + words.kinds + 1))[c.local], 0.0)
            text = [k if k >= 0 else None for k in c.text.tolist()]
            cols = [c.ids, c.held.tolist(), c.lens - c.before, np.bincount(doc, (known > 0)[c.local] & own, m).astype(np.int64), np.full(m, words.total), np.bincount(doc, base, m), np.bincount(doc, token, m), text]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema)], schema=schema)
            del w, c, token, doc, base, cols, own

    return joined.mapInArrow(run, PIECES)


def whole(pieces: DataFrame) -> DataFrame:
    """The rows of texts: the sums of their pieces."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    sums = pieces.where("text IS NOT NULL").groupBy("text").agg(*[(F.sum if c in ("n_tokens", "n_known", "base_score", "score") else F.first)(c).alias(c) for c in names])
    return pieces.where("text IS NULL").select(*names).union(sums.select(*names))


# -- the operator ---------------------------------------------------------------------------


def totals(counted: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of counts; the sums of what else COUNTS has; the number of each bucket's first entry, and of all: a few numbers a bucket."""
    parts = {r.bucket: unpack(bytes(r.blob), "int64", "int64") for r in counted.where(F.col("kind") == COUNTS).select("bucket", "blob").collect()}
    numbers = np.cumsum([0, *(int(parts[k][1][1]) if k in parts else 0 for k in range(buckets))])
    return sum((p[0] for p in parts.values()), np.zeros(K + 2, np.int64)), sum((p[1] for p in parts.values()), np.zeros(2, np.int64)), numbers


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32(id as text) mod 7 is not 2 (a null id is not held out) and scores all, both as the
    contract of the query says, the latter by a model of ``order`` (2 or more).  A null text is empty: one token, its end.  Rows
    that repeat an id each count and get a row.  Without training documents every token is unknown.  A text of more tokens than
    CHUNK is several pieces, whose sums are its row.  An empty table gives an empty table.

    The tables of an order (TABLE rows: gram counts, then contexts with their weights) lie in the shared folder, partitioned by kind and
    packed by bucket, until the scores are written.
    """
    if order < 2:
        raise ValueError("a backoff model has order two or more")
    spark = df.sparkSession
    buckets = n_buckets(spark)
    table = Buckets(chunks(df, id_col, text_col, order), "katz-chunks", "chunk")
    counted = Stage(count_words(ask_words(table.df(), buckets)), "katz-words", release=True, by="kind")
    counts, (total, kinds), numbers = totals(counted.df(), buckets)
    state, staged = State(Words.of(counts, int(total), int(kinds)), numbers, [], buckets), [counted]

    def joined(known: list[Stage]) -> DataFrame:
        out = table.df()
        for k, x in enumerate(known):
            out = out.join(answers(x.df().where(F.col("kind") == ANSWER), f"got{k}"), "chunk", "left")
        return out.select("chunk", "vocab", "tokens", *(f"got{k}" for k in range(len(known))))

    for m in range(2, order + 1):
        asked = ask_grams(joined(staged), state, m)
        grams = Stage(count_grams(asked, m < order, state.words if m == 2 else None), f"katz-grams-{m}", release=True, by="kind")
        counts, _, numbers = totals(grams.df(), buckets)
        level = Level(discounts(counts), numbers)
        sums = grams.df().where(F.col("kind") == PARTIAL).select("kind", "bucket", "chunk", "blob")
        weights = Stage(weigh_contexts(ask_contexts(joined(staged), state, m).union(sums), level.d), f"katz-contexts-{m}", release=m < order, by="kind")
        staged += [grams, weights]
        state = State(state.words, state.numbers, [*state.levels, level], buckets)
    out = Stage(score_chunks(joined(staged), state, order), "katz-scores")
    for x in (table, *staged):
        x.drop()
    return whole(out.df())
