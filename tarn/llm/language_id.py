"""Language ID: a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import crc_mod, map_rows, mix64, text_bytes

#: Hidden units in each direction.
HIDDEN = 8
#: Bytes of a segment; every byte of a text lies in one.  Segments of a text go through the network side by side, so the state at an
#: edge comes from WARM bytes beyond it, not from the whole text; a test measures what that changes.
SEGMENT, WARM = 384, 64
#: Segments of a language that training uses, at most, drawn from all segments of all labelled texts of the training fold.
SAMPLE = 800
UNKNOWN = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class BiGru:
    """Weights; [d] is the direction: 0 forwards, 1 backwards.

    A step of unit vector h on byte b: z, r = sigmoid(W[b] + U h), c = tanh(W[b] + U (r * h)), h = h + z * (c - h).
    """

    labels: list[str]
    embed: np.ndarray  # [d, 256, 3H]: input weights of each byte, biases included
    gates: np.ndarray  # [d, 2H, H]
    cand: np.ndarray  # [d, H, H]
    out: np.ndarray  # [L, 2H + 1]

    def pass_(self, d: int, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """States of one direction; x: [T, B] bytes in reading order. The state is zero where the mask is."""
        H = self.gates.shape[2]
        h, W = np.zeros((H, x.shape[1]), np.float32), np.ascontiguousarray(self.embed[d].T)
        hs, trace, full = np.empty((len(x), H, x.shape[1]), np.float32), [], mask.all(axis=1)
        for t in range(len(x)):
            w = np.take(W, x[t], axis=1)
            g = w[: 2 * H] + self.gates[d] @ h
            g *= 0.5
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            z, r = g[:H], g[H:]
            c = self.cand[d] @ (r * h)
            c += w[2 * H :]
            np.tanh(c, out=c)
            if keep:
                trace.append((h, z, r, c))
            h = h + z * (c - h)
            if not full[t]:
                h *= mask[t]
            hs[t] = h
        return hs, trace

    def positions(self, x: np.ndarray, mask: np.ndarray, warm: int = 0) -> np.ndarray:
        """Probabilities of each label at each position, [T - 2 warm, L, B], zero where the mask is.

        The first and last ``warm`` rows only warm up the direction that reads them first.
        """
        T = len(x) - 2 * warm
        f, _ = self.pass_(0, x[: T + warm], mask[: T + warm])
        b, _ = self.pass_(1, x[warm:][::-1], mask[warm:][::-1])
        f, b, H = f[warm:], b[warm:][::-1], f.shape[1]
        out = np.empty((T, len(self.labels), x.shape[1]), np.float32)
        for t in range(T):
            s = self.out[:, :H] @ f[t] + self.out[:, H : 2 * H] @ b[t] + self.out[:, -1:]
            s -= s.max(axis=0)
            np.exp(s, out=s)
            s *= mask[warm + t] / s.sum(axis=0)
            out[t] = s
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy of all positions, and its gradients by backpropagation through time. y: [B] labels."""
        T, B = x.shape
        H, n = self.gates.shape[2], max(1.0, float(mask.sum()))
        passes = [self.pass_(0, x, mask, True), self.pass_(1, x[::-1], mask[::-1], True)]
        g = [np.zeros_like(a) for a in (self.embed, self.gates, self.cand, self.out)]
        dh = np.zeros((2, T, H, B), np.float32)
        loss, hot = 0.0, np.zeros((len(self.labels), B), np.float32)
        hot[y, np.arange(B)] = 1
        for t in range(T):
            f, b = passes[0][0][t], passes[1][0][T - 1 - t]
            s = self.out[:, :H] @ f + self.out[:, H : 2 * H] @ b + self.out[:, -1:]
            s -= s.max(axis=0)
            p = np.exp(s)
            p /= p.sum(axis=0)
            loss -= float((np.log(p[y, np.arange(B)] + 1e-9) * mask[t]).sum()) / n
            ds = (p - hot) * mask[t] / n
            g[3][:, :H] += ds @ f.T
            g[3][:, H : 2 * H] += ds @ b.T
            g[3][:, -1] += ds.sum(axis=1)
            dh[0, t] += self.out[:, :H].T @ ds
            dh[1, T - 1 - t] += self.out[:, H : 2 * H].T @ ds
        for d in (0, 1):
            order, real, back = (x, x[::-1])[d], (mask, mask[::-1])[d], np.zeros((H, B), np.float32)
            down = np.empty((T, 3 * H, B), np.float32)
            for t in range(T - 1, -1, -1):
                h, z, r, c = passes[d][1][t]
                e = (dh[d, t] + back) * real[t]
                dc, dz = e * z * (1 - c * c), e * (c - h) * z * (1 - z)
                drh = self.cand[d].T @ dc
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate([dz, dr])
                back = e * (1 - z) + drh * r + self.gates[d].T @ dzr
                g[1][d] += dzr @ h.T
                g[2][d] += dc @ (r * h).T
                down[t, : 2 * H], down[t, 2 * H :] = dzr, dc
            for k in range(3 * H):
                g[0][d, :, k] = np.bincount(order.ravel(), down[:, k].ravel(), 256)
        return loss, g


def train(pieces: list[bytes], langs: list[str], hidden: int = HIDDEN, epochs: int = 10, batch: int = 256, rate: float = 0.02, seed: int = 11) -> BiGru:
    """Adam on segments of texts; the same segments give the same network."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    H, L = hidden, len(labels)
    net = BiGru(labels, *(rng.normal(0, s, n).astype(np.float32) for s, n in ((0.4, (2, 256, 3 * H)), (0.3, (2, 2 * H, H)), (0.3, (2, H, H)), (0.3, (L, 2 * H + 1)))))
    pieces = [(p, labels.index(y)) for p, y in zip(pieces, langs) if p]
    m, v, step = [np.zeros_like(a) for a in params(net)], [np.zeros_like(a) for a in params(net)], 0
    total = max(1, epochs * -(-len(pieces) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        for k in range(0, len(order), batch):
            own = [pieces[i] for i in order[k : k + batch]]
            x, mask = padded([p[0] for p in own])
            _, g = net.gradients(x, mask, np.array([p[1] for p in own]))
            step += 1
            size = rate * (1 - step / (total + 1))
            norm = np.sqrt(sum(float((a * a).sum()) for a in g))
            for i, (p, a) in enumerate(zip(params(net), g)):
                a = a * min(1.0, 1.0 / (norm + 1e-9))
                m[i] = 0.9 * m[i] + 0.1 * a
                v[i] = 0.99 * v[i] + 0.01 * a * a
                p -= (size * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def params(net: BiGru) -> tuple[np.ndarray, ...]:
    return net.embed, net.gates, net.cand, net.out


def padded(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """[T, B] bytes and which of them are real."""
    T = max(map(len, pieces))
    x = np.frombuffer(b"".join(p.ljust(T, b"\0") for p in pieces), np.uint8).reshape(len(pieces), T).T
    mask = (np.arange(T)[:, None] < np.fromiter(map(len, pieces), np.int64, len(pieces))).astype(np.float32)
    return np.ascontiguousarray(x), mask


#: Segments that go through the network at a time.
BATCH = 2048


def pooled(net: BiGru, texts: list[bytes]) -> np.ndarray:
    """[documents, labels]: the mean of the position probabilities of each whole text."""
    sums, waiting = np.zeros((len(texts), len(net.labels))), []

    def run() -> None:
        if waiting:
            x, mask = segments([(texts[i], at) for i, at in waiting])
            np.add.at(sums, [i for i, _ in waiting], net.positions(x, mask, WARM).sum(axis=0).T)
            waiting.clear()

    # full segments first, then last ones by length, so that a batch is padded as little as possible
    full = ((i, at) for i, t in enumerate(texts) for at in range(0, len(t) - SEGMENT + 1, SEGMENT))
    last = sorted((len(t) % SEGMENT, i, len(t) - len(t) % SEGMENT) for i, t in enumerate(texts) if len(t) % SEGMENT)
    for kind in (full, ((i, at) for _, i, at in last)):
        for x in kind:
            waiting.append(x)
            if len(waiting) == BATCH:
                run()
        run()
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    return sums / np.maximum(n, 1)[:, None]


def segments(places: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
    """[T + 2 WARM, B] bytes around the segments that begin at these places of texts, and which of them there are."""
    T = max(min(SEGMENT, len(t) - at) for t, at in places) + 2 * WARM
    rows, begin, end = [], np.empty(len(places), np.int64), np.empty(len(places), np.int64)
    for k, (t, at) in enumerate(places):
        stop = min(at + T - WARM, len(t)) if at + SEGMENT < len(t) else len(t)
        piece = t[max(0, at - WARM) : stop]
        begin[k] = WARM - min(at, WARM)
        end[k] = begin[k] + len(piece)
        rows.append(b"\0" * int(begin[k]) + piece.ljust(T - int(begin[k]), b"\0"))
    x = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), T).T
    t = np.arange(T)[:, None]
    return np.ascontiguousarray(x), ((t >= begin) & (t < end)).astype(np.float32)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> BiGru | None:
    """Train on ``sample`` segments of each language at most, drawn by a hash of id and place; crc32(id) mod 4 is not 2.

    Every segment of every labelled text may be drawn, however long the text is.  Rows with a null id, text or language, and empty
    texts, teach nothing; rows that repeat an id and a text are drawn together.  Without any there is no network (None).
    """
    c = lambda x: F.col(f"`{x}`")
    rows = df.select(c(id_col).cast("long").alias("id"), c(text_col).cast("string").alias("text"), c(lang_col).alias("lang")).where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL AND text != ''")
    rows = rows.where(crc_mod("id", 4) != 2)
    n = F.ceil(F.octet_length("text") / SEGMENT)
    shares = {r[0]: min(1.0, 1.5 * sample / r[1]) for r in rows.groupBy("lang").agg(F.sum(n)).collect()}  # one row a language
    packed = df.sparkSession.sparkContext.broadcast(shares)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own = packed.value
        for b in batches:
            for i, lang, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2))):
                m = -(-len(raw) // SEGMENT)
                with np.errstate(over="ignore"):
                    h = mix64(np.uint64(i & (1 << 64) - 1) * np.uint64(0x9E3779B97F4A7C15) + np.arange(m, dtype=np.uint64)) >> np.uint64(11)
                for k in np.flatnonzero(h < np.uint64(own[lang] * (1 << 53))).tolist():
                    yield int(h[k]), i, lang, raw[k * SEGMENT : (k + 1) * SEGMENT]

    few = map_rows(rows.select("id", "lang", "text"), drawn, "h long, id long, lang string, piece binary").collect()
    pieces, langs = [], []
    for lang in sorted(shares):
        own = sorted((r.h, r.id, bytes(r.piece)) for r in few if r.lang == lang)[:sample]
        pieces += [x[2] for x in own]
        langs += [lang] * len(own)
    return train(pieces, langs) if pieces else None


def predict(df: DataFrame, net: BiGru | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score) for every whole text, without a shuffle.

    ``und`` with score 0 where the text is null or has no letter, or where there is no network.  The score is the
    pooled probability of the predicted language; of labels of one probability the first in their order.  Rows that repeat an id get
    a row each, alike if their texts are.  A text of any length is read whole, BATCH segments at a time.  Columns named in ``keep`` come
    along unchanged.
    """
    sent = [text_col, *[c for c in keep if c != text_col]]
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *[F.col(f"`{c}`").alias(f"keep_{k}") for k, c in enumerate(sent)])
    kept = [sent.index(c) for c in keep]
    out = StructType.fromDDL("doc_id long, lang_pred string, score double")
    for k in kept:
        out.add(rows.schema[f"keep_{k}"])
    packed = df.sparkSession.sparkContext.broadcast(net)  # 20 KB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = packed.value, out.names
        for b in batches:
            texts = [t if t is not None and any(map(str.isalpha, t)) else "" for t in b.column(1).to_pylist()]
            p = pooled(own, [t.encode() for t in texts]) if own else np.zeros((len(texts), 1))
            k = p.argmax(axis=1)
            lang = [own.labels[j] if own and t else UNKNOWN for t, j in zip(texts, k.tolist())]
            score = [min(1.0, s) if t else 0.0 for t, s in zip(texts, p.max(axis=1).tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), *[b.column(1 + k) for k in kept]], names=names)

    return rows.mapInArrow(run, out).select("doc_id", "lang_pred", "score", *[F.col(f"keep_{k}").alias(sent[k]) for k in kept])
