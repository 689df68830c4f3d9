"""SimHash fingerprints, their binary trie self-join, and the groups that links form."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED, SLICE, Stage, arrow_schema, by_bucket, deal, docs_of, give_back, grouped, map_rows, mix64, n_buckets, n_shuffle, pack, settle, slices_of, staged, text_bytes, tidy, unpack

BITS = 64
UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text: bytes, words: int, size: int = SLICE) -> np.ndarray:
    """The hashes of a text's runs of words in order; a text of fewer words is one run, and without words there is none.

    ``size`` bytes of a long text are split at a time; the last words of a part go on to the next.
    """
    parts, w = [], []
    for x in slices_of(text, size):
        w += x.translate(UPPER).split()
        if len(w) >= words:
            parts.append(runs(w, words))
            w = w[len(w) - words + 1 :]
    if not parts and w:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)], np.uint64)
    return np.concatenate([np.zeros(0, np.uint64), *parts])


def runs(w: list[bytes], words: int) -> np.ndarray:
    joined, h = b" ".join(w), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = [0, *ends[: len(w) - words].tolist()]
    return np.array([h(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that most hashes have; 0 without any."""
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):  # 256 KB of bits at a time, however long the text is
        part = hashes[at : at + 4096]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, words: int = 3) -> int:
    """The majority bits of the hashes of a text's shingles; 0 without words."""
    return majority(shingles(text, words))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("doc_id long, fp long")
        for b in batches:
            fps = np.fromiter((fingerprint(t, words) for t in text_bytes(b.column(1))), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], schema=schema)

    return docs_of(df, id_col, (text_col, "text")).mapInArrow(run, "doc_id long, fp long")


# -- the trie -------------------------------------------------------------------------------
# A sorted array of distinct fingerprints is a binary trie: a node is a range of it, at a depth.

#: Node pairs with at most so many leaf pairs are compared leaf by leaf.
LEAF = 64
#: Node pairs held at a time.
FRONTIER = 1 << 15


class Forest:
    """Union-find over array places; keeps one link for each union, so links never outnumber fingerprints."""

    def __init__(self, n: int):
        self.up, self.links = np.arange(n), []

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while (self.up[r] != r).any():
            r = self.up[r]
        self.up[x] = r
        return r

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.roots(a), self.roots(b)
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            keep = lo != hi
            a, b, lo, hi = a[keep], b[keep], lo[keep], hi[keep]
            # one union for each root at a time; what it leaves open comes again
            _, first = np.unique(hi, return_index=True)
            self.up[hi[first]] = lo[first]
            self.links += zip(a[first].tolist(), b[first].tolist())


def trie_join(fps: np.ndarray, limit: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between the two nodes of each pair, or within one node; the forest is of all pairs together.

    A pair is a row (begin, end, begin, end): two ranges of ``fps`` that are sorted and distinct each, or one range twice.

    Pairs of nodes go down the trie together.  ``errors`` counts the bits in which their paths differ; a pair over
    ``limit`` is dropped with all below it.  A pair that can't get over it any more (few bits are left) is linked as a
    chain without looking further, and so is a node with itself.
    """
    forest = Forest(len(fps))
    stack = [(pairs[k : k + FRONTIER], 0, np.zeros(len(pairs[k : k + FRONTIER]), np.int64)) for k in range(0, len(pairs), FRONTIER)]
    while stack:
        pairs, depth, err = stack.pop()
        sizes_a, sizes_b = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
        same = pairs[:, 0] == pairs[:, 2]
        sure = err + (BITS - depth) <= limit
        for lo, hi, lo2, hi2 in pairs[sure]:
            x = np.concatenate([np.arange(lo + 1, hi), np.arange(lo2, hi2)])
            forest.link(np.full(len(x), lo), x)
        small = ~sure & (sizes_a * sizes_b <= LEAF)
        if small.any():
            p, n = pairs[small], (sizes_a * sizes_b)[small]
            own = np.repeat(np.arange(len(p)), n)
            k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            width = sizes_b[small][own]
            i, j = p[own, 0] + k // width, p[own, 2] + k % width
            near = (np.bitwise_count(fps[i] ^ fps[j]) <= limit) & (i < j)
            forest.link(i[near], j[near])
        rest = ~sure & ~small
        if not rest.any() or depth >= BITS:
            continue
        p, e, same = pairs[rest], err[rest], same[rest]
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
        mid = np.stack([split(fps, p[:, 0], p[:, 1], bit), split(fps, p[:, 2], p[:, 3], bit)], 1)
        low_a, high_a, low_b, high_b = (p[:, 0], mid[:, 0]), (mid[:, 0], p[:, 1]), (p[:, 2], mid[:, 1]), (mid[:, 1], p[:, 3])
        parts = [(low_a, low_b, 0, None), (high_a, high_b, 0, None), (low_a, high_b, 1, None), (high_a, low_b, 1, ~same)]
        below, errs = [], []
        for x, y, more, only in parts:
            keep = (x[1] > x[0]) & (y[1] > y[0]) & (e + more <= limit)
            if only is not None:
                keep &= only
            below.append(np.stack([x[0], x[1], y[0], y[1]], 1)[keep])
            errs.append((e + more)[keep])
        below, errs = np.concatenate(below), np.concatenate(errs)
        stack += [(below[k : k + FRONTIER], depth + 1, errs[k : k + FRONTIER]) for k in range(0, len(below), FRONTIER)]
    return forest.links


def split(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where the bit turns from 0 to 1 within each range: a binary search for all ranges at once."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        m = (lo + hi) >> 1
        up = (fps[np.minimum(m, len(fps) - 1)] & bit) == 0
        lo, hi = np.where(open_ & up, m + 1, lo), np.where(open_ & ~up, m, hi)
    return lo


#: Distinct fingerprints of a node that one task takes: at least, at most.
NODES = (1 << 12, 1 << 15)
#: Parts of a node, at most; fingerprints that go down the trie together.
PARTS, TOGETHER = 64, 1 << 16


def cuts(n: int, limit: int, node: int) -> list[int]:
    """Bit masks: of two fingerprints that differ in ``limit`` bits or fewer, at least one mask shows the same of both.

    The bits are cut into blocks; a mask takes all but ``limit`` of them.  There are as many blocks as are needed for nodes of
    about ``node`` among n even fingerprints.
    """
    for blocks in range(limit + 1, 2 * limit + 3):
        edges = [BITS * k // blocks for k in range(blocks + 1)]
        masks = [sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in own) for own in combinations(range(blocks), blocks - limit)]
        if n >> min(m.bit_count() for m in masks) <= node:
            break
    return masks


def links(fps: DataFrame, limit: int = 3) -> DataFrame:
    """(a, b): a spanning forest, task by task, of the pairs of distinct fingerprints that differ in ``limit`` bits or fewer.

    Fingerprints that are equal under one of the masks of cuts() are a node; each is in as many nodes as there are masks (4 up to
    some 2 * 10^9 fingerprints).  A node goes down the binary trie with itself.  One that holds more than a task should is dealt into
    parts by hash, and its tasks are pairs of parts, so close fingerprints that share most bits are split too, which cutting by
    further bits would leave together.  A node of more than PARTS times a task's size has larger parts.
    """
    spark = fps.sparkSession
    n = fps.count()
    node = min(max(n // (4 * n_shuffle(spark)), NODES[0]), NODES[1])
    masks = cuts(n, limit, node)
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    each = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("cut"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("key")) for k, m in enumerate(masks)])).alias("x")).select("fp", "x.cut", "x.key")
    sizes = each.groupBy("cut", "key").count().where("count > 1").withColumn("parts", F.least(F.ceil(F.col("count") / node), F.lit(PARTS)).cast("int"))
    own = each.join(sizes, ["cut", "key"]).withColumn("part", F.pmod(F.xxhash64("fp", "cut"), F.col("parts")).cast("int"))
    dealt = own.select("cut", "key", "fp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("cut", "key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), (F.col("part") > F.col("other")).alias("second"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, size = [], 0

        def join() -> Iterator[tuple]:
            # columns: cut, key, lo, hi, second, fp; rows of a task come one after the other, those of its second part last
            task = np.concatenate([h[0] for h in held])
            second, fp = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            order = np.lexsort((fp, second, task))
            task, second, fp = task[order], second[order], fp[order]
            new = np.flatnonzero(np.concatenate([[True], (task[1:] != task[:-1]) | (second[1:] != second[:-1])]))
            begin, end = new, np.append(new[1:], len(fp))
            first = ~second[begin]
            follows = np.append(second[begin][1:], False)  # a range after which the second part of its task comes
            at = np.flatnonzero(first)
            partner = np.where(follows[at], at + 1, at)
            both = single[task[begin[at]]]
            use = both | follows[at]  # a part that meets another, without any of it, has nothing to do
            pairs = np.stack([begin[at], end[at], begin[partner], end[partner]], 1)[use]
            for x, y in trie_join(fp, limit, pairs):
                yield int(fp[x].view(np.int64)), int(fp[y].view(np.int64))

        single = np.zeros(0, bool)
        last, count = None, -1
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            change = np.zeros(b.num_rows, bool)
            change[1:] = np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)
            change[0] = last is None or last != tuple(int(c[0]) for c in cols[:4])
            last = tuple(int(c[-1]) for c in cols[:4])
            starts = np.flatnonzero(change)
            at = 0
            # a batch is cut where enough has come together and a task ends
            for cut in [*(starts[starts > 0].tolist()), b.num_rows] if size + b.num_rows > TOGETHER else [b.num_rows]:
                if change[at] and size >= TOGETHER:
                    yield from join()
                    held, size, count, single = [], 0, -1, np.zeros(0, bool)
                number = count + np.cumsum(change[at:cut])
                fresh = np.flatnonzero(change[at:cut]) + at
                single = np.concatenate([single, cols[2][fresh] == cols[3][fresh]])
                held.append((number, cols[4][at:cut].astype(bool), cols[5][at:cut].view(np.uint64)))
                size, count, at = size + cut - at, int(number[-1]), cut
        if held:
            yield from join()

    tasks = dealt.repartition(n_shuffle(spark), "cut", "key", "lo", "hi").sortWithinPartitions("cut", "key", "lo", "hi")
    return map_rows(tasks, run, "a long, b long")


def groups(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): connected components by alternating large-star and small-star steps; root is the smallest node,
    with a row of its own.

    Each step is two aggregations; a node's neighbours are never gathered, only their minimum.  A step's result is a table in
    the shared folder; steps end when none changes.  Nodes without a link are not in the result.
    """
    now = Stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    seen = None
    for _ in range(rounds):
        e = now.df()
        # large star: all larger neighbours of a node go to its smallest neighbour (or itself)
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        mid = Stage(large, "large-star")
        # small star: a node and its smaller neighbours go to the smallest of them
        e = mid.df()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        new = Stage(small, "small-star")
        state = new.df().agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        mid.drop()
        now.drop()
        now = new
        if state == seen:
            stars = now.df().select(F.col("u").alias("node"), F.col("v").alias("root"))
            return stars.union(stars.select("root", "root").distinct())
        seen = state
    raise RuntimeError("the groups did not settle")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, limit: int = 3) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hexadecimal digits), component_id, fp.

    Texts whose fingerprints differ in ``limit`` bits or fewer are linked; component_id is the smallest doc_id that
    links reach.  A null text counts as empty; texts without words have fingerprint zero and are linked like others.
    Rows that repeat an id each get a row.  A null id takes part in links but is never a component_id, unless all ids
    of the component are null (then it is null).  An empty table gives an empty table.
    """
    each = staged(fingerprints(df, id_col, text_col, words), "fingerprints")
    own = staged(each.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    root = groups(links(own.select("fp"), limit))
    reach = own.join(root, own.fp == root.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    # only linked fingerprints need their group's minimum
    lowest = reach.where("linked").groupBy("root").agg(F.min("low").alias("least"))
    ids = reach.join(lowest, "root", "left").select("fp", F.when(F.col("linked"), F.col("least")).otherwise(F.col("low")).alias("component_id"))
    ids = staged(ids, "components")
    return each.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


# -- near copies by shingle similarity --------------------------------------------------------
# SimHash puts texts of similarity 0.8 at about 10 of 64 bits, where the trie visits nearly all pairs. So the trie finds the
# closest copies, and bands of least hashes find most others: one band meets at similarity s with probability s^DEEP. What
# both miss is found by prefixes, which miss nothing, and only between the groups that are there already.

#: Bands, and least hashes a band: of pairs of similarity 0.8 at least one band meets for 99.8 %.
BANDS, DEEP = 16, 5
_draw = np.random.default_rng(11).integers(0, 1 << 64, (2, BANDS * DEEP, 1), np.uint64)
FACTORS, SHIFTS = _draw[0] | np.uint64(1), _draw[1]


def band_keys(own: np.ndarray) -> np.ndarray:
    """One key a band of a set of hashes; none for an empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * DEEP, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 4096):
        least = np.minimum(least, (own[at : at + 4096] * FACTORS + SHIFTS).min(axis=1))
    rows = least.reshape(BANDS, DEEP)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of distinct hashes the common part of the union; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


#: Hashes of texts that are held while frequent ones are counted; texts among them that make a hash frequent; frequent hashes, at most.
HELD, OFTEN, FREQUENT = 1 << 20, 4, 100_000


def often(sets: list[np.ndarray]) -> list[int]:
    """The hashes that OFTEN sets or more hold."""
    if len(sets) < OFTEN:
        return []
    h, n = np.unique(np.concatenate(sets), return_counts=True)
    return h[n >= OFTEN].view(np.int64).tolist()


def sketches(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, node, fp, keys, often): node is a hash of the text's shingle set, so texts of one node are of similarity 1.

    ``often`` is null but in some rows, which name hashes that are frequent among the different texts before them."""
    ddl = "doc_id long, node long, fp long, keys array<long>, often array<long>"
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64())), ("often", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fp, keys, common, held, size = [], [], [], [], {}, 0
            for k, t in enumerate(text_bytes(b.column(1))):
                hashes = shingles(t, words)
                own = np.unique(hashes)
                node.append(xxhash.xxh64_intdigest(own.tobytes()))
                fp.append(majority(hashes))
                keys.append(band_keys(own))
                size += len(own) if node[-1] not in held else 0
                held[node[-1]] = own
                full = size >= HELD or k + 1 == b.num_rows
                common.append(often(list(held.values())) if full else None)
                held, size = ({}, 0) if full else (held, size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(common, pa.list_(pa.int64()))], schema=schema)

    return docs_of(df, id_col, (text_col, "text")).mapInArrow(run, ddl)


def candidate_pairs(nodes: DataFrame, limit: int) -> DataFrame:
    """(a, b), a < b: in each band, and among equal fingerprints, every node with the first and the last of its key in an order
    that differs by band; and the links of the trie.  A key makes at most two pairs a node, however many share it, so pairs
    are left out here; prefix_pairs() finds them."""
    keys = nodes.select("node", F.posexplode("keys").alias("band", "key")).union(nodes.select("node", F.lit(-1), "fp"))
    keys = keys.withColumn("at", F.struct(F.xxhash64("node", "band").alias("h"), "node"))
    ends = keys.groupBy("band", "key").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first != last")
    met = keys.join(ends.select("band", "key", "first", "last"), ["band", "key"])
    met = met.select("node", F.explode(F.array("first.node", "last.node")).alias("other"))
    of_fp = staged(nodes.groupBy("fp").agg(F.min("node").alias("node")), "distinct-fingerprints")
    near = links(of_fp.select("fp"), limit).join(of_fp.select(F.col("fp").alias("a"), "node"), "a").join(of_fp.select(F.col("fp").alias("b"), F.col("node").alias("other")), "b")
    pairs = met.union(near.select("node", "other")).where("node != other")
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that of the rows of a batch only FEW are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, FEW):
            yield b.slice(at, FEW)


def alike(pairs: DataFrame, texts: DataFrame, least: float, words: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts, of (node, text), have a shingle similarity of ``least`` or more."""
    # texts of a hot node are split by adaptive execution; its rows come one after the other, so its set is made once
    joined = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, own = None, None
        for batch in few_rows(batches):
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), text_bytes(batch.column(3))):
                if a != held:
                    held, own = a, np.unique(shingles(x, words))
                if similarity(own, np.unique(shingles(y, words))) >= least:
                    yield a, b

    return map_rows(joined.select("a", "b", "text_a", "text_b"), run, "a long, b long")


# Two sets of similarity ``least`` share one of the first hashes of each, in any order of all hashes: so many that fewer than
# the share that they must have in common come after them. Hashes that many texts hold come last in the order.

#: Texts of a key whose pairs are made where the key is; pairs that are looked at together; bits of a bitmap, at most.
KEY, BLOCK, MAP = 1 << 12, 1 << 20, 1 << 20
#: Rows of a batch that a task sends on; rows with two texts or bitmaps that are unpacked at a time.
ROWS, FEW = 1 << 16, 1 << 8
#: For rounding: sizes are whole numbers.
TINY = 1e-6


def prefix(own: np.ndarray, least: float, frequent: np.ndarray) -> np.ndarray:
    """The first hashes of a sorted set, of which another set of similarity ``least`` holds one among its own; ``frequent`` is sorted."""
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own
        own = np.concatenate([own[~late], own[late]])
    return own[: len(own) - int(np.ceil(least * len(own) - TINY)) + 1].copy()  # a view would hold the whole set


def needed(both: np.ndarray, least: float) -> np.ndarray:
    """What sets of ``both`` hashes, counted together, must have in common."""
    return np.ceil(both * (least / (1 + least)) - TINY)


def meetings(task: np.ndarray, major: np.ndarray, home: np.ndarray, own: np.ndarray, root: np.ndarray, n: np.ndarray, at: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of texts (a, b) of one task that may have the similarity, and not the same root (0: none).

    ``own`` is a text's number, ``n`` the size of its set, ``at`` the place of the task's hash in its order: if it is the first that
    two sets share, no more than n - at can be common.  ``major`` texts are of one root each task, so they don't meet each other;
    two others meet if the smaller one is at ``home``.
    """
    order = np.lexsort((own, n, major, task))
    task, major, home, own, root, n, at = (x[order] for x in (task, major, home, own, root, n, at))
    part = 2 * np.cumsum(np.append(False, task[1:] != task[:-1])) + major
    n, span = n.astype(np.int64), np.int64(n.max(initial=0) + 1)
    place = part * span + n
    i = np.flatnonzero(~major)
    most, fewest = np.minimum(n[i] / least + TINY, span - 1).astype(np.int64), np.ceil(n[i] * least - TINY).astype(np.int64)
    until = np.searchsorted(place, part[i] * span + most, "right")
    begin = np.concatenate([i + 1, np.searchsorted(place, (part[i] + 1) * span + fewest, "left")])
    end = np.concatenate([np.where(home[i], until, i + 1), np.searchsorted(place, (part[i] + 1) * span + most, "right")])
    i = np.concatenate([i, i])
    some = end > begin
    i, begin, total = i[some], begin[some], np.cumsum(end[some] - begin[some])
    k = 0
    while k < len(i):
        before = total[k - 1] if k else 0
        stop = max(int(np.searchsorted(total, before + BLOCK)), k + 1)
        width = np.diff(total[k:stop], prepend=before)
        x = np.repeat(i[k:stop], width)
        y = np.arange(len(x)) - np.repeat(np.cumsum(width) - width - begin[k:stop], width)
        need = needed(n[x] + n[y], least)
        keep = (n[x] - at[x] >= need) & (n[y] - at[y] >= need) & ((root[x] != root[y]) | (root[x] == 0))
        yield own[x[keep]], own[y[keep]]
        k = stop


def largest(key: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Of keys and roots in order, which places are of the key's most frequent root (0 is none)."""
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (root[1:] != root[:-1])))
    size = np.diff(np.append(new, len(key)))
    weight = np.where(root[new] == 0, 0, size)
    order = np.lexsort((weight, key[new]))
    last = order[np.append(key[new][order][1:] != key[new][order][:-1], True)]
    best = np.zeros(len(new), bool)
    best[last[weight[last] > 1]] = True
    return np.repeat(best, size)


def prefix_pairs(texts: DataFrame, words: int, least: float, frequent: np.ndarray) -> DataFrame:
    """(a, b), a < b: of (doc_id, root, text), all pairs of different roots (0: none) that may have the similarity; none that has it is missing.

    The prefix hashes of all texts are dealt by hash, packed.  A hash that no two texts share is gone then, and one
    that only texts of one root share.  Texts of a hash are paired at once, or in tasks if they are many: those of the
    hash's most frequent root are dealt into parts, the others go to every part.
    """
    spark = texts.sparkSession
    buckets, many, parts_most = n_buckets(spark), KEY, PARTS
    kinds = ("<u8", "<i8", "<i8", "<i4", "<i4")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, size = [], 0

        def flush() -> Iterator[tuple]:
            keys = mix64(np.concatenate([h[0] for h in held]))
            sizes = [len(h[0]) for h in held]
            cols = [np.repeat(np.array([h[k] for h in held], t), sizes) for k, t in ((1, np.int64), (2, np.int64), (3, np.int32))]
            cols.append(np.concatenate([np.arange(m, dtype=np.int32) for m in sizes]))
            order = np.argsort(keys)
            keys, cols = keys[order], [c[order] for c in cols]
            for bucket, (lo, hi) in enumerate(zip(*(x.tolist() for x in by_bucket(keys, buckets)))):
                if hi > lo:
                    yield bucket, 0, pack(keys[lo:hi], *(c[lo:hi] for c in cols), spread=True)

        for b in batches:
            for i, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2))):
                own = np.unique(shingles(t, words))
                if len(own):
                    held.append((prefix(own, least, frequent), i, r, len(own)))
                    size += len(held[-1][0])
                if size >= HELD:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()
        held = []
        give_back()

    ddl = "key long, part int, major boolean, home boolean, a long, b long, root long, n int, at int"
    schema = arrow_schema(ddl)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in grouped(batches):
            key, own, root, n, at = (np.concatenate(x) for x in zip(*(unpack(blob, *kinds, spread=True) for _, blob in held)))
            order = np.lexsort((root, key))
            key, own, root, n, at = (x[order] for x in (key, own, root, n, at))
            major = largest(key, root)
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            count = np.diff(np.append(new, len(key)))
            use = (count > 1) & (np.add.reduceat(major, new, dtype=np.int64) < count)
            parts = np.where(use, np.minimum(-(-count // many), parts_most), 0)
            parts = np.repeat(parts, count)
            x = parts == 1
            if x.any():
                for a, b in meetings(key[x], major[x], np.ones(int(x.sum()), bool), own[x], root[x], n[x], at[x], least):
                    a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else (a, b)
                    for k in range(0, len(a), ROWS):
                        u, v = a[k : k + ROWS], b[k : k + ROWS]
                        none = np.zeros(len(u), np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (none.astype(np.int64), none - 1, none > 0, none > 0, u, v, none.astype(np.int64), none, none)], schema=schema)
            x = np.flatnonzero(parts > 1)
            mine = (mix64(own[x].view(np.uint64)) % parts[x].astype(np.uint64)).astype(np.int32)
            times = np.where(major[x], 1, parts[x])
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            x, mine = np.repeat(x, times), np.repeat(mine, times)
            part = np.where(major[x], mine, part).astype(np.int32)
            for k in range(0, len(x), ROWS):
                z, p, m = (v[k : k + ROWS] for v in (x, part, mine))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (key[z].view(np.int64), p, major[z], p == m, own[z], own[z], root[z], n[z], at[z])], schema=schema)
        give_back()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last, number = [], 0, None, 0

        def join() -> Iterator[pa.RecordBatch]:
            for a, b in meetings(*(np.concatenate(c) for c in zip(*held)), least):
                for k in range(0, len(a), ROWS):
                    u, v = a[k : k + ROWS], b[k : k + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], schema=arrow_schema("a long, b long"))

        for b in batches:
            if not b.num_rows:
                continue
            key, part, major, home, own, _, root, n, at = (b.column(k).to_numpy(zero_copy_only=False) for k in range(9))
            change = np.append((int(key[0]), int(part[0])) != last, (key[1:] != key[:-1]) | (part[1:] != part[:-1]))
            last = (int(key[-1]), int(part[-1]))
            task = number + np.cumsum(change)
            number = int(task[-1])
            first = int(np.argmax(change)) if change.any() else b.num_rows
            for lo, hi in ((0, first), (first, b.num_rows)):
                if lo == first and size >= BLOCK >> 4 and hi > lo:
                    yield from join()
                    held, size = [], 0
                if hi > lo:
                    held.append(tuple(c[lo:hi] for c in (task, major.astype(bool), home.astype(bool), own, root, n, at)))
                    size += hi - lo
        if held:
            yield from join()

    met = Stage(deal(map_rows(texts, chunks, PACKED)).mapInArrow(meet, ddl), "met", release=True).df()
    tasks = met.where("part >= 0").repartition(n_shuffle(spark), "key", "part").sortWithinPartitions("key", "part")
    return met.where("part < 0").select("a", "b").union(tasks.mapInArrow(finish, "a long, b long")).distinct()


def bitmap(own: np.ndarray) -> bytes:
    """Whether the hashes of a set that fall on a bit are odd in number; four bits a hash or more, up to MAP."""
    bits = min(max(64, 1 << (4 * len(own)).bit_length()), MAP)
    odd = np.bincount((mix64(own) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """So many hashes at least are in one of two sets only, by their bitmaps; the larger is folded to the size of the other."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum(dtype=np.int64))


def possible(pairs: DataFrame, texts: DataFrame, least: float, words: int) -> DataFrame:
    """The (a, b) of ``pairs`` but for those whose bitmaps show that their similarity is under ``least``."""

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for node, t in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                own = np.unique(shingles(t, words))
                yield node, len(own), bitmap(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in few_rows(batches):
            for a, b, n, m, x, y in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if apart(x, y) <= n + m - 2 * needed(n + m, least):
                    yield a, b

    each = staged(map_rows(texts, maps, "node long, n long, bits binary"), "bitmaps")
    joined = pairs
    for c in "ba":
        joined = joined.join(each.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")), c)
    return map_rows(joined.select("a", "b", "n_a", "n_b", "bits_a", "bits_b"), run, "a long, b long")


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, limit: int = 3) -> DataFrame:
    """(doc_id, component_id): groups of texts that pairs of shingle similarity ``least`` (above 0) or more connect.

    Ids must be distinct and not null.  Similarity is the part that two texts' sets of ``words``-word shingles share of their union.
    Fingerprints within ``limit`` bits and bands find most pairs; then the pairs between the groups so far are sought by prefixes, which
    leave out none.  Each pair is checked by its whole sets, so no other texts are linked.  (Shingles and sets are told apart by 64-bit hashes.)
    Texts without words are one group.
    """
    each = staged(sketches(df, id_col, text_col, words), "sketches")
    nodes = staged(each.groupBy("node").agg(F.min("doc_id").alias("low"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")
    all_texts = docs_of(df, id_col, (text_col, "text"))
    texts_of = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    pairs = settle(lambda: candidate_pairs(nodes, limit), "pairs").df()
    texts = nodes.join(texts_of(pairs), "node").select("node", F.col("low").alias("doc_id")).join(all_texts, "doc_id").select("node", "text")
    root = groups(settle(lambda: alike(pairs, staged(texts, "pair-texts"), least, words), "alike").df())
    found = staged(nodes.join(root, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("linked")), "found")
    # what is between the groups; a text has the number of its first document now
    rows = each.select(F.explode("often").alias("hash")).groupBy("hash").count().orderBy(F.desc("count"), "hash").limit(FREQUENT).collect()
    frequent = np.sort(np.array([r.hash for r in rows], np.int64).view(np.uint64))
    tidy(df.sparkSession)
    chosen = found.select(F.col("low").alias("doc_id"), F.when(F.col("linked"), F.col("root")).otherwise(0).alias("root"))
    more = settle(lambda: prefix_pairs(chosen.join(all_texts, "doc_id").select("doc_id", "root", "text"), words, least, frequent), "more-pairs").df()
    late = staged(texts_of(more).withColumnRenamed("node", "doc_id").join(all_texts, "doc_id").select(F.col("doc_id").alias("node"), "text"), "more-texts")
    left = settle(lambda: possible(more, late, least, words), "possible").df()
    new = settle(lambda: alike(left, late, least, words), "more-alike").df()
    for c in "ab":
        new = new.join(found.select(F.col("low").alias(c), F.col("root").alias(f"root_{c}")), c)
    top = groups(new.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    own = found.join(top.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("component_id"))
    return each.select("doc_id", "node").join(own, "node").select("doc_id", "component_id")
