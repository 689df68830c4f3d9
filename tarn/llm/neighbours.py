"""Approximate nearest neighbours: inverted lists scanned by an adaptive dimension scan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, n_shuffle, staged

#: Vectors that centroids are trained on, and queries that the number of probed lists is tuned on, at most.
SAMPLE, TUNE = 8192, 128
#: Vectors that a list should hold; centroids of a level, at most: lists grow with the table to the square of that.
LIST, CENTROIDS = 1024, 1024
#: Dimensions of a column block; vectors of a block of a list, and queries that scan it together, at most.
COLUMNS, ROWS, QUERIES = 16, 4096, 512
#: The hypothesis test's factor: a candidate is abandoned if its partial distance is off by more than CONFIDENCE / sqrt(dimensions).
CONFIDENCE = 2.1
#: Part of true neighbours that tuning aims at.
RECALL = 0.97
#: Part of candidates under which those left are looked at one by one; pairs that are scored exactly at a time.
FEW, PAIRS = 0.2, 1 << 16


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


@dataclass
class Index:
    """A random rotation, the largest norm, centroids of two levels, and how many cells and lists a query looks at.

    A list is a cell (the nearest of ``coarse``) and the nearest of ``fine`` to what is left of the vector; its number is
    cell * len(fine) + place.  ``sample`` holds vectors of the table, from which queries get their first bounds.
    """

    rotation: np.ndarray
    largest: float
    coarse: np.ndarray
    fine: np.ndarray
    sample: np.ndarray
    #: the list of each vector of the sample
    at: np.ndarray | None = None
    wide: int = 1
    probes: int = 1

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Vectors with one dimension more, in which the least distance is the largest inner product; rotated."""
        rest = np.sqrt(np.maximum(self.largest**2 - (x * x).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], 1) @ self.rotation

    def query(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([q, np.zeros((len(q), 1))], 1) @ self.rotation

    def lists(self) -> int:
        return len(self.coarse) * len(self.fine)

    def list_of(self, lifted: np.ndarray) -> np.ndarray:
        cell = distances(lifted, self.coarse).argmin(1)
        return cell * len(self.fine) + distances(lifted - self.coarse[cell], self.fine).argmin(1)

    def near(self, q: np.ndarray, wide: int) -> np.ndarray:
        """The lists of the ``wide`` nearest cells of each lifted query, nearest first."""
        d = distances(q, self.coarse)
        if len(self.fine) == 1:
            return np.argsort(d, 1, kind="stable")
        cell = np.argsort(d, 1, kind="stable")[:, :wide]
        # |q - c - f|^2 = |q - c|^2 - 2 q f + 2 c f + |f|^2
        both = np.take_along_axis(d, cell, 1)[:, :, None] + 2 * (self.coarse @ self.fine.T)[cell] + ((self.fine**2).sum(1) - 2 * q @ self.fine.T)[:, None, :]
        number = cell[:, :, None] * len(self.fine) + np.arange(len(self.fine))
        order = np.argsort(both.reshape(len(q), -1), 1, kind="stable")
        return np.take_along_axis(number.reshape(len(q), -1), order, 1)

    def bounds(self, q: np.ndarray, routes: list[np.ndarray], k: int) -> np.ndarray:
        """A score that k vectors of each query's own lists reach: the k-th best of the sample's vectors in them."""
        out, there = np.full(len(q), -np.inf), np.zeros(self.lists(), bool)
        scores = q @ self.sample.T
        for i, near in enumerate(routes):
            there[near] = True
            own = scores[i, there[self.at]]
            there[near] = False
            if len(own) >= k:
                out[i] = -np.partition(-own, k - 1)[k - 1]
        return out

    def route(self, q: np.ndarray, sizes: np.ndarray, k: int) -> list[np.ndarray]:
        """The lists that each query scans: the nearest ``probes``, and further ones until they hold k vectors."""
        lifted, out = self.query(q), []
        for i, near in enumerate(self.near(lifted, self.wide)):
            if sizes[near[: self.probes]].sum() < k:
                near = self.near(lifted[i : i + 1], len(self.coarse))[0]
                out.append(near[: max(self.probes, int(np.searchsorted(np.cumsum(sizes[near]), k)) + 1)])
            else:
                out.append(near[: self.probes])
        return out


def means(x: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k-means: n centroids."""
    c = x[rng.permutation(len(x))[:n]].copy()
    for _ in range(rounds if len(c) > 1 else 1):
        own = distances(x, c).argmin(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        count = np.bincount(own, minlength=len(c))
        c[count > 0] = total[count > 0] / count[count > 0][:, None]
    return c


def fit(sample: np.ndarray, largest: float, n: int, k: int, seed: int = 5) -> Index:
    """Centroids of the sample for a table of n vectors; then the least numbers of cells and lists that find RECALL of the
    sample's own k neighbours."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    rotation = np.linalg.qr(rng.normal(size=(d + 1, d + 1)))[0]
    index = Index(rotation, largest, np.zeros((1, d + 1)), np.zeros((1, d + 1)), sample)
    x = index.lift(sample)
    lists = max(1, -(-n // LIST))
    index.coarse = means(x, min(lists, CENTROIDS, len(x)), rng)
    if lists > len(index.coarse):
        rest = x - index.coarse[distances(x, index.coarse).argmin(1)]
        index.fine = means(rest, min(-(-lists // len(index.coarse)), CENTROIDS, len(x)), rng)
    own = index.at = index.list_of(x)
    q = sample[rng.permutation(len(sample))[:TUNE]]
    best = np.argsort(-(q @ sample.T), 1)[:, : min(k + 1, len(sample))]
    lifted = index.query(q)
    order = np.argsort(distances(lifted, index.coarse), 1, kind="stable")
    index.wide = part_of(order, own[best] // len(index.fine), len(index.coarse)) if len(index.fine) > 1 else len(index.coarse)
    index.probes = part_of(index.near(lifted, index.wide), own[best], index.lists())
    return index


def part_of(order: np.ndarray, wanted: np.ndarray, n: int) -> int:
    """How many of each row's ``order`` hold RECALL of what is wanted, over all rows."""
    needed = []
    for o, w in zip(order, wanted):
        rank = np.full(n, len(o), np.int64)
        rank[o] = np.arange(len(o))
        needed.append(rank[w])
    return min(int(np.quantile(np.concatenate(needed), RECALL, method="higher")) + 1, order.shape[1])


class Block:
    """The vectors of a block of a list, as they are and lifted; ``first`` is the smallest id of each."""

    def __init__(self, index: Index, x: np.ndarray, first: np.ndarray):
        self.x, self.first = x, first
        self.lifted = index.lift(x).astype(np.float32)

    def scan(self, index: Index, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, score) of the k best for each query, best first, ties by ``first``; none under the query's bound.

        The adaptive scan: partial distances grow by blocks of COLUMNS rotated dimensions, of all queries and vectors at once.
        After each, pairs go whose partial distance, scaled to all dimensions, is over the bound by more than chance
        allows; when few are left, only those go on.  What is left at the end is scored in double precision.
        """
        rotated = index.query(q)
        # the bound as a distance: |q|^2 + M^2 - 2 * inner product; floats of 32 bits are off by less than ``off``
        norm = (rotated**2).sum(1) + index.largest**2
        off = 1e-5 * norm.max()
        limit = np.maximum(norm - 2 * bound, 0) + off
        rq, D = rotated.astype(np.float32), rotated.shape[1]
        part, pairs = np.zeros((len(q), len(self.x)), np.float32), None
        for at in range(0, D, COLUMNS):
            a, b = rq[:, at : at + COLUMNS], self.lifted[:, at : at + COLUMNS]
            seen = min(at + COLUMNS, D)
            most = (limit * (seen / D * (1 + CONFIDENCE / np.sqrt(seen)) ** 2) if seen < D else limit).astype(np.float32)
            if pairs is None:
                part += distances(a, b)
                if seen == D:
                    break
                stay = part <= most[:, None]
                if stay.mean() < FEW:
                    pairs = np.nonzero(stay)
                    part = part[pairs]
                else:
                    part[~stay] = np.inf
            else:
                i, j = pairs
                for n in range(0, len(i), PAIRS):
                    diff = b[j[n : n + PAIRS]] - a[i[n : n + PAIRS]]
                    part[n : n + PAIRS] += np.einsum("ij,ij->i", diff, diff)
                stay = part <= most[i]
                pairs, part = (i[stay], j[stay]), part[stay]
        if pairs is None:
            if len(self.x) > k:  # the block's own k-th best is a bound too
                limit = np.minimum(limit, np.partition(part, k - 1, 1)[:, k - 1] + 2 * off)
            pairs = np.nonzero(part <= limit[:, None])
        i, j = pairs
        score = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", self.x[j[n : n + PAIRS]], q[i[n : n + PAIRS]]) for n in range(0, len(i), PAIRS))])
        enough = score >= bound[i]
        i, j, score = i[enough], j[enough], score[enough]
        order = np.lexsort((self.first[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        begin = np.searchsorted(i, i)
        top = np.arange(len(i)) - begin < k
        return i[top], j[top], score[top]


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def search(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, index: Index | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query, by largest inner product, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but those of the query's own id.  An id that
    is asked with two vectors has one list, in which the best of both take turns.  Vectors that are null, zero or hold null or non-finite components
    take no part, nor rows without an id, nor vectors of another length than most have.  An empty table gives an empty result.

    Equal vectors are one candidate that stands for its k + 1 smallest ids, and equal queries are asked once, so a very
    common vector is one entry of one list.  Lists are cut into blocks of ROWS vectors; a task reads blocks one after the other,
    each followed by the queries that probe its list, and holds one block and QUERIES queries at a time.  A query's bound
    is that of the sample's vectors in its lists at first, and tightened by each block that its task scans.  The index is fitted on SAMPLE vectors, but
    every vector is in it; a query whose lists hold too few vectors goes on to further ones.  Of different vectors with one
    score those with smaller ids come first, so ties are never cut at random.
    """
    spark = df.sparkSession
    raw = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = raw.where(fine)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    rows = Stage(rows.where(F.size("v") == common.n), "vectors").df()
    # the k + 1 smallest ids of a vector, by a partial top list of each task: no list of ids grows with a group
    distinct = staged(smallest(rows, k + 1), "distinct-vectors")
    stats = distinct.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))).alias("m")).first()
    if index is None:
        share = min(1.0, 1.3 * SAMPLE / stats.n)
        picked = distinct.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.xxhash64("v").alias("h"), "v").orderBy("h", "v").limit(SAMPLE).collect()
        index = fit(np.array([r.v for r in picked]), float(stats.m), stats.n, k)
    packed = spark.sparkContext.broadcast(index)  # SAMPLE bounds it

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = packed.value
        for b in batches:
            where = np.concatenate([np.zeros(0, np.int64), *(own.list_of(own.lift(matrix(b.column(1).slice(at, ROWS)))) for at in range(0, b.num_rows, ROWS))])
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), b.column(0), b.column(1)], names=["list", "ids", "v"])

    lists = staged(distinct.select("ids", "v").mapInArrow(assign, "list long, ids array<long>, v array<double>"), "lists")
    counted = lists.groupBy("list").count().collect()  # one row a list: at most CENTROIDS squared
    held = np.zeros(index.lists(), np.int64)
    for r in counted:
        held[r["list"]] = r["count"]
    sizes = spark.sparkContext.broadcast(held)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = packed.value, sizes.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                q = matrix(some.column(1))
                routes = own.route(q, n, k + 1)
                bound = own.bounds(q, routes, k + 1) - 1e-9
                went = [(i, x, c) for i, near in enumerate(routes) for x in near[n[near] > 0].tolist() for c in range(-(-int(n[x]) // ROWS))]
                who = pa.array([i for i, _, _ in went], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x for _, x, _ in went], pa.int64()), pa.array([c for _, _, c in went], pa.int32()), some.column(0).take(who), pa.array(bound).take(who), some.column(1).take(who)], names=["list", "block", "qid", "bound", "v"])

    blocks = F.broadcast(spark.createDataFrame([(r["list"], -(-r["count"] // ROWS)) for r in counted], "list long, blocks int"))
    blocked = lists.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    asked = Stage(rows.where(F.col("id") % every == 0).groupBy("v").agg(F.min("id").alias("qid")), "queries").df()
    routed = asked.select("qid", "v").mapInArrow(route, "list long, block int, qid long, bound double, v array<double>")
    both = blocked.select("list", "block", F.lit(None).cast("long").alias("qid"), F.lit(None).cast("double").alias("bound"), "ids", "v").union(routed.select("list", "block", "qid", "bound", F.lit(None).cast("array<long>"), "v"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tight = packed.value, {}
        schema = pa.schema([("qid", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])
        key, vectors, ids, block = None, [], [], None

        def ask(part: pa.RecordBatch) -> pa.RecordBatch:
            qids = part.column(2).to_pylist()
            bound = np.array([max(a, tight.get(x, a)) for x, a in zip(qids, part.column(3).to_pylist())])
            i, j, score = block.scan(own, matrix(part.column(5)), bound, k + 1)
            if len(tight) > 1 << 20:
                tight.clear()
            full = np.flatnonzero(np.bincount(i, minlength=len(qids)) > k)
            last = np.searchsorted(i, full, "right") - 1
            tight.update((qids[x], s) for x, s in zip(full.tolist(), score[last].tolist()))
            return pa.RecordBatch.from_arrays([part.column(2).take(pa.array(i)), pa.array(score), every_ids.take(pa.array(j))], schema=schema)

        for b in batches:
            lists_, blocks_ = b.column(0).to_numpy(), b.column(1).to_numpy()
            is_q = b.column(2).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(lists_) != 0) | (np.diff(blocks_) != 0) | (np.diff(is_q.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if lo == hi:
                    continue
                part, here = b.slice(lo, hi - lo), (lists_[lo], blocks_[lo])
                if here != key:
                    key, vectors, ids, block = here, [], [], None
                if not is_q[lo]:
                    vectors.append(matrix(part.column(5)))
                    ids.append(part.column(4))
                elif vectors:
                    if block is None:
                        every_ids = pa.concat_arrays(ids)
                        block = Block(own, np.concatenate(vectors), np.array([x[0] for x in every_ids.to_pylist()], np.int64))
                    for at in range(0, part.num_rows, QUERIES):
                        yield ask(part.slice(at, QUERIES))

    dealt = both.repartition(n_shuffle(spark), "list", "block").sortWithinPartitions("list", "block", F.col("qid").asc_nulls_first())
    found = dealt.mapInArrow(probe, "qid long, score double, ids array<long>")
    best = top(found, k + 1)
    each = staged(best, "found").join(asked, "qid").join(rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "v").distinct(), "v")
    each = each.select("query_id", F.posexplode("near").alias("at", "x")).where("x.vec_id != query_id")
    ranked = each.select("query_id", (F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
    return ranked.where(F.col("rank") <= k)


def smallest(rows: DataFrame, n: int) -> DataFrame:
    """(ids, v): each distinct vector with its n smallest ids. Lists are cut to n in each of two steps."""
    part = rows.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"), "id").count()
    w = Window.partitionBy("v", "salt").orderBy("id")
    cut = part.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return cut.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, n).alias("ids")).select("ids", "v")


def top(found: DataFrame, n: int) -> DataFrame:
    """(qid, near): the n best (score, vec_id) of each query, best first; ids of equal vectors spread out."""
    each = found.select("qid", "score", F.explode("ids").alias("vec_id"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))), lambda x: F.struct(x["vec_id"].alias("vec_id"), x["score"].alias("score"))).alias("near"))
