"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

#: Hexadecimal digits of the document's hash that one level of histograms looks at; 16 ** DIGITS buckets a source.
DIGITS = 3
#: Levels: 12 digits, 48 bits, of the hash decide in the end.
LEVELS = 4
#: No document is taken more often than this.
REPEATS = 3
#: Bytes of the plan, one row a source, up to which each executor gets it whole.
BROADCAST = 8 << 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size) to (source, source_size, target), both numbers in words.

    Sources in code-point order, null last, have the weights in turn, over and over.  They share the sum of all sizes
    by weight; a target stops at REPEATS times its source's size and what it can't take is shared by the others, by
    weight, until none is above.  In order of REPEATS * size / weight the sources that stop are a prefix: a source stops
    if even the level that holds with all before it stopped is at or over its own ratio.  One row a source: the only
    window over all rows of the operator, and it sees the names of sources, not documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    cycle = F.array(*[F.lit(w) for w in weights])
    w = sizes.withColumn("w", F.get(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))).cast("long")).withColumn("cap", F.col("source_size") * REPEATS)
    by_ratio = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = w.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    x = x.withColumn("open", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    x = x.withColumn("stops", F.col("cap") * F.col("open") <= F.col("left") * F.col("w"))
    # shared by those that don't stop: what is left, and the weights, at the first of them
    x = x.withColumn("rest", F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("w"), "left", "open"))).over(everything))
    share = F.col("w").cast("double") * F.col("rest.left").cast("double") / F.col("rest.open").cast("double")
    return x.select("source", "source_size", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: id, source, size, source_size, target, taken.

    Size is the number of words of the whole text (null: 0).  A source whose target is t times its size and more is
    taken floor(t) times as a whole; of what remains of the target, documents are taken once more in the order of
    MD5(id as text), as long as the running sum of their sizes, in hash order, stays within it.  So taken is a multiple
    of size, at most REPEATS times, and reruns agree.  The running sum is never sorted for: sizes are summed by source
    and the first DIGITS digits of the hash, the bucket in which the budget ends is found, and only that bucket is
    looked at again by the next digits, LEVELS times.  Documents that agree in all these digits (rows that repeat an
    id, or null ids, which hash as one) are taken together or not at all; a source short of its target by one such
    group, or one document, stays short.  Columns named in ``keep`` come along.

    Null sources are a source of their own.  Texts without words have size 0 and are taken 0 words.  An empty table gives
    an empty table.  A source may hold any share of the rows: all sums are partial before they are shuffled, and the
    joins are with one row a source.
    """
    one = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), n_words(F.col(f"`{text_col}`").cast("string")).alias("size"), *[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep])
    docs = staged(one.withColumn("h", F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), 1, DIGITS * LEVELS)), "mix-sizes")
    plan = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(REPEATS))).otherwise(0))
    plan = staged(plan.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    # cut: hashes below it are taken; spent: what they sum to
    cuts = plan.select("source", "budget", F.lit(0.0).alias("spent"), F.lit("").alias("cut"))
    for level in range(LEVELS):
        width = DIGITS * (level + 1)
        inside = docs.join(cuts.select(F.col("source").alias("s"), F.col("cut").alias("c")), F.col("source").eqNullSafe(F.col("s")) & F.startswith("h", "c"))
        sums = inside.groupBy("source", F.substring("h", 1, width).alias("b")).agg(F.sum("size").alias("n"))
        run = sums.withColumn("run", F.sum("n").over(Window.partitionBy("source").orderBy("b")))
        held = cuts.select(F.col("source").alias("s"), "budget", "spent")
        over = run.join(held, F.col("source").eqNullSafe(F.col("s"))).where(F.col("spent") + F.col("run") > F.col("budget"))
        over = over.groupBy("source", "budget").agg(F.min(F.struct("b", (F.col("spent") + F.col("run") - F.col("n")).alias("spent"))).alias("x"))
        cuts = staged(over.select("source", "budget", "x.spent", F.col("x.b").alias("cut")), f"mix-level{level}")
    done = plan.join(cuts.select(F.col("source").alias("s"), "cut"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    done = done.select(F.col("source").alias("s"), "source_size", "target", "whole", "cut")
    # documents stay where they are while the plan is small; beyond that adaptive execution splits a hot source
    sources = plan.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0)).alias("chars")).first()
    if sources.n * 64 + sources.chars <= BROADCAST:
        done = F.broadcast(done)
    # a source without a cut spends its whole budget: all its documents are within it
    more = F.when(F.col("cut").isNull() | (F.col("h") < F.col("cut")), 1).otherwise(0)
    taken = F.col("size") * F.least(F.col("whole") + more, F.lit(REPEATS))
    return docs.join(done, F.col("source").eqNullSafe(F.col("s"))).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.cast("long").alias("taken"), *[F.col(f"keep_{c}").alias(c) for c in keep])


#: The same rows in DuckDB: the running sum in hash order, by a window over all documents of a source.
ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                  substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 3 AS cap, 1 + (row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") - 1) % 3 AS w FROM s),
x AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS remaining, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS open
      FROM w WINDOW b AS (ORDER BY cap / w, source IS NULL, source COLLATE "binary" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, cap * open <= remaining * w AS stops FROM x),
z AS (SELECT *, (SELECT remaining FROM y WHERE NOT stops ORDER BY cap / w LIMIT 1) AS r, (SELECT open FROM y WHERE NOT stops ORDER BY cap / w LIMIT 1) AS o FROM y),
t AS (SELECT source, source_size, CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE CAST(w AS DOUBLE) * CAST(r AS DOUBLE) / CAST(o AS DOUBLE) END AS target FROM z),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole FROM t),
u AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * least(whole + CASE WHEN run <= budget THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken FROM u
"""
