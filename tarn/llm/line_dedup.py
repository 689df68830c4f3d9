"""Line dedup with overlapping three-line windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged


def bind(value: Column, f) -> Column:
    """f(value) with value computed once: inside a nested lambda an expression is evaluated for each element."""
    return F.transform(F.array(value), f)[0]


def window_keys(text: Column, width: int) -> Column:
    """(place, key) of each run of ``width`` lines that has a word in it; the key is 128 bits."""

    def key(lines, i):
        block = F.array_join(F.slice(lines, i + 1, F.lit(width)), "\n")
        return bind(block, lambda b: F.when(F.rlike(b, F.lit(r"[^\x20\x09-\x0D]")), F.unhex(F.md5(b.cast("binary")))))

    def keys(lines):
        each = F.transform(F.sequence(F.lit(0), F.size(lines) - width), lambda i: F.struct(i.alias("pos"), key(lines, i).alias("w")))
        return F.when(F.size(lines) >= width, F.filter(each, lambda x: x["w"].isNotNull()))

    return bind(F.split(text, "\n", -1), keys)


def without(text: Column, starts: Column, width: int) -> Column:
    """The lines that no run of ``width`` lines from one of ``starts`` (sorted, distinct) covers, joined again."""

    def rest(x):
        def piece(i):
            begin = F.when(i == 0, F.lit(0)).otherwise(F.get(x["s"], i - 1) + width)
            end = F.when(i == F.size(x["s"]), F.size(x["l"])).otherwise(F.get(x["s"], i))
            return F.slice(x["l"], begin + 1, F.greatest(end - begin, F.lit(0)))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["s"])), piece))

    return bind(F.struct(F.split(text, "\n", -1).alias("l"), starts.alias("s")), rest)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: id, text with repeated passages removed, n_lines, n_removed, n_windows.

    Lines are what ``\\n`` separates.  Every run of ``width`` consecutive lines of a document is a window; windows are
    hashed (MD5 of the lines joined by ``\\n``, 128 bits).  The first occurrence of a window in the order (id, place)
    stays; all lines that any later occurrence covers are removed, overlapping occurrences merged.

    Windows without a word never count.  Documents of fewer lines than ``width`` have no window and are unchanged.
    A null text gives a null text, no lines and no windows.  Null ids come first in the order; rows that repeat an id
    are told apart by a row number that Spark assigns when the input is staged, so of equal rows one stays, the first by
    that number.  A document may become empty; it is kept with an empty text.  An empty table gives an empty table.
    Columns named in ``keep`` come along.

    Shuffles: (window, row, place) moves, and text once in the last join.  The count of each window is summed before
    its shuffle; the join back is a sort-merge join whose hot windows adaptive execution splits.
    """
    named = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep])
    docs = staged(named.withColumn("k", F.monotonically_increasing_id()), "lines-in")
    found = docs.select(F.struct("id", "k").alias("doc"), F.explode(window_keys(F.col("text"), width)).alias("x")).select("x.w", F.struct("doc.id", "doc.k", "x.pos").alias("at"))
    windows = staged(found, "lines-windows")
    repeated = windows.groupBy("w").agg(F.count("*").alias("n"), F.min("at").alias("first")).where("n > 1").select("w", "first")
    later = windows.join(repeated, "w").where(F.col("at") > F.col("first")).select("at.k", "at.pos")
    covered = later.groupBy("k").agg(F.array_sort(F.collect_set("pos")).alias("starts"))
    joined = docs.join(covered, "k", "left")
    kept = F.when(F.col("starts").isNotNull(), without(F.col("text"), F.col("starts"), width))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    out = joined.select("id", "text", kept.alias("kept"), n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("starts"), F.lit(0)).cast("long").alias("n_windows"), *[f"`keep_{c}`" for c in keep])
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(F.array_join("kept", "\n"), "text").alias(text_col),
        "n_lines",
        F.when(F.col("kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"),
        "n_windows",
        *[F.col(f"`keep_{c}`").alias(c) for c in keep],
    )


#: The same rows in DuckDB, which compares the lines themselves.
ORACLE = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, i, array_to_string(lines[i:i+2], chr(10)) AS w FROM d, unnest(generate_series(1, len(lines) - 2)) AS u(i)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM w WHERE regexp_matches(w, '[^\x20\x09-\x0D]')),
c AS (SELECT doc_id, list(i) AS starts FROM r WHERE n > 1 GROUP BY doc_id),
l AS (SELECT d.doc_id, j, lines[j] AS line, EXISTS (SELECT 1 FROM r WHERE r.n > 1 AND r.doc_id = d.doc_id AND j BETWEEN r.i AND r.i + 2) AS gone
      FROM d, unnest(generate_series(1, len(lines))) AS u(j)),
k AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY j) FILTER (NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed FROM l GROUP BY doc_id)
SELECT d.doc_id, k.text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, CAST(coalesce(len(c.starts), 0) AS BIGINT) AS n_windows
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
"""
