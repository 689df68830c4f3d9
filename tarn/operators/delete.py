"""Row deletes: positions in files, ends of inlined rows."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog.store import new_uuid
from ..plans.scan import FILE, POSITION, ROW, ScanResult, to_df
from ..sources.footers import row_count
from ..sources.storage import Files, plain

if TYPE_CHECKING:
    from ..transaction import TransactionTable


@contextmanager
def kept(table: TransactionTable, df: DataFrame) -> Iterator[tuple[DataFrame, int]]:
    """The rows of ``df`` as a written table, so that its conditions are evaluated once, and their number; gone at the end."""
    spark, files = df.sparkSession, Files(df.sparkSession)
    folder = f"{table.tx.catalog.path_of(table.t)}tarn-{new_uuid()}-hits"
    df.write.option("compression", "zstd").parquet(folder)
    paths = [f.path for f in files.list(folder) if f.path.endswith(".parquet")]
    try:
        yield spark.read.schema(df.schema).parquet(folder), sum(counts(files, paths))
    finally:
        files.delete(folder)


def counts(files: Files, paths: list[str]) -> list[int]:
    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(lambda p: row_count(files, p), paths))


def delete_rows(table: TransactionTable, result: ScanResult, where: str, alias: str | None = None) -> None:
    """Mark the rows for which ``where`` is true as deleted; nothing is rewritten. Files that statistics rule out aren't read."""
    hit = to_df(table.tx.lake, result, where, hidden=True, alias=alias).select(ROW, FILE, POSITION)
    with kept(table, hit) as (rows, n):
        mark(table, result, rows, n)


def mark(table: TransactionTable, result: ScanResult, hits: DataFrame, n: int) -> None:
    """Delete the ``n`` rows that ``hits`` (ROW, FILE, POSITION) names; each is alive in ``result``.

    Up to the inlining limit positions go into the catalog.  More are written as one delete file for each data file, which takes the
    place of that file's earlier ones and so holds their positions too.
    """
    lake, spark = table.tx.lake, table.tx.lake.spark
    limit = table.options()["data_inlining_row_limit"] if lake.inlines else 0
    if not n:
        return
    d, files = table.tx.of(table.id), Files(spark)
    d.removed += n
    by_key = {files.key(f.path): f for f in result.files}
    if n <= limit:
        few = hits.select(ROW, FILE, POSITION).collect()
        d.ended_inlined += [r[ROW] for r in few if r[ROW] is not None]
        d.deleted += [(by_key[r[FILE]].id, r[POSITION]) for r in few if r[FILE] is not None]
        d.kinds.append("inlined_delete")
        return
    # inlined rows are in the catalog, so those that are hit are few enough to be listed here
    d.ended_inlined += [r[ROW] for r in hits.where(F.col(ROW).isNotNull()).select(ROW).collect()]
    folder = f"{table.tx.catalog.path_of(table.t)}tarn-{new_uuid()}-deletes"
    gone = hits.where(F.col(FILE).isNotNull()).select(F.col(FILE).alias("file_path"), F.col(POSITION).alias("pos"))
    dirty = [f for f in result.files if f.deleted()]
    if dirty:
        # what was deleted before is alive no more, so it meets no hit; but it may be both inlined and in a file of old
        before = spark.createDataFrame([(files.key(f.path), p) for f in dirty for p in f.deleted_rows], "file_path string, pos long")
        old = [x.path for f in dirty for x in f.deletes]
        if old:
            before = before.union(spark.read.schema("file_path string, pos long").parquet(*old)).distinct()
        gone = gone.union(before.join(gone.select("file_path").distinct(), "file_path", "left_semi"))
    numbers = spark.createDataFrame([(k, f.id) for k, f in by_key.items()] or [("", -1)], "file_path string, f long")
    gone = gone.join(numbers, "file_path")
    gone.repartition("f").sortWithinPartitions("f", "pos").withColumn("part", F.col("f")).drop("f").write.partitionBy("part").parquet(folder)
    found = [f for f in files.list(folder) if f.path.endswith(".parquet")]
    for f, rows in zip(found, counts(files, [f.path for f in found])):  # one a data file, whose rows were brought together
        d.delete_files.append((int(plain(f.path).split("/part=")[1].split("/")[0]), f.path, rows, f.size))
    d.kinds.append("deleted_from_table")
