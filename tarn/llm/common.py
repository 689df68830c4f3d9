"""What the operators of this subpackage share: staged tables and packed shuffles."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import sys
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark regular expression of one word; ``bytes.split()`` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """A fresh folder for this session below ``spark.checkpoint.dir``; removed when the driver ends.

    Executors and the driver all see it.  Only where the setting is absent (local tests) is a temporary folder used.
    """
    key = spark.sparkContext.applicationId
    if key not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            got = spark.sparkContext._jsc.sc().getCheckpointDir()
            base = got.get() if got.isDefined() else None
        if base is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tarn-")
        _roots[key] = f"{base.rstrip('/')}/tarn-{uuid.uuid4().hex}"
        atexit.register(remove, spark, _roots[key])
    return _roots[key]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system; at exit the JVM may be gone already."""
    try:
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception as e:  # noqa: BLE001 - the gateway closes before atexit in some shells
        if "Py4J" not in type(e).__name__ and not isinstance(e, (ConnectionError, AttributeError, TypeError)):
            raise


class Stage:
    """A table written to the shared folder: cuts lineage, survives lost executors."""

    def __init__(self, df: DataFrame, name: str, release: bool = False, by: str | None = None):
        """release: give back the disk that the shuffles behind the table took, which are not needed any more.

        by: a column by which the table is partitioned; conditions on it read only what they ask for.
        """
        self.spark = df.sparkSession
        self.path = f"{shared_root(self.spark)}/{name}-{uuid.uuid4().hex[:12]}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(self.path)
        self.schema = df.schema
        del df
        _staged.append(self)
        if release:
            tidy(self.spark)

    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Only once everything that reads it has been staged itself."""
        remove(self.spark, self.path)
        if self in _staged:
            _staged.remove(self)


#: Buckets that Spark allows by default.
MOST_BUCKETS = 100_000


class Buckets(Stage):
    """A staged table that is dealt by a column: joins on it leave its rows where they are, and shuffle only the other side."""

    def __init__(self, df: DataFrame, name: str, column: str):
        self.spark, self.table = df.sparkSession, f"tarn_{uuid.uuid4().hex}"
        self.path = f"{shared_root(self.spark)}/{name}-{self.table}"
        # buckets follow the input, so the rows of one don't grow with it
        n = max(n_shuffle(self.spark), 4 * df._jdf.queryExecution().toRdd().getNumPartitions())
        writer = df.write.format("parquet").option("path", self.path).option("compression", "zstd")
        writer.bucketBy(min(n, MOST_BUCKETS), column).sortBy(column).saveAsTable(self.table)
        _staged.append(self)

    def df(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        super().drop()


def staged(df: DataFrame, name: str) -> DataFrame:
    return Stage(df, name).df()


#: Tables that are staged and not dropped yet, in the order in which they were written.
_staged: list[Stage] = []


def settle(make: Callable[[], DataFrame], name: str, *gone: Stage) -> Stage:
    """The result of ``make`` as a table, after which all that was staged for it is dropped, and ``gone`` too."""
    before = set(map(id, _staged))
    out = Stage(make(), name)
    for x in [*(x for x in _staged if id(x) not in before and x is not out), *gone]:
        x.drop()
    return out


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of stages whose results are staged.

    The first collection frees what Python held, and only then does the second find the shuffles unused.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1)


def give_back() -> None:
    """Return freed memory to the system: workers live on, and their allocators keep what large arrays took."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_buckets(spark: SparkSession) -> int:
    """Key ranges of a packed shuffle: several a partition, so that partitions come out even; their number follows that of the
    partitions, which follows the input."""
    n = n_shuffle(spark)
    return max(64, 1 << ((6 if n <= 341 else 2) * n - 1).bit_length())


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of 64-bit keys: a range of the top bits."""
    return (keys >> np.uint64(64 - (buckets - 1).bit_length())).astype(np.int64)


def grouped(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple[int, list[tuple]]]:
    """The rows (*more, chunk, blob) of each bucket, one bucket at a time, of batches that deal() sorted."""
    key, held = None, []
    for b in batches:
        for k, *row in zip(*(b.column(n).to_pylist() for n in ("bucket", *more, "chunk", "blob"))):
            if k != key:
                if held:
                    yield key, held
                key, held = k, []
            held.append(tuple(row))
    if held:
        yield key, held


# -- packed arrays ---------------------------------------------------------------------------


def pack(*arrays: np.ndarray, level: int = 1, spread: bool = False) -> bytes:
    """Arrays as one compressed blob; unpack() needs their types.

    spread: all first bytes of an array's values come first, then all second ones, and so on; small numbers take less so.
    """
    head = np.array([len(a) for a in arrays], dtype=np.int64).tobytes()
    raw = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T if spread else np.ascontiguousarray(a) for a in arrays)
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(x.tobytes() for x in raw))


def unpack(blob: bytes, *types: str, spread: bool = False) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * len(types), []
    for n, t in zip(np.frombuffer(raw, np.int64, len(types)).tolist(), types, strict=True):
        size = np.dtype(t).itemsize
        if spread:
            out.append(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(t).ravel())
        else:
            out.append(np.frombuffer(raw, t, n, at))
        at += n * size
    return out


PACKED = "bucket int, chunk long, blob binary"


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each bucket in *sorted* 64-bit keys; a bucket is a range of the key's top bits."""
    shift = np.uint64(64 - (buckets - 1).bit_length())
    edges = np.arange(1, buckets, dtype=np.uint64) << shift
    cut = np.searchsorted(keys, edges)
    return np.concatenate([[0], cut]).astype(np.int64), np.concatenate([cut, [len(keys)]]).astype(np.int64)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(","))])


def batches_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)


def map_rows(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], ddl: str, flush_bytes: int = 16 << 20) -> DataFrame:
    """mapInArrow for a generator of tuples, sent on in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows, held = arrow_schema(ddl), [], 0
        for row in f(batches):
            rows.append(row)
            held += sum(len(x) for x in row if isinstance(x, (bytes, str))) + 64
            if held >= flush_bytes or len(rows) >= 8192:
                yield batches_of(rows, schema)
                rows, held = [], 0
        if rows:
            yield batches_of(rows, schema)

    return df.mapInArrow(run, ddl)


def deal(df: DataFrame) -> DataFrame:
    """Bring the blobs of a bucket into one partition, one bucket after the other."""
    return df.repartition(n_shuffle(df.sparkSession), "bucket").sortWithinPartitions("bucket")


def answers(df: DataFrame, name: str = "answers") -> DataFrame:
    """(chunk, bucket, blob) rows to one row for each chunk: a list of (bucket, blob), at most one a bucket."""
    return df.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "blob")).alias(name))


def text_bytes(array: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x if x is not None else b"" for x in array.cast(pa.binary()).to_pylist()]


SPACE = re.compile(rb"[ \t-\r]")
#: Bytes of a text whose words are split at a time, about.
SLICE = 1 << 22


def slices_of(text: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes that end at white space."""
    at = 0
    while at < len(text):
        m = SPACE.search(text, at + size)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def docs_of(df: DataFrame, id_col: str, *cols: tuple[str, str]) -> DataFrame:
    """The columns that an operator needs, under its own names."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *[F.col(f"`{c}`").alias(n) for c, n in cols])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(id_col: str, m: int):
    """crc32 of the id as decimal text, modulo m; a null id is in no fold (null)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(m))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
