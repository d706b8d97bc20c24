"""Helpers shared by the operators: scratch tables, text batches, splits and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch of texts holds at most (a longer text is a batch of its own); they bound a
#: Python worker's memory.
BATCH_ROWS, BATCH_BYTES = 400, 2 << 20
#: Bytes of text that are worked on at once where a text can be cut, so that a long one needs no more memory.
BLOCK_BYTES = 1 << 18
WHITE = r"[\x20\x09-\x0D]+"
NON_WHITE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all run here."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = held.get() if held.isDefined() else f"file://{tempfile.mkdtemp(prefix='flowlens-')}"
        if not held.isDefined():
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


class _Collecting(threading.local):
    def __init__(self):
        self.held: list[list[str]] = []


_collecting = _Collecting()


@contextlib.contextmanager
def collecting() -> Iterator[list[str]]:
    """The scratch paths that are given out meanwhile in this thread."""
    _collecting.held.append([])
    try:
        yield _collecting.held[-1]
    finally:
        _collecting.held.pop()


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for held in _collecting.held:
        held.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table into the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(column):
    return F.translate(column, UPPER, LOWER)


def remainder(doc_id, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def _release() -> None:
    """Give freed memory back: workers are kept between tasks, and each holds what it once needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems' C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches small enough for long texts.

    Spark takes the two limits from the session when the plan is made, so they stay set on it.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        _release()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(tidy, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end, and the n + 1 offsets; null counts as empty. No copy unless sliced or null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def blocks(body: np.ndarray, at: np.ndarray, cut: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray]]:
    """Texts i to j - 1 and their offsets, `most` bytes or so at a time; a longer text comes alone and in parts.

    A part ends after a byte that the table `cut` marks, however far that is; its offsets lie inside the text.
    """
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        if at[i + 1] - at[i] <= most:
            yield i, j, at[i : j + 1]
        else:
            j, a = i + 1, int(at[i])
            while a < at[j]:
                b = min(a + most, int(at[j]))
                while b < at[j] and not cut[body[b - 1]]:
                    near = np.flatnonzero(cut[body[b : b + most]])
                    b = b + int(near[0]) + 1 if len(near) else min(b + most, int(at[j]))
                yield i, j, np.array([a, b])
                a = b
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer with full avalanche (the published splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, as far as they were needed; the first KEPT stay."""

    KEPT = 1 << 20

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) >= n:
            return self.up, self.down
        size = 1 << max(16, (n - 1).bit_length())
        up, down = np.full(size, self.base, np.uint64), np.full(size, self.inverse, np.uint64)
        for x in (up, down):
            x[0] = 1
            np.cumprod(x, dtype=np.uint64, out=x)
        if size <= self.KEPT:
            self.up, self.down = up, down
        return up, down


POWERS = Powers()
_SALTS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def running_hash(body: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] = the polynomial of bytes i..j-1, times base**i (modulo 2**64)."""
    up, _ = POWERS.upto(len(body) + 1)
    out = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(_SALTS[body] * up[: len(body)], out=out[1:])
    return out


def span_hash(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each span of bytes; it depends on the bytes alone, not on where they lie."""
    _, down = POWERS.upto(len(running))
    return mix((running[end] - running[start]) * down[start] + (end - start).astype(np.uint64))


_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def fold(body: np.ndarray) -> np.ndarray:
    """A-Z to lower case."""
    return _FOLD[body]


def words(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each white-space-free word, and for each text the index of its first word (n + 1 values)."""
    inside = ~_IS_WHITE[body]
    first = np.zeros(len(body) + 1, bool)
    first[offsets] = True
    before = np.empty(len(body), bool)
    before[1:] = inside[:-1]
    before[:1] = False
    start = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(body), bool)
    after[:-1] = inside[1:]
    after[-1:] = False
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of (a, b) links of long ids: one row (node, component) per node that has a link.

    component is the smallest id that can be reached. Rounds of minimum labels with pointer jumping; each
    round's labels are a table in the shared folder, so no executor's loss repeats more than a round, and the
    driver sees two numbers a round only. Joins read tables directly, so that AQE can split a hot node.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).toDF("src", "dst").where("src <> dst").distinct(), name)
    parent = stored(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("component")), name)
    last = None
    while True:
        heard = both.join(parent.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "component")
        jumped = parent.join(parent.select(F.col("node").alias("component"), F.col("component").alias("__up")), "component", "left")
        jumped = jumped.select("node", F.coalesce("__up", "component").alias("component"))
        parent = stored(heard.union(jumped).groupBy("node").agg(F.min("component").alias("component")), name)
        now = parent.agg(F.sum(F.col("component").cast("decimal(38,0)")), F.count("*")).first()
        if now == last:
            return parent
        last = now
