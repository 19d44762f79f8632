"""What the training-data operators share: scratch tables, samples, text kernels."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset a temporary
    folder is made and set if Spark runs in one process, as in tests; a cluster has to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="evenkeel-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: its lineage ends here. ``path``: where, if not at a new one."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """While it lasts, the session has this value of a setting."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


#: Bytes that Python workers get at a time.
BATCH_BYTES = 4 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session hands rows to Python workers in batches of ``BATCH_BYTES`` at most from now on.

    Spark's own limit makes each of them, and the JVM for each, hold ten times as much of the texts.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return df


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker, which lives on for other tasks, gives the memory that it freed back to the system."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def shuffles_removed(spark: SparkSession) -> contextlib.AbstractContextManager:
    """While it lasts, a job's shuffle files go when it ends; jobs that write tables need them no more."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, ASCII_UPPER, ASCII_UPPER.lower())


def crc_mod(column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id does not."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def hashed_share(rows: int, wanted: int, *columns: str) -> Column:
    """Keeps about ``wanted`` of ``rows`` rows, chosen by a hash of ``columns``."""
    if rows <= wanted:
        return F.lit(True)
    cut = int(wanted / rows * (1 << 53))
    return F.shiftrightunsigned(F.xxhash64(F.lit("sample"), *columns), 11) < cut


_C1, _C2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + _GOLD
        x = (x ^ (x >> np.uint64(30))) * _C1
        x = (x ^ (x >> np.uint64(27))) * _C2
        return x ^ (x >> np.uint64(31))


def byte_ngrams(data: bytes, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Indices below 2**bits of all byte n-grams of the given sizes (8 at most), repeats included."""
    code = np.frombuffer(data, np.uint8).astype(np.uint64)
    packed, n, out = code, 1, []
    for size in sizes:
        if len(code) < size:
            break
        while n < size:
            packed = (packed[:-1] << np.uint64(8)) | code[n:]
            n += 1
        # multiplicative hashing; another odd factor for each size
        out.append((packed * np.uint64(0x9E3779B97F4A7C15 + 2 * size) >> np.uint64(64 - bits)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


SEGMENT = 1 << 20


def segments(data: bytes, size: int = SEGMENT, overlap: int = 0):
    """Cut long texts so that arrays over them stay small; neighbours share ``overlap`` bytes."""
    if len(data) <= size:
        yield data
        return
    for i in range(0, len(data), size):
        yield data[i : i + size + overlap]


def portions(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Slices of whole texts with about ``size`` bytes each."""
    upto, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right")))
        yield texts.slice(at, end - at)
        at = end


_SPACE = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    """Cut between words, into pieces of about ``size`` bytes."""
    at = 0
    while len(data) - at > size:
        cut = max(data.rfind(s, at, at + size) for s in _SPACE)
        if cut <= at:
            after = [k for k in (data.find(s, at + size) for s in _SPACE) if k >= 0]
            if not after:
                break
            cut = min(after)
        yield data[at:cut]
        at = cut
    yield data[at:]
