"""Helpers shared by the training-data operators: shared tables, size-checked joins, word hashing."""

from __future__ import annotations

import ctypes
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most this many bytes; beyond it, both sides are shuffled.
BROADCAST_BYTES = 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one if all runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext.getCheckpointDir()
        if not kept and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = kept or tempfile.mkdtemp(prefix="brindle-checkpoint-")
        if not kept:
            spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later stages survive lost executors without recomputing it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that stored() wrote and nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, row_bytes: int) -> bool:
    """Whether df, of at most row_bytes a row, may be broadcast. Counts it, so pass a stored table."""
    return df.count() * row_bytes <= BROADCAST_BYTES


def maybe_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if small(df, row_bytes) else df.hint("merge")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = f"__{name}"
    while out in taken:
        out = f"_{out}"
    return out


def bounded(batch: pa.RecordBatch, rows: int = 4096, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A record batch in order, in halves of halves until a part has at most so many rows and bytes, or is one row."""
    if batch.num_rows > 1 and (batch.num_rows > rows or batch.nbytes > most):
        half = batch.num_rows // 2
        yield from bounded(batch.slice(0, half), rows, most)
        yield from bounded(batch.slice(half), rows, most)
    elif batch.num_rows:
        yield batch


@contextmanager
def short_batches(spark: SparkSession, most: int = 2 << 20) -> Iterator[None]:
    """What is written meanwhile goes to Python in Arrow batches that end after so many bytes, where no such bound is set.

    By rows alone, a batch is all that a task reads of wide rows, and the executor holds it in buffers of powers of two.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.unset(name)


def release() -> None:
    """Gives memory that is free in this process back to the system; it would stay with a worker that waits for its next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def released(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A mapInArrow function that calls release() at its task's end."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def by_rows(fn: Callable[[dict], Iterator[dict] | list], schema: pa.Schema, rows: int = 4096, most: int = 8 << 20) -> Callable:
    """A mapInArrow function: fn gets the columns of bounded() parts as lists and yields dicts of output columns."""

    def run(batches):
        for batch in batches:
            for part in bounded(batch, rows, most):
                for out in fn(part.to_pydict()):
                    yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word (bytes) to 64-bit hash, computed once for each word and forgotten when the table grows large."""

    def __init__(self, most: int = 2_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; bytes.lower and bytes.split have exactly these classes."""
    if text is None:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).lower().split()


_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the windows of `width` words; with fewer words, the whole sequence as one; without words, none."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < width:
        x = np.uint64(n)
        for h in hashes:
            x = mixed(np.array([x], np.uint64) * _K[0] + h)[0]
        return np.array([x], np.uint64)
    x = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        x = mixed(x * _K[0] + hashes[j : n - width + 1 + j])
    return np.unique(x)
