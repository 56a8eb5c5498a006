"""Sizing and shared-folder helpers of the operators in this subpackage."""

from __future__ import annotations

import ctypes
import math
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size of the plan: file sizes for tables, no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets(df: DataFrame, each: int = 128 << 20) -> int:
    """Hash buckets for an exchange of packed rows: grows with the input so that one bucket stays small."""
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return max(shuffle, math.ceil(size / each) if size < 1 << 60 else 0)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir; a local one only on a local master that names none, as in tests."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
    return f"{root.rstrip('/')}/tessera-{uuid.uuid4().hex}"


#: Shuffle files go once the query that made them has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors.

    The shuffles behind df are removed, as nothing needs them from then on.
    """
    spark = df.sparkSession
    path, was = shared_dir(spark), spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def discard(*settled: DataFrame) -> None:
    """Removes what settle() wrote, once no frame that is still to run reads it."""
    for df in settled:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._settled)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one byte string, for rows that carry many small values through an exchange."""
    head = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        head += [a.dtype.str.encode().ljust(8), np.array([len(a)], np.int64).tobytes()]
    return b"".join(head + [np.ascontiguousarray(a).tobytes() for a in arrays])


def unpack(data) -> list[np.ndarray]:
    data = memoryview(data)
    k = int(np.frombuffer(data[:8], np.int64)[0])
    out, at = [], 8 + 16 * k
    for i in range(k):
        h = data[8 + 16 * i : 24 + 16 * i]
        dtype, n = np.dtype(bytes(h[:8]).decode().strip()), int(np.frombuffer(h[8:], np.int64)[0])
        out.append(np.frombuffer(data[at : at + n * dtype.itemsize], dtype))
        at += n * dtype.itemsize
    return out


def squeeze(data: bytes) -> bytes:
    """Packed arrays, compressed for an exchange or a table that is large."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueeze(data) -> list[np.ndarray]:
    data = memoryview(data)
    return unpack(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd"))


def small(a: np.ndarray) -> np.ndarray:
    """Non-negative whole numbers in the narrowest type that holds them."""
    most = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket, and where each of n buckets starts in it."""
    order = np.argsort(bucket.astype(np.uint16 if n < 1 << 16 else np.uint32), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=n))])


def at_most(counts: DataFrame, key: str, n: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys (long, sorted as unsigned) with the largest counts, most of them at most, and their counts.

    A histogram of bounded length finds the least count that fits, so ties there are all left out.
    """
    level = F.when(F.col(n) < 4096, F.col(n)).otherwise((4096 + 64 * (F.log2(n) - 12)).cast("long"))
    hist = counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).toPandas().sort_values("level", ascending=False)
    fit = hist.level[hist.rows.cumsum() <= most]
    if not len(fit):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = counts.where(level >= int(fit.min())).select(key, n).toArrow()
    k = top[key].to_numpy().view(np.uint64)
    order = np.argsort(k)
    return k[order], top[n].to_numpy()[order]


_LIBC = ctypes.CDLL(None)
#: Arrays from this size on are memory of their own, which goes back as soon as they are freed (mallopt's M_MMAP_THRESHOLD is -3).
APART = 1 << 20
#: Groups of so many bytes are taken before a worker gives back what it has freed.
EVERY = 16 << 20


def give_back() -> None:
    """What this Python has freed goes back to the system; a worker would keep it for its next task, beside its executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def _set_apart() -> None:
    if hasattr(_LIBC, "mallopt"):
        _LIBC.mallopt(-3, APART)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, from a worker that holds on to no memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _set_apart()
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def lean_group(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """f for applyInArrow, likewise."""
    taken = EVERY

    def run(table: pa.Table) -> pa.Table:
        nonlocal taken
        _set_apart()
        out = f(table)
        taken += table.nbytes
        if taken >= EVERY:
            taken = 0
            give_back()
        return out

    return run
