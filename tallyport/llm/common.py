"""Shared pieces: stage tables in the shared folder, folds, word rules, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine (tests) may lack the setting; it then gets a temporary folder.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyport-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here.

    The tables stay until :func:`discard` or until the folder's own clean-up.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallyport-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyport_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that :func:`store` returned."""
    path = getattr(df, "_tallyport_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release(df: DataFrame) -> int:
    """Delete the stage tables that back an operator's result, once it has been written or is no longer wanted; returns
    how many there were. ``df`` can't be run again after that. Tables that aren't stage tables stay."""
    spark = df.sparkSession
    folder = shared_folder(spark).split("://")[-1].removeprefix("file:").rstrip("/") + "/tallyport-"
    found = {f[: f.index("/", f.index(folder) + len(folder))] for f in df.inputFiles() if folder in f}
    for path in found:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(found)


def fold(column: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``, by alternating large and small stars.

    Each round rewrites the edge table with two equi-joins on pre-aggregated minima, so neither the
    driver nor one task ever holds a component. Rounds end when the edge set stays the same.
    Self-loops and repeated edges do no harm; an empty table gives an empty result.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = store(e, "cc")
    mark = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark or now[0] == 0:
            break
        mark = now
        near = e.union(e.select("v", "u")).groupBy("u").agg(F.min("v").alias("m"))
        near = near.select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = e.join(near, "v").where(F.col("u") != F.col("m")).select("u", F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = store(rest.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        discard(e)
        e = after
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def handing_back(run):
    """``run`` (batches -> batches) that gives the memory it no longer needs back when its task ends.

    Python workers outlive their tasks, and what their allocators keep counts against the executor.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not this C library
                pass

    return wrapped


class Index:
    """Places of distinct 64-bit keys, by open addressing in a table an eighth full; lookups are vectorised."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        self.bits = max(4, int(8 * len(keys)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(self.keys)
        while len(left):
            free = np.flatnonzero(self.table[slot] < 0)
            self.table[slot[free]] = left[free]  # of several for one place, one stays
            missed = self.table[slot] != left
            left, slot = left[missed], (slot[missed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key (uint64) among the index's keys, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        slot = self._slot(keys)
        found = self.table[slot]
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        slot = slot[wrong]
        while len(wrong):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found[wrong] = self.table[slot]
            again = (found[wrong] >= 0) & (self.keys[found[wrong]] != keys[wrong])
            wrong, slot = wrong[again], slot[again]
        return found
