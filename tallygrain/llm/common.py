"""Helpers that the operators of this subpackage share: shared-folder tables, hashing, and blob coding."""

from __future__ import annotations

import gc
import struct
import uuid

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrain.session import shared_dir

#: Spark's xxhash64 uses this seed; functions that hash in Python use it too, so both sides agree.
SEED = 42


class Scratch:
    """Tables written to the shared folder, so that lineage ends there and a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str, frees: bool = False):
        """frees: after each table, let go of the shuffle files that led to it, where they are large against the input."""
        self.spark, self.frees = spark, frees
        self.root = shared_dir(spark, name)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        if self.frees:
            release(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_homes(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """``save`` of a table that is then joined again and again by ``key``: its rows stay where they were written, one file a task
        where a task's rows have one key, and only the other side of such a join moves."""
        table = f"{name}_{uuid.uuid4().hex}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.option("compression", "zstd").option("path", f"{self.root}/{name}").bucketBy(parts, key).saveAsTable(table)
        if self.frees:
            release(self.spark)
        return self.spark.table(table)

    def drop(self, name: str = "") -> None:
        """Delete a table once nothing will read it again."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what nothing refers to any more: it does when the driver's JVM collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; a null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def crc_mod(column: str, modulus: int):
    """crc32(column as text) mod modulus; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def pack(array: np.ndarray, level: int = 3) -> bytes:
    """Byte planes of an integer or float array, each compressed by itself: high bytes of small numbers cost nothing, and short
    arrays do not pay for what their planes differ in. Behind the count and how many planes are not zero, each one's number
    and length, then the planes."""
    array = np.ascontiguousarray(array)
    planes = array.view(np.uint8).reshape(len(array), array.itemsize).T
    some = [i for i in range(array.itemsize) if planes[i].any()]
    squeeze = zstandard.ZstdCompressor(level=level).compress
    blobs = [squeeze(np.ascontiguousarray(planes[i]).tobytes()) for i in some]
    return b"".join((struct.pack("<IB", len(array), len(some)), *(struct.pack("<BI", i, len(b)) for i, b in zip(some, blobs)), *blobs))


def unpack(blob: bytes, dtype) -> np.ndarray:
    """The array that ``pack`` coded."""
    n, some = struct.unpack_from("<IB", blob)
    planes = np.zeros((np.dtype(dtype).itemsize, n), np.uint8)
    expand, at = zstandard.ZstdDecompressor().decompress, 5 + 5 * some
    for k in range(some):
        i, size = struct.unpack_from("<BI", blob, 5 + 5 * k)
        planes[i] = np.frombuffer(expand(blob[at : at + size]), np.uint8)
        at += size
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def pack_sorted(array: np.ndarray, level: int = 3) -> bytes:
    """``pack`` of the differences of an ascending array."""
    return pack(np.diff(array, prepend=array.dtype.type(0)), level)


def unpack_sorted(blob: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(blob, dtype), dtype=dtype)


def partitions_for(total: float, each: float, least: int = 1) -> int:
    """How many parts of about ``each`` hold ``total``."""
    return max(least, int(-(-total // each)))
