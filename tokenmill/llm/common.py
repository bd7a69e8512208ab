"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.session import shared_dir

PIECE_BYTES = 1 << 18  # text that numpy handles at once
HELD_BITS = 26  # log2 of the bits of the map in may_hold


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: no later step repeats or loses it. It goes when the session's driver ends.

    Spark deletes the shuffle files of a plan that nobody holds any more, but only after its driver's next garbage collection, which may be long
    after they have piled up; so there is one here.
    """
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    gc.collect()
    df.sparkSession.sparkContext._jvm.java.lang.System.gc()
    hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def may_hold(rows: DataFrame, value: Column, keys: DataFrame, key: Column, out: str = "maybe") -> DataFrame:
    """`rows` with a flag: false only where no `key` equals `value` (64-bit hashes).

    The map of 2^HELD_BITS bits (8 MB) is broadcast whatever the number of keys is; rows without the flag need no shuffle to learn that they have no partner.
    """
    bit = F.shiftrightunsigned(key, 64 - HELD_BITS) + 1  # Spark counts buckets, and the values in them, from 1
    maps = keys.groupBy(F.bitmap_bucket_number(bit).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("__map"))
    own = F.shiftrightunsigned(value, 64 - HELD_BITS) + 1
    at = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring("__map", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    flag = F.coalesce(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1, F.lit(False))
    return rows.withColumn("__bucket", F.bitmap_bucket_number(own)).join(F.broadcast(maps), "__bucket", "left").withColumn(out, flag).drop("__bucket", "__map")


def released(run: Callable) -> Callable:
    """A function for mapInArrow that hands memory back at its end; Spark uses Python workers again, and they would keep their peak."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, nulls as empty, and the offsets of its rows (one more than rows)."""
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    array = pc.fill_null(array, "")
    width = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, width, len(array) + 1, array.offset * np.dtype(width).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, rows)
        first = min(last, rows)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the number of values in each row."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over all bits, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _FACTOR)


class Words:
    """Words of UTF-8 texts, as runs of the wanted bytes, each as a 64-bit hash of its bytes with A-Z in lower case."""

    def __init__(self, wanted: np.ndarray):
        self.wanted = wanted
        fold = np.arange(256)
        fold[65:91] += 32
        self.value = _BYTE[fold]
        self.power = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of all rows in order, and the number of words of each row."""
        rows = len(offsets) - 1
        mask = self.wanted[data]
        at = np.flatnonzero(mask)
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
        first = mask.copy()
        first[1:] &= ~mask[:-1]
        edge = offsets[:-1][offsets[:-1] < len(data)]
        first[edge] = mask[edge]
        starts = np.flatnonzero(first[at])
        lengths = np.diff(starts, append=len(at))
        if lengths.max() > len(self.power):
            self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(lengths.max()), _FACTOR)]))
        place = np.arange(len(at)) - np.repeat(starts, lengths)
        hashes = mixed(np.add.reduceat(self.value[data[at]] * self.power[place], starts))
        begin = at[starts]
        return hashes, np.diff(np.searchsorted(begin, offsets))
