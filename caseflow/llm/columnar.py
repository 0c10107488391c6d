"""Vectorised text primitives over Arrow string buffers: words, span hashes, sliding windows.

Every operator of this package that must look at each word of a corpus works on the UTF-8 bytes of a
bounded slice of an Arrow batch, so that memory depends on the slice (or on the longest single text)
and never on the partition.
"""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are looked at in one go.
CHUNK_BYTES = 2 << 20

_WHITE = (0x20, *range(0x09, 0x0E))


def byte_table(*word_ranges: tuple[int, int]) -> np.ndarray:
    """256 booleans: True for the bytes of a word."""
    table = np.zeros(256, bool)
    for low, high in word_ranges:
        table[low : high + 1] = True
    return table


#: Words of anything but ASCII white space.
NON_SPACE = np.ones(256, bool)
NON_SPACE[list(_WHITE)] = False
#: Words of digits, a-z and whatever is not ASCII (after lower-casing).
ALNUM = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C1B)  # 3 modulo 8: powers of it differ early in their low bits
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(which: int, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        step = np.full(max(n, 1 << 16), (_BASE, _INVERSE)[which], np.uint64)
        step[0] = 1
        _powers[which] = np.cumprod(step)
    return _powers[which][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


_VALUES = mix(np.arange(1, 2 * 256 + 1, dtype=np.uint64) * _BASE).reshape(2, 256) | np.uint64(1)


def extend(fields: list[T.StructField], ddl: str) -> T.StructType:
    """Fields followed by those of a DDL string."""
    return T.StructType([*fields, *T.StructType.fromDDL(ddl).fields])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; where that is unset (tests), in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Removes a job's shuffle files once the job has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Folders that written() made within scratch(), by its name; the name that counts now.
_scratch: dict[str, list[str]] = {}
_current: list[str] = []


@contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """What is run inside sends its rows to Python in Arrow batches of so many bytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet to the shared folder and read again: later steps neither repeat the plan nor need its shuffle files."""
    spark = df.sparkSession
    path, before = shared_folder(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    if _current:
        _scratch[_current[-1]].append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*frames: DataFrame) -> None:
    """Deletes what written() wrote for these frames; nothing that is still to be computed may read them."""
    for df in frames:
        path = _folders.pop(df, None)
        if path:
            _delete(df.sparkSession, path)


@contextmanager
def scratch(docs: DataFrame, name: str) -> Iterator[None]:
    """What written() writes inside belongs to this name, and what belonged to it before is deleted, unless docs still reads it.

    For a chain of steps of which each has stored its result, the next one's docs, before the next begins; one chain of a name at a time.
    """
    before = _scratch.pop(name, [])
    read = docs.inputFiles() if before else []
    for path in before:
        if not any(path.rsplit("/", 1)[-1] in f for f in read):
            _delete(docs.sparkSession, path)
    _scratch[name] = []
    _current.append(name)
    try:
        yield
    finally:
        _current.pop()


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be none of the columns (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def column(batch: pa.RecordBatch | pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null is empty."""
    arr = batch.column(name)
    arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, name: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most `limit` bytes of text, or one row: (slice, bytes, offsets)."""
    data, offsets = column(batch, name)
    i, n = 0, batch.num_rows
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and the index of each text's first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    cuts = offsets[1:-1]
    before[cuts[cuts < n]] = False
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def running(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """Running sums that hash_of() takes, for many hashes of the same bytes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[seed][data] * _power(0, len(data)), out=total[1:])
    return total


def hash_of(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """span_hash() from running sums."""
    return mix((total[ends] - total[starts]) * _power(1, len(total))[starts])


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand. seed: 0 or 1, independent."""
    return hash_of(running(data, seed), starts, ends)


def window_hash(tokens: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of every k consecutive tokens (64-bit numbers), by the index of the first."""
    if len(tokens) < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * _power(0, len(tokens)), out=total[1:])
    return mix((total[k:] - total[:-k]) * _power(1, len(tokens) + 1)[: len(tokens) - k + 1] + np.uint64(k))


def distinct(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(each text's distinct hashes in ascending order; offsets by text) of hashes and their texts, n texts in all."""
    by = np.argsort(h)
    by = by[np.argsort(text[by].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
    h, text = h[by], text[by]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[keep], np.searchsorted(text[keep], np.arange(n + 1))


def parities(h: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """(text, bits / 64): by bit, whether an odd number of the text's hashes falls on it; bits is a power of two.

    A bit in which two sets differ stands for one element at least that only one of them has: the number of such bits
    never exceeds the size of the sets' symmetric difference.
    """
    out = np.zeros((len(offsets) - 1, bits // 64), np.uint64)
    bit = mix(h * _M2) >> np.uint64(64 - (bits - 1).bit_length())
    text = np.repeat(np.arange(len(out)), np.diff(offsets))
    np.bitwise_xor.at(out.reshape(-1), text * out.shape[1] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def least_overlap(nx: Column, ny: Column, num: int, den: int) -> Column:
    """Smallest overlap of two sets of these sizes with Jaccard similarity num / den."""
    return F.ceil((nx + ny) * num / (num + den) - 1e-9)


def may_link(num: int, den: int, bits: int) -> Column:
    """What holds for all sets ax, ay (structs of the size n and parities q0, q1, ...) of this similarity: sizes, and parities."""
    nx, ny = F.col("ax.n"), F.col("ay.n")
    apart = sum((F.bit_count(F.col(f"ax.q{i}").bitwiseXOR(F.col(f"ay.q{i}"))) for i in range(bits // 64)), F.lit(0))
    return (nx * den >= ny * num) & (ny * den >= nx * num) & (apart <= nx + ny - 2 * least_overlap(nx, ny, num, den))


def owner(first: np.ndarray) -> np.ndarray:
    """The text of each word, from words()' third result."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def starts_of(first: np.ndarray, k: int) -> np.ndarray:
    """Boolean by word: a window of k words of the same text starts here."""
    end = np.repeat(first[1:], np.diff(first))
    return np.arange(first[0], first[-1]) + k <= end


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Boolean by position: covered by a window of this length from one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0
