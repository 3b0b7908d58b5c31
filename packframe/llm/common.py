"""What several operators share: checkpoints, checked broadcasts, byte-level tokens.

The byte-level tokenizer reads Arrow's own buffers, so a batch of documents is
tokenised by a handful of numpy passes instead of a Python loop per word.
A *word* is a run of lower-case ASCII letters, digits and non-ASCII bytes; all
other ASCII characters separate words.  Callers lower-case the text in the JVM.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same word rule as a regular expression (Java and RE2).
NOT_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"

#: Bytes that may be broadcast to every executor; beyond it, operators join by shuffle.
BROADCAST_BYTES = 64 << 20

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    A temporary folder stands in only where the session names none, and only in
    local mode, where all tasks see it.
    """
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="packframe-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder and read it again.

    The table outlives any executor, is compressed, and goes when the session ends,
    or before with :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/packframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = _place(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.packframe_path = path
    return out


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def discard(*frames: DataFrame) -> None:
    """Delete checkpointed tables that nothing will read again."""
    for df in frames:
        fs, where = _place(df.sparkSession, df.packframe_path)
        fs.delete(where, True)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a checkpointed table fits the broadcast limit, by its row count."""
    return df.count() * row_bytes <= limit


def joinable(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a checkpointed table for broadcast if its size allows, else leave it to a shuffle join."""
    return F.broadcast(df) if small(df, row_bytes, limit) else df


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, applied elementwise."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.cumprod(np.full(4096, _ODD, dtype=np.uint64))
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(128, 256)]] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of the documents' words) of a lower-cased string column."""
    raw, offsets = buffers(column)
    docs = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    inside = _WORD[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    first[begins] = inside[begins]  # a document never continues its predecessor's word
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    at = np.flatnonzero(inside)
    heads = np.flatnonzero(first[at])
    lengths = np.diff(np.append(heads, len(at)))
    place = np.arange(len(at)) - np.repeat(heads, lengths)
    if lengths.max() > len(_POWER):
        place %= len(_POWER)
    hashed = np.add.reduceat(_BYTE[raw[at]] * _POWER[place], heads)
    hashed = mix(hashed + lengths.astype(np.uint64))
    return hashed, np.searchsorted(starts, offsets)


def hash_words(terms: list[str]) -> np.ndarray:
    """The hashes :func:`words` gives these words."""
    got, offsets = words(pa.array(terms, pa.string()))
    if not np.array_equal(np.diff(offsets), np.ones(len(terms))):
        raise ValueError("each term must be one word")
    return got


def owners(offsets: np.ndarray) -> np.ndarray:
    """The document number of each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each n-word shingle, offsets by document); a shorter document is one shingle."""
    hashed, offsets = words(column)
    count = np.diff(offsets)
    if not len(hashed):
        return hashed, offsets
    with np.errstate(over="ignore"):
        key = hashed.copy()
        doc = owners(offsets)
        left = np.repeat(offsets[1:], count) - np.arange(len(hashed))  # words from here to the document's end
        for k in range(1, n):
            more = left > k
            key = key * _ODD
            key[more] += hashed[np.flatnonzero(more) + k]
        keep = (left >= n) | ((np.repeat(count, count) < n) & (np.arange(len(hashed)) == np.repeat(offsets[:-1], count)))
        key = mix(key[keep])
    doc = doc[keep]
    return key, np.searchsorted(doc, np.arange(len(count) + 1))


def counted(keys: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each document in ascending order: (keys, counts, offsets)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), offsets
    doc = owners(offsets)
    order = np.argsort(keys, kind="stable")
    order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return keys[at], np.diff(np.append(at, len(keys))), np.searchsorted(doc[at], np.arange(len(offsets)))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece has about ``most`` bytes of text, to bound a worker's memory.

    A longer document is a piece of its own, whole.  The numpy passes over a piece take
    some 40 bytes a byte of text.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def release() -> None:
    """Give freed memory back to the system: a Python worker outlives its task, and what it keeps is its executor's loss."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def relieve(spark: SparkSession) -> None:
    """Have the executors collect their garbage, and so shrink their heaps: each operator begins as if it ran alone.

    A heap that one operator has grown is else kept, beside the Python workers of the next.
    There are as many tasks as cores, which the scheduler deals out to the executors in turn.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


class Tally:
    """Sums by key, in one or several columns; merged whenever what is pending outgrows half of what is merged."""

    def __init__(self, least: int = 1 << 20):
        self.least, self.pending, self.merged = least, 0, 0
        self.keys: list[np.ndarray] = []
        self.sums: list[np.ndarray] = []

    def add(self, keys: np.ndarray, sums: np.ndarray) -> None:
        self.keys.append(keys)
        self.sums.append(sums)
        self.pending += len(keys)
        if self.pending > max(self.least, self.merged // 2):
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray] | None:
        """(distinct keys in ascending order, sums), None if nothing was added."""
        if len(self.keys) > 1 or self.pending:
            keys, sums = np.concatenate(self.keys), np.concatenate(self.sums)
            order = np.argsort(keys, kind="stable")
            keys, sums = keys[order], sums[order]
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            self.keys, self.sums = [keys[at]], [np.add.reduceat(sums, at, axis=0) if len(at) else sums]
            self.pending, self.merged = 0, len(at)
        return (self.keys[0], self.sums[0]) if self.keys else None


def varint(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whole numbers as bytes, seven bits each, the lowest first; where each number begins, and the end)."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(7, 64, 7):
        more = values >= np.uint64(1 << k)
        if not more.any():
            break
        size += more
    begin = np.append(0, np.cumsum(size))
    out = np.zeros(int(begin[-1]), np.uint8)
    for k in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > k)
        out[begin[at] + k] = ((values[at] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[at] > k + 1, 128, 0).astype(np.uint8)
    return out, begin


def unvarint(data: np.ndarray) -> np.ndarray:
    """What :func:`varint` was given, of its bytes."""
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(data < 128)
    begin = np.append(0, ends[:-1] + 1)
    out = (data[begin] & 127).astype(np.int64)
    size = ends - begin
    for k in range(1, int(size.max()) + 1):
        at = np.flatnonzero(size >= k)
        out[at] |= (data[begin[at] + k] & 127).astype(np.int64) << (7 * k)
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that the frame doesn't hold, whatever its case."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def ref(df: DataFrame, name: str):
    """A column by its exact name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]
