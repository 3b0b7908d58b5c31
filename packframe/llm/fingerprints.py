"""Document fingerprints: bottom-k sketches of word shingles.

A sketch holds the ``k`` smallest distinct shingle hashes.  The sketch of a union
is the ``k`` smallest of the sketches' union, so sketches of parts merge.  A
word's hash is 30 bits of its md5; a shingle's is a fixed linear function of its
words' hashes modulo a prime near 2**59.  Such a hash is pairwise independent,
which bottom-k estimates need, costs one md5 a distinct word, and is plain
64-bit arithmetic in any SQL engine.

* distinct shingles: the size if the sketch holds under ``k`` hashes, else
  ``(k - 1) / u`` with ``u`` the k-th hash as a fraction of the hash range;
* resemblance: the share of the union's bottom-k that both sketches hold;
* containment of a in b: ``resemblance * |union| / |a|``, at most 1.

A word is a run without ASCII white space of the lower-cased text, and a text of
fewer than ``n`` words is one shingle.  Null, empty and blank texts have an empty
sketch, 0 distinct shingles, resemblance and containment 0.  Repeated rows give
repeated results; null ids stay null.  Only the named columns of the input are used.

A sketch of a whole corpus says next to nothing of one of its items in one
document, and a document's bottom-k little of a short item in it.  So
:func:`overlaps` compares each document with each item by all their shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packframe.llm.common import BROADCAST_BYTES, checkpoint, counted, owners, pieces, ref

N, K = 5, 128
WORD_RANGE, RANGE = (1 << 30) - 35, (1 << 59) - 55
#: Factors below 2**30: a sum of up to 7 products stays below 2**63.
FACTORS = (823640017, 1043150719, 664918541, 958105847, 720883139, 893720243, 777912461)


class _Hashes(dict):
    """md5 of each word met, computed once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = int(hashlib.md5(word, usedforsecurity=False).hexdigest()[:8], 16) % WORD_RANGE
        return value


def hash_shingles(texts: list[bytes], n: int, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, offsets by text)."""
    split = [t.split() for t in texts]
    count = np.array([len(w) for w in split], np.int64)
    offsets = np.append(0, np.cumsum(count))
    words = np.fromiter((known[w] for row in split for w in row), np.int64, int(offsets[-1]))
    doc = owners(offsets)
    left = offsets[1:][doc] - np.arange(len(words))
    total = np.zeros(len(words), np.int64)
    for k in range(n):
        has = np.flatnonzero(left > k)
        total[has] += words[has + k] * FACTORS[k]
    keep = (left >= n) | (np.arange(len(words)) == offsets[:-1][doc])
    return (total % RANGE)[keep], np.searchsorted(doc[keep], np.arange(len(offsets)))


def bottom_k(lowered: Column, n: int = N, k: int = K) -> Column:
    """The sketch of a lower-cased text: ascending hashes."""

    @F.arrow_udf("array<bigint>")
    def sketch_of(texts: pa.Array) -> pa.Array:
        out = []
        known = _Hashes()
        for start in range(0, len(texts), 512):
            part = texts.slice(start, 512).fill_null("").cast(pa.binary()).to_pylist()
            keys, offsets = hash_shingles(part, n, known)
            keys, _, offsets = counted(keys, offsets)
            size = np.minimum(np.diff(offsets), k)
            ends = np.append(0, np.cumsum(size))
            at = np.arange(ends[-1]) + np.repeat(offsets[:-1] - ends[:-1], size)
            out.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys[at])))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))

    return sketch_of(lowered)


def sketch(docs: DataFrame, by: list[str], text: str = "text", n: int = N, k: int = K) -> DataFrame:
    """(*by, sketch) of each row; no shuffle."""
    return docs.select(*by, bottom_k(F.lower(ref(docs, text).cast("string")), n, k).alias("sketch"))


def merge(sketches: DataFrame, by: list[str], k: int = K, column: str = "sketch") -> DataFrame:
    """(*by, sketch): the union of each group's sketches.

    Hashes are ranked within salted parts first, so that a hot group is merged by many tasks.
    """
    once = sketches.select(*by, F.explode(column).alias("h")).groupBy(*by, "h").agg(F.lit(1).alias("one")).drop("one")
    salted = once.withColumn("salt", F.pmod("h", F.lit(256)))
    part = salted.groupBy(*by, "salt").agg(F.slice(F.array_sort(F.collect_list("h")), 1, k).alias("part"))
    return part.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("part"))), 1, k).alias("sketch"))


def distinct_estimate(s: Column, k: int = K) -> Column:
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(F.lit(float(k - 1)) / (F.element_at(s, -1).cast("double") / F.lit(float(RANGE))))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(0.0)).otherwise(both / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Of a in b."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    share = resemblance(a, b, k) * distinct_estimate(union, k) / distinct_estimate(a, k)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), share))


def fingerprints(docs: DataFrame, against: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, k: int = K) -> DataFrame:
    """(doc_id, n_sketch, distinct_shingles, resemblance, containment, sketch) of each document.

    resemblance and containment compare the document with one corpus, the merged
    sketch of ``against`` (a sketch of k hashes whatever its size).
    """
    whole = merge(sketch(against.select(ref(against, text).alias("text")), [], "text", n, k).withColumn("all", F.lit(1)), ["all"], k)
    whole = whole.select(F.col("sketch").alias("whole"))
    empty = docs.sparkSession.range(1).select(F.array().cast("array<bigint>").alias("none"))
    whole = empty.join(whole, how="left").select(F.coalesce("whole", "none").alias("whole"))
    mine = sketch(docs.select(ref(docs, doc_id).alias("doc_id"), ref(docs, text).alias("text")), ["doc_id"], "text", n, k)
    out = mine.crossJoin(F.broadcast(whole))
    return out.select(
        "doc_id",
        F.size("sketch").alias("n_sketch"),
        F.round(distinct_estimate(F.col("sketch"), k), 3).alias("distinct_shingles"),
        F.round(resemblance(F.col("sketch"), F.col("whole"), k), 6).alias("resemblance"),
        F.round(containment(F.col("sketch"), F.col("whole"), k), 6).alias("containment"),
        F.array_join("sketch", ",").alias("sketch"),
    )


def shingle_rows(docs: DataFrame, doc_id: str, text: str, n: int, known: np.ndarray | None = None) -> DataFrame:
    """(row, id, size, shingles): each row's number, how many distinct shingles it has, and these, or those among ``known`` (ascending)."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, md5s, among = TaskContext.get().partitionId() << 40, _Hashes(), shared.value
        for batch in pieces(batches, "t"):
            if len(md5s) > 1 << 18:
                md5s.clear()
            keys, offsets = hash_shingles(batch.column("t").fill_null("").cast(pa.binary()).to_pylist(), n, md5s)
            keys, _, offsets = counted(keys, offsets)
            size = np.diff(offsets)
            if among is not None:
                hit = np.zeros(len(keys), bool) if not len(among) else among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys
                keys, offsets = keys[hit], np.append(0, np.cumsum(hit))[offsets]
            rows = pa.array(np.arange(row, row + len(size)))
            row += len(size)
            yield pa.RecordBatch.from_arrays([rows, batch.column("id"), pa.array(size), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys.astype(np.int64)))], names=["row", "id", "size", "shingles"])

    rows = docs.select(ref(docs, doc_id).alias("id"), F.lower(ref(docs, text).cast("string")).alias("t"))
    return rows.mapInArrow(run, f"row long, id {rows.schema['id'].dataType.simpleString()}, size long, shingles array<long>")


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", n: int = N, most: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, shared, doc_shingles, item_shingles, resemblance, doc_in_item, item_in_doc) of each document and item that share a shingle.

    Counts are of all distinct shingles, so the shares are exact.  The items' hashes
    thin the documents' out where they fit ``most`` bytes; beyond it all are joined.
    Each row is a document or an item of its own, also with a null or a repeated id.
    """
    listed = checkpoint(shingle_rows(items, item_id, text, n))
    theirs = listed.select(F.col("row").alias("item_row"), F.col("id").alias("item_id"), F.col("size").alias("item_shingles"), F.explode("shingles").alias("h"))
    hashes = checkpoint(theirs.select("h").distinct())
    known = np.sort(hashes.toPandas()["h"].to_numpy(np.int64)) if hashes.count() * 8 <= most else None
    mine = checkpoint(shingle_rows(docs, doc_id, text, n, known).filter(F.size("shingles") > 0))  # so that rows keep their numbers
    mine = mine.select("row", F.col("id").alias("doc_id"), F.col("size").alias("doc_shingles"), F.explode("shingles").alias("h"))
    pairs = mine.join(theirs, "h").groupBy("row", "item_row").agg(*[F.first(c).alias(c) for c in ("doc_id", "item_id", "doc_shingles", "item_shingles")], F.count(F.lit(1)).alias("shared"))
    share = lambda of: F.round(F.col("shared") / of, 6)
    return pairs.select(
        "doc_id",
        "item_id",
        "shared",
        "doc_shingles",
        "item_shingles",
        share(F.col("doc_shingles") + F.col("item_shingles") - F.col("shared")).alias("resemblance"),
        share(F.col("doc_shingles")).alias("doc_in_item"),
        share(F.col("item_shingles")).alias("item_in_doc"),
    )


_SHINGLE = " + ".join(f"coalesce(w[i + {j}] * {FACTORS[j]}, 0)" for j in range(N))
SQL = f"""
WITH t AS (
  SELECT doc_id, text, 0 AS side FROM documents UNION ALL SELECT item_id, text, 1 FROM benchmark),
w AS (
  SELECT doc_id, side, list_transform(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: x <> ''),
    lambda x: ('0x' || md5(x)[1:8])::BIGINT % {WORD_RANGE}) AS w FROM t),
s AS (
  SELECT doc_id, side, CASE WHEN len(w) > 0 THEN list_sort(list_distinct(list_transform(range(1, greatest(1, len(w) - {N - 1}) + 1),
    lambda i: ({_SHINGLE}) % {RANGE})))[1:{K}] ELSE [] END AS s FROM w),
b AS (SELECT coalesce(list_sort(list(DISTINCT h))[1:{K}], []) AS b FROM (SELECT unnest(s) AS h FROM s WHERE side = 1)),
u AS (SELECT doc_id, s, b, list_sort(list_distinct(list_concat(s, b)))[1:{K}] AS u, list_intersect(s, b) AS i FROM s, b WHERE side = 0),
e AS (SELECT *, CASE WHEN len(u) = 0 THEN 0.0 ELSE len(list_intersect(u, i)) / len(u)::DOUBLE END AS r,
  CASE WHEN len(s) < {K} THEN len(s)::DOUBLE ELSE {K - 1}::DOUBLE / (s[-1]::DOUBLE / {RANGE}::DOUBLE) END AS ds,
  CASE WHEN len(u) < {K} THEN len(u)::DOUBLE ELSE {K - 1}::DOUBLE / (u[-1]::DOUBLE / {RANGE}::DOUBLE) END AS du FROM u)
SELECT doc_id, len(s)::INT AS n_sketch, round(ds, 3) AS distinct_shingles, round(r, 6) AS resemblance,
  round(CASE WHEN len(s) = 0 THEN 0.0 ELSE least(1.0, r * du / ds) END, 6) AS containment, array_to_string(s, ',') AS sketch
FROM e
"""
