"""Near-duplicate documents by improved consistent weighted sampling (ICWS).

A document is a weighted set of word shingles: weight = times in the document x
inverse document frequency.  Two documents' ICWS samples agree with probability
equal to their weighted Jaccard similarity.  ``bands`` bands of ``rows`` samples
are hashed; documents that share a band are candidates, and the exact weighted
Jaccard similarity of candidates decides.  Groups are the connected components
of the pairs at or above ``threshold``; the least id of a group stays.

* Document frequency is counted over all documents in a fixed table of 2**22
  hashed counters, and ``idf = ln(1 + N / max(df, N * floor))``: the floor (1 in
  1000 documents) is far above what collisions add, so they barely matter, and
  what is broadcast (16 MB) never grows.
* The three random numbers of ICWS come from a table of 2**16 draws per sample,
  indexed by the shingle's hash, so that equal shingles draw alike everywhere.
* Exact copies are one candidate.  Each candidate is compared with the least id of
  each of its bands; what is alike is linked, and labels spread over the links
  (iteratively, as tables).  Of a band that still holds several labels the other
  pairs of different labels are compared too: one by one where the band is small,
  else block by block of ``BLOCK`` candidates, where blocks of one label are left out.
  So each pair that shares a band is compared, except pairs already known to be
  connected: there is no cap on partners, thousands of copies cost about one
  comparison a copy, and no task holds more than two blocks.

Documents without any word (null, empty, punctuation): null texts are never
grouped; equal texts without words are exact copies.  Rows with a null id are
not grouped and always stay.  Repeated rows of one id are one document: of its
texts the one with the greatest md5 counts, and the others are not compared.
Only the named columns are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from packframe.llm.common import checkpoint, counted, discard, fresh, joinable, mix, pieces, ref, release, relieve, shingles

SHINGLE, BANDS, ROWS, THRESHOLD, FLOOR = 3, 16, 3, 0.5, 1e-3
COUNTERS = 22
STAR, SMALL, BLOCK = 256, 8, 64  # candidates to one centre in a group; in a small band, less its centre; in a block
_DRAWS = 16


def draws(samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(multipliers, r, beta, ln c - r) for each sample."""
    rng = np.random.default_rng(7)
    shape = (samples, 1 << _DRAWS)
    r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
    return rng.integers(1, 1 << 63, samples, dtype=np.uint64) | np.uint64(1), r, rng.random(shape, dtype=np.float32), (np.log(rng.gamma(2.0, 1.0, shape)) - r).astype(np.float32)


def slot(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - COUNTERS)).astype(np.int64)


def document_frequency(docs: DataFrame, shingle: int) -> tuple[np.ndarray, int]:
    """(document frequency of each hashed counter, number of non-null documents)."""
    chunk = 1 << 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows = np.zeros(1 << COUNTERS, np.int32), 0
        for batch in pieces(batches, "t", 1 << 19):
            rows += batch.num_rows - batch.column("t").null_count
            keys, _, _ = counted(*shingles(batch.column("t"), shingle))
            np.add.at(table, slot(keys), np.int32(1))
        release()
        if rows:
            width = np.int32 if table.max() > 65535 else np.uint16 if table.max() > 255 else np.uint8
            parts = [table[i : i + chunk].astype(width).tobytes() for i in range(0, len(table), chunk)]
            yield pa.RecordBatch.from_arrays([pa.array([*range(len(parts)), -1], pa.int32()), pa.array([*parts, b""], pa.binary()), pa.array([0] * len(parts) + [rows], pa.int64())], names=["part", "counts", "n"])

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        part, sums = int(frame["part"].iloc[0]), np.zeros(chunk, np.int64)
        if part >= 0:
            for raw in frame["counts"]:
                sums += np.frombuffer(raw, {chunk: np.uint8, 2 * chunk: np.uint16, 4 * chunk: np.int32}[len(raw)])
        sums = sums.astype(np.int32) if sums.max() < 1 << 31 else sums
        return pd.DataFrame({"part": [part], "counts": [sums.tobytes() if part >= 0 else b""], "n": [int(frame["n"].sum())]})

    kind = "part int, counts binary, n long"
    got = docs.mapInArrow(count, kind).groupBy("part").applyInPandas(total, kind).collect()
    wide = any(len(row["counts"]) > 4 * chunk for row in got)
    table, rows = np.zeros(1 << COUNTERS, np.int64 if wide else np.int32), 0
    for row in got:
        if row["part"] < 0:
            rows = row["n"]
        else:
            table[row["part"] * chunk : (row["part"] + 1) * chunk] = np.frombuffer(row["counts"], np.int64 if len(row["counts"]) > 4 * chunk else np.int32)
    return table, rows


def inverse_frequency(table: np.ndarray, rows: int, floor: float) -> np.ndarray:
    return np.log1p(np.float32(max(rows, 1)) / np.maximum(table, np.float32(max(1.0, rows * floor)), dtype=np.float32)).astype(np.float32)


def weighted(texts: pa.Array, shingle: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, weights, offsets), each document's shingles distinct and ascending."""
    keys, counts, offsets = counted(*shingles(texts, shingle))
    return keys, counts.astype(np.float32) * idf[slot(keys)], offsets


def signatures(keys: np.ndarray, weights: np.ndarray, offsets: np.ndarray, samples: int, table: tuple) -> np.ndarray:
    """ICWS samples of each non-empty document: an array (documents, samples)."""
    multipliers, r_, beta_, shift_ = table
    docs = len(offsets) - 1
    out = np.zeros((docs, samples), np.uint64)
    logs = np.log(weights).astype(np.float32)
    start = 0
    while start < docs:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + (1 << 15), "right")) - 1)
        h, lw = keys[offsets[start] : offsets[end]], logs[offsets[start] : offsets[end]]
        at, size = offsets[start:end] - offsets[start], np.diff(offsets[start : end + 1])
        for k in range(samples):
            draw = ((h * multipliers[k]) >> np.uint64(64 - _DRAWS)).astype(np.int64)
            r = r_[k][draw]
            level = np.floor(lw / r + beta_[k][draw])
            a = shift_[k][draw] - r * (level - beta_[k][draw])
            least = np.repeat(np.minimum.reduceat(a, at), size)
            won = np.flatnonzero(a == least)
            first = np.searchsorted(won, at)  # of equal values the least shingle, as they ascend
            best = won[first]
            out[start:end, k] = mix(h[best] + (level[best].astype(np.int64).view(np.uint64) << np.uint64(32)))
        start = end
    return out


def band_hashes(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash a band, as int64 (documents, bands)."""
    out = np.zeros((len(samples), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(samples), b + 1, np.uint64)
        for k in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + samples[:, b * rows + k])
        out[:, b] = key
    return out.view(np.int64)


def sketches(docs: DataFrame, shared: Broadcast, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, same, bands) of each document with text; ``same`` is a 128-bit hash of the text; shared: the idf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = draws(bands * rows)
        for batch in pieces(batches, "t"):
            keys, weights, offsets = weighted(batch.column("t"), shingle, shared.value)
            filled = np.flatnonzero(np.diff(offsets))
            found = np.zeros((batch.num_rows, 0), np.int64)
            if len(filled):
                # documents without words hold no elements, so the offsets of the others stay contiguous
                found = band_hashes(signatures(keys, weights, np.append(offsets[filled], offsets[-1]), bands * rows, table), bands, rows)
            sizes = np.zeros(batch.num_rows + 1, np.int32)
            sizes[filled + 1] = bands
            column = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(found.reshape(-1) if len(filled) else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("same"), column], names=["id", "same", "bands"])
        del table
        release()

    return docs.select("id", F.md5("t0").alias("same"), "t").mapInArrow(run, T.StructType([docs.schema["id"], T.StructField("same", T.StringType()), T.StructField("bands", T.ArrayType(T.LongType()))]))


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, label): the least id connected to each id of the links (a, b)."""
    both = checkpoint(links.select(F.col("a").alias("a"), F.col("b").alias("b")).union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    held = checkpoint(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    for _ in range(most_rounds):
        labels = held.select("id", "label")
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        # the label of one's label: paths halve each round
        step = labels.join(near, labels["id"] == near["a"]).select("id", "label", F.least("label", "near").alias("to"))
        far = labels.select(F.col("id").alias("to_id"), F.col("label").alias("of_to"))
        new = checkpoint(step.join(far, step["to"] == far["to_id"], "left").select("id", F.col("label").alias("was"), F.least("to", F.coalesce("of_to", "to")).alias("label")))
        discard(held)
        held = new
        if new.filter(F.col("was") != F.col("label")).isEmpty():
            discard(both)
            return new.select("id", "label")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (ascending keys, weights)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][at] == a[0]
    least = np.minimum(a[1][hit], b[1][at[hit]]).sum(dtype=np.float64)
    whole = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - least
    return float(least / whole) if whole else 0.0


def across(held: list[tuple], threshold: float) -> list[tuple]:
    """(a, b) of the pairs of different labels that are alike, less those already connected; held: (id, label, set)."""
    parent: dict = {label: label for _, label, _ in held}

    def root(label):
        while parent[label] != label:
            parent[label] = label = parent[parent[label]]
        return label

    out = []
    for j, (b, of_b, theirs) in enumerate(held):
        for a, of_a, ours in held[:j]:
            if root(of_a) != root(of_b) and jaccard(ours, theirs) >= threshold:
                parent[root(of_b)] = root(of_a)
                out.append((a, b))
    return out


def alike(rows: DataFrame, heads: DataFrame, texts: DataFrame, shared: Broadcast, shingle: int, threshold: float) -> DataFrame:
    """(a, b): the links within the groups of rows (g, part, id, label).

    A group with a centre (part 0) compares it with each other row, a group
    without one compares all rows of different labels.  heads: (id, same) says which of
    an id's texts counts; texts: (id, same, t); shared: the idf.
    """
    wanted = joinable(checkpoint(rows.join(heads.select("id", "same"), "id")), 256)
    # Only these documents' texts move; all are shuffled only where the rows are too many to broadcast.
    full = texts.join(wanted, ["id", "same"]).select("g", "part", "id", "label", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last, centre, held, out = None, None, None, [], []
        for batch in pieces(batches, "t"):
            keys, weights, offsets = weighted(batch.column("t"), shingle, shared.value)
            columns = [batch.column(c).to_pylist() for c in ("g", "part", "id", "label")]
            for i, (g, part, doc, label) in enumerate(zip(*columns)):
                if g != group:
                    out += across(held, threshold)
                    group, last, centre, held = g, None, None, []
                if doc == last:
                    continue  # a repeated row
                last = doc
                own = keys[offsets[i] : offsets[i + 1]], weights[offsets[i] : offsets[i + 1]]
                if part == 0:
                    centre = doc, tuple(x.copy() for x in own)
                elif centre is None:
                    held.append((doc, label, tuple(x.copy() for x in own)))
                elif jaccard(centre[1], own) >= threshold:
                    out.append((centre[0], doc))
            yield links_of(out)
            out = []
        yield links_of(across(held, threshold))
        release()

    id_type = rows.schema["id"].dataType
    arrow = to_arrow_type(id_type)

    def links_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], arrow) for k in (0, 1)], names=["a", "b"])

    ordered = full.repartition("g").sortWithinPartitions("g", "part", "id")
    return ordered.mapInArrow(run, T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)]))


def stars(pairs: DataFrame) -> DataFrame:
    """Rows for :func:`alike` of pairs (a, b): a is the centre of groups of some STAR others each, so that none grows with the data."""
    size = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    salted = pairs.join(size, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / STAR)).alias("salt"))
    g = F.concat_ws("|", F.col("a").cast("string"), F.col("salt").cast("string")).alias("g")
    others = salted.select(g, F.lit(1).alias("part"), F.col("b").alias("id"), F.col("b").alias("label"))
    return others.union(salted.select("a", "salt").distinct().select(g, F.lit(0).alias("part"), F.col("a").alias("id"), F.col("a").alias("label")))


def blocks(rest: DataFrame) -> DataFrame:
    """Rows for :func:`alike` of large bands (band, id, label): a group is two blocks of a band, unless all of both have one label."""
    sizes = rest.groupBy("band", "label").agg(F.count(F.lit(1)).alias("c"))
    loose = sizes.filter(F.col("c") < BLOCK).groupBy("band").agg(F.sum("c").alias("loose"))
    wide = F.col("c") >= BLOCK
    hashed = lambda c, n: F.pmod(F.xxhash64(c), F.ceil(n / BLOCK)).cast("string")
    own = F.concat_ws("|", F.lit("of"), F.col("label").cast("string"), hashed("id", F.col("c")))
    block = F.when(wide, own).otherwise(F.concat_ws("|", F.lit("some"), hashed("label", F.col("loose"))))
    placed = checkpoint(rest.join(sizes, ["band", "label"]).join(loose, "band", "left").select("band", "id", "label", block.alias("block"), F.when(wide, F.col("label")).alias("pure")))
    each = placed.select("band", "block", "pure").distinct()
    x, y = (each.select("band", F.col("block").alias(f"block_{k}"), F.col("pure").alias(f"pure_{k}")) for k in "xy")
    two = x.join(y, "band").filter((F.col("block_x") <= F.col("block_y")) & ~F.coalesce(F.col("pure_x") == F.col("pure_y"), F.lit(False)))
    two = two.select("band", F.concat_ws("||", F.col("band").cast("string"), "block_x", "block_y").alias("g"), F.explode(F.array_distinct(F.array("block_x", "block_y"))).alias("block"))
    return placed.join(two, ["band", "block"]).select("g", F.lit(1).alias("part"), "id", "label")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, floor: float = FLOOR) -> DataFrame:
    """(doc_id, group_id, group_size, n_links, keep) of each document with an id: the group's least id stays.

    n_links: with how many other texts the document's text was linked; pairs that are
    connected already are not compared, so it counts what was found, not all that is alike.
    """
    relieve(docs.sparkSession)
    table = docs.select(ref(docs, doc_id).alias("id"), ref(docs, text).cast("string").alias("t0")).filter("id IS NOT NULL")
    table = table.withColumn("t", F.lower("t0"))
    counts, n = document_frequency(table.select("t"), shingle)
    idf = docs.sparkSession.sparkContext.broadcast(inverse_frequency(counts, n, floor))
    del counts
    release()
    made = checkpoint(sketches(table.filter("t0 IS NOT NULL"), idf, shingle, bands, rows))
    # Repeated rows of an id: one row. Exact copies: the least id stands for them. Equal texts have equal bands.
    one = checkpoint(made.groupBy("id").agg(F.max(F.struct("same", "bands")).alias("x")).select("id", "x.same", "x.bands"))
    same = one.select("id", "same")
    heads = checkpoint(one.groupBy("same").agg(F.min("id").alias("id"), F.first("bands").alias("bands")))
    in_band = heads.select("id", F.explode("bands").alias("band"))
    shared = in_band.groupBy("band").agg(F.min("id").alias("a"), (F.count(F.lit(1)) - 1).alias("others")).filter("others > 0")
    members = checkpoint(in_band.join(shared, "band").filter(F.col("id") != F.col("a")))  # (band, id, a, others)
    texts = table.filter("t0 IS NOT NULL").select("id", F.md5("t0").alias("same"), "t")
    compare = lambda rows: alike(rows, heads, texts, idf, shingle, threshold)
    pairs = checkpoint(members.select("a", F.col("id").alias("b")).distinct())
    links = checkpoint(compare(stars(pairs)))
    labels = components(links)
    # What is left: bands whose members, less the one that all were compared with, have several labels.
    several = members.filter("others > 1").join(labels, "id", "left").select("band", "id", "others", F.coalesce("label", "id").alias("label"))
    mixed = several.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("band")
    rest = checkpoint(several.join(mixed, "band"))
    few, many = rest.filter(F.col("others") <= SMALL), rest.filter(F.col("others") > SMALL)
    x, y = (few.select("band", F.col("id").alias(i), F.col("label").alias(f"label_{i}")) for i in "ab")
    others = x.join(y, "band").filter("a < b AND label_a <> label_b").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    more = checkpoint(compare(stars(others).union(blocks(many))))
    if not more.isEmpty():
        labels = components(links.union(more))
    grouped = labels.select("id", F.col("label").alias("head"))
    # Every document: by its text to the head of its copies, by that to its group.
    joined = same.join(heads.select("same", F.col("id").alias("first")), "same").join(grouped.select(F.col("id").alias("first"), "head"), "first", "left")
    every = links.union(more)
    degree = every.select("a").union(every.select("b")).groupBy(F.col("a").alias("first")).agg(F.count(F.lit(1)).alias("n_links"))
    placed = joined.join(degree, "first", "left").select("id", F.coalesce("head", "first").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    empty = table.filter("t0 IS NULL").select("id").distinct().join(placed.select("id"), "id", "left_anti").select("id", F.col("id").alias("group_id"), F.lit(0).cast("bigint").alias("n_links"))
    placed = checkpoint(placed.union(empty))
    discard(made, one, heads, members, pairs, links, rest, more)
    sizes = placed.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    return placed.join(sizes, "group_id").select(F.col("id").alias("doc_id"), "group_id", "group_size", "n_links", (F.col("id") == F.col("group_id")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents less those whose group has a lesser id, every column as it was."""
    (name,) = fresh(docs, "_gone")
    gone = joinable(checkpoint(near_dedup(docs, doc_id, text, **settings).filter("NOT keep").select(F.col("doc_id").alias(name))), 16)
    return docs.join(gone, ref(docs, doc_id) == F.col(name), "left_anti")
