"""LM scoring by prediction by partial matching (PPM) over bytes.

A byte-context trie of depth ``order`` holds how often each byte followed each
context.  A byte is coded in the longest known context; where the context has
not seen it, an escape (method C: the number of distinct followers) is coded
and the next shorter context is tried, *excluding* the symbols the longer
context could have coded.  Below order 0 the remaining bytes are equally likely.

Two modes:

* ``pretrained`` (:func:`train`, :func:`score`): the trie holds the counts of the
  whole corpus.  Since every suffix of a context has at least the context's
  followers, the excluded set at each level is exactly the longer context's
  followers, hence each edge's code length is a constant of the trie.  These
  are computed once; scoring a byte is one hash lookup, in numpy, and only
  bytes without a deepest edge walk down the orders.
* ``adaptive`` (:func:`adaptive_bits`): a trie per document that learns as it
  codes.

Every edge of the corpus is kept, unless a caller sets ``min_rate``: an edge of
under that share of all bytes is then left out.  A trie of up to ``held`` edges
is broadcast.  A larger one stays tables, by edge and by context: of it, only
the most frequent deepest edges, at most ``held``, are broadcast, and a byte
without one of these is looked up by a join of its gram.  Both give the same
code lengths, so ``held`` is a matter of memory alone.

Null text: null code length.  Empty text: 0 bits, 0 bits a byte.  Null ids and
repeated rows are scored like any row.  An empty training corpus gives 8 bits a byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packframe.llm.common import Tally, buffers, checkpoint, mix, pieces, ref, release

ORDER, MIN_RATE, MOST_ORDER = 4, 0.0, 6
#: Edges that may be broadcast, some 100 bytes each in a worker.
HELD = 1 << 18


def grams(raw: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte, the key of its ``order`` predecessors and itself; a document begins after zero bytes."""
    key = raw.astype(np.uint64)
    before = raw
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order + 1):
        shifted = np.zeros(len(raw), np.uint64)
        shifted[k:] = before[:-k] if len(raw) > k else 0
        shifted[place < k] = 0
        key |= shifted << np.uint64(8 * k)
    return key


def gram_counts(docs: DataFrame, text: str = "text", order: int = ORDER) -> DataFrame:
    """(gram, n) over all documents: each task counts what it reads, then sums are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Tally()
        for batch in pieces(batches, "t"):
            raw, offsets = buffers(batch.column("t"))
            if len(raw):
                key = grams(raw, offsets, order)
                key.sort()
                at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                held.add(key[at], np.diff(np.append(at, len(key))))
        if found := held.fold():
            keys, counts = found
            for i in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 18)].view(np.int64)), pa.array(counts[i : i + (1 << 18)], pa.int64())], names=["gram", "n"])
            del found, keys, counts
        del held
        release()

    part = docs.select(ref(docs, text).cast("string").alias("t")).mapInArrow(count, "gram long, n long")
    return part.groupBy("gram").agg(F.sum("n").alias("n"))


class Edges:
    """An open-addressing table from deepest edges to their bits."""

    def __init__(self, edges: np.ndarray, bits: np.ndarray):
        self.log = max(4, int(math.ceil(math.log2(max(1, len(edges)) * 2.5))))
        size = 1 << self.log
        self.slot_key = np.full(size, np.iinfo(np.uint64).max, np.uint64)
        self.slot_bits = np.zeros(size, np.float32)
        left = np.arange(len(edges))
        slot = (mix(edges) >> np.uint64(64 - self.log)).astype(np.int64)
        while len(left):
            free = self.slot_key[slot[left]] == np.iinfo(np.uint64).max
            took, first = np.unique(slot[left[free]], return_index=True)
            who = left[free][first]
            self.slot_key[took], self.slot_bits[took] = edges[who], bits[who]
            done = np.zeros(len(edges), bool)
            done[who] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) % size

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits of each key, the places of those that the table doesn't hold)."""
        out = np.empty(len(key), np.float32)
        size = len(self.slot_key)
        slot = (mix(key) >> np.uint64(64 - self.log)).astype(np.int64)
        held = self.slot_key[slot]
        out[:] = self.slot_bits[slot]
        rest = np.flatnonzero(held != key)
        missing = [np.zeros(0, np.int64)]
        slots = slot[rest]
        held = held[rest]
        while len(rest):
            empty = held == np.iinfo(np.uint64).max
            missing.append(rest[empty])
            rest, slots = rest[~empty], (slots[~empty] + 1) % size
            held = self.slot_key[slots]
            hit = held == key[rest]
            out[rest[hit]] = self.slot_bits[slots[hit]]
            rest, slots, held = rest[~hit], slots[~hit], held[~hit]
        return out, np.concatenate(missing)


class Trie:
    """Code lengths of a trie in memory; see the module's docstring."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels: the kept edges (gram, n) of each order from 0."""
        self.order = len(levels) - 1
        order = self.order
        full = [(keys.astype(np.uint64), n.astype(np.float64)) for keys, n in levels]
        # A context's nodes: total and number of followers; sorted by context.
        nodes = []
        for keys, n in full:
            sort = np.argsort(keys)
            keys, n = keys[sort], n[sort]
            context = keys >> np.uint64(8)
            at = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.zeros(0, np.int64)
            nodes.append({"edge": keys, "n": n, "context": context[at], "total": np.add.reduceat(n, at) if len(at) else n, "kinds": np.diff(np.append(at, len(keys))).astype(float)})
        # left[k]: what an escape from a node of order k leaves at its parent: the sum and number of symbols not excluded.
        for k, node in enumerate(nodes):
            if k == 0:
                node["left"], node["left_kinds"] = np.full(len(node["context"]), 256.0) - node["kinds"], np.zeros(len(node["context"]))
            else:
                parent = nodes[k - 1]
                mask = np.uint64((1 << (8 * k)) - 1)
                edge_in_parent = np.searchsorted(parent["edge"], node["edge"] & mask)
                at = np.flatnonzero(np.append(True, (node["edge"][1:] >> np.uint64(8)) != (node["edge"][:-1] >> np.uint64(8)))) if len(node["edge"]) else np.zeros(0, np.int64)
                excluded = np.add.reduceat(parent["n"][edge_in_parent], at) if len(at) else np.zeros(0)
                up = np.searchsorted(parent["context"], node["context"] & np.uint64((1 << (8 * (k - 1))) - 1 if k > 1 else 0))
                node["left"] = parent["total"][up] - excluded
                node["left_kinds"] = parent["kinds"][up] - node["kinds"]
        self.nodes = nodes
        top = nodes[order]
        owner = np.searchsorted(top["context"], top["edge"] >> np.uint64(8))
        self.bits = np.log2((top["total"][owner] + top["kinds"][owner]) / top["n"]).astype(np.float32) if len(owner) else np.zeros(0, np.float32)
        self.edges = Edges(top["edge"], self.bits)

    def code_lengths(self, key: np.ndarray) -> np.ndarray:
        """Bits of each byte, from the keys of :func:`grams`."""
        out, at = self.edges.find(key)
        if len(at):
            kinds, back = np.unique(key[at], return_inverse=True)
            out[at] = self._walk(kinds)[back]
        return out

    def _walk(self, key: np.ndarray) -> np.ndarray:
        """Bits by descending the orders, with escapes and exclusion."""
        bits = np.zeros(len(key))
        open_ = np.ones(len(key), bool)
        came = np.full(len(key), -1)  # the node of the order above that was escaped from, or -1
        for k in range(self.order, -1, -1):
            node = self.nodes[k]
            above = self.nodes[k + 1] if k < self.order else None
            if not len(node["edge"]):
                continue
            mine = key & np.uint64((1 << (8 * (k + 1))) - 1)
            context = mine >> np.uint64(8)
            n_at = np.minimum(np.searchsorted(node["context"], context), len(node["context"]) - 1)
            known = open_ & (node["context"][n_at] == context)
            if above is not None and len(above["edge"]):
                total = np.where(came >= 0, above["left"][came], node["total"][n_at])
                kinds = np.where(came >= 0, above["left_kinds"][came], node["kinds"][n_at])
            else:
                total, kinds = node["total"][n_at], node["kinds"][n_at]
            e_at = np.minimum(np.searchsorted(node["edge"], mine), len(node["edge"]) - 1)
            found = known & (node["edge"][e_at] == mine)
            bits[found] += np.log2((total[found] + kinds[found]) / node["n"][e_at[found]])
            open_ &= ~found
            escape = known & ~found & (kinds > 0)
            bits[escape] += np.log2((total[escape] + kinds[escape]) / kinds[escape])
            came = np.where(known & ~found, n_at, -1)
        root = self.nodes[0]
        rest = root["left"][0] if len(root["left"]) else 256.0
        bits[open_] += math.log2(max(rest, 1.0))
        return bits.astype(np.float32)


def _low(gram: Column | str, n_bytes: int) -> Column:
    """The last ``n_bytes`` bytes of a gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << (8 * n_bytes)) - 1))


class TrieTables:
    """The same trie where it is too large for a broadcast: a table of edges an order, and what follows from it."""

    def __init__(self, levels: list[DataFrame], held: int):
        """levels: the edges (gram, n) of each order from 0, checkpointed; held: how many of the deepest are broadcast."""
        self.order, self.levels = len(levels) - 1, levels
        steps = levels[-1].groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect()
        least, edges = None, 0
        for row in steps:  # as many steps as bits in a count, times 8
            edges += row["n"]
            if edges > held:
                break
            least = row["step"]
        near = levels[-1].filter(F.floor(F.log2("n") * 8) >= least if least is not None else F.lit(False)).withColumn("context", F.shiftrightunsigned("gram", 8))
        near = near.join(self._sums(self.order), "context").select("gram", F.log2((F.col("total") + F.col("kinds")) / F.col("n")).cast("float").alias("bits")).toPandas()
        self.near = Edges(near["gram"].to_numpy(np.int64).view(np.uint64), near["bits"].to_numpy(np.float32))

    def _sums(self, k: int) -> DataFrame:
        """(context, total, kinds) of the nodes of order k."""
        return self.levels[k].groupBy(F.shiftrightunsigned("gram", 8).alias("context")).agg(F.sum("n").cast("double").alias("total"), F.count(F.lit(1)).cast("double").alias("kinds"))

    @cached_property
    def nodes(self) -> list[DataFrame]:
        """(context, total, kinds, left, left_kinds) of each order: see :class:`Trie`."""
        out = [self._sums(0).withColumns({"left": 256.0 - F.col("kinds"), "left_kinds": F.lit(0.0)})]
        for k in range(1, self.order + 1):
            parent_edge = self.levels[k - 1].select(F.col("gram").alias("up"), F.col("n").alias("up_n"))
            excluded = self.levels[k].withColumn("up", _low("gram", k)).join(parent_edge, "up").groupBy(F.shiftrightunsigned("gram", 8).alias("context")).agg(F.sum("up_n").cast("double").alias("excluded"))
            parent = self._sums(k - 1).select(F.col("context").alias("up"), F.col("total").alias("up_total"), F.col("kinds").alias("up_kinds"))
            node = self._sums(k).join(excluded, "context").withColumn("up", _low("context", k - 1)).join(parent, "up")
            out.append(node.select("context", "total", "kinds", (F.col("up_total") - F.col("excluded")).alias("left"), (F.col("up_kinds") - F.col("kinds")).alias("left_kinds")))
        return [checkpoint(node) for node in out]

    def bits(self, wanted: DataFrame) -> DataFrame:
        """(gram, bits) of distinct grams: of a deepest edge at once, of others down the orders, as :meth:`Trie._walk` goes."""
        top = self.levels[-1].join(self._sums(self.order), F.shiftrightunsigned("gram", 8) == F.col("context"))
        first = checkpoint(wanted.join(top, "gram", "left").select("gram", F.log2((F.col("total") + F.col("kinds")) / F.col("n")).alias("bits")))
        done = [first.filter("bits IS NOT NULL")]
        rest = first.filter("bits IS NULL").select("gram", F.lit(0.0).alias("bits"), *[F.lit(None).cast("double").alias(c) for c in ("came", "came_kinds")])
        if rest.isEmpty():
            return done[0].withColumn("bits", F.col("bits").cast("float"))
        for k in range(self.order, -1, -1):
            edge = self.levels[k].select(F.col("gram").alias("mine"), "n")
            at = rest.withColumn("mine", _low("gram", k + 1)).withColumn("context", F.shiftrightunsigned("mine", 8))
            at = at.join(edge, "mine", "left").join(self.nodes[k], "context", "left")
            at = at.withColumns({"of": F.coalesce("came", "total"), "of_kinds": F.coalesce("came_kinds", "kinds")})
            found = F.col("n").isNotNull()
            escaped = F.col("of_kinds") > 0  # null without a node
            more = F.when(found, F.log2((F.col("of") + F.col("of_kinds")) / F.col("n"))).when(escaped, F.log2((F.col("of") + F.col("of_kinds")) / F.col("of_kinds"))).otherwise(0.0)
            at = checkpoint(at.select("gram", (F.col("bits") + more).alias("bits"), F.col("left").alias("came"), F.col("left_kinds").alias("came_kinds"), found.alias("found")))
            done.append(at.filter("found").select("gram", "bits"))
            rest = at.filter("NOT found").drop("found")
        root = self.nodes[0].first()
        done.append(rest.select("gram", (F.col("bits") + F.lit(math.log2(max(1.0, root["left"] if root else 256.0)))).alias("bits")))
        out = done[0]
        for part in done[1:]:
            out = out.union(part)
        return out.withColumn("bits", F.col("bits").cast("float"))


def train(docs: DataFrame, text: str = "text", order: int = ORDER, min_rate: float = MIN_RATE, held: int = HELD) -> Trie | TrieTables:
    """The trie of all documents' counts; at most ``held`` edges reach the driver."""
    if not 0 <= order <= MOST_ORDER:
        raise ValueError(f"order must be 0 to {MOST_ORDER}: a context and its byte are a key of 63 bits")
    counts = checkpoint(gram_counts(docs, text, order))
    least = max(1.0, min_rate * (counts.agg(F.sum("n")).first()[0] or 0))
    levels = []
    for k in range(order, -1, -1):
        levels.append(counts.filter(F.col("n") >= least) if least > 1 else counts)
        if k:  # a shorter gram's count is the sum of those of which it is a suffix
            counts = checkpoint(counts.groupBy(_low("gram", k).alias("gram")).agg(F.sum("n").alias("n")))
    levels = levels[::-1]
    if sum(level.count() for level in levels) > held:
        return TrieTables(levels, held)
    kept = [level.toPandas() for level in levels]
    return Trie([(rows["gram"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)) for rows in kept])


def score(docs: DataFrame, trie: Trie | TrieTables, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) under a pretrained trie."""
    spark = docs.sparkSession
    whole = isinstance(trie, Trie)
    model = spark.sparkContext.broadcast(trie if whole else trie.near)
    order = trie.order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        row = TaskContext.get().partitionId() << 40
        for batch in pieces(batches, "t"):
            raw, offsets = buffers(batch.column("t"))
            size = np.diff(offsets)
            sums = np.zeros(len(size))
            rest, begin = np.zeros(0, np.int64), np.zeros(len(offsets), np.int32)
            if len(raw):
                key = grams(raw, offsets, order)
                if whole:
                    bits = known.code_lengths(key)
                else:
                    bits, at = known.find(key)
                    at.sort()
                    bits[at] = 0
                    rest, begin = key[at].view(np.int64), np.searchsorted(at, offsets).astype(np.int32)
                full = np.flatnonzero(size)
                sums[full] = np.add.reduceat(bits.astype(np.float64), offsets[:-1][full])
            null = batch.column("t").is_null().to_numpy(zero_copy_only=False)
            columns = [batch.column("doc_id"), pa.array(size, pa.int64(), mask=null), pa.array(sums, mask=null)]
            if whole:
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "bits"])
            else:
                rows = pa.array(np.arange(row, row + len(size)))
                row += len(size)
                yield pa.RecordBatch.from_arrays([*columns, rows, pa.ListArray.from_arrays(pa.array(begin), pa.array(rest))], names=["doc_id", "n_bytes", "bits", "row", "rest"])

    rows = docs.select(ref(docs, doc_id).alias("doc_id"), ref(docs, text).cast("string").alias("t"))
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, bits double" + ("" if whole else ", row long, rest array<long>")
    out = rows.mapInArrow(run, kind)
    if not whole:
        part = checkpoint(out)  # so that rows keep their numbers
        rest = part.select("row", F.explode("rest").alias("gram"))
        bits = trie.bits(rest.select("gram").distinct())
        more = rest.join(bits, "gram").groupBy("row").agg(F.sum(F.col("bits").cast("double")).alias("more"))
        out = part.drop("rest").join(more, "row", "left").withColumn("bits", F.col("bits") + F.coalesce("more", F.lit(0.0)))
    rate = F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes")).when(F.col("n_bytes") == 0, 0.0)
    return out.select("doc_id", "n_bytes", "bits", rate.alias("bits_per_byte"))


def lm_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, min_rate: float = MIN_RATE) -> DataFrame:
    """Train on all documents, then score each of them."""
    return score(docs, train(docs, text, order, min_rate), doc_id, text)


def adaptive_bits(data: bytes, order: int = ORDER) -> float:
    """Code length of one document under a trie that learns while it codes."""
    tries: list[dict[bytes, dict[int, int]]] = [{} for _ in range(order + 1)]
    data = bytes(order) + data
    bits = 0.0
    for i in range(order, len(data)):
        symbol, excluded = data[i], set()
        for k in range(order, -1, -1):
            seen = tries[k].get(data[i - k : i])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            total, kinds = sum(left.values()), len(left)
            if symbol in left:
                bits += math.log2((total + kinds) / left[symbol])
                break
            if kinds:
                bits += math.log2((total + kinds) / kinds)
            excluded |= left.keys()
        else:
            bits += math.log2(256 - len(excluded))
        for k in range(order + 1):
            followers = tries[k].setdefault(data[i - k : i], {})
            followers[symbol] = followers.get(symbol, 0) + 1
    return bits


def score_adaptive(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte), each document under a trie of its own that learns as it codes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [None if t is None else t.encode() for t in batch["t"]]
            bits = [None if r is None else adaptive_bits(r, order) for r in raw]
            size = [None if r is None else len(r) for r in raw]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": pd.array(size, "Int64"), "bits": bits, "bits_per_byte": [None if b is None else b / max(1, n) for b, n in zip(bits, size)]})

    rows = docs.select(ref(docs, doc_id).alias("doc_id"), ref(docs, text).cast("string").alias("t"))
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, bits double, bits_per_byte double")
