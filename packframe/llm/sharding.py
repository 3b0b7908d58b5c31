"""Sharding by sampled splitters.

1. A size-weighted sample of keys: a record of ``s`` bytes is drawn with
   probability ``min(1, s / step)``, by the hash of its key, and stands for
   ``max(s, step)`` bytes; ``step`` makes it ``oversample`` draws a range.
2. Splitters are the sample's quantiles by bytes: a range a target shard, but at
   most ``MOST_RANGES``, so that the sample on the driver is as small however large
   the table.
3. Records are ranged by the splitters (the record goes to the range of the
   first splitter above its key) and each range's bytes are counted exactly.
4. A range over ``overfull`` times the target is subdivided: its records, in key
   order, are cut at each target's worth of bytes.  Records of one key can be cut,
   as ties are ordered by the hash of the whole record.  Repeated rows across a cut
   can't be told apart, so they are dealt out: each task starts at a place of its own
   and goes on in steps of the golden ratio, whatever its batches, so that each
   shard gets the share of them that its bytes span, give or take a few a task.
5. Records move once, straight to their shard's partition, sorted by shard and key.

Shards are numbered from 0 in key order.  Keys are numbers, booleans, dates,
timestamps, strings or binaries; other types raise an error.  Doubles sort as Spark
sorts them: -0.0 equals 0.0, and NaN comes last.  Null key parts come before all
others.  Sizes are bytes of UTF-8 text, at least 1 (null and empty texts too).
Repeated rows are kept.  An empty table has no shards.  The table of shards is what
tasks look up; it may take ``MOST_SHARDS`` rows, and a table that needs more is
an error that asks for a greater target.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packframe.llm.common import checkpoint, discard, fresh, joinable, mix, ref

PHI = 0.6180339887498949
TARGET_BYTES, OVERSAMPLE, OVERFULL = 64 << 20, 64, 1.25
MOST_RANGES, MOST_SHARDS, MOST_PARTITIONS = 1 << 12, 1 << 20, 1 << 15


@F.arrow_udf(T.StringType())
def _float_key(values: pa.Array) -> pa.Array:
    """16 hexadecimal digits that sort as the doubles do."""
    x = values.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    x[np.isnan(x)] = np.nan  # one NaN, with the sign bit clear
    bits = x.view(np.uint64)
    bits = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))
    return pa.array([f"{b:016x}" for b in bits.tolist()], pa.string())


@F.arrow_udf(T.StringType())
def _decimal_key(values: pa.Array) -> pa.Array:
    """39 digits that sort as the decimals do, which share a scale."""
    scale, half = values.type.scale, 10**38
    return pa.array([None if v is None else f"{int(v.scaleb(scale)) + half:039d}" for v in values.to_pylist()], pa.string())


def sort_key(df: DataFrame, keys: list[str]) -> Column:
    """One string that sorts, by bytes, as the key columns do; a null sorts first."""
    parts = []
    for k in keys:
        c, kind = ref(df, k), df.schema[k].dataType
        if isinstance(kind, T.BooleanType):
            said = c.cast("int").cast("string")
        elif isinstance(kind, (T.IntegralType, T.DateType, T.TimestampType)):
            whole = F.unix_date(c) if isinstance(kind, T.DateType) else F.unix_micros(c) if isinstance(kind, T.TimestampType) else c
            high = whole.cast("decimal(20,0)") + F.lit(Decimal(1 << 63)).cast("decimal(20,0)")
            said = F.lpad(high.cast("decimal(20,0)").cast("string"), 20, "0")
        elif isinstance(kind, T.FractionalType):
            said = _decimal_key(c) if isinstance(kind, T.DecimalType) else _float_key(c.cast("double"))
        elif isinstance(kind, T.StringType):  # no byte of a part may pass for the bound between parts
            said = F.replace(F.replace(c, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))
        elif isinstance(kind, T.BinaryType):
            said = F.hex(c)
        elif isinstance(kind, T.NullType):
            said = F.lit("")
        else:
            raise ValueError(f"no order of keys for column {k} of type {kind.simpleString()}")
        parts.append(F.when(c.isNull(), F.lit("\x01")).otherwise(F.concat(F.lit("\x02"), said)))
    return F.concat_ws("\x00", *parts)


def sample(rows: DataFrame, step: float) -> DataFrame:
    """(k, w): the sampled keys and the bytes each stands for; rows: (k, h, s)."""
    chance = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)
    return rows.filter(chance < F.col("s") / F.lit(float(step))).select("k", F.greatest(F.col("s").cast("double"), F.lit(float(step))).alias("w"))


def quantiles(drawn: pd.DataFrame, shards: int) -> list[str]:
    """The keys at the weighted quantiles, in order, each once."""
    drawn = drawn.sort_values("k", kind="stable", key=lambda c: c.map(str.encode))
    sums = drawn["w"].cumsum().to_numpy()
    if not len(sums) or shards < 2:
        return []
    at = np.searchsorted(sums, sums[-1] * np.arange(1, shards) / shards)
    return list(dict.fromkeys(drawn["k"].iloc[np.minimum(at, len(sums) - 1)]))


def range_of(key: Column, splitters: list[bytes]) -> Column:
    """How many splitters are at or below the key; they are as few as MOST_RANGES says."""

    @F.arrow_udf("int")
    def place(keys: pa.Array) -> pa.Array:
        return pa.array([bisect_right(splitters, k) for k in keys.cast(pa.binary()).to_pylist()], pa.int32())

    return place(key) if splitters else F.lit(0)


class Places:
    """Where records go: the cuts between shards, in order, and the runs of repeated rows that a cut goes through."""

    def __init__(self, splitters: list[bytes], bounds: pd.DataFrame, alike: list, target: int):
        self.splitters, self.target = splitters, target
        self.first: dict[int, int] = {}
        self.cuts: dict[int, list[tuple[bytes, int]]] = {}
        self.parts: dict[int, list[int]] = {}  # a record over the target leaves parts out
        for shard, (rng, part, start) in enumerate(zip(bounds["r"], bounds["part"], bounds["from"])):
            self.first.setdefault(int(rng), shard)
            self.parts.setdefault(int(rng), []).append(int(part))
            if part > 0:
                self.cuts.setdefault(int(rng), []).append((start["k"].encode(), int(start["h"])))
        self.runs = {(row["r"], row["k"].encode(), row["h"]): (row["begin"], row["bytes"], row["high"]) for row in alike}

    def shard(self, key: bytes, hashed: int, share: float) -> int:
        """The shard of a record; share: where it is dealt to within a run of repeated rows, from 0 to 1."""
        rng = bisect_right(self.splitters, key)
        if run := self.runs.get((rng, key, hashed)):
            return self.first[rng] + bisect_right(self.parts[rng], min(run[2], int((run[0] + share * run[1]) // self.target))) - 1
        inside = self.cuts.get(rng)
        return self.first[rng] + (bisect_right(inside, (key, hashed)) if inside else 0)


def assign(docs: DataFrame, keys: list[str], text: str, target_bytes: int = TARGET_BYTES, oversample: int = OVERSAMPLE, overfull: float = OVERFULL) -> tuple[DataFrame, int, tuple[str, str, str, str]]:
    """(the records with their key, hash, size and shard; the number of shards; the names of those four columns)."""
    k, h, s, r = fresh(docs, "_key", "_hash", "_size", "_range")
    rows = docs.withColumn(s, F.greatest(F.lit(1), F.coalesce(F.octet_length(ref(docs, text).cast("string")), F.lit(1))).cast("bigint")).withColumn(k, sort_key(docs, keys)).withColumn(h, F.xxhash64(*[ref(docs, c) for c in docs.columns]))
    slim = checkpoint(rows.select(F.col(k).alias("k"), F.col(h).alias("h"), F.col(s).alias("s")))
    total = slim.agg(F.sum("s")).first()[0] or 0
    ranges = max(1, min(-(-total // target_bytes), MOST_RANGES))
    drawn = sample(slim, max(1.0, total / (ranges * oversample))).toPandas()
    splitters = [x.encode() for x in quantiles(drawn, ranges)]
    ranged = checkpoint(slim.withColumn("r", range_of(F.col("k"), splitters)))
    sizes = ranged.groupBy("r").agg(F.sum("s").alias("bytes"))
    # Subdivision: the overfull ranges' keys alone are sorted, each range on its own.
    over = joinable(checkpoint(sizes.filter(F.col("bytes") > overfull * target_bytes)), 24)
    inner = ranged.join(over, "r").withColumn("at", F.sum("s").over(Window.partitionBy("r").orderBy("k", "h").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s"))
    inner = checkpoint(inner.select("r", "k", "h", "s", "at").withColumn("part", F.floor(F.col("at") / target_bytes)))
    # Rows alike on both sides of a cut: where they begin, and what they span. There are at most as many such runs as cuts.
    alike = inner.groupBy("r", "k", "h").agg(F.min("at").alias("begin"), F.sum("s").alias("bytes"), F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high")
    cuts = inner.groupBy("r", "part").agg(F.min(F.struct("k", "h")).alias("from"))
    # Shards in order: each range gives one, or one a part.
    table = checkpoint(sizes.select("r").join(cuts, "r", "left").select("r", F.coalesce("part", F.lit(0)).alias("part"), F.col("from")))
    n = table.count()
    if n > MOST_SHARDS:
        raise ValueError(f"{n} shards of {target_bytes} bytes: choose a target of at least {-(-total // MOST_SHARDS)}")
    places = Places(splitters, table.toPandas().sort_values(["r", "part"]), alike.collect(), target_bytes)
    discard(slim, ranged, inner, table)
    shared = docs.sparkSession.sparkContext.broadcast(places)

    @F.arrow_udf("int")
    def shard_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = shared.value
        start, turn = int(mix(np.array([TaskContext.get().partitionId() + 1], np.uint64))[0]) / 2.0**64, 0
        for keys_, hashes in batches:
            out = []
            for key, h_ in zip(keys_.cast(pa.binary()).to_pylist(), hashes.to_pylist()):
                if known.runs:
                    turn += 1
                out.append(known.shard(key, h_, (start + turn * PHI) % 1.0))
            yield pa.array(out, pa.int32())

    return rows.withColumn(r, shard_of(F.col(k), F.col(h))), n, (k, h, s, r)


def shard(docs: DataFrame, keys: list[str], text: str = "text", shard_column: str = "shard", **settings) -> DataFrame:
    """The records with their shard, each shard whole in one partition, sorted by shard and key.

    A partition is a shard, or of over ``MOST_PARTITIONS`` shards several in a row.  A
    column of the input that is named like ``shard_column`` is replaced.
    """
    placed, n, (k, h, _, r) = assign(docs, keys, text, **settings)
    parts = max(1, min(n, MOST_PARTITIONS))
    at = F.col(r) if parts >= n else F.floor(F.col(r).cast("bigint") * parts / n).cast("int")
    moved = placed.repartitionById(parts, at).sortWithinPartitions(r, k, h)
    return moved.select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c != shard_column], F.col(r).alias(shard_column))
