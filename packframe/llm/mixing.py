"""Mixing sources to target weights along a low-discrepancy schedule.

1. Each source's documents are shuffled (by md5 of seed and id) and laid end to
   end; a document belongs to the block of ``block_tokens`` tokens in which it
   begins.  Blocks hold equal tokens, give or take a document.
2. Slot i takes the point ``frac((i + 1) * phi)`` (golden ratio), or the base-2
   van der Corput point, and the source in whose share of the cumulative
   weights the point falls.  Every stretch of slots holds each source in
   proportion, within a few slots.
3. The r-th slot of a source takes its block ``r mod blocks``.  The schedule is
   long enough that each source is used once in full, so sources above their
   natural share repeat in epochs and nothing is lost.

Weights default to ``(1 - even) * natural share + even / sources`` by tokens.
A source's running sums and ranks are split in two levels (hashed bucket, then
within it), so that a hot source is no single task's work.

Tokens are runs without white space.  Null, empty and blank texts count one
token, so that they are scheduled too.  A null source is a source of its own;
sources without a positive weight are left out.  Repeated rows are scheduled
each; null ids are shuffled by text.  Only the named columns are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packframe.llm.common import checkpoint, fresh, joinable, ref

PHI = 0.6180339887498949
BLOCK_TOKENS, EVEN, SEED = 4096, 0.25, "mix-1"
BUCKETS, CHUNK = 256, 1 << 16


def token_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(1))).cast("bigint")


def blocks(docs: DataFrame, doc_id: str, text: str, source: str, block_tokens: int, seed: str, order_id: str | None = None) -> DataFrame:
    """(doc_id, source, tokens, begin, block) of each row; order_id: the column by which rows are shuffled, doc_id unless given."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("by").cast("string"), F.md5("t"))))
    rows = docs.select(ref(docs, doc_id).alias("doc_id"), ref(docs, order_id or doc_id).alias("by"), F.coalesce(ref(docs, source).cast("string"), F.lit("")).alias("source"), ref(docs, text).cast("string").alias("t"))
    rows = checkpoint(rows.select("doc_id", "source", token_count(F.col("t")).alias("tokens"), order.alias("o")).withColumn("bucket", F.substring("o", 1, 2)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("s"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "bucket").orderBy("o", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("b", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(joinable(checkpoint(offsets), 64), ["source", "bucket"])
    placed = placed.withColumn("begin", F.col("b") + F.col("offset"))
    return placed.select("doc_id", "source", "tokens", "begin", F.floor(F.col("begin") / block_tokens).cast("bigint").alias("block"))


def van_der_corput(i: Column) -> Column:
    """The base-2 radical inverse of a whole number below 2**53."""
    return F.conv(F.reverse(F.lpad(F.conv(i.cast("string"), 10, 2), 53, "0")), 2, 10).cast("double") / float(1 << 53)


def point(i: Column, sequence: str) -> Column:
    if sequence == "golden":
        x = (i + 1).cast("double") * F.lit(PHI)
        return x - F.floor(x).cast("double")
    if sequence == "van_der_corput":
        return van_der_corput(i + 1)
    raise ValueError(f"no such sequence: {sequence}")


def shares(placed: DataFrame, weights: dict[str, float] | None, even: float) -> DataFrame:
    """(source, weight, low, high, n_blocks, tokens): each source's interval of [0, 1)."""
    spark = placed.sparkSession
    # blocks are counted as the greatest: one that a long document spans whole has no document of its own
    sizes = checkpoint(placed.groupBy("source").agg(F.sum("tokens").alias("tokens"), (F.max("block") + 1).alias("n_blocks")))
    if weights is None:
        total = sizes.agg(F.sum("tokens").alias("all_tokens"), F.count(F.lit(1)).alias("n_sources"))
        sizes = sizes.crossJoin(F.broadcast(total)).withColumn("weight", (1.0 - even) * F.col("tokens") / F.col("all_tokens") + even / F.col("n_sources")).drop("all_tokens", "n_sources")
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items() if v > 0] or [("", 0.0)], "source string, given double")
        sizes = sizes.join(F.broadcast(given), "source").filter("given > 0")
        total = sizes.agg(F.sum("given").alias("all_given"))
        sizes = sizes.crossJoin(F.broadcast(total)).withColumn("weight", F.col("given") / F.col("all_given")).drop("given", "all_given")
    ordered = Window.orderBy("source").rowsBetween(Window.unboundedPreceding, 0)
    last = Window.orderBy(F.col("source").desc())
    out = sizes.withColumn("high", F.sum("weight").over(ordered)).withColumn("low", F.lag("high", 1, 0.0).over(Window.orderBy("source")))
    return checkpoint(out.withColumn("high", F.when(F.row_number().over(last) == 1, F.lit(1.0)).otherwise(F.col("high"))))


def slots(parts: DataFrame, sequence: str) -> DataFrame:
    """(slot, source, rank, n_blocks): the schedule, until every source is used in full."""
    spark = parts.sparkSession
    need = parts.agg(F.max(F.ceil(F.col("n_blocks") / F.col("weight")))).first()[0] or 0
    n = int(need) + int(need) // 64 + 16 if need else 0  # the points may be a few slots late
    cells = 1024
    grid = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.floor(F.least(F.col("high"), F.lit(1.0 - 1e-12)) * cells))))
    at = spark.range(n).select(F.col("id").alias("slot"), point(F.col("id"), sequence).alias("x")).withColumn("cell", F.floor(F.col("x") * cells))
    taken = checkpoint(at.join(joinable(checkpoint(grid), 96), "cell").filter("x >= low AND x < high").select("slot", "source", "n_blocks", F.floor(F.col("slot") / CHUNK).alias("chunk")))
    counts = taken.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = checkpoint(counts.select("source", "chunk", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset")))
    ranked = taken.withColumn("r", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(joinable(offsets, 64), ["source", "chunk"]).select("slot", "source", (F.col("r") + F.col("offset")).alias("rank"), "n_blocks")
    # cut where the last source completes its first round
    end = ranked.filter("rank < n_blocks").agg(F.max("slot")).first()[0]
    return ranked.filter(F.col("slot") <= F.lit(-1 if end is None else end))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", block_tokens: int = BLOCK_TOKENS, even: float = EVEN, seed: str = SEED, sequence: str = "golden", order_id: str | None = None) -> DataFrame:
    """(slot, position, source, epoch, block, doc_id, tokens): the mixed corpus, its order that of slot and position."""
    placed = checkpoint(blocks(docs, doc_id, text, source, block_tokens, seed, order_id))
    plan = slots(shares(placed, weights, even), sequence)
    plan = plan.select("slot", "source", F.floor(F.col("rank") / F.col("n_blocks")).cast("bigint").alias("epoch"), (F.col("rank") % F.col("n_blocks")).alias("block"))
    return plan.join(placed, ["source", "block"]).select("slot", F.col("begin").alias("position"), "source", "epoch", "block", "doc_id", "tokens")


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The rows of ``docs`` in the schedule's order, each as often as the schedule takes it, with its columns as they were.

    Partitions are runs of slots, sorted by slot and position, so that a reader who goes
    through the files in order reads the mixed corpus.  Rows are numbered once, so each
    row, also of a null or repeated id, has its own slots.
    """
    row, slot, position, of = fresh(docs, "_row", "_slot", "_position", "_of")
    spark = docs.sparkSession
    numbered = checkpoint(docs.withColumn(row, F.monotonically_increasing_id()))
    plan = checkpoint(mix(numbered, weights, row, text, source, order_id=doc_id, **settings).select(F.col("slot").alias(slot), F.col("position").alias(position), F.col("doc_id").alias(of)))
    slots_ = (plan.agg(F.max(slot)).first()[0] or 0) + 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    joined = numbered.join(joinable(plan, 48), F.col(row) == F.col(of))
    moved = joined.repartitionById(parts, F.floor(F.col(slot) * parts / slots_).cast("int")).sortWithinPartitions(slot, position)
    return moved.select(*[ref(moved, c) for c in docs.columns])
