"""Length-bucketed batches under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packframe.config import PackConfig
from packframe.functions.scalar import bucket, hash32
from packframe.operators.nextfit import chunks, next_fit


def bucketed(lengths: DataFrame, width: int, length: str = "L") -> DataFrame:
    return lengths.withColumn("bucket_id", bucket(F.col(length), width))


def bucket_histogram(lengths: DataFrame, width: int) -> DataFrame:
    return bucketed(lengths, width).groupBy("bucket_id").agg(F.count(F.lit(1)).alias("n"), F.sum("L").alias("tokens"), F.min("L").alias("min_len"), F.max("L").alias("max_len"))


def too_long(length: Column, config: PackConfig) -> Column:
    most = config.budget if config.max_length is None else min(config.budget, config.max_length)
    return length > most


def pack(lengths: DataFrame, config: PackConfig, n_chunks: int | None = None) -> DataFrame:
    """(example_id, L, bucket_id, batch_no) of the packed examples; lengths: (example_id, L).

    Next-fit: within a bucket an example joins the open batch if neither the
    token budget nor the longest allowed length is exceeded, else it opens the
    next.  ``long`` says what happens to an example beyond either limit: it is
    skipped, is a batch of its own, or (truncate) is packed like others.  A bucket
    is packed in ``n_chunks`` parts at once, as many as there are shuffle
    partitions unless given.
    """
    rows = bucketed(lengths.select("example_id", "L"), config.width)
    if config.long == "skip":
        rows = rows.filter(~too_long(F.col("L"), config))
    n = n_chunks or int(lengths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order, chunk = ["example_id"], None
    if config.shuffle:
        rows = rows.withColumn("_key", F.md5(F.concat_ws("|", F.lit(config.seed), F.col("example_id").cast("string"))))
        order = ["_key", "example_id"]
        chunk = F.floor(F.conv(F.substring("_key", 1, 7), 16, 10).cast("bigint") * n / (1 << 28))
    else:
        chunk = chunks(lengths, "example_id", n)
    alone = config.long == "single" and too_long(F.col("L"), config)
    closed = F.lit(False) if config.max_length is None else F.col("L") > config.max_length  # no other example fits beside it
    out = next_fit(rows, "bucket_id", chunk, order, "L", config.budget, closed | alone if config.long == "single" else closed, "batch_no")
    out = out.withColumn("alone", alone if config.long == "single" else F.lit(False))
    if config.drop_last and config.strict_drop_last:
        out = out.filter("alone")
    elif config.drop_last:  # a bucket's last batch is incomplete, unless it is one long example
        last = out.groupBy("bucket_id").agg(F.max("batch_no").alias("_last"))
        out = out.join(last, "bucket_id").filter("alone OR batch_no < _last")
    return out.select("example_id", "L", "bucket_id", "batch_no")


def batches(packed: DataFrame) -> DataFrame:
    """(bucket_id, batch_no, n, tokens, max_len, padded, waste) of each batch."""
    each = packed.groupBy("bucket_id", "batch_no").agg(F.count(F.lit(1)).alias("n"), F.sum("L").alias("tokens"), F.max("L").alias("max_len"))
    return each.withColumn("padded", F.col("n") * F.col("max_len")).withColumn("waste", F.col("padded") - F.col("tokens"))


def batch_count(packed: DataFrame) -> DataFrame:
    """(n_batches): at least 1."""
    return packed.select("bucket_id", "batch_no").distinct().agg(F.greatest(F.lit(1).cast("bigint"), F.count(F.lit(1))).alias("n_batches"))


def emit_order(packed: DataFrame, config: PackConfig) -> DataFrame:
    """(bucket_id, batch_no, emit_pos): the order in which batches are given out.

    bucket: bucket by bucket, shuffled by bucket; interleave: batches shuffled.
    Positions come from counts of coarse groups plus a rank within each, so no task
    sorts all batches.
    """
    each = packed.select("bucket_id", "batch_no").distinct()
    if config.mode == "bucket":
        group = F.col("bucket_id").cast("string")
        key = hash32(F.lit(config.seed), F.lit("bucket"), F.col("bucket_id")) if config.shuffle else F.col("bucket_id").cast("bigint")
        keyed = each.withColumn("_g", group).withColumn("_k", key).withColumn("_in", F.col("batch_no").cast("bigint"))
    else:
        key = hash32(F.lit(config.seed), F.lit("batch"), F.col("bucket_id"), F.col("batch_no")) if config.shuffle else F.col("bucket_id").cast("bigint") * F.lit(1 << 24)
        keyed = each.withColumn("_in", key).withColumn("_k", F.shiftright(key, 24)).withColumn("_g", F.col("_k").cast("string"))
    sizes = keyed.groupBy("_g", "_k").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_k", "_g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_g").orderBy("_in", "bucket_id", "batch_no")
    placed = keyed.withColumn("_r", F.row_number().over(inside) - 1).join(offsets, "_g")
    return placed.select("bucket_id", "batch_no", (F.col("_before") + F.col("_r")).alias("emit_pos"))


def batch_rows(packed: DataFrame, examples: DataFrame, key: str = "example_id") -> DataFrame:
    """The examples of the plan, with their batch: the plan is joined, and AQE broadcasts it if it is small."""
    return examples.join(packed.select("example_id", "bucket_id", "batch_no").withColumnRenamed("example_id", "_id"), F.col(key) == F.col("_id")).drop("_id")
