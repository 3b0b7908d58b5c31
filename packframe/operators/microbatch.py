"""Splitting batches into memory-bounded microbatches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packframe.functions.scalar import effective
from packframe.operators.fold import ordered_fold

BATCH = ["bucket_id", "batch_no"]


def split(rows: DataFrame, tokens: int | Column, examples: int | None | Column = None, padded: bool = False) -> DataFrame:
    """The rows with mb_no; rows: (bucket_id, batch_no, example_id, eff, ...).

    In ascending order of effective length, a microbatch closes before the row
    that would take it over ``tokens`` (its sum, or with ``padded`` its area),
    or once it holds ``examples``.  A first row always fits.  Either limit may
    be a column, a constant of its batch.
    """
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    limited = rows.withColumn("_T", as_column(tokens).cast("double")).withColumn("_B", F.coalesce(as_column(examples).cast("bigint"), F.lit((1 << 62))))

    def start() -> tuple:
        return 0, 0.0, 0.0, 0

    def step(state: tuple, eff: float, most: float, count_most: int) -> tuple[tuple, tuple]:
        number, total, longest, count = state
        top = max(longest, eff)
        over = count > 0 and (top * (count + 1) if padded else total + eff) > most
        if over or count >= count_most:
            return (number + 1, eff, eff, 1), (number + 1,)
        return (number, total + eff, top, count + 1), (number,)

    return ordered_fold(limited, BATCH, ["eff", "example_id"], ["eff", "_T", "_B"], start, step, [("mb_no", T.IntegerType())]).drop("_T", "_B")


def with_effective(rows: DataFrame, alpha: float, generation: int | None = None) -> DataFrame:
    """Rows with eff; ``generation``: the length each example may generate, in place of its labels'."""
    return rows.withColumn("eff", effective(F.col("enc_len"), F.col("dec_len") if generation is None else F.lit(generation), alpha))


def capped(rows: DataFrame, tokens: int, examples: int | None, most: int = 8, proven: int | None = None) -> DataFrame:
    """Like split(), but a batch of over ``most`` microbatches is split again under wider limits.

    Only such batches take the second pass.  most = 0: no cap.
    """
    first = split(rows, tokens, examples)
    if not most:
        return first
    count = first.groupBy(*BATCH).agg((F.max("mb_no") + 1).alias("_m"), F.sum("eff").cast("bigint").alias("_eff"), F.count(F.lit(1)).alias("_n"))
    joined = first.join(count, BATCH)
    wide = joined.filter(F.col("_m") > most).drop("mb_no")
    step_tokens = F.greatest(F.floor(F.col("_eff") / most) + 1, F.lit(tokens))
    ideal = F.floor(F.col("_n") / most) + 1
    if examples is None:
        again = split(wide, step_tokens, None)
    else:
        cap = max(2 * examples, examples + 16)
        if proven is not None:
            cap = min(cap, int(1.5 * proven))
        again = split(wide, step_tokens, F.least(ideal, F.lit(max(cap, examples)).cast("bigint")))
    return joined.filter(F.col("_m") <= most).drop("_m", "_eff", "_n").unionByName(again.drop("_m", "_eff", "_n"))


def statistics(split_rows: DataFrame, alpha: float) -> DataFrame:
    """(..., n, ntok, eff_tokens, lm_tokens, enc_width, dec_width, waste) of each microbatch."""
    each = split_rows.groupBy(*BATCH, "mb_no").agg(
        F.count(F.lit(1)).alias("n"), F.sum("dec_len").cast("bigint").alias("ntok"), F.sum("enc_len").cast("bigint").alias("enc_tokens"),
        F.max("enc_len").alias("_e"), F.max("dec_len").alias("_d"), F.max("eff").alias("max_eff"),
    )
    width = lambda c: F.greatest(F.lit(1), F.col(c)).cast("int")
    return each.select(
        *BATCH, "mb_no", "n", "ntok", "enc_tokens", effective(F.col("enc_tokens"), F.col("ntok"), alpha).cast("bigint").alias("eff_tokens"), (F.col("n") * F.col("_d")).cast("bigint").alias("lm_tokens"), "max_eff",
        width("_e").alias("enc_width"), width("_d").alias("dec_width"),
        (F.col("n") * width("_e") - F.col("enc_tokens") + F.col("n") * width("_d") - F.col("ntok")).cast("bigint").alias("waste"),
    )


def preflight(stats: DataFrame, vocab: int, half: bool, free: int, total: int, baseline: int, cost: float | None, safety: float) -> DataFrame:
    """stats with would_oom and reason: whether logits or the predicted peak exceed memory."""
    size = F.lit(0).cast("bigint") if vocab <= 64000 else F.col("lm_tokens") * F.lit(vocab * (2 if half else 4))
    lm = size.cast("double") > F.lit(0.85 * free)
    peak = F.lit(False) if cost is None else (F.lit(float(baseline)) + F.lit(cost) * F.col("eff_tokens").cast("double")) > F.lit(total * safety)
    reason = F.when(lm, F.lit("lm_head")).when(peak, F.lit("predicted"))
    return stats.withColumn("reason", reason).withColumn("would_oom", reason.isNotNull())
