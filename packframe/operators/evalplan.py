"""Which batches an evaluation takes, and how it groups them for generation."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packframe.config import RegimeConfig
from packframe.operators import microbatch, regime
from packframe.operators.fold import ordered_fold


def stride_sample(batches: DataFrame, n_examples: int, most: int, number: str = "num") -> DataFrame:
    """Every stride-th batch, from 1, where the stride follows from examples; all for a stride of 1."""
    stride = max(1, n_examples // most)
    return batches if stride == 1 else batches.filter(F.pmod(F.col(number), F.lit(stride)) == 1)


def flush_groups(batches: DataFrame, target: int, order: list[str], keys: list[str] | None = None, size: str = "n") -> DataFrame:
    """Batches with flush_no: a group closes once it holds ``target`` examples or more."""

    def step(state: tuple[int, int], n: int) -> tuple[tuple[int, int], tuple[int]]:
        number, held = state
        held += int(n)
        return ((number + 1, 0) if held >= target else (number, held)), (number,)

    return ordered_fold(batches, keys or [], order, [size], lambda: (0, 0), step, [("flush_no", T.IntegerType())])


def loss_units(rows: DataFrame, tokens: int, capacity: float) -> DataFrame:
    """The rows that an evaluation's loss is computed of, with mb_no; rows as :func:`microbatch.split` takes them.

    A batch within ``capacity`` is one unit; a larger one fails whole and is split by
    ``tokens``, and of its microbatches those beyond the capacity fail and are left out.
    """
    by = microbatch.BATCH
    sizes = rows.groupBy(*by).agg(F.sum("eff").alias("_all"))
    sized = rows.join(sizes, by)
    whole = sized.filter(F.col("_all") <= capacity).withColumn("mb_no", F.lit(0))
    split = microbatch.split(sized.filter(F.col("_all") > capacity), tokens)
    fits = split.groupBy(*by, "mb_no").agg(F.sum("eff").alias("_one")).filter(F.col("_one") <= capacity).drop("_one")
    return whole.unionByName(split.join(fits, [*by, "mb_no"])).drop("_all")


def cut(lengths: list[float], tokens: float, examples: int | None) -> list[float]:
    """The sums of the microbatches of one batch, in ascending order of length: see :func:`microbatch.split`."""
    out: list[float] = []
    held = 0
    for x in sorted(lengths):
        if out and out[-1] + x <= tokens and (examples is None or held < examples):
            out[-1] += x
            held += 1
        else:
            out.append(x)
            held = 1
    return out


FLOW = [("path", T.StringType()), ("attempts", T.IntegerType()), ("microbatches", T.IntegerType()), *regime.EVAL_STATE]


def flush(s: regime.Evaluation, c: RegimeConfig, lengths: list[float], capacity: float) -> tuple[str, int, int]:
    """One flush of the generation buffer: (path, failed attempts, microbatches run); the limits move.

    A flush of up to G examples is tried whole.  If it is larger, or fails, it is
    split under T and G (B without G); each failure shrinks a limit and the
    flush is tried again, until nothing shrinks or the retries are spent, and it is
    skipped.  The first success after a failure is a mark at once.  A unit
    fails if its lengths exceed ``capacity``.
    """
    failed_whole = False
    if s.G is None or len(lengths) <= s.G:
        if sum(lengths) <= capacity:
            regime.eval_succeed(s, c, c.tokens)
            return "whole", 0, 1
        failed_whole = True
    for attempt in range(c.max_retries + 1):
        units = cut(lengths, float("inf") if s.T is None else s.T, s.G if s.G is not None else s.B)
        if all(u <= capacity for u in units):
            regime.eval_succeed(s, c, c.tokens)
            if attempt > 0 or failed_whole:
                regime.eval_bootstrap(s)
            return "split", attempt + failed_whole, len(units)
        if not regime.eval_fail(s, c):
            break
    return "skipped", attempt + 1 + failed_whole, 0


def generation_flow(flushes: DataFrame, config: RegimeConfig, start: regime.Evaluation, capacity: float, order: str = "flush_no", keys: list[str] | None = None, lengths: str = "lengths") -> DataFrame:
    """Flushes (order, lengths: an array of effective lengths) with what became of each, and the limits after it.

    The limits go from flush to flush, so an evaluation (of ``keys``) is folded in its order.
    """

    def step(s: regime.Evaluation, row) -> tuple[regime.Evaluation, tuple]:
        said = flush(s, config, [float(x) for x in row], capacity)
        return s, (*said, *asdict(s).values())

    return ordered_fold(flushes, keys or [], [order], [lengths], lambda: regime.Evaluation(**asdict(start)), step, FLOW)
