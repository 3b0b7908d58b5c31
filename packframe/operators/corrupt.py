"""Span corruption with deterministic spans.

Counts follow in closed form from a row's length.  Lengths are multinomial: item j
of a row goes to the cell ``mix(md5(seed, id, side) + (j + 1) * STEP) mod cells``.

An Arrow batch is cut in pieces of bounded size, and each piece is sent back before
the next is made: a worker holds the batch, and the arrays of one piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packframe.functions.scalar import IGNORE, hash32, pad_width, padded


#: Factors of the hash of an item: sums and products stay below 2**63 in any engine.
STEP, TIMES, MASK = 2654435761, 73244475, (1 << 32) - 1

#: Tokens of the rows that a numpy pass takes at once.
PIECE = 1 << 17


@dataclass(frozen=True)
class SpanConfig:
    """vocab: the tokenizer's size, where it is known; sentinels must lie below it."""

    density: float = 0.15
    mean: float = 3.0
    input_cap: int = 64
    target_cap: int = 64
    multiple: int = 8
    dynamic: bool = True
    eos: int | None = 1
    pad: int = 0
    sentinels: tuple[int, ...] = tuple(range(31999, 31899, -1))
    seed: str = "0"
    vocab: int | None = None

    def __post_init__(self) -> None:
        outside = [(i, s) for i, s in enumerate(self.sentinels) if s < 0 or (self.vocab is not None and s >= self.vocab)]
        if outside:
            raise ValueError(f"sentinels outside the vocabulary of {self.vocab}, as (place, id): {outside[:5]}")


def span_counts(length: Column, config: SpanConfig) -> tuple[Column, Column]:
    """(noise tokens, spans); halves are rounded to even."""
    noise = F.greatest(F.lit(1), F.bround(length.cast("double") * F.lit(config.density)).cast("int"))
    return noise, F.greatest(F.lit(1), F.bround(noise.cast("double") / F.lit(config.mean)).cast("int"))


def upto(n: Column) -> Column:
    """0 .. n - 1, empty for n = 0."""
    return F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), n)), lambda i: i < n)


def _pieces(size: np.ndarray) -> Iterator[slice]:
    """Runs of rows of at most PIECE tokens and rows in all; a longer row is a run of its own."""
    ends, start = np.append(0, np.cumsum(size + 1)), 0
    while start < len(size):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + PIECE, "right")) - 1)
        yield slice(start, end)
        start = end


def _counts(seed: np.ndarray, many: np.ndarray, size: np.ndarray) -> pa.Array:
    """How many of a row's items fall in each of its cells, by a hash of its seed and the item's number."""
    many = np.where(size == 0, 0, many)
    ends, last = np.append(0, np.cumsum(size)), np.append(0, np.cumsum(many))
    owner = np.repeat(np.arange(len(seed)), many)
    x = seed[owner] + (np.arange(last[-1]) - last[owner] + 1) * STEP & MASK
    x ^= x >> 16
    x = x * TIMES & MASK
    x ^= x >> 16
    counts = np.bincount(ends[owner] + x % size[owner], minlength=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(counts.astype(np.int32)))


#: Both sides of a row, each of (seed, items, cells), as one iterator takes one worker.
@F.arrow_udf(T.StructType([T.StructField(side, T.ArrayType(T.IntegerType())) for side in ("noise", "gap")]))
def _dealt(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for batch in batches:
        held = [np.maximum(x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), 0) for x in batch]
        for rows in _pieces(held[1] + held[2] + held[4] + held[5]):
            part = [x[rows] for x in held]
            yield pa.StructArray.from_arrays([_counts(*part[:3]), _counts(*part[3:])], ["noise", "gap"])


def spread(noise: tuple[Column, Column], gap: tuple[Column, Column], key: Column, config: SpanConfig) -> Column:
    """How many of the items fall in each cell, of both sides' (items, cells); one md5 a row and side seeds the arithmetic that places them."""
    return _dealt(*(x for side, held in (("noise", noise), ("gap", gap)) for x in (hash32(F.lit(config.seed), key, F.lit(side)), *held)))


def spans(df: DataFrame, config: SpanConfig = SpanConfig(), key: str = "example_id", length: str = "L") -> DataFrame:
    """df with noise_n, span_n, noise_lens and gap_lens."""
    noise, count = span_counts(F.col(length), config)
    out = df.withColumn("noise_n", F.when(F.col(length) > 0, noise).otherwise(F.lit(0))).withColumn("span_n", F.when(F.col(length) > 0, count).otherwise(F.lit(0)))
    out = out.withColumn("_keep", F.greatest(F.lit(0), F.col(length) - F.col("noise_n")))
    keep, n, s, k = F.col("_keep"), F.col("noise_n"), F.col("span_n"), F.col(key)
    roomy, many = keep >= s + 1, n >= s
    out = out.withColumn("_dealt", spread((F.when(many, n - s).otherwise(F.lit(0)), s), (F.when(roomy, keep - s - 1).otherwise(keep), s + 1), k, config))
    none = F.array().cast("array<int>")
    lens = F.transform("_dealt.noise", lambda x: x + 1)
    gaps = F.when(roomy, F.transform("_dealt.gap", lambda x: x + 1)).otherwise(F.col("_dealt.gap"))
    return out.withColumn("noise_lens", F.when(s > 0, lens).otherwise(none)).withColumn("gap_lens", F.when(s > 0, gaps).otherwise(F.array(F.col(length)))).drop("_keep", "_dealt")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows, where each row begins, and the end)."""
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, np.cumsum(size))


def _replaced(config: SpanConfig):
    """(ids, gap_lens, noise_lens) -> struct(corrupted, target), a piece of a batch in a few numpy passes."""
    sentinels = np.array(config.sentinels, np.int64)
    lists = T.ArrayType(T.IntegerType())

    def made(ids: pa.Array, gaps: pa.Array, noise: pa.Array) -> pa.Array:
        (token, rows), (gap, gap_at), (cut, cut_at) = _flat(ids), _flat(gaps), _flat(noise)
        n_spans = np.diff(cut_at)
        has = n_spans > 0
        if not has.all():  # a row without spans gives nothing
            gap = gap[np.repeat(has, np.diff(gap_at))]
            gap_at = np.append(0, np.cumsum(np.where(has, np.diff(gap_at), 0)))
        # Pieces in turn: a row's gaps and noise spans, gap first, one more gap than spans.
        n_pieces = np.where(has, 2 * n_spans + 1, 0)
        first = np.append(0, np.cumsum(n_pieces))
        size = np.zeros(first[-1], np.int64)
        inner = lambda at: np.arange(at[-1]) - np.repeat(at[:-1], np.diff(at))
        of_gap, of_cut = np.repeat(np.arange(len(has)), np.diff(gap_at)), np.repeat(np.arange(len(has)), n_spans)
        size[first[of_gap] + 2 * inner(gap_at)] = gap
        size[first[of_cut] + 2 * inner(cut_at) + 1] = cut
        owner = np.repeat(np.arange(len(has)), n_pieces)
        ends = np.cumsum(size)
        base = np.append(0, ends)[first[:-1]]
        length = np.diff(rows)
        begin, end = (np.minimum(x - base[owner], length[owner]) for x in (ends - size, ends))  # within the row's tokens
        size = end - begin
        is_cut = (np.arange(len(size)) - first[owner]) % 2 == 1
        mark = sentinels[np.minimum((np.arange(len(size)) - first[owner]) // 2, len(sentinels) - 1)]

        def built(kept: np.ndarray, lead: bool, tail: list[int]) -> pa.Array:
            """The kept pieces' tokens, each noise span's sentinel before them (lead) or in their place, and the tail."""
            width = np.where(kept, size, 0) + is_cut
            total = np.zeros(len(has), np.int64)
            np.add.at(total, owner, width)
            out_at = np.append(0, np.cumsum(total + len(tail)))
            before = np.cumsum(width) - width
            at = out_at[owner] + before - np.append(0, np.cumsum(total))[owner]
            out = np.empty(out_at[-1], np.int64)
            out[at[is_cut]] = mark[is_cut]
            chosen = np.flatnonzero(kept & (size > 0))
            many = size[chosen]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            out[np.repeat(at[chosen] + (is_cut[chosen] if lead else 0), many) + step] = token[np.repeat(rows[:-1][owner[chosen]] + begin[chosen], many) + step]
            for i, x in enumerate(tail):
                out[out_at[1:] - len(tail) + i] = x
            return pa.ListArray.from_arrays(pa.array(out_at.astype(np.int32)), pa.array(out.astype(np.int32)))

        return pa.StructArray.from_arrays([built(~is_cut, False, []), built(is_cut, True, [] if config.eos is None else [config.eos])], ["corrupted", "target"])

    @F.arrow_udf(T.StructType([T.StructField("corrupted", lists), T.StructField("target", lists)]))
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            for rows in _pieces(batch[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)):
                yield made(*(x[rows] for x in batch))

    return run


def corrupt(df: DataFrame, config: SpanConfig = SpanConfig(), ids: str = "input_ids", key: str = "example_id") -> DataFrame:
    """df with corrupted and target: each noise span is replaced by a sentinel, and spelt out in the target.

    The i-th span takes the i-th sentinel; the last serves for all beyond.
    """
    held = spans(df.withColumn("L", F.coalesce(F.size(ids), F.lit(0))), config, key)
    made = held.withColumn("_made", _replaced(config)(F.col(ids).cast("array<int>"), F.col("gap_lens"), F.col("noise_lens")))
    return made.withColumn("corrupted", F.col("_made.corrupted")).withColumn("target", F.col("_made.target")).drop("_made")


def collate_spans(df: DataFrame, by: list[str], config: SpanConfig = SpanConfig()) -> DataFrame:
    """Corrupted rows as padded input_ids, attention_mask, labels and input_length, by batch."""
    batch = Window.partitionBy(*by)
    cut = df.withColumn("corrupted", F.slice("corrupted", 1, config.input_cap)).withColumn("target", F.slice("target", 1, config.target_cap))
    width = pad_width(F.max(F.size("corrupted")).over(batch), config.multiple, config.input_cap) if config.dynamic else F.lit(config.input_cap)
    wide = cut.withColumn("_e", width).withColumn("_d", pad_width(F.max(F.size("target")).over(batch), config.multiple, config.target_cap))
    made = wide.withColumn("input_ids", padded(F.col("corrupted"), F.col("_e"), config.pad))
    made = made.withColumn("attention_mask", F.transform("input_ids", lambda x: F.when(x != config.pad, 1).otherwise(0)))
    made = made.withColumn("labels", F.transform(padded(F.col("target"), F.col("_d"), config.pad), lambda x: F.when(x == config.pad, F.lit(IGNORE)).otherwise(x)))
    return made.withColumn("input_length", F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)).drop("_e", "_d", "corrupted", "target")
