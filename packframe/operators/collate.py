"""Truncation, padding and concatenation of examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packframe.functions.scalar import IGNORE, mask_length, pad_width, padded, prefix

KEEP = ["input_ids", "attention_mask", "labels", "decoder_input_ids", "decoder_attention_mask", "task", "len_allowed", "meteor_ok"]
GENERATE = ["input_ids", "attention_mask"]


def keep_columns(df: DataFrame, length: str = "input_length", ids: tuple[str, ...] = ("example_id",)) -> DataFrame:
    """The columns that a training step reads; the scan then reads no others."""
    return df.select(*[c for c in df.columns if c in (*ids, *KEEP, length)])


def without_length(df: DataFrame, length: str = "input_length") -> DataFrame:
    """What a model's forward step takes."""
    return df.drop(length)


def require_labels(df: DataFrame) -> DataFrame:
    if "labels" not in df.columns:
        raise ValueError("examples must have labels")
    return df


def generate_columns(df: DataFrame, forward: list[str], allow: list[str] = GENERATE, ignore: tuple[str, ...] = ("labels",), ids: tuple[str, ...] = ("example_id",)) -> DataFrame:
    """The array columns that generation accepts."""
    wanted = (set(forward) | set(allow)) - set(ignore)
    return df.select(*[c for c, kind in df.dtypes if c in ids or (c in wanted and kind.startswith("array"))])


def truncated(df: DataFrame, enc_cap: int | None, dec_cap: int | None) -> DataFrame:
    """Encoder and decoder arrays cut to their caps; null arrays stay null."""
    caps = {"input_ids": enc_cap, "attention_mask": enc_cap, "labels": dec_cap, "decoder_input_ids": dec_cap, "decoder_attention_mask": dec_cap}
    return df.withColumns({c: prefix(F.col(c), n) for c, n in caps.items() if n is not None and c in df.columns})


def truncation_hits(df: DataFrame, enc_cap: int, dec_cap: int) -> DataFrame:
    """(enc_hits, dec_hits): how many arrays the caps would cut."""
    hit = lambda c, n: F.coalesce(F.sum(F.when(F.size(c) > n, 1).otherwise(0)), F.lit(0)).cast("bigint")
    return df.agg(hit("input_ids", enc_cap).alias("enc_hits"), hit("labels", dec_cap).alias("dec_hits"))


def collated(df: DataFrame, by: list[str], pad: int = 0, multiple: int | None = None, enc_cap: int | None = None, dec_cap: int | None = None) -> DataFrame:
    """Arrays padded to the widths of their batch, with input_length; one shuffle, by batch."""
    cut = truncated(df, enc_cap, dec_cap)
    batch = Window.partitionBy(*by)
    wide = cut.withColumn("_e", pad_width(F.max(F.size("input_ids")).over(batch), multiple, enc_cap)).withColumn("_d", pad_width(F.max(F.size("labels")).over(batch), multiple, dec_cap))
    out = wide.withColumn("input_length", mask_length(F.col("attention_mask"))).withColumns({"input_ids": padded(F.col("input_ids"), F.col("_e"), pad), "attention_mask": padded(F.col("attention_mask"), F.col("_e"), 0), "labels": padded(F.col("labels"), F.col("_d"), IGNORE)})
    return out.drop("_e", "_d")


def concatenated(batches: list[DataFrame]) -> DataFrame:
    """A bag of batches: widths follow from the rows, so nothing is padded again."""
    out = batches[0]
    for batch in batches[1:]:
        out = out.unionByName(batch, allowMissingColumns=True)
    return out
