"""What a training or an evaluation loop reads: packed, ordered and padded batches of examples.

Examples have example_id, input_ids, attention_mask and labels, and any columns
besides.  Only ids and lengths are packed; the arrays are joined to the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packframe.config import PackConfig
from packframe.functions.scalar import label_length, sampler_length
from packframe.operators import collate, sampler

Collator = Callable[[DataFrame, list[str]], DataFrame]


def fixed(examples: DataFrame, batch_size: int, shuffle: bool = False, seed: str = "0") -> DataFrame:
    """(example_id, L, bucket_id, batch_no): batches of so many examples each, which is packing of lengths of 1."""
    ones = examples.select("example_id", F.lit(1).alias("L"))
    return sampler.pack(ones, PackConfig(batch_size, 1, shuffle=shuffle, seed=seed))


def _collated(examples: DataFrame, plan: DataFrame, order: PackConfig, collator: Collator) -> DataFrame:
    rows = sampler.batch_rows(plan, examples)
    return collator(rows, ["bucket_id", "batch_no"]).join(sampler.emit_order(plan, order), ["bucket_id", "batch_no"])


def padded(pad: int = 0, multiple: int | None = 8, enc_cap: int | None = None, dec_cap: int | None = None) -> Collator:
    """The usual collator: arrays cut to their caps and padded to their batch's widths."""
    return lambda rows, by: collate.collated(rows, by, pad, multiple, enc_cap, dec_cap)


def train_batches(examples: DataFrame, config: PackConfig | None, batch_size: int = 8, alpha: float = 2.0, enc_cap: int | None = None, dec_cap: int | None = None, collator: Collator | None = None, shuffle: bool = True, seed: str = "0") -> DataFrame:
    """The examples with bucket_id, batch_no, emit_pos and padded arrays.

    Packed by effective length under a token budget; without a configuration in
    batches of ``batch_size`` examples.  collator: a function of the rows and
    the columns that name a batch, in place of padding.
    """
    kept = collate.require_labels(collate.keep_columns(examples))
    if config is None:
        plan, order = fixed(kept, batch_size, shuffle, seed), PackConfig(batch_size, 1, shuffle=shuffle, seed=seed)
    else:
        lengths = kept.select("example_id", sampler_length(F.size("input_ids"), label_length(F.col("labels")), alpha, enc_cap, dec_cap).alias("L"))
        plan, order = sampler.pack(lengths, config), config
    return _collated(kept, plan, order, collator or padded(enc_cap=enc_cap, dec_cap=dec_cap))


def eval_batches(examples: DataFrame, config: PackConfig | None, batch_size: int = 8, enc_cap: int | None = None, dec_cap: int | None = None, collator: Collator | None = None, eval_collator: Collator | None = None) -> DataFrame:
    """Like :func:`train_batches`, never shuffled, and packed by the encoder's lengths alone; an evaluation's own collator goes first."""
    kept = collate.require_labels(collate.keep_columns(examples))
    if config is None:
        plan, order = fixed(kept, batch_size), PackConfig(batch_size, 1)
    else:
        order = PackConfig(config.budget, config.width, config.max_length, config.long, config.drop_last, config.strict_drop_last)
        length = F.size("input_ids") if enc_cap is None else F.least(F.size("input_ids"), F.lit(enc_cap))
        plan = sampler.pack(kept.select("example_id", length.alias("L")), order)
    return _collated(kept, plan, order, eval_collator or collator or padded(enc_cap=enc_cap, dec_cap=dec_cap))
