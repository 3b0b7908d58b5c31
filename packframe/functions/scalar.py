"""Lengths, budgets, limits and predicates as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from packframe.config import EDGES, TIERS

WORD = r"[^ \t\r\n]+"
IGNORE = -100
GIB = 1 << 30


def word_count(text: Column) -> Column:
    """Runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("int")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\r\n]+"), lambda w: w != "")


def mask_length(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda a, x: a + x)


def label_length(labels: Column) -> Column:
    """Labels that count; 0 where there are none."""
    return F.coalesce(F.size(F.filter(labels, lambda x: x != IGNORE)), F.lit(0))


def effective(enc: Column, dec: Column, alpha: float | Column) -> Column:
    alpha = F.lit(float(alpha)) if not isinstance(alpha, Column) else alpha
    return enc.cast("double") + alpha * dec.cast("double")


def sampler_length(enc: Column, dec: Column, alpha: float, enc_cap: int | None = None, dec_cap: int | None = None) -> Column:
    """Length under the caps, truncated to a whole number."""
    e = F.least(enc, F.lit(enc_cap)) if enc_cap is not None else enc
    d = F.least(dec, F.lit(dec_cap)) if dec_cap is not None else dec
    return effective(e, d, alpha).cast("int")


def decoder_alpha(vocab: Column) -> Column:
    """What a decoder token costs against an encoder token, by vocabulary size."""
    big = F.least(F.lit(16.0), F.lit(2.0) * F.sqrt(vocab.cast("double") / F.lit(32000.0)))
    return F.when(vocab.isNull() | (vocab <= 64000), F.lit(2.0)).when(vocab <= 128000, F.lit(4.0)).otherwise(big)


def bucket(length: Column, width: int) -> Column:
    return F.ceil(length / F.lit(width)).cast("int")


def regime_key(longest: Column, width: int = 128) -> Column:
    """Truncate, then divide rounding up; 0 for an empty batch."""
    return F.coalesce(F.floor((longest.cast("bigint") + F.lit(width - 1)) / F.lit(width)).cast("int"), F.lit(0))


def pad_width(raw: Column, multiple: int | None, cap: int | None) -> Column:
    """The next multiple, but not above the cap."""
    up = F.ceil(raw / F.lit(multiple)).cast("int") * F.lit(multiple) if multiple else raw
    return F.least(up, F.lit(cap)) if cap is not None else up


def clamp(x: Column, low: Column | int, high: Column | int) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(as_column(low), F.least(x, as_column(high)))


def tier(name: str, gigabytes: Column) -> Column:
    values = TIERS[name]
    out = F.when(gigabytes >= EDGES[0], F.lit(values[0]))
    for edge, value in zip(EDGES[1:], values[1:]):
        out = out.when(gigabytes >= edge, F.lit(value))
    return out.otherwise(F.lit(values[3]))


def lm_head_bytes(dec_tokens: Column, vocab: Column, half: Column) -> Column:
    """Bytes of the output logits; 0 for a vocabulary of 64000 at most."""
    size = dec_tokens.cast("bigint") * vocab.cast("bigint") * F.when(half, F.lit(2)).otherwise(F.lit(4))
    return F.when((vocab > 64000) & (dec_tokens > 0), size).otherwise(F.lit(0).cast("bigint"))


def generation_examples(free: Column, enc: Column, gen: Column, layers: Column, d_model: Column, kv_heads: Column, d_kv: Column, dtype_bytes: Column, both: Column, safety: float = 0.85) -> Column:
    """How many examples' key-value caches fit; null where the model's shape isn't known."""
    per_token = F.lit(2).cast("bigint") * kv_heads * d_kv * dtype_bytes
    length = F.when(both, enc + gen).otherwise(gen).cast("bigint")
    each = layers.cast("bigint") * length * per_token + F.lit(4).cast("bigint") * layers * d_model * dtype_bytes
    return F.when(each > 0, F.greatest(F.lit(1).cast("bigint"), F.floor(free.cast("double") * F.lit(safety) / each.cast("double")).cast("bigint")))


def headroom(total: Column, baseline: Column) -> Column:
    """Memory beyond the model's, at least a twentieth of all."""
    return F.greatest((total - baseline).cast("double"), total.cast("double") * F.lit(0.05))


def safe_floor(total: Column, baseline: Column, bytes_per_token: Column, least: int) -> Column:
    """The least token limit worth having: two thirds of the headroom."""
    fits = (F.lit(0.66) * headroom(total, baseline) / F.greatest(bytes_per_token, F.lit(1e-9))).cast("bigint")
    return F.when(bytes_per_token > 0, F.greatest(F.lit(least).cast("bigint"), fits)).otherwise(F.lit(least).cast("bigint"))


def bytes_per_token(total: Column, baseline: Column, peak: Column, tokens: Column) -> Column:
    room = headroom(total, baseline)
    used = F.greatest((peak - baseline).cast("double"), room * F.lit(0.05))
    return F.when((peak > 0) & (tokens > 0), used / tokens.cast("double"))


def autotuned_tokens(total: Column, baseline: Column, peak: Column, tokens: Column, safety: float, least: int, most: int) -> Column:
    cost = bytes_per_token(total, baseline, peak, tokens)
    target = (F.lit(safety) * headroom(total, baseline) / F.greatest(cost, F.lit(1e-9))).cast("bigint")
    return clamp(target, F.lit(least).cast("bigint"), F.lit(most).cast("bigint"))


def contains_any(text: Column, needles: list[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [text.contains(n) for n in needles]), F.lit(False))


#: What a device that ran out of memory says, and what failures worth saving state for say; letters' case counts.
MEMORY = ("CUDA out of memory", "CUBLAS_STATUS_ALLOC_FAILED", "cudaMalloc")
SAVED = ("CUDA out of memory", "CUBLAS_STATUS_ALLOC_FAILED", "cudaErrorLaunchTimeout", "the launch timed out and was terminated", "CUDA error")


def memory_failure(message: Column) -> Column:
    """Whether a step is tried again under smaller limits."""
    return contains_any(message, list(MEMORY))


def worth_saving(message: Column) -> Column:
    """Whether state is saved before the failure is raised."""
    return contains_any(message, list(SAVED))


def oom_class(message: Column) -> Column:
    """memory: a device ran out; device: another failure worth saving state for; other."""
    return F.when(memory_failure(message), F.lit("memory")).when(worth_saving(message), F.lit("device")).otherwise(F.lit("other"))


def english_target(prompt: Column) -> Column:
    return contains_any(F.lower(prompt), [" to english", " into english", "english translation"])


def first_words(text: Column, n: int = 64) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def first_label(labels: Column) -> Column:
    """Of a list of references the first, stripped; empty where there is none."""
    return F.coalesce(stripped(F.get(labels, F.lit(0))), F.lit(""))


ALIASES = {"sacrebleu": "bleu", "bleu1": "bleu", "bleu-1": "bleu", "chr_f": "chrf", "chrf++": "chrf", "chrfpp": "chrf"}


def metric_name(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    low = F.lower(F.trim(name))
    return F.coalesce(F.try_element_at(table, low), low)


def eval_mode(mode: Column) -> Column:
    low = F.lower(F.trim(mode))
    return F.when(low.isin("hf", "auto", "token_aware_loss", "token_aware_metrics"), low)


def padded(array: Column, width: Column, fill: int) -> Column:
    """The array, filled on the right up to the width."""
    return F.concat(array, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), width - F.size(array))))


def prefix(array: Column, n: int) -> Column:
    """The first n elements; null for null."""
    return F.slice(array, 1, n)


def shifted_right(ids: Column, pad: int, start: int) -> Column:
    """Decoder inputs from labels: the start id, then all labels but the last, ignored ones as padding."""
    moved = F.concat(F.array(F.lit(start)), F.slice(ids, 1, F.greatest(F.lit(0), F.size(ids) - 1)))
    return F.when(F.size(ids) > 0, F.transform(moved, lambda x: F.when(x == IGNORE, F.lit(pad)).otherwise(x))).otherwise(ids)


def unignored(labels: Column, pad: int) -> Column:
    return F.transform(labels, lambda x: F.when(x == IGNORE, F.lit(pad)).otherwise(x))


def hash32(*parts: Column) -> Column:
    """An integer below 2**32 that SQL engines agree on: eight digits of md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")
