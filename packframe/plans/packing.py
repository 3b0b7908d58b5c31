"""Lengths, packing, emission order and microbatches, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packframe.config import PackConfig
from packframe.functions import scalar as S
from packframe.operators import collate, microbatch, sampler
from packframe.sources import loaders
from packframe.sources import tables as D

BUDGET, WIDTH, MAX_LENGTH, ALPHA = 2048, 16, 512, D.ALPHA
BASE = PackConfig(BUDGET, WIDTH)
MB_TOKENS, MB_EXAMPLES, GENERATION, CAP_TOKENS, MOST_MB, PROVEN = 1024, 4, 128, 512, 3, 5


def packed(spark: SparkSession, sf_dir: str, **change) -> DataFrame:
    return sampler.pack(D.lengths(spark, sf_dir), PackConfig(**{"budget": BUDGET, "width": WIDTH} | change))


def packed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bucket_id, batch_no, example_id, enc_len, dec_len, eff): pairs in batches by their sampler length."""
    pairs = D.pairs(spark, sf_dir)
    sized = pairs.withColumn("L", S.sampler_length(F.col("enc_len"), F.col("dec_len"), ALPHA))
    plan = sampler.pack(sized, PackConfig(4 * BUDGET, 128))
    return microbatch.with_effective(sampler.batch_rows(plan, pairs), ALPHA)


def doc_lengths(spark, sf_dir):
    return D.lengths(spark, sf_dir)


def pair_lengths(spark, sf_dir):
    return D.pairs(spark, sf_dir).withColumn("total_len", F.col("enc_len") + F.col("dec_len"))


def effective_length(spark, sf_dir):
    return D.pairs(spark, sf_dir).select("example_id", S.effective(F.col("enc_len"), F.col("dec_len"), ALPHA).alias("eff"))


def sampler_length(spark, sf_dir):
    return D.pairs(spark, sf_dir).select("example_id", S.sampler_length(F.col("enc_len"), F.col("dec_len"), ALPHA, 48, 96).alias("L"))


def length_extremes(spark, sf_dir):
    p = D.pairs(spark, sf_dir)
    total = F.col("enc_len") + F.col("dec_len")
    return p.agg(F.max("enc_len").alias("max_enc"), F.max("dec_len").alias("max_dec"), F.max(total).alias("max_total"), F.count(F.when(total > 256, 1)).alias("over_cap"), F.round(F.avg(S.effective(F.col("enc_len"), F.col("dec_len"), ALPHA)), 6).alias("mean_eff"))


def bucket_histogram(spark, sf_dir):
    return sampler.bucket_histogram(D.lengths(spark, sf_dir), WIDTH)


def keep_columns(spark, sf_dir):
    wide = D.examples(spark, sf_dir).withColumn("junk", F.lit(1))
    kept = collate.keep_columns(wide)
    return kept.select("example_id", "task", F.size("input_ids").alias("n_ids"), F.lit(",".join(sorted(kept.columns))).alias("columns"))


def generate_columns(spark, sf_dir):
    kept = collate.generate_columns(D.examples(spark, sf_dir), ["input_ids", "labels"])
    return kept.select("example_id", F.size("input_ids").alias("n_ids"), F.lit(",".join(sorted(kept.columns))).alias("columns"))


def _joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


def truncate_caps(spark, sf_dir):
    return collate.truncated(D.examples(spark, sf_dir), 32, 64).select("example_id", _joined("input_ids"), F.size("attention_mask").alias("n_mask"), _joined("labels"))


def trunc_hits(spark, sf_dir):
    return collate.truncation_hits(D.examples(spark, sf_dir), 32, 64)


def capped_collate(spark, sf_dir):
    rows = D.examples(spark, sf_dir).withColumn("b", F.col("example_id") % 64)
    return collate.collated(rows, ["b"], 0, 8, 32, 64).select("example_id", "input_length", _joined("input_ids"), _joined("attention_mask"), _joined("labels"))


def concat_batches(spark, sf_dir):
    """Two bags of batches put together, and padded to their common widths."""
    rows = D.examples(spark, sf_dir).withColumn("b", F.col("example_id") % 64)
    union = collate.concatenated([rows.filter("example_id % 2 = 0"), rows.filter("example_id % 2 = 1")])
    return collate.collated(union, ["b"]).select("example_id", "input_length", _joined("input_ids"), _joined("attention_mask"), _joined("labels"))


def _loaded(batches):
    return batches.select("example_id", "bucket_id", "batch_no", "emit_pos", "input_length", F.size("input_ids").alias("enc_width"), F.size("labels").alias("dec_width"))


def loader_train(spark, sf_dir):
    return _loaded(loaders.train_batches(D.examples(spark, sf_dir), PackConfig(4 * BUDGET, 128), alpha=ALPHA))


def loader_eval(spark, sf_dir):
    return _loaded(loaders.eval_batches(D.examples(spark, sf_dir), BASE))


def loader_fixed(spark, sf_dir):
    return _loaded(loaders.eval_batches(D.examples(spark, sf_dir), None, 8))


def pad_to_multiple(spark, sf_dir):
    return D.lengths(spark, sf_dir).select("example_id", S.pad_width(F.col("L"), 8, 500).alias("width"))


def shift_right(spark, sf_dir):
    return D.examples(spark, sf_dir).select("example_id", _joined("labels").alias("l0"), S.shifted_right(F.col("labels"), 0, 0).alias("s")).select("example_id", _joined("s").alias("shifted"))


def slice_rows(spark, sf_dir):
    wanted = packed(spark, sf_dir).filter("batch_no = 0").select(F.col("example_id").alias("w"))
    return D.lengths(spark, sf_dir).join(wanted, F.col("example_id") == F.col("w"), "left_semi")


def pack_truncate(spark, sf_dir):
    return packed(spark, sf_dir)


def pack_skip(spark, sf_dir):
    return packed(spark, sf_dir, long="skip", max_length=MAX_LENGTH)


def pack_single(spark, sf_dir):
    return packed(spark, sf_dir, long="single", max_length=MAX_LENGTH)


def pack_max_length(spark, sf_dir):
    return packed(spark, sf_dir, max_length=MAX_LENGTH)


def pack_drop_last(spark, sf_dir):
    return packed(spark, sf_dir, drop_last=True)


def pack_drop_last_strict(spark, sf_dir):
    return packed(spark, sf_dir, drop_last=True, strict_drop_last=True, long="single", max_length=MAX_LENGTH)


def pack_shuffled(spark, sf_dir):
    return packed(spark, sf_dir, shuffle=True, seed="s1")


def pack_summary(spark, sf_dir):
    return sampler.batches(packed(spark, sf_dir))


def pack_count(spark, sf_dir):
    return sampler.batch_count(packed(spark, sf_dir))


def emit_order_bucket(spark, sf_dir):
    config = PackConfig(BUDGET, WIDTH, shuffle=True, seed="s1")
    return sampler.emit_order(sampler.pack(D.lengths(spark, sf_dir), config), config)


def emit_order_interleave(spark, sf_dir):
    config = PackConfig(BUDGET, WIDTH, shuffle=True, mode="interleave", seed="s1")
    return sampler.emit_order(sampler.pack(D.lengths(spark, sf_dir), config), config)


def _mb(rows):
    return rows.select("bucket_id", "batch_no", "example_id", "mb_no")


def mb_tokens(spark, sf_dir):
    return _mb(microbatch.split(packed_pairs(spark, sf_dir), MB_TOKENS))


def mb_examples(spark, sf_dir):
    return _mb(microbatch.split(packed_pairs(spark, sf_dir), MB_TOKENS, MB_EXAMPLES))


def mb_padding_aware(spark, sf_dir):
    return _mb(microbatch.split(packed_pairs(spark, sf_dir), MB_TOKENS, padded=True))


def mb_generation(spark, sf_dir):
    return _mb(microbatch.split(microbatch.with_effective(packed_pairs(spark, sf_dir), ALPHA, GENERATION), MB_TOKENS))


def mb_cap(spark, sf_dir):
    return _mb(microbatch.capped(packed_pairs(spark, sf_dir), CAP_TOKENS, MB_EXAMPLES, MOST_MB))


def mb_cap_proven(spark, sf_dir):
    """Wider limits stop at one and a half times what has proven stable."""
    return _mb(microbatch.capped(packed_pairs(spark, sf_dir), CAP_TOKENS, MB_EXAMPLES, MOST_MB, PROVEN))


def mb_statistics(spark, sf_dir):
    return microbatch.statistics(microbatch.split(packed_pairs(spark, sf_dir), MB_TOKENS), ALPHA)


def mb_token_stats(spark, sf_dir):
    return mb_statistics(spark, sf_dir).select("bucket_id", "batch_no", "mb_no", "n", "ntok", "eff_tokens", "lm_tokens")


def mb_padding_waste(spark, sf_dir):
    return mb_statistics(spark, sf_dir).select("bucket_id", "batch_no", "mb_no", "enc_width", "dec_width", "waste")


def regime_keys(spark, sf_dir):
    rows = packed_pairs(spark, sf_dir)
    return rows.groupBy("bucket_id", "batch_no").agg(F.max("eff").alias("m")).select("bucket_id", "batch_no", S.regime_key(F.col("m")).alias("regime_key"))


def preflight_lm_head(spark, sf_dir):
    return microbatch.preflight(mb_statistics(spark, sf_dir), 128000, True, 100_000_000, 1 << 36, 1 << 34, None, 0.9).select("bucket_id", "batch_no", "mb_no", "would_oom", "reason")


def preflight_predictive(spark, sf_dir):
    return microbatch.preflight(mb_statistics(spark, sf_dir), 32000, True, 1 << 34, 80 << 30, 16 << 30, 7e7, 0.9).select("bucket_id", "batch_no", "mb_no", "would_oom", "reason")


def pack_sql(budget: int = BUDGET, width: int = WIDTH, most: int | None = None, long: str = "truncate", order: str = "example_id", source: str = "lengths") -> str:
    """CTEs ending in packed(example_id, L, bucket_id, batch_no, alone)."""
    cap = budget if most is None else min(budget, most)
    skip = f"WHERE L <= {cap}" if long == "skip" else ""
    over = f" OR greatest(f.longest, e.L) > {most}" if most is not None else ""
    lone = f"e.L > {cap}" if long == "single" else "false"
    lone1 = lone.replace("e.L", "L")
    return f"""
ex AS MATERIALIZED (SELECT example_id, L, ceil(L / {width})::INT AS bucket_id, row_number() OVER (PARTITION BY ceil(L / {width})::INT ORDER BY {order}) AS rn FROM {source} {skip}),
packed AS (
  SELECT bucket_id, rn, example_id, L, 0 AS batch_no, CASE WHEN {lone1} THEN 0 ELSE L END AS tokens, CASE WHEN {lone1} THEN 0 ELSE L END AS longest, {lone1} AS closed, {lone1} AS alone FROM ex WHERE rn = 1
  UNION ALL
  SELECT e.bucket_id, e.rn, e.example_id, e.L, CASE WHEN {lone} OR f.closed OR f.tokens + e.L > {budget}{over} THEN f.batch_no + 1 ELSE f.batch_no END,
    CASE WHEN {lone} THEN 0 WHEN f.closed OR f.tokens + e.L > {budget}{over} THEN e.L ELSE f.tokens + e.L END,
    CASE WHEN {lone} THEN 0 WHEN f.closed OR f.tokens + e.L > {budget}{over} THEN e.L ELSE greatest(f.longest, e.L) END, {lone}, {lone}
  FROM packed AS f JOIN ex AS e ON e.bucket_id = f.bucket_id AND e.rn = f.rn + 1)"""


def docs_sql(tail: str, **how) -> str:
    return f"WITH RECURSIVE {D.SQL_LENGTHS}, {pack_sql(**how)} {tail}"


ROWS = "SELECT example_id, L, bucket_id, batch_no FROM packed"
MD5_ORDER = "md5('s1' || '|' || example_id::VARCHAR), example_id"
HASH = "('0x' || md5({0})[1:8])::BIGINT"


def pairs_sql(eff: str = "enc_len + 2.0::DOUBLE * dec_len") -> str:
    """CTEs ending in rows(bucket_id, batch_no, example_id, enc_len, dec_len, eff)."""
    return f"""{D.SQL_PAIRS}, sized AS (SELECT *, (enc_len + {ALPHA}::DOUBLE * dec_len)::INT AS L FROM pairs), {pack_sql(4 * BUDGET, 128, source='sized')},
rows AS MATERIALIZED (SELECT bucket_id, batch_no, example_id, enc_len, dec_len, {eff} AS eff FROM packed JOIN pairs USING (example_id))"""


def split_sql(tokens: str, examples: str, padded: bool = False, source: str = "rows", name: str = "split") -> str:
    """CTEs ending in the named table, with mb_no; the limits are expressions over row e."""
    over = f"greatest(f.longest, e.eff) * (f.held + 1) > {tokens}" if padded else f"f.total + e.eff > {tokens}"
    close = f"({over} OR f.held >= {examples})"
    return f"""
{name}_n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY bucket_id, batch_no ORDER BY eff, example_id) AS rm FROM {source}),
{name} AS (
  SELECT *, 0 AS mb_no, eff AS total, eff AS longest, 1 AS held FROM {name}_n WHERE rm = 1
  UNION ALL
  SELECT e.*, CASE WHEN {close} THEN f.mb_no + 1 ELSE f.mb_no END, CASE WHEN {close} THEN e.eff ELSE f.total + e.eff END, CASE WHEN {close} THEN e.eff ELSE greatest(f.longest, e.eff) END, CASE WHEN {close} THEN 1 ELSE f.held + 1 END
  FROM {name} AS f JOIN {name}_n AS e ON e.bucket_id = f.bucket_id AND e.batch_no = f.batch_no AND e.rm = f.rm + 1)"""


MB_ROWS = "SELECT bucket_id, batch_no, example_id, mb_no FROM split"
NONE = str(1 << 62)
STATS = """stats AS (SELECT bucket_id, batch_no, mb_no, count(*) AS n, sum(dec_len)::BIGINT AS ntok, sum(enc_len)::BIGINT AS enc_tokens, (sum(enc_len) + 2 * sum(dec_len))::BIGINT AS eff_tokens, (count(*) * max(dec_len))::BIGINT AS lm_tokens,
  greatest(1, max(enc_len))::INT AS enc_width, greatest(1, max(dec_len))::INT AS dec_width FROM split GROUP BY ALL)"""
BATCH_SQL = "each AS (SELECT bucket_id, batch_no, count(*) AS n, sum(L)::BIGINT AS tokens, max(L) AS max_len FROM packed GROUP BY ALL)"
CAT = "coalesce(array_to_string({0}, ','), '')"


def with_stats(tail: str) -> str:
    return f"WITH RECURSIVE {pairs_sql()}, {split_sql(str(MB_TOKENS), NONE)}, {STATS} {tail}"


def _cap_sql(examples: str) -> str:
    return f"""WITH RECURSIVE {pairs_sql()}, {split_sql(str(CAP_TOKENS), str(MB_EXAMPLES), name='one')},
wide AS MATERIALIZED (SELECT bucket_id, batch_no, greatest(sum(eff)::BIGINT // {MOST_MB} + 1, {CAP_TOKENS}) AS t, {examples} AS b FROM one GROUP BY ALL HAVING max(mb_no) + 1 > {MOST_MB}),
again AS MATERIALIZED (SELECT rows.*, t, b FROM rows JOIN wide USING (bucket_id, batch_no)), {split_sql('e.t', 'e.b', source='again', name='two')}
SELECT bucket_id, batch_no, example_id, mb_no FROM one WHERE (bucket_id, batch_no) NOT IN (SELECT (bucket_id, batch_no) FROM wide) UNION ALL SELECT bucket_id, batch_no, example_id, mb_no FROM two"""


def loader_sql(length: str, packed: str) -> str:
    """Batches of the examples by a length of the encoder's ids e and the labels that count d, in order of bucket."""
    return f"""WITH RECURSIVE {D.SQL_EXAMPLES}, x AS (SELECT example_id, len(input_ids)::INT AS e, len(list_filter(labels, lambda y: y <> -100))::INT AS d, len(labels)::INT AS wide FROM examples), sized AS (SELECT example_id, {length} AS L FROM x), {packed},
each AS (SELECT bucket_id, batch_no, row_number() OVER (ORDER BY bucket_id, batch_no) - 1 AS emit_pos FROM (SELECT DISTINCT bucket_id, batch_no FROM packed))
SELECT example_id, bucket_id, batch_no, emit_pos, e AS input_length, ceil(max(e) OVER w / 8)::INT * 8 AS enc_width, ceil(max(wide) OVER w / 8)::INT * 8 AS dec_width FROM packed JOIN each USING (bucket_id, batch_no) JOIN x USING (example_id) WINDOW w AS (PARTITION BY bucket_id, batch_no)"""


_PAD = "list_concat({0}, list_transform(range(0, greatest(0, {1} - len({0}))), lambda x: {2}))"
SQL = {
    "doc_lengths": f"WITH {D.SQL_LENGTHS} SELECT example_id, L FROM lengths",
    "pair_lengths": f"WITH {D.SQL_PAIRS} SELECT *, enc_len + dec_len AS total_len FROM pairs",
    "effective_length": f"WITH {D.SQL_PAIRS} SELECT example_id, enc_len + {ALPHA}::DOUBLE * dec_len AS eff FROM pairs",
    "sampler_length": f"WITH {D.SQL_PAIRS} SELECT example_id, trunc(least(enc_len, 48) + {ALPHA}::DOUBLE * least(dec_len, 96))::INT AS L FROM pairs",
    "length_extremes": f"WITH {D.SQL_PAIRS} SELECT max(enc_len) AS max_enc, max(dec_len) AS max_dec, max(enc_len + dec_len) AS max_total, count(*) FILTER (enc_len + dec_len > 256) AS over_cap, round(avg(enc_len + {ALPHA}::DOUBLE * dec_len), 6) AS mean_eff FROM pairs",
    "bucket_histogram": f"WITH {D.SQL_LENGTHS} SELECT ceil(L / {WIDTH})::INT AS bucket_id, count(*) AS n, sum(L)::BIGINT AS tokens, min(L) AS min_len, max(L) AS max_len FROM lengths GROUP BY 1",
    "keep_columns": f"WITH {D.SQL_EXAMPLES} SELECT example_id, task, len(input_ids)::INT AS n_ids, 'attention_mask,example_id,input_ids,labels,task' AS columns FROM examples",
    "generate_columns": f"WITH {D.SQL_EXAMPLES} SELECT example_id, len(input_ids)::INT AS n_ids, 'attention_mask,example_id,input_ids' AS columns FROM examples",
    "truncate_caps": f"WITH {D.SQL_EXAMPLES} SELECT example_id, {CAT.format('input_ids[:32]')} AS input_ids, len(attention_mask[:32])::INT AS n_mask, {CAT.format('labels[:64]')} AS labels FROM examples",
    "trunc_hits": f"WITH {D.SQL_EXAMPLES} SELECT count(*) FILTER (len(input_ids) > 32) AS enc_hits, count(*) FILTER (len(labels) > 64) AS dec_hits FROM examples",
    "capped_collate": f"""WITH {D.SQL_EXAMPLES}, c AS (SELECT example_id, example_id % 64 AS b, input_ids[:32] AS i, attention_mask[:32] AS m, labels[:64] AS l FROM examples),
w AS (SELECT *, least(ceil(max(len(i)) OVER (PARTITION BY b) / 8)::INT * 8, 32) AS e, least(ceil(max(len(l)) OVER (PARTITION BY b) / 8)::INT * 8, 64) AS d FROM c)
SELECT example_id, coalesce(list_sum(m), 0)::INT AS input_length, {CAT.format(_PAD.format('i', 'e', 0))} AS input_ids, {CAT.format(_PAD.format('m', 'e', 0))} AS attention_mask, {CAT.format(_PAD.format('l', 'd', -100))} AS labels FROM w""",
    "concat_batches": f"""WITH {D.SQL_EXAMPLES}, w AS (SELECT *, max(len(input_ids)) OVER (PARTITION BY example_id % 64) AS e, max(len(labels)) OVER (PARTITION BY example_id % 64) AS d FROM examples)
SELECT example_id, coalesce(list_sum(attention_mask), 0)::INT AS input_length, {CAT.format(_PAD.format('input_ids', 'e', 0))} AS input_ids, {CAT.format(_PAD.format('attention_mask', 'e', 0))} AS attention_mask, {CAT.format(_PAD.format('labels', 'd', -100))} AS labels FROM w""",
    "loader_train": loader_sql("(e + 2.0::DOUBLE * d)::INT", pack_sql(4 * BUDGET, 128, source="sized")),
    "loader_eval": loader_sql("e", pack_sql(source="sized")),
    "loader_fixed": loader_sql("1", "packed AS (SELECT example_id, 1 AS bucket_id, ((row_number() OVER (ORDER BY example_id) - 1) // 8)::INT AS batch_no FROM sized)"),
    "pad_to_multiple": f"WITH {D.SQL_LENGTHS} SELECT example_id, least(ceil(L / 8)::INT * 8, 500) AS width FROM lengths",
    "shift_right": f"WITH {D.SQL_EXAMPLES} SELECT example_id, CASE WHEN len(labels) = 0 THEN '' ELSE {CAT.format('list_transform(list_concat([0], labels[:len(labels) - 1]), lambda x: CASE WHEN x = -100 THEN 0 ELSE x END)')} END AS shifted FROM examples",
    "slice_rows": docs_sql("SELECT example_id, L FROM packed WHERE batch_no = 0"),
    "pack_truncate": docs_sql(ROWS),
    "pack_skip": docs_sql(ROWS, long="skip", most=MAX_LENGTH),
    "pack_single": docs_sql(ROWS, long="single", most=MAX_LENGTH),
    "pack_max_length": docs_sql(ROWS, most=MAX_LENGTH),
    "pack_drop_last": docs_sql("SELECT example_id, L, bucket_id, batch_no FROM (SELECT *, max(batch_no) OVER (PARTITION BY bucket_id) AS z FROM packed) WHERE batch_no < z"),
    "pack_drop_last_strict": docs_sql(f"{ROWS} WHERE alone", long="single", most=MAX_LENGTH),
    "pack_shuffled": docs_sql(ROWS, order=MD5_ORDER),
    "pack_summary": docs_sql(f", {BATCH_SQL} SELECT *, n * max_len AS padded, n * max_len - tokens AS waste FROM each"),
    "pack_count": docs_sql("SELECT greatest(1, count(DISTINCT (bucket_id, batch_no)))::BIGINT AS n_batches FROM packed"),
    "emit_order_bucket": docs_sql(f", {BATCH_SQL} SELECT bucket_id, batch_no, row_number() OVER (ORDER BY {HASH.format(chr(39) + 's1|bucket|' + chr(39) + ' || bucket_id::VARCHAR')}, bucket_id::VARCHAR, batch_no) - 1 AS emit_pos FROM each", order=MD5_ORDER),
    "emit_order_interleave": docs_sql(f", {BATCH_SQL} SELECT bucket_id, batch_no, row_number() OVER (ORDER BY {HASH.format(chr(39) + 's1|batch|' + chr(39) + ' || bucket_id::VARCHAR || ' + chr(39) + '|' + chr(39) + ' || batch_no::VARCHAR')}, bucket_id, batch_no) - 1 AS emit_pos FROM each", order=MD5_ORDER),
    "mb_tokens": f"WITH RECURSIVE {pairs_sql()}, {split_sql(str(MB_TOKENS), NONE)} {MB_ROWS}",
    "mb_examples": f"WITH RECURSIVE {pairs_sql()}, {split_sql(str(MB_TOKENS), str(MB_EXAMPLES))} {MB_ROWS}",
    "mb_padding_aware": f"WITH RECURSIVE {pairs_sql()}, {split_sql(str(MB_TOKENS), NONE, padded=True)} {MB_ROWS}",
    "mb_generation": f"WITH RECURSIVE {pairs_sql(f'enc_len + {ALPHA}::DOUBLE * {GENERATION}')}, {split_sql(str(MB_TOKENS), NONE)} {MB_ROWS}",
    "mb_cap": _cap_sql(f"least(count(*) // {MOST_MB} + 1, greatest(greatest(2 * {MB_EXAMPLES}, {MB_EXAMPLES} + 16), {MB_EXAMPLES}))"),
    "mb_cap_proven": _cap_sql(f"least(count(*) // {MOST_MB} + 1, greatest({int(1.5 * PROVEN)}, {MB_EXAMPLES}))"),
    "mb_token_stats": with_stats("SELECT bucket_id, batch_no, mb_no, n, ntok, eff_tokens, lm_tokens FROM stats"),
    "mb_padding_waste": with_stats("SELECT bucket_id, batch_no, mb_no, enc_width, dec_width, (n * enc_width - enc_tokens + n * dec_width - ntok)::BIGINT AS waste FROM stats"),
    "regime_keys": f"WITH RECURSIVE {pairs_sql()} SELECT bucket_id, batch_no, ((trunc(max(eff))::BIGINT + 127) // 128)::INT AS regime_key FROM rows GROUP BY ALL",
    "preflight_lm_head": with_stats("SELECT bucket_id, batch_no, mb_no, CASE WHEN lm_tokens * 256000 > 0.85 * 100000000 THEN 'lm_head' END AS reason, lm_tokens * 256000 > 0.85 * 100000000 AS would_oom FROM stats"),
    "preflight_predictive": with_stats(f"SELECT bucket_id, batch_no, mb_no, CASE WHEN {float(16 << 30)!r}::DOUBLE + 7e7::DOUBLE * eff_tokens > {(80 << 30) * 0.9!r}::DOUBLE THEN 'predicted' END AS reason, {float(16 << 30)!r}::DOUBLE + 7e7::DOUBLE * eff_tokens > {(80 << 30) * 0.9!r}::DOUBLE AS would_oom FROM stats"),
}
QUERIES = {name: globals()[name] for name in SQL}
