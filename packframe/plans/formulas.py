"""Sizing formulas, memory figures and text predicates over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from packframe.config import EDGES, TIERS
from packframe.functions import scalar as S
from packframe.sources import tables as D

GIB = 1 << 30
TOTAL = 80 * GIB


def _vocabularies(spark, sf_dir):
    """(id, vocab): sizes from 0 to 600000, with nulls."""
    return D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 50 != 0, F.col("p_partkey") * 1379 % 600000).alias("vocab"))


SQL_VOCAB = "v AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 <> 0 THEN p_partkey * 1379 % 600000 END AS vocab FROM part)"


def decoder_alpha(spark, sf_dir):
    return _vocabularies(spark, sf_dir).select("id", F.round(S.decoder_alpha(F.col("vocab")), 9).alias("alpha"))


def lm_head_bytes(spark, sf_dir):
    return _vocabularies(spark, sf_dir).select("id", S.lm_head_bytes(F.col("id") % 4096, F.coalesce("vocab", F.lit(0)), F.col("id") % 2 == 0).alias("bytes"))


def vram_tiers(spark, sf_dir):
    gigabytes = F.pmod(F.col("c_custkey"), F.lit(97)).cast("double")
    return D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), *[S.tier(name, gigabytes).alias(name) for name in TIERS])


def kv_gen_batch(spark, sf_dir):
    orders = D.table(spark, sf_dir, "orders")
    n = lambda x: F.lit(x).cast("int")
    fits = S.generation_examples(F.lit(8 * GIB), (F.col("o_custkey") % 512 + 1).cast("int"), n(128), n(12), n(768), n(12), n(64), n(2), F.col("o_orderkey") % 2 == 0)
    return orders.select(F.col("o_orderkey").alias("id"), fits.alias("examples"))


def _memory(spark, sf_dir):
    """(id, baseline, peak, cost, tokens) of orders."""
    k = F.col("o_orderkey")
    return D.table(spark, sf_dir, "orders").select(
        k.alias("id"), (k % 90 * GIB).alias("baseline"), ((k % 90 + k % 7) * GIB).alias("peak"), F.floor(F.col("o_totalprice")).cast("bigint").alias("cost"), (k * 131 % 200000).alias("tokens"),
    )


SQL_MEMORY = f"""m AS (SELECT o_orderkey AS id, o_orderkey % 90 * {GIB} AS baseline, (o_orderkey % 90 + o_orderkey % 7) * {GIB} AS peak, floor(o_totalprice)::BIGINT AS cost, o_orderkey * 131 % 200000 AS tokens FROM orders),
h AS (SELECT *, greatest(({TOTAL} - baseline)::DOUBLE, {TOTAL}::DOUBLE * 0.05::DOUBLE) AS room FROM m)"""


def safe_floor(spark, sf_dir):
    return _memory(spark, sf_dir).select("id", S.safe_floor(F.lit(TOTAL), F.col("baseline"), F.col("cost").cast("double"), 64).alias("floor_tokens"))


def bytes_per_token(spark, sf_dir):
    return _memory(spark, sf_dir).select("id", F.round(S.bytes_per_token(F.lit(TOTAL), F.col("baseline"), F.col("peak"), F.col("tokens")), 3).alias("cost"))


def autotune_target(spark, sf_dir):
    tuned = S.autotuned_tokens(F.lit(TOTAL), F.col("baseline"), F.col("peak"), F.col("tokens"), 0.75, 64, 1_000_000)
    return _memory(spark, sf_dir).filter("peak > 0 AND tokens > 0").select("id", tuned.alias("tokens"))


#: What a step said, and by hand its class and whether state is saved.
MESSAGES = {
    "error": ("RuntimeError: CUDA out of memory. Tried to allocate", "memory", True),
    "click": ("cudaErrorLaunchTimeout in a kernel", "device", True),
    "view": ("RuntimeError: CUDA error: device-side assert", "device", True),
    "signup": ("cudaMalloc failed", "memory", False),
    "purchase": ("the host ran out of memory; cuda error; launch timed out", "other", False),
}


def oom_classify(spark, sf_dir):
    table = F.create_map(*[F.lit(x) for event, (said, _, _) in MESSAGES.items() for x in (event, said)])
    said = D.table(spark, sf_dir, "events").select("event_id", F.try_element_at(table, F.col("event_type")).alias("said"))
    return said.select("event_id", S.oom_class(F.col("said")).alias("kind"), S.worth_saving(F.col("said")).alias("save"))


def eval_mode(spark, sf_dir):
    modes = F.array(*[F.lit(x) for x in (" HF", "Auto", "token_aware_loss ", "TOKEN_AWARE_METRICS", "other")])
    return D.table(spark, sf_dir, "nation").select("n_nationkey", S.eval_mode(F.get(modes, F.col("n_nationkey") % 5)).alias("mode"))


def metric_alias(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in (" SacreBLEU", "bleu-1", "chrF++", "chr_f", "METEOR", "comet")])
    return D.table(spark, sf_dir, "nation").select("n_nationkey", S.metric_name(F.get(names, F.col("n_nationkey") % 6)).alias("metric"))


def postprocess(spark, sf_dir):
    turns = D.table(spark, sf_dir, "conversations")
    framed = F.concat(F.lit(" \t\n"), F.coalesce("text", F.lit("")), F.lit("\n  "))
    listed = F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(framed, F.lit("second")))
    return turns.select("conv_id", "turn", S.stripped(framed).alias("stripped"), S.first_label(listed).alias("label"))


def truncate_words(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", S.first_words(F.col("text"), 64).alias("head"))


def _prompts(spark, sf_dir):
    """(example_id, prompt): a third each asks for English, for another language, and has none."""
    asked = F.when(F.col("example_id") % 3 == 0, F.concat(F.lit("Translate Akkadian TO English: "), F.col("source"))).when(F.col("example_id") % 3 == 1, F.concat(F.lit("to english: "), F.col("source")))
    return D.pair_texts(spark, sf_dir).select("example_id", asked.alias("prompt"))


SQL_PROMPTS = f"{D.SQL_PAIR_TEXTS}, p AS (SELECT example_id, CASE example_id % 3 WHEN 0 THEN 'Translate Akkadian TO English: ' || source WHEN 1 THEN 'to english: ' || source END AS prompt FROM pair_texts)"
SQL_ENGLISH = "coalesce(contains(lower(prompt), ' to english') OR contains(lower(prompt), ' into english') OR contains(lower(prompt), 'english translation'), false)"


def english_target(spark, sf_dir):
    return _prompts(spark, sf_dir).select("example_id", S.english_target(F.col("prompt")).alias("english"))


def meteor_mask(spark, sf_dir):
    return _prompts(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(S.english_target(F.col("prompt")), 1)).alias("scored"))


def unignored_labels(spark, sf_dir):
    out = D.examples(spark, sf_dir).select("example_id", S.unignored(F.col("labels"), 0).alias("l"))
    return out.select("example_id", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("labels"))


def _tiers(name: str) -> str:
    values = TIERS[name]
    kind = "INT" if isinstance(values[0], int) else "DOUBLE"
    whens = " ".join(f"WHEN c_custkey % 97 >= {edge} THEN {value}::{kind}" for edge, value in zip(EDGES, values))
    return f"CASE {whens} ELSE {values[3]}::{kind} END AS {name}"


_MODE = "[' HF', 'Auto', 'token_aware_loss ', 'TOKEN_AWARE_METRICS', 'other'][n_nationkey % 5 + 1]"
_NAME = "lower(trim([' SacreBLEU', 'bleu-1', 'chrF++', 'chr_f', 'METEOR', 'comet'][n_nationkey % 6 + 1]))"
_CAT = "coalesce(array_to_string({0}, ','), '')"
_KV = "12::BIGINT * (CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 512 + 1 + 128 ELSE 128 END) * (2 * 12 * 64 * 2) + 4 * 12 * 768 * 2"
_COST = "greatest((peak - baseline)::DOUBLE, room * 0.05::DOUBLE) / tokens::DOUBLE"
SQL = {
    "decoder_alpha": f"WITH {SQL_VOCAB} SELECT id, round(CASE WHEN vocab IS NULL OR vocab <= 64000 THEN 2.0::DOUBLE WHEN vocab <= 128000 THEN 4.0::DOUBLE ELSE least(16.0::DOUBLE, 2.0::DOUBLE * sqrt(vocab::DOUBLE / 32000.0::DOUBLE)) END, 9) AS alpha FROM v",
    "lm_head_bytes": f"WITH {SQL_VOCAB} SELECT id, CASE WHEN coalesce(vocab, 0) > 64000 AND id % 4096 > 0 THEN (id % 4096)::BIGINT * vocab * (CASE WHEN id % 2 = 0 THEN 2 ELSE 4 END) ELSE 0 END::BIGINT AS bytes FROM v",
    "vram_tiers": f"SELECT c_custkey AS id, {', '.join(map(_tiers, TIERS))} FROM customer",
    "kv_gen_batch": f"SELECT o_orderkey AS id, greatest(1, floor({8 * GIB}::DOUBLE * 0.85::DOUBLE / ({_KV})::DOUBLE)::BIGINT) AS examples FROM orders",
    "safe_floor": f"WITH {SQL_MEMORY} SELECT id, CASE WHEN cost > 0 THEN greatest(64, trunc(0.66::DOUBLE * room / cost::DOUBLE)::BIGINT) ELSE 64 END::BIGINT AS floor_tokens FROM h",
    "bytes_per_token": f"WITH {SQL_MEMORY} SELECT id, CASE WHEN peak > 0 AND tokens > 0 THEN round({_COST}, 3) END AS cost FROM h",
    "autotune_target": f"WITH {SQL_MEMORY} SELECT id, greatest(64, least(1000000, trunc(0.75::DOUBLE * room / greatest({_COST}, 1e-9::DOUBLE))::BIGINT))::BIGINT AS tokens FROM h WHERE peak > 0 AND tokens > 0",
    "oom_classify": f"SELECT event_id, CASE event_type {' '.join(f"WHEN '{e}' THEN '{kind}'" for e, (_, kind, _) in MESSAGES.items())} ELSE 'other' END AS kind, coalesce(event_type IN ({', '.join(f"'{e}'" for e, (_, _, save) in MESSAGES.items() if save)}), false) AS save FROM events",
    "eval_mode": f"SELECT n_nationkey, CASE WHEN lower(trim({_MODE})) IN ('hf', 'auto', 'token_aware_loss', 'token_aware_metrics') THEN lower(trim({_MODE})) END AS mode FROM nation",
    "metric_alias": f"SELECT n_nationkey, CASE WHEN {_NAME} IN ('sacrebleu', 'bleu1', 'bleu-1') THEN 'bleu' WHEN {_NAME} IN ('chr_f', 'chrf++', 'chrfpp') THEN 'chrf' ELSE {_NAME} END AS metric FROM nation",
    "postprocess": "SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS stripped, CASE WHEN turn % 3 = 0 THEN '' ELSE regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') END AS label FROM conversations",
    "truncate_words": f"SELECT doc_id, coalesce(array_to_string(({D.SQL_WORDS.format('text')})[:64], ' '), '') AS head FROM documents",
    "english_target": f"WITH {SQL_PROMPTS} SELECT example_id, {SQL_ENGLISH} AS english FROM p",
    "meteor_mask": f"WITH {SQL_PROMPTS} SELECT count(*) AS n, count(*) FILTER ({SQL_ENGLISH}) AS scored FROM p",
    "unignored_labels": f"WITH {D.SQL_EXAMPLES} SELECT example_id, {_CAT.format('list_transform(labels, lambda x: CASE WHEN x = -100 THEN 0 ELSE x END)')} AS labels FROM examples",
}
QUERIES = {name: globals()[name] for name in SQL}
