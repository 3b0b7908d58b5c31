"""Example tables derived from the test tables.

documents stand for pre-training examples, pairs of turns of conversations for
sequence-to-sequence examples, events for a step log.  Each scan reads only the
columns that it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packframe.functions.scalar import IGNORE, word_count, words

VOCAB, ALPHA = 32000, 2.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id, L) of documents."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"), word_count(F.col("text")).alias("L"))


def token_ids(text: Column) -> Column:
    """Ids from 2, below the sentinels, by md5: a vocabulary without a table."""
    return F.transform(words(text), lambda w: (F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("bigint") % 31000 + 2).cast("int"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id, input_ids) of documents."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("example_id"), token_ids(F.col("text")).alias("input_ids"))


def pair_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id, source, reference): a user's turn and the assistant's answer that follows it."""
    turns = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = turns.withColumn("r2", F.lead("role").over(w)).withColumn("t2", F.lead("text").over(w))
    return nxt.filter("role = 'user' AND r2 = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("example_id"), F.col("text").alias("source"), F.col("t2").alias("reference"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id, enc_len, dec_len)."""
    return pair_texts(spark, sf_dir).select("example_id", word_count(F.col("source")).alias("enc_len"), word_count(F.col("reference")).alias("dec_len"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id, input_ids, attention_mask, labels, task): every fifth label is ignored."""
    ids = pair_texts(spark, sf_dir).select("example_id", token_ids(F.col("source")).alias("input_ids"), token_ids(F.col("reference")).alias("l"))
    labels = F.transform("l", lambda x, i: F.when(i % 5 == 4, F.lit(IGNORE)).otherwise(x))
    return ids.select("example_id", "input_ids", F.transform("input_ids", lambda x: F.lit(1)).alias("attention_mask"), labels.alias("labels"), F.lit("chat").alias("task"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(example_id, source, pred, ref): the prediction is the reference less a tenth of its words, by md5."""
    said = pair_texts(spark, sf_dir).select("example_id", "source", F.col("reference").alias("ref"), words(F.col("reference")).alias("w"))
    keep = F.filter("w", lambda x, i: F.conv(F.substring(F.md5(F.concat_ws("|", F.col("example_id").cast("string"), i.cast("string"))), 1, 6), 16, 10).cast("bigint") % 10 != 0)
    return said.select("example_id", "source", F.array_join(keep, " ").alias("pred"), "ref")


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, step, regime_key, outcome, shrink_b, util, plan_ms, exec_ms, total_ms, ts_ms, end_ms, tokens, examples, microbatches) of events.

    A run is 64 users' events; a step takes its event's value in place of time.
    """
    events = table(spark, sf_dir, "events")
    ts = F.unix_millis(F.col("ts").cast("timestamp"))
    exec_ms = F.coalesce("value", F.lit(0.0)) * 10.0 + 1.0
    return events.select(
        F.floor(F.col("user_id") / 64).alias("run"), F.col("event_id").alias("step"), (F.col("user_id") % 8).cast("int").alias("regime_key"),
        F.when(F.col("event_type") == "error", "oom").otherwise("ok").alias("outcome"), (F.col("event_id") % 2 == 0).alias("shrink_b"),
        F.get_json_object("props", "$.k").cast("double").alias("util"), exec_ms.alias("exec_ms"), ts.cast("double").alias("ts_ms"), (ts.cast("double") + exec_ms).alias("end_ms"),
        (F.floor(F.coalesce("value", F.lit(0.0)) * 100) + 1).alias("tokens"), (F.col("event_id") % 16 + 1).alias("examples"), (F.col("event_id") % 5 + 1).alias("microbatches"),
        (F.col("event_id") % 7).cast("double").alias("plan_ms"), (exec_ms + (F.col("event_id") % 7).cast("double")).alias("total_ms"),
    )


#: The same derivations as DuckDB common table expressions.
SQL_WORDS = "list_filter(regexp_split_to_array({0}, '[ \\t\\r\\n]+'), lambda w: w <> '')"
SQL_COUNT = "len(regexp_extract_all({0}, '[^ \\t\\r\\n]+'))::INT"
SQL_IDS = "list_transform(list_filter(regexp_split_to_array({0}, '[ \\t\\r\\n]+'), lambda w: w <> ''), lambda w: (('0x' || md5(w)[1:6])::BIGINT % 31000 + 2)::INT)"
SQL_LENGTHS = f"lengths AS (SELECT doc_id AS example_id, {SQL_COUNT.format('text')} AS L FROM documents)"
SQL_PAIR_TEXTS = """pair_texts AS (SELECT conv_id * 1000 + turn AS example_id, text AS source, t2 AS reference FROM (
  SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r2 = 'assistant')"""
SQL_PAIRS = f"{SQL_PAIR_TEXTS}, pairs AS (SELECT example_id, {SQL_COUNT.format('source')} AS enc_len, {SQL_COUNT.format('reference')} AS dec_len FROM pair_texts)"
SQL_EXAMPLES = f"""{SQL_PAIR_TEXTS}, examples AS (SELECT example_id, input_ids, list_transform(input_ids, lambda x: 1) AS attention_mask, list_transform(l, lambda x, i: CASE WHEN (i - 1) % 5 = 4 THEN {IGNORE} ELSE x END) AS labels, 'chat' AS task
  FROM (SELECT example_id, {SQL_IDS.format('source')} AS input_ids, {SQL_IDS.format('reference')} AS l FROM pair_texts))"""
SQL_PREDICTIONS = f"""{SQL_PAIR_TEXTS}, predictions AS (SELECT example_id, source, coalesce(array_to_string(list_filter(w, lambda x, i: ('0x' || md5(example_id::VARCHAR || '|' || (i - 1)::VARCHAR)[1:6])::BIGINT % 10 <> 0), ' '), '') AS pred, reference AS ref
  FROM (SELECT *, {SQL_WORDS.format('reference')} AS w FROM pair_texts))"""
SQL_LOG = """log AS (SELECT user_id // 64 AS run, event_id AS step, (user_id % 8)::INT AS regime_key, CASE WHEN event_type = 'error' THEN 'oom' ELSE 'ok' END AS outcome, event_id % 2 = 0 AS shrink_b,
  json_extract_string(props, '$.k')::DOUBLE AS util, coalesce(value, 0) * 10.0::DOUBLE + 1.0::DOUBLE AS exec_ms, (epoch_us(ts) // 1000)::DOUBLE AS ts_ms, (epoch_us(ts) // 1000)::DOUBLE + (coalesce(value, 0) * 10.0::DOUBLE + 1.0::DOUBLE) AS end_ms,
  floor(coalesce(value, 0) * 100)::BIGINT + 1 AS tokens, event_id % 16 + 1 AS examples, event_id % 5 + 1 AS microbatches, (event_id % 7)::DOUBLE AS plan_ms, (coalesce(value, 0) * 10.0::DOUBLE + 1.0::DOUBLE) + (event_id % 7)::DOUBLE AS total_ms FROM events)"""
