"""Losses, text metrics and evaluation plans, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packframe.config import RegimeConfig
from packframe.functions import scalar as S
from packframe.operators import evalplan, metrics, microbatch, regime, sampler
from packframe.plans import packing as P
from packframe.sources import tables as D

MOST_EXAMPLES, FLUSH, CAPACITY = 100, 64, 3000


def losses(spark, sf_dir) -> DataFrame:
    """(bucket_id, batch_no, mb_no, ntok, loss) of microbatches: a loss made of the greatest length."""
    stats = P.mb_statistics(spark, sf_dir)
    return stats.select("bucket_id", "batch_no", "mb_no", "ntok", (F.lit(1.0) + F.pmod(F.col("max_eff").cast("bigint"), F.lit(7)) / 4.0).alias("loss"))


def weighted_loss(spark, sf_dir):
    return metrics.weighted_loss(losses(spark, sf_dir)).select(F.round("loss", 9).alias("loss"))


def mb_weights(spark, sf_dir):
    share = F.col("ntok") / F.sum("ntok").over(Window.partitionBy("bucket_id", "batch_no"))
    kept = losses(spark, sf_dir).filter("ntok > 0")
    return kept.select("bucket_id", "batch_no", "mb_no", F.round(share, 9).alias("weight"), F.round(share * F.col("loss"), 9).alias("weighted_loss"))


def num_items(spark, sf_dir):
    return losses(spark, sf_dir).groupBy("bucket_id", "batch_no").agg(F.sum("ntok").cast("bigint").alias("items"))


def gen_len(spark, sf_dir):
    made = D.examples(spark, sf_dir).select(S.unignored(F.col("labels"), 0).alias("pred_ids"))
    return metrics.generated_length(made, 0).select(F.round("gen_len", 9).alias("gen_len"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(n, 6).alias(n) for n in names])


def bleu_stats(spark, sf_dir):
    return metrics.bleu_statistics(D.predictions(spark, sf_dir), "none")


def bleu_corpus(spark, sf_dir):
    return _rounded(metrics.bleu(D.predictions(spark, sf_dir), "none"), "bleu")


def bleu_13a(spark, sf_dir):
    return _rounded(metrics.bleu(D.predictions(spark, sf_dir), "13a", lower=True), "bleu")


def chrf_stats(spark, sf_dir):
    return metrics.chrf_statistics(D.predictions(spark, sf_dir))


def chrf_corpus(spark, sf_dir):
    return _rounded(metrics.chrf(D.predictions(spark, sf_dir)), "chrf")


def meteor_avg(spark, sf_dir):
    return _rounded(metrics.meteor(D.predictions(spark, sf_dir)), "meteor")


def meteor_english(spark, sf_dir):
    marked = D.predictions(spark, sf_dir).withColumn("english", F.col("example_id") % 3 == 0)
    return _rounded(metrics.meteor(marked, "english"), "meteor")


def compute_metrics(spark, sf_dir):
    """The metrics of predictions cut to 64 words, as an evaluation reports them."""
    cut = D.predictions(spark, sf_dir).select("example_id", *[S.stripped(S.first_words(F.col(c), 64)).alias(c) for c in ("pred", "ref")])
    ids = D.examples(spark, sf_dir).select(S.unignored(F.col("labels"), 0).alias("pred_ids"))
    return metrics.compute_metrics(cut.withColumn("english", F.col("example_id") % 3 == 0), ids, 0, "english")


def meteor_exact(spark, sf_dir):
    """The mean of METEOR's first stage alone, words that are equal."""
    return _rounded(metrics.meteor(D.predictions(spark, sf_dir), stages=(metrics.EXACT,)), "meteor")


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.select("example_id", S.word_count(F.col("pred")).alias("pred_words"), S.word_count(F.col("ref")).alias("ref_words"))


def paired(spark, sf_dir):
    """Predictions joined to references by their example."""
    rows = D.predictions(spark, sf_dir)
    return _counted(metrics.paired(rows, rows, "example_id"))


def paired_by_place(spark, sf_dir):
    """The n-th prediction with the n-th longer source, up to the shorter side's end."""
    rows = D.predictions(spark, sf_dir)
    longer = rows.select("example_id", F.col("source").alias("ref")).filter(S.word_count(F.col("source")) > 8)
    return _counted(metrics.paired(rows, longer))


def evaluation_units(spark, sf_dir):
    """What an evaluation's loss is computed of: whole batches, or microbatches where a batch doesn't fit."""
    rows = evalplan.loss_units(P.packed_pairs(spark, sf_dir), P.MB_TOKENS, CAPACITY)
    return rows.select("bucket_id", "batch_no", "example_id", "mb_no")


def evaluation_flow(spark, sf_dir):
    """Every batch is put in the generation buffer; what becomes of each flush, bucket by bucket, and the limits after it."""
    rows = microbatch.with_effective(P.packed_pairs(spark, sf_dir), P.ALPHA, P.GENERATION)
    each = rows.groupBy("bucket_id", "batch_no").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("eff")).alias("lengths"))
    groups = evalplan.flush_groups(each, FLUSH, ["batch_no"], ["bucket_id"]).groupBy("bucket_id", "flush_no").agg(F.sort_array(F.flatten(F.collect_list("lengths"))).alias("lengths"))
    return evalplan.generation_flow(groups, RegimeConfig(tokens=4096, eval_ramp_every=3), regime.Evaluation(16384, 48, 16), 4 * CAPACITY, keys=["bucket_id"]).drop("lengths")


def _numbered(spark, sf_dir) -> DataFrame:
    """(bucket_id, batch_no, num): batches as an evaluation goes through them, from 1."""
    return sampler.emit_order(P.packed(spark, sf_dir), P.BASE).select("bucket_id", "batch_no", (F.col("emit_pos") + 1).alias("num"))


def stride_sample(spark, sf_dir):
    return evalplan.stride_sample(_numbered(spark, sf_dir), D.table(spark, sf_dir, "documents").count(), MOST_EXAMPLES)


def gen_flush_groups(spark, sf_dir):
    each = sampler.batches(P.packed(spark, sf_dir)).select("bucket_id", "batch_no", "n")
    return evalplan.flush_groups(each, FLUSH, ["batch_no"], ["bucket_id"])


LOSS = "losses AS (SELECT bucket_id, batch_no, mb_no, sum(dec_len)::BIGINT AS ntok, 1.0::DOUBLE + (trunc(max(eff))::BIGINT % 7) / 4.0::DOUBLE AS loss FROM split GROUP BY ALL)"


def losses_sql(tail: str) -> str:
    return f"WITH RECURSIVE {P.pairs_sql()}, {P.split_sql(str(P.MB_TOKENS), P.NONE)}, {LOSS} {tail}"


def _13a(text: str) -> str:
    out = f"' ' || lower({text}) || ' '"
    for plain, new in (("<skipped>", "''"), ("-\n", "''"), ("\n", "' '"), ("&quot;", "'\"'"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'")):
        out = f"replace({out}, '{plain}', {new})"
    for pattern, new in ((r"([\{-\~\[-\x60 -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), ("([0-9])(-)", r"\1 \2 ")):
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return D.SQL_WORDS.format(out)


def bleu_sql(tokens) -> str:
    """CTEs ending in sums(hyp_len, ref_len, hit1 ... all4)."""
    return f"""{D.SQL_PREDICTIONS}, t AS (SELECT example_id, {tokens('pred')} AS a, {tokens('ref')} AS b FROM predictions),
o AS (SELECT *, unnest([1, 2, 3, 4]) AS n FROM t),
ga AS (SELECT example_id, n, gram, count(*) AS c FROM (SELECT example_id, n, unnest(list_transform(range(1, len(a) - n + 2), lambda i: array_to_string(a[i:i + n - 1], chr(1)))) AS gram FROM o) GROUP BY ALL),
gb AS (SELECT example_id, n, gram, count(*) AS c FROM (SELECT example_id, n, unnest(list_transform(range(1, len(b) - n + 2), lambda i: array_to_string(b[i:i + n - 1], chr(1)))) AS gram FROM o) GROUP BY ALL),
hits AS (SELECT n, sum(least(ga.c, gb.c))::BIGINT AS h FROM ga JOIN gb USING (example_id, n, gram) GROUP BY n),
sums AS (SELECT coalesce(sum(len(a)), 0)::BIGINT AS hyp_len, coalesce(sum(len(b)), 0)::BIGINT AS ref_len, {', '.join(f'coalesce((SELECT h FROM hits WHERE n = {n}), 0)::BIGINT AS hit{n}, coalesce(sum(greatest(0, len(a) - {n - 1})), 0)::BIGINT AS all{n}' for n in range(1, 5))} FROM t)"""


def _bleu_tail() -> str:
    """Corpus BLEU of sums; an order without a hit counts as 1 / 2**k, k the number of such orders so far."""
    zeros = ["0"]
    for n in range(1, 5):
        zeros.append(f"{zeros[-1]} + (CASE WHEN hit{n} = 0 AND all{n} > 0 THEN 1 ELSE 0 END)")
    logs = " + ".join(f"(CASE WHEN hit{n} = 0 THEN ln(100.0::DOUBLE / (pow(2, {zeros[n]}) * all{n})) ELSE ln(100.0::DOUBLE * hit{n} / all{n}) END)" for n in range(1, 5))
    brevity = "CASE WHEN hyp_len >= ref_len THEN 1.0::DOUBLE ELSE exp(1.0::DOUBLE - ref_len / hyp_len::DOUBLE) END"
    return f"SELECT round(CASE WHEN hyp_len = 0 OR hit1 = 0 OR all4 = 0 THEN 0.0::DOUBLE ELSE ({brevity}) * exp(({logs}) / 4) END, 6) AS bleu FROM sums"


_CHARS = "regexp_replace({0}, '\\s+', '', 'g')"
CHRF = f"""{D.SQL_PREDICTIONS}, t AS (SELECT example_id, {_CHARS.format('pred')} AS a, {_CHARS.format('ref')} AS b FROM predictions),
o AS (SELECT *, unnest([1, 2, 3, 4, 5, 6]) AS n FROM t),
ga AS (SELECT example_id, n, gram, count(*) AS c FROM (SELECT example_id, n, unnest(list_transform(range(1, length(a) - n + 2), lambda i: substring(a, i, n))) AS gram FROM o) GROUP BY ALL),
gb AS (SELECT example_id, n, gram, count(*) AS c FROM (SELECT example_id, n, unnest(list_transform(range(1, length(b) - n + 2), lambda i: substring(b, i, n))) AS gram FROM o) GROUP BY ALL),
hits AS (SELECT n, sum(least(ga.c, gb.c))::BIGINT AS h FROM ga JOIN gb USING (example_id, n, gram) GROUP BY n),
sums AS (SELECT {', '.join(f'coalesce(sum(greatest(0, length(a) - {n - 1})), 0)::BIGINT AS hyp{n}, coalesce(sum(greatest(0, length(b) - {n - 1})), 0)::BIGINT AS ref{n}, coalesce((SELECT h FROM hits WHERE n = {n}), 0)::BIGINT AS hit{n}' for n in range(1, 7))} FROM t)"""


def _chrf_tail() -> str:
    both = [f"hyp{n} > 0 AND ref{n} > 0" for n in range(1, 7)]
    p = " + ".join(f"(CASE WHEN {c} THEN hit{n} / hyp{n}::DOUBLE ELSE 0 END)" for n, c in enumerate(both, 1))
    r = " + ".join(f"(CASE WHEN {c} THEN hit{n} / ref{n}::DOUBLE ELSE 0 END)" for n, c in enumerate(both, 1))
    k = " + ".join(f"(CASE WHEN {c} THEN 1 ELSE 0 END)" for c in both)
    return f"SELECT round(CASE WHEN k > 0 AND p + r > 0 THEN 500.0::DOUBLE * (p / k) * (r / k) / (4.0::DOUBLE * (p / k) + r / k) ELSE 0.0::DOUBLE END, 6) AS chrf FROM (SELECT {p} AS p, {r} AS r, {k} AS k FROM sums)"


SQL = {
    "weighted_loss": losses_sql("SELECT round(sum(loss * ntok) / sum(ntok), 9) AS loss FROM losses WHERE ntok > 0"),
    "mb_weights": losses_sql("SELECT bucket_id, batch_no, mb_no, round(ntok / z::DOUBLE, 9) AS weight, round(ntok / z::DOUBLE * loss, 9) AS weighted_loss FROM (SELECT *, sum(ntok) OVER (PARTITION BY bucket_id, batch_no) AS z FROM losses WHERE ntok > 0)"),
    "num_items": losses_sql("SELECT bucket_id, batch_no, sum(ntok)::BIGINT AS items FROM losses GROUP BY ALL"),
    "gen_len": f"WITH {D.SQL_EXAMPLES} SELECT round(avg(len(list_filter(labels, lambda x: x <> -100 AND x <> 0))), 9) AS gen_len FROM examples",
    "bleu_stats": f"WITH {bleu_sql(D.SQL_WORDS.format)} SELECT * FROM sums",
    "bleu_corpus": f"WITH {bleu_sql(D.SQL_WORDS.format)} {_bleu_tail()}",
    "bleu_13a": f"WITH {bleu_sql(_13a)} {_bleu_tail()}",
    "chrf_stats": f"WITH {CHRF} SELECT * FROM sums",
    "chrf_corpus": f"WITH {CHRF} {_chrf_tail()}",
    "meteor_exact": f"""WITH {D.SQL_PREDICTIONS}, t AS (SELECT example_id, {D.SQL_WORDS.format('lower(pred)')} AS a, {D.SQL_WORDS.format('lower(ref)')} AS b FROM predictions),
a AS (SELECT *, row_number() OVER (PARTITION BY example_id, w ORDER BY i DESC) AS r FROM (SELECT example_id, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM t)),
b AS (SELECT *, row_number() OVER (PARTITION BY example_id, w ORDER BY j DESC) AS r FROM (SELECT example_id, unnest(b) AS w, generate_subscripts(b, 1) AS j FROM t)),
m AS (SELECT example_id, CASE WHEN i = lag(i) OVER w + 1 AND j = lag(j) OVER w + 1 THEN 0 ELSE 1 END AS begins FROM a JOIN b USING (example_id, w, r) WINDOW w AS (PARTITION BY example_id ORDER BY i)),
s AS (SELECT example_id, count(*)::DOUBLE AS m, sum(begins)::DOUBLE AS chunks FROM m GROUP BY example_id)
SELECT round(avg(CASE WHEN m IS NULL THEN 0 ELSE (m / len(a)) * (m / len(b)) / (0.9::DOUBLE * (m / len(a)) + 0.1::DOUBLE * (m / len(b))) * (1 - 0.5::DOUBLE * pow(chunks / m, 3)) END), 6) AS meteor FROM t LEFT JOIN s USING (example_id)""",
    "paired": f"WITH {D.SQL_PREDICTIONS} SELECT example_id, {D.SQL_COUNT.format('pred')} AS pred_words, {D.SQL_COUNT.format('ref')} AS ref_words FROM predictions",
    "paired_by_place": f"""WITH {D.SQL_PREDICTIONS}, p AS (SELECT example_id, pred, row_number() OVER (ORDER BY example_id) AS n FROM predictions), r AS (SELECT source, row_number() OVER (ORDER BY example_id) AS n FROM predictions WHERE {D.SQL_COUNT.format('source')} > 8)
SELECT example_id, {D.SQL_COUNT.format('pred')} AS pred_words, {D.SQL_COUNT.format('source')} AS ref_words FROM p JOIN r USING (n)""",
    "evaluation_units": f"""WITH RECURSIVE {P.pairs_sql()}, {P.split_sql(str(P.MB_TOKENS), P.NONE)}, z AS (SELECT bucket_id, batch_no, example_id, mb_no, sum(eff) OVER (PARTITION BY bucket_id, batch_no) AS whole, sum(eff) OVER (PARTITION BY bucket_id, batch_no, mb_no) AS one FROM split)
SELECT bucket_id, batch_no, example_id, CASE WHEN whole <= {CAPACITY} THEN 0 ELSE mb_no END AS mb_no FROM z WHERE whole <= {CAPACITY} OR one <= {CAPACITY}""",
    "stride_sample": P.docs_sql(f""", {P.BATCH_SQL}, z AS (SELECT bucket_id, batch_no, row_number() OVER (ORDER BY bucket_id, batch_no) AS num FROM each), st AS (SELECT greatest(1, count(*) // {MOST_EXAMPLES}) AS s FROM documents)
SELECT bucket_id, batch_no, num FROM z, st WHERE s = 1 OR num % s = 1"""),
    "gen_flush_groups": P.docs_sql(f""", {P.BATCH_SQL}, o AS MATERIALIZED (SELECT bucket_id, batch_no, n FROM each),
g AS (SELECT bucket_id, batch_no, n, 0 AS flush_no, n AS held FROM o WHERE batch_no = 0 UNION ALL
  SELECT o.bucket_id, o.batch_no, o.n, CASE WHEN g.held >= {FLUSH} THEN g.flush_no + 1 ELSE g.flush_no END, CASE WHEN g.held >= {FLUSH} THEN o.n ELSE g.held + o.n END FROM g JOIN o ON o.bucket_id = g.bucket_id AND o.batch_no = g.batch_no + 1)
SELECT bucket_id, batch_no, n, flush_no FROM g"""),
}
QUERIES = {name: globals()[name] for name in (*SQL, "meteor_avg", "meteor_english", "compute_metrics", "evaluation_flow")}
