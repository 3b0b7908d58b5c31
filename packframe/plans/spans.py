"""Span corruption of documents, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from packframe.operators import corrupt
from packframe.operators.corrupt import SpanConfig
from packframe.sources import tables as D

CONFIG = SpanConfig()
WIDE = SpanConfig(input_cap=512, target_cap=256)
BATCHES = 64


def _joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


def span_counts(spark, sf_dir):
    noise, count = corrupt.span_counts(F.col("L"), CONFIG)
    return D.lengths(spark, sf_dir).filter("L > 0").select("example_id", "L", noise.alias("noise_n"), count.alias("span_n"))


def span_lengths(spark, sf_dir):
    return corrupt.spans(D.lengths(spark, sf_dir), CONFIG).select("example_id", "noise_n", "span_n", _joined("noise_lens"), _joined("gap_lens"))


def span_corrupt(spark, sf_dir):
    return corrupt.corrupt(D.tokens(spark, sf_dir), CONFIG).select("example_id", _joined("corrupted"), _joined("target"))


def span_batch(spark, sf_dir):
    made = corrupt.corrupt(D.tokens(spark, sf_dir), WIDE).withColumn("batch", F.col("example_id") % BATCHES)
    return corrupt.collate_spans(made, ["batch"], WIDE).select("example_id", "input_length", F.size("attention_mask").alias("width"), _joined("labels"), F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",").alias("input_ids"))


COUNTS = f"""c AS (SELECT *, CASE WHEN L > 0 THEN greatest(1, round_even(L * {CONFIG.density}::DOUBLE, 0)::INT) ELSE 0 END AS noise_n FROM {{0}}),
s AS (SELECT *, CASE WHEN L > 0 THEN greatest(1, round_even(noise_n / {CONFIG.mean}::DOUBLE, 0)::INT) ELSE 0 END AS span_n FROM c)"""


#: Hits are counted with a join rather than a search for each cell.
LENS = f"""n AS (SELECT *, greatest(0, L - noise_n) AS keep FROM s),
k AS (SELECT example_id, 'noise' AS side, span_n AS cells, CASE WHEN noise_n >= span_n THEN noise_n - span_n ELSE 0 END AS items, 1 AS base FROM n WHERE span_n > 0 UNION ALL
  SELECT example_id, 'gap', span_n + 1, CASE WHEN keep >= span_n + 1 THEN keep - span_n - 1 ELSE keep END, CASE WHEN keep >= span_n + 1 THEN 1 ELSE 0 END FROM n WHERE span_n > 0),
x0 AS (SELECT example_id, side, cells, (h + (j + 1) * {corrupt.STEP}) % {corrupt.MASK + 1} AS x FROM (SELECT *, unnest(range(0, items)) AS j FROM (SELECT *, ('0x' || md5('{CONFIG.seed}|' || example_id::VARCHAR || '|' || side)[1:8])::BIGINT AS h FROM k))),
x1 AS (SELECT example_id, side, cells, (xor(x, x >> 16) * {corrupt.TIMES}) % {corrupt.MASK + 1} AS x FROM x0),
hits AS (SELECT example_id, side, xor(x, x >> 16) % cells AS cell, count(*) AS c FROM x1 GROUP BY ALL),
cells AS (SELECT example_id, side, base, unnest(range(0, cells)) AS cell FROM k),
lens AS (SELECT example_id, side, list((base + coalesce(c, 0))::INT ORDER BY cell) AS lens FROM cells LEFT JOIN hits USING (example_id, side, cell) GROUP BY example_id, side),
w AS (SELECT n.*, coalesce(a.lens, []::INT[]) AS noise_lens, coalesce(b.lens, [L::INT]) AS gap_lens FROM n LEFT JOIN lens AS a ON n.example_id = a.example_id AND a.side = 'noise' LEFT JOIN lens AS b ON n.example_id = b.example_id AND b.side = 'gap')"""
SENTINEL = f"({CONFIG.sentinels[0]} - least(i - 1, {len(CONFIG.sentinels) - 1}))::INT"
APPLY = f"""toks AS MATERIALIZED (SELECT doc_id AS example_id, {D.SQL_IDS.format('text')} AS ids FROM documents),
lengths AS (SELECT example_id, len(ids)::INT AS L FROM toks), {COUNTS.format('lengths')}, {LENS},
parts AS (SELECT example_id, span_n, gap_lens, noise_lens, unnest(range(1, span_n + 2)) AS i FROM w),
cut AS (SELECT example_id, span_n, i, gap_lens[i] AS g, coalesce(noise_lens[i], 0) AS m, sum(gap_lens[i] + coalesce(noise_lens[i], 0)) OVER (PARTITION BY example_id ORDER BY i) - gap_lens[i] - coalesce(noise_lens[i], 0) AS pos FROM parts WHERE span_n > 0),
spelt AS (SELECT example_id, i, list_concat(ids[pos + 1:pos + g], CASE WHEN i <= span_n THEN [{SENTINEL}] ELSE []::INT[] END) AS body, CASE WHEN i <= span_n THEN list_concat([{SENTINEL}], ids[pos + g + 1:pos + g + m]) ELSE []::INT[] END AS said FROM cut JOIN toks USING (example_id)),
whole AS (SELECT example_id, flatten(list(body ORDER BY i)) AS corrupted, flatten(list(said ORDER BY i)) AS target FROM spelt GROUP BY example_id),
done AS (SELECT example_id, coalesce(corrupted, []::INT[]) AS corrupted, list_concat(coalesce(target, []::INT[]), [{CONFIG.eos}]) AS target FROM toks LEFT JOIN whole USING (example_id))"""
_CAT = "coalesce(array_to_string({0}, ','), '')"
_PAD = "list_concat({0}, list_transform(range(0, greatest(0, {1} - len({0}))), lambda x: {2}))"
SQL = {
    "span_counts": f"WITH {D.SQL_LENGTHS}, {COUNTS.format('lengths')} SELECT example_id, L, noise_n, span_n FROM s WHERE L > 0",
    "span_lengths": f"WITH {D.SQL_LENGTHS}, {COUNTS.format('lengths')}, {LENS} SELECT example_id, noise_n, span_n, {_CAT.format('noise_lens')} AS noise_lens, {_CAT.format('gap_lens')} AS gap_lens FROM w",
    "span_corrupt": f"WITH {APPLY} SELECT example_id, {_CAT.format('corrupted')} AS corrupted, {_CAT.format('target')} AS target FROM done",
    "span_batch": f"""WITH {APPLY}, capped AS (SELECT example_id, example_id % {BATCHES} AS b, corrupted[:{WIDE.input_cap}] AS i, target[:{WIDE.target_cap}] AS t FROM done),
wide AS (SELECT *, least(ceil(max(len(i)) OVER (PARTITION BY b) / {WIDE.multiple})::INT * {WIDE.multiple}, {WIDE.input_cap}) AS e, least(ceil(max(len(t)) OVER (PARTITION BY b) / {WIDE.multiple})::INT * {WIDE.multiple}, {WIDE.target_cap}) AS d FROM capped)
SELECT example_id, len(list_filter(i, lambda x: x <> {CONFIG.pad}))::INT AS input_length, e::INT AS width, {_CAT.format(_PAD.format('t', 'd', -100))} AS labels, {_CAT.format(_PAD.format('i', 'e', CONFIG.pad))} AS input_ids FROM wide""",
}
QUERIES = {name: globals()[name] for name in SQL}
