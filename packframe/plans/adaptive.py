"""Adaptive limits, their persistence, and step-log telemetry, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packframe.config import RegimeConfig
from packframe.operators import regime, telemetry
from packframe.plans import packing as P
from packframe.sources import state
from packframe.sources import tables as D

CONFIG = RegimeConfig(tokens=4096, examples=64)
RUN, ORDER = ["run"], ["step"]
RING = 5000
TIMES = ("mean_plan", "mean_exec", "mean_total", "mean_gap", "idle_pct", "mean_examples", "mean_tokens", "mean_microbatches", "utilisation")


START = regime.Regime(T=CONFIG.tokens, B=CONFIG.examples, adaptive_ramps=3)


def _log(spark, sf_dir) -> DataFrame:
    """The step log with attempts 0 to 3, partial failures, utilisation and memory figures."""
    log = D.step_log(spark, sf_dir)
    at, failed = F.col("step"), F.col("outcome") == "oom"
    gib = F.lit(1 << 30).cast("bigint")
    return log.withColumns({
        "attempt": (F.floor(at / 3) % 4).cast("int"), "outcome": F.when(failed & (at % 8 == 0), "partial").when(failed & (at % 4 == 0), "oom").otherwise("ok"), "shrink_b": F.floor(at / 16) % 2 == 0,
        "util20": F.when(at % 5 != 0, (at % 97).cast("double")), "peak": gib * (20 + at % 40), "baseline": gib * 16, "total": gib * 80, "max_mb_eff": F.col("tokens"),
    })


def _replayed(spark, sf_dir) -> DataFrame:
    return regime.replay(_log(spark, sf_dir), CONFIG, run=("run",), start=START)


def _said(replayed: DataFrame, *names: str) -> DataFrame:
    return replayed.select(*names, *[F.round(f.name, 3).alias(f.name) if f.name == "bytes_per_token" else F.col(f.name) for f in regime.STATE])


def regime_fold(spark, sf_dir):
    return _said(_replayed(spark, sf_dir), "run", "regime_key", "step", "attempt")


def regime_final(spark, sf_dir):
    return _said(regime.final_states(_replayed(spark, sf_dir), run=("run",)), "run", "regime_key")


def regime_limits_lookup(spark, sf_dir):
    joined = regime.limits(P.regime_keys(spark, sf_dir), _states(spark, sf_dir), CONFIG)
    return joined.select("bucket_id", "batch_no", "regime_key", "limit_T", "limit_B")


def eval_fold(spark, sf_dir):
    log = D.step_log(spark, sf_dir).select("run", "step", "outcome")
    return regime.eval_replay(log, RegimeConfig(tokens=4096, eval_ramp_every=3), regime.Evaluation(2048, 32, 16), RUN, ORDER)


RECORD_LONGS = ("step", "gpu_temp_c", "examples", "tokens", "eff_tok", "n_mb", "max_mb_tok", "rk", "rT", "rB", "hwm_T", "stable", "ooms")


def _states(spark, sf_dir) -> DataFrame:
    """A state for each nation: what a run left behind."""
    k = F.col("n_nationkey")
    big = lambda c: c.cast("bigint")
    return D.table(spark, sf_dir, "nation").select(
        k.cast("int").alias("regime_key"), big(256 + k * 64).alias("T"), big(F.when(k % 3 != 0, k + 8)).alias("B"), big(k % 7).alias("stable"), big(F.when(k % 2 == 0, 300 + k * 70)).alias("hwm_T"), big(F.when(k % 5 == 0, k + 9)).alias("hwm_B"),
        F.when(k % 4 == 0, k * 1000.5).cast("double").alias("bytes_per_token"), big(k % 3).alias("adaptive_ramps"), big(F.lit(1)).alias("util_attempts"), big(k % 4).alias("oom_count"), (k % 2 == 1).alias("tuned"),
    )


def regime_json_roundtrip(spark, sf_dir):
    """States as one JSON document, and as a reader gets them back."""
    text = state.as_document(_states(spark, sf_dir)).select(F.to_json(F.struct("*")).alias("j"))
    return state.from_document(text.select(F.from_json("j", state.DOCUMENT).alias("d")).select("d.*"))


def regime_seed(spark, sf_dir):
    return state.seeded(_states(spark, sf_dir), adaptive=True)


def regime_summary(spark, sf_dir):
    return state.summary(_states(spark, sf_dir))


def util_rolling20(spark, sf_dir):
    return telemetry.rolling_utilisation(D.step_log(spark, sf_dir), RUN, ORDER).select("run", "step", F.round("util20", 6).alias("util20"))


def step_gap(spark, sf_dir):
    return telemetry.gaps(D.step_log(spark, sf_dir), RUN, ORDER).select("run", "step", F.round("gap_ms", 3).alias("gap_ms"))


def timing_100(spark, sf_dir):
    means = telemetry.timing_means(telemetry.gaps(D.step_log(spark, sf_dir), RUN, ORDER), RUN, ORDER)
    return means.select("run", "window_no", "steps", *[F.round(c, 4).alias(c) for c in TIMES])


def slow_steps(spark, sf_dir):
    return telemetry.slow_steps(D.step_log(spark, sf_dir), RUN, ORDER).select("run", "step", "step_no", "base_ms", "slow")


def slow_streaks(spark, sf_dir):
    made = telemetry.slow_streaks(D.step_log(spark, sf_dir), RUN, ORDER, factor=3.0, floor_ms=500.0, fire_ms=4000.0)
    return made.select("run", "step", F.round("streak_ms", 3).alias("streak_ms"), "fired")


def diag_ring(spark, sf_dir):
    return telemetry.ring(D.step_log(spark, sf_dir).select("step", "run", "outcome"), "step", RING)


def _diagnosed(spark, sf_dir) -> DataFrame:
    """The step log with every column that a record has a field for."""
    log = telemetry.recent_utilisation(telemetry.gaps(D.step_log(spark, sf_dir), RUN, ORDER), RUN, ORDER)
    at, k = F.col("step"), F.col("regime_key").cast("bigint")
    return log.withColumns({
        "ts": F.col("ts_ms") / 1000.0, "mem_alloc_gb": at % 9000 / 1024.0, "mem_peak_gb": at % 8000 / 125.0, "power_w": at % 3000 / 8.0, "temp_c": at % 90, "cpu_load": at % 640 / 16.0, "cpu_pct": at % 1000 / 10.0, "ram_pct": at % 999 / 10.0,
        "eff_tokens": F.col("tokens") * 2, "max_mb_eff": F.col("tokens"), "T": k * 64 + 256, "B": F.when(k % 3 != 0, k + 8), "hwm_T": F.when(k % 2 == 0, k * 70 + 300), "stable": k % 7, "bytes_per_token": F.when(k % 4 == 0, k * 1000.3), "ooms": at % 4,
    })


def diag_records(spark, sf_dir):
    """The records, as a reader of their JSON gets them back."""
    kinds = ", ".join(f"{name} {'string' if name == 'outcome' else 'bigint' if name in RECORD_LONGS else 'double'}" for name in telemetry.FIELDS)
    return telemetry.records(_diagnosed(spark, sf_dir)).select(F.from_json("record", kinds).alias("r")).select("r.*")


def baseline_mem(spark, sf_dir):
    return telemetry.baseline_memory(D.step_log(spark, sf_dir), "regime_key", "step", "exec_ms", 500)


def bottleneck_device(spark, sf_dir):
    k = F.col("s_suppkey")
    devices = D.table(spark, sf_dir, "supplier").select((k % 5).alias("host"), k.alias("device"), (F.lit(80000) - k % 3 * 8000).alias("total"), (k * 7919 % 70000 * (k % 4)).alias("peak"), (k % 9000).alias("baseline"))
    return telemetry.bottleneck(devices, ["host"])


def throughput(spark, sf_dir):
    made = telemetry.throughput(D.step_log(spark, sf_dir), RUN)
    return made.select("run", *[F.round(c, 6).alias(c) for c in ("runtime", "samples_per_second", "steps_per_second")])


NATION = """st AS (SELECT n_nationkey AS k, n_nationkey::INT AS regime_key, (256 + n_nationkey * 64)::BIGINT AS T, (CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey + 8 END)::BIGINT AS B, (n_nationkey % 7)::BIGINT AS stable,
  (CASE WHEN n_nationkey % 2 = 0 THEN 300 + n_nationkey * 70 END)::BIGINT AS hwm_T, (CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey + 9 END)::BIGINT AS hwm_B, CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey * 1000.5::DOUBLE END AS bytes_per_token,
  (n_nationkey % 4)::BIGINT AS oom_count, n_nationkey % 2 = 1 AS tuned FROM nation)"""

#: A failure shrinks the first of G, T, B that gives way, by the ladder of the marks.
_LADDER = "CASE WHEN {h} > 0 AND {x} > {h} THEN {h} WHEN {h} > 0 AND {x} > trunc({h} * 0.85::DOUBLE)::BIGINT THEN greatest({low}, trunc({h} * 0.85::DOUBLE)::BIGINT) ELSE greatest({low}, trunc({x} * {f}::DOUBLE)::BIGINT) END"


def _eval_fold_sql() -> str:
    """The recursion of an evaluation's limits: marks first, then growth, recovery or shrinking."""
    new_g = _LADDER.format(x="G", h="coalesce(mG, 0)", low=1, f=0.5)
    new_t = _LADDER.format(x="T", h="coalesce(mT, 0)", low=64, f=0.85)
    below = "((coalesce(mT, 0) > 0 AND T < trunc(mT * 0.9::DOUBLE)::BIGINT) OR (coalesce(mG, 0) > 0 AND G < trunc(mG * 0.9::DOUBLE)::BIGINT))"
    return f"""WITH RECURSIVE {D.SQL_LOG}, l AS MATERIALIZED (SELECT run, step, outcome = 'ok' AS ok, outcome, row_number() OVER (PARTITION BY run ORDER BY step) AS rn FROM log),
f(run, rn, step, outcome, T, G, B, stable, hwm_T, hwm_G) AS (
  SELECT run, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, 2048::BIGINT, 32::BIGINT, 16::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT run FROM l)
  UNION ALL
  SELECT run, rn, step, outcome,
    CASE WHEN ok THEN CASE WHEN {below} THEN CASE WHEN s % 3 = 0 AND coalesce(mT, 0) > 0 AND T < mT THEN greatest(64, least(trunc(T * 1.2::DOUBLE)::BIGINT, mT)) ELSE T END
        WHEN s % 3 = 0 THEN greatest(64, least(trunc(T * 1.05::DOUBLE)::BIGINT, 4096)) ELSE T END
      WHEN G > 1 AND ng <> G THEN T WHEN T > 64 AND nt < T THEN nt ELSE T END,
    CASE WHEN ok THEN CASE WHEN {below} AND s % 3 = 0 AND coalesce(mG, 0) > 0 AND G < mG THEN greatest(1, least(trunc(G * 1.2::DOUBLE)::BIGINT + 1, mG)) ELSE G END WHEN G > 1 AND ng <> G THEN ng ELSE G END,
    CASE WHEN NOT ok AND NOT (G > 1 AND ng <> G) AND NOT (T > 64 AND nt < T) AND B > 1 AND nb < B THEN nb ELSE B END,
    CASE WHEN ok THEN s ELSE 0 END, mT, mG
  FROM (SELECT *, {new_g} AS ng, {new_t} AS nt, greatest(1, trunc(B * 0.5::DOUBLE)::BIGINT) AS nb
    FROM (SELECT l.run, l.rn, l.step, l.outcome, l.ok, f.T, f.G, f.B, CASE WHEN l.ok THEN f.stable + 1 ELSE f.stable END AS s,
      CASE WHEN (CASE WHEN l.ok THEN f.stable + 1 >= 5 ELSE f.stable >= 3 END) THEN greatest(f.T, coalesce(f.hwm_T, 0)) ELSE f.hwm_T END AS mT,
      CASE WHEN (CASE WHEN l.ok THEN f.stable + 1 >= 5 ELSE f.stable >= 3 END) THEN greatest(f.G, coalesce(f.hwm_G, 0)) ELSE f.hwm_G END AS mG
      FROM f JOIN l ON l.run = f.run AND l.rn = f.rn + 1)))
SELECT run, step, outcome, T, G, B, stable, hwm_T, hwm_G FROM f WHERE rn > 0"""


def _regime_sql(tail: str) -> str:
    """The recursion of all regimes' limits in a run: st holds a state for each regime, of which a row changes one."""
    c = CONFIG
    whole = lambda x: f"trunc({x})::BIGINT"
    t_range = lambda x: f"greatest({c.min_tokens}, least({x}, {c.top_tokens}))"
    b_range = lambda x: f"greatest({c.min_examples}, least({x}, {c.top_examples}))"
    ramped = f"(NOT below AND ra > 0 AND n >= {c.ramp_every})"
    judged = f"(NOT below AND NOT {ramped} AND util20 IS NOT NULL AND n >= 20)"
    wider = t_range(whole("T * 1.05::DOUBLE"))
    widened = f"({judged} AND util20 < 50 AND ua < 10 AND {wider} <> T)"
    first = f"{{'T': {START.T}::BIGINT, 'B': {START.B}::BIGINT, 'stable': 0::BIGINT, 'hT': NULL::BIGINT, 'hB': NULL::BIGINT, 'bpt': NULL::DOUBLE, 'ra': {START.adaptive_ramps}::BIGINT, 'ua': 0::BIGINT, 'oom': 0::BIGINT, 'tuned': false}}"
    down = lambda x, h, f, low: _LADDER.format(x=x, h=f"coalesce({h}, 0)", low=low, f=f)
    return f"""WITH RECURSIVE {D.SQL_LOG}, r AS MATERIALIZED (SELECT run, step, (step // 3 % 4)::INT AS attempt, regime_key AS k, CASE WHEN outcome = 'oom' AND step % 8 = 0 THEN 'partial' WHEN outcome = 'oom' AND step % 4 = 0 THEN 'oom' ELSE 'ok' END AS outcome,
  step // 16 % 2 = 0 AS shrink_b, CASE WHEN step % 5 <> 0 THEN (step % 97)::DOUBLE END AS util20, {1 << 30}::BIGINT * (20 + step % 40) AS peak, {16 << 30}::BIGINT AS baseline, {80 << 30}::BIGINT AS total, tokens AS tok, row_number() OVER (PARTITION BY run ORDER BY step) AS rn FROM log),
f AS (SELECT run, 0::BIGINT AS rn, 0::INT AS k, NULL::BIGINT AS step, NULL::INT AS attempt, list_transform(range(0, 8), lambda i: {first}) AS st FROM (SELECT DISTINCT run FROM r)
  UNION ALL
  SELECT run, rn, k, step, attempt, list_transform(st, lambda x, i: CASE WHEN i = k + 1 THEN new ELSE x END) FROM (
  SELECT *, {{'T': CASE WHEN ok THEN CASE WHEN tn THEN tT ELSE T1 END WHEN sb THEN T ELSE greatest(least_T, {down('T', 'hT1', 0.85, 'least_T')}) END, 'B': CASE WHEN ok THEN B1 WHEN NOT sb THEN B WHEN B IS NULL THEN {c.top_examples} ELSE {down('B', 'hB1', 0.7, c.min_examples)} END,
    'stable': CASE WHEN ok THEN n1 ELSE 0 END, 'hT': CASE WHEN tn THEN greatest(tT, coalesce(hT1, 0)) ELSE hT1 END, 'hB': hB1, 'bpt': CASE WHEN tn THEN cost WHEN ok THEN bpt END, 'ra': CASE WHEN ok THEN ra1 ELSE 0 END, 'ua': CASE WHEN ok THEN ua1 ELSE 0 END,
    'oom': CASE WHEN ok THEN oom ELSE oom + 1 END, 'tuned': CASE WHEN tn THEN true WHEN ok THEN tuned ELSE false END}} AS new
  FROM (SELECT *, ok AND attempt = 0 AND (NOT tuned OR n1 % 500 = 0) AND NOT (oom > 0 AND tok < 0.1::DOUBLE * coalesce(hT1, 0)) AND peak > 0 AND tok > 0 AS tn,
    {t_range(whole(f"(CASE WHEN oom > 0 THEN {c.autotune_oom_safety} ELSE {c.autotune_safety} END)::DOUBLE * room / greatest(cost, 1e-9::DOUBLE)"))} AS tT,
    CASE WHEN dearest > 0 THEN greatest({c.min_tokens}, {whole("0.66::DOUBLE * room / greatest(dearest, 1e-9::DOUBLE)")}) ELSE {c.min_tokens} END AS least_T
  FROM (SELECT *, greatest((peak - baseline)::DOUBLE, room * 0.05::DOUBLE) / tok::DOUBLE AS cost, coalesce(list_max(list_transform(st, lambda x, i: CASE WHEN i <> k + 1 THEN x.bpt END)), 0) AS dearest,
    CASE WHEN below THEN CASE WHEN n % 5 = 0 AND coalesce(hT1, 0) > 0 AND T < hT1 THEN {t_range(f"least({whole('T * 1.2::DOUBLE')}, hT1)")} ELSE T END WHEN {ramped} THEN {t_range(whole(f"T * {c.ramp_tokens}::DOUBLE"))} WHEN {widened} THEN {wider} ELSE T END AS T1,
    CASE WHEN B IS NULL THEN B WHEN below THEN CASE WHEN n % 5 = 0 AND coalesce(hB1, 0) > 0 AND B < hB1 THEN {b_range(f"least(greatest({c.min_examples}, {whole('B * 1.2::DOUBLE')} + 1), hB1)")} ELSE B END WHEN {ramped} THEN {b_range(f"greatest({c.min_examples}, {whole(f'B * {c.ramp_examples}::DOUBLE')} + 1)")} ELSE B END AS B1,
    CASE WHEN {ramped} OR {widened} THEN 0 ELSE n END AS n1, CASE WHEN {judged} AND util20 >= 80 THEN 0 WHEN {widened} THEN ua + 1 ELSE ua END AS ua1, CASE WHEN {ramped} THEN ra - 1 ELSE ra END AS ra1
  FROM (SELECT *, (coalesce(hT1, 0) > 0 AND T < {whole("hT1 * 0.9::DOUBLE")}) OR (coalesce(hB1, 0) > 0 AND B IS NOT NULL AND B < {whole("hB1 * 0.9::DOUBLE")}) AS below
  FROM (SELECT *, CASE WHEN n >= proof THEN greatest(T, coalesce(hT, 0)) ELSE hT END AS hT1, CASE WHEN n >= proof AND B IS NOT NULL THEN greatest(B, coalesce(hB, 0)) ELSE hB END AS hB1
  FROM (SELECT l.*, f.st, f.st[l.k + 1].T AS T, f.st[l.k + 1].B AS B, f.st[l.k + 1].hT AS hT, f.st[l.k + 1].hB AS hB, f.st[l.k + 1].bpt AS bpt, f.st[l.k + 1].ra AS ra, f.st[l.k + 1].ua AS ua, f.st[l.k + 1].oom AS oom, f.st[l.k + 1].tuned AS tuned,
    l.outcome = 'ok' AS ok, l.outcome = 'partial' OR l.shrink_b AS sb, f.st[l.k + 1].stable + CASE WHEN l.outcome = 'ok' THEN 1 ELSE 0 END AS n, CASE WHEN l.outcome = 'ok' THEN 5 ELSE 3 END AS proof, greatest((l.total - l.baseline)::DOUBLE, l.total * 0.05::DOUBLE) AS room
    FROM f JOIN r AS l ON l.run = f.run AND l.rn = f.rn + 1)))))))
SELECT run, k AS regime_key, {tail} s.T AS T, s.B AS B, s.stable AS stable, s.hT AS hwm_T, s.hB AS hwm_B, round(s.bpt, 3) AS bytes_per_token, s.ra AS adaptive_ramps, s.ua AS util_attempts, s.oom AS oom_count, s.tuned AS tuned FROM (SELECT *, st[k + 1] AS s FROM f WHERE rn > 0)"""


_W = "(PARTITION BY run ORDER BY step)"
#: The last 20 samples' mean and number, carried over steps without a sample.
_RECENT = """u AS (SELECT *, last_value(CASE WHEN util IS NOT NULL THEN m END IGNORE NULLS) OVER w AS recent, coalesce(last_value(CASE WHEN util IS NOT NULL THEN c END IGNORE NULLS) OVER w, 0) AS recent_n FROM (
  SELECT *, avg(util) OVER v AS m, count(util) OVER v AS c FROM {0} WINDOW v AS (PARTITION BY run, util IS NULL ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_GAPS = f"{D.SQL_LOG}, g AS (SELECT *, ts_ms - lag(end_ms) OVER {_W} AS gap_ms, row_number() OVER {_W} AS rn FROM log)"
SQL = {
    "regime_limits_lookup": f"""WITH RECURSIVE {P.pairs_sql()}, {NATION}, k AS (SELECT bucket_id, batch_no, ((trunc(max(eff))::BIGINT + 127) // 128)::INT AS regime_key FROM rows GROUP BY ALL)
SELECT bucket_id, batch_no, k.regime_key, least(coalesce(T, {CONFIG.tokens}), {CONFIG.top_tokens})::BIGINT AS limit_T, (CASE WHEN st.regime_key IS NOT NULL THEN B ELSE {CONFIG.examples} END)::BIGINT AS limit_B FROM k LEFT JOIN st USING (regime_key)""",
    "eval_fold": _eval_fold_sql(),
    "regime_json_roundtrip": f"WITH {NATION} SELECT regime_key, T, B, stable, hwm_T, hwm_B, bytes_per_token, 0::BIGINT AS adaptive_ramps, 0::BIGINT AS util_attempts, oom_count, false AS tuned FROM st",
    "regime_seed": f"WITH {NATION} SELECT regime_key, T, B, 0::BIGINT AS stable, NULL::BIGINT AS hwm_T, NULL::BIGINT AS hwm_B, NULL::DOUBLE AS bytes_per_token, 3::BIGINT AS adaptive_ramps, 0::BIGINT AS util_attempts, 0::BIGINT AS oom_count, false AS tuned FROM st",
    "regime_summary": f"WITH {NATION} SELECT count(*) AS regimes, sum(oom_count)::BIGINT AS total_oom, count(*) FILTER (tuned) AS tuned, max(T) AS max_T, min(T) AS min_T FROM st",
    "util_rolling20": f"WITH {D.SQL_LOG}, {_RECENT.format('log')} SELECT run, step, CASE WHEN recent_n >= 20 THEN round(recent, 6) END AS util20 FROM u",
    "step_gap": f"WITH {_GAPS} SELECT run, step, round(gap_ms, 3) AS gap_ms FROM g",
    "timing_100": f"""WITH {_GAPS}, {_RECENT.format('g')}, e AS (SELECT run, ((rn - 1) // 100)::INT AS window_no, count(*) AS steps, sum(plan_ms) / 100 AS p, sum(exec_ms) / 100 AS x, sum(total_ms) / 100 AS t, coalesce(avg(gap_ms), 0) AS gap,
  sum(examples)::DOUBLE / 100 AS ex, sum(tokens)::DOUBLE / 100 AS tok, sum(microbatches)::DOUBLE / 100 AS mb, coalesce(arg_max(recent, rn), -1) AS util FROM u GROUP BY ALL HAVING count(*) = 100)
SELECT run, window_no, steps, round(p, 4) AS mean_plan, round(x, 4) AS mean_exec, round(t, 4) AS mean_total, round(gap, 4) AS mean_gap, round(CASE WHEN gap > 0 THEN 100.0::DOUBLE * gap / (gap + t) ELSE 0 END, 4) AS idle_pct, round(ex, 4) AS mean_examples, round(tok, 4) AS mean_tokens, round(mb, 4) AS mean_microbatches, round(util, 4) AS utilisation FROM e""",
    "slow_steps": f"WITH {D.SQL_LOG}, n AS (SELECT *, row_number() OVER {_W}::INT AS step_no, min(exec_ms) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS base_ms FROM log) SELECT run, step, step_no, base_ms, step_no > 3 AND (exec_ms > 3.0::DOUBLE * base_ms OR exec_ms > 5000) AS slow FROM n",
    "slow_streaks": f"""WITH RECURSIVE {D.SQL_LOG}, l AS MATERIALIZED (SELECT run, step, exec_ms, row_number() OVER {_W} AS rn, min(exec_ms) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS base FROM log),
f AS (SELECT run, 0::BIGINT AS rn, NULL::BIGINT AS step, 0.0::DOUBLE AS said, 0.0::DOUBLE AS held, -1000::BIGINT AS last, false AS fired FROM (SELECT DISTINCT run FROM l) UNION ALL
  SELECT run, rn, step, h, CASE WHEN h >= 4000 AND rn - last > 100 THEN 0.0::DOUBLE ELSE h END, CASE WHEN h >= 4000 AND rn - last > 100 THEN rn ELSE last END, h >= 4000 AND rn - last > 100
  FROM (SELECT l.run, l.rn, l.step, f.last, CASE WHEN l.rn > 20 AND l.exec_ms > greatest(3.0::DOUBLE * l.base, 500.0::DOUBLE) THEN f.held + l.exec_ms ELSE 0.0::DOUBLE END AS h FROM f JOIN l ON l.run = f.run AND l.rn = f.rn + 1))
SELECT run, step, round(said, 3) AS streak_ms, fired FROM f WHERE rn > 0""",
    "regime_fold": _regime_sql("step, attempt,"),
    "regime_final": _regime_sql("") + " QUALIFY row_number() OVER (PARTITION BY run, k ORDER BY step DESC) = 1",
    "diag_records": f"""WITH {_GAPS}, {_RECENT.format('g')} SELECT step, round_even(ts_ms / 1000.0::DOUBLE, 2) AS ts, util AS gpu_util, round_even(step % 9000 / 1024.0::DOUBLE, 2) AS gpu_mem_alloc_gb, round_even(step % 8000 / 125.0::DOUBLE, 2) AS gpu_mem_peak_gb, round_even(step % 3000 / 8.0::DOUBLE, 1) AS gpu_power_w, step % 90 AS gpu_temp_c,
  round_even(step % 640 / 16.0::DOUBLE, 1) AS cpu_load_1m, step % 1000 / 10.0::DOUBLE AS cpu_pct, step % 999 / 10.0::DOUBLE AS ram_pct, round_even(plan_ms, 1) AS plan_ms, round_even(exec_ms, 1) AS exec_ms, round_even(total_ms, 1) AS step_ms, round_even(gap_ms, 1) AS gap_ms, round_even(100.0::DOUBLE * exec_ms / (total_ms + gap_ms), 1) AS busy_pct,
  examples, tokens, tokens * 2 AS eff_tok, microbatches AS n_mb, tokens AS max_mb_tok, regime_key::BIGINT AS rk, regime_key * 64::BIGINT + 256 AS rT, CASE WHEN regime_key % 3 <> 0 THEN regime_key::BIGINT + 8 END AS rB, CASE WHEN regime_key % 2 = 0 THEN regime_key * 70::BIGINT + 300 END AS hwm_T, (regime_key % 7)::BIGINT AS stable,
  CASE WHEN regime_key % 4 = 0 THEN round_even(regime_key * 1000.3::DOUBLE, 0) END AS bpt, round_even(recent, 1) AS util_avg20, CASE WHEN step % 4 > 0 THEN step % 4 END AS ooms, outcome FROM u""",
    "diag_ring": f"WITH {D.SQL_LOG} SELECT step, run, outcome FROM log ORDER BY step DESC LIMIT {RING}",
    "baseline_mem": f"WITH {D.SQL_LOG} SELECT regime_key, arg_max(exec_ms, step) AS baseline_mem FROM log WHERE step <= 500 GROUP BY regime_key",
    "bottleneck_device": "SELECT host, device, total, peak, baseline FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY total - peak, device) AS r FROM (SELECT s_suppkey % 5 AS host, s_suppkey AS device, 80000 - s_suppkey % 3 * 8000 AS total, s_suppkey * 7919 % 70000 * (s_suppkey % 4) AS peak, s_suppkey % 9000 AS baseline FROM supplier) WHERE peak > 0) WHERE r = 1",
    "throughput": f"WITH {D.SQL_LOG} SELECT run, round(sum(exec_ms) / 1000.0::DOUBLE, 6) AS runtime, round(sum(examples) / (sum(exec_ms) / 1000.0::DOUBLE), 6) AS samples_per_second, round(count(*) / (sum(exec_ms) / 1000.0::DOUBLE), 6) AS steps_per_second FROM log GROUP BY run",
}
QUERIES = {name: globals()[name] for name in SQL}
