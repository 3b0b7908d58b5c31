"""Rolling figures of a step log.  A log is ordered within a run, the window partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packframe.operators.fold import ordered_fold


def _ordered(run: list[str], order: list[str]):
    return Window.partitionBy(*run).orderBy(*order)


def recent_utilisation(log: DataFrame, run: list[str], order: list[str], n: int = 20) -> DataFrame:
    """log with recent_util and recent_n: the mean and number of the last n samples, however many steps had none."""
    samples = Window.partitionBy(*run, F.col("util").isNull()).orderBy(*order).rowsBetween(-(n - 1), 0)
    so_far = _ordered(run, order).rowsBetween(Window.unboundedPreceding, 0)
    held = log.withColumn("_s", F.when(F.col("util").isNotNull(), F.struct(F.avg("util").over(samples).alias("util"), F.count("util").over(samples).alias("n"))))
    held = held.withColumn("_s", F.last("_s", ignorenulls=True).over(so_far))
    return held.withColumn("recent_util", F.col("_s.util")).withColumn("recent_n", F.coalesce("_s.n", F.lit(0))).drop("_s")


def rolling_utilisation(log: DataFrame, run: list[str], order: list[str], n: int = 20) -> DataFrame:
    """log with util20: the mean of the last n samples, null before there are n."""
    held = recent_utilisation(log, run, order, n)
    return held.withColumn("util20", F.when(F.col("recent_n") >= n, F.col("recent_util"))).drop("recent_util", "recent_n")


def gaps(log: DataFrame, run: list[str], order: list[str], begin: str = "ts_ms", end: str = "end_ms") -> DataFrame:
    """log with gap_ms: from the end of the step before, null for the first."""
    return log.withColumn("gap_ms", F.col(begin) - F.lag(end).over(_ordered(run, order)))


def timing_means(log: DataFrame, run: list[str], order: list[str], n: int = 100) -> DataFrame:
    """Means over each full n steps of a run, with the utilisation at their end (-1 without a sample).

    The gap's mean counts its own rows; what is idle is that gap's share of a gap and a whole step.
    """
    held = recent_utilisation(log, run, order)
    numbered = held.withColumn("_rn", F.row_number().over(_ordered(run, order)) - 1).withColumn("window_no", F.floor(F.col("_rn") / n).cast("int"))
    mean = lambda c: F.sum(c) / n
    gap, total = F.coalesce(F.avg("gap_ms"), F.lit(0.0)), mean("total_ms")
    out = numbered.groupBy(*run, "window_no").agg(
        F.count(F.lit(1)).alias("steps"), mean("plan_ms").alias("mean_plan"), mean("exec_ms").alias("mean_exec"), total.alias("mean_total"), gap.alias("mean_gap"),
        F.when(gap > 0, F.lit(100.0) * gap / (gap + total)).otherwise(0.0).alias("idle_pct"),
        mean("examples").alias("mean_examples"), mean("tokens").alias("mean_tokens"), mean("microbatches").alias("mean_microbatches"),
        F.coalesce(F.max_by("recent_util", "_rn"), F.lit(-1.0)).alias("utilisation"),
    )
    return out.filter(F.col("steps") == n)


def slow_steps(log: DataFrame, run: list[str], order: list[str]) -> DataFrame:
    """log with step_no, base_ms (the fastest step so far) and slow: over three times that, or over 5 s."""
    w = _ordered(run, order)
    numbered = log.withColumn("step_no", F.row_number().over(w)).withColumn("base_ms", F.min("exec_ms").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("slow", (F.col("step_no") > 3) & ((F.col("exec_ms") > F.lit(3.0) * F.col("base_ms")) | (F.col("exec_ms") > 5000.0)))


def slow_streaks(log: DataFrame, run: list[str], order: list[str], factor: float = 10.0, floor_ms: float = 10_000.0, fire_ms: float = 120_000.0, cooldown: int = 100, warm: int = 20) -> DataFrame:
    """log with streak_ms and fired: sustained slowness adds up, and fires at most once in ``cooldown`` steps.

    A step counts if it is past ``warm`` and slower than ``factor`` times the fastest so far and than ``floor_ms``.
    """

    def start() -> tuple:
        return 0, float("inf"), 0.0, None

    def step(state: tuple, exec_ms: float) -> tuple[tuple, tuple]:
        number, base, held, fired_at = state
        number, base = number + 1, min(base, exec_ms)
        held = held + exec_ms if number > warm and exec_ms > max(factor * base, floor_ms) else 0.0
        fires = held >= fire_ms and (fired_at is None or number - fired_at > cooldown)
        return (number, base, 0.0 if fires else held, number if fires else fired_at), (held, fires)

    return ordered_fold(log, run, order, ["exec_ms"], start, step, [("streak_ms", T.DoubleType()), ("fired", T.BooleanType())])


def ring(log: DataFrame, order: str, most: int = 5000) -> DataFrame:
    """The last records: a top-k, so no global sort."""
    return log.orderBy(F.desc(order)).limit(most)


def baseline_memory(log: DataFrame, device: str, step: str, memory: str, upto: int = 5) -> DataFrame:
    """(device, baseline_mem): each device's latest sample of its first steps."""
    return log.filter(F.col(step) <= upto).groupBy(device).agg(F.max_by(memory, step).alias("baseline_mem"))


def bottleneck(devices: DataFrame, by: list[str]) -> DataFrame:
    """(by, device, total, peak, baseline) of the device in use with the least memory left."""
    used = devices.filter("peak > 0")
    row = F.struct("device", "total", "peak", "baseline")
    return used.groupBy(*by).agg(F.min_by(row, F.struct(F.col("total") - F.col("peak"), F.col("device"))).alias("r")).select(*by, "r.*")


def throughput(log: DataFrame, run: list[str]) -> DataFrame:
    seconds = F.sum("exec_ms") / 1000.0
    return log.groupBy(*run).agg(seconds.alias("runtime"), (F.sum("examples") / seconds).alias("samples_per_second"), (F.count(F.lit(1)) / seconds).alias("steps_per_second"))


#: A record's fields: the log's column, and the digits it is rounded to (halves to even).
FIELDS = {
    "step": ("step", None), "ts": ("ts", 2), "gpu_util": ("util", None), "gpu_mem_alloc_gb": ("mem_alloc_gb", 2), "gpu_mem_peak_gb": ("mem_peak_gb", 2), "gpu_power_w": ("power_w", 1), "gpu_temp_c": ("temp_c", None),
    "cpu_load_1m": ("cpu_load", 1), "cpu_pct": ("cpu_pct", None), "ram_pct": ("ram_pct", None), "plan_ms": ("plan_ms", 1), "exec_ms": ("exec_ms", 1), "step_ms": ("total_ms", 1), "gap_ms": ("gap_ms", 1), "busy_pct": ("_busy", 1),
    "examples": ("examples", None), "tokens": ("tokens", None), "eff_tok": ("eff_tokens", None), "n_mb": ("microbatches", None), "max_mb_tok": ("max_mb_eff", None), "rk": ("regime_key", None), "rT": ("T", None), "rB": ("B", None),
    "hwm_T": ("hwm_T", None), "stable": ("stable", None), "bpt": ("bytes_per_token", 0), "util_avg20": ("recent_util", 1), "ooms": ("_ooms", None), "outcome": ("outcome", None),
}


def records(log: DataFrame) -> DataFrame:
    """(step, record): compact JSON of the fields that the log has columns for; nulls are left out, as is a count of no failures."""
    full = log
    if {"exec_ms", "gap_ms"} <= set(log.columns):
        total = F.col("total_ms") if "total_ms" in log.columns else F.col("exec_ms")
        full = full.withColumn("_busy", F.when(F.col("gap_ms").isNotNull() & (total > 0), F.lit(100.0) * F.col("exec_ms") / (total + F.col("gap_ms"))))
    if "ooms" in log.columns:
        full = full.withColumn("_ooms", F.when(F.col("ooms") > 0, F.col("ooms")))
    row = F.struct(*[(F.col(c) if digits is None else F.bround(c, digits)).alias(name) for name, (c, digits) in FIELDS.items() if c in full.columns])
    return full.select("step", F.to_json(row).alias("record"))
