"""The adaptive limits of each regime, as a pure transition function and its drivers.

A regime is a class of batches of like length.  Its limits (T tokens and B
examples a microbatch) grow with success and shrink with memory failures, around
high-water marks that have proven stable.  The same function drives a batch
replay of a step log (an ordered fold by run) and a stream
(:mod:`packframe.streaming.regimes`).  The regimes of a run share one thing: a
failure never shrinks T below what the memory left by the model safely holds, at
the highest cost of a token that any of them has measured.

A log row is one attempt: outcome ok, partial (memory failed after some
microbatches had run) or oom; ``shrink_b`` says whether a failure shrinks B
(a batch's first) or T.  What the original reads from the device comes as columns:
``util20`` (mean utilisation of the last 20 steps, null before), and for tuning
``peak``, ``baseline``, ``total`` and ``max_mb_eff``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packframe.config import RegimeConfig
from packframe.operators.fold import ordered_fold


@dataclass
class Regime:
    T: int
    B: int | None = None
    stable: int = 0
    hwm_T: int | None = None
    hwm_B: int | None = None
    bytes_per_token: float | None = None
    adaptive_ramps: int = 0
    util_attempts: int = 0
    oom_count: int = 0
    tuned: bool = False

    @classmethod
    def fresh(cls, config: RegimeConfig) -> "Regime":
        return cls(T=400 if config.tokens is None else config.tokens, B=config.examples)


STATE = T.StructType([
    T.StructField("T", T.LongType()), T.StructField("B", T.LongType()), T.StructField("stable", T.LongType()), T.StructField("hwm_T", T.LongType()), T.StructField("hwm_B", T.LongType()),
    T.StructField("bytes_per_token", T.DoubleType()), T.StructField("adaptive_ramps", T.LongType()), T.StructField("util_attempts", T.LongType()), T.StructField("oom_count", T.LongType()), T.StructField("tuned", T.BooleanType()),
])
assert [f.name for f in STATE] == [f.name for f in fields(Regime)]


def between(x: int, low: int, high: int) -> int:
    return max(low, min(x, high))


def mark(s: Regime, after: int) -> None:
    """Raise the high-water marks once ``after`` successes in a row have proven the limits."""
    if s.stable >= after:
        s.hwm_T = max(s.T, s.hwm_T or 0)
        if s.B is not None:
            s.hwm_B = max(s.B, s.hwm_B or 0)


def succeed(s: Regime, c: RegimeConfig, util20: float | None = None) -> None:
    s.stable += 1
    mark(s, 5)
    below = lambda now, top: bool(top) and now is not None and now < int(top * 0.9)
    if below(s.T, s.hwm_T) or below(s.B, s.hwm_B):  # recover what has proven stable
        if s.stable % 5 == 0:
            if s.hwm_T and s.T < s.hwm_T:
                s.T = between(min(int(s.T * 1.20), s.hwm_T), c.min_tokens, c.top_tokens)
            if s.B is not None and s.hwm_B and s.B < s.hwm_B:
                s.B = between(min(max(c.min_examples, int(s.B * 1.20) + 1), s.hwm_B), c.min_examples, c.top_examples)
        return
    if s.adaptive_ramps > 0 and s.stable >= c.ramp_every:  # explore beyond a seed
        s.T = between(int(s.T * c.ramp_tokens), c.min_tokens, c.top_tokens)
        if s.B is not None:
            s.B = between(max(c.min_examples, int(s.B * c.ramp_examples) + 1), c.min_examples, c.top_examples)
        s.adaptive_ramps -= 1
        s.stable = 0
        return
    if util20 is not None and s.stable >= 20:
        if util20 >= 80:
            s.util_attempts = 0
        elif util20 < 50 and s.util_attempts < 10:
            wider = between(int(s.T * 1.05), c.min_tokens, c.top_tokens)
            if wider != s.T:
                s.T, s.stable, s.util_attempts = wider, 0, s.util_attempts + 1


def ladder(now: int, proven: int | None, fraction: float, least: int) -> int:
    """Down to the proven level if above it, else a step below it, else by a fraction."""
    if proven and now > proven:
        return proven
    if proven and now > int(proven * 0.85):
        return max(least, int(proven * 0.85))
    return max(least, int(now * fraction))


def safe_tokens(costs: Iterable[float | None], total: int | None, baseline: int | None, c: RegimeConfig) -> int:
    """The least T worth having: two thirds of the memory beyond the baseline, at the highest cost known."""
    cost = max((b for b in costs if b), default=0.0)
    if cost <= 0 or total is None or baseline is None:
        return c.min_tokens
    return max(c.min_tokens, int(0.66 * max(total - baseline, total * 0.05) / max(cost, 1e-9)))


def fail(s: Regime, c: RegimeConfig, shrink_b: bool, safe: Callable[[], int] | None = None) -> None:
    """safe: gives the floor of T, asked once this regime's own cost is forgotten."""
    mark(s, 3)
    s.stable = s.adaptive_ramps = s.util_attempts = 0
    s.bytes_per_token = None
    s.oom_count += 1
    s.tuned = False
    if shrink_b:
        s.B = c.top_examples if s.B is None else ladder(s.B, s.hwm_B, 0.7, c.min_examples)
    else:
        floor = max(c.safe_floor, c.min_tokens, safe() if safe else 0)
        s.T = max(floor, ladder(s.T, s.hwm_T, 0.85, floor))


def tune(s: Regime, c: RegimeConfig, peak: int, baseline: int, total: int, tokens: int) -> None:
    """Set T from the memory that a step took."""
    if peak <= 0 or tokens <= 0:
        return
    room = max(total - baseline, total * 0.05)
    cost = max(peak - baseline, room * 0.05) / float(tokens)
    safety = c.autotune_oom_safety if s.oom_count else c.autotune_safety
    s.T = max(c.min_tokens, min(int(safety * room / max(cost, 1e-9)), c.top_tokens))
    s.hwm_T = max(s.T, s.hwm_T or 0)
    s.bytes_per_token = cost
    s.tuned = True


def advance(s: Regime, c: RegimeConfig, outcome: str, attempt: int, shrink_b: bool, util20: float | None, memory: tuple | None, safe: Callable[[], int] | None = None) -> None:
    """One log row: success precedes tuning, and a partial step shrinks B without counting as either."""
    if outcome == "ok":
        succeed(s, c, util20)
        if memory is not None and attempt == 0 and (not s.tuned or s.stable % 500 == 0):
            peak, baseline, total, tokens = memory
            if not (s.oom_count and tokens < 0.1 * (s.hwm_T or 0)):  # too small a step to judge after a failure
                tune(s, c, peak, baseline, total, tokens)
    elif outcome == "partial":
        fail(s, c, True, safe)
    elif outcome == "oom":
        fail(s, c, shrink_b, safe)
    else:
        raise ValueError(f"no such outcome: {outcome}")


LOG = ["outcome", "attempt", "shrink_b", "util20", "peak", "baseline", "total", "max_mb_eff"]


def row_memory(peak, baseline, total, tokens) -> tuple | None:
    given = (peak, baseline, total, tokens)
    return None if any(x is None or x != x for x in given) else tuple(int(x) for x in given)


def apply_row(regimes: dict, key, c: RegimeConfig, start: Regime, outcome, attempt, shrink_b, util20, peak, baseline, total, tokens) -> Regime:
    """One log row of a run, of whose regimes' states one changes; it is returned."""
    s = regimes.get(key)
    if s is None:
        s = regimes[key] = replace(start)
    util = None if util20 is None or util20 != util20 else float(util20)
    whole = lambda x: None if x is None or x != x else int(x)
    safe = lambda: safe_tokens((r.bytes_per_token for r in regimes.values()), whole(total), whole(baseline), c)
    advance(s, c, outcome, int(attempt), bool(shrink_b), util, row_memory(peak, baseline, total, tokens), safe)
    return s


def with_log_columns(log: DataFrame) -> DataFrame:
    """The log with every column of a log row; what it lacks is null, attempt 0, and B shrinks first."""
    missing = {"attempt": F.lit(0), "shrink_b": F.lit(True) if "attempt" not in log.columns else F.col("attempt") == 0, "util20": F.lit(None).cast("double")}
    missing |= {k: F.lit(None).cast("bigint") for k in ("peak", "baseline", "total", "max_mb_eff")}
    return log.withColumns({k: v for k, v in missing.items() if k not in log.columns})


def replay(log: DataFrame, config: RegimeConfig = RegimeConfig(), key: str = "regime_key", order: tuple[str, ...] = ("step", "attempt"), run: tuple[str, ...] = (), start: Regime | None = None) -> DataFrame:
    """The log with the state of each row's regime after it, in STATE's columns.

    run: the columns that name a run, each of which is folded in its order on its
    own; without them the log is one run.  start: the state that regimes begin in.
    """
    full = with_log_columns(log)
    first = start or Regime.fresh(config)

    def step(regimes: dict, regime_key, *row) -> tuple[dict, tuple]:
        s = apply_row(regimes, regime_key, config, first, *[None if x is None or (isinstance(x, float) and x != x) else x for x in row])
        return regimes, tuple(asdict(s).values())

    names = [(f.name, f.dataType) for f in STATE]
    wanted = list(dict.fromkeys([*run, key, *order, *LOG]))
    return ordered_fold(full.select(*wanted), list(run), list(order), [key, *LOG], dict, step, names)


def final_states(replayed: DataFrame, key: str = "regime_key", order: tuple[str, ...] = ("step", "attempt"), run: tuple[str, ...] = ()) -> DataFrame:
    """(run, key, state columns) after each regime's last row."""
    last = replayed.groupBy(*run, key).agg(F.max_by(F.struct(*[f.name for f in STATE]), F.struct(*order)).alias("s"))
    return last.select(*run, key, "s.*")


def limits(batches: DataFrame, states: DataFrame, config: RegimeConfig, key: str = "regime_key") -> DataFrame:
    """Batches with limit_T and limit_B of their regime, or the defaults; T is capped."""
    known = states.select(F.col(key).alias("_k"), F.col("T").alias("_T"), F.col("B").alias("_B"), F.lit(True).alias("_known"))
    joined = batches.join(F.broadcast(known), F.col(key) == F.col("_k"), "left")  # a row a class of lengths
    default = F.lit(400 if config.tokens is None else config.tokens).cast("bigint")
    cap = F.least(F.coalesce("_T", default), F.lit(config.top_tokens).cast("bigint"))
    b = F.when(F.col("_known"), F.col("_B")).otherwise(F.lit(config.examples).cast("bigint"))
    return joined.withColumn("limit_T", cap).withColumn("limit_B", b).drop("_k", "_T", "_B", "_known")


def shrink_global(tokens: int | None, examples: int | None, c: RegimeConfig) -> tuple[int | None, int | None, bool]:
    """Limits without a regime: B shrinks first, then T; (T, B, whether either did)."""
    if examples is not None and (b := max(c.min_examples, int(examples * c.shrink_examples))) < examples:
        return tokens, b, True
    if tokens is not None and (t := max(c.min_tokens, int(tokens * c.shrink_tokens))) < tokens:
        return t, examples, True
    return tokens, examples, False


@dataclass
class Evaluation:
    """Limits of an evaluation: T tokens, G examples a generation, B examples a microbatch."""

    T: int | None
    G: int | None = None
    B: int | None = None
    stable: int = 0
    hwm_T: int | None = None
    hwm_G: int | None = None


def eval_mark(s: Evaluation, after: int) -> None:
    if s.stable >= after:
        if s.T is not None:
            s.hwm_T = max(s.T, s.hwm_T or 0)
        if s.G is not None:
            s.hwm_G = max(s.G, s.hwm_G or 0)


def eval_succeed(s: Evaluation, c: RegimeConfig, train_T: int | None = None) -> None:
    s.stable += 1
    eval_mark(s, 5)
    if s.T is None:
        return
    if (s.hwm_T and s.T < int(s.hwm_T * 0.9)) or (s.hwm_G and s.G is not None and s.G < int(s.hwm_G * 0.9)):
        if s.stable % 3 == 0:
            if s.hwm_T and s.T < s.hwm_T:
                s.T = max(min(int(s.T * 1.20), s.hwm_T), c.min_tokens)
            if s.G is not None and s.hwm_G and s.G < s.hwm_G:
                s.G = max(1, min(int(s.G * 1.20) + 1, s.hwm_G))
        return
    if s.stable % c.eval_ramp_every == 0:
        wider = int(s.T * c.eval_ramp_tokens)
        s.T = max(wider if train_T is None else min(wider, train_T), c.min_tokens)


def eval_shrink(s: Evaluation, c: RegimeConfig) -> bool:
    """Generation first, then tokens, then examples; the first that gives way."""
    if s.G is not None and s.G > 1 and (g := ladder(s.G, s.hwm_G, c.shrink_examples, 1)) != s.G:
        s.G = g
        return True
    if s.T is not None and s.T > c.min_tokens and (t := max(c.min_tokens, ladder(s.T, s.hwm_T, c.shrink_tokens, c.min_tokens))) < s.T:
        s.T = t
        return True
    if s.B is not None and s.B > c.min_examples and (b := max(c.min_examples, int(s.B * c.shrink_examples))) < s.B:
        s.B = b
        return True
    return False


def eval_fail(s: Evaluation, c: RegimeConfig) -> bool:
    eval_mark(s, 3)
    s.stable = 0
    return eval_shrink(s, c)


def eval_bootstrap(s: Evaluation) -> None:
    """After the first success that follows a failure: what ran is a mark at once."""
    s.hwm_T = s.T if s.hwm_T is None else s.hwm_T
    s.hwm_G = s.G if s.hwm_G is None else s.hwm_G


def eval_start(initial: int, hwm: int | None) -> int:
    return min(initial, hwm) if hwm else initial


EVAL_STATE = [("T", T.LongType()), ("G", T.LongType()), ("B", T.LongType()), ("stable", T.LongType()), ("hwm_T", T.LongType()), ("hwm_G", T.LongType())]


def eval_replay(log: DataFrame, config: RegimeConfig, start: Evaluation, key: list[str], order: list[str]) -> DataFrame:
    """An evaluation log (outcome ok or oom) with the limits after each row."""

    def step(s: Evaluation, outcome: str) -> tuple[Evaluation, tuple]:
        if outcome == "ok":
            eval_succeed(s, config, config.tokens)
        else:
            eval_fail(s, config)
        return s, tuple(asdict(s).values())

    return ordered_fold(log, key, order, ["outcome"], lambda: Evaluation(**asdict(start)), step, EVAL_STATE)
