"""Golden vectors, properties and brute force for the library's operators."""

from __future__ import annotations

import json
import math
import random
import threading
from collections import Counter
from dataclasses import asdict

import numpy as np
import psutil
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packframe import config
from packframe.config import PackConfig, RegimeConfig, tier_value
from packframe.functions import scalar, stemmer
from packframe.functions import scalar as S
from packframe.operators import collate, corrupt, evalplan, metrics, microbatch, nextfit, regime, sampler, telemetry
from packframe.sources import loaders, state
from packframe.streaming import regimes

GOLDEN = [5, 16, 17, 32, 33, 100, 3, 12, 16]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def lengths(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "example_id long, L int")


def packed(spark, values, **how):
    out: dict = {}
    for r in sampler.pack(lengths(spark, values), PackConfig(**how)).orderBy("bucket_id", "batch_no", "example_id").collect():
        out.setdefault((r["bucket_id"], r["batch_no"]), []).append(r["example_id"])
    return list(out.values())


@pytest.mark.parametrize(
    ("how", "batches"),
    [
        ({}, [[0, 1, 6, 7], [8], [2], [3], [4], [5]]),
        ({"long": "single"}, [[0, 1, 6, 7], [8], [2], [3], [4], [5]]),
        ({"long": "skip"}, [[0, 1, 6, 7], [8], [2], [3], [4]]),
        ({"long": "skip", "max_length": 30}, [[0, 1, 6, 7], [8], [2]]),
        ({"long": "single", "drop_last": True, "strict_drop_last": True}, [[5]]),
        ({"drop_last": True, "strict_drop_last": True}, []),
    ],
)
def test_golden_packing(spark, how, batches):
    assert packed(spark, GOLDEN, budget=40, width=16, **how) == batches


def test_count_is_at_least_one(spark):
    none = sampler.pack(lengths(spark, GOLDEN).filter("L < 0"), PackConfig(40))
    assert sampler.batch_count(none).first()[0] == 1


def next_fit(values, budget, width, most):
    """Brute force: one bucket after another."""
    out = []
    for b in sorted({math.ceil(v / width) for v in values}):
        batch, tokens, longest = [], 0, 0
        for i, v in enumerate(values):
            if math.ceil(v / width) != b:
                continue
            if batch and (tokens + v > budget or (most is not None and max(longest, v) > most)):
                out.append(batch)
                batch, tokens, longest = [], 0, 0
            batch.append(i)
            tokens, longest = tokens + v, max(longest, v)
        out.append(batch)
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 90), min_size=1, max_size=60), st.integers(1, 100), st.integers(1, 40), st.one_of(st.none(), st.integers(1, 80)))
def test_packing_is_next_fit(spark, values, budget, width, most):
    want = next_fit(values, budget, width, most)
    assert packed(spark, values, budget=budget, width=width, max_length=most) == want
    assert packed(spark, values, budget=budget, width=width, max_length=most, long="single") == want


def test_emission_is_a_permutation(spark):
    draw = random.Random(4)
    rows = lengths(spark, [draw.randint(1, 90) for _ in range(200)])
    for mode in ("bucket", "interleave"):
        config = PackConfig(64, 16, shuffle=True, mode=mode, seed="x")
        found = sampler.emit_order(sampler.pack(rows, config), config).orderBy("emit_pos").collect()
        assert [r["emit_pos"] for r in found] == list(range(len(found)))
        seen = [r["bucket_id"] for r in found]
        runs = 1 + sum(a != b for a, b in zip(seen, seen[1:]))
        assert (runs == len(set(seen))) == (mode == "bucket")


def microbatches(spark, tokens, examples=None, padded=False):
    rows = spark.createDataFrame([(0, 0, i, e, d) for i, (e, d) in enumerate(zip([10, 20, 30, 40], [5, 5, 10, 0]))], "bucket_id int, batch_no int, example_id long, enc_len int, dec_len int")
    found = microbatch.split(microbatch.with_effective(rows, 2.0), tokens, examples, padded).orderBy("mb_no", "eff").collect()
    out: dict = {}
    for r in found:
        out.setdefault(r["mb_no"], []).append(r["example_id"])
    return list(out.values())


def test_golden_microbatches(spark):
    assert microbatches(spark, 100) == [[0, 1, 3], [2]]
    assert microbatches(spark, 100, padded=True) == [[0, 1], [3, 2]]
    assert microbatches(spark, 1000, 2) == [[0, 1], [3, 2]]


def test_golden_scalars(spark):
    for eff, key in ((0.0, 0), (1.0, 1), (50.0, 1), (128.0, 1), (128.9, 1), (129.0, 2)):
        assert one(spark, S.regime_key(F.lit(eff))) == key
    for vocab, alpha in ((0, 2), (32128, 2), (64000, 2), (100000, 4), (128000, 4), (250112, 5.5914), (256000, 5.6569), (3000000, 16)):
        assert one(spark, S.decoder_alpha(F.lit(vocab))) == pytest.approx(alpha, abs=1e-4)
    for raw, multiple, cap, width in ((13, 8, 64, 16), (61, 8, 64, 64), (13, 8, 14, 14), (100, 8, 64, 64)):
        assert one(spark, S.pad_width(F.lit(raw), multiple, cap)) == width
    for prompt, english in (("Translate Akkadian to English: x", True), ("ENGLISH TRANSLATION of", True), ("to english", False), (None, False)):
        assert one(spark, S.english_target(F.lit(prompt).cast("string"))) is english
    assert one(spark, S.shifted_right(F.array(*map(F.lit, (7, 8, -100))), 0, 0)) == [0, 7, 8]
    assert one(spark, S.shifted_right(F.array(*map(F.lit, (7, -100, 9))), 0, 0)) == [0, 7, 0]
    assert one(spark, S.autotuned_tokens(F.lit(80 << 30), F.lit(16 << 30), F.lit(48 << 30), F.lit(100000), 0.75, 64, 1 << 40)) == 150000
    assert [tier_value("ramp_every", g) for g in (80, 79, 24, 8)] == [2, 3, 4, 6] and tier_value("ramp_every", 8, 9) == 9


def test_configuration_reports_all_errors():
    with pytest.raises(ValueError, match="budget.*width.*long"):
        PackConfig(0, 0, long="no")
    with pytest.raises(ValueError, match="min_tokens.*autotune_safety"):
        RegimeConfig(min_tokens=0, autotune_safety=2.0)


def test_golden_span_counts(spark):
    table = {1: (1, 1), 10: (2, 1), 30: (4, 1), 64: (10, 3), 100: (15, 5), 512: (77, 26)}
    for length, counts in table.items():
        assert tuple(one(spark, c) for c in corrupt.span_counts(F.lit(length), corrupt.SpanConfig())) == counts


def test_spans_restore_the_input(spark):
    values = [0, 1, 2, 3, 7, 20, 64, 200, 900]
    rows = spark.createDataFrame([(i, [100 + j for j in range(n)]) for i, n in enumerate(values)], "example_id long, input_ids array<int>")
    config = corrupt.SpanConfig(sentinels=tuple(range(31999, 31499, -1)))
    for r in corrupt.corrupt(rows, config).collect():
        n = len(r["input_ids"])
        assert sum(r["gap_lens"]) + sum(r["noise_lens"]) == n and r["target"][-1] == 1
        if n == 0:
            assert (r["corrupted"], r["target"]) == ([], [1])
            continue
        said: dict = {}
        for t in r["target"][:-1]:
            if t in config.sentinels:
                said[t] = []
            else:
                said[list(said)[-1]].append(t)
        back = [x for t in r["corrupted"] for x in (said.pop(t) if t in said else [t])]
        assert back == r["input_ids"]
        assert len(r["corrupted"]) == n - r["noise_n"] + r["span_n"] and len(r["target"]) == r["noise_n"] + r["span_n"] + 1


def test_spans_hold_a_piece_of_a_batch(spark):
    """A worker grows by the batch as it is read (48 MB here) and the arrays of one piece, not by arrays of the whole batch."""
    rows = spark.range(0, 6000, 1, 1).select(F.col("id").alias("example_id"), F.sequence(F.lit(2), F.lit(2001)).alias("input_ids"))
    begun, grown, ended = {}, Counter(), threading.Event()

    def watch() -> None:
        while not ended.wait(0.02):
            for p in psutil.Process().children(recursive=True):
                try:
                    if "python" in p.name():
                        held = p.memory_info().rss >> 20
                        grown[p.pid] = max(grown[p.pid], held - begun.setdefault(p.pid, held))
                except psutil.Error:
                    pass

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        corrupt.corrupt(rows).select("corrupted", "target").write.format("noop").mode("overwrite").save()
    finally:
        ended.set()
        watcher.join()
    assert max(grown.values()) < 400, grown


def test_spans_are_the_same_in_pieces(spark, monkeypatch):
    values = [None, 0, 1, 2, 40, 0, 700, 3, 3, 90, None]
    rows = spark.createDataFrame([(i, None if n is None else list(range(100, 100 + n))) for i, n in enumerate(values)], "example_id long, input_ids array<int>")
    made = [tuple(r) for r in corrupt.corrupt(rows.coalesce(1)).select("input_ids", "gap_lens", "noise_lens", "corrupted", "target").collect()]
    lists = pa.list_(pa.int32())
    batch = tuple(pa.array([r[k] for r in made], lists) for k in range(3))
    dealt = tuple(pa.array(x) for x in ([7, 8, 9, None], [5, 900, 0, 3], [2, 30, 4, 0], [1, 2, 3, 4], [60, 0, 7, 1], [9, 1, 3, 2]))
    whole = pa.concat_arrays(corrupt._dealt.func(iter([dealt]))).to_pylist()
    assert [(sum(r["noise"]), len(r["noise"]), sum(r["gap"]), len(r["gap"])) for r in whole] == [(5, 2, 60, 9), (900, 30, 0, 1), (0, 4, 7, 3), (0, 0, 1, 2)]
    for piece in (1, 7, 100, 1 << 17):
        monkeypatch.setattr(corrupt, "PIECE", piece)
        got = list(corrupt._replaced(corrupt.SpanConfig()).func(iter([batch, tuple(x[:0] for x in batch), batch])))
        assert all(len(x) == 1 or x.field("corrupted").flatten().nbytes <= 8 * piece for x in got)
        assert [(r["corrupted"], r["target"]) for r in pa.concat_arrays(got).to_pylist()] == 2 * [r[3:] for r in made]
        assert pa.concat_arrays(corrupt._dealt.func(iter([dealt]))).to_pylist() == whole


def test_collated_widths(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3], [1, 1, 1], [5], 0), (2, [1], [1], [5, -100, 7], 0), (3, None, None, None, 1)], "example_id long, input_ids array<int>, attention_mask array<int>, labels array<int>, b int")
    found = {r["example_id"]: r for r in collate.collated(rows, ["b"], 0, 2, 8, 8).collect()}
    assert found[2]["input_ids"] == [1, 0, 0, 0] and found[2]["attention_mask"] == [1, 0, 0, 0] and found[1]["labels"] == [5, -100, -100, -100] and found[2]["input_length"] == 1
    assert found[3]["input_ids"] is None


def test_weighted_loss(spark):
    kind = "loss double, ntok long"
    assert metrics.weighted_loss(spark.createDataFrame([(2.0, 10), (4.0, 30), (9.0, 0)], kind)).first()[0] == 3.5
    assert math.isnan(metrics.weighted_loss(spark.createDataFrame([(9.0, 0)], kind)).first()[0])


def test_text_metrics_by_hand(spark):
    pairs = spark.createDataFrame([("the cat sat on the mat", "the cat sat on the mat"), ("a b", "a c"), (None, "x")], "pred string, ref string")
    s = metrics.bleu_statistics(pairs, "none").first().asDict()
    assert (s["hyp_len"], s["ref_len"], s["hit1"], s["all1"], s["hit2"], s["all2"]) == (8, 9, 7, 8, 5, 6)
    want = 100 * math.exp(1 - 9 / 8) * (7 / 8 * 5 / 6 * 4 / 4 * 3 / 3) ** 0.25
    assert metrics.bleu(pairs, "none").first()[0] == pytest.approx(want)
    same = spark.createDataFrame([("hello, world. 3.5", "hello, world. 3.5")], "pred string, ref string")
    assert metrics.bleu(same).first()[0] == pytest.approx(100.0) and metrics.chrf(same).first()[0] == pytest.approx(100.0)
    assert metrics.tokens_13a("Hello, world. 3.5-4") == ["Hello", ",", "world", ".", "3.5", "-", "4"]
    assert metrics.meteor_row("the cat sat", "the cat sat") == pytest.approx(1 - 0.5 / 27)
    assert metrics.meteor_row("walking", "walked") > 0 and metrics.meteor_row("x", "y") == 0
    none = pairs.withColumn("only", F.lit(False))
    assert math.isnan(metrics.meteor(none, "only").first()[0])


def test_stride_and_flush(spark):
    numbered = spark.createDataFrame([(i,) for i in range(1, 9)], "num int")
    assert sorted(r[0] for r in evalplan.stride_sample(numbered, 10, 3).collect()) == [1, 4, 7]
    assert evalplan.stride_sample(numbered, 3, 10).count() == 8
    batches = spark.createDataFrame([(i, n) for i, n in enumerate([3, 3, 5, 1, 9, 2])], "i int, n int")
    assert [r["flush_no"] for r in evalplan.flush_groups(batches, 6, ["i"]).orderBy("i").collect()] == [0, 0, 1, 1, 2, 3]


def test_golden_limits():
    c = RegimeConfig(tokens=4096, examples=64, safe_floor=2957)
    s = regime.Regime.fresh(c)
    for _ in range(5):
        regime.succeed(s, c)
    assert (s.hwm_B, s.hwm_T) == (64, 4096)
    regime.fail(s, c, True)
    assert s.B == 54
    regime.fail(s, c, False)
    assert s.T == 3481
    regime.fail(s, c, False)
    assert s.T == 2958
    for _ in range(5):
        regime.succeed(s, c)
    assert (s.T, s.B) == (3549, 64)
    for _ in range(5):
        regime.succeed(s, c)
    assert s.T == 4096
    s = regime.Regime(T=4096, B=44, hwm_T=4096, hwm_B=64)
    for want in (53, 64):
        for _ in range(5):
            regime.succeed(s, c)
        assert s.B == want


def test_golden_tuning():
    c = RegimeConfig(tokens=1 << 20, autotune_safety=0.75)
    s = regime.Regime.fresh(c)
    regime.tune(s, c, 48 << 30, 16 << 30, 80 << 30, 100000)
    assert s.T == 150000 and s.bytes_per_token == pytest.approx(343597.38368) and s.tuned


def log_rows(n=120):
    draw = random.Random(3)
    return [(i % 3, i, 0, draw.choice(["ok"] * 6 + ["oom", "partial"]), bool(draw.getrandbits(1)), draw.choice([None, 20.0, 90.0]), *draw.choice([(None,) * 4, (40 << 30, 16 << 30, 80 << 30, 5000)])) for i in range(n)]


LOG_KIND = "regime_key int, step long, attempt int, outcome string, shrink_b boolean, util20 double, peak long, baseline long, total long, max_mb_eff long"


def test_replay_follows_the_machine(spark):
    c = RegimeConfig(tokens=2048, examples=32)
    found = {(r["regime_key"], r["step"]): r for r in regime.replay(spark.createDataFrame(log_rows(), LOG_KIND), c).collect()}
    held: dict = {}
    for key, step, attempt, outcome, shrink, util, *memory in log_rows():
        s = regime.apply_row(held, key, c, regime.Regime.fresh(c), outcome, attempt, shrink, util, *memory)
        assert {k: found[key, step][k] for k in asdict(s)} == asdict(s)


def test_a_failure_keeps_what_memory_safely_holds():
    """By hand: 64 GiB beyond the baseline at 2 MiB a token, the dearest of other regimes, two thirds of it: 21626 tokens."""
    c = RegimeConfig(tokens=1 << 16, examples=8)
    regimes = {1: regime.Regime(T=22000, B=8, bytes_per_token=9e9), 2: regime.Regime(T=10, bytes_per_token=float(1 << 21)), 3: regime.Regime(T=10, bytes_per_token=5.0)}
    s = regime.apply_row(regimes, 1, c, regime.Regime.fresh(c), "oom", 1, False, None, None, 16 << 30, 80 << 30, None)
    assert (s.T, s.B, s.bytes_per_token, s.oom_count) == (21626, 8, None, 1)
    s = regime.apply_row(regimes, 3, c, regime.Regime.fresh(c), "oom", 1, False, None, None, None, None, None)
    assert s.T == 64  # without memory figures the least T


def test_failures_by_hand(spark):
    said = {
        "CUDA out of memory. Tried": ("memory", True), "CUBLAS_STATUS_ALLOC_FAILED": ("memory", True), "cudaMalloc failed": ("memory", False), "cudaErrorLaunchTimeout": ("device", True),
        "the launch timed out and was terminated": ("device", True), "CUDA error: assert": ("device", True), "cuda error: x": ("other", False), "out of memory": ("other", False), "launch timed out": ("other", False),
    }
    rows = spark.createDataFrame([(x,) for x in said] + [(None,)], "m string").select("m", scalar.oom_class(F.col("m")).alias("kind"), scalar.worth_saving(F.col("m")).alias("save")).collect()
    assert {r["m"]: (r["kind"], r["save"]) for r in rows} == said | {None: ("other", False)}


def test_timing_by_hand(spark):
    """Two steps a window: a gap's mean counts its own rows, what is idle is the mean gap against a mean whole step, and a part of a window isn't said."""
    rows = [(1, 1, 10.0, 90.0, 100.0, None, 4, 40, 1, None), (1, 2, 20.0, 180.0, 200.0, 50.0, 6, 60, 3, 30.0), (1, 3, 0.0, 10.0, 10.0, 5.0, 1, 1, 1, 50.0)]
    log = spark.createDataFrame(rows, "run int, step int, plan_ms double, exec_ms double, total_ms double, gap_ms double, examples int, tokens int, microbatches int, util double")
    (r,) = telemetry.timing_means(log, ["run"], ["step"], 2).collect()
    assert (r["steps"], r["mean_plan"], r["mean_exec"], r["mean_total"], r["mean_gap"], r["mean_examples"], r["mean_tokens"], r["mean_microbatches"], r["utilisation"]) == (2, 15.0, 135.0, 150.0, 50.0, 5.0, 50.0, 2.0, 30.0)
    assert r["idle_pct"] == 25.0


def test_stream_equals_replay(spark, tmp_path):
    c = RegimeConfig(tokens=2048, examples=32)
    for part, at in enumerate(range(0, 120, 60)):
        spark.createDataFrame(log_rows()[at : at + 60], LOG_KIND).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    source = spark.readStream.schema(LOG_KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = regimes.stream(source, c).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination()
    names = ["regime_key", "step", *[f.name for f in regime.STATE]]
    streamed = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*names).collect()))
    assert streamed == sorted(map(tuple, regime.replay(spark.createDataFrame(log_rows(), LOG_KIND), c).select(*names).collect()))


def test_state_is_saved_and_restored(spark, tmp_path):
    rows = [(1, 512, 8, 3, 600, None, 1.5, 2, 1, 4, True), (7, 64, None, 0, None, None, None, 0, 0, 0, False)]
    states = spark.createDataFrame(rows, T.StructType([T.StructField("regime_key", T.IntegerType()), *regime.STATE.fields]))
    path = str(tmp_path / "state")
    assert state.load(spark, path) is None
    state.save(states, path)
    found = {r["regime_key"]: r for r in state.load(spark, path).collect()}
    assert (found[1]["T"], found[1]["B"], found[1]["oom_count"], found[1]["tuned"], found[1]["adaptive_ramps"], found[7]["B"]) == (512, 8, 4, False, 0, None)
    for _ in range(3):  # a reader sees whole versions alone, and old ones go
        state.save(states.filter("regime_key = 7"), path)
    assert [r["regime_key"] for r in state.load(spark, path).collect()] == [7] and len(list((tmp_path / "state").glob("version=*"))) == 2
    assert state.save_on_failure(states, path, "CUDA error: x") and state.load(spark, path).count() == 2 and not state.save_on_failure(states, path, "KeyError")
    assert state.summary(states, RegimeConfig(), spark.createDataFrame([(10.0,), (None,)], "util double")).first()["utilisation"] == 10.0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text("not json")
    assert state.load(spark, str(tmp_path / "bad")) is None


def test_global_and_evaluation_limits():
    c = RegimeConfig(tokens=400, examples=8)
    assert regime.shrink_global(400, 8, c) == (400, 4, True) and regime.shrink_global(400, 1, c) == (340, 1, True) and regime.shrink_global(64, 1, c) == (64, 1, False)
    s = regime.Evaluation(400, 8, 4)
    assert regime.eval_shrink(s, c) and s.G == 4
    s.G = 1
    assert regime.eval_shrink(s, c) and s.T == 340
    s.T = 64
    assert regime.eval_shrink(s, c) and s.B == 2
    s.B = 1
    assert not regime.eval_shrink(s, c)
    regime.eval_bootstrap(s)
    assert (s.hwm_T, s.hwm_G) == (64, 1) and regime.eval_start(400, 64) == 64 and regime.eval_start(400, None) == 400


def test_records_are_compact_json(spark):
    log = spark.createDataFrame([(1, 12.25, None, "ok"), (2, 30.0, 10.0, "oom")], "step long, exec_ms double, gap_ms double, outcome string")
    found = [json.loads(r["record"]) for r in telemetry.records(log).orderBy("step").collect()]
    assert found == [{"step": 1, "exec_ms": 12.2, "outcome": "ok"}, {"step": 2, "exec_ms": 30.0, "gap_ms": 10.0, "busy_pct": 75.0, "outcome": "oom"}]


def test_next_fit_tables_follow_the_machine():
    """Tables of blocks, put together, say what a pass over all rows does, whatever is open before."""
    draw = random.Random(11)
    for _ in range(300):
        budget = draw.choice([5, 20, 100])
        parts = [[draw.choice([0, 0, 1, draw.randint(0, budget + 3)]) for _ in range(draw.randint(1, 12))] for _ in range(draw.randint(1, 4))]
        alone = [[draw.random() < 0.1 for _ in p] for p in parts]
        blocks = [nextfit.Block(np.array(p), budget, np.array(a)) for p, a in zip(parts, alone)]
        table = blocks[0].table()
        for b in blocks[1:]:
            table = table.then(b.table(), budget)
        for carry in (0, 1, draw.randint(0, budget), budget, budget + 1):
            held, started, labels = carry, 0, []
            for length, lone in zip(sum(parts, []), sum(alone, [])):
                if held > budget or lone or held + length > budget:
                    started, held = started + 1, budget + 1 if lone or length > budget else length
                else:
                    held += length
                labels.append(started)
            got_started, got_held = table.after(budget, carry)
            assert (int(got_started), int(got_held)) == (started, held)
            at, open_, numbers = 0, carry, []
            for b in blocks:
                own = b.table()
                numbers += (at + np.cumsum(b.starts(int(own.absorbed(budget, open_))))).tolist()
                more, open_ = (int(x) for x in own.after(budget, open_))
                at += more
            assert numbers == labels


@pytest.mark.parametrize("kind", ["long", "string"])
def test_one_bucket_is_packed_in_chunks(spark, monkeypatch, kind):
    monkeypatch.setattr(nextfit, "BLOCK", 7)
    draw = random.Random(12)
    rows = [(i * 3, draw.randint(0, 40)) for i in range(500)]
    frame = spark.createDataFrame(rows, "example_id long, L int").withColumn("example_id", F.lpad(F.col("example_id").cast("string"), 6, "0") if kind == "string" else F.col("example_id"))
    found = sampler.pack(frame, PackConfig(100, 10**6), n_chunks=5).filter("bucket_id >= 0").orderBy("example_id").collect()
    number, want = {0: -1, 1: -1}, []
    open_ = {0: 101, 1: 101}
    for _, length in rows:
        b = -(-length // 10**6)
        if open_[b] + length > 100:
            number[b] += 1
            open_[b] = length
        else:
            open_[b] += length
        want.append(number[b])
    assert [r["batch_no"] for r in found] == want


def test_stems_and_synonyms(spark):
    words = "caresses ponies ties caress cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational digitizer operator feudalism decisiveness hopefulness formality sensibility triplicate formative formalize electrical goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment dependent adoption communism activate effective probate rate cease controll roll".split()
    want = "caress poni ti caress cat feed agre plaster motor sing conflat troubl size hop tan fall hiss fizz fail file happi sky relat condit ration digit oper feudal decis hope formal sensibl triplic form formal electr good reviv allow infer airlin adjust defens irrit replac adjust depend adopt commun activ effect probat rate ceas control roll".split()
    assert [stemmer.stem(w) for w in words] == want
    pairs = spark.createDataFrame([("the big cat runs", "the large cats run")], "pred string, ref string")
    thesaurus = spark.createDataFrame([("Big", "large")], "word string, synonym string")
    score = lambda **how: metrics.meteor(pairs, **how).first()[0]
    assert score(stages=(metrics.EXACT,)) == pytest.approx(0.25 * 0.5)
    assert score() == pytest.approx(0.75 * (1 - 0.5 * (2 / 3) ** 3)) and score(synonyms=thesaurus) == pytest.approx(1 - 0.5 * (1 / 4) ** 3)


def test_metrics_by_name(spark):
    pairs = spark.createDataFrame([("a b c d", "a b c d"), (None, "x")], "pred string, ref string")
    assert metrics.factory([" SacreBLEU", "chrF++", "bleu"])(pairs).columns == ["bleu", "chrf"]
    with pytest.raises(ValueError, match="comet"):
        metrics.factory(["comet"])
    ids = spark.createDataFrame([([1, 2, 0, 99],), (None,)], "ids array<int>")
    assert [r["text"] for r in metrics.decoded(ids, "ids", ["<pad>", "▁he", "llo"], (0,)).collect()] == ["hello", None]


def test_settings():
    assert config.generation_arguments({"generation_max_length": "9", "top_k": 5}, {"max_length": 1, "num_beams": 2}) == {"max_length": 9, "num_beams": 2}
    assert config.generation_arguments({"do_sample": True, "top_k": 5, "top_p": "0.5"}) == {"do_sample": True, "top_k": 5, "top_p": 0.5}
    assert config.device_memory([80.0, 24.0]) == 24.0 and config.device_memory([], 48.0) == 48.0
    with pytest.raises(ValueError, match="sentinels"):
        corrupt.SpanConfig(vocab=31999)


def test_loaders(spark):
    rows = [(i, list(range(2, 3 + i % 5)), [1] * (1 + i % 5), [4] * (1 + i % 3)) for i in range(20)]
    frame = spark.createDataFrame(rows, "example_id long, input_ids array<int>, attention_mask array<int>, labels array<int>").withColumn("junk", F.lit(1))
    fixed = loaders.train_batches(frame, None, 8, seed="s").collect()
    assert sorted(Counter(r["emit_pos"] for r in fixed).items()) == [(0, 8), (1, 8), (2, 4)] and "junk" not in fixed[0]
    packed = loaders.train_batches(frame, PackConfig(30, 4, shuffle=True, mode="interleave"), collator=lambda rows, by: rows.withColumn("own", F.lit(1)))
    assert packed.filter("own = 1").count() == 20
    with pytest.raises(ValueError, match="labels"):
        loaders.eval_batches(frame.drop("labels"), None)
    assert collate.without_length(frame.withColumn("input_length", F.lit(1))).columns == frame.columns


def test_evaluation_flow_by_hand(spark):
    """G 4, T 100, capacity 60: whole, whole fails and T shrinks until it fits, then a flush over G is split at once, and what can't fit is skipped."""
    c = RegimeConfig(tokens=100, max_retries=3, shrink_tokens=0.5, shrink_examples=0.5, min_tokens=16)
    flushes = spark.createDataFrame([(0, [10.0] * 4), (1, [30.0] * 4), (2, [5.0] * 6), (3, [70.0])], "flush_no int, lengths array<double>")
    found = evalplan.generation_flow(flushes, c, regime.Evaluation(100, 4, 8), 60).orderBy("flush_no").collect()
    assert [(r["path"], r["attempts"], r["microbatches"], r["T"], r["G"]) for r in found] == [("whole", 0, 1, 100, 4), ("split", 2, 2, 100, 2), ("split", 0, 3, 100, 2), ("skipped", 5, 0, 21, 1)]
    assert (found[1]["hwm_T"], found[1]["hwm_G"]) == (100, 2)
