"""Near dedup (4), mixing (5), line dedup (6) and sharding (9)."""

from __future__ import annotations

import datetime
import hashlib
import random
import re
from collections import Counter, defaultdict
from decimal import Decimal

import cases
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packframe.llm import line_dedup, mixing, near_dedup, sharding


def alike(docs, threshold=near_dedup.THRESHOLD):
    """(ids, every pair at or above the threshold), by comparing all documents with all."""
    counts, n = near_dedup.document_frequency(docs.select(F.lower("text").alias("t")), near_dedup.SHINGLE)
    idf = near_dedup.inverse_frequency(counts, n, near_dedup.FLOOR)
    rows = docs.filter("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.lower("text").alias("t")).collect()
    keys, weights, offsets = near_dedup.weighted(pa.array([r["t"] for r in rows], pa.string()), near_dedup.SHINGLE, idf)
    sets = [(keys[a:b], weights[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    ids = [r["doc_id"] for r in rows]
    pairs = {(ids[i], ids[j]) for i in range(len(ids)) for j in range(len(ids)) if ids[i] < ids[j] and len(sets[i][0]) and len(sets[j][0]) and near_dedup.jaccard(sets[i], sets[j]) >= threshold}
    return ids, pairs


def groups_of(ids, pairs):
    label = {i: i for i in ids}
    for _ in range(len(ids)):
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    return label


def test_near_dedup_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ids, pairs = alike(docs)
    want = groups_of(ids, pairs)
    got = {r["doc_id"]: r["group_id"] for r in near_dedup.near_dedup(docs).collect()}
    assert set(got) == set(ids) and len(pairs) > 50
    together = [(a, b) for a, b in pairs if got[a] == got[b]]
    assert len(together) >= 0.95 * len(pairs)  # recall of pairs
    assert all(want[i] == want[g] for i, g in got.items())  # nothing grouped that isn't connected


@pytest.mark.parametrize("limits", [{}, {"STAR": 2, "SMALL": 1, "BLOCK": 2}])
def test_no_candidate_link_is_lost(spark, monkeypatch, limits):
    """The groups are those of all pairs that share a band and are alike, whether bands are compared pair by pair or in blocks."""
    for name, value in limits.items():
        monkeypatch.setattr(near_dedup, name, value)
    draw = random.Random(2)
    bases = [cases.prose(i, 60).split() for i in range(6)]
    rows = []
    for i in range(160):  # chains of texts that drift apart
        words = list(draw.choice(bases))
        for _ in range(draw.randint(0, 14)):
            words[draw.randrange(len(words))] = f"w{draw.randint(0, 50)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids, pairs = alike(docs)
    counts, n = near_dedup.document_frequency(docs.select(F.lower("text").alias("t")), near_dedup.SHINGLE)
    shared = spark.sparkContext.broadcast(near_dedup.inverse_frequency(counts, n, near_dedup.FLOOR))
    table = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t0"), F.lower("text").alias("t"))
    bands = {r["id"]: set(r["bands"]) for r in near_dedup.sketches(table, shared, near_dedup.SHINGLE, near_dedup.BANDS, near_dedup.ROWS).collect()}
    want = groups_of(ids, {(a, b) for a, b in pairs if bands[a] & bands[b]})
    got = {r["doc_id"]: r["group_id"] for r in near_dedup.near_dedup(docs).collect()}
    assert got == want and len(set(want.values())) > 6


def test_repeated_ids_are_one_document(spark):
    """Of an id's texts only one counts, so that its other texts link nothing."""
    a, b = cases.prose(1, 80), cases.prose(2, 80)
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    rows = [(1, a), (1, b), (2, a), (3, b), (4, b + " x")]
    found = {r["doc_id"]: r["group_id"] for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == ({1: 1, 2: 1, 3: 3, 4: 3} if md5(a) > md5(b) else {1: 1, 2: 2, 3: 1, 4: 1})


def test_one_document_of_each_group_stays(spark):
    base = cases.prose(9, 200).split()
    rows = [(i, " ".join(base[:-1] + [f"end{i}"])) for i in range(40)] + [(100 + i, cases.prose(50 + i, 200)) for i in range(20)] + [(200, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(docs).collect())
    assert kept == [0, *range(100, 120)]
    made = near_dedup.near_dedup(docs)
    found = made.filter("group_id = 0").agg(F.count(F.lit(1)), F.max("group_size"), F.count(F.when(F.col("keep"), 1)), F.min("n_links")).first()
    assert tuple(found) == (41, 41, 1, 1) and made.filter("group_id <> 0").agg(F.max("n_links")).first()[0] == 0


def test_near_dedup_of_messy_rows(spark):
    for frame in (cases.messy(spark), cases.clashing(spark)):
        found = {r["doc_id"]: r for r in near_dedup.near_dedup(frame).collect()}
        assert set(found) == set(range(11))
        assert found[6]["group_id"] == 5 and found[7]["group_id"] == 5 and all(found[i]["keep"] for i in (0, 1, 2, 3, 4, 5, 8, 9, 10))
        kept = near_dedup.drop_near_duplicates(frame)
        assert kept.columns == frame.columns
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter({**dict.fromkeys((0, 1, 2, 3, 4, 5, 8, 9), 1), 10: 3, None: 2})
    assert near_dedup.near_dedup(cases.empty(spark)).count() == near_dedup.drop_near_duplicates(cases.empty(spark)).count() == 0


def test_samples_agree_as_weighted_jaccard(spark):
    draw = random.Random(1)
    texts = [" ".join(f"w{draw.randint(0, 60)}" for _ in range(400)) for _ in range(8)]
    idf = np.ones(1 << near_dedup.COUNTERS, np.float32)
    keys, weights, offsets = near_dedup.weighted(pa.array(texts), 1, idf)
    samples = near_dedup.signatures(keys, weights, offsets, 600, near_dedup.draws(600))
    sets = [(keys[a:b], weights[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    for i in range(8):
        for j in range(i):
            assert (samples[i] == samples[j]).mean() == pytest.approx(near_dedup.jaccard(sets[i], sets[j]), abs=0.09)


def brute_lines(rows, ratio, least):
    """(the texts after boilerplate lines went), host by host."""
    strip = lambda x: x.strip(" \t\r")
    pages, holding = Counter(h for h, _ in rows), defaultdict(Counter)
    for h, t in rows:
        holding[h].update({strip(x) for x in (t or "").split("\n")} if t is not None else ())
    bad = {h: {x for x, n in c.items() if x and n >= least and n > pages[h] * ratio} for h, c in holding.items()}
    return [(h, None if t is None else "\n".join(x for x in t.split("\n") if strip(x) not in bad[h])) for h, t in rows]


def test_lines_by_brute_force(spark):
    draw = random.Random(5)
    rows = []
    for i in range(300):
        lines = [f"body {draw.randint(0, 10_000)}" for _ in range(5)]
        if i % 3:
            lines.insert(0, "  Home | About\t")
        if i % 50 == 0:
            lines.append("rare")
        lines += ["", "", f"said by {i % 4}"]
        rows.append((draw.choice(["a", "b", None]), "\n".join(lines)))
    rows += [("a", None), ("b", ""), ("c", "Home | About"), (None, "Home | About")]
    frame = spark.createDataFrame(rows, "source string, text string").withColumns({c: F.lit(1) for c in ("_host", "_lines", "_kept", "_text", "host", "line", "h", "t")})
    made = line_dedup.dedup_lines(frame)
    assert made.columns == frame.columns
    assert sorted(((r["source"], r["text"]) for r in made.collect()), key=repr) == sorted(brute_lines(rows, line_dedup.RATIO, line_dedup.MIN_PAGES), key=repr)


def test_lines_of_messy_rows(spark):
    for frame in (cases.messy(spark), cases.clashing(spark)):
        assert sorted(map(repr, line_dedup.dedup_lines(frame).collect())) == sorted(map(repr, frame.collect()))
    assert line_dedup.dedup_lines(cases.empty(spark)).count() == 0


def brute_mix(rows, block_tokens, even, seed):
    """The schedule, slot by slot; rows: (id, text, source)."""
    held = defaultdict(list)
    for i, text, source in rows:
        tokens = max(1, len(re.findall(r"[^ \t\r\n]+", text or "")))
        held[source or ""].append((hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i, tokens))
    blocks, sums = {}, {}
    for s, docs in held.items():
        at, out = 0, defaultdict(list)
        for _, i, tokens in sorted(docs):
            out[at // block_tokens].append((at, i, tokens))
            at += tokens
        blocks[s], sums[s] = out, at
    total = sum(sums.values())
    weight = {s: (1 - even) * n / total + even / len(sums) for s, n in sums.items()}
    ends, high = [], 0.0
    for s in sorted(weight):
        high += weight[s]
        ends.append((high, s))
    ends[-1] = (1.0, ends[-1][1])
    size = {s: max(b) + 1 for s, b in blocks.items()}
    rank, out, slot = Counter(), [], 0
    while any(rank[s] < size[s] for s in size):
        x = (slot + 1) * mixing.PHI % 1.0
        s = next(s for h, s in ends if x < h)
        out += [(slot, at, s, rank[s] // size[s], rank[s] % size[s], i, tokens) for at, i, tokens in blocks[s][rank[s] % size[s]]]
        rank[s] += 1
        slot += 1
    return sorted(out)


def test_mix_by_brute_force(spark):
    draw = random.Random(2)
    rows = [(i, cases.prose(i, draw.randint(0, 120)), draw.choice(["a", "b", "b", "b", "b", "c", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, mixing.mix(docs, block_tokens=256).collect()))
    assert got == brute_mix(rows, 256, mixing.EVEN, mixing.SEED)
    assert {r[5] for r in got} == set(range(400))


@pytest.mark.parametrize("sequence", ["golden", "van_der_corput"])
def test_mix_reaches_the_weights(spark, sequence):
    docs = spark.createDataFrame([(i, "w " * 64, "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    weights = {"a": 3.0, "b": 2.0, "c": 1.0, "absent": 5.0}
    out = mixing.mix(docs, weights, block_tokens=256, sequence=sequence).groupBy("source").agg(F.sum("tokens").alias("n"), F.countDistinct("doc_id").alias("d")).collect()
    total = sum(r["n"] for r in out)
    assert {r["source"]: r["d"] for r in out} == {"a": 200, "b": 200, "c": 200}
    for r in out:
        assert r["n"] / total == pytest.approx(weights[r["source"]] / 6, abs=0.02)
    assert mixing.mix(docs, {"a": 1.0}).select("source").distinct().count() == 1


def test_van_der_corput_points(spark):
    """The radical inverse, also beyond 2**32 slots."""
    slots = [1, 2, 3, 6, (1 << 32) + 1, (1 << 40) + 3, (1 << 52) + 5]
    want = [sum(0.5 ** (k + 1) for k in range(53) if i >> k & 1) for i in slots]
    rows = spark.createDataFrame([(i,) for i in slots], "i long").select("i", mixing.van_der_corput(F.col("i")).alias("x")).collect()
    assert [r["x"] for r in sorted(rows)] == pytest.approx(want, abs=1e-15)


def test_mixed_documents_keep_the_schedule(spark):
    """Each row, also of a repeated or null id, is there as often as its own slots take it, in their order."""
    draw = random.Random(3)
    rows = [(draw.choice([None, 1, 2, 3 + i]), cases.prose(i, 30 + i), draw.choice("aaab")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("_row", "_slot", "_position", "_of", "slot", "by", "t")})
    found = [r["text"] for r in mixing.mixed_documents(docs, block_tokens=200).collect()]
    plan = mixing.mix(docs.withColumn("row", F.monotonically_increasing_id()), None, "row", block_tokens=200, order_id="doc_id").join(docs.select(F.monotonically_increasing_id().alias("doc_id"), "text"), "doc_id")
    assert found == [r["text"] for r in plan.orderBy("slot", "position").collect()] and set(found) == {t for _, t, _ in rows}


def test_mix_of_messy_rows(spark):
    for frame in (cases.messy(spark), cases.clashing(spark)):
        made = mixing.mixed_documents(frame)
        assert made.columns == frame.columns
        assert set(map(repr, made.collect())) == set(map(repr, frame.collect()))
    assert mixing.mix(cases.empty(spark)).count() == mixing.mixed_documents(cases.empty(spark)).count() == 0


def checked_shards(spark, rows, target):
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("_key", "_hash", "_size", "_range", "k", "h", "s", "r")})
    out = sharding.shard(frame, ["source", "doc_id"], target_bytes=target).withColumn("part", F.spark_partition_id()).collect()
    assert sorted(((r["doc_id"], r["text"], r["source"]) for r in out), key=repr) == sorted(rows, key=repr)
    size, keys, parts = Counter(), defaultdict(list), defaultdict(set)
    for r in out:
        size[r["shard"]] += max(1, len((r["text"] or "").encode()))
        keys[r["shard"]].append(tuple((x is not None, x if x is not None else 0) for x in (r["source"], r["doc_id"])))
        parts[r["shard"]].add(r["part"])
    largest = max((len((t or "").encode()) for _, t, _ in rows), default=0)
    assert sorted(size) == list(range(len(size))) and all(len(p) == 1 for p in parts.values())
    assert all(n <= sharding.OVERFULL * target + largest for n in size.values())
    comparable = {s: sorted((str(k[0]), k[1]) for k in v) for s, v in keys.items()}
    assert all(comparable[s][-1] <= comparable[s + 1][0] for s in range(len(size) - 1))
    return size


def test_shards(spark):
    draw = random.Random(8)
    rows = [(draw.randint(-500, 500), "x" * draw.randint(0, 400), draw.choice(["a", "b"])) for i in range(2000)]
    size = checked_shards(spark, rows, 10_000)
    assert sum(size.values()) / 10_000 * 0.8 <= len(size) <= sum(size.values()) / 10_000 * 2.2
    hot = [(1, "y" * 100, "a")] * 900 + [(i, "z" * 50, "b") for i in range(100)]
    assert len(checked_shards(spark, hot, 5_000)) >= 15
    checked_shards(spark, [(None, None, None), (1, "", "a"), (2, "x" * 50_000, "a"), (3, "b", None)], 1000)


def test_equal_rows_are_dealt_out_whatever_the_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        size = checked_shards(spark, [(1, "y" * 100, "a")] * 400, 5_000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(size) == 8


@pytest.mark.parametrize(
    ("kind", "values"),
    [
        ("double", [-50.5, -5.0, -0.0, 0.0, 2.0, 9.0, 10.0, 100.0, 1e300, -1e300, float("inf"), float("-inf")]),
        ("decimal(20,3)", [Decimal(x) for x in ("-12.5", "-1.001", "0", "0.001", "2", "9", "10", "100.25")]),
        ("date", [datetime.date(y, 5, 4) for y in (1800, 1969, 1970, 1999, 2024)]),
        ("timestamp", [datetime.datetime(y, 5, 4, 3, 2, 1, 7) for y in (1950, 1970, 1999, 2024)]),
        ("string", ["", "a", "a\x00", "a\x00b", "a\x01", "a\x01b", "ab", "é", "中"]),
        ("binary", [b"", b"\x00", b"\x00\x01", b"a", b"\xff"]),
        ("int", [-(1 << 31), -10, -9, 0, 9, 10, 100]),
        ("boolean", [False, True]),
    ],
)
def test_keys_sort_as_their_values(spark, kind, values):
    rows = [(x, y) for x in [*values, None] for y in (2, 10)]
    frame = spark.createDataFrame(rows, f"x {kind}, y long")
    made = frame.select("x", "y", sharding.sort_key(frame, ["x", "y"]).alias("k")).collect()
    rank = {x: i for i, x in enumerate(sorted(set(values)))}
    order = sorted(made, key=lambda r: (-1 if r["x"] is None else rank[bytes(r["x"]) if kind == "binary" else r["x"]], r["y"]))
    keys = [r["k"].encode() for r in order]
    assert keys == sorted(keys)
    with pytest.raises(ValueError, match="order of keys"):
        sharding.sort_key(frame.withColumn("z", F.array("y")), ["z"])


def test_shards_of_messy_rows(spark):
    for frame in (cases.messy(spark), cases.clashing(spark)):
        made = sharding.shard(frame, ["source", "doc_id"])
        assert [c for c in made.columns if c != "shard"] == [c for c in frame.columns if c != "shard"] and made.count() == frame.count()
    assert sharding.shard(cases.empty(spark), ["source", "doc_id"]).count() == 0
