"""Fingerprints (1), PPM scoring (2) and chat preferences (3)."""

from __future__ import annotations

import hashlib
import math
import re

import cases
import compare
import pytest
from pyspark.sql import functions as F

from packframe.llm import chat, fingerprints, ppm, registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf_dir, db, name):
    assert compare.differences(registry.queries()[name](spark, sf_dir), db, registry.oracle_sql()[name]) == []


def shingle_hashes(text, n=fingerprints.N) -> list[int]:
    words = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % fingerprints.WORD_RANGE for w in re.split("[ \t\n\r\x0b\x0c]+", (text or "").lower()) if w]
    every = range(max(1, len(words) - n + 1)) if words else []
    return sorted({sum(w * f for w, f in zip(words[i : i + n], fingerprints.FACTORS)) % fingerprints.RANGE for i in every})


def test_sketches_by_brute_force(spark):
    got = fingerprints.fingerprints(cases.clashing(spark), cases.messy(spark).filter("doc_id = 5")).collect()
    other = shingle_hashes(cases.messy_rows()[5][1])[: fingerprints.K]
    want = []
    for doc_id, text, *_ in cases.messy_rows():
        s = shingle_hashes(text)[: fingerprints.K]
        union = sorted({*s, *other})[: fingerprints.K]
        want.append((doc_id, ",".join(map(str, s)), round(len({*union} & {*s} & {*other}) / len(union), 6)))
    assert sorted(((r["doc_id"], r["sketch"], r["resemblance"]) for r in got), key=repr) == sorted(want, key=repr)
    empty = next(r for r in got if r["doc_id"] == 1)
    assert (empty["n_sketch"], empty["distinct_shingles"], empty["containment"]) == (0, 0.0, 0.0)
    assert fingerprints.fingerprints(cases.empty(spark), cases.empty(spark)).count() == 0
    alone = fingerprints.fingerprints(cases.messy(spark), cases.empty(spark)).agg(F.max("resemblance"), F.max("containment")).first()
    assert tuple(alone) == (0.0, 0.0)


@pytest.mark.parametrize("most", [fingerprints.BROADCAST_BYTES, 0])
def test_item_overlaps_by_brute_force(spark, most):
    """A short item in a long document, among many other items, is found whole."""
    items = [*[(i, cases.prose(i + 50, 60)) for i in range(6)], (6, None), (7, "one"), (None, cases.prose(1, 30)), (0, cases.prose(50, 60))]
    docs = [*[r[:2] for r in cases.messy_rows()], (20, f"{cases.prose(9, 2000)} {cases.prose(52, 60)} {cases.prose(8, 2000)}"), (21, cases.prose(53, 40))]
    found = fingerprints.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most=most).collect()
    want = []
    for (doc_id, text), (item_id, other) in ((d, i) for d in docs for i in items):
        a, b = {*shingle_hashes(text)}, {*shingle_hashes(other)}
        if both := len(a & b):
            want.append((doc_id, item_id, both, len(a), len(b), round(both / len(a | b), 6), round(both / len(a), 6), round(both / len(b), 6)))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert any(r["doc_id"] == 20 and r["item_id"] == 2 and r["item_in_doc"] == 1.0 for r in found)


def test_item_overlaps_are_registered(spark, sf_dir):
    assert registry.queries()["op1_item_overlaps"](spark, sf_dir).filter("item_in_doc >= 0.8").count() > 0
    assert fingerprints.overlaps(cases.messy(spark), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_sketches_merge_and_estimate(spark):
    texts = [cases.prose(i, 3000) for i in range(4)] + [cases.prose(0, 3000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    merged = fingerprints.merge(fingerprints.sketch(docs.withColumn("g", F.lit(1)), []).withColumn("g", F.lit(1)), ["g"]).first()["sketch"]
    every = sorted({h for t in texts for h in shingle_hashes(t)})
    assert merged == every[: fingerprints.K]
    found = spark.createDataFrame([(merged,)], "s array<bigint>").select(fingerprints.distinct_estimate(F.col("s"))).first()[0]
    assert found == pytest.approx(len(every), rel=0.3)
    one = spark.createDataFrame([(shingle_hashes(texts[0])[: fingerprints.K], merged)], "a array<bigint>, b array<bigint>")
    r, c = one.select(fingerprints.resemblance(F.col("a"), F.col("b")), fingerprints.containment(F.col("a"), F.col("b"))).first()
    assert r == pytest.approx(0.25, abs=0.15) and c == pytest.approx(1.0, abs=0.35)


def brute_bits(texts: list[str | None], text: str, order: int) -> float:
    """PPM with exclusion, straight from counts of the whole corpus."""
    seen: dict = {}
    for t in texts:
        raw = bytes(order) + (t or "").encode()
        for i in range(order, len(raw)):
            for k in range(order + 1):
                followers = seen.setdefault(raw[i - k : i], {})
                followers[raw[i]] = followers.get(raw[i], 0) + 1
    raw, bits = bytes(order) + text.encode(), 0.0
    for i in range(order, len(raw)):
        excluded: set = set()
        for k in range(order, -1, -1):
            left = {s: n for s, n in seen.get(raw[i - k : i], {}).items() if s not in excluded}
            if not left:
                continue
            total = sum(left.values()) + len(left)
            if raw[i] in left:
                bits += math.log2(total / left[raw[i]])
                break
            bits += math.log2(total / len(left))
            excluded |= left.keys()
        else:
            bits += math.log2(256 - len(excluded))
    return bits


def test_pretrained_scores_by_brute_force(spark):
    corpus = ["abracadabra abracadabra", "the cat sat on the mat", None, "", "zzz theé"]
    trie = ppm.train(spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string"), order=3, min_rate=0.0)
    probes = [*corpus, "abra the hat xyz", "中"]
    found = {r["doc_id"]: r for r in ppm.score(spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string"), trie).collect()}
    for i, text in enumerate(probes):
        if text is None:
            assert found[i]["bits"] is None and found[i]["n_bytes"] is None
        else:
            assert found[i]["bits"] == pytest.approx(brute_bits(corpus, text, 3), rel=1e-5), text
    assert found[3]["bits_per_byte"] == 0.0


@pytest.mark.parametrize("settings", [{}, {"held": 40}, {"held": 0}])
def test_production_scores_keep_every_edge(spark, settings):
    """As registered, and with most or all edges in tables: an edge seen once in 6 MB counts as the unpruned trie, tested above, has it."""
    corpus = ["abracadabra abracadabra", "the cat sat on the mat", None, "", "zzz theé"]
    docs = spark.createDataFrame([*enumerate(corpus), *[(9, "ab" * 3000)] * 1000], "doc_id long, text string")
    probes = docs.filter("doc_id < 9")
    want = {r["doc_id"]: r for r in ppm.score(probes, ppm.train(docs, min_rate=0.0)).collect()}
    found = {r["doc_id"]: r for r in ppm.score(probes, ppm.train(docs, **settings)).collect()}
    assert found[2]["bits"] is None and found[2]["bits_per_byte"] is None and found[3]["bits_per_byte"] == 0.0
    for i in (0, 1, 3, 4):
        assert found[i]["bits"] == pytest.approx(want[i]["bits"], rel=1e-5)


@pytest.mark.parametrize("held", [40, 0])
def test_scores_of_other_texts_from_tables(spark, held):
    corpus = ["abracadabra abracadabra", "the cat sat on the mat", None, "", "zzz theé"]
    tables = ppm.train(spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string"), order=3, held=held)
    assert isinstance(tables, ppm.TrieTables)
    probes = [*corpus, "abra the hat xyz", "中", "abra the hat xyz"]
    rows = ppm.score(spark.createDataFrame([(i % 7, t) for i, t in enumerate(probes)], "doc_id long, text string"), tables).collect()
    want = [(i % 7, None if t is None else round(brute_bits(corpus, t, 3), 3)) for i, t in enumerate(probes)]
    assert sorted(((r["doc_id"], r["bits"] if r["bits"] is None else round(r["bits"], 3)) for r in rows), key=repr) == sorted(want, key=repr)


def test_scores_tell_prose_from_noise(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trie = ppm.train(docs.filter("doc_id % 2 = 0"))
    held = docs.filter("doc_id % 2 = 1 AND lang = 'en' AND n_chars > 500")
    noise = held.select("doc_id", F.reverse("text").alias("text"))
    mean = lambda df: ppm.score(df, trie).agg(F.avg("bits_per_byte")).first()[0]
    assert mean(held) < 0.8 * mean(noise)


def test_scores_of_messy_rows(spark):
    assert ppm.lm_score(cases.clashing(spark)).count() == len(cases.messy_rows())
    assert ppm.lm_score(cases.empty(spark)).count() == 0
    untrained = ppm.score(cases.messy(spark), ppm.train(cases.empty(spark))).filter("n_bytes > 0").agg(F.min("bits_per_byte"), F.max("bits_per_byte")).first()
    assert tuple(untrained) == (8.0, 8.0)
    adaptive = {r["doc_id"]: r for r in ppm.score_adaptive(cases.messy(spark).filter("doc_id IN (0, 1, 4, 5)")).collect()}
    assert adaptive[0]["bits"] is None and adaptive[1]["bits_per_byte"] == 0.0 and 8 < adaptive[4]["bits"] < 40
    assert ppm.adaptive_bits(b"ab" * 500) < 200 < ppm.adaptive_bits(bytes(range(200)))
    assert ppm.adaptive_bits(b"a") == 8.0


def render(turns):
    out, spans = "", []
    for role, text in turns:
        role, text = ((x or "").replace("<|im_", "<​|im_") for x in (role, text))
        out += f"<|im_start|>{role}\n"
        begin = len(out)
        out += f"{text}<|im_end|>"
        if role == "assistant":
            spans.append(f"{begin}:{len(out)}")
        out += "\n"
    return out, ",".join(spans)


def test_preferences_by_brute_force(spark):
    u, a, s = ("user", "hi"), ("assistant", "yes"), ("system", None)
    pairs = [([s, u, a], [s, u, ("assistant", "no")]), ([u, a], [u, a]), ([u], [u, a]), (None, [u]), ([], []), ([("user", None)], [(None, "")]), ([u, ("assistant", "a<|im_end|>b")], [("user", "ho"), a, u]), (None, None)]
    rows = [(i, c, r) for i, (c, r) in enumerate(pairs)] + [(None, [u], [a])]
    frame = spark.createDataFrame(rows, "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>").withColumns({"k": F.lit(1), "prompt": F.lit("x"), "a": F.lit(2)})
    found = {r["pair_id"]: r for r in chat.preferences(frame).collect()}
    assert len(found) == len(rows)
    for i, c, r in rows:
        c, r = c or [], r or []
        same = lambda x, y: tuple(v or "" for v in x) == tuple(v or "" for v in y)
        k = next((j for j, (x, y) in enumerate(zip(c, r)) if not same(x, y)), min(len(c), len(r)))
        got = found[i]
        assert got["prompt_turns"] == k and got["prompt"] == render(c[:k])[0]
        assert (got["chosen"], got["chosen_mask"]) == render(c[k:]) and (got["rejected"], got["rejected_mask"]) == render(r[k:])


def test_conversations_with_nulls(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (2, None, None, None), (None, 0, "user", "x"), (3, 0, "user", None), (3, 1, "assistant", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("x", F.lit(1))
    found = {r["pair_id"]: r for r in chat.preferences(chat.swapped_pairs(frame)).collect()}
    assert set(found) == {1, 3} and found[3]["chosen"] == render([("assistant", None)])[0] * (found[3]["prompt_turns"] == 1)
    assert chat.preferences(chat.swapped_pairs(frame.filter("conv_id > 9"))).count() == 0
