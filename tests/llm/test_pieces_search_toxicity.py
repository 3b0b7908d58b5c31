"""SentencePiece (7), BM25 search (8), toxicity (10) and what they share."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter

import cases
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packframe.llm import common, search, sentencepiece, toxicity


def test_varints_round_trip():
    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 40, (1 << 63) - 1], np.uint64)
    assert common.unvarint(common.varint(values)[0]).tolist() == values.tolist()
    assert len(common.varint(np.arange(128))[0]) == 128 and len(common.unvarint(np.zeros(0, np.uint8))) == 0


def test_blocks_round_trip():
    draw = np.random.default_rng(5)
    cells = np.unique(draw.integers(0, 40 * toxicity.CELLS, 20_000))
    counts = draw.integers(1, 400, len(cells))
    got = toxicity.cells_of(toxicity.blocks(cells, counts))
    assert np.array_equal(got[0], cells) and np.array_equal(got[1], counts)
    assert len(toxicity.cells_of(toxicity.blocks(cells[:0], counts[:0]))[0]) == 0


def test_tally_sums_by_key():
    draw = np.random.default_rng(1)
    held, want = common.Tally(least=50), Counter()
    for _ in range(40):
        keys = draw.integers(0, 200, 30)
        held.add(keys, np.ones(30, np.int64))
        want.update(keys.tolist())
    keys, sums = held.fold()
    assert dict(zip(keys.tolist(), sums.tolist())) == want and common.Tally().fold() is None


def test_words_by_regular_expression():
    texts = [None, "", "a b", "  x1—y 中文!z ", "é", "end ", "start"] + [cases.prose(i, 30) for i in range(5)]
    got, offsets = common.words(pa.array(texts, pa.string()))
    split = [[w for w in re.split(r"[\x00-/:-`{-\x7f]+", t or "") if w] for t in texts]
    assert np.diff(offsets).tolist() == list(map(len, split))
    every = [w for row in split for w in row]
    known = dict(zip(every, got.tolist()))
    assert [known[w] for w in every] == got.tolist() and len(set(known.values())) == len(set(every))


def best_path(text: str, known: sentencepiece.Vocabulary) -> tuple[list[int], float]:
    """Viterbi over the whole text at once; of paths that are equal but for rounding the one with the longer last piece."""
    table = {p.replace(sentencepiece.SPACE, " "): (i, s) for p, i, s in known.table}
    text = " " + text if text else ""
    best: list = [(0.0, 0, [])] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - known.longest), end):
            sub = text[start:end]
            if sub in table:
                i, s = table[sub]
                edge = (s, [i])
            elif end - start == 1:
                edge = (known.penalty, [known.byte_ids[b] for b in sub.encode()])
            else:
                continue
            if best[start] is not None and (best[end] is None or best[start][0] + edge[0] > best[end][0] + 1e-8):
                best[end] = (best[start][0] + edge[0], start, edge[1])
    out, at = [], len(text)
    while at:
        out.append(best[at][2])
        at = best[at][1]
    return [i for ids in reversed(out) for i in ids], best[-1][0]


@pytest.fixture(scope="module")
def known():
    return sentencepiece.load()


def test_encoding_by_brute_force(spark, known):
    docs = cases.clashing(spark).filter("n_chars IS NULL OR n_chars < 100")
    found = sentencepiece.encode(docs, known).collect()
    assert len(found) == len(cases.messy_rows())
    texts = {r[0]: r[1] for r in cases.messy_rows()[:9]}
    for r in found:
        if r["doc_id"] in texts:
            text = texts[r["doc_id"]]
            if text is None:
                assert r["ids"] is None and r["n_pieces"] is None and r["round_trip"] is None
            elif len(text) < 2000:
                assert r["round_trip"] and r["ids"] == best_path(text, known)[0], text
    assert sentencepiece.encode(cases.empty(spark), known).count() == 0


def test_decoding_gives_the_text(spark, sf_dir, known):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = sentencepiece.encode(docs, known)
    assert made.filter("NOT round_trip").count() == 0
    back = made.join(docs, "doc_id").filter(sentencepiece.decode(F.col("ids"), known) != F.col("text"))
    assert back.count() == 0
    messy = sentencepiece.encode(cases.messy(spark).filter("doc_id <> 10"), known).filter("doc_id IN (0, 1, 8, 9)")
    texts = {r["doc_id"]: r["s"] for r in messy.select("doc_id", sentencepiece.decode(F.col("ids"), known).alias("s")).collect()}
    assert texts == {0: None, 1: "", 8: cases.messy_rows()[8][1], 9: cases.LONG}


def test_words_beyond_the_broadcast_dictionary(spark, known):
    docs = cases.messy(spark)
    key = lambda df: sorted((repr(r["doc_id"]), r["ids"] or [], r["round_trip"]) for r in df.filter("ids IS NOT NULL").collect())
    assert key(sentencepiece.encode(docs, known, dictionary_bytes=2000)) == key(sentencepiece.encode(docs, known))


@pytest.mark.parametrize("most", [sentencepiece.DICTIONARY_BYTES, 0])
def test_long_runs_by_brute_force(spark, known, most):
    """Runs without a space or change of kind: the best path of the whole run, beside short words and other documents."""
    draw = random.Random(4)
    letters = ["".join(draw.choice(["the", "ation", "er", "in", "qu", "str", "zx", "ou", "ing", "pre", "k"]) for _ in range(350)) for _ in range(4)]
    texts = [*[t[:1000] for t in letters], "short words " + letters[0][:700] + " and more " + letters[1][:600], "中文字符" * 200, "=-" * 400, "plain", "a" * 255, "a" * 256, "a" * 257]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in sentencepiece.encode(docs, known, dictionary_bytes=most).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert rows[i]["round_trip"] and rows[i]["ids"] == best_path(text, known)[0], text[:20]


def test_equal_paths_whatever_the_order_of_their_pieces(spark):
    """Sums of 0.1, 0.2 and 0.3 differ by rounding with their order; of equal paths the one with the longer last piece wins."""
    tokens = ["a", "aa", "aaa", sentencepiece.SPACE]
    made = sentencepiece.vocabulary([t.replace(sentencepiece.SPACE, " ").encode() for t in tokens], [(t, i, s) for i, (t, s) in enumerate(zip(tokens, [-0.1, -0.2, -0.3, -0.1]))], [-1] * 256, 0)
    for n in (3, 4, 5, 6, 8, 11, 100, 400):
        want = best_path("a" * n, made)[0]
        assert want == [3] + [0] * (n % 3 == 1) + [1] * (n % 3 == 2) + [2] * (n // 3)
        assert sentencepiece.LongWords(made).ids(" " + "a" * n) == want
    rows = sentencepiece.encode(spark.createDataFrame([(n, "a" * n) for n in (3, 4, 5, 6, 8, 11, 100, 400)], "doc_id long, text string"), made).collect()
    assert all(r["ids"] == best_path("a" * r["doc_id"], made)[0] and r["round_trip"] for r in rows)


def test_the_fold_keeps_no_paths(spark, known):
    """Letters of long words cost about what those of short words do: no step copies the paths of all ends."""
    draw = random.Random(8)
    line = "".join(draw.choice("etaoinshrdlu") for _ in range(100_000))
    cost = {}
    for size in (10, 10, 250, 250):  # the second time counts, as code is compiled
        words = spark.createDataFrame([(line[i : i + size], 1) for i in range(0, len(line), size)], "word string, n long").repartition(4)
        began = time.perf_counter()
        made = sentencepiece.segment(words, known).collect()
        cost[size] = time.perf_counter() - began
    assert cost[250] < 3 * cost[10]
    long = sentencepiece.LongWords(known)
    assert all(r["ids"] == long.ids(r["word"]) for r in made)


def test_library_words_agree(known):
    assert sentencepiece.cut(" a  b1 --c") == [" a", "  b", "1 --", "c"] or "".join(sentencepiece.cut(" a  b1 --c")) == " a  b1 --c"
    long = "x" * 2000 + "é" * 900
    assert "".join(sentencepiece.cut(long)) == long


def bm25(docs, queries, k):
    split = lambda t: [w for w in re.split(r"[\x00-/:-`{-\x7f]+", (t or "").lower()) if w]
    docs = [(i, split(t)) for i, t in docs if i is not None]
    mean = sum(len(w) for _, w in docs) / max(1, len(docs))
    df = Counter(w for _, ws in docs for w in set(ws))
    out = []
    for q, text in queries:
        scores = []
        for i, ws in docs:
            tf = Counter(ws)
            s = sum(n * math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (search.K1 + 1) / (tf[w] + search.K1 * (1 - search.B + search.B * len(ws) / mean)) for w, n in Counter(split(text)).items() if tf[w])
            if s > 0:
                scores.append((-round(s, 6), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("shard", "block", "rounds"), [(32768, 128, 4096), (64, 8, 3), (1, 1, 1)])
def test_search_by_brute_force(spark, shard, block, rounds):
    draw = random.Random(6)
    docs = [(i, cases.prose(draw.randint(0, 60), draw.randint(1, 60))) for i in range(250)] + [(None, "river0"), (300, None), (301, ""), (7, cases.prose(3, 10))]
    queries = [(i, cases.prose(100 + i, n)) for i, n in enumerate([1, 3, 8, 20, 50])] + [(5, None), (6, "unheardof"), (None, "river0"), (7, "river1 river1 stone2")]
    extra = {c: F.lit(1) for c in ("id", "t", "query", "rank", "score", "term", "n")}
    found = search.top_k(spark.createDataFrame(docs, "doc_id long, text string").withColumns(extra), spark.createDataFrame(queries, "item_id long, text string").withColumns(extra), k=5, shard_docs=shard, block_docs=block, round_queries=rounds)
    got = sorted(map(tuple, found.collect()))
    want = bm25(docs, [q for q in queries if q[0] is not None], 5)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-6)


def test_pruning_skips_documents():
    draw = np.random.default_rng(3)
    doc = np.sort(draw.choice(10_000, 4000, replace=False))
    index = search.Shard(np.arange(10_000), doc, np.zeros(4000, np.int64), draw.pareto(2.0, 4000), 1, 64)
    found, scores, scored = index.search(np.array([0]), np.array([1]), 10)
    assert scored < 2000 and sorted(scores, reverse=True) == sorted(np.round(index.impact, 6), reverse=True)[:10] and len(found) == 10


def test_search_of_messy_rows(spark):
    queries = spark.createDataFrame([(1, "one river1 lorem")], "item_id long, text string")
    plain = sorted(map(tuple, search.top_k(cases.messy(spark), queries).collect()))
    assert plain == sorted(map(tuple, search.top_k(cases.clashing(spark), queries).collect())) and {4, 9} <= {r[2] for r in plain}
    assert search.top_k(cases.empty(spark), queries).count() == search.top_k(cases.messy(spark), queries.filter("item_id > 1")).count() == 0


TOXIC = "gruk blarn vexil snorp drath".split()


def planted(spark, n=600, seed=0):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        words = cases.prose(seed * 10_000 + i, draw.randint(40, 120)).split()
        if i % 6 == 0:
            at = draw.randint(0, len(words) - 20)
            words[at : at + 16] = [draw.choice(TOXIC) if j % 2 == 0 else draw.choice(["you", "people", "are"]) for j in range(16)]
        rows.append((i, " ".join(words), int(i % 6 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_on_held_out_documents(spark):
    docs = planted(spark)
    labels = docs.filter("doc_id % 2 = 0 OR doc_id % 3 = 1").select("doc_id", "toxic")
    found = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(docs.select("doc_id", "text"), labels).collect()}
    held = [(r["toxic"], found[r["doc_id"]]) for r in docs.filter("NOT (doc_id % 2 = 0 OR doc_id % 3 = 1)").collect()]
    everything = [(r["toxic"], found[r["doc_id"]]) for r in docs.collect()]
    for rows in (held, everything):
        assert sum(bool(t) == p for t, p in rows) >= 0.97 * len(rows)
    kept = toxicity.drop_toxic(docs.select("doc_id", "text"), labels)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in found.items() if not t}


def test_toxicity_of_the_test_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train = labels.filter("doc_id % 2 = 0")
    joined = toxicity.toxicity(docs, train).withColumnRenamed("toxic", "said").join(labels.filter("doc_id % 2 = 1"), "doc_id").select("said", F.col("toxic") == 1).collect()
    hits = sum(s and t for s, t in joined)
    assert hits >= 0.8 * sum(t for _, t in joined) and hits >= 0.9 * sum(s for s, _ in joined)


def test_walk_by_brute_force(spark):
    docs = spark.createDataFrame([(i, cases.prose(i % 7, 60)) for i in range(40)], "doc_id long, text string").select(F.col("text").alias("t"))
    terms = sorted({w for r in docs.collect() for w in r["t"].split()})[:90]
    nodes = np.sort(common.hash_words(terms))
    at = {int(h): i for i, h in enumerate(nodes)}
    size, window = len(nodes), 4
    n = np.zeros((size, size))
    for r in docs.collect():
        row = [at[int(h)] for h in common.hash_words(r["t"].split()) if int(h) in at]
        for i, a in enumerate(row):
            for b in row[i + 1 : i + 1 + window]:
                n[min(a, b), max(a, b)] += 1
    graph = toxicity.Graph(toxicity.pair_counts(docs, nodes, window), size)
    both = n + n.T - np.diag(np.diag(n))
    seen = both.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.log(both * seen.sum() / np.outer(seen, seen))
    w = np.where(np.isfinite(w) & (w > 0), w, 0.0)
    np.fill_diagonal(w, 0.0)
    p = w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300)
    restart = np.zeros((2, size))
    restart[0, :3] = 1 / 3
    restart[1, 3:9] = 1 / 6
    now = restart
    for _ in range(4):
        now = 0.3 * restart + 0.7 * now @ p
    assert graph.seen[0] == pytest.approx(seen)
    assert toxicity.walk(graph, restart, 4, 0.3) == pytest.approx(now, abs=1e-12)


def test_toxicity_of_messy_rows(spark):
    labels = spark.createDataFrame([(5, 1), (6, 0), (None, 1), (7, None), (8, 0)], "doc_id long, toxic int").withColumn("y", F.lit(1))
    for frame in (cases.messy(spark), cases.clashing(spark)):
        found = toxicity.toxicity(frame, labels).collect()
        assert len(found) == len(cases.messy_rows()) and all(r["score"] == 0 and not r["toxic"] for r in found if r["doc_id"] in (0, 1, 2, 3))
        kept = toxicity.drop_toxic(frame, labels)
        assert kept.columns == frame.columns and kept.count() <= len(found)
    for docs, known in ((cases.messy(spark), labels.filter("toxic = 0")), (cases.messy(spark), labels.filter("doc_id > 99")), (cases.empty(spark), labels)):
        assert toxicity.toxicity(docs, known).filter("toxic OR score <> 0").count() == 0
        assert toxicity.drop_toxic(docs, known).count() == docs.count()
