"""Toxicity by lexicon induction: random walks over a word graph.

1. Seeds: words whose document frequency differs between documents labelled
   toxic and clean beyond chance (a binomial tail, corrected for the number of
   words tried) may be toxic seeds; of these stay the words whose share of toxic
   documents reaches the bar at which "holds a seed" fits the labels best (by F1).
   The most frequent words whose share is at most the average are clean seeds.
   Labels are a sample of at most ``label_rows`` labelled rows by hash (a bounded,
   documented parameter); equal texts with equal labels count once in it, as copies
   are no evidence of their own.
2. Graph: words in ``min_df`` to ``max_df`` of all documents, and the seeds, are
   nodes; the rule bounds their number by (words per document) / ``min_df``
   whatever the corpus.  Other words get no polarity.  Words within ``window`` nodes of each other co-occur;
   an edge weighs the pair's positive pointwise mutual information over all
   documents.
3. Random walks with restart from the toxic and from the clean seeds give each
   word two visiting rates; its polarity is their log ratio against the graph's
   average, cut at 0 and scaled to a seed's: 1 for a typical toxic seed.
4. A document's score is the sum of its words' squared polarity over the square
   root of its number of words, by the words of at least a least polarity, so that
   many words of little polarity can't add up.  That cut, one of CUTS, and the
   threshold above which a document is toxic are those that together best
   separate the labelled sample (by F1).

A word is a run of lower-case ASCII letters, digits and non-ASCII characters of
the lower-cased text.  Null, empty and wordless texts score 0 and are not toxic.
Without toxic labels there are no seeds, every score is 0 and nothing is toxic.
A document labelled both ways counts as toxic; labels with a null side are left
out.  Rows with a null id are scored, but never labelled.  Repeated rows score alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packframe.llm.common import Tally, buffers, checkpoint, counted, discard, fresh, owners, pieces, ref, release, relieve, unvarint, varint, words

LABEL_ROWS, MIN_DF, MAX_DF, WINDOW = 50_000, 2e-3, 0.2, 5
CUTS = tuple(i / 20 for i in range(20))
CELLS = 1 << 14  # cells of the pair matrix in a block
RANGES = 8
CLEAN_SEEDS, STEPS, RESTART, ALPHA = 200, 6, 0.3, 1e-3


@dataclass
class Lexicon:
    """Word hashes in ascending order, their polarity weights, and the threshold of scores."""

    keys: np.ndarray
    weights: np.ndarray
    threshold: float = math.inf


def label_sample(labels: DataFrame, doc_id: str, toxic: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids in ascending order, toxic or not) of at most ``most`` labelled documents, chosen by hash."""
    rows = labels.select(ref(labels, doc_id).cast("long").alias("id"), ref(labels, toxic).cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    rows = rows.groupBy("id").agg((F.max("y") > 0).alias("y")).orderBy(F.xxhash64("id"), "id").limit(most).toPandas().sort_values("id")
    return rows["id"].to_numpy(np.int64), rows["y"].to_numpy(bool)


def _side(ids: pa.Array, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 toxic, 0 clean, -1 unlabelled."""
    if not len(known[0]):
        return np.full(len(ids), -1)
    null = ids.is_null().to_numpy(zero_copy_only=False)
    values = ids.fill_null(0).to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(known[0], values), len(known[0]) - 1)
    return np.where((known[0][at] == values) & ~null, known[1][at].astype(int), -1)


def word_table(docs: DataFrame, known: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(word, df, toxic_df, clean_df) over all documents; row 0 of word null: the number of documents of each kind."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Tally(1 << 18)
        docs_of = np.zeros(3, np.int64)
        for batch in pieces(batches, "t", 1 << 19):
            side = _side(batch.column("id"), shared.value)
            docs_of += [len(side), int((side == 1).sum()), int((side == 0).sum())]
            keys, _, offsets = counted(*words(batch.column("t")))
            if len(keys):
                mine = side[owners(offsets)]
                order = np.argsort(keys, kind="stable")
                keys, mine = keys[order], mine[order]
                at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                held.add(keys[at], np.stack([np.diff(np.append(at, len(keys))), np.add.reduceat((mine == 1).astype(np.int32), at), np.add.reduceat((mine == 0).astype(np.int32), at)], axis=1).astype(np.int32))
        if found := held.fold():
            for i in range(0, len(found[0]), 1 << 17):
                part = found[1][i : i + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(found[0][i : i + (1 << 17)].view(np.int64)), *[pa.array(part[:, k].astype(np.int64)) for k in range(3)]], names=["word", "df", "toxic_df", "clean_df"])
            del found, part
        del held
        release()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), *[pa.array([int(x)]) for x in docs_of]], names=["word", "df", "toxic_df", "clean_df"])

    part = docs.mapInArrow(count, "word long, df long, toxic_df long, clean_df long")
    return part.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("df", "toxic_df", "clean_df")])


def binomial_tail(k: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """An upper bound (Chernoff) of the log of P(X >= k), 0 where k is at most the mean."""
    q = k / n
    with np.errstate(divide="ignore", invalid="ignore"):
        d = q * np.log(q / p) + np.where(q < 1, (1 - q) * np.log(np.maximum(1 - q, 1e-300) / (1 - p)), 0.0)
    return np.where(q > p, -n * d, 0.0)


def blocks(cells: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """(block, keys, counts) of ascending cells: a row a block, its cells as differences, and their counts, as varints."""
    block = cells // CELLS
    at = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(cells) else np.zeros(0, np.int64)
    steps = np.diff(cells, prepend=0)
    steps[at] = cells[at] - block[at] * CELLS
    blobs = []
    for values in (steps, counts):
        data, begin = varint(values)
        offsets = begin[np.append(at, len(cells))].astype(np.int32)
        blobs.append(pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]))
    return pa.RecordBatch.from_arrays([pa.array(block[at], pa.int64()), *blobs], names=["block", "keys", "counts"])


def cells_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(cells, counts) of blocks, all rows at once."""
    data, offsets = buffers(batch.column("keys"))
    steps = unvarint(data)
    first = np.append(0, np.cumsum(data < 128))[offsets]
    sums = np.cumsum(steps)
    begin = first[:-1]
    base = batch.column("block").to_numpy(zero_copy_only=False) * CELLS - (sums[begin] - steps[begin])
    return sums + np.repeat(base, np.diff(first)), unvarint(buffers(batch.column("counts"))[0])


def pair_counts(docs: DataFrame, nodes: np.ndarray, window: int) -> DataFrame:
    """(block, keys, counts): how often nodes a <= b stand within ``window`` nodes of each other.

    The cell ``a * nodes + b`` lies in block ``cell // CELLS``; packed so, a pair takes two or three bytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(nodes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        size = len(known)
        # Sums by range of cells, about equal ones as the lesser node falls in them: what is sorted at once is one range.
        held = [Tally(1 << 16) for _ in range(RANGES)]
        cuts = (size * (1 - np.sqrt(1 - np.arange(1, RANGES) / RANGES))).astype(np.int64) * size
        for batch in pieces(batches, "t", 1 << 19):
            keys, offsets = words(batch.column("t"))
            if not len(keys) or not size:
                continue
            at = np.minimum(np.searchsorted(known, keys), size - 1)
            hit = known[at] == keys
            node, doc = at[hit], owners(offsets)[hit]
            pairs = []
            for step in range(1, window + 1):
                same = doc[step:] == doc[:-step]
                a, b = node[:-step][same], node[step:][same]
                pairs.append(np.minimum(a, b) * size + np.maximum(a, b))
            key = np.concatenate(pairs)
            if len(key):
                key.sort()
                at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                key, n = key[at], np.diff(np.append(at, len(key))).astype(np.int32)
                for tally, a, b in zip(held, np.append(0, np.searchsorted(key, cuts)), np.append(np.searchsorted(key, cuts), len(key))):
                    if a < b:
                        tally.add(key[a:b].copy(), n[a:b].copy())
        while held:
            if found := held.pop(0).fold():
                for i in range(0, len(found[0]), 1 << 18):
                    yield blocks(found[0][i : i + (1 << 18)], found[1][i : i + (1 << 18)])
                del found
        release()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come block by block, so blocks before the last are whole."""
        held = Tally(1 << 19)
        for batch in pieces(batches, "keys"):
            cells, counts = cells_of(batch)
            held.add(cells, counts)
            if held.merged > 1 << 20:
                cells, counts = held.fold()
                whole = np.searchsorted(cells, cells[-1] // CELLS * CELLS)
                yield blocks(cells[:whole], counts[:whole])
                held = Tally()
                held.add(cells[whole:], counts[whole:])
        if found := held.fold():
            yield blocks(*found)
            del found
        del held
        release()

    kind = "block long, keys binary, counts binary"
    return docs.mapInArrow(count, kind).repartition("block").sortWithinPartitions("block").mapInArrow(total, kind)


class Graph:
    """The word graph as a table of blocks; what is known of each node is an array, as bounded as the nodes are."""

    def __init__(self, pairs: DataFrame, nodes: int):
        self.pairs, self.nodes = checkpoint(pairs), nodes
        # a pair of a node with itself counts once
        self.seen = self._sums(1, lambda a, b, n: [(a, n), (b[a != b], n[a != b])])
        self.total = float(self.seen.sum())
        self.weight = np.maximum(self._sums(1, self._edges(lambda a, b, w: [(a, w), (b, w)])), 1e-300)

    def _sums(self, columns: int, given) -> np.ndarray:
        """(columns, nodes): the sums of what ``given(a, b, n)`` gives nodes, over all pairs, added up slice by slice of nodes."""
        size, width = self.nodes, 1 << 12

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((columns, size))
            for batch in pieces(batches, "keys"):
                cell, n = cells_of(batch)
                for node, value in given(cell // size, cell % size, n.astype(np.float64)):
                    for k, v in enumerate(np.atleast_2d(value)):
                        out[k] += np.bincount(node, v, size)
            if out.any():
                parts = [np.ascontiguousarray(out[:, i : i + width]).tobytes() for i in range(0, size, width)]
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([task] * len(parts), pa.int32()), pa.array(parts, pa.binary())], names=["part", "task", "sums"])
            release()

        def add(frame: pd.DataFrame) -> pd.DataFrame:
            each = frame.sort_values("task")["sums"]  # in one order, so that results repeat to the last bit
            out = np.zeros(len(each.iloc[0]) // 8)
            for raw in each:
                out += np.frombuffer(raw)
            return pd.DataFrame({"part": [int(frame["part"].iloc[0])], "task": [0], "sums": [out.tobytes()]})

        kind = "part int, task int, sums binary"
        got = sorted((r["part"], r["sums"]) for r in self.pairs.mapInArrow(run, kind).groupBy("part").applyInPandas(add, kind).collect())
        return np.concatenate([np.frombuffer(raw).reshape(columns, -1) for _, raw in got], axis=1) if got else np.zeros((columns, size))

    def _edges(self, then):
        """Pairs of different nodes with positive pointwise mutual information, which is their weight."""
        seen, total = self.seen[0], self.total

        def given(a: np.ndarray, b: np.ndarray, n: np.ndarray):
            w = np.log(n * total / (seen[a] * seen[b]))
            keep = (w > 0) & (a != b)
            return then(a[keep], b[keep], w[keep])

        return given

    def step(self, rates: np.ndarray) -> np.ndarray:
        """(2, nodes): where walkers at these rates go, each along an edge in proportion to its weight."""
        out = rates / self.weight
        return self._sums(2, self._edges(lambda a, b, w: [(b, out[:, a] * w), (a, out[:, b] * w)]))


def walk(graph: Graph, restart: np.ndarray, steps: int, back: float) -> np.ndarray:
    """(2, nodes): visiting rates of the walks from the toxic and from the clean seeds; restart: the seeds' mass."""
    now = restart
    for _ in range(steps):
        now = back * restart + (1 - back) * graph.step(now)
    return now


def induce(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", label_rows: int = LABEL_ROWS, min_df: float = MIN_DF, max_df: float = MAX_DF, window: int = WINDOW, clean_seeds: int = CLEAN_SEEDS, steps: int = STEPS, restart: float = RESTART) -> Lexicon:
    """The lexicon and the threshold of a corpus and its labels."""
    relieve(docs.sparkSession)
    known = label_sample(labels, doc_id, toxic, label_rows)
    rows = docs.select(ref(docs, doc_id).cast("long").alias("id"), F.lower(ref(docs, text).cast("string")).alias("t"))
    # The labelled texts, as bounded as the sample: each once for each label.
    sample = F.broadcast(docs.sparkSession.createDataFrame(pd.DataFrame({"lid": known[0], "y": known[1]}), "lid long, y boolean"))
    judged = rows.join(sample, F.col("id") == F.col("lid")).groupBy(F.md5("t"), "y").agg(F.min(F.struct("id", "t")).alias("x"))
    judged = checkpoint(judged.select("x.id", "y", "x.t"))
    once = judged.select("id", "y").toPandas().sort_values("id").drop_duplicates("id")
    known = once["id"].to_numpy(np.int64), once["y"].to_numpy(bool)
    table = checkpoint(word_table(rows, known))
    whole = table.filter("word IS NULL").first()
    n_docs, n_toxic, n_clean = (int(whole[c]) for c in ("df", "toxic_df", "clean_df")) if whole else (0, 0, 0)
    nothing = Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.float32))
    if not n_toxic or not n_clean:
        return nothing
    rate = n_toxic / (n_toxic + n_clean)
    # Candidate seeds are words of several toxic documents, above their share: as bounded as the labels are.
    tried = table.filter("word IS NOT NULL")
    lean = tried.filter((F.col("toxic_df") >= 3) & (F.col("toxic_df") > F.lit(rate) * (F.col("toxic_df") + F.col("clean_df"))))
    frame = tried.filter((F.col("df") >= max(2.0, min_df * n_docs)) & (F.col("df") <= max_df * n_docs)).union(lean).distinct().toPandas()
    tests = tried.filter("toxic_df + clean_df >= 3").count()
    discard(table)
    if not len(frame):
        return nothing
    frame["key"] = frame["word"].to_numpy(np.int64).view(np.uint64)
    frame = frame.sort_values("key").reset_index(drop=True)
    seen = (frame["toxic_df"] + frame["clean_df"]).to_numpy(float)
    tail = binomial_tail(frame["toxic_df"].to_numpy(float), np.maximum(seen, 1), rate)
    is_toxic = (tail < math.log(ALPHA / max(1, tests))) & (frame["toxic_df"].to_numpy() / np.maximum(seen, 1) > 0.5)
    inside = (frame["df"] >= max(2.0, min_df * n_docs)) & (frame["df"] <= max_df * n_docs)
    frame, is_toxic, seen = frame[inside | is_toxic].reset_index(drop=True), is_toxic[inside | is_toxic], seen[inside | is_toxic]
    if not is_toxic.any():
        return nothing
    share = frame["toxic_df"].to_numpy() / (seen + 2.0)
    seeds = Lexicon(frame["key"].to_numpy(np.uint64)[is_toxic], share[is_toxic].astype(np.float32))
    best = labelled_scores(judged, seeds, lambda texts, lexicon: text_most(texts, lexicon)[:, None])
    _, bar = best_threshold(best[1][:, 0], best[0])
    is_toxic &= (share >= bar) | (share >= share[is_toxic].max())
    clean_rate = frame["toxic_df"].to_numpy() / np.maximum(seen, 1)
    ranked = np.lexsort((frame["key"], -frame["clean_df"].to_numpy()))
    ranked = ranked[(clean_rate[ranked] <= rate) & (seen[ranked] > 0)][:clean_seeds]
    is_clean = np.zeros(len(frame), bool)
    is_clean[ranked] = True
    graph = Graph(pair_counts(rows, frame["key"].to_numpy(np.uint64), window), len(frame))
    # Seeds restart in proportion to their labelled documents, so that both walks cover the languages alike.
    mass = [np.where(side, frame[c].to_numpy(float), 0.0) for side, c in ((is_toxic, "toxic_df"), (is_clean, "clean_df"))]
    start = np.stack([mass[0] / mass[0].sum(), mass[1] / max(1.0, mass[1].sum())])
    toxic_rate, clean_rate = walk(graph, start, steps, restart)
    discard(graph.pairs)
    smooth = 0.01 / len(frame)
    ratio = np.log((toxic_rate + smooth) / (clean_rate + smooth))
    scale = np.median(ratio[is_toxic])
    weights = np.clip(ratio / scale, 0, 1) if scale > 0 else is_toxic.astype(float)
    kept = weights > 0
    lexicon = Lexicon(frame["key"].to_numpy(np.uint64)[kept], weights[kept].astype(np.float32))
    # The cut and the threshold, by labelled documents only.
    is_bad, scores = labelled_scores(judged, lexicon, lambda texts, lexicon: text_scores(texts, lexicon, CUTS))
    discard(judged)
    found = [best_threshold(scores[:, i], is_bad) for i in range(len(CUTS))]
    best = max(range(len(CUTS)), key=lambda i: found[i][0])  # of equal cuts the lowest
    release()
    strong = lexicon.weights >= CUTS[best]
    return Lexicon(lexicon.keys[strong], lexicon.weights[strong], found[best][1])


def best_threshold(scores: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """(F1, threshold): the middle between the two scores whose cut has the best F1; of equal cuts the highest."""
    if not toxic.any():
        return 0.0, math.inf
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], toxic[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    cuts = np.append(s[1:] < s[:-1], True) & (s > 0)
    if not cuts.any():
        return 0.0, math.inf
    i = int(np.flatnonzero(cuts)[np.argmax(f1[cuts])])
    return float(f1[i]), float((s[i] + (s[i + 1] if i + 1 < len(s) else 0.0)) / 2)


def text_scores(texts: pa.Array, lexicon: Lexicon, cuts: tuple[float, ...] = (0.0,)) -> np.ndarray:
    """(texts, cuts): each text's score by the words of at least each cut's weight."""
    out = np.zeros((len(texts), len(cuts)))
    keys, offsets = words(texts)
    if len(keys) and len(lexicon.keys):
        at = np.minimum(np.searchsorted(lexicon.keys, keys), len(lexicon.keys) - 1)
        weight = np.where(lexicon.keys[at] == keys, lexicon.weights[at], 0).astype(np.float64)
        size = np.diff(offsets)
        full = np.flatnonzero(size)
        for i, cut in enumerate(cuts):
            value = np.where(weight >= cut, weight, 0.0) ** 2
            out[full, i] = np.add.reduceat(value, offsets[:-1][full]) / np.sqrt(size[full])
    return out


def piecewise_scores(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Each text's score, a piece of bounded bytes at a time."""
    batch = pa.RecordBatch.from_arrays([texts], names=["t"])
    return np.concatenate([np.zeros(0), *(text_scores(part.column("t"), lexicon)[:, 0] for part in pieces([batch], "t", 1 << 19))])


def text_most(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Each text's greatest weight, 0 without a word of the lexicon."""
    out = np.zeros(len(texts))
    keys, offsets = words(texts)
    if len(keys) and len(lexicon.keys):
        at = np.minimum(np.searchsorted(lexicon.keys, keys), len(lexicon.keys) - 1)
        weight = np.where(lexicon.keys[at] == keys, lexicon.weights[at], 0).astype(np.float64)
        full = np.flatnonzero(np.diff(offsets))
        out[full] = np.maximum.reduceat(weight, offsets[:-1][full])
    return out


def labelled_scores(judged: DataFrame, lexicon: Lexicon, scores) -> tuple[np.ndarray, np.ndarray]:
    """(toxic or not, scores) of the labelled texts (y, t), a row a text, as bounded as the sample; scores: of texts, by a lexicon."""
    shared = judged.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            found = scores(batch.column("t"), shared.value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("y"), lists], names=["y", "scores"])
        release()

    got = judged.select("y", "t").mapInArrow(run, "y boolean, scores array<double>").toPandas()
    return got["y"].to_numpy(bool), np.stack(got["scores"].to_numpy()) if len(got) else np.zeros((0, 1))


def score_column(docs: DataFrame, lexicon: Lexicon, lowered: str, name: str = "score") -> DataFrame:
    """The frame with the score of a lower-cased text column; no shuffle, one Arrow pass over that column."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = pa.array(piecewise_scores(texts, shared.value))
        release()
        return out

    return docs.withColumn(name, score(F.col(lowered)))


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(doc_id, score, toxic) of each row."""
    lexicon = induce(docs, labels, doc_id, text, **settings)
    rows = docs.select(ref(docs, doc_id).alias("doc_id"), F.lower(ref(docs, text).cast("string")).alias("t"))
    return score_column(rows, lexicon, "t").select("doc_id", F.round("score", 6).alias("score"), (F.col("score") > F.lit(lexicon.threshold)).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows that are not toxic, every column as it was."""
    lexicon = induce(docs, labels, doc_id, text, **settings)
    low, score = fresh(docs, "_low", "_score")
    scored = score_column(docs.withColumn(low, F.lower(ref(docs, text).cast("string"))), lexicon, low, score)
    return scored.filter(F.col(score) <= F.lit(lexicon.threshold)).select(*[ref(scored, c) for c in docs.columns])
