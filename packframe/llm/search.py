"""Exact top-k BM25 search by block-max WAND over an inverted index of shards.

1. Global statistics: the number of documents, their mean length, and each query
   term's document frequency, over all documents.
2. Each task indexes the documents it reads, a shard of up to ``shard_docs``
   documents at a time: for each query term its postings (document, impact) in
   document order, cut in blocks of ``block_docs`` consecutive documents, with each
   block's greatest impact.  Impacts use the global statistics, so shards'
   scores compare.  Terms in no query are never looked up, hence not indexed.
3. Each query is run on each shard with a threshold, the k-th best score so far:
   blocks in descending order of the sum of the terms' block maxima are opened
   until that bound falls under the threshold; inside a block only documents
   whose own bound (the block maxima of the terms that they hold: the pivot
   condition) reaches the threshold are scored.  This is block-max WAND a block
   at a time, in numpy: no document that could enter the top k is skipped.
4. Shards' top k are merged; ties go to the lesser document id.

A term is a run of lower-case ASCII letters, digits and non-ASCII characters of
the lower-cased text, matched by 64-bit hash.  A query's repeated term counts as
often as it occurs.  ``idf = ln(1 + (N - df + 0.5) / (df + 0.5))``.  Scores are rounded
to 6 places before they are ranked.

Null, empty and wordless texts of either side match nothing; documents or queries
with a null id are left out, as are documents without a common term.  Repeated rows
are ranked each.  Queries are grouped in rounds of ``round_queries``, whose terms
are what is broadcast; each round reads the documents once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packframe.llm.common import counted, owners, pieces, ref, words

TOP_K, K1, B = 10, 1.2, 0.75
SHARD_DOCS, BLOCK_DOCS, ROUND_QUERIES = 32_768, 128, 4096


def statistics(docs: DataFrame, terms: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(documents, their words, document frequency of each term) over all documents; docs: (id, t)."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        df, n, length = np.zeros(len(known), np.int64), 0, 0
        for batch in pieces(batches, "t"):
            keys, offsets = words(batch.column("t"))
            n, length = n + batch.num_rows, length + len(keys)
            if len(keys) and len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                cell = np.unique(owners(offsets)[hit] * len(known) + at[hit])
                df += np.bincount(cell % len(known), minlength=len(known))
        some = np.flatnonzero(df)
        term = np.concatenate([[-2, -1], some])
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.concatenate([[n, length], df[some]]).astype(np.int64))], names=["term", "n"])

    got = docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas().set_index("term")["n"]
    df = np.zeros(len(terms), np.int64)
    some = got[got.index >= 0]
    df[some.index.to_numpy()] = some.to_numpy()
    return int(got.get(-2, 0)), int(got.get(-1, 0)), df


class Shard:
    """The index of some documents: postings by term, cut in blocks of documents."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int, block: int):
        order = np.lexsort((doc, term))
        self.ids, self.block = ids, block
        self.doc, self.impact = doc[order], impact[order]
        term = term[order]
        self.blocks = -(-len(ids) // block)
        cell = term * self.blocks + self.doc // block
        at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        self.cell = cell[at]
        self.begin = np.append(at, len(cell))
        self.most = np.maximum.reduceat(self.impact, at) if len(at) else np.zeros(0)
        self.of_term = np.searchsorted(self.cell, np.arange(terms + 1) * self.blocks)

    def search(self, terms: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, documents scored) of the top k, by rounded score and id."""
        cells = np.concatenate([np.arange(self.of_term[t], self.of_term[t + 1]) for t in terms]) if len(terms) else np.zeros(0, np.int64)
        if not len(cells):
            return np.zeros(0, np.int64), np.zeros(0), 0
        weight = np.repeat(times, self.of_term[terms + 1] - self.of_term[terms]).astype(float)
        block = self.cell[cells] % self.blocks
        bound = np.bincount(block, self.most[cells] * weight, self.blocks)
        by_block = np.argsort(block, kind="stable")
        edge = np.searchsorted(block[by_block], np.arange(self.blocks + 1))
        best_doc, best, least, scored = np.zeros(0, np.int64), np.zeros(0), -1.0, 0
        slack = 2e-6  # rounding may lift a score by half a millionth
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or bound[b] + slack < least:
                break
            mine = by_block[edge[b] : edge[b + 1]]
            c, w = cells[mine], weight[mine]
            size = self.begin[c + 1] - self.begin[c]
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) + np.repeat(self.begin[c] - (ends - size), size)
            local = self.doc[at] - b * self.block
            may = np.bincount(local, np.repeat(self.most[c] * w, size), self.block)
            pivot = may + slack >= max(least, slack)
            keep = pivot[local]
            scores = np.round(np.bincount(local[keep], (self.impact[at] * np.repeat(w, size))[keep], self.block), 6)
            found = np.flatnonzero(scores > 0)
            scored += len(found)
            best_doc = np.append(best_doc, found + b * self.block)
            best = np.append(best, scores[found])
            order = np.lexsort((self.ids[best_doc], -best))[:k]
            best_doc, best = best_doc[order], best[order]
            if len(best) == k:
                least = best[-1]
        return best_doc, best, scored


def round_search(docs: DataFrame, queries: pd.DataFrame, k: int, k1: float, b: float, shard_docs: int, block_docs: int) -> DataFrame:
    """(query, id, score): each shard's top k of each query; docs: (id, t), queries: (query, t)."""
    keys, times, offsets = counted(*words(pa.array(queries["t"], pa.string())))
    terms, place = np.unique(keys, return_inverse=True)
    n, length, df = statistics(docs, terms)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    mean = length / n if n else 1.0
    # Per query: its terms that occur at all, as places in `terms`.
    asked = [(int(q), place[x:y][df[place[x:y]] > 0], times[x:y][df[place[x:y]] > 0]) for q, x, y in zip(queries["query"], offsets[:-1], offsets[1:])]
    shared = docs.sparkSession.sparkContext.broadcast((terms, idf, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, all_asked = shared.value
        held: list[tuple] = []
        count = 0

        def index_and_search() -> pa.RecordBatch:
            ids = np.concatenate([h[0] for h in held])
            index = Shard(ids, *[np.concatenate([h[i] for h in held]) for i in (1, 2, 3)], len(known), block_docs)
            out: list[tuple] = []
            for query, own, often in all_asked:
                doc, score, _ = index.search(own, often, k)
                out.append((np.full(len(doc), query), ids[doc], score))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out]).astype(np.int64)), pa.array(np.concatenate([o[1] for o in out]).astype(np.int64)), pa.array(np.concatenate([o[2] for o in out]))], names=["query", "id", "score"])

        if not all_asked or not len(known):
            for _ in batches:
                pass
            return
        for batch in pieces(batches, "t"):
            keys, offsets = words(batch.column("t"))
            size = np.diff(offsets)
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = known[at] == keys
            cell, tf = np.unique(owners(offsets)[hit] * len(known) + at[hit], return_counts=True)
            doc, term = cell // len(known), cell % len(known)
            impact = weights[term] * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * size[doc] / mean))
            held.append((batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64), doc + count, term, impact))
            count += batch.num_rows
            if count >= shard_docs:
                yield index_and_search()
                held, count = [], 0
        if held:
            yield index_and_search()

    return docs.mapInArrow(run, "query long, id long, score double")


def top_k(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text", k: int = TOP_K, k1: float = K1, b: float = B, shard_docs: int = SHARD_DOCS, block_docs: int = BLOCK_DOCS, round_queries: int = ROUND_QUERIES) -> DataFrame:
    """(query_id, rank, doc_id, score) of each query's k best documents; ids are integers."""
    rows = docs.select(ref(docs, doc_id).cast("long").alias("id"), F.lower(ref(docs, text).cast("string")).alias("t")).filter("id IS NOT NULL")
    asked = queries.select(ref(queries, query_id).cast("long").alias("query"), F.lower(F.coalesce(ref(queries, query_text).cast("string"), F.lit(""))).alias("t")).filter("query IS NOT NULL")
    # Repeated ids of queries are asked once, with the greatest text; rounds are cut by rank.
    asked = asked.groupBy("query").agg(F.max("t").alias("t"))
    parts: list[DataFrame] = []
    last = None
    while True:
        left = asked if last is None else asked.filter(F.col("query") > last)
        part = left.orderBy("query").limit(round_queries).toPandas()
        if not len(part):
            break
        parts.append(round_search(rows, part, k, k1, b, shard_docs, block_docs))
        last = int(part["query"].iloc[-1])
        if len(part) < round_queries:
            break
    if not parts:
        kind = T.StructType([T.StructField("query", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])
        parts = [docs.sparkSession.createDataFrame([], kind)]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", F.col("id").alias("doc_id"), "score")


SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT count(*) AS n, sum(coalesce(len(w), 0)) / count(*)::DOUBLE AS mean FROM d),
tf AS (SELECT doc_id, n AS size, t, count(*) AS f FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
q AS (SELECT item_id, t, count(*) AS often FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '')) AS t FROM benchmark) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf WHERE t IN (SELECT t FROM q) GROUP BY t),
p AS (SELECT item_id, doc_id, round(sum(often * ln(1 + (s.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (f * {K1 + 1}::DOUBLE) / (f + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * size / mean))), 6) AS score
  FROM q JOIN tf USING (t) JOIN df USING (t), s GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM p)
SELECT item_id AS query_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= {TOP_K}
"""
