"""SentencePiece encoding and decoding as a relational lattice.

1. The distinct words of all documents: a word is a run of spaces and the run of
   letters, or of other characters, after it.  No piece spans words (this is
   verified of the model), so the best path of a text is its words' best paths.
2. Lattice: every substring of a word up to the longest piece, equi-joined to
   the piece table; edges are grouped by word.  A character without a piece is
   an edge to its bytes, below every piece.
3. Viterbi: one fold over a word's edges in order of their end, with the
   higher-order function ``aggregate``.
4. Documents are encoded by looking their words up, in numpy over Arrow's
   buffers.  The dictionary is broadcast as flat arrays up to
   ``dictionary_bytes``, most frequent words first.  Of other words each occurrence
   is joined to the whole dictionary, and its ids are put in their place.
5. A word of over ``MAX_WORD`` bytes is in no dictionary, as such words hardly
   repeat: it is segmented where it stands, by the same Viterbi over all of it.

The score of a piece is the model's for a unigram model.  A BPE model has merge
ranks in place of scores; a piece of rank r then scores ``-ln(1 + r)`` (Zipf's law
for a unigram model ranked alike).  Of equal paths the one with the longer last
piece wins.  Scores are added as whole numbers of 2**-40, so that the order of a path's
pieces can't tell by rounding, and count as equal within 1e-8.

A text is encoded as SentencePiece's identity normaliser prescribes: a space is
put before it, and spaces become U+2581.  Decoding is exact for every text, but a
U+2581 of the text itself becomes a space.  Null text: null ids.  Empty text: no
ids.  Null document ids and repeated rows are encoded like any row.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packframe.llm.common import _BYTE, _ODD, buffers, checkpoint, discard, mix, pieces, ref, release, relieve

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
DICTIONARY_BYTES = 128 << 20
MAX_WORD = 256  # a word of more bytes is in no dictionary
FINER = 4
HELD_WORDS = 1 << 19  # distinct words that a task counts before it passes them on
UNIT = 1 << 40
TIE = round(1e-8 * UNIT)
_POWERS = np.cumprod(np.full(MAX_WORD, _ODD, dtype=np.uint64))

_KIND = np.full(256, 2, np.uint8)  # 0 space, 1 letter, 2 other
_KIND[0x20] = 0
_KIND[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0xC3, 0xE2), *range(0xE3, 0x100)]] = 1


@dataclass
class Vocabulary:
    """pieces: of every id, as bytes, with spaces for U+2581; table: (piece, id, score) of those the lattice may use."""

    pieces: list[bytes]
    table: list[tuple[str, int, float]]
    byte_ids: list[int]
    unknown: int

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.table)

    @property
    def penalty(self) -> float:
        return min(s for _, _, s in self.table) - 10.0


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, table, byte_ids = [], [], [-1] * 256
    ranked = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:-1], 16)] = i
            texts.append(bytes([int(piece[3:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            texts.append(b"")
        else:
            texts.append(piece.replace(SPACE, " ").encode())
            ranked.append((piece, i, model.get_score(i)))
    bpe = all(s == int(s) for _, _, s in ranked)
    table = [(p, i, -math.log1p(-s) if bpe else s) for p, i, s in ranked]
    return vocabulary(texts, table, byte_ids, model.unk_id())


def vocabulary(texts: list[bytes], table: list[tuple[str, int, float]], byte_ids: list[int], unknown: int) -> Vocabulary:
    crossing = [p for p, _, _ in table if len(cut(p.replace(SPACE, " "))) > 1]
    if crossing:
        raise ValueError(f"pieces span words: {crossing[:5]}")
    return Vocabulary(texts, table, byte_ids, unknown)


def _starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin in the bytes of texts."""
    lead = (raw & 0xC0) != 0x80
    kind = _KIND[raw]
    if not lead.all():
        kind = kind[np.maximum.accumulate(np.where(lead, np.arange(len(raw)), 0))]
    first = np.zeros(len(raw), bool)
    first[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != 0)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(first)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, begin, length) of each word; the hash of a word of over MAX_WORD bytes means nothing."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = _starts(raw, offsets)
    size = np.diff(np.append(starts, len(raw)))
    place = np.arange(len(raw)) - np.repeat(starts, size)
    if size.max() > MAX_WORD:
        place %= MAX_WORD
    hashed = np.add.reduceat(_BYTE[raw] * _POWERS[place], starts)
    return mix(hashed + size.astype(np.uint64)), starts, size


def cut(text: str) -> list[str]:
    """The words of one text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    _, starts, size = word_hashes(raw, np.array([0, len(raw)]))
    return [raw[s : s + n].tobytes().decode() for s, n in zip(starts, size)]


def distinct_words(texts: DataFrame) -> DataFrame:
    """(word, n) of all documents, of words of up to MAX_WORD bytes; texts: one column t, with the space before it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = place = sums = np.zeros(0, np.int64)
        spelt: list[bytes] = []

        def clear() -> None:
            nonlocal known, place, sums
            known, place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in ascending order, and their place in what follows
            sums = np.zeros(0, np.int64)
            spelt.clear()

        def counts() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(spelt), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(spelt[i : i + (1 << 16)], pa.binary()).cast(pa.string()), pa.array(sums[i : i + (1 << 16)])], names=["word", "n"])
            clear()

        clear()
        for batch in pieces(batches, "t", 1 << 19):
            raw, offsets = buffers(batch.column("t"))
            hashed, starts, size = word_hashes(raw, offsets)
            if len(size) and size.max() > MAX_WORD:
                hashed, starts, size = (x[size <= MAX_WORD] for x in (hashed, starts, size))
            if not len(hashed):
                continue
            kinds, first, n = np.unique(hashed, return_index=True, return_counts=True)
            at = np.minimum(np.searchsorted(known, kinds), max(0, len(known) - 1))
            old = known[at] == kinds if len(known) else np.zeros(len(kinds), bool)
            sums[place[at[old]]] += n[old]
            fresh = np.flatnonzero(~old)
            if len(fresh):
                spelt.extend(raw[starts[i] : starts[i] + size[i]].tobytes() for i in first[fresh])
                order = np.argsort(np.concatenate([known, kinds[fresh]]), kind="stable")
                place = np.concatenate([place, np.arange(len(sums), len(spelt))])[order]
                known = np.concatenate([known, kinds[fresh]])[order]
                sums = np.concatenate([sums, n[fresh]])
            if len(spelt) > HELD_WORDS:
                yield from counts()
        yield from counts()
        release()

    # The lattice has some 25 edges a word, which are sorted by word: FINER parts than a shuffle of words would want.
    parts = FINER * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.mapInArrow(count, "word string, n long").repartition(parts, "word").groupBy("word").agg(F.sum("n").alias("n"))


def units(score: float) -> int:
    """A score in whole numbers of 1 / UNIT, whose sums are exact."""
    return round(score * UNIT)


def piece_table(spark: SparkSession, known: Vocabulary) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame({"piece": [p.replace(SPACE, " ") for p, _, _ in known.table], "id": np.array([i for _, i, _ in known.table], np.int32), "score": np.array([units(s) for _, _, s in known.table], np.int64)}), "piece string, id int, score long")


def viterbi(edges: Column, word: Column, known: Vocabulary) -> Column:
    """The ids of the best path, from an array of struct(end, start, score in units, id) with ids under 0 for characters without a piece.

    The state has no paths: the best score and last edge of each end before now, and the best so far
    of now.  An end is added once, when the next one begins; the path is traced back when all are known.
    """
    edge_type = "struct<end:int,start:int,score:bigint,id:int>"
    top = F.struct(F.lit(0).cast("bigint").alias("best"), F.lit(None).cast(edge_type).alias("edge"))
    begin = F.struct(F.array().cast(f"array<struct<best:bigint,edge:{edge_type}>>").alias("ends"), F.lit(0).alias("now"), top.alias("top"))

    def step(held: Column, edge: Column) -> Column:
        # Each end has an edge, of one character: at the first edge of an end, now is the end before it.
        came = F.when(edge["start"] == held["now"], held["top"]["best"]).otherwise(F.get(held["ends"], edge["start"])["best"])
        new = came + edge["score"]
        after = [edge["end"].alias("now"), F.struct(new.alias("best"), edge.alias("edge")).alias("top")]
        return (
            F.when(edge["end"] > held["now"], F.struct(F.array_append(held["ends"], held["top"]).alias("ends"), *after))
            .when(new > held["top"]["best"] + F.lit(TIE), F.struct(held["ends"].alias("ends"), *after))
            .otherwise(held)
        )

    def put(piece: Column, path: Column) -> Column:
        char = F.hex(F.encode(F.substring(word, -piece, F.lit(1)), "UTF-8"))
        table = F.array(*[F.lit(i) for i in known.byte_ids])
        raw = F.transform(F.sequence(F.lit(1), F.length(char), F.lit(2)), lambda k: F.get(table, F.conv(F.substring(char, k, F.lit(2)), 16, 10).cast("int")))
        if min(known.byte_ids) < 0:
            raw = F.array(F.lit(known.unknown))
        return F.when(piece >= 0, F.array_prepend(path, piece)).otherwise(F.concat(raw, path))

    def back(came: Column, edge: Column) -> Column:
        return F.when(edge["end"] == came["at"], F.struct(edge["start"].alias("at"), put(edge["id"], came["path"]).alias("path"))).otherwise(came)

    def trace(held: Column) -> Column:
        edge = held["top"]["edge"]
        last = F.struct(edge["start"].alias("at"), put(edge["id"], F.array().cast("array<int>")).alias("path"))
        return F.aggregate(F.reverse(held["ends"]), last, lambda came, end: back(came, end["edge"]), lambda came: came["path"])

    return F.aggregate(F.sort_array(edges), begin, step, trace)


class LongWords:
    """The best path of a long word: :func:`viterbi` with its ties, but with pointers back in place of paths."""

    def __init__(self, known: Vocabulary):
        self.known, self.longest, self.penalty = known, known.longest, units(known.penalty)
        self.table = {p.replace(SPACE, " "): (i, units(s)) for p, i, s in known.table}

    def ids(self, word: str) -> list[int]:
        known, table, longest, penalty = self.known, self.table, self.longest, self.penalty
        n = len(word)
        ring = longest + 1
        best: list[int | None] = [0] + [None] * longest  # of the ends that a piece from here may reach; Python's whole numbers have no bound
        came, piece = array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        for start in range(n):
            base, best[start % ring] = best[start % ring], None
            for end in range(start + 1, min(n, start + longest) + 1):
                edge = table.get(word[start:end])
                if edge is None:
                    if end > start + 1:
                        continue
                    edge = (-1, penalty)
                held = best[end % ring]
                if held is None or base + edge[1] > held + TIE:
                    best[end % ring], came[end], piece[end] = base + edge[1], start, edge[0]
        out, at = [], n
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            elif min(known.byte_ids) < 0:
                out.append(known.unknown)
            else:
                out.extend(known.byte_ids[b] for b in reversed(word[came[at] : at].encode()))
            at = came[at]
        return out[::-1]


def segment(words: DataFrame, known: Vocabulary) -> DataFrame:
    """(word, n, ids): the best path through each word's lattice."""
    spark = words.sparkSession
    table = F.broadcast(piece_table(spark, known))  # as large as the vocabulary, whatever the corpus
    span = words.withColumn("start", F.explode(F.sequence(F.lit(0), F.length("word") - 1)))
    span = span.withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.lit(known.longest), F.length("word") - F.col("start")))))
    span = span.withColumn("sub", F.expr("substring(word, start + 1, size)"))
    edges = span.join(table, span["sub"] == table["piece"], "left").filter("id IS NOT NULL OR size = 1")
    edge = F.struct((F.col("start") + F.col("size")).alias("end"), F.col("start").alias("start"), F.coalesce("score", F.lit(units(known.penalty)).cast("long")).alias("score"), F.coalesce("id", -F.col("start") - 1).alias("id"))
    grouped = edges.groupBy("word").agg(F.first("n").alias("n"), F.collect_list(edge).alias("edges"))
    return grouped.select("word", "n", viterbi(F.col("edges"), F.col("word"), known).alias("ids"))


@dataclass
class Dictionary:
    """Words' hashes in ascending order, and their ids end to end."""

    keys: np.ndarray
    offsets: np.ndarray
    ids: np.ndarray

    def index(self) -> None:
        """Where each range of hashes begins: one gather in place of a binary search."""
        self.log = max(4, int(math.ceil(math.log2(max(2, len(self.keys))))))
        self.first = np.full((1 << self.log) + 1, len(self.keys), np.int32)
        for i in range(0, 1 << self.log, 1 << 16):  # in slices, to hold little besides
            cells = np.arange(i, min(i + (1 << 16), 1 << self.log), dtype=np.uint64)
            self.first[i : i + len(cells)] = np.searchsorted(self.keys, cells << np.uint64(64 - self.log))

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if it isn't held."""
        cell = (hashed >> np.uint64(64 - self.log)).astype(np.int64)
        at, end = self.first[cell].astype(np.int64), self.first[cell + 1]
        out = np.full(len(hashed), -1, np.int64)
        rest = np.flatnonzero(at < end)
        while len(rest):
            hit = self.keys[at[rest]] == hashed[rest]
            out[rest[hit]] = at[rest[hit]]
            rest = rest[~hit]
            at[rest] += 1
            rest = rest[at[rest] < end[rest]]
        return out


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices begin[0], begin[0] + 1, ..., for each range in turn."""
    total = int(size.sum())
    ends = np.cumsum(size)
    return np.arange(total) + np.repeat(begin - (ends - size), size)


def gather(table: DataFrame, most_bytes: int) -> tuple[Dictionary, bool]:
    """The dictionary of the most frequent words within the limit, and whether it is whole."""
    row = 24 + 2 * 8
    rows = table.count()
    whole = rows * row <= most_bytes
    if not whole:  # the frequency above which words fit: exact counts of each frequency, a short table
        by_n = table.groupBy("n").count().orderBy(F.desc("n")).toPandas()
        fits = by_n["n"][np.cumsum(by_n["count"].to_numpy()) * row <= most_bytes]
        table = table.filter(F.col("n") >= (int(fits.min()) if len(fits) else (1 << 62)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, offsets = buffers(batch.column("word"))
            hashed, starts, _ = word_hashes(raw, offsets)
            if not np.array_equal(starts, offsets[:-1]):
                raise ValueError("a row must hold one word")
            ids = batch.column("ids")
            packed = [hashed, np.diff(ids.offsets.to_numpy()).astype(np.uint16), ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)]
            packed[2] = packed[2].astype(np.uint16) if packed[2].max() < 1 << 16 else packed[2]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in packed] + [pa.array([packed[2].itemsize], pa.int32())], names=["keys", "sizes", "ids", "width"])

    got = table.select("word", "ids").mapInArrow(pack, "keys binary, sizes binary, ids binary, width int").collect()
    keys, size = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[c], kind) for r in got)]) for c, kind in (("keys", np.uint64), ("sizes", np.uint16)))
    kind = np.int32 if any(r["width"] == 4 for r in got) else np.uint16
    flat = np.concatenate([np.zeros(0, kind), *(np.frombuffer(r["ids"], {2: np.uint16, 4: np.int32}[r["width"]]).astype(kind, copy=False) for r in got)])
    del got
    begin = np.cumsum(size, dtype=np.int64) - size
    order = np.argsort(keys).astype(np.int32 if len(keys) < 1 << 31 else np.int64)
    keys, begin, size = keys[order], begin[order], size[order]
    offsets = np.append(0, np.cumsum(size, dtype=np.int64))
    ids = np.empty(len(flat), kind)
    for i in range(0, len(size), 1 << 16):  # in slices, to hold little besides
        part = size[i : i + (1 << 16)].astype(np.int64)
        ids[offsets[i] : offsets[i + len(part)]] = flat[spread(begin[i : i + len(part)], part)]
    return Dictionary(keys, offsets.astype(np.uint32) if len(flat) < 1 << 32 else offsets, ids), whole


def encode(docs: DataFrame, known: Vocabulary | None = None, doc_id: str = "doc_id", text: str = "text", dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """(doc_id, n_pieces, round_trip, ids) of each row; round_trip: whether decoding the ids gave the text."""
    spark = docs.sparkSession
    relieve(spark)
    known = known or load()
    raw_text = ref(docs, text).cast("string")
    rows = docs.select(ref(docs, doc_id).alias("doc_id"), F.when(raw_text == "", F.lit("")).otherwise(F.concat(F.lit(" "), raw_text)).alias("t"))
    found = segment(distinct_words(rows.select("t")), known)
    table = checkpoint(found.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions"))))  # a task takes its parts in turn
    dictionary, whole = gather(table, dictionary_bytes)
    shared = spark.sparkContext.broadcast((dictionary, known.pieces))
    del dictionary
    release()
    vocabulary_ = spark.sparkContext.broadcast(known)  # read only where a long word stands
    kind = docs.select(ref(docs, doc_id).alias("doc_id")).schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, said = shared.value
        held.index()
        piece_bytes = np.frombuffer(b"".join(said), np.uint8)
        piece_size = np.array([len(p) for p in said], np.int64)
        piece_begin = np.cumsum(piece_size) - piece_size
        long_words = None
        row = TaskContext.get().partitionId() << 40
        for batch in pieces(batches, "t", 1 << 19):
            raw, offsets = buffers(batch.column("t"))
            hashed, starts, n_bytes = word_hashes(raw, offsets)
            at = held.find(hashed)
            long = n_bytes > MAX_WORD
            at[long] = -1
            in_doc = np.searchsorted(starts, offsets)
            size = np.where(at >= 0, held.offsets[at + 1].astype(np.int64) - held.offsets[at], 0) if len(held.keys) else np.zeros(len(at), np.int64)
            ids = held.ids[spread(held.offsets[at].astype(np.int64), size)].astype(np.int32) if len(held.keys) else np.zeros(0, np.int32)
            if long.any():
                long_words = long_words or LongWords(vocabulary_.value)
                paths = [np.array(long_words.ids(raw[starts[i] : starts[i] + n_bytes[i]].tobytes().decode()), np.int32) for i in np.flatnonzero(long)]
                short, size[long] = ids, [len(p) for p in paths]
                theirs = np.repeat(long, size)
                ids = np.empty(len(theirs), np.int32)
                ids[~theirs], ids[theirs] = short, np.concatenate(paths)
            sums = np.append(0, np.cumsum(size))
            ends = sums[in_doc]
            # Decoding: the texts without the words that have no ids yet.
            lost = np.flatnonzero((at < 0) & ~long)
            there = np.delete(raw, spread(starts[lost], n_bytes[lost])) if len(lost) else raw
            gone = np.append(0, np.cumsum(n_bytes[lost]))[np.searchsorted(lost, in_doc)]
            texts = offsets - gone
            spelt = np.append(0, np.cumsum(piece_size[ids]))[ends]
            back = piece_bytes[spread(piece_begin[ids], piece_size[ids])]
            same = np.diff(spelt) == np.diff(texts)
            if len(back) == len(there):
                same &= np.diff(np.append(0, np.cumsum(back != there))[texts]) == 0
            else:
                same &= [bool(s) and np.array_equal(back[spelt[i] : spelt[i + 1]], there[texts[i] : texts[i + 1]]) for i, s in enumerate(same)]
            null = batch.column("t").is_null().to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids), mask=pa.array(null))
            columns = [batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int32), mask=null), pa.array(same, mask=null), lists]
            if not whole:
                owner = np.searchsorted(in_doc, lost, "right") - 1
                letters = pa.py_buffer(raw[spread(starts[lost], n_bytes[lost])].tobytes())
                spelt_out = pa.StringArray.from_buffers(len(lost), pa.py_buffer(np.append(0, np.cumsum(n_bytes[lost])).astype(np.int32).tobytes()), letters)
                rare = pa.StructArray.from_arrays([pa.array((sums[lost] - ends[owner]).astype(np.int32)), spelt_out], ["at", "word"])
                columns += [pa.array(np.arange(row, row + batch.num_rows)), pa.ListArray.from_arrays(pa.array(np.searchsorted(lost, in_doc).astype(np.int32)), rare)]
                row += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pieces", "round_trip", "ids", "row", "rare"][: len(columns)])
        del held
        release()

    fields = [kind, T.StructField("n_pieces", T.IntegerType()), T.StructField("round_trip", T.BooleanType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if whole:
        discard(table)
        return rows.mapInArrow(run, T.StructType(fields))
    rare = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("word", T.StringType())]))
    made = checkpoint(rows.mapInArrow(run, T.StructType([*fields, T.StructField("row", T.LongType()), T.StructField("rare", rare)])))  # so that rows keep their numbers
    # Each occurrence of a word beyond the broadcast part is joined to the whole dictionary; ids alone go back to its row.
    said = made.select("row", F.posexplode("rare").alias("pos", "x")).select("row", "pos", "x.at", "x.word")
    found = said.join(table.select("word", "ids"), "word").withColumn("fine", decode(F.col("ids"), known, False) == F.col("word"))
    found = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "at", "ids"))).alias("more"), F.every("fine").alias("fine"))
    joined = made.drop("rare").join(found, "row", "left").withColumn("ids", F.when(F.col("more").isNull(), F.col("ids")).otherwise(spliced(F.col("ids"), F.col("more.at"), F.col("more.ids"))))
    return joined.select("doc_id", F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n_pieces"), (F.col("round_trip") & F.coalesce("fine", F.lit(True))).alias("round_trip"), "ids")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def spliced(ids: pa.Array, at: pa.Array, parts: pa.Array) -> pa.Array:
    """ids with each of the row's parts put in before the id at its place, in turn."""
    length = lambda x: x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    kept, runs = length(ids), length(at)
    inner = parts.flatten()
    sizes = length(inner)
    begin = np.repeat(np.cumsum(kept) - kept, runs)
    place = np.repeat(begin + at.flatten().to_numpy(zero_copy_only=False), sizes)
    out = np.insert(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32), place.astype(np.int64), inner.flatten().to_numpy(zero_copy_only=False).astype(np.int32))
    added = np.diff(np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(runs))])
    ends = np.append(0, np.cumsum(kept + added)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(out), mask=ids.is_null())


def decode(ids: Column, known: Vocabulary | None = None, strip: bool = True) -> Column:
    """The text of an array of ids; null for null.  strip: less the space that encoding put before the text."""
    said = (known or load()).pieces

    @F.arrow_udf("string")
    def back(lists: pa.Array) -> pa.Array:
        out = []
        for row in lists:
            text = None if not row.is_valid else b"".join(said[i] for i in row.as_py()).decode("utf-8", "replace")
            out.append(text[1:] if strip and text else text)
        return pa.array(out, pa.string())

    return back(ids)
