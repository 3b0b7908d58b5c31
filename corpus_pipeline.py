"""Corpus preparation in five stages, each one of the operators of ``packframe.llm``.

Each stage takes all documents that the stage before kept.  The first four
return the columns of ``documents``; the last returns the encoded corpus.

1. toxicity: documents that the induced lexicon rejects go.
2. line dedup: a source's boilerplate lines go from its documents' texts.
   Documents stay, also where nothing of the text is left.
3. MinHash near-dedup: of each group the document with the least id stays.
4. mixing: documents are repeated in epochs as the schedule takes them, so that
   sources' shares of tokens come to the target weights; each is there at least once.
5. SentencePiece: texts are encoded, and decoded to verify.

Every stage handles nulls, empty texts, repeated rows, empty tables and extra
columns as its operator states.  SQL can't express stages 1, 3 and 5; the
tests hold each against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from packframe.llm import line_dedup, mixing, near_dedup, sentencepiece, toxicity
from packframe.llm.common import checkpoint, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def near_dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup_documents),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, on the documents table; each stage's result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
