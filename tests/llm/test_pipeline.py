"""The corpus pipeline, stage by stage and as a whole, on the small tables and on messy rows."""

from __future__ import annotations

from collections import Counter

import cases
import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_dedup_and_mix import alike, brute_lines, groups_of
from test_pieces_search_toxicity import best_path, planted

from packframe.llm import line_dedup, sentencepiece


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """(docs, and what each stage wrote), in order."""
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mix_sources", "sentencepiece"]


def test_columns_pass_through(stages):
    for made in stages[1:-1]:
        assert made.dtypes == stages[0].dtypes


def test_clean_documents_stay(spark, sf_dir, stages):
    """11 toxic labels are too few for a seed to be beyond chance; no clean document goes."""
    kept = {r[0] for r in stages[1].select("doc_id").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 0").collect()}
    assert len(clean - kept) <= 0.03 * len(clean)


def test_toxic_documents_go(spark, tmp_path):
    docs = planted(spark)
    docs.select("doc_id", F.lit(1).alias("quality"), "toxic").filter("doc_id % 2 = 0 OR doc_id % 3 = 1").write.parquet(f"{tmp_path}/labels.parquet")
    made = corpus_pipeline.STAGES[0][1](spark, docs.drop("toxic"), str(tmp_path))
    kept = {r[0] for r in made.collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in docs.collect()}
    assert sum((i in kept) != bool(t) for i, t in toxic.items()) >= 0.97 * len(toxic)


def test_boilerplate_goes(stages):
    before, after = ({r["doc_id"]: (r["source"], r["text"]) for r in s.collect()} for s in stages[1:3])
    assert after == dict(zip(before, brute_lines(list(before.values()), line_dedup.RATIO, line_dedup.MIN_PAGES)))


def test_one_document_of_each_group_stays(stages):
    ids, pairs = alike(stages[2])
    want = groups_of(ids, pairs)
    kept = {r[0] for r in stages[3].select("doc_id").collect()}
    assert {want[i] for i in ids} <= {want[i] for i in kept} and len(kept) <= 1.02 * len(set(want.values()))
    assert all(i in kept for i, c in want.items() if sum(v == c for v in want.values()) == 1)


def test_every_document_is_mixed_in(stages):
    before, after = (Counter(r[0] for r in s.select("doc_id").collect()) for s in stages[3:5])
    assert set(after) == set(before) and all(after[i] >= n for i, n in before.items())


def test_texts_are_encoded(stages):
    known = sentencepiece.load()
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count() and all(r["round_trip"] for r in rows)
    for r in rows[:40]:
        if len(texts[r["doc_id"]]) < 3000:
            assert r["ids"] == best_path(texts[r["doc_id"]], known)[0]


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    made = corpus_pipeline.run(spark, sf_dir)
    key = lambda df: Counter((r["doc_id"], tuple(r["ids"])) for r in df.collect())
    assert key(made) == key(stages[5])


def test_messy_rows_go_through(spark, sf_dir):
    for docs in (cases.clashing(spark), cases.empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, docs, sf_dir)
            assert made.columns == docs.columns
            docs = spark.createDataFrame(made.collect(), made.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).filter(~F.col("round_trip")).count() == 0
