"""What operators give back, and how much text a pass takes at once."""

from __future__ import annotations

import cases
import numpy as np
import pyarrow as pa
import pytest

from packframe.llm import common, near_dedup, sentencepiece, toxicity


def test_executors_shrink_their_heaps(spark):
    """In local mode the executor is this JVM."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    held = [spark.sparkContext._gateway.new_array(spark._jvm.long, 1 << 20) for _ in range(120)]
    grown = runtime.totalMemory()
    for x in held:
        spark.sparkContext._gateway.detach(x)
    del held
    common.relieve(spark)
    assert runtime.totalMemory() < grown - (400 << 20)


@pytest.mark.parametrize("module, stage", [(sentencepiece, lambda docs: sentencepiece.encode(docs)), (near_dedup, near_dedup.drop_near_duplicates), (toxicity, lambda docs: toxicity.drop_toxic(docs, docs.selectExpr("doc_id", "0 AS toxic")))])
def test_stages_begin_with_shrunk_heaps(spark, monkeypatch, module, stage):
    class Begun(Exception):
        pass

    def begun(_):
        raise Begun

    monkeypatch.setattr(module, "relieve", begun)
    with pytest.raises(Begun):
        stage(cases.messy(spark))


def test_scores_take_bounded_text_at_once(monkeypatch):
    taken = []
    whole = toxicity.text_scores
    monkeypatch.setattr(toxicity, "text_scores", lambda texts, lexicon: taken.append(texts.nbytes) or whole(texts, lexicon))
    lexicon = toxicity.Lexicon(np.sort(common.hash_words(["stone", "river"])), np.array([0.5, 1.0], np.float32))
    texts = pa.array([None, "", "a stone", *["stone and river " * 2000] * 100, "x"], pa.string())
    got = toxicity.piecewise_scores(texts, lexicon)
    assert np.array_equal(got, whole(texts, lexicon)[:, 0]) and max(taken) < 1 << 20
    assert len(toxicity.piecewise_scores(texts[:0], lexicon)) == 0
