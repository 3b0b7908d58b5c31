"""Rows that every operator must take: nulls, empty and very long texts, repeats, and columns with clashing names."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LEXICON = "river stone market garden window letter winter candle bridge forest engine harbor mirror pocket silver thunder village whisper yellow zebra".split()
LONG = "lorem ipsum dolor " * 60_000


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(LEXICON) + str(draw.randint(0, 40)) for _ in range(n))


def messy_rows() -> list[tuple]:
    texts = [None, "", " \t\n", "?!...", "one", prose(1, 80), prose(1, 80), prose(1, 79) + " changed", "Café naïve 中文 \U0001f600 — mixed\r\nlines\nlines", LONG, prose(2, 300)]
    rows = [(i, t, "en" if i % 2 else None, None if i % 4 == 3 else f"site{i % 2}", None) for i, t in enumerate(texts)]
    return [*rows, (None, prose(3, 40), None, "site0", 1), (None, None, None, None, None), rows[10], (10, prose(4, 20), "en", "site1", 5)]


def messy(spark):
    return spark.createDataFrame(messy_rows(), DOCUMENTS)


def clashing(spark):
    """messy() with columns named like those that operators make up."""
    names = "id t t0 same bands label n h k w word shard score toxic _low _score _host _lines _kept _text _gone _key _hash _size _range _copies _id begin block tokens bucket epoch slot ids lost row begin_ x.y".split()
    return messy(spark).withColumns({c: F.lit(7) for c in names})


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
