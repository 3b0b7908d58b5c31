"""Token-weighted losses and corpus text metrics.

Each row's n-gram statistics are made where the row is, in Arrow batches; only
sums are shuffled, and scores follow from them in closed form.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packframe.functions.scalar import ALIASES
from packframe.functions.stemmer import stem
from packframe.operators import grams
from packframe.operators.nextfit import chunks

NAN = float("nan")


def weighted_loss(losses: DataFrame) -> DataFrame:
    """(loss): the mean by label tokens; rows without tokens don't count, NaN without any."""
    total = F.sum("ntok")
    return losses.filter("ntok > 0").agg(F.when(total > 0, F.sum(F.col("loss") * F.col("ntok")) / total).otherwise(F.lit(NAN)).alias("loss"))


BLEU = ["hyp_len", "ref_len", *[f"{x}{n}" for n in range(1, 5) for x in ("hit", "all")]]
CHRF = [f"{x}{n}" for n in range(1, 7) for x in ("hyp", "ref", "hit")]


def tokens_13a(text: str) -> list[str]:
    """Punctuation apart, but not within numbers."""
    text = f" {text} ".replace("<skipped>", "").replace("-\n", "").replace("\n", " ").replace("&quot;", '"').replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")
    text = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", text)
    text = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", text)
    text = re.sub(r"([\.,])([^0-9])", r" \1 \2", text)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", text).split()


def _sums(pairs: DataFrame, names: list[str], statistics: Callable[[list[str], list[str]], np.ndarray]) -> DataFrame:
    """(names) summed over all pairs; statistics: of some rows' texts, already summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                total += statistics(*([t or "" for t in part.column(c).to_pylist()] for c in ("pred", "ref")))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total.tolist()], names=names)

    made = pairs.select(F.col("pred").cast("string"), F.col("ref").cast("string")).mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return made.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def _ends(rows: list) -> np.ndarray:
    return np.append(0, np.cumsum([len(r) for r in rows], dtype=np.int64))


def bleu_sums(preds: list[str], refs: list[str], tokenize: str, lower: bool) -> np.ndarray:
    """The sums of BLEU's statistics, in the order of BLEU."""
    said = [[(tokens_13a(t) if tokenize == "13a" else t.split()) for t in (map(str.lower, side) if lower else side)] for side in (preds, refs)]
    words = [w for side in said for row in side for w in row]
    codes = pd.factorize(np.array(words, dtype=object))[0] if words else np.zeros(0, np.int64)
    ends = [_ends(side) for side in said]
    n = int(ends[0][-1])
    found = grams.shared(codes[:n], ends[0], codes[n:], ends[1], 4)
    return np.concatenate([[n, len(codes) - n], found[:, [2, 0]].reshape(-1)])


def chrf_sums(preds: list[str], refs: list[str]) -> np.ndarray:
    """The sums of chrF's statistics, in the order of CHRF."""
    said = [["".join(t.split()) for t in side] for side in (preds, refs)]
    codes = [np.frombuffer("".join(side).encode("utf-32-le", "surrogatepass"), np.uint32) for side in said]
    return grams.shared(codes[0], _ends(said[0]), codes[1], _ends(said[1]), 6).reshape(-1)


def bleu_statistics(pairs: DataFrame, tokenize: str = "13a", lower: bool = False) -> DataFrame:
    return _sums(pairs, BLEU, lambda p, r: bleu_sums(p, r, tokenize, lower))


def bleu(pairs: DataFrame, tokenize: str = "13a", lower: bool = False) -> DataFrame:
    """(bleu): corpus BLEU to order 4 with exponential smoothing, in percent."""
    s = bleu_statistics(pairs, tokenize, lower)
    log, smooth = F.lit(0.0), F.lit(1.0)
    for n in range(1, 5):
        hit, every = F.col(f"hit{n}").cast("double"), F.col(f"all{n}").cast("double")
        smooth = F.when((hit == 0) & (every > 0), smooth * 2).otherwise(smooth)
        log = log + F.when(every == 0, F.lit(NAN)).when(hit == 0, F.log(F.lit(100.0) / (smooth * every))).otherwise(F.log(F.lit(100.0) * hit / every))
    brevity = F.when(F.col("hyp_len") >= F.col("ref_len"), F.lit(1.0)).when(F.col("hyp_len") > 0, F.exp(F.lit(1.0) - F.col("ref_len") / F.col("hyp_len"))).otherwise(F.lit(0.0))
    score = F.when((F.col("hyp_len") == 0) | (F.col("hit1") == 0) | (F.col("all4") == 0), F.lit(0.0)).otherwise(brevity * F.exp(log / 4))
    return s.select(score.alias("bleu"))


def chrf_statistics(pairs: DataFrame) -> DataFrame:
    return _sums(pairs, CHRF, chrf_sums)


def chrf(pairs: DataFrame, beta: float = 2.0) -> DataFrame:
    """(chrf): corpus chrF to order 6, white space left out, in percent."""
    s = chrf_statistics(pairs)
    precision, recall, orders = F.lit(0.0), F.lit(0.0), F.lit(0)
    for n in range(1, 7):
        both = (F.col(f"hyp{n}") > 0) & (F.col(f"ref{n}") > 0)
        precision = precision + F.when(both, F.col(f"hit{n}") / F.col(f"hyp{n}")).otherwise(F.lit(0.0))
        recall = recall + F.when(both, F.col(f"hit{n}") / F.col(f"ref{n}")).otherwise(F.lit(0.0))
        orders = orders + F.when(both, 1).otherwise(0)
    p, r = precision / orders, recall / orders
    factor = beta * beta
    return s.select(F.when((orders > 0) & (precision + recall > 0), F.lit(100.0 * (1 + factor)) * p * r / (F.lit(factor) * p + r)).otherwise(F.lit(0.0)).alias("chrf"))


EXACT, STEM, SYNONYM = "exact", "stem", "synonym"


def meteor_pairs(a: list[str], b: list[str], stages: tuple[str, ...], synonyms: dict[str, frozenset[str]]) -> list[tuple[int, int]]:
    """The aligned words, in order of a: stage by stage, the last free word of a with the last free one of b that fits."""
    free_a, free_b = list(range(len(a))), list(range(len(b)))
    out = []
    for stage in stages:
        if stage == SYNONYM:
            left = []
            for i in reversed(free_a):
                meant = synonyms.get(a[i], frozenset()) | {a[i]}
                j = next((j for j in reversed(free_b) if b[j] in meant), None)
                if j is None:
                    left.append(i)
                else:
                    out.append((i, j))
                    free_b.remove(j)
            free_a = left[::-1]
            continue
        form = stem if stage == STEM else str
        places: dict[str, list[int]] = {}
        for j in free_b:
            places.setdefault(form(b[j]), []).append(j)
        left, taken = [], set()
        for i in reversed(free_a):
            held = places.get(form(a[i]))
            if held:
                out.append((i, held.pop()))
                taken.add(out[-1][1])
            else:
                left.append(i)
        free_a, free_b = left[::-1], [j for j in free_b if j not in taken]
    return sorted(out)


def meteor_row(pred: str, ref: str, stages: tuple[str, ...] = (EXACT, STEM), synonyms: dict[str, frozenset[str]] | None = None) -> float:
    """METEOR of a pair of texts, words being lower-cased runs without white space."""
    a, b = pred.lower().split(), ref.lower().split()
    order = meteor_pairs(a, b, stages, synonyms or {})
    if not order:
        return 0.0
    chunks = 1 + sum(1 for (i, x), (j, y) in zip(order, order[1:]) if j != i + 1 or y != x + 1)
    m = len(order)
    p, r = m / len(a), m / len(b)
    return p * r / (0.9 * p + 0.1 * r) * (1 - 0.5 * (chunks / m) ** 3)


def synonym_sets(table: DataFrame, most: int = 1 << 20) -> dict[str, frozenset[str]]:
    """Of a table (word, synonym) of a thesaurus, which is as large as its language and not as the data: at most ``most`` rows."""
    rows = table.select(F.lower("word").alias("word"), F.lower("synonym").alias("synonym")).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a thesaurus of over {most} rows")
    out: dict[str, set[str]] = {}
    for word, synonym in rows:
        out.setdefault(word, set()).add(synonym)
        out.setdefault(synonym, set()).add(word)
    return {w: frozenset(s) for w, s in out.items()}


def meteor(pairs: DataFrame, only: str | None = None, stages: tuple[str, ...] = (EXACT, STEM), synonyms: DataFrame | None = None) -> DataFrame:
    """(meteor): the mean over rows, or over those whose boolean column ``only`` holds; NaN for none.

    synonyms: an optional table (word, synonym), for a third stage.
    """
    rows = pairs if only is None else pairs.filter(F.coalesce(F.col(only), F.lit(False)))
    known = pairs.sparkSession.sparkContext.broadcast({} if synonyms is None else synonym_sets(synonyms))
    taken = stages if synonyms is None else (*stages, SYNONYM)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"m": [meteor_row(p or "", r or "", taken, known.value) for p, r in zip(batch["pred"], batch["ref"])]}, dtype="float64")

    return rows.select("pred", "ref").mapInPandas(run, "m double").agg(F.coalesce(F.avg("m"), F.lit(NAN)).alias("meteor"))


def generated_length(predictions: DataFrame, pad: int) -> DataFrame:
    """(gen_len): the mean number of generated tokens that aren't padding."""
    return predictions.agg(F.avg(F.size(F.filter("pred_ids", lambda x: x != pad))).alias("gen_len"))


def compute_metrics(pairs: DataFrame, predictions: DataFrame | None = None, pad: int = 0, only: str | None = None) -> DataFrame:
    """One row of bleu, chrf, meteor and gen_len, rounded, of pairs cut to 64 words and stripped."""
    out = bleu(pairs, "none").select(F.bround("bleu", 4).alias("bleu")).crossJoin(chrf(pairs).select(F.bround("chrf", 4).alias("chrf"))).crossJoin(meteor(pairs, only).select(F.bround("meteor", 4).alias("meteor")))
    return out if predictions is None else out.crossJoin(generated_length(predictions, pad).select(F.bround("gen_len", 2).alias("gen_len")))


#: Metrics by name, as functions from pairs to one row.
REGISTRY = {"bleu": bleu, "chrf": chrf, "meteor": meteor}


def factory(names: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A function from pairs to one row of the named metrics; names as users write them, each once."""
    known = list(dict.fromkeys(ALIASES.get(n.strip().lower(), n.strip().lower()) for n in names))
    if unknown := [n for n in known if n not in REGISTRY]:
        raise ValueError(f"no such metrics: {unknown}; there are {sorted(REGISTRY)}")

    def run(pairs: DataFrame) -> DataFrame:
        out = REGISTRY[known[0]](pairs)
        for name in known[1:]:
            out = out.crossJoin(REGISTRY[name](pairs))  # one row each
        return out

    return run


def paired(predictions: DataFrame, references: DataFrame, key: str | None = None, order: str = "example_id") -> DataFrame:
    """(key, pred, ref): joined by a key; without one by place, the longer side trimmed to the shorter."""
    if key is not None:
        return predictions.select(key, "pred").join(references.select(key, "ref"), key)
    p, r = ranked(predictions.select(order, "pred"), order), ranked(references.select(F.col(order).alias("_order"), "ref"), "_order")
    return p.join(r.drop("_order"), "rank").select(order, "pred", "ref")


def ranked(rows: DataFrame, order: str, n: int = 1024) -> DataFrame:
    """rows with rank, from 0 in order: rows of a cell of ``order`` are ranked apart and counts are added up, so no task sorts all."""
    cell = chunks(rows, order, n)
    held = rows.withColumn("_cell", cell)
    sizes = held.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_cell", F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = held.withColumn("rank", F.row_number().over(Window.partitionBy("_cell").orderBy(order)) - 1)
    return inside.join(F.broadcast(before), "_cell").withColumn("rank", F.col("rank") + F.col("_before")).drop("_cell", "_before")


def decoded(rows: DataFrame, ids: str, vocabulary: list[str], special: tuple[int, ...] = (), column: str = "text", space: str = "▁") -> DataFrame:
    """rows with the text of token ids: special and unknown ids are left out, and the mark of a word's begin is a space."""
    known = rows.sparkSession.sparkContext.broadcast({i: p for i, p in enumerate(vocabulary) if i not in set(special)})

    @F.arrow_udf(T.StringType())
    def text(lists: pa.Array) -> pa.Array:
        said = known.value
        return pa.array([None if row is None else "".join(said.get(i, "") for i in row).replace(space, " ").strip() for row in lists.to_pylist()], pa.string())

    return rows.withColumn(column, text(F.col(ids)))
