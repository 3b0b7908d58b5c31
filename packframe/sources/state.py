"""Regime state and diagnostics as JSON tables.

State is one document: regimes by key (as text, since JSON keys are), the tuned
keys, and counters.  A missing or corrupt document is no state: None.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packframe.config import RegimeConfig
from packframe.functions.scalar import SAVED
from packframe.operators.regime import STATE

LIMITS = T.StructType([f for f in STATE if f.name in ("T", "B", "stable", "hwm_T", "hwm_B", "bytes_per_token", "adaptive_ramps")])
DOCUMENT = T.StructType([
    T.StructField("regime_limits", T.MapType(T.StringType(), LIMITS)), T.StructField("autotuned_keys", T.ArrayType(T.IntegerType())), T.StructField("regime_oom_count", T.MapType(T.StringType(), T.LongType())),
    T.StructField("oom_events", T.LongType()), T.StructField("oom_skipped_batches", T.LongType()), T.StructField("seeded_from", T.StringType()),
])


def as_document(states: DataFrame, key: str = "regime_key", skipped: int = 0, seeded_from: str | None = None) -> DataFrame:
    """One row in DOCUMENT's columns, of a table of regimes' states."""
    k = F.col(key).cast("string")
    row = F.struct(*[F.col(f.name) for f in LIMITS])
    return states.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(k, row)))).alias("regime_limits"),
        F.sort_array(F.collect_list(F.when(F.col("tuned"), F.col(key).cast("int")))).alias("autotuned_keys"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(k, F.col("oom_count"))))).alias("regime_oom_count"),
        F.coalesce(F.sum("oom_count"), F.lit(0)).cast("bigint").alias("oom_events"),
        F.lit(skipped).cast("bigint").alias("oom_skipped_batches"), F.lit(seeded_from).cast("string").alias("seeded_from"),
    )


def _versions(spark: SparkSession, path: str):
    """(the file system, the state's folder, its whole versions from the oldest to the newest)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath() for x in fs.listStatus(where)] if fs.exists(where) else []
    child = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")
    return fs, where, sorted((p for p in found if p.getName().startswith("version=") and fs.exists(child(p))), key=lambda p: p.getName())


def save(states: DataFrame, path: str, **about) -> None:
    """Write the document as a new version beside the old one, then drop older ones: a reader sees one or the other, whole."""
    spark = states.sparkSession
    fs, _, old = _versions(spark, path)
    newest = int(old[-1].getName().split("=")[1]) if old else 0
    as_document(states, **about).coalesce(1).write.mode("overwrite").json(f"{path}/version={newest + 1:012d}")
    for p in old[:-1]:  # a reader may still hold the last one
        fs.delete(p, True)


def save_on_failure(states: DataFrame, path: str, message: str, **about) -> bool:
    """Save if the failure is one worth saving for, and say whether; the caller raises it again."""
    if any(said in message for said in SAVED):
        save(states, path, **about)
        return True
    return False


def from_document(documents: DataFrame) -> DataFrame:
    """(regime_key, state columns): tuned is cleared and ramps end, so that limits are judged anew."""
    each = documents.select(F.explode("regime_limits").alias("k", "s"), "regime_oom_count")
    of = lambda name: F.col(f"s.{name}")
    return each.select(
        F.col("k").cast("int").alias("regime_key"), *[of(n).alias(n) for n in ("T", "B", "stable", "hwm_T", "hwm_B", "bytes_per_token")], F.lit(0).cast("bigint").alias("adaptive_ramps"),
        F.lit(0).cast("bigint").alias("util_attempts"), F.coalesce(F.try_element_at("regime_oom_count", F.col("k")), F.lit(0)).cast("bigint").alias("oom_count"), F.lit(False).alias("tuned"),
    )


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The states saved under a path, or None."""
    try:
        versions = _versions(spark, path)[2]
        found = spark.read.schema(DOCUMENT).json(versions[-1].toString() if versions else path).filter("regime_limits IS NOT NULL")
        return None if found.isEmpty() else from_document(found)
    except AnalysisException:
        return None


def seeded(states: DataFrame, adaptive: bool = False, ramps: int = 3) -> DataFrame:
    """States to start another run from: counters start anew; adaptive: marks too, with a few ramps to explore."""
    zero = F.lit(0).cast("bigint")
    out = states.withColumns({"stable": zero, "bytes_per_token": F.lit(None).cast("double"), "oom_count": zero, "util_attempts": zero, "tuned": F.lit(False), "adaptive_ramps": F.lit(ramps if adaptive else 0).cast("bigint")})
    return out.withColumns({"hwm_T": F.lit(None).cast("bigint"), "hwm_B": F.lit(None).cast("bigint")}) if adaptive else out


def summary(states: DataFrame, config: RegimeConfig | None = None, utilisation: DataFrame | None = None) -> DataFrame:
    """(regimes, total_oom, tuned, max_T, min_T) of all states, one row.

    config adds the limits' bounds; utilisation, a log with util, the mean of its samples.
    """
    out = _summary(states)
    if config is not None:
        out = out.withColumns({name: F.lit(getattr(config, name)).cast("bigint") for name in ("min_tokens", "top_tokens", "min_examples", "top_examples")})
    return out if utilisation is None else out.crossJoin(utilisation.agg(F.avg("util").alias("utilisation")))


def _summary(states: DataFrame) -> DataFrame:
    return states.agg(F.count(F.lit(1)).alias("regimes"), F.coalesce(F.sum("oom_count"), F.lit(0)).cast("bigint").alias("total_oom"), F.count(F.when(F.col("tuned"), 1)).alias("tuned"), F.max("T").alias("max_T"), F.min("T").alias("min_T"))


def write_records(records: DataFrame, path: str) -> None:
    """Diagnostics, one JSON object a line."""
    records.select("record").write.mode("overwrite").text(path)
