"""The regime state machine on a stream of step-log rows.

State is kept by run, as JSON, and changes by the same function as in the batch
replay.  Rows are put in order of (step, attempt) within a micro-batch; across
micro-batches they must arrive in order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packframe.config import RegimeConfig
from packframe.operators.regime import LOG, STATE, Regime, apply_row, with_log_columns

HELD = T.StructType([T.StructField("regimes", T.StringType())])


def stream(log: DataFrame, config: RegimeConfig = RegimeConfig(), key: str = "regime_key", run: str | None = None, start: Regime | None = None) -> DataFrame:
    """(run, key, step, attempt, state columns) after each row, as rows arrive; keys are whole numbers.

    run: the column that names a run; without it the stream is one.
    """
    full = with_log_columns(log)
    names = [f.name for f in STATE]
    first = start or Regime.fresh(config)
    by = run or "_run"
    if run is None:
        full = full.withColumn(by, F.lit(0))

    def step(group: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        regimes = {int(k): Regime(**s) for k, s in json.loads(held.get[0]).items()} if held.exists else {}
        rows = pd.concat(list(frames)).sort_values(["step", "attempt"], kind="stable")
        out = []
        for at, attempt, k, *row in zip(rows["step"], rows["attempt"], rows[key], *[rows[c].array for c in LOG]):
            s = apply_row(regimes, int(k), config, first, *[None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else x for x in row])
            out.append((group[0], k, at, attempt, *asdict(s).values()))
        held.update((json.dumps({k: asdict(s) for k, s in regimes.items()}, default=int),))
        frame = pd.DataFrame(out, columns=[by, key, "step", "attempt", *names])
        yield frame.astype({n: "Int64" for n in names if n not in ("bytes_per_token", "tuned")})

    kinds = {f.name: f.dataType for f in full.schema}
    out = T.StructType([*[T.StructField(c, kinds[c]) for c in (by, key, "step", "attempt")], *STATE.fields])
    made = full.groupBy(by).applyInPandasWithState(step, out, HELD, "append", GroupStateTimeout.NoTimeout)
    return made if run else made.drop(by)
