"""The ordered fold: a label for each row that depends on all rows before it in its group.

Greedy packing can't be a window function, as a frame cannot restart on its own
output.  Rows are shuffled by their group, sorted within partitions, and one
pass carries the state from row to row and from Arrow batch to Arrow batch: memory
doesn't grow with a group, and only the columns given move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable[[], Any], step: Callable[..., tuple[Any, tuple]], labels: list[tuple[str, T.DataType]]) -> DataFrame:
    """The rows with label columns.

    step(state, *inputs) gives the next state and the row's labels; each group
    begins with start().  Without keys all rows are one group, and one task.
    """
    names = [name for name, _ in labels]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before: Any = None
        state: Any = None
        fresh = True
        for batch in batches:
            out: list[tuple] = []
            groups = list(zip(*[batch[k] for k in keys])) if keys else [()] * len(batch)
            for group, values in zip(groups, zip(*[batch[c].array for c in inputs])):
                if fresh or group != before:
                    state, before, fresh = start(), group, False
                state, said = step(state, *values)
                out.append(said)
            for i, name in enumerate(names):
                batch[name] = pd.Series([o[i] for o in out], index=batch.index, dtype="object")
            yield batch

    schema = T.StructType([*df.schema.fields, *[T.StructField(name, kind) for name, kind in labels]])
    moved = df.repartition(*keys) if keys else df.repartition(1)
    return moved.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
