"""Next-fit packing of ordered lengths, in parallel.

Where a batch ends depends on all rows before it, so a group seems to be one
task's work.  But a piece of a group only needs to know how many tokens the
batch holds that is open when it begins; all it does with that is to absorb some
first rows and to start its own batches at the next.  So the group is cut in
chunks by its order, and:

1. each chunk says, for each number of first rows that may be absorbed, how many
   batches it then starts and what the last of them holds (a short table: as long
   as the rows that fit a budget);
2. one pass over these tables gives each chunk the open batch that it meets;
3. each chunk numbers its rows.

Chunks are read in blocks of numpy arrays: the row after which each row's batch
would end is one binary search over running sums, and the batches that are in
fact started are found by doubling jumps, without a loop over rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1 << 18


class Table:
    """What a run of rows does with an open batch.

    upto[j]: the tokens of its first j rows, as many as may be absorbed; starts[j]
    and held[j]: the batches it starts after them, and what the last holds (more
    than the budget if it is closed), -1 if all rows are absorbed.
    """

    def __init__(self, upto: np.ndarray, starts: np.ndarray, held: np.ndarray):
        self.upto, self.starts, self.held = upto, starts, held

    def absorbed(self, budget: int, carry):
        return np.maximum(np.searchsorted(self.upto, budget - carry, "right") - 1, 0)

    def after(self, budget: int, carry):
        """(batches started, tokens of the batch that is then open)."""
        j = self.absorbed(budget, carry)
        return self.starts[j], np.where(self.held[j] < 0, carry + self.upto[j], self.held[j])

    def then(self, other: "Table", budget: int) -> "Table":
        """The table of these rows and the other's, in turn."""
        own = slice(0, len(self.upto) - 1 if self.held[-1] < 0 else len(self.upto))
        started, held = other.after(budget, self.held[own])
        upto, starts = self.upto[own], self.starts[own] + started
        if self.held[-1] < 0:
            fits = other.upto + self.upto[-1] <= budget
            fits[0] = True
            upto, starts, held = np.append(upto, other.upto[fits] + self.upto[-1]), np.append(starts, other.starts[fits]), np.append(held, other.held[fits])
        return Table(upto, starts, held)


class Block:
    """Rows in order: where each row's batch would end."""

    def __init__(self, lengths: np.ndarray, budget: int, single: np.ndarray):
        """single: the rows that are a batch of their own."""
        n = len(lengths)
        self.n, self.budget, self.sums = n, budget, np.append(0, np.cumsum(lengths, dtype=np.int64))
        self.closed = single | (lengths > budget)
        barrier = np.full(n + 1, n, np.int64)  # the first closed row from here on
        barrier[:-1][self.closed] = np.flatnonzero(self.closed)
        barrier = np.minimum.accumulate(barrier[::-1])[::-1]
        end = np.searchsorted(self.sums, self.sums[:-1] + budget, "right") - 1
        rows = np.arange(n)
        self.next = np.where(self.closed, rows + 1, np.maximum(np.minimum(end, barrier[1:]), rows + 1))
        self.room = int(min(np.searchsorted(self.sums, budget, "right") - 1, barrier[0]))

    def table(self) -> Table:
        last = np.where(self.next < self.n, self.next, np.arange(self.n))  # the row that starts the last batch
        count = (self.next < self.n).astype(np.int64)
        while True:
            further = last[last]
            if np.array_equal(further, last):
                break
            count += count[last]
            last = further
        first = np.arange(min(self.room + 1, self.n))
        ends = last[first]
        held = np.where(self.closed[ends], self.budget + 1, self.sums[-1] - self.sums[ends])
        starts = count[first] + 1
        if self.room == self.n:
            starts, held = np.append(starts, 0), np.append(held, -1)
        return Table(self.sums[: self.room + 1], starts, held)

    def starts(self, first: int) -> np.ndarray:
        """The rows that start a batch, if ``first`` rows are absorbed."""
        marked = np.zeros(self.n + 1, bool)
        marked[first] = True
        jump = np.append(self.next, self.n)
        while True:
            reached = marked.copy()
            reached[jump[marked]] = True
            if np.array_equal(reached, marked):
                return marked[:-1]
            marked, jump = reached, jump[jump]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows): runs of rows of one key, a run cut at batches and at BLOCK rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[::BLOCK] = True
        at = np.append(np.flatnonzero(new), batch.num_rows)
        for a, b in zip(at[:-1], at[1:]):
            yield tuple(c[a].item() for c in columns), batch.slice(a, b - a)


def next_fit(rows: DataFrame, group: str, chunk: Column, order: list[str], length: str, budget: int, single: Column, number: str) -> DataFrame:
    """The rows with ``number``, their batch within the group, from 0.

    Rows of a group are taken in ``order``; chunk: a whole number that never falls in
    that order, by which a group is cut.  single: whether a row is a batch of its own.
    """
    keyed = rows.withColumn("_chunk", chunk.cast("int")).withColumn("_single", F.coalesce(single, F.lit(False)))
    moved = keyed.repartition(group, "_chunk").sortWithinPartitions(group, "_chunk", *order)
    block = lambda part: Block(part.column(length).to_numpy(zero_copy_only=False).astype(np.int64), budget, part.column("_single").to_numpy(zero_copy_only=False))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Table | None = None
        before: tuple | None = None

        def done() -> pa.RecordBatch:
            lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (held.upto, held.starts, held.held)]
            return pa.RecordBatch.from_arrays([pa.array([before[0]], pa.int64()), pa.array([before[1]], pa.int32()), *lists], names=["_g", "_c", "upto", "starts", "held"])

        for key, part in _runs(batches, [group, "_chunk"]):
            if before is not None and key != before:
                yield done()
                held = None
            before, own = key, block(part).table()
            held = own if held is None else held.then(own, budget)
        if before is not None:
            yield done()

    def entries(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_c")
        at, carry, out = -1, budget + 1, []
        for upto, starts, held in zip(frame["upto"], frame["starts"], frame["held"]):
            out.append((at, carry))
            started, carry = (int(x) for x in Table(np.asarray(upto), np.asarray(starts), np.asarray(held)).after(budget, carry))
            at += started
        return pd.DataFrame({"_g": frame["_g"].to_numpy(), "_c": frame["_c"].to_numpy(), "_at": [x[0] for x in out], "_carry": [x[1] for x in out]})

    # As many rows as chunks: a group's tables are one task's, its rows are not.
    found = moved.mapInArrow(tables, "_g long, _c int, upto array<long>, starts array<long>, held array<long>").groupBy("_g").applyInPandas(entries, "_g long, _c int, _at long, _carry long")
    met = moved.join(found, (F.col(group) == F.col("_g")) & (F.col("_chunk") == F.col("_c"))).drop("_g", "_c").repartition(group, "_chunk").sortWithinPartitions(group, "_chunk", *order)

    names = rows.columns

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, at, carry = None, 0, 0
        for key, part in _runs(batches, [group, "_chunk"]):
            if key != before:
                before, at, carry = key, part.column("_at")[0].as_py(), part.column("_carry")[0].as_py()
            own = block(part)
            table = own.table()
            first = int(table.absorbed(budget, carry))
            numbers = at + np.cumsum(own.starts(first))
            started, carry = (int(x) for x in table.after(budget, carry))
            at += started
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(numbers.astype(np.int32))], names=[*names, number])

    return met.mapInArrow(label, T.StructType([*rows.schema.fields, T.StructField(number, T.IntegerType())]))


def chunks(rows: DataFrame, key: str, n: int) -> Column:
    """A chunk of [0, n) by a whole-number key, about equal ones; of another type all rows are one chunk.

    What is read is the key alone, and what comes back are n - 1 quantiles.
    """
    if n < 2 or not isinstance(rows.schema[key].dataType, T.IntegralType):
        return F.lit(0)
    cuts = sorted({int(x) for x in rows.select(F.percentile_approx(key, [i / n for i in range(1, n)], F.lit(1000)).alias("q")).first()["q"] or []})
    return F.array_size(F.filter(F.array(*[F.lit(c).cast("bigint") for c in cuts]), lambda c: c < F.col(key))) if cuts else F.lit(0)
