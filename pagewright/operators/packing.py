"""Greedy packing of ordered rows into groups, in time that grows with the rows.

Where a group ends depends only on the row it begins at: prefix sums give that row its successor, the first
row that no longer fits.  A task goes from one group's first row to the next by such jumps, over rows that
Spark has brought together by key and sorted; it holds one Arrow batch and the sum of the group still open.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ..runtime import python_ready


def packed(rows: DataFrame, keys: list[str], order: list[str], size: Column, most: Column | int, times: int | None = None) -> DataFrame:
    """``rows`` with ``part``: the number (from 0) of its group within ``keys``, in ``order``.

    A group takes rows while their sizes (whole numbers, not negative) stay within ``most`` together, which
    may differ between keys, and while it has fewer than ``times`` rows; its first row may be larger.
    ``order`` must tell the rows of a key apart; keys may be null.
    """
    python_ready(rows.sparkSession)
    w = Window.partitionBy(*keys).orderBy(*order)
    sorted_rows = rows.select(
        "*", size.cast("long").alias("_size"), (F.lit(most) if isinstance(most, int) else most).cast("long").alias("_most"), (F.row_number().over(w) == 1).alias("_first")
    ).sortWithinPartitions(*keys, *order)
    schema = StructType([*rows.schema.fields]).add("part", IntegerType())

    def run(batches):
        part, used, held = -1, 0, 0  # of the group still open
        for b in batches:
            n = b.num_rows
            sizes, most = b.column("_size").to_numpy(), b.column("_most").to_numpy()
            first = b.column("_first").to_numpy(zero_copy_only=False)
            ends, out = np.cumsum(sizes), np.empty(n, np.int32)
            heads = [0, *(np.flatnonzero(first[1:]) + 1).tolist()] if n else []
            for a, z in zip(heads, [*heads[1:], n], strict=False):
                fresh = bool(first[a])
                part, at = (-1 if fresh else part), a
                while at < z:
                    before = int(ends[at] - sizes[at])
                    room = int(most[at]) - (0 if fresh else used)
                    to = at + int(np.searchsorted(ends[at:z], before + room, "right"))
                    if times:
                        to = min(to, at + times - (0 if fresh else held))
                    if fresh:
                        part, used, held, to = part + 1, 0, 0, max(to, at + 1)
                    if to > at:
                        out[at:to] = part
                        used, held = used + int(ends[to - 1]) - before, held + to - at
                    at, fresh = to, True
            columns = [b.column(i) for i in range(b.num_columns - 3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out)], names=[*b.schema.names[:-3], "part"])

    return sorted_rows.mapInArrow(run, schema)


def _starts(sizes: np.ndarray, heads: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Where groups start: at each of ``heads``, and where the next row no longer fits; ``most`` is by head."""
    ends, out = np.cumsum(sizes), []
    for a, z, room in zip(heads.tolist(), [*heads[1:].tolist(), len(sizes)], most.tolist(), strict=True):
        while a < z:
            out.append(a)
            a = max(a + 1, a + int(np.searchsorted(ends[a:z], ends[a] - sizes[a] + room, "right")))
    return np.array(out, np.int64)


def _heads(first: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Rows before which a group ends whatever fits: the first of a key, those that stand alone and those after them."""
    stop = first | alone
    stop[1:] |= alone[:-1]
    if len(stop):
        stop[0] = True
    return np.flatnonzero(stop)


def _numbers(first: np.ndarray, open_: int = 0) -> np.ndarray:
    """The number of each group within its key; the first group's is ``open_`` if its key began before."""
    n = np.arange(len(first))
    since = np.maximum.accumulate(np.where(first, n, -1))
    return np.where(since < 0, n + open_, n - since).astype(np.int32)


def _lists(starts: np.ndarray, ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    n = ends - starts
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), values.take(pa.array(at)))


def grouped_rows(rows: DataFrame, keys: list[str], order: list[str], values: list[str], size: Column, alone: Column, most: int) -> DataFrame:
    """keys, part, and ``values`` as lists: a row for each group that ``packed`` makes, whose rows never leave their task.

    A row that is ``alone`` is a group of its own.  A task holds one Arrow batch and the rows of the group still
    open; sizes are at least 1, so these are ``most`` at most.
    """
    python_ready(rows.sparkSession)
    w = Window.partitionBy(*keys).orderBy(*order)
    x = rows.select(*keys, *order, *values, size.cast("long").alias("_size"), alone.alias("_alone"), (F.row_number().over(w) == 1).alias("_first")).sortWithinPartitions(*keys, *order).drop(*order)
    schema = StructType([x.schema[k] for k in keys]).add("part", IntegerType())
    for v in values:
        schema = schema.add(v, ArrayType(x.schema[v].dataType))

    def run(batches):
        held, number = None, 0  # the rows of the group still open, and its number

        def groups(t, starts, upto):
            first = t.column("_first").to_numpy(zero_copy_only=False)
            part = _numbers(first[starts], number)
            ends = np.append(starts[1:], t.num_rows)
            columns = [t.column(k).take(pa.array(starts[:upto])) for k in keys] + [pa.array(part[:upto])]
            return part, pa.RecordBatch.from_arrays(columns + [_lists(starts[:upto], ends[:upto], t.column(v)) for v in values], names=schema.names)

        for b in batches:
            if not b.num_rows:
                continue
            t = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            heads = _heads(*(t.column(c).to_numpy(zero_copy_only=False).copy() for c in ("_first", "_alone")))
            starts = _starts(t.column("_size").to_numpy(), heads, np.full(len(heads), most))
            part, out = groups(t, starts, len(starts) - 1)
            held, number = t.slice(starts[-1]), int(part[-1])
            if out.num_rows:
                yield out
        if held is not None:
            yield groups(held, np.zeros(1, np.int64), 1)[1]

    return x.mapInArrow(run, schema)


def grouped_lists(rows: DataFrame, keep: list[str], values: list[str], most: Column, overlap: int) -> DataFrame:
    """``keep``, part, ``values`` as lists, over: the groups that a row's list ``units`` (``values``, size, alone) is packed into.

    Each group has the last units of the one before it whose sizes stay within ``overlap`` at its front; ``over``
    is their size.  A list is one row's, so nothing is shuffled.
    """
    python_ready(rows.sparkSession)
    x = rows.select(*keep, most.cast("long").alias("_most"), "units")
    unit = x.schema["units"].dataType.elementType
    schema = StructType([x.schema[k] for k in keep]).add("part", IntegerType())
    for v in values:
        schema = schema.add(v, ArrayType(unit[v].dataType))
    schema = schema.add("over", IntegerType())

    def run(batches):
        for b in batches:
            lists = b.column("units")
            flat, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
            if not len(row):
                continue
            sizes, alone = (pc.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in ("size", "alone"))
            first = np.append(True, row[1:] != row[:-1])
            heads = _heads(first.copy(), alone)
            starts = _starts(sizes, heads, b.column("_most").to_numpy()[row[heads]])
            ends, upto = np.append(starts[1:], len(row)), np.append(0, np.cumsum(sizes))
            again = np.maximum(np.searchsorted(upto, upto[starts] - overlap, "left"), np.append(0, starts[:-1]))
            again = np.where(first[starts], starts, again)
            columns = [b.column(k).take(pa.array(row[starts])) for k in keep] + [pa.array(_numbers(first[starts]))]
            columns += [_lists(again, ends, pc.struct_field(flat, v)) for v in values]
            yield pa.RecordBatch.from_arrays([*columns, pa.array((upto[starts] - upto[again]).astype(np.int32))], names=schema.names)

    return x.mapInArrow(run, schema)
