"""Unions and gaps of day intervals, by canonical dyadic blocks.

An interval is the union of few blocks ``[i * 2^l, (i + 1) * 2^l)``. Blocks below another are dropped, pairs of siblings
are replaced by their parent from the lowest level up, and what is left is disjoint and as coarse as can be; blocks that
touch then make a period. The steps run over arrays of many entities at once, since a cascade of sibling merges is a loop
over levels that Catalyst could only express as one shuffle or aggregate a level.

They run in each task first, then by entity and cell, a cell being a block of a high level, and last by entity over what
is left. Rows arrive sorted, so that all a task keeps between batches is the one period that is still open.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.columns import day_number
from lodeworks.operators.tree import chunks_of

#: Days are shifted so that year 1 is above 0, and years up to 9999 fit below 2^LEVELS.
SHIFT, LEVELS = 800_000, 23
#: Level of the cells by which an entity is shared out: 4,096 days, so that a cell has 2,048 periods at most.
CELL = 12
#: What stands for the whole cells of an interval, which are one row.
WHOLE = -1
#: Rows that a task holds at most before it works on them.
BATCH_ROWS = 200_000


def blocks_of(e: np.ndarray, s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical blocks (entity, level, index) of the closed intervals [s, t]."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lo, hi = s.astype(np.int64), t.astype(np.int64) + 1
    for level in range(LEVELS + 1):
        live = lo < hi
        if not live.any():
            break
        e, lo, hi = e[live], lo[live], hi[live]
        left = (lo & 1) == 1
        out.append((e[left], np.full(left.sum(), level), lo[left]))
        lo = lo + left
        right = ((hi & 1) == 1) & (lo < hi)
        hi = hi - right
        out.append((e[right], np.full(right.sum(), level), hi[right]))
        lo, hi = lo >> 1, hi >> 1
    if not out:
        return e[:0], s[:0], s[:0]
    return tuple(np.concatenate(x) for x in zip(*out))


def without_covered(e: np.ndarray, level: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks that no other block contains, each once. Blocks nest or are apart, so one running maximum tells."""
    if not len(e):
        return e, level, i
    order = np.lexsort((-level, i << level, e))
    e, level, i = e[order], level[order], i[order]
    span = np.int64(1) << (LEVELS + 2)
    reach = np.maximum.accumulate(e * span + ((i + 1) << level))
    keep = np.ones(len(e), bool)
    keep[1:] = (e * span + ((i + 1) << level))[1:] > reach[:-1]
    return e[keep], level[keep], i[keep]


def siblings_merged(e: np.ndarray, level: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint blocks with every complete pair of siblings replaced by the parent, upwards."""
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    span = np.int64(1) << (LEVELS + 2)
    up = np.empty(0, np.int64)
    for at in range(LEVELS + 1):
        own = level == at
        here = np.sort(np.concatenate([up, e[own] * span + i[own]]))
        if not len(here):
            up = here
            continue
        first = np.zeros(len(here), bool)
        first[:-1] = ((here[:-1] & 1) == 0) & (here[1:] == here[:-1] + 1)
        pair = first.copy()
        pair[1:] |= first[:-1]
        single, both = here[~pair], here[first]
        done.append((single // span, np.full(len(single), at), single % span))
        up = (both // span) * span + ((both % span) >> 1)
    if len(up):
        done.append((up // span, np.full(len(up), LEVELS + 1), up % span))
    return tuple(np.concatenate(x) for x in zip(*done)) if done else (e[:0], level[:0], i[:0])


def united(e: np.ndarray, s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entity, from, to) of the continuous periods of closed intervals of entities 0, 1, ..., sorted."""
    e, level, i = siblings_merged(*without_covered(*blocks_of(e.astype(np.int64), s, t)))
    if not len(e):
        return e, e, e
    lo, hi = i << level, ((i + 1) << level) - 1
    order = np.lexsort((lo, e))
    e, lo, hi = e[order], lo[order], hi[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (lo[1:] > hi[:-1] + 1)
    at = np.flatnonzero(new)
    return e[at], lo[at], hi[np.append(at[1:], len(e)) - 1]


def by_cell(s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, from, to): each interval as its whole cells, in one piece, and what it has of the cells at its ends."""
    row = np.arange(len(s))
    first, after = (s + (1 << CELL) - 1) >> CELL, (t + 1) >> CELL  # whole cells are [first, after)
    inside = after < first  # of one cell, neither its first day nor its last
    whole = after > first
    left = ~inside & (s < first << CELL)
    right = ~inside & (t >= after << CELL)
    at = np.concatenate([row[inside], row[whole], row[left], row[right]])
    cell = np.concatenate([s[inside] >> CELL, np.full(whole.sum(), WHOLE), s[left] >> CELL, t[right] >> CELL])
    lo = np.concatenate([s[inside], first[whole] << CELL, s[left], after[right] << CELL])
    hi = np.concatenate([t[inside], (after[whole] << CELL) - 1, (first[left] << CELL) - 1, t[right]])
    return at, cell, lo, hi


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Periods of the rows of a task, by cell. What was united stays in the buffer as long as it is small, so a task gives few rows."""
    names = ["k", "s", "t"]

    def work(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        keys = t["k"].combine_chunks().dictionary_encode()
        e, s, u = united(keys.indices.to_numpy(), t["s"].to_numpy(), t["t"].to_numpy())
        return pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(e)), pa.array(s, pa.int32()), pa.array(u, pa.int32())], names=names)

    def out(b: pa.RecordBatch) -> pa.RecordBatch:
        at, cell, lo, hi = by_cell(b["s"].to_numpy().astype(np.int64), b["t"].to_numpy().astype(np.int64))
        return pa.RecordBatch.from_arrays([b["k"].take(pa.array(at)), *[pa.array(x, pa.int32()) for x in (cell, lo, hi)]], names=["k", "cell", "s", "t"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= BATCH_ROWS:
            done = work(held)
            if done.num_rows > BATCH_ROWS // 2:
                yield out(done)
                held, rows = [], 0
            else:
                held, rows = [done], done.num_rows
    if held:
        yield out(work(held))


def _joined(keys: list[str], gaps: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Periods of rows that come sorted by the keys and their start, and with ``gaps`` what lies between them."""

    def work(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """The periods of a stretch of rows, and the places where a period follows another of the same keys."""
        codes = np.zeros(t.num_rows, np.int64)
        for k in keys:
            c = t[k].combine_chunks()
            c = (c.dictionary_encode().indices if pa.types.is_string(c.type) else c).to_numpy()
            codes[1:] |= c[1:] != c[:-1]
        codes = np.cumsum(codes)
        e, s, u = united(codes, t["s"].to_numpy(), t["t"].to_numpy())
        head = t.select(keys).take(pa.array(np.searchsorted(codes, e)))
        both = head.append_column("s", pa.array(s, t["s"].type)).append_column("t", pa.array(u, t["s"].type))
        return both.combine_chunks(), np.flatnonzero(e[1:] == e[:-1])

    def shown(t: pa.Table, kind: str) -> list[pa.RecordBatch]:
        if gaps:
            t = t.append_column("kind", pa.array([kind] * t.num_rows, pa.string())).select([*keys, "kind", "s", "t"])
        return t.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush() -> tuple[pa.Table, list[pa.RecordBatch]]:
            t, follows = work(pa.Table.from_batches(held).combine_chunks())
            out: list[pa.RecordBatch] = []
            if gaps and len(follows):
                between = t.take(pa.array(follows))
                lo, hi = between["t"].to_numpy() + 1, t["s"].to_numpy()[follows + 1] - 1
                out += shown(between.select(keys).append_column("s", pa.array(lo, t["s"].type)).append_column("t", pa.array(hi, t["s"].type)), "gap")
            return t, out

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= BATCH_ROWS:
                t, out = flush()
                yield from out
                yield from shown(t.slice(0, t.num_rows - 1), "period")
                held = t.slice(t.num_rows - 1).combine_chunks().to_batches()  # still open
                rows = 1
        if held:
            t, out = flush()
            yield from out
            yield from shown(t, "period")

    return run


_final = _joined(["k"], True)


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str, fan_in: int = 1024) -> DataFrame:
    """(entity, kind, day_from, day_to): the continuous periods of each entity and the gaps between them.

    ``kind`` is ``period`` or ``gap``; days are day numbers, both ends included. Periods that share a day or follow on the
    very next day are one. Rows with null entity, start or end, with end before start, or outside the years 1 to 9999
    don't count. Empty input gives no rows; other columns play no part.

    Scale: each task unites its own rows first, so a hot entity leaves a few periods a task. Those meet by (entity, cell of
    4,096 days), ``fan_in`` tasks at a time where there are more, and only the few periods of each cell by entity. A cell has
    2,048 periods at most, whatever the rows; a task reads them in order and holds one open period, never an entity.
    """
    valid = df.select(F.col(f"`{entity}`").cast("string").alias("k"), (day_number(F.col(f"`{start}`")) + SHIFT).alias("s"), (day_number(F.col(f"`{end}`")) + SHIFT).alias("t")).where(f"k is not null and s >= 0 and t >= s and t < {1 << LEVELS}")
    parts = valid.mapInArrow(_local, "k string, cell int, s int, t int")
    nodes = chunks_of(df)
    while nodes > fan_in:
        nodes = math.ceil(nodes / fan_in)
        some = parts.withColumn("node", F.pmod(F.spark_partition_id(), F.lit(nodes)).cast("int"))
        parts = some.repartition("k", "cell", "node").sortWithinPartitions("k", "cell", "node", "s").mapInArrow(_joined(["k", "cell", "node"], False), "k string, cell int, node int, s int, t int").drop("node")
    cells = parts.repartition("k", "cell").sortWithinPartitions("k", "cell", "s").mapInArrow(_joined(["k", "cell"], False), "k string, cell int, s int, t int")
    final = cells.select("k", "s", "t").repartition("k").sortWithinPartitions("k", "s").mapInArrow(_final, "k string, kind string, s int, t int")
    return final.select(F.col("k").alias("entity"), "kind", (F.col("s") - SHIFT).alias("day_from"), (F.col("t") - SHIFT).alias("day_to"))
