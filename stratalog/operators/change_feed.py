"""Rebuilding a table from a feed of inserts, updates and deletes that repeats and is out of order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.runtime import in_arrow


def events(
    rows: DataFrame, key: str, order: list[Column | str], columns: list[str], deleted: Column, base: bool = False,
    changed: Column | None = None,
) -> DataFrame:
    """Bring rows into the form that ``replay`` takes.

    ``order`` gives two sequence columns, the second breaking ties of the first. ``changed`` is an array of the names of
    the columns that a row sets; without it a row sets all of them. ``base`` marks rows of the state before the feed.
    """
    o1, o2 = (F.col(c) if isinstance(c, str) else c for c in order)
    sets = [F.lit(True) if changed is None else F.coalesce(F.array_contains(changed, c), F.lit(False)) for c in columns]
    gone = F.coalesce(deleted, F.lit(False))
    return rows.select(
        F.col(key).alias("k"), o1.cast("long").alias("o1"), o2.cast("long").alias("o2"), gone.alias("gone"),
        (gone | F.lit(base)).alias("barrier"), *[(s & ~gone).alias(f"s{i}") for i, s in enumerate(sets)],
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)],
    )


class _Groups:
    """The groups of equal keys in a table sorted by key and sequence, and the event that decides each column."""

    def __init__(self, table: pa.Table, width: int):
        n, k = table.num_rows, table.column("k").combine_chunks()
        k = k.combine_chunks() if isinstance(k, pa.ChunkedArray) else k
        a, b = k.slice(1), k.slice(0, n - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        self.starts = np.concatenate([[0], 1 + np.flatnonzero(~same.to_numpy(zero_copy_only=False))])
        self.ends = np.append(self.starts[1:], n) - 1
        place = np.arange(n)
        last = lambda name: np.maximum.reduceat(np.where(table.column(name).to_numpy(), place, -1), self.starts)
        #: The last delete or base row: all before it has been applied or is void.
        self.barrier = last("barrier")
        self.setter = [np.where((p := last(f"s{i}")) >= self.barrier, p, -1) for i in range(width)]

    def needed(self) -> np.ndarray:
        """Places of the events that can still matter, whatever else comes for the key."""
        places = np.unique(np.concatenate([self.barrier, *self.setter, self.ends]))
        return places[places >= 0]


def _whole_groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Table, _Groups]]:
    """Tables of whole key groups. The group that a batch leaves open is kept as the events that can still matter, so
    memory does not grow with the number of changes of a key."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        cut = int(_Groups(table, width).starts[-1])
        if cut:
            head = table.slice(0, cut)
            yield head, _Groups(head, width)
        tail = table.slice(cut)
        held = tail.take(pa.array(_Groups(tail, width).needed()))
    if held is not None:
        yield held, _Groups(held, width)


def replay(changes: DataFrame, base: DataFrame | None, columns: list[str], key: str = "key", order: tuple[str, str] = ("version", "arrival")) -> DataFrame:
    """The state after all changes: ``(key, order..., live, columns...)``, one row per key that ever occurred.

    First each input partition, sorted by key and sequence where it lies, drops the events that later ones override;
    a key with a third of all changes so becomes a few rows per partition before anything is shuffled. The rest is
    repartitioned by key, sorted by sequence within partitions and run through the same state machine: a delete voids
    the row, a base row stands for everything up to its sequence (older changes are already applied and skipped), a
    change sets only the columns it names. Repeated changes set the same values again, which alters nothing.

    Nulls: a null key is a key of its own; a null sequence comes before all others; a null in a column that a change sets
    is a value. Changes with equal key and sequence are taken in the order of their values, so the result is defined.
    A put after a delete makes the row live again with only the columns set since. Empty inputs give no rows.
    """
    width = len(columns)
    log = changes if base is None else changes.unionByName(base)
    schema = log.schema
    sequence = ["k", "o1", "o2", "barrier", *[f"c{i}" for i in range(width)]]

    def compact(batches):
        for table, groups in _whole_groups(batches, width):
            yield from table.take(pa.array(groups.needed())).to_batches()

    def apply(batches):
        for table, groups in _whole_groups(batches, width):
            ends, gone = pa.array(groups.ends), table.column("gone").to_numpy()
            voided = (groups.barrier >= 0) & gone[np.maximum(groups.barrier, 0)]
            live = ~voided | np.logical_or.reduce([s > groups.barrier for s in groups.setter] or [np.zeros(len(voided), bool)])
            out = {"k": table.column("k").take(ends), "o1": table.column("o1").take(ends), "o2": table.column("o2").take(ends), "live": pa.array(live)}
            for i, s in enumerate(groups.setter):
                out[f"c{i}"] = table.column(f"c{i}").take(pa.array(s, mask=s < 0))
            yield from pa.table(out).combine_chunks().to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    result = ", ".join(f"{c} {kinds[c]}" for c in ("k", "o1", "o2")) + ", live boolean" + "".join(f", c{i} {kinds[f'c{i}']}" for i in range(width))
    local = in_arrow(log.sortWithinPartitions(*sequence), compact, schema)
    state = in_arrow(local.repartition("k").sortWithinPartitions(*sequence), apply, result)
    return state.toDF(key, *order, "live", *columns)
