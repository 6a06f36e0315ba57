"""Packing items of varying size into containers of fixed capacity."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.runtime import broadcast_if_small, in_arrow, written

#: Containers that a partition keeps open while it goes through its items.
OPEN = 64
#: Partitions whose leftovers are merged in one task of a round.
FAN_IN = 16


class OpenWindows:
    """Best fit with a bounded number of open containers."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self._room: list[tuple[int, int]] = []  # (room, container), ascending

    def place(self, size: int, new: int) -> int:
        """The open container with the least room that holds ``size``; ``new`` is opened if there is none, and the
        fullest one is given up when too many are open."""
        at = bisect_left(self._room, (size, -1))
        if at < len(self._room):
            room, container = self._room.pop(at)
        else:
            if len(self._room) >= self.most:
                self._room.pop(0)
            room, container = self.capacity, new
        if room > size:
            insort(self._room, (room - size, container))
        return container

    def open(self) -> list[tuple[int, int]]:
        """(container, tokens in it) of those still open."""
        return [(c, self.capacity - r) for r, c in self._room]


def pack(items: DataFrame, id: str, size: str, capacity: int, most_open: int = OPEN) -> DataFrame:
    """``(id, piece, tokens, container)``: where each item goes.

    Each partition packs its items in order of arrival by best fit with ``most_open`` open containers and gives up the
    fullest when it needs another. What is open at the end of the partitions are the leftovers: rounds of merges, each
    taking the leftovers of at most 16 partitions into one task, put them together. No item is shuffled, only leftovers.

    An item over capacity is cut into full pieces, each a container of its own, and a rest that is packed like any
    item; ``piece`` counts from 0. An item of size 0 or null needs no place and gives no row; negative sizes are
    taken as 0. Repeated ids are items of their own; ids may be null. Other columns are ignored. Which container an item gets
    depends on how the items are partitioned, for a small input so on the number of cores; what fits where does not.
    """
    spark = items.sparkSession
    id_type = dict(items.dtypes)[id]

    def run(batches):
        from pyspark import TaskContext

        windows, new = OpenWindows(capacity, most_open), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, sizes = batch.column(0), batch.column(1).to_pylist()
            take, pieces, tokens, containers = [], [], [], []
            for i, n in enumerate(sizes):
                piece, n = 0, n or 0
                while n > 0:
                    part = min(n, capacity)
                    new += 1
                    take.append(i)
                    pieces.append(piece)
                    tokens.append(part)
                    containers.append(new if part == capacity else windows.place(part, new))
                    n -= part
                    piece += 1
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(take, pa.int64())), pa.array(pieces, pa.int32()), pa.array(tokens, pa.int64()), pa.array(containers, pa.int64()), pa.array([False] * len(take))],
                ["id", "piece", "tokens", "container", "open"],
            )
        left = windows.open()
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(left), batch_type), pa.nulls(len(left), pa.int32()), pa.array([n for _, n in left], pa.int64()), pa.array([c for c, _ in left], pa.int64()), pa.array([True] * len(left))],
            ["id", "piece", "tokens", "container", "open"],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    rows = items.select(F.col(id).alias("id"), F.col(size).cast("long").alias("n"))
    batch_type = to_arrow_type(rows.schema["id"].dataType)
    placed = written(in_arrow(rows, run, f"id {id_type}, piece int, tokens long, container long, open boolean"), "placed")
    result = placed.where("not open").drop("open")
    left = placed.where("open").select("container", "tokens")
    moves = None
    while (n := left.count()) > 1:
        parts = -(-n // (most_open * FAN_IN))
        # a round leaves at most most_open containers open in each partition, a FAN_IN-th of what it got
        merged = written(_merge(left, parts, capacity, most_open if parts > 1 else n), "merged")
        step = merged.select(F.col("container").alias("from"), F.col("target").alias("to"))
        moves = step if moves is None else (
            moves.join(step.toDF("to", "then"), "to", "left").select("from", F.coalesce("then", "to").alias("to"))
        )
        if parts == 1:
            break
        left = merged.groupBy("target").agg(F.sum("tokens").alias("tokens"), F.max("open").alias("open")).where("open").select(F.col("target").alias("container"), "tokens")
    if moves is not None:
        moved = broadcast_if_small(moves.where("`from` != `to`"))
        result = result.join(moved, F.col("container") == F.col("from"), "left").withColumn("container", F.coalesce("to", "container")).drop("from", "to")
    return result.select(F.col("id").alias(id), "piece", "tokens", "container")


def _merge(left: DataFrame, parts: int, capacity: int, most: int) -> DataFrame:
    """One round: each partition puts its leftovers together, the largest first."""

    def run(batches):
        windows, rows = OpenWindows(capacity, most), []
        for batch in batches:
            for c, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append((c, n, windows.place(n, c)))
        still = {c for c, _ in windows.open()}
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[2] in still for r in rows], pa.bool_())],
            ["container", "tokens", "target", "open"],
        )

    spread = left.repartition(parts, "container").sortWithinPartitions(F.desc("tokens"), "container")
    return in_arrow(spread, run, "container long, tokens long, target long, open boolean")
