"""Per-key results when a few keys hold most rows: a tree of partial states with bounded fan-in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.runtime import in_arrow, shuffle_partitions

#: Partial states that one node of the tree merges at most.
FAN_IN = 16
#: Rows that are combined locally before anything is sent.
CHUNK_ROWS = 65_536


def tree_levels(partitions: int, fan_in: int = FAN_IN) -> int:
    """Least number of rounds whose leaves are at least as many as the partitions."""
    levels = 1
    while fan_in**levels < partitions:
        levels += 1
    return levels


def combine_chunks(rows: DataFrame, keys: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Distinct ``keys`` of each run of ``chunk_rows`` consecutive rows of a partition; nothing is shuffled."""
    import pyarrow as pa

    schema = rows.select(*keys).schema

    def combine(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= chunk_rows:
                yield from pa.Table.from_batches(held).group_by(keys).aggregate([]).to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).group_by(keys).aggregate([]).to_batches()

    return in_arrow(rows.select(*keys), combine, schema)


def distinct_versions(rows: DataFrame, key: str, version: str, fan_in: int = FAN_IN, partitions: int | None = None) -> DataFrame:
    """Per key the number of distinct versions and the newest: ``(key, n_versions, newest)``.

    Fixed-size chunks of the input are combined where they lie. The distinct pairs then go to the leaves of a tree, a
    leaf being a hash bucket of the version, so even a key with a third of all rows is spread over all leaves and each
    pair is counted once. Every further round merges at most ``fan_in`` states of a key into one, until one is left.

    Nulls: a null key is a key of its own; a null version is not counted, and a key with nothing but null versions has
    0 and null. Repeated rows count once. An empty table gives no rows. Other columns are ignored.
    """
    levels = tree_levels(partitions or shuffle_partitions(rows.sparkSession), fan_in)
    named = rows.select(F.col(key).alias("k"), F.col(version).alias("v"))
    leaf = F.pmod(F.xxhash64("v"), F.lit(fan_in**levels)).cast("int")
    pairs = combine_chunks(named, ["k", "v"]).withColumn("node", leaf)
    # the exchange on (k, node) serves both the distinct and the first count
    state = (
        pairs.repartition("k", "node").groupBy("k", "node", "v").agg(F.lit(1).alias("one"))
        .groupBy("k", "node").agg(F.count("v").alias("n"), F.max("v").alias("m"))
    )
    for _ in range(levels):
        state = (
            state.withColumn("node", F.expr(f"node div {fan_in}"))
            .groupBy("k", "node").agg(F.sum("n").alias("n"), F.max("m").alias("m"))
        )
    return state.select(F.col("k").alias(key), F.col("n").alias("n_versions"), F.col("m").alias("newest"))
