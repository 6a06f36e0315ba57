"""Dense versions in input order, without a single task that sees all rows."""

from __future__ import annotations

from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stratalog.runtime import AT_ONCE, FOOTERS, footer_rows, shuffle_partitions, written


def assign_versions(rows: DataFrame, order: list[str], first: int = 1, into: str = "version", observation: Observation | None = None, measures: list[Column] = ()) -> DataFrame:
    """Number the rows first, first + 1, ... in the order of ``order``; rows that tie there are numbered in the order of all
    their columns, and equal rows arbitrarily, which can't be told apart.

    The rows are range-partitioned and written once; only the row count of each file, which its footer has, goes to the
    driver, which adds them up. ``observation`` gets ``measures`` of the rows in the same pass. Nulls sort first. An empty
    table stays empty. A column named ``into`` is replaced.
    """
    rows = rows.drop(into)
    keys = order + [c for c, t in rows.dtypes if c not in order and not t.startswith(("map", "variant"))]
    spark = rows.sparkSession
    spread = rows.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    spread = spread.observe(observation, *measures) if observation is not None else spread
    placed = written(spread.withColumn("_id", F.monotonically_increasing_id()), "placed")
    counts = _rows_of_parts(placed)
    starts, total = {}, first
    for p in sorted(counts):
        starts[p], total = total, total + counts[p]
    if not starts:
        return placed.drop("_id").withColumn(into, F.lit(None).cast("long"))
    bases = F.array(*[F.lit(starts.get(p, 0)) for p in range(max(starts) + 1)])  # a constant of one number per partition
    return placed.withColumn(into, F.element_at(bases, F.expr("cast(shiftright(_id, 33) as int) + 1")) + F.expr("_id & 8589934591")).drop("_id")


def _rows_of_parts(placed: DataFrame) -> Counter[int]:
    """Rows of each partition of a written table, from the footers: its files have the partition's number in their names."""
    files, counts = [unquote(f) for f in placed.inputFiles()], Counter()
    if len(files) <= FOOTERS:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            found = list(zip(files, pool.map(lambda f: footer_rows(placed.sparkSession, f), files), strict=True))
    else:  # no column but the file's name is asked for, so the readers open only the footers
        rows = placed.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n"))
        found = [(r["f"], r["n"]) for r in rows.toLocalIterator()]
    for name, n in found:
        counts[int(name.rpartition("/")[2].split("-")[1])] += n
    return counts
