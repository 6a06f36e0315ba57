"""Processing only new or changed records, with a persisted state of keys and content hashes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.runtime import BucketedTables, VersionLog, fingerprint, shuffle_partitions

#: So many segments are probed one after the other before a run merges them into one.
MAX_SEGMENTS = 8

#: What stands for a null key of types that 0 can't be cast to.
_ZERO = {"string": "''", "binary": "X''", "date": "DATE'1970-01-01'"}


class IncrementalProcessor:
    """Selects the records that are new or changed since the last successful run.

    The state is a list of segments ``(keys..., content)``, tables hash-bucketed by the keys, named by the current document of
    a version log. ``run`` hashes the current rows, merge-joins them with the segments where those lie, so only the rows
    move, writes what differs as a new segment and publishes it with one atomic rename. The segment *is* the run's output, so
    output and state change together.

    A run has an id, and every record comes out under exactly one: a run that dies before the rename leaves nothing behind and
    its records come out when it is repeated; after the rename, repeating the same id, or ``output``, reads the recorded
    segment again and processes nothing. Outputs are kept until ``acknowledge`` says that they were consumed; an acknowledged
    id that is run again is a new run. Of two runs at the same time the second to publish fails with a CommitConflict.

    Nulls: null keys are a key of their own, and null content equals null content only. Repeated rows: of a key's rows
    the one with the greatest ``order`` counts; on equal ``order``, the one with the greater hash. A null ``order`` comes
    before all others. Columns other than keys, content and order are ignored, whatever their names. An empty table is fine.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], order: str, content: list[str], buckets: int | None = None):
        self.spark, self.root, self.keys, self.order, self.content = spark, root, keys, order, content
        self.log = VersionLog(spark, root)
        self.buckets = self.log.current()[1].get("buckets") or buckets or shuffle_partitions(spark)

    def _plain(self, rows: DataFrame) -> list[Column]:
        """The keys without nulls, and a number whose bits say which were null: what is grouped by can then be joined with
        plain equality, on the same partitioning."""
        kinds = dict(rows.dtypes)
        plain = [F.coalesce(F.col(k), F.expr(_ZERO.get(kinds[k], f"cast(0 AS {kinds[k]})"))).alias(f"k{i}") for i, k in enumerate(self.keys)]
        nulls = [F.when(F.col(k).isNull(), 1 << i).otherwise(0) for i, k in enumerate(self.keys)]
        return [*plain, reduce(Column.__add__, nulls).alias("nulls")]

    @property
    def _plain_names(self) -> list[str]:
        return [*(f"k{i}" for i in range(len(self.keys))), "nulls"]

    def _tables(self, columns: str) -> BucketedTables:
        return BucketedTables(self.spark, self.root, columns, self._plain_names)

    def _segment(self, document: dict, name: str) -> DataFrame:
        return self._tables(document["columns"]).read(name, self.buckets)

    def named(self, plain: DataFrame) -> DataFrame:
        """Keys under their names, with their nulls, and the content hash."""
        keys = [F.when(F.col("nulls").bitwiseAND(1 << i) == 0, F.col(f"k{i}")).alias(k) for i, k in enumerate(self.keys)]
        return plain.select(*keys, "content")

    def hashed(self, rows: DataFrame) -> DataFrame:
        """One row per key with the content hash of its newest row."""
        order, content = F.col(self.order).alias("o"), fingerprint(*self.content).alias("h")
        newest = F.max(F.struct("o", "h"))
        return rows.select(*self._plain(rows), order, content).groupBy(*self._plain_names).agg(newest.alias("n")).select(*self._plain_names, F.col("n.h").alias("content"))

    def _state(self, document: dict) -> DataFrame | None:
        segments = document.get("segments", [])
        if not segments:
            return None
        if len(segments) == 1:
            return self._segment(document, segments[0])
        parts = [self._tables(document["columns"]).files(s).withColumn("at", F.lit(i)) for i, s in enumerate(segments)]
        last = F.max(F.struct("at", "content")).alias("n")
        return reduce(DataFrame.unionByName, parts).groupBy(*self._plain_names).agg(last).select(*self._plain_names, F.col("n.content").alias("content"))

    def state(self) -> DataFrame | None:
        """Keys and content hashes as of the last successful run."""
        state = self._state(self.log.current()[1])
        return None if state is None else self.named(state)

    def select(self, rows: DataFrame) -> DataFrame:
        """The keys of ``rows`` that the state lacks or holds with other content, and their hashes; keys in plain form. The
        newest segment that has a key tells its content."""
        document, now = self.log.current()[1], self.hashed(rows)
        if self.buckets != shuffle_partitions(self.spark):
            now = now.repartition(self.buckets, *self._plain_names)
        held = []
        for i, name in enumerate(reversed(document.get("segments", []))):
            past = self._segment(document, name).withColumnRenamed("content", f"was{i}")
            now, held = now.join(past.hint("merge"), self._plain_names, "left"), [*held, f"was{i}"]
        if not held:
            return now
        was = F.coalesce(*held)
        return now.where(was.isNull() | (was != F.col("content"))).select(*self._plain_names, "content")

    def run(self, rows: DataFrame, run_id: str | None = None) -> DataFrame:
        """Publish what is new or changed in ``rows`` under an id, by default a new one, and return it, one row per key."""
        number, document = self.log.current()
        run_id, outputs = run_id or uuid.uuid4().hex, document.get("outputs", {})
        if run_id in outputs:
            return self.output(run_id)
        segment, found = f"segment_{number + 1:012d}_{uuid.uuid4().hex}", self.select(rows)
        columns = document.get("columns") or ", ".join(f"{n} {t}" for n, t in found.dtypes)
        self._tables(columns).write(found, segment, self.buckets, grouped=True)
        segments = [*document.get("segments", []), segment]
        self.log.commit(number + 1, {"buckets": self.buckets, "columns": columns, "segments": segments, "outputs": outputs | {run_id: segment}})
        if len(segments) > MAX_SEGMENTS:
            self.compact()
        return self.output(run_id)

    def output(self, run_id: str) -> DataFrame:
        """What a successful run published, until it is acknowledged."""
        document = self.log.current()[1]
        if run_id not in document.get("outputs", {}):
            raise KeyError(f"no output of run {run_id} is kept")
        return self.named(self._segment(document, document["outputs"][run_id]))

    def acknowledge(self, run_id: str) -> None:
        """The output of this run was consumed and need not be kept. Doing it twice is fine."""
        number, document = self.log.current()
        if run_id in document.get("outputs", {}):
            self.log.commit(number + 1, document | {"outputs": {r: s for r, s in document["outputs"].items() if r != run_id}})

    def compact(self) -> None:
        """Merge the state's segments into one; the old files stay until ``vacuum``."""
        number, document = self.log.current()
        if len(document.get("segments", [])) > 1:
            merged = f"segment_{number + 1:012d}_{uuid.uuid4().hex}"
            self._tables(document["columns"]).write(self._state(document), merged, self.buckets, grouped=True)
            self.log.commit(number + 1, document | {"segments": [merged]})

    def vacuum(self) -> None:
        """Delete segments that neither the state nor an output that was not acknowledged names."""
        document = self.log.current()[1]
        keep = {*document.get("segments", []), *document.get("outputs", {}).values()}
        for name in self.log.files.names(self.root):
            if name.startswith("segment_") and name not in keep:
                self._tables("").drop(name)
