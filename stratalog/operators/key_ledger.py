"""Exact answers to "has this key been seen before?" from a bucketed ledger on disk."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.runtime import BucketedTables, NameSet, VersionLog, shuffle_partitions

#: So many segments are probed one after the other before they are merged.
MAX_SEGMENTS = 8
#: Keys of a bucket beyond which a merge doubles the number of buckets.
BUCKET_KEYS = 16_000_000


class KeyLedger:
    """All keys ever seen, hash-partitioned and sorted on disk; no key is held in memory and no answer is wrong.

    Each segment is a bucketed table, so the sort-merge join of a batch with the ledger moves only the batch's distinct
    keys: the ledger is read bucket by bucket where it lies. ``probe`` answers a batch and appends its new keys as one
    segment, published by an atomic rename. A batch is known by an id; probing the same id again, say after a failure,
    ignores what that id had appended and gives the same answers, until the batch is merged with older ones. Merges take
    more buckets when those have grown, and ``vacuum`` deletes what they replaced.

    Nulls: a record with a null key was never seen, and null is not recorded. A null arrival comes before all others
    (it counts as the first). Records of the same key and arrival are the same record, so neither has seen the other.
    Keys are compared byte by byte. An empty batch or ledger is fine.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root = spark, root
        self.log, self._names = VersionLog(spark, root), NameSet(spark, root)
        self._tables = BucketedTables(spark, root, "key STRING, first BIGINT", ["key"])
        self.buckets = self.log.current()[1].get("buckets") or buckets or shuffle_partitions(spark)

    def _write(self, keys: DataFrame, grouped: bool = True) -> str:
        """Write distinct keys ``(key, first)`` as a segment."""
        return self._tables.write(keys, f"ledger_{uuid.uuid4().hex}", self.buckets, grouped)

    def _segment(self, name: str) -> DataFrame:
        return self._tables.read(name, self.buckets)

    def _publish(self, number: int, segments: list[dict], merged: str | None) -> None:
        self.log.commit(number + 1, {"buckets": self.buckets, "segments": segments, "merged": merged})

    def seed(self, rows: DataFrame, key: str, batch: str = "seed") -> None:
        """Record the distinct keys of earlier data."""
        number, document = self.log.current()
        if any(s["batch"] == batch for s in document.get("segments", [])) or self._names.has(document.get("merged"), batch):
            return
        keys = rows.select(F.col(key).alias("key")).where("key is not null").distinct().withColumn("first", F.lit(None).cast("long"))
        self._publish(number, document.get("segments", []) + [{"batch": batch, "name": self._write(keys)}], document.get("merged"))

    def probe(self, batch: DataFrame, key: str, arrival: str, batch_id: str) -> DataFrame:
        """``(arrival, key, seen)`` for each record of the batch, under the names given."""
        number, document = self.log.current()
        if self._names.has(document.get("merged"), batch_id):
            raise ValueError(f"batch {batch_id} is merged into the ledger and can't be probed again")
        segments = [s for s in document.get("segments", []) if s["batch"] != batch_id]
        rows = batch.select(F.col(arrival).alias("first"), F.col(key).alias("key"))
        # the record of rank 1 by arrival within its key; a null arrival ranks first
        rank_one = F.when(F.count(F.when(F.col("first").isNull(), 1)) > 0, None).otherwise(F.min("first"))
        new = rows.where("key is not null").groupBy("key").agg(rank_one.alias("first"))
        for s in segments:
            known = self._segment(s["name"]).select(F.col("key").alias("_known"))
            new = new.join(known.hint("merge"), F.col("key") == F.col("_known"), "left").where("_known is null").drop("_known")
        added = self._write(new)
        segments = segments + [{"batch": batch_id, "name": added}]
        self._publish(number, segments, document.get("merged"))
        answers = self._answers(rows, self._segment(added), key, arrival)
        if len(segments) > MAX_SEGMENTS:
            self.compact(keep=added)
        return answers

    @staticmethod
    def _answers(rows: DataFrame, added: DataFrame, key: str, arrival: str) -> DataFrame:
        """A record is unseen exactly when it is the first one of a key that was appended. The join is on the record, not
        on the key, so a key with a third of the batch does not meet in one task."""
        firsts = added.select(F.col("key").alias("_k"), F.col("first").alias("_f"))
        on = F.col("first").eqNullSafe(F.col("_f")) & (F.col("key") == F.col("_k"))
        seen = F.col("key").isNotNull() & F.col("_k").isNull()
        return rows.join(firsts, on, "left").select(F.col("first").alias(arrival), F.col("key").alias(key), seen.alias("seen"))

    def compact(self, keep: str | None = None) -> None:
        """Merge all segments but ``keep`` into one, bucket by bucket; with buckets that have grown too large, all segments
        into twice as many or more."""
        number, document = self.log.current()
        segments = document.get("segments", [])
        rows = sum(self._segment(s["name"]).count() for s in segments)  # from the footers
        buckets = self.buckets
        while rows > buckets * BUCKET_KEYS:
            buckets *= 2
        if buckets != self.buckets:
            self.rebucket(buckets)
            return
        old = [s for s in segments if s["name"] != keep]
        if old:
            merged = {"batch": None, "name": self._write(self._union(old), grouped=False)}
            self._publish(number, [merged] + [s for s in segments if s["name"] == keep], self._merged(document, old))

    def rebucket(self, buckets: int) -> None:
        """Write the whole ledger as one segment of another number of buckets."""
        number, document = self.log.current()
        old = document.get("segments", [])
        union = self._union(old)
        before, self.buckets = self.buckets, buckets
        try:
            merged = [{"batch": None, "name": self._write(union, grouped=False)}] if old else []
            self._publish(number, merged, self._merged(document, old))
        except BaseException:
            self.buckets = before
            raise

    def _union(self, segments: list[dict]) -> DataFrame:
        union = self.spark.createDataFrame([], "key string, first bigint")
        for s in segments:
            union = union.unionByName(self._tables.files(s["name"]))
        return union.select("key", F.lit(None).cast("long").alias("first"))

    def _merged(self, document: dict, segments: list[dict]) -> str | None:
        return self._names.with_added(document.get("merged"), [s["batch"] for s in segments if s["batch"] is not None])

    def keys(self) -> DataFrame:
        return self._union(self.log.current()[1].get("segments", [])).select("key")

    def vacuum(self) -> None:
        """Delete segments and lists of merged batches that the current document does not name; answers not yet evaluated that
        read them fail."""
        document = self.log.current()[1]
        keep = {s["name"] for s in document.get("segments", [])} | {document.get("merged")}
        for name in self.log.files.names(self.root):
            if name.startswith(("ledger_", "names_")) and name not in keep:
                self._tables.drop(name)
