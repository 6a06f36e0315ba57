"""Reads of a change log as it was at a version.

All take and return DataFrames. Of the records of a key up to the version, the one with the greatest version counts; a
tombstone there hides the key, and only there, so it is dropped after the choice. One partial and one final aggregate do
that, so a key with a third of all records is a few rows per partition before the shuffle. Of records with equal key and
version the newer run wins (lower level, then greater seq) when ``runs`` says that the log has those columns, then the
greater (tombstone, value): the result never depends on the order of rows.

Nulls: a record with a null key is no record and is left out; a null version is older than all others and at no version
but now visible; a null tombstone counts as false. An empty log gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.runtime import BROADCAST_BYTES, BROADCAST_ROWS, is_small


def _tombstone() -> Column:
    return F.coalesce(F.col("tombstone"), F.lit(False))


def record(runs: bool = False) -> Column:
    """A struct of which the maximum is the record that counts."""
    source = [(-F.col("level")).alias("near"), F.col("seq")] if runs else []
    return F.struct("version", *source, _tombstone().alias("tombstone"), "value")


def visible(log: DataFrame, version: int | None = None, lower: str | None = None, upper: str | None = None) -> DataFrame:
    """Records up to a version with lower <= key < upper, bounds optional; all of it reaches the Parquet reader."""
    rows = log.where("key is not null")
    if version is not None:
        rows = rows.where(F.col("version") <= version)
    if lower is not None:
        rows = rows.where(F.col("key") >= lower)
    if upper is not None:
        rows = rows.where(F.col("key") < upper)
    return rows


def newest(rows: DataFrame, runs: bool = False) -> DataFrame:
    """The record that counts of each key, tombstones included: ``(key, version, tombstone, value)``."""
    return rows.groupBy("key").agg(F.max(record(runs)).alias("r")).select("key", "r.version", "r.tombstone", "r.value")


def scan(log: DataFrame, lower: str | None = None, upper: str | None = None, version: int | None = None, runs: bool = False) -> DataFrame:
    """``(key, value)`` of the live keys in [lower, upper) at a version, by default all of them now. Unordered: add
    ``orderBy("key")`` (bytes of UTF-8), with a limit if only the first rows matter."""
    return newest(visible(log, version, lower, upper), runs).where(~F.col("tombstone")).select("key", "value")


def get(log: DataFrame, key: str, version: int | None = None, runs: bool = False) -> DataFrame:
    """``(key, value)`` of one key, no row if it is absent or deleted."""
    return newest(visible(log, version).where(F.col("key") == key), runs).where(~F.col("tombstone")).select("key", "value")


def multi_get(log: DataFrame, keys: DataFrame, key: str = "key", version: int | None = None, runs: bool = False, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(key, value)`` of those of ``keys`` that are live. Up to ``most`` distinct keys of ``most_bytes`` together, both counted,
    are broadcast and filter the log before it is aggregated; more are joined with the aggregate, which has one row per key."""
    wanted = keys.select(F.col(key).alias("key")).where("key is not null").distinct()
    if is_small(wanted, most, most_bytes):
        return scan(log.join(F.broadcast(wanted), "key", "left_semi"), version=version, runs=runs)
    return scan(log, version=version, runs=runs).join(wanted, "key", "left_semi")


def history(log: DataFrame, key: str, runs: bool = False) -> DataFrame:
    """``(version, tombstone, value)`` of all writes of a key, newest first, each version once."""
    rows = deduplicated(log.where(F.col("key") == key), runs)
    return rows.select("version", "tombstone", "value").orderBy(F.desc("version"))


def deduplicated(rows: DataFrame, runs: bool = False) -> DataFrame:
    """Each (key, version) once; the hash is over both, so a hot key's versions are spread."""
    return rows.where("key is not null").groupBy("key", "version").agg(F.max(record(runs)).alias("r")).select("key", "version", "r.tombstone", "r.value")


def diff(log: DataFrame, before: int, after: int | None = None, runs: bool = False) -> DataFrame:
    """``(key, before, after)`` of keys whose value differs between two versions; null means absent. One pass and one
    shuffle: both states are aggregated side by side."""
    r = record(runs)
    then = F.max(F.when(F.col("version") <= before, r)).alias("b")
    both = visible(log, after).groupBy("key").agg(then, F.max(r).alias("a"))
    value = lambda c: F.when(~F.col(f"{c}.tombstone"), F.col(f"{c}.value"))
    return both.select("key", value("b").alias("before"), value("a").alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))


def counters(log: DataFrame) -> DataFrame:
    """One row: distinct keys, records, tombstones, UTF-8 bytes of keys and values, greatest version."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    per_key = log.where("key is not null").groupBy("key").agg(
        F.count("*").alias("n"), F.sum(_tombstone().cast("long")).alias("t"), F.sum(size).alias("b"), F.max("version").alias("v")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per_key.agg(F.count("*").alias("entries"), total("n").alias("versions"), total("t").alias("tombstones"), total("b").alias("bytes"), F.max("v").alias("max_version"))
