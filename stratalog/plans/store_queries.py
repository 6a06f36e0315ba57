"""Queries for the store's own operators over whole tables, and their SQL."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.net.session import Session
from stratalog.operators import reads
from stratalog.operators.retention import retain
from stratalog.operators.versions import assign_versions
from stratalog.plans.tables import table
from stratalog.runtime import fresh_path, written
from stratalog.sources.runs import metadata, read_runs, write_runs
from stratalog.sources.wal import Durability
from stratalog.store import Store
from stratalog.streaming.ingest import ingest

#: Change logs of the driver's tables: key, version, tombstone, value.
LOGS = {
    "events": "SELECT concat('user_', lpad(cast(user_id AS {s}), 6, '0')) AS key, event_id + 1 AS version, event_type = 'error' AS tombstone, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value FROM {t}",
    "orders": "SELECT concat('cust_', lpad(cast(o_custkey AS {s}), 7, '0')) AS key, o_orderkey + 1 AS version, o_orderstatus = 'P' AS tombstone, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS value FROM {t}",
    "documents": "SELECT left(text, 8) AS key, doc_id + 1 AS version, coalesce(n_chars % 5 = 0, false) AS tombstone, CASE WHEN n_chars % 5 = 0 THEN NULL ELSE concat(source, '/', lang) END AS value FROM {t}",
    "versioned_keys": "SELECT key, version, tombstone, value, level, seq FROM {t}",
}


def _log(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.sql(LOGS[name].format(t="{rows}", s="string"), rows=table(spark, d, name))


def _at(log: DataFrame, tenths: int = 7) -> int:
    """A version some way into the log's history."""
    return (log.agg(F.max("version")).first()[0] or 0) * tenths // 10


def full_scan_now(spark, d):
    return reads.scan(_log(spark, d, "events"))


def full_scan_as_of(spark, d):
    log = _log(spark, d, "events")
    return reads.scan(log, version=_at(log))


def store_scan_now(spark, d):
    return reads.scan(_log(spark, d, "versioned_keys"), runs=True)


def store_scan_as_of(spark, d):
    log = _log(spark, d, "versioned_keys")
    return reads.scan(log, version=_at(log, 5), runs=True)


def point_get_now(spark, d):
    return reads.get(_log(spark, d, "versioned_keys"), "größe_L", runs=True)


def point_get_as_of(spark, d):
    log = _log(spark, d, "versioned_keys")
    return reads.get(log, "größe_L", _at(log), runs=True)


def point_get_deleted(spark, d):
    """Keys whose newest record is a tombstone: none of them can be got."""
    log = _log(spark, d, "events")
    dead = reads.newest(log).where("tombstone").select("key")
    found = reads.multi_get(log, dead).select("key", F.lit(1).alias("one"))
    return dead.join(found, "key", "left").agg(F.count("*").alias("deleted"), F.count("one").alias("found"))


def point_get_missing(spark, d):
    return reads.get(_log(spark, d, "events"), "no such key").agg(F.count("*").alias("found"))


def multi_get(spark, d):
    keys = table(spark, d, "incoming").select("key")
    return reads.multi_get(_log(spark, d, "versioned_keys"), keys, runs=True)


def range_scan_half_open(spark, d):
    return reads.scan(_log(spark, d, "orders"), "cust_0000100", "cust_0000900")


def range_scan_open_lower(spark, d):
    return reads.scan(_log(spark, d, "orders"), None, "cust_0000500")


def range_scan_open_upper(spark, d):
    return reads.scan(_log(spark, d, "versioned_keys"), "sess/", None, runs=True)


def range_scan_inverted_count(spark, d):
    return reads.scan(_log(spark, d, "events"), "user_000090", "user_000010").agg(F.count("*").alias("rows"))


def scan_first_rows(spark, d):
    """The first rows of a scan, the store's early stop."""
    return reads.scan(_log(spark, d, "versioned_keys"), runs=True).orderBy("key").limit(100)


def key_history(spark, d):
    return reads.history(_log(spark, d, "versioned_keys"), "größe_L", runs=True)


def counters(spark, d):
    return reads.counters(_log(spark, d, "versioned_keys"))


def live_key_count(spark, d):
    return reads.scan(_log(spark, d, "orders")).agg(F.count("*").alias("live"))


def snapshot_diff(spark, d):
    log = _log(spark, d, "events")
    return reads.diff(log, _at(log, 3), _at(log, 7))


def merge_runs_dedup(spark, d):
    return reads.deduplicated(_log(spark, d, "versioned_keys"), runs=True)


def unicode_keys_scan(spark, d):
    return reads.scan(_log(spark, d, "documents"), "a", "é")


def retain_no_snapshot(spark, d):
    return retain(_log(spark, d, "events"))


def retain_watermark(spark, d):
    log = _log(spark, d, "versioned_keys")
    return retain(log, _at(log, 5), runs=True)


def reclaim_tombstones_bottom(spark, d):
    log = _log(spark, d, "events")
    return retain(log, _at(log, 5), bottom=True)


def reclaim_tombstones_not_bottom(spark, d):
    log = _log(spark, d, "events")
    return retain(log, _at(log, 5))


def compaction_invariance(spark, d):
    """What a compacted log shows at a version above the watermark."""
    log = _log(spark, d, "versioned_keys")
    return reads.scan(retain(log, _at(log, 5), bottom=True, runs=True), version=_at(log, 8))


def assign_versions_query(spark, d):
    rows = table(spark, d, "written").select("arrival_no", "key")
    return assign_versions(rows, ["arrival_no"])


def run_metadata(spark, d):
    return metadata(_log(spark, d, "versioned_keys"), ["level", "seq"])


def run_round_trip(spark, d):
    """A log written as sorted runs and read back."""
    root = fresh_path(spark, "store")
    log = _log(spark, d, "versioned_keys").select("key", "version", "tombstone", "value")
    runs = write_runs(spark, root, log, 0, 1, parts=4)
    return read_runs(spark, root, runs).select("key", "version", "tombstone", "value")


@contextmanager
def _store(spark: SparkSession, **options):
    """A store in a folder of its own."""
    with Store(spark, fresh_path(spark, "store"), **options) as store:
        yield store


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d, "events").select("key", F.when(~F.col("tombstone"), F.col("value")).alias("value"), F.col("version").alias("at"))


def flush_reopen_scan(spark, d):
    """Two bulk writes, a reopening and a full compaction; then everything that is live."""
    rows = _events(spark, d)
    half = _at(rows.withColumnRenamed("at", "version"), 5)
    with _store(spark) as store:
        store.write_frame(rows.where(F.col("at") <= half), ["at"])
        root = store.root
    with Store(spark, root) as store:
        store.write_frame(rows.where(F.col("at") > half), ["at"])
        store.compact_all()
        return written(store.scan(), "scan")


def bulk_as_of_scan(spark, d):
    """A bulk write read at an earlier version."""
    with _store(spark) as store:
        last = store.write_frame(_events(spark, d), ["at"])
        return written(store.scan(at=last * 7 // 10), "scan")


def stream_ingest_scan(spark, d):
    """Events through a stream into a store, then scanned."""
    source = fresh_path(spark, "stream-source")
    _events(spark, d).repartitionByRange(4, "at").write.parquet(source)
    stream = spark.readStream.schema("key string, value string, at bigint").option("maxFilesPerTrigger", 100).parquet(source)
    with _store(spark) as store:
        ingest(stream, store, ["at"], "events", fresh_path(spark, "stream-state")).awaitTermination()
        return written(store.scan(), "scan")


#: A conversation with the store: what is sent and what comes back.
TRANSCRIPT = [
    ("PUT name ada", "OK"), ("GET name", "VALUE ada"), ("GET absent", "NIL"), ("put greeting hello there world", "OK"), ("get greeting", "VALUE hello there world"), ("SNAPSHOT", "OK 2"),
    ("SNAPSHOT", "ERR snapshot already open at version 2"), ("DEL name", "OK"), ("GET name", "VALUE ada"), ("RELEASE", "OK"), ("RELEASE", "ERR no snapshot open"), ("GET name", "NIL"),
    ("SCAN", "ROW greeting hello there world\nEND"), ("SCAN - a", "END"), ("PING", "PONG"), ("WHAT", "ERR unknown command: WHAT"), ("GET", "ERR usage: GET <key>"), ("PUT a", "ERR usage: PUT <key> <value>"), ("QUIT", "OK"),
]


def protocol_transcript(spark, d):
    with _store(spark, durability=Durability.SYNC) as store:
        session = Session(store)
        replies = [(i, line, "\n".join(session.execute(line).lines)) for i, (line, _) in enumerate(TRANSCRIPT)]
        session.close()
    return spark.createDataFrame(replies, "step int, command string, reply string")


def as_of_join_orders(spark, d):
    """A snapshot joined and aggregated like any table."""
    log = _log(spark, d, "orders")
    live = reads.scan(log, version=_at(log))
    customers = table(spark, d, "customer").select(F.concat(F.lit("cust_"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("key"), "c_mktsegment")
    return live.join(customers, "key").groupBy("c_mktsegment", "value").agg(F.count("*").alias("customers"))


QUERIES = {
    f.__name__.removesuffix("_query"): f
    for f in (
        full_scan_now, full_scan_as_of, store_scan_now, store_scan_as_of, point_get_now, point_get_as_of, point_get_deleted, point_get_missing, multi_get, range_scan_half_open, range_scan_open_lower, range_scan_open_upper,
        range_scan_inverted_count, scan_first_rows, key_history, counters, live_key_count, snapshot_diff, merge_runs_dedup, unicode_keys_scan, retain_no_snapshot, retain_watermark, reclaim_tombstones_bottom,
        reclaim_tombstones_not_bottom, compaction_invariance, assign_versions_query, run_metadata, run_round_trip, flush_reopen_scan, bulk_as_of_scan, stream_ingest_scan, protocol_transcript, as_of_join_orders,
    )
}


def _sql_log(name: str) -> str:
    return LOGS[name].format(t=name, s="varchar")


def _sql_newest(name: str, where: str = "true", runs: bool = False) -> str:
    order = "version DESC" + (", level, seq DESC" if runs else "")
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {order}) AS rn FROM ({_sql_log(name)}) WHERE key IS NOT NULL AND {where}) WHERE rn = 1"


def _sql_scan(name: str, where: str = "true", runs: bool = False) -> str:
    return f"SELECT key, value FROM ({_sql_newest(name, where, runs)}) WHERE NOT tombstone"


def _sql_at(name: str, tenths: int) -> str:
    return f"(SELECT max(version) * {tenths} // 10 FROM ({_sql_log(name)}))"


def _sql_retain(name: str, tenths: int, bottom: bool) -> str:
    at = _sql_at(name, tenths)
    return f"""SELECT key, version, tombstone, value FROM (SELECT *, row_number() OVER (PARTITION BY key, version <= {at} ORDER BY version DESC) AS rn
      FROM (SELECT DISTINCT key, version, tombstone, value FROM ({_sql_log(name)}) WHERE key IS NOT NULL)) WHERE (version > {at} OR rn = 1) {f"AND NOT (version <= {at} AND tombstone)" if bottom else ""}"""


_BYTES = "octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0)"
_K = "versioned_keys"
SQL = {
    "full_scan_now": _sql_scan("events"),
    "full_scan_as_of": _sql_scan("events", f"version <= {_sql_at('events', 7)}"),
    "store_scan_now": _sql_scan(_K, runs=True),
    "store_scan_as_of": _sql_scan(_K, f"version <= {_sql_at(_K, 5)}", True),
    "point_get_now": _sql_scan(_K, "key = 'größe_L'", True),
    "point_get_as_of": _sql_scan(_K, f"key = 'größe_L' AND version <= {_sql_at(_K, 7)}", True),
    "point_get_deleted": f"SELECT count(*) AS deleted, 0::BIGINT AS found FROM ({_sql_newest('events')}) WHERE tombstone",
    "point_get_missing": "SELECT 0::BIGINT AS found",
    "multi_get": _sql_scan(_K, "key IN (SELECT key FROM incoming WHERE key IS NOT NULL)", True),
    "range_scan_half_open": _sql_scan("orders", "key >= 'cust_0000100' AND key < 'cust_0000900'"),
    "range_scan_open_lower": _sql_scan("orders", "key < 'cust_0000500'"),
    "range_scan_open_upper": _sql_scan(_K, "key >= 'sess/'", True),
    "range_scan_inverted_count": 'SELECT 0::BIGINT AS "rows"',
    "scan_first_rows": f"SELECT * FROM ({_sql_scan(_K, runs=True)}) ORDER BY key LIMIT 100",
    "key_history": f"SELECT DISTINCT version, tombstone, value FROM ({_sql_log(_K)}) WHERE key = 'größe_L'",
    "counters": f"""SELECT count(DISTINCT key) AS entries, count(*) AS versions, count(*) FILTER (WHERE tombstone) AS tombstones, sum({_BYTES})::BIGINT AS bytes, max(version) AS max_version
      FROM ({_sql_log(_K)}) WHERE key IS NOT NULL""",
    "live_key_count": f"SELECT count(*) AS live FROM ({_sql_scan('orders')})",
    "snapshot_diff": f"""SELECT coalesce(b.key, a.key) AS key, b.value AS before, a.value AS after FROM ({_sql_scan('events', f"version <= {_sql_at('events', 3)}")}) b
      FULL JOIN ({_sql_scan('events', f"version <= {_sql_at('events', 7)}")}) a ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value""",
    "merge_runs_dedup": f"""SELECT key, version, tombstone, value FROM (SELECT *, row_number() OVER (PARTITION BY key, version ORDER BY level, seq DESC) AS rn
      FROM ({_sql_log(_K)}) WHERE key IS NOT NULL) WHERE rn = 1""",
    "unicode_keys_scan": _sql_scan("documents", "key >= 'a' AND key < 'é'"),
    "retain_no_snapshot": f"SELECT key, version, tombstone, value FROM ({_sql_newest('events')})",
    "retain_watermark": _sql_retain(_K, 5, False),
    "reclaim_tombstones_bottom": _sql_retain("events", 5, True),
    "reclaim_tombstones_not_bottom": _sql_retain("events", 5, False),
    "compaction_invariance": _sql_scan(_K, f"version <= {_sql_at(_K, 8)}", True),
    "assign_versions": "SELECT arrival_no, key, row_number() OVER (ORDER BY arrival_no) AS version FROM written",
    "run_metadata": f"""SELECT level, seq, min(key) AS min_key, max(key) AS max_key, count(*) AS entry_count, min(version) AS min_version, max(version) AS max_version, sum({_BYTES})::BIGINT AS size_bytes
      FROM versioned_keys GROUP BY level, seq""",
    "run_round_trip": "SELECT key, version, tombstone, value FROM versioned_keys",
    "flush_reopen_scan": _sql_scan("events"),
    "bulk_as_of_scan": _sql_scan("events", f"version <= {_sql_at('events', 7)}"),
    "stream_ingest_scan": _sql_scan("events"),
    "protocol_transcript": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', '{r}')" for i, (c, r) in enumerate(TRANSCRIPT)) + ") t(step, command, reply)",
    "as_of_join_orders": f"""SELECT c_mktsegment, value, count(*) AS customers FROM ({_sql_scan('orders', f"version <= {_sql_at('orders', 7)}")}) o
      JOIN customer ON key = concat('cust_', lpad(cast(c_custkey AS varchar), 7, '0')) GROUP BY c_mktsegment, value""",
}
