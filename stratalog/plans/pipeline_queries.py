"""Queries p1 to p5 over the whole store tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.intervals import merged_ranges, within_ranges
from stratalog.operators.change_feed import events, replay
from stratalog.operators.delivery_dedup import DeliveryLog, repeats, split_deliveries
from stratalog.operators.incremental import IncrementalProcessor
from stratalog.operators.key_ledger import KeyLedger
from stratalog.operators.tree_aggregate import distinct_versions
from stratalog.plans.tables import table
from stratalog.runtime import fresh_path, written

#: A key is hot from this part of all distinct (key, version) pairs.
HOT_SHARE = 100


def succeeded_ranges(sync_runs: DataFrame) -> DataFrame:
    """``(feed, lo, hi)``: the arrivals that succeeded runs have read, disjoint.

    A run's status is that of its row logged last; a null ``logged_at`` comes before all others.
    """
    status = F.lower(F.trim("status"))
    last = F.max(F.struct("logged_at", status.alias("status"), "feed", "first_arrival", "last_arrival")).alias("_l")
    runs = sync_runs.groupBy("run_id").agg(last).select("_l.*").where("status = 'succeeded'")
    return merged_ranges(runs, "feed", "first_arrival", "last_arrival")


def _feeds(spark: SparkSession, d: str) -> DataFrame:
    versioned = table(spark, d, "versioned_keys").select(F.lit("versioned_keys").alias("feed"), "key", "version", F.col("delivery_id").alias("arrival"), "value")
    return versioned.unionByName(table(spark, d, "written").select(F.lit("written").alias("feed"), "key", "version", F.col("arrival_no").alias("arrival"), "value"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    processor = IncrementalProcessor(spark, fresh_path(spark, "incremental"), ["feed", "key", "version"], "arrival", ["value"])
    rows = _feeds(spark, d)
    ranges = written(succeeded_ranges(table(spark, d, "sync_runs")), "ranges")
    processor.run(within_ranges(rows, ranges, "feed", "arrival").where("covered"))
    return processor.run(rows).select("feed", "key", "version")


def p1_rerun(spark: SparkSession, d: str) -> DataFrame:
    """A run that is repeated after it was published gives its records again, and leaves none for another run."""
    processor = IncrementalProcessor(spark, fresh_path(spark, "incremental"), ["feed", "key", "version"], "arrival", ["value"])
    rows = _feeds(spark, d)
    ranges = written(succeeded_ranges(table(spark, d, "sync_runs")), "ranges")
    processor.run(within_ranges(rows, ranges, "feed", "arrival").where("covered"), "past")
    processor.run(rows, "now")
    again, later = processor.run(rows, "now"), processor.run(rows, "later").count()
    return again.select("feed", "key", "version", F.lit(later).alias("later"))


def p1_state_size(spark: SparkSession, d: str) -> DataFrame:
    """Records that the state knows after a run over everything, by feed."""
    processor = IncrementalProcessor(spark, fresh_path(spark, "incremental"), ["feed", "key", "version"], "arrival", ["value"])
    processor.run(_feeds(spark, d))
    return processor.state().groupBy("feed").agg(F.count("*").alias("records"))


def _per_key(spark: SparkSession, d: str) -> DataFrame:
    return distinct_versions(table(spark, d, "versioned_keys"), "key", "version")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    per_key = written(_per_key(spark, d), "per-key")
    pairs = per_key.agg(F.sum("n_versions")).first()[0] or 0
    return per_key.where(F.col("n_versions") * HOT_SHARE >= pairs).select("key")


def p2_per_key(spark: SparkSession, d: str) -> DataFrame:
    return _per_key(spark, d)


def _state(spark: SparkSession, d: str) -> DataFrame:
    puts, base = table(spark, d, "written"), table(spark, d, "entries")
    changes = events(puts, "key", ["version", "arrival_no"], ["value"], F.col("value").isNull())
    state = events(base, "key", ["version", F.lit(-1)], ["value"], F.col("tombstone") | F.col("value").isNull(), base=True)
    return replay(changes, state, ["value"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).where("live").select("key", "version")


def p3_current(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).where("live").select("key", "value")


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    ledger = KeyLedger(spark, fresh_path(spark, "ledger"))
    ledger.seed(table(spark, d, "versioned_keys"), "key")
    return ledger.probe(table(spark, d, "incoming"), "key", "incoming_id", "incoming")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d).where("seen").select("incoming_id")


def p4_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d).select("incoming_id", "seen")


def p4_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """Wrong answers of the ledger, counted by recomputing each answer from all records."""
    said = _verdicts(spark, d)
    old = table(spark, d, "versioned_keys").select("key").where("key is not null").distinct().withColumn("old", F.lit(True))
    firsts = table(spark, d, "incoming").where("key is not null").groupBy("key").agg(F.min("incoming_id").alias("first")).join(old, "key", "left")
    truth = said.join(firsts, "key", "left").withColumn("true_seen", F.coalesce(F.col("old") | (F.col("incoming_id") > F.col("first")), F.col("incoming_id") > F.col("first"), F.lit(False)))
    wrong = F.count(F.when(F.col("seen") != F.col("true_seen"), 1))
    return truth.agg(F.count("*").alias("records"), F.count(F.when(F.col("seen"), 1)).alias("seen"), wrong.alias("wrong"), (wrong / F.count("*")).alias("wrong_rate"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats(table(spark, d, "versioned_keys"), "key", "version", "delivery_id").select("delivery_id")


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    kept = split_deliveries(table(spark, d, "versioned_keys"), "key", "version", "delivery_id", keep=True)
    return kept.select("delivery_id", "key", "version", "tombstone", "value")


def p5_by_batch(spark: SparkSession, d: str) -> DataFrame:
    """The rows kept when the table comes in three batches, by order of arrival; null arrivals are in the first."""
    rows = table(spark, d, "versioned_keys").select("delivery_id", "key", "version")
    last = rows.agg(F.max("delivery_id")).first()[0] or 0
    log, kept = DeliveryLog(spark, fresh_path(spark, "deliveries")), None
    for i in range(3):
        until = F.col("delivery_id") <= last * (i + 1) // 3
        batch = rows.where(until & (F.col("delivery_id") > last * i // 3) if i else until | F.col("delivery_id").isNull())
        accepted = log.accept(batch, "key", "version", "delivery_id", f"batch-{i}").select("delivery_id")
        kept = accepted if kept is None else kept.unionByName(accepted)
    return kept


QUERIES = {
    "p1_found": p1_found, "p1_rerun": p1_rerun, "p1_state_size": p1_state_size, "p2_found": p2_found, "p2_per_key": p2_per_key, "p3_found": p3_found, "p3_current": p3_current,
    "p4_found": p4_found, "p4_verdicts": p4_verdicts, "p4_error_rate": p4_error_rate, "p5_found": p5_found, "p5_kept": p5_kept, "p5_by_batch": p5_by_batch,
}

_FEEDS = """
    SELECT 'versioned_keys' AS feed, key, version, delivery_id AS arrival, value FROM versioned_keys
    UNION ALL SELECT 'written', key, version, arrival_no, value FROM written"""
_COUNTS = """
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC, arrival DESC) AS rn FROM (
      SELECT key, version, arrival_no AS arrival, value FROM written
      UNION ALL SELECT key, version, -1, value FROM entries)"""
_SEEN = """
    SELECT i.incoming_id, i.key IS NOT NULL AND (o.key IS NOT NULL OR i.incoming_id > f.first) AS seen
    FROM incoming i LEFT JOIN (SELECT DISTINCT key FROM versioned_keys) o ON i.key = o.key
    LEFT JOIN (SELECT key, min(incoming_id) AS first FROM incoming GROUP BY key) f ON i.key = f.key"""
_UNPROCESSED = f"""
    WITH feeds AS ({_FEEDS}),
    runs1 AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY logged_at DESC) AS rn FROM sync_runs),
    ok AS (SELECT feed, first_arrival, last_arrival FROM runs1 WHERE rn = 1 AND lower(trim(status)) = 'succeeded'),
    ids AS (SELECT DISTINCT feed, unnest(range(first_arrival, last_arrival + 1)) AS arrival FROM ok),
    flagged AS (SELECT f.*, i.arrival IS NOT NULL AS done FROM feeds f LEFT JOIN ids i ON f.feed = i.feed AND f.arrival = i.arrival),
    newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feed, key, version ORDER BY arrival DESC) AS rn FROM flagged) WHERE rn = 1),
    past AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feed, key, version ORDER BY arrival DESC) AS rn FROM flagged WHERE done) WHERE rn = 1)
    SELECT n.feed, n.key, n.version FROM newest n LEFT JOIN past p
    ON n.feed = p.feed AND n.key IS NOT DISTINCT FROM p.key AND n.version IS NOT DISTINCT FROM p.version
    WHERE p.feed IS NULL OR n.value IS DISTINCT FROM p.value"""
SQL = {
    "p1_found": _UNPROCESSED,
    "p1_rerun": f"SELECT *, 0::BIGINT AS later FROM ({_UNPROCESSED})",
    "p1_state_size": f"SELECT feed, count(*) AS records FROM (SELECT DISTINCT feed, key, version FROM ({_FEEDS})) GROUP BY feed",
    "p2_found": """
    WITH n AS (SELECT key, count(DISTINCT version) AS n FROM versioned_keys GROUP BY key)
    SELECT key FROM n WHERE n * 100 >= (SELECT sum(n) FROM n)""",
    "p2_per_key": "SELECT key, count(DISTINCT version) AS n_versions, max(version) AS newest FROM versioned_keys GROUP BY key",
    "p3_found": f"SELECT key, version FROM ({_COUNTS}) WHERE rn = 1 AND value IS NOT NULL",
    "p3_current": f"SELECT key, value FROM ({_COUNTS}) WHERE rn = 1 AND value IS NOT NULL",
    "p4_found": f"SELECT incoming_id FROM ({_SEEN}) WHERE seen",
    "p4_verdicts": f"SELECT incoming_id, coalesce(seen, false) AS seen FROM ({_SEEN})",
    "p4_error_rate": f"SELECT count(*) AS records, count(*) FILTER (WHERE seen) AS seen, 0::BIGINT AS wrong, 0::DOUBLE AS wrong_rate FROM ({_SEEN})",
    "p5_found": """
    SELECT delivery_id FROM (SELECT delivery_id, min(delivery_id) OVER (PARTITION BY key, version) AS first FROM versioned_keys)
    WHERE delivery_id > first""",
    "p5_by_batch": """
    SELECT delivery_id FROM (SELECT delivery_id, min(delivery_id) OVER (PARTITION BY key, version) AS first FROM versioned_keys)
    WHERE delivery_id = first""",
    "p5_kept": """
    SELECT delivery_id, key, version, tombstone, value FROM (SELECT *, min(delivery_id) OVER (PARTITION BY key, version) AS first FROM versioned_keys)
    WHERE delivery_id = first""",
}
