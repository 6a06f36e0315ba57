"""Operators of problems 1 to 5 against brute force on small dirty tables."""

import random

import pytest
from pyspark.sql import functions as F

from stratalog.functions.intervals import merged_ranges, within_ranges
from stratalog.operators.change_feed import events, replay
from stratalog.operators.delivery_dedup import Bloom, BloomChain, DeliveryLog, _screen, repeats, split_deliveries
from stratalog.operators.incremental import IncrementalProcessor
from stratalog.operators.key_ledger import KeyLedger
from stratalog.operators.tree_aggregate import distinct_versions, tree_levels
from stratalog.plans.pipeline_queries import p5_by_batch, succeeded_ranges
from stratalog.runtime import CommitConflict, VersionLog


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def dirty(seed, n=400):
    """(id, key, version, value): a third of one key, look-alike and null keys, repeats."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if r.random() < 0.34 else r.choice(["", " ", "Hot", "hot ", "é", "é", None, *map(str, range(20))])
        out.append((i, key, r.choice([None, *range(30)]), r.choice([None, "", "x", "y"])))
        if r.random() < 0.2 and out:
            j = r.randrange(len(out))
            out.append((i + 1000, *out[j][1:]))
    r.shuffle(out)
    return out


SCHEMA = "id long, key string, version long, value string"


def test_ranges(spark):
    ranges = spark.createDataFrame([("a", 1, 5), ("a", 4, 8), ("a", 9, 9), ("a", 20, 10), ("b", 3, 3), ("a", None, 7), ("a", 5000, 20000), ("a", 6000, 7000)], "g string, lo_ long, hi_ long")
    merged = merged_ranges(ranges, "g", "lo_", "hi_")
    assert got(merged) == [("a", 1, 9), ("a", 5000, 20000), ("b", 3, 3)]
    ids = spark.createDataFrame([("a", i) for i in (0, 1, 9, 10, 4999, 5000, 20000, 20001)] + [("b", 3), ("c", 3), ("a", None)], "g string, id long")
    assert got(within_ranges(ids, merged, "g", "id").where("covered")) == [("a", 1, True), ("a", 20000, True), ("a", 5000, True), ("a", 9, True), ("b", 3, True)]
    assert within_ranges(ids, merged, "g", "id").count() == 11 and within_ranges(ids, merged.where("false"), "g", "id").where("covered").count() == 0


def test_status_is_of_the_last_logged_row(spark):
    rows = [(1, "f", 1, 5, "running", 1), (1, "f", 1, 5, " SUCCEEDED ", 2), (2, "f", 7, 9, "succeeded", 1), (2, "f", 7, 9, "revoked", 3), (2, "f", 7, 9, "revoked", 3), (3, "f", 6, 6, None, 2)]
    df = spark.createDataFrame(rows, "run_id long, feed string, first_arrival long, last_arrival long, status string, t int").withColumn("logged_at", F.timestamp_seconds("t")).drop("t")
    assert got(succeeded_ranges(df)) == [("f", 1, 5)]


@pytest.mark.parametrize("seed", range(2))
def test_incremental(spark, root, seed):
    rows = dirty(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("content", F.lit("clash"))
    p = IncrementalProcessor(spark, root, ["key", "version"], "id", ["value"])

    def newest(data):
        best = {}
        for i, k, v, x in sorted(data, key=lambda r: r[0]):
            best[k, v] = x
        return best

    first = newest([r for r in rows if r[0] % 3 == 0])
    assert got(p.run(df.where("id % 3 = 0")).select("key", "version")) == sorted(first, key=repr)
    now = newest(rows)
    assert got(p.run(df).select("key", "version")) == sorted((k for k, v in now.items() if k not in first or first[k] != v), key=repr)
    assert p.run(df).count() == 0 and p.state().count() == len(now)
    p.compact()
    p.vacuum()
    assert p.run(df).count() == 0 and p.run(df.where("false")).count() == 0
    # a run that dies before the commit is as if it had not been
    changed = df.withColumn("value", F.concat(F.coalesce("value", F.lit("")), F.lit("!")))
    commit, p.log.commit = p.log.commit, lambda *_: (_ for _ in ()).throw(OSError("crash"))
    with pytest.raises(OSError):
        p.run(changed)
    p.log.commit = commit
    assert p.run(changed).count() == len(now) and p.run(changed).count() == 0
    for _ in range(9):
        p.run(df)
    assert len(p.log.current()[1]["segments"]) <= 8


def test_version_log_conflict(spark, root):
    log = VersionLog(spark, root)
    assert log.current() == (0, {})
    log.commit(1, {"a": "é"})
    with pytest.raises(CommitConflict):
        log.commit(1, {"a": 2})
    assert log.current() == (1, {"a": "é"})


@pytest.mark.parametrize("seed, fan_in, partitions", [(0, 2, 16), (1, 16, 4)])
def test_tree_aggregate(spark, seed, fan_in, partitions):
    rows = dirty(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("clash")).repartition(5)
    expected = {}
    for _, k, v, _ in rows:
        expected.setdefault(k, set()).add(v)
    out = [(k, len(vs - {None}), max(vs - {None}, default=None)) for k, vs in expected.items()]
    assert got(distinct_versions(df, "key", "version", fan_in, partitions)) == sorted(out, key=repr)
    assert got(distinct_versions(df.where("false"), "key", "version")) == []
    assert [tree_levels(n, 16) for n in (1, 16, 17, 256, 4096)] == [1, 1, 2, 2, 3]


@pytest.mark.parametrize("seed", range(3))
def test_change_feed_full_rows(spark, seed):
    r = random.Random(seed)
    puts = [(i, k, v, x) for i, k, v, x in dirty(seed)]
    base = [(r.choice(["hot", "1", "2", "q", None]), r.randrange(30), r.choice([None, "b"])) for _ in range(8)]
    base = list({b[0]: b for b in base}.values()) + base[:1] * 0
    changes = events(spark.createDataFrame(puts, SCHEMA).repartition(3), "key", ["version", "id"], ["value"], F.col("value").isNull())
    state = events(spark.createDataFrame(base + base[:1], "key string, version long, value string"), "key", ["version", F.lit(-1)], ["value"], F.col("value").isNull(), base=True)
    best = {}
    for v, i, k, x in [(v, -1, k, x) for k, v, x in base] + [(v, i, k, x) for i, k, v, x in puts]:
        if k not in best or best[k][0] < (-1 if v is None else v, i):
            best[k] = ((-1 if v is None else v, i), x)
    expected = sorted(((k, x) for k, (_, x) in best.items() if x is not None), key=repr)
    result = replay(changes, state, ["value"])
    assert got(result.where("live").select("key", "value")) == expected and result.count() == len(best)
    assert got(replay(changes.where("false"), state.where("false"), ["value"])) == []


@pytest.mark.parametrize("seed", range(4))
def test_change_feed_partial_columns(spark, seed):
    """Against a replay of one change after the other."""
    r = random.Random(seed)
    feed = [(r.choice("aab"), s, r.random() < 0.15, r.sample(["x", "y"], r.randrange(1, 3)), r.choice([None, s]), r.choice([None, -s])) for s in range(60)]
    base = [("a", 20, 7, 8), ("c", 1, 5, 6)]
    model = {}
    for k, s, x, y in base:
        model[k] = {"x": x, "y": y}
    applied = {k: s for k, s, *_ in base}
    for k, s, gone, sets, x, y in feed:
        if s <= applied.get(k, -1):
            continue
        if gone:
            model[k] = None
        else:
            model[k] = (model.get(k) or {}) | {c: v for c, v in (("x", x), ("y", y)) if c in sets}
    shuffled = feed + r.sample(feed, 20)
    r.shuffle(shuffled)
    changes = events(spark.createDataFrame(shuffled, "key string, s long, gone boolean, sets array<string>, x long, y long").repartition(4), "key", ["s", F.lit(0)], ["x", "y"], F.col("gone"), changed=F.col("sets"))
    state = events(spark.createDataFrame(base, "key string, s long, x long, y long"), "key", ["s", F.lit(0)], ["x", "y"], F.lit(False), base=True)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        result = got(replay(changes, state, ["x", "y"]).where("live").select("key", "x", "y"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert result == sorted((k, m.get("x"), m.get("y")) for k, m in model.items() if m is not None)


def test_key_ledger(spark, root):
    ledger = KeyLedger(spark, f"{root}/ledger", 3)
    ledger.seed(spark.createDataFrame([("a",), ("a",), (None,), ("",)], "key string"), "key")
    batch = [(1, "a"), (2, "b"), (3, "b"), (4, None), (5, ""), (6, " "), (7, "B"), (7, "B"), (None, "n"), (8, "n")]
    df = spark.createDataFrame(batch, "id long, key string").withColumn("first", F.lit("clash"))
    expected = sorted([(i, k, s) for (i, k), s in zip(batch, [True, False, True, False, True, False, False, False, False, True], strict=True)], key=repr)
    assert got(ledger.probe(df, "key", "id", "b1")) == expected
    assert got(ledger.probe(df, "key", "id", "b1")) == expected  # again, after a failure
    assert {s for _, k, s in got(ledger.probe(df, "key", "id", "b2")) if k} == {True}
    again = KeyLedger(spark, f"{root}/ledger")
    assert again.buckets == 3 and again.probe(df.where("false"), "key", "id", "b3").count() == 0
    for i in range(8):
        again.probe(spark.createDataFrame([(i, f"k{i}")], "id long, key string"), "key", "id", f"c{i}")
    assert again.keys().distinct().count() == again.keys().count() == 6 + 8
    with pytest.raises(ValueError):
        again.probe(df, "key", "id", "b1")


def test_ledger_is_not_shuffled(spark, root):
    ledger = KeyLedger(spark, f"{root}/plain", 4)
    ledger.seed(spark.range(100).selectExpr("cast(id AS string) AS key"), "key")
    known = ledger._segment(ledger.log.current()[1]["segments"][0]["name"])
    plan = spark.range(50).selectExpr("cast(id AS string) AS k").groupBy("k").count().join(known.hint("merge"), F.col("k") == F.col("key"), "left")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan


@pytest.mark.parametrize("seed, buckets", [(0, 32), (1, 1), (2, 7)])
def test_delivery_dedup(spark, seed, buckets):
    rows = dirty(seed) + [(5000 + i, "copied", 1, "x") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"a": F.lit("clash"), "h": F.lit(1), "_first": F.lit(2)}).repartition(6)
    first = {}
    for i, k, v, _ in rows:
        first[k, v] = min(i, first.get((k, v), i))
    kept = split_deliveries(df, "key", "version", "id", keep=True, time_buckets=buckets)
    assert sorted(r["id"] for r in kept.collect()) == sorted(first.values()) and kept.columns == df.columns
    gone = [(i, k, v) for i, k, v, _ in rows if i != first[k, v]]
    assert got(repeats(df, "key", "version", "id", buckets)) == sorted(gone, key=repr)
    dropped = split_deliveries(df, "key", "version", "id", keep=False, time_buckets=buckets)
    assert sorted(r["id"] for r in dropped.collect()) == sorted(i for i, k, v, _ in rows if i != first[k, v])
    assert split_deliveries(df.where("false"), "key", "version", "id", keep=True).count() == 0


def test_delivery_log(spark, root, monkeypatch):
    log, model, kept, n = DeliveryLog(spark, f"{root}/log", 3), set(), {}, 6
    monkeypatch.setattr("stratalog.operators.delivery_dedup.MAX_BUCKETS", 4)
    rows = dirty(5, 300)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"a": F.lit("clash"), "_first": F.lit(2)})
    for i in range(n):
        part = [r for r in rows if r[0] % n == i]
        out = log.accept(df.where(f"id % {n} = {i}"), "key", "version", "id", str(i))
        expected = {}
        for r in part:
            if r[1:3] not in model:
                expected[r[1:3]] = min(r[0], expected.get(r[1:3], r[0]))
        model |= set(expected)
        kept[i] = sorted(expected.values())
        assert sorted(r["id"] for r in out.collect()) == kept[i] and out.columns == df.columns
    assert sorted(r["id"] for r in log.accept(df.where("id % 6 = 5"), "key", "version", "id", "5").collect()) == kept[5]  # again
    with pytest.raises(ValueError):
        log.accept(df, "key", "version", "id", "0")
    log.vacuum()
    again = DeliveryLog(spark, f"{root}/log")
    assert again.partitions == 3 and again.accept(df, "key", "version", "id", "all").count() == 0 and again.accept(df.where("false"), "key", "version", "id", "none").count() == 0


def test_delivery_null_arrival_comes_first(spark):
    df = spark.createDataFrame([(None, "a", 1, "x"), (3, "a", 1, "x"), (3, "b", 1, "x"), (3, "b", 1, "x")], SCHEMA)
    assert [(r["id"], r["key"]) for r in split_deliveries(df, "key", "version", "id", keep=False).collect()] == [(3, "a")]


def test_bloom_has_no_false_negatives():
    import numpy as np

    r = np.random.default_rng(1)
    known, other = r.integers(0, 2**63, 20_000, dtype=np.uint64), r.integers(0, 2**63, 20_000, dtype=np.uint64)
    b, chain = Bloom(len(known)), BloomChain(3000)
    b.add(known)
    for i in range(0, len(known), 777):
        chain.add(known[i : i + 777])
    assert b.may_contain(known).all() and b.may_contain(other).mean() < 0.01
    assert chain.may_contain(known).all() and len(chain.filters) == 7 and chain.may_contain(other).mean() < 0.03
    assert not BloomChain(0).may_contain(other).any()


@pytest.mark.parametrize("shift", [0, -40])
def test_by_batch_takes_null_zero_and_negative_arrivals(spark, tmp_path, shift):
    rows = [(None, "a", 1), (-7, "b", 1), (0, "c", 1), (1, "a", 1), (2, "b", 1), (10, "d", 2), (20, "c", 1), (25, "e", None), (30, "d", 2), (30, "f", 3)]
    rows = [(None if d is None else d + shift, k, v) for d, k, v in rows]
    spark.createDataFrame(rows, "delivery_id long, key string, version long").write.parquet(f"{tmp_path}/versioned_keys.parquet")
    first = {}
    for d, k, v in rows:
        a = -(2**63) if d is None else d
        first[k, v] = min(first.get((k, v), a), a)
    assert got(p5_by_batch(spark, str(tmp_path))) == sorted([(None if a == -(2**63) else a,) for a in first.values()], key=repr)


def test_outlier_in_arrival_and_small_batches(spark):
    """One arrival far off moves no border, and groups that batches cut come out whole."""
    rows = [(i if i else 2**60, f"k{i % 37}", i % 5) for i in range(3000)] + [(7, "hot", 1)] * 50 + [(i, "hot", 1) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, key string, version long").repartition(3)
    first = {}
    for i, k, v in rows:
        first[k, v] = min(i, first.get((k, v), i))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert got(repeats(df, "key", "version", "id")) == sorted([(i, k, v) for i, k, v in rows if i != first[k, v]], key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_screen_holds_filters_only(monkeypatch):
    """Ten times the rows in a partition are screened in the same memory but for the filters."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    def batches(n):
        for at in range(0, n, 5000):
            i = np.arange(at, at + 5000, dtype=np.int64)
            s = ((i * 4 // n) << 57) | (i << 20)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array([f"key{x}" for x in i]), pa.array(i), pa.array(np.zeros(5000, np.int32)), pa.array(i), pa.array(np.ones(5000, np.int64))], ["s", "k", "v", "nulls", "a", "m"])

    def peak(n):
        tracemalloc.start()
        rows = sum(b.num_rows for b in _screen(n // 4)(batches(n)))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return rows, most - n * 12 // 8

    peak(5000)
    (a, small), (b, large) = peak(20_000), peak(200_000)
    assert (a, b) == (20_000, 200_000) and large < 1.3 * small + 100_000


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "decimal(20,0)", "int"])
def test_kinds_of_arrival(spark, kind):
    to = {"timestamp": "timestamp_micros(i)", "timestamp_ntz": "cast(timestamp_micros(i) AS timestamp_ntz)", "date": "date_from_unix_date(cast(i AS int))"}.get(kind, f"cast(i AS {kind})")
    df = spark.createDataFrame([(3, "a", 1), (1, "a", 1), (2, "b", None), (5, None, 1), (None, "b", None)], "i long, key string, version int").selectExpr(f"{to} AS at", "key", "version", "i")
    want = [(r["at"], r["key"], r["version"]) for r in df.where("i IN (2, 3)").collect()]
    assert got(repeats(df, "key", "version", "at")) == sorted(want, key=repr)
    assert sorted(r["i"] for r in split_deliveries(df, "key", "version", "at", keep=False).collect()) == [2, 3]
    with pytest.raises(ValueError):
        repeats(df.withColumn("at", F.lit(1.5)), "key", "version", "at")


def test_delivery_log_takes_more_partitions(spark, root, monkeypatch):
    monkeypatch.setattr("stratalog.operators.delivery_dedup.MAX_BUCKETS", 2)
    monkeypatch.setattr("stratalog.operators.delivery_dedup.PARTITION_ROWS", 20)
    log, seen = DeliveryLog(spark, f"{root}/log", 2), 0
    for i in range(4):
        batch = spark.range(i * 15, i * 15 + 30).selectExpr("id", "concat('k', id) AS key", "1 AS version")
        assert sorted(r["id"] for r in log.accept(batch, "key", "version", "id", str(i)).collect()) == list(range(seen, i * 15 + 30))
        seen = i * 15 + 30
    assert log.partitions > 2 and DeliveryLog(spark, f"{root}/log").partitions == log.partitions
    log.vacuum()
    assert log.accept(batch, "key", "version", "id", "again").count() == 0


def test_incremental_run_ids(spark, root):
    """Every record comes out under exactly one id, whether the process dies before or after the commit."""
    df = spark.createDataFrame([(i, f"k{i}", 1, "x") for i in range(20)] + [(50, None, None, None)], SCHEMA)
    make = lambda: IncrementalProcessor(spark, root, ["key", "version"], "id", ["value"])
    p = make()
    commit, p.log.commit = p.log.commit, lambda *_: (_ for _ in ()).throw(OSError("killed before the commit"))
    with pytest.raises(OSError):
        p.run(df, "one")
    with pytest.raises(KeyError):
        make().output("one")
    p.log.commit = lambda *a: (commit(*a), (_ for _ in ()).throw(OSError("killed after the commit")))
    with pytest.raises(OSError):
        p.run(df, "one")
    again = make()
    more = df.unionByName(spark.createDataFrame([(60, "new", 1, "y")], SCHEMA))
    assert got(again.run(more, "one").select("key")) == got(df.select("key")) and got(again.run(more, "two").select("key")) == [("new",)]
    for i in range(10):
        again.run(df, f"empty{i}")
    again.vacuum()
    assert got(make().output("one").select("key")) == got(df.select("key")) and make().run(more).count() == 0
    again.acknowledge("one")
    again.acknowledge("one")
    again.vacuum()
    with pytest.raises(KeyError):
        make().output("one")
    assert make().run(more, "one").count() == 0 and make().output("two").count() == 1


def test_incremental_state_is_not_shuffled(spark, root):
    df = spark.createDataFrame([(i, f"k{i}", 1, "x") for i in range(50)], SCHEMA)
    p = IncrementalProcessor(spark, root, ["key", "version"], "id", ["value"])
    p.run(df, "a")
    p.run(df.withColumn("value", F.lit("z")), "b")
    plan = p.select(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 2
    q = IncrementalProcessor(spark, f"{root}/other", ["key", "version"], "id", ["value"], buckets=3)
    assert q.run(df).count() == 50 and q.run(df).count() == 0 and IncrementalProcessor(spark, f"{root}/other", ["key", "version"], "id", ["value"]).buckets == 3


def test_ledger_vacuum_and_rebucketing(spark, root, monkeypatch):
    from stratalog.runtime import SharedFiles

    ledger = KeyLedger(spark, f"{root}/ledger", 2)
    for i in range(12):
        ledger.probe(spark.createDataFrame([(i, f"k{i}"), (i, "always")], "id long, key string"), "key", "id", f"b{i}")
    assert "'b0'" not in str(ledger.log.current()[1])
    ledger.vacuum()
    names = [n for n in SharedFiles(spark).names(f"{root}/ledger") if n.startswith("ledger_")]
    assert len(names) == len(ledger.log.current()[1]["segments"])
    with pytest.raises(ValueError):
        ledger.probe(spark.createDataFrame([(1, "x")], "id long, key string"), "key", "id", "b0")
    monkeypatch.setattr("stratalog.operators.key_ledger.BUCKET_KEYS", 2)
    ledger.compact()
    again = KeyLedger(spark, f"{root}/ledger")
    assert ledger.buckets == again.buckets == 8 and again.keys().count() == 13
    assert [r["seen"] for r in again.probe(spark.createDataFrame([(1, "k3"), (2, "q")], "id long, key string"), "key", "id", "z").orderBy("id").collect()] == [True, False]


def test_bucketed_tables_live_in_an_own_database(spark, root):
    from stratalog.runtime import database

    KeyLedger(spark, f"{root}/own").seed(spark.createDataFrame([("a",)], "key string"), "key")
    assert not [t for t in spark.catalog.listTables("default") if not t.isTemporary] and spark.catalog.listTables(database(spark))


def test_broadcast_is_bounded_by_bytes(spark):
    from stratalog.runtime import is_small

    df = spark.createDataFrame([("x" * 1000, [1, 2])] * 10, "key string, more array<int>")
    assert is_small(df, 10, 20_000) and not is_small(df, 10, 9_000) and not is_small(df, 9, 20_000) and is_small(df.where("false"), 0, 0)
