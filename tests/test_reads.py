import random

import pytest

from stratalog.operators import reads
from stratalog.operators.retention import retain
from stratalog.operators.versions import assign_versions
from stratalog.schema import CHANGE_LOG, NEWEST


def log(spark, rows):
    """(key, version, value or None for a delete)."""
    return spark.createDataFrame([(k, v, x is None, x) for k, v, x in rows], CHANGE_LOG)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_newest_record_counts_and_tombstone_hides(spark):
    df = log(spark, [("a", 1, "x"), ("a", 2, None), ("b", 3, "y"), ("b", 4, ""), ("", 5, "empty key")])
    assert sorted(rows(reads.scan(df))) == [("", "empty key"), ("b", "")]
    assert sorted(rows(reads.scan(df, version=1))) == [("a", "x")]
    assert rows(reads.get(df, "a")) == []
    assert rows(reads.get(df, "a", 1)) == [("a", "x")]


def test_half_open_and_inverted_ranges(spark):
    df = log(spark, [(f"key_{i:03d}", i + 1, f"v{i}") for i in range(20)])
    assert [k for k, _ in sorted(rows(reads.scan(df, "key_005", "key_008")))] == ["key_005", "key_006", "key_007"]
    assert rows(reads.scan(df, "key_008", "key_005")) == rows(reads.scan(df, "key_005", "key_005")) == []


def test_order_is_by_utf8_bytes(spark):
    keys = ["z", "", "\U0001f680", "é", "A", "鍵"]
    df = log(spark, [(k, i, "x") for i, k in enumerate(keys)])
    assert [k for k, _ in rows(reads.scan(df).orderBy("key"))] == sorted(keys, key=str.encode)


def test_nulls_ties_and_extra_columns(spark):
    data = [(None, 1, False, "x"), ("a", None, False, "old"), ("a", 1, None, "new"), ("b", 2, False, "p"), ("b", 2, False, "q"), ("b", 2, False, "q")]
    df = spark.createDataFrame(data, CHANGE_LOG).selectExpr("*", "'w' AS level", "1 AS r", "2 AS near")
    assert sorted(rows(reads.scan(df))) == [("a", "new"), ("b", "q")]
    assert rows(reads.scan(df, version=0)) == []
    assert rows(reads.counters(df))[0][:3] == (2, 5, 0)
    empty = spark.createDataFrame([], CHANGE_LOG)
    assert rows(reads.scan(empty)) == rows(reads.history(empty, "a")) == rows(reads.diff(empty, 0)) == rows(retain(empty)) == []
    assert rows(reads.counters(empty)) == [(0, 0, 0, 0, None)]


def test_newer_run_wins(spark):
    data = [("k", 30, False, "L1", 1, 9), ("k", 30, False, "L0 old", 0, 1), ("k", 30, False, "L0 new", 0, 2)]
    df = spark.createDataFrame(data, "key string, version long, tombstone boolean, value string, level int, seq long")
    assert rows(reads.scan(df, runs=True)) == [("k", "L0 new")]
    assert rows(reads.deduplicated(df, runs=True)) == [("k", 30, False, "L0 new")]


@pytest.mark.parametrize("most", [0, 100])
def test_multi_get_both_ways(spark, most):
    df = log(spark, [("a", 1, "x"), ("b", 2, "y"), ("c", 3, None)])
    keys = spark.createDataFrame([("a",), ("a",), ("c",), (None,), ("zz",)], "key string")
    assert rows(reads.multi_get(df, keys, most=most)) == [("a", "x")]


def test_history_and_diff(spark):
    df = log(spark, [("a", 1, "x"), ("a", 3, None), ("a", 2, "y"), ("b", 2, "same"), ("c", 3, "new")])
    assert rows(reads.history(df, "a")) == [(3, True, None), (2, False, "y"), (1, False, "x")]
    assert sorted(rows(reads.diff(df, 2))) == [("a", "y", None), ("c", None, "new")]
    assert sorted(rows(reads.diff(df, 1, 2))) == [("a", "x", "y"), ("b", None, "same")]


CASES = [
    ([30, 20, 10], NEWEST, True, [30]), ([40, 30, 20, 10], 15, True, [40, 30, 20, 10]), ([30, 20, 10], 25, True, [30, 20]), ([30, 20, 10], 20, True, [30, 20]),
    ([50, 40, 30, 20, 10], 45, True, [50, 40]), ([30, 20, 10], 1, True, [30, 20, 10]), ([-30, 10], 5, True, [-30, 10]), ([-30, 10], NEWEST, True, []), ([-30], NEWEST, False, [-30]),
]


@pytest.mark.parametrize("versions, watermark, bottom, kept", CASES)
def test_retention_cases(spark, versions, watermark, bottom, kept):
    """A negative number is a delete at that version."""
    df = log(spark, [("k", abs(v), None if v < 0 else "x") for v in versions])
    got = sorted(((-1 if t else 1) * v for _, v, t, _ in rows(retain(df, watermark, bottom))), key=abs, reverse=True)
    assert got == kept


def test_retention_two_keys_and_two_runs(spark):
    df = log(spark, [("a", 40, "x"), ("a", 10, "x"), ("b", 35, "x"), ("b", 5, "x")])
    assert retain(df, 20, True).count() == 4
    two = spark.createDataFrame([("k", 30, False, "old", 0, 1), ("k", 30, False, "new", 0, 2)], "key string, version long, tombstone boolean, value string, level int, seq long")
    assert rows(retain(two, 1, True, runs=True)) == [("k", 30, False, "new")]


@pytest.mark.parametrize("seed", range(3))
def test_retention_changes_no_visible_answer(spark, seed):
    r = random.Random(seed)
    data, v = [], 0
    for _ in range(30):
        v += r.randrange(1, 4)
        data.append((r.choice("abc"), v, None if r.random() < 0.2 else str(v)))
    df, watermark = log(spark, data), r.randrange(1, v)
    kept = retain(df, watermark, True).cache()
    for at in range(watermark, v + 1, 5):
        assert sorted(rows(reads.scan(df, version=at))) == sorted(rows(reads.scan(kept, version=at)))


def test_assign_versions(spark):
    df = spark.createDataFrame([(9, "c"), (1, "a"), (5, "b"), (5, "a"), (None, "n")], "at int, key string").withColumn("version", __import__("pyspark").sql.functions.lit("clash"))
    assert sorted((r["version"], r["at"], r["key"]) for r in assign_versions(df, ["at"], 100).collect()) == [(100, None, "n"), (101, 1, "a"), (102, 5, "a"), (103, 5, "b"), (104, 9, "c")]
    assert assign_versions(df.where("false"), ["at"]).count() == 0


def test_version_and_key_predicates_reach_the_scan(spark, tmp_path):
    log(spark, [("a", 1, "x")]).write.parquet(f"{tmp_path}/log")
    plan = reads.get(spark.read.parquet(f"{tmp_path}/log"), "a", 5)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,a)" in plan and "LessThanOrEqual(version,5)" in plan
