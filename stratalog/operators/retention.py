"""Which versions a merge of runs keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.reads import deduplicated, record
from stratalog.schema import NEWEST


def retain(log: DataFrame, watermark: int = NEWEST, bottom: bool = False, runs: bool = False) -> DataFrame:
    """``(key, version, tombstone, value)``: what readers at the watermark or later can still see.

    Kept are all versions above the watermark, and of each key the newest one at or below it. With ``bottom``, when no
    deeper level exists, that one is dropped too if it is a tombstone. Each (key, version) comes out once, the newer
    run's. Versions above the watermark are grouped by key and version and the rest by key with partial aggregates, so
    no task gets the whole history of a hot key.

    A null version lies at or below every watermark. Null keys are left out. An empty log gives no rows.
    """
    rows = log.where("key is not null")
    floor = rows if watermark >= NEWEST else rows.where(F.col("version").isNull() | (F.col("version") <= watermark))
    floor = floor.groupBy("key").agg(F.max(record(runs)).alias("r")).select("key", "r.version", "r.tombstone", "r.value")
    if bottom:
        floor = floor.where(~F.col("tombstone"))
    if watermark >= NEWEST:  # no version lies above
        return floor
    return deduplicated(rows.where(F.col("version") > watermark), runs).unionByName(floor)
