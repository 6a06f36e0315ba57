"""Queries p6 to p8 over the whole table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.encode import decoded, token_counts, token_ids
from stratalog.llm.packing import pack
from stratalog.llm.pii import find, redact, trained
from stratalog.runtime import written

#: Tokens of a container.
CAPACITY = 512
#: Bound of the lists of given names and brands that the detector takes.
MOST_NAMES = 10_000


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(_documents(spark, d))


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every text decoded from its ids; null texts come back empty."""
    return decoded(token_ids(_documents(spark, d)))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return pack(token_counts(_documents(spark, d)), "doc_id", "n_tokens", CAPACITY)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d).where("piece = 1").select("doc_id")


def p7_placed(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, tokens in them, and the least number that could hold them."""
    per = written(_placed(spark, d).groupBy("container").agg(F.sum("tokens").alias("tokens")), "containers")
    return per.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.ceil(F.sum("tokens") / CAPACITY).alias("bound"))


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must not be: containers over capacity, tokens that lie nowhere or more than once, texts cut without need, and more
    open containers left than one; the number of containers is at most twice the least possible one."""
    counts, placed = token_counts(_documents(spark, d)), written(_placed(spark, d), "placed")
    per_text = placed.groupBy("doc_id").agg(F.sum("tokens").alias("placed"), F.count("*").alias("pieces"))
    texts = counts.join(per_text, "doc_id", "left").agg(
        F.count(F.when(F.coalesce("placed", F.lit(0)) != F.col("n_tokens"), 1)).alias("misplaced"), F.count(F.when(F.col("pieces") > F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / CAPACITY)), 1)).alias("cut"), F.sum("n_tokens").alias("tokens"),
    )
    per = placed.groupBy("container").agg(F.sum("tokens").alias("tokens"))
    containers = per.agg(F.count("*").alias("containers"), F.count(F.when(F.col("tokens") > CAPACITY, 1)).alias("overfull"), F.count(F.when(F.col("tokens") * 2 <= CAPACITY, 1)).alias("half_empty"))
    n = containers.first()  # one row of counts
    bound = F.lit(n["containers"]) > 2 * F.ceil(F.coalesce("tokens", F.lit(0)) / CAPACITY)
    return texts.select("misplaced", "cut", F.lit(n["overfull"]).alias("overfull"), F.lit(n["half_empty"] > 1).alias("wasteful"), bound.alias("beyond_bound"))


def _names(spark: SparkSession, d: str, table: str, column: str) -> tuple[str, ...]:
    """A short fixed list; a longer one than MOST_NAMES is refused rather than gathered."""
    names = [r[0] for r in spark.read.parquet(f"{d}/{table}.parquet").select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_NAMES + 1).collect()]
    if len(names) > MOST_NAMES:
        raise ValueError(f"{table}.{column} is no short list")
    return tuple(sorted(names))


def _detector(spark: SparkSession, d: str):
    return trained(_names(spark, d, "given_names", "given_name"), _names(spark, d, "items", "brand"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find(_documents(spark, d), _detector(spark, d))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact(_documents(spark, d), _detector(spark, d))


QUERIES = {"p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip, "p7_found": p7_found, "p7_placed": p7_placed, "p7_fill": p7_fill, "p7_invariants": p7_invariants, "p8_found": p8_found, "p8_redacted": p8_redacted}
SQL = {
    "p6_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_invariants": "SELECT 0::BIGINT AS misplaced, 0::BIGINT AS cut, 0::BIGINT AS overfull, false AS wasteful, false AS beyond_bound",
}
