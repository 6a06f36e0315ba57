"""Shared folder, written tables, atomic version logs and size-checked broadcasts."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted to have at most so many rows and bytes; beyond, the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


#: Up to so many files the driver reads the footers itself, this many at a time; beyond, a Spark job does.
FOOTERS, AT_ONCE = 256, 8


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read and write.

    It is what the cluster names in ``spark.checkpoint.dir``. Only in local mode, where all executors are threads of
    one process, an unset folder is replaced by a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master.startswith("local") and not master.startswith("local-cluster"):
        base = "file://" + tempfile.mkdtemp(prefix="stratalog-")
        spark.conf.set("spark.checkpoint.dir", base)
        return base
    raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stratalog/{spark.sparkContext.applicationId}"


_CLEANED: set[str] = set()


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path for intermediate data; it is deleted when the application ends in order, or by ``clean``."""
    folder = _own_folder(spark)
    if folder not in _CLEANED:
        _CLEANED.add(folder)
        atexit.register(_clean_at_exit, spark)
    return f"{folder}/{what}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete all intermediate data of this application and its catalog entries; results that still read them can't be
    evaluated afterwards."""
    spark.sql(f"DROP DATABASE IF EXISTS {database(spark)} CASCADE")
    SharedFiles(spark).delete(_own_folder(spark))


def database(spark: SparkSession) -> str:
    """Name of this application's own database, which holds the entries of bucketed tables."""
    return "stratalog_" + "".join(c if c.isalnum() else "_" for c in spark.sparkContext.applicationId).lower()


class BucketedTables:
    """Tables hash-bucketed by some columns under a folder, so that joins and aggregates on them move nothing.

    The files are what lasts. The catalog entry of a table, in this application's own database, is made when it is first
    read and can be made again at any time; ``drop`` removes both.
    """

    def __init__(self, spark: SparkSession, root: str, columns: str, keys: list[str]):
        self.spark, self.root, self.columns, self.keys = spark, root, columns, keys

    def write(self, rows: DataFrame, name: str, buckets: int, grouped: bool = False) -> str:
        """Write ``rows`` as a table of so many buckets. ``grouped`` says that they are hash-partitioned by the keys into the
        session's number of shuffle partitions; where that is another number than ``buckets`` they are moved once more."""
        placed = rows if grouped and buckets == shuffle_partitions(self.spark) else rows.repartition(buckets, *self.keys)
        self._database()
        (
            placed.sortWithinPartitions(*self.keys).write.bucketBy(buckets, *self.keys).sortBy(*self.keys)
            .option("path", f"{self.root}/{name}").saveAsTable(self._full(name))
        )
        return name

    def write_placed(self, rows: DataFrame, name: str, buckets: int) -> BucketedTables:
        """Write rows that already lie in so many hash partitions of the keys, in their order, as a table that is not sorted."""
        self._database()
        rows.write.bucketBy(buckets, *self.keys).option("path", f"{self.root}/{name}").saveAsTable(self._full(name))
        return self

    def read(self, name: str, buckets: int) -> DataFrame:
        if not self.spark.catalog.tableExists(self._full(name)):
            self._database()
            by = ", ".join(self.keys)
            self.spark.sql(
                f"CREATE TABLE {self._full(name)} ({self.columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{self.root}/{name}'"
            )
        return self.spark.table(self._full(name))

    def files(self, name: str) -> DataFrame:
        """The rows of a table without its bucketing. Unions take this form: a union of bucketed tables can claim their
        partitioning after the planner has given it up, and an aggregate on top is then wrong."""
        return self.spark.read.schema(self.columns).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._full(name)}")
        SharedFiles(self.spark).delete(f"{self.root}/{name}")

    def _full(self, name: str) -> str:
        return f"{database(self.spark)}.`{name}`"

    def _database(self) -> None:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database(self.spark)} LOCATION '{_own_folder(self.spark)}/database'")


def _clean_at_exit(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            clean(spark)
    except Exception:  # noqa: BLE001 - the JVM may have ended first
        pass


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and no executor's loss can undo it."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes that a row takes: those of its texts, and 16 for each column. Nested values count as their JSON."""
    total = F.lit(16 * len(df.columns)).cast("long")
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(column), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return total


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and bytes, counted in one distributed pass."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    return n <= rows and size <= bytes


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast only after its rows and bytes were counted and are within the bounds."""
    return F.broadcast(df) if is_small(df, rows, bytes) else df


def fingerprint(*columns: Column | str) -> Column:
    """64-bit content hash in which null, '' and a shift between columns all differ."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.xxhash64(*[x for c in cols for x in (c, c.isNull())])


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` has not, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="stratalog-package-"))
    shutil.copytree(package, folder / "src" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(folder / package.name), "zip", folder / "src"))


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input that Spark reads in fewer partitions than there are cores, where a row costs much
    more than its bytes. Inputs with enough partitions, and those already shuffled, stay as they are."""
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


class SharedFiles:
    """The few file operations that commits need, on whatever file system holds the path."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def names(self, path: str) -> list[str]:
        fs, p = self._fs(path), self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def sizes(self, path: str) -> list[tuple[str, int]]:
        """Names and lengths of the files in a folder; an absent one has none."""
        fs, p = self._fs(path), self._path(path)
        return sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(p) if s.isFile()) if fs.exists(p) else []

    def age(self, path: str, now: float) -> float:
        """Seconds since a file or folder was last changed."""
        return now - self._fs(path).getFileStatus(self._path(path)).getModificationTime() / 1000

    def size(self, path: str) -> int:
        return self._fs(path).getContentSummary(self._path(path)).getLength()

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)

    def read(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Write a file that must not exist yet; it appears whole or not at all."""
        draft = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        stream = self._fs(draft).create(self._path(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(path).toUri(), self._conf)
        none = self._spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(draft), self._path(path), none)
        except Exception as e:
            self.delete(draft)
            raise CommitConflict(path) from e


def open_footer(spark: SparkSession, path: str):
    """A reader of a Parquet file that has read its footer only; to be closed."""
    jvm = spark._jvm
    place = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration())
    return jvm.org.apache.parquet.hadoop.ParquetFileReader.open(place)


def footer_rows(spark: SparkSession, path: str) -> int:
    reader = open_footer(spark, path)
    try:
        return reader.getRecordCount()
    finally:
        reader.close()


class CommitConflict(RuntimeError):
    """Another writer already published this version."""


class VersionLog:
    """Numbered JSON documents in a folder; the one with the highest number is the current state.

    A commit is the rename of a finished file to a name that must be free, so a reader sees the old state or the new
    one and of two writers with the same number one fails. Data files that no document lists are invisible.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.files, self.root = SharedFiles(spark), f"{root}/_versions"

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(self.root) if n.endswith(".json") and not n.startswith(".")]

    def read(self, number: int) -> dict:
        return json.loads(self.files.read(f"{self.root}/{number:012d}.json"))

    def current(self) -> tuple[int, dict]:
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, {})

    def commit(self, number: int, document: dict) -> int:
        self.files.create(f"{self.root}/{number:012d}.json", json.dumps(document, ensure_ascii=False))
        return number


class NameSet:
    """A set of names that only grows, such as batches that were merged: a small Parquet table each time it changes, so the
    documents of a version log name the set and do not hold it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _read(self, stored: str) -> DataFrame:
        return self.spark.read.schema("name string").parquet(f"{self.root}/{stored}")

    def has(self, stored: str | None, name: str) -> bool:
        return stored is not None and bool(self._read(stored).where(F.col("name") == name).head(1))

    def with_added(self, stored: str | None, names: list[str]) -> str | None:
        """A new set with these names too; the old one stays as it is."""
        if not names:
            return stored
        added = self.spark.createDataFrame([(n,) for n in names], "name string")
        new = f"names_{uuid.uuid4().hex}"
        (added if stored is None else added.unionByName(self._read(stored))).coalesce(1).write.parquet(f"{self.root}/{new}")
        return new
