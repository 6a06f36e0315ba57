"""Immutable sorted Parquet runs and what the manifest says of them."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.runtime import AT_ONCE, FOOTERS, SharedFiles, footer_rows, open_footer
from stratalog.schema import RUN_LOG

#: Version of the layout; a manifest with another one is refused.
FORMAT = 2
#: Spark's names of the codecs for blocks.
CODECS = {"none": "uncompressed", "lz4": "lz4_raw", "zstd": "zstd", "snappy": "snappy"}


class DamagedRun(RuntimeError):
    """A run is missing, of another length or record count than when it was written, or can't be read."""


@dataclass(frozen=True)
class Run:
    """One Parquet file, sorted by key and descending version. ``file_bytes`` is its length, ``size_bytes`` the UTF-8 bytes of keys and values."""

    path: str
    level: int
    seq: int
    min_key: str | None
    max_key: str | None
    entry_count: int
    min_version: int | None
    max_version: int | None
    size_bytes: int
    file_bytes: int = 0

    def may_hold(self, lower: str | None, upper: str | None, version: int | None, last_included: bool = False) -> bool:
        """Whether a record with lower <= key < upper (or <= upper) and at most that version can be in it."""
        if not self.entry_count or self.min_key is None:
            return False
        below = upper is not None and (_bytes(self.min_key) > _bytes(upper) or (not last_included and self.min_key == upper))
        above = lower is not None and _bytes(self.max_key) < _bytes(lower)
        late = version is not None and self.min_version is not None and self.min_version > version
        return not (below or above or late)

    def overlaps(self, low: str, high: str) -> bool:
        return self.may_hold(low, high, None, last_included=True)

    def document(self) -> dict:
        return asdict(self)


def _bytes(key: str) -> bytes:
    return key.encode("utf-8")


METADATA = {
    "min_key": "min(key)", "max_key": "max(key)", "entry_count": "count(1)", "min_version": "min(version)", "max_version": "max(version)",
    "size_bytes": "coalesce(sum(octet_length(key) + coalesce(octet_length(value), 0)), 0)",
}


def metadata(log: DataFrame, by: list[str]) -> DataFrame:
    """Key and version ranges, record count and UTF-8 bytes of keys and values of each run."""
    return log.groupBy(*by).agg(*[F.expr(e).alias(n) for n, e in METADATA.items()])


def write_runs(spark: SparkSession, root: str, log: DataFrame, level: int, seq: int, parts: int = 1, codec: str = "lz4", distinct_keys: int | None = None) -> list[Run]:
    """Write a change log as up to ``parts`` runs of consecutive ranges of (key, version descending), sorted so, one file each.

    Only a key with more records than a run takes spans several runs; reads go by version, never by run, and a merge takes
    all runs that share a key. The files become visible when a manifest lists them. Parquet keeps min, max and a Bloom
    filter or dictionary of the keys per row group; ``distinct_keys`` sizes the filter of a run, without it the writer picks
    the size that its keys turn out to need. What
    the manifest says of a run comes from the file's footer, so nothing is read again.
    """
    folder = f"runs/{uuid.uuid4().hex}"
    rows = log.select("key", "version", "tombstone", "value").withColumns({"level": F.lit(level), "seq": F.lit(seq).cast("long")})
    spread = rows.repartitionByRange(parts, "key", F.desc("version")) if parts > 1 else rows.coalesce(1)
    writer = (
        spread.sortWithinPartitions("key", F.desc("version")).write.option("compression", CODECS[codec])
        .option("parquet.bloom.filter.enabled#key", "true").option("parquet.page.write-checksum.enabled", "true")
    )
    if distinct_keys:
        writer = writer.option("parquet.bloom.filter.expected.ndv#key", str(max(1, -(-distinct_keys // parts))))
    else:
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    writer.parquet(f"{root}/{folder}")
    found = describe(spark, root, [(f"{folder}/{n}", size) for n, size in SharedFiles(spark).sizes(f"{root}/{folder}") if n.endswith(".parquet")])
    filled = sorted((f for f in found if f["entry_count"]), key=lambda f: f["path"])
    return [Run(level=level, seq=seq + i, **f) for i, f in enumerate(filled)]


def describe(spark: SparkSession, root: str, files: list[tuple[str, int]]) -> list[dict]:
    """``path``, ``file_bytes`` and the METADATA of run files, from their footers. The footer of a file with very long keys has no
    bounds of them; such files, and more than FOOTERS of them, are read by one job instead."""
    out, rest = [], files
    if len(files) <= FOOTERS:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            feet = list(pool.map(lambda f: _footer(spark, f"{root}/{f[0]}"), files))
        out = [{"path": p, "file_bytes": n, **f} for (p, n), f in zip(files, feet, strict=True) if f]
        rest = [f for f, foot in zip(files, feet, strict=True) if not foot]
    if rest:
        sizes = {p.rpartition("/")[2]: (p, n) for p, n in rest}
        log = spark.read.schema(RUN_LOG).parquet(*[f"{root}/{p}" for p, _ in rest]).withColumn("file", F.col("_metadata.file_name"))
        read = {r["file"]: {n: r[n] for n in METADATA} for r in metadata(log, ["file"]).toLocalIterator()}
        empty = dict.fromkeys(METADATA) | {"entry_count": 0, "size_bytes": 0}
        out += [{"path": p, "file_bytes": n, **read.get(name, empty)} for name, (p, n) in sizes.items()]
    return out


def _footer(spark: SparkSession, path: str) -> dict | None:
    """METADATA from a footer, None if it does not have all of it. A footer that can't be read raises."""
    reader = open_footer(spark, path)
    try:
        blocks = [(b.getRowCount(), {c.getPath().toDotString(): c for c in b.getColumns()}) for b in reader.getFooter().getBlocks()]
    finally:
        reader.close()
    rows, size, keys, versions = 0, 0, [], []
    for n, columns in blocks:
        key, version, value = columns["key"].getStatistics(), columns["version"].getStatistics(), columns["value"].getStatistics()
        if n and (not key.hasNonNullValue() or not key.isNumNullsSet() or key.getNumNulls()):
            return None
        rows += n
        if n:
            keys += [bytes(key.getMinBytes()).decode(), bytes(key.getMaxBytes()).decode()]
            if version.hasNonNullValue():
                versions += [version.getMin(), version.getMax()]
        for c in ("key", "value"):
            counted = columns[c].getSizeStatistics()
            held = counted.getUnencodedByteArrayDataBytes() if counted is not None else None
            if held is None or not held.isPresent():
                if c == "value" and value.isNumNullsSet() and value.getNumNulls() == n:
                    continue
                return None
            size += held.get()
    bounds = {"min_key": min(keys, key=_bytes), "max_key": max(keys, key=_bytes)} if keys else {"min_key": None, "max_key": None}
    return {**bounds, "entry_count": rows, "min_version": min(versions, default=None), "max_version": max(versions, default=None), "size_bytes": size}


def check_runs(spark: SparkSession, root: str, runs: list[Run]) -> None:
    """Raise DamagedRun unless each run is there, as long as when it was written, with a readable footer that counts the
    same records. Pages have checksums, which every read verifies."""
    files = SharedFiles(spark)
    folders = sorted({r.path.rpartition("/")[0] for r in runs})
    with ThreadPoolExecutor(AT_ONCE) as pool:
        there = {f"{folder}/{n}": size for folder, found in zip(folders, pool.map(lambda f: files.sizes(f"{root}/{f}"), folders), strict=True) for n, size in found}
    for r in runs:
        if r.path not in there:
            raise DamagedRun(f"run {r.path} is missing")
        if there[r.path] != r.file_bytes:
            raise DamagedRun(f"run {r.path} has {there[r.path]} bytes, not {r.file_bytes}")
    counts = dict.fromkeys((r.path.rpartition("/")[2] for r in runs), 0)
    try:
        if len(runs) <= FOOTERS:
            with ThreadPoolExecutor(AT_ONCE) as pool:
                counts = dict(zip(counts, pool.map(lambda r: footer_rows(spark, f"{root}/{r.path}"), runs), strict=True))
        else:  # no column is read, so the readers open nothing but the footers
            log = spark.read.schema(RUN_LOG).parquet(*[f"{root}/{r.path}" for r in runs])
            counts |= {r["file"]: r["n"] for r in log.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n")).toLocalIterator()}
    except Exception as e:
        raise DamagedRun(f"a run can't be read: {str(e).splitlines()[0]}") from e
    for r in runs:
        if counts[r.path.rpartition("/")[2]] != r.entry_count:
            raise DamagedRun(f"run {r.path} has {counts[r.path.rpartition('/')[2]]} records, not {r.entry_count}")


def read_runs(spark: SparkSession, root: str, runs: list[Run]) -> DataFrame:
    """The records of runs in one scan; page checksums are verified. A file that is gone is an error, never an empty run.

    Parquet's dictionary filter is off: it copies a dictionary 8 KiB at a time, which the decoder of lz4_raw can't do, so a
    predicate on a run with a larger one would fail. As runs are sorted, the bounds of pages leave about a page to read for a key.
    """
    if not runs:
        return spark.createDataFrame([], RUN_LOG)
    options = {"parquet.page.verify-checksum.enabled": "true", "parquet.filter.dictionary.enabled": "false"}
    return spark.read.schema(RUN_LOG).options(**options).parquet(*[f"{root}/{r.path}" for r in runs])


class RunCache:
    """Runs kept in the executors' memory, the least recently read ones dropped beyond a bound of bytes.

    Only reads whose runs all fit are served from it, so a scan of everything does not displace what point reads use. A run
    whose read fails is not kept: what can't be read is never stored.
    """

    def __init__(self, spark: SparkSession, root: str, most_bytes: int):
        self._spark, self._root, self.most_bytes = spark, root, most_bytes
        self._held: dict[str, tuple[DataFrame, int]] = {}  # in order of last use
        self.hits = self.misses = 0

    @property
    def bytes(self) -> int:
        return sum(n for _, n in self._held.values())

    def read(self, runs: list[Run]) -> DataFrame:
        if not runs or sum(r.size_bytes for r in runs) > self.most_bytes or len(runs) > FOOTERS:
            return read_runs(self._spark, self._root, runs)
        frames = []
        for r in runs:
            held = self._held.pop(r.path, None)
            if held is None:
                self.misses += 1
                held = read_runs(self._spark, self._root, [r]).persist(), r.size_bytes
            else:
                self.hits += 1
            self._held[r.path] = held
            frames.append(held[0])
        wanted = {r.path for r in runs}
        for path in [p for p in self._held if p not in wanted]:
            if self.bytes <= self.most_bytes:
                break
            self.drop([path])
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def drop(self, paths: list[str]) -> None:
        for p in paths:
            held = self._held.pop(p, None)
            if held is not None:
                held[0].unpersist()

    def clear(self) -> None:
        self.drop(list(self._held))
