"""Exactly one copy of each message that was delivered at least once."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.runtime import BucketedTables, NameSet, VersionLog, broadcast_if_small, free_names, fresh_path, in_arrow, shuffle_partitions, written

#: Time buckets; the buckets that an identifier may occur in are the bits of a long.
TIME_BUCKETS = 32
#: Bits per identifier and probes of a Bloom filter, for about 1 false positive in 300.
BLOOM_BITS, BLOOM_PROBES = 12, 6
#: Rows that are combined locally before anything is sent.
CHUNK_ROWS = 65_536
#: Rows of a hash partition, all time buckets together, for which filters are in memory at a time: 12 MB of them.
PARTITION_ROWS = 8_000_000
#: Identifiers of a stored filter.
FILTER_IDS = 1_000_000
#: How exact the borders of the time buckets are: their sizes differ by one part in this.
_EXACT = 10_000
_BEFORE_ALL = -(2**63)
#: Bits of the hash that a row is sorted by, below its time bucket.
_HASH_BITS = 57


class Bloom:
    """Bloom filter over 64-bit hashes for so many identifiers."""

    def __init__(self, identifiers: int):
        self.bits = max(64, identifiers * BLOOM_BITS)
        self.words = np.zeros(-(-self.bits // 8), np.uint8)

    @classmethod
    def of(cls, bits: int, words: bytes) -> Bloom:
        """A filter from its parts."""
        bloom = cls.__new__(cls)
        bloom.bits, bloom.words = bits, np.frombuffer(words, np.uint8)
        return bloom

    def _place(self, h: np.ndarray, probe: int) -> np.ndarray:
        step = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32) | np.uint64(1)
        return (h + np.uint64(probe) * step) % np.uint64(self.bits)

    def add(self, hashes: np.ndarray) -> None:
        h = hashes.astype(np.uint64)
        for i in range(BLOOM_PROBES):
            place = self._place(h, i)
            np.bitwise_or.at(self.words, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))

    def may_contain(self, hashes: np.ndarray) -> np.ndarray:
        left = np.arange(len(hashes))
        for i in range(BLOOM_PROBES):
            place = self._place(hashes[left].astype(np.uint64), i)
            left = left[(self.words[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        found = np.zeros(len(hashes), bool)
        found[left] = True
        return found


class BloomChain:
    """Filters of a fixed size, another one begun when the last is full: the rate of false positives stays, whatever comes."""

    def __init__(self, identifiers: int):
        self.identifiers, self.filters, self._room = max(64, identifiers), [], 0

    def add(self, hashes: np.ndarray) -> None:
        while len(hashes):
            if not self._room:
                self.filters.append(Bloom(self.identifiers))
                self._room = self.identifiers
            self.filters[-1].add(hashes[: self._room])
            taken = min(self._room, len(hashes))
            self._room, hashes = self._room - taken, hashes[taken:]

    def may_contain(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), bool)
        for f in self.filters:
            found |= f.may_contain(hashes)
        return found


_KIND = "t int, k string, v long, nulls int, a long, h long, m long"
#: Bits of ``nulls``: the key is null, the version is null, the row is already known to be dropped; above are bits of the arrival
#: that spread such rows.
_NO_KEY, _NO_VERSION, _DROPPED, _SPREAD = 1, 2, 4, 3


def _number(rows: DataFrame, arrival: str) -> Column:
    """The arrival as a long in the same order."""
    kind = dict(rows.dtypes)[arrival]
    if kind == "timestamp":
        return F.unix_micros(F.col(arrival))
    if kind == "timestamp_ntz":
        return F.unix_micros(F.convert_timezone(None, F.lit("UTC"), F.col(arrival)).cast("timestamp"))
    if kind == "date":
        return F.unix_date(F.col(arrival)).cast("long")
    if kind in ("tinyint", "smallint", "int", "bigint") or (kind.startswith("decimal") and kind.endswith(",0)")):
        return F.col(arrival).cast("long")
    raise ValueError(f"an arrival must be a whole number, a date or a timestamp, not {kind}")


def _flags(key: str, version: str) -> Column:
    return (F.when(F.col(key).isNull(), _NO_KEY).otherwise(0) + F.when(F.col(version).isNull(), _NO_VERSION).otherwise(0)).cast("int")


def _identified(rows: DataFrame, key: str, version: str, arrival: str, bucket: Column) -> DataFrame:
    k, v, nulls = F.coalesce(F.col(key), F.lit("")), F.coalesce(F.col(version), F.lit(0)).cast("long"), _flags(key, version)
    return rows.select(
        bucket.alias("t"), k.alias("k"), v.alias("v"), nulls.alias("nulls"), F.coalesce(_number(rows, arrival), F.lit(_BEFORE_ALL)).alias("a"), F.xxhash64(k, v, nulls).alias("h"), F.lit(1).cast("long").alias("m"),
    )


def _same(column: pa.Array) -> np.ndarray:
    """Whether each value but the first equals the one before."""
    return pc.equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)


def _combine(batches):
    """Of every CHUNK_ROWS rows of a partition: copies of one delivery (same identifier and arrival) become one row with their
    number ``m``, and rows that an earlier one of the chunk makes superfluous are marked as dropped. A marked row's ``nulls``
    says so, and has bits of its arrival, so that rows of one identifier part ways."""
    held, n = [], 0

    def flush():
        table = pa.Table.from_batches(held).combine_chunks()
        h, a = table.column("h").to_numpy(), table.column("a").to_numpy()
        order = np.lexsort((a, h))
        table = table.take(pa.array(order)).combine_chunks()
        k, v, nulls = (table.column(c).chunk(0) for c in ("k", "v", "nulls"))
        a = a[order]
        same = np.concatenate([[False], _same(k) & _same(v) & _same(nulls)])
        repeated = same & np.concatenate([[False], a[1:] == a[:-1]])
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(a))))
        starts = np.flatnonzero(~repeated)
        copies = np.add.reduceat(table.column("m").to_numpy(), starts)
        late = (a > a[lead])[starts]
        spread = ((a[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int32)
        marked = np.where(late, nulls.to_numpy()[starts] | _DROPPED | (spread << _SPREAD), nulls.to_numpy()[starts]).astype(np.int32)
        out = table.take(pa.array(starts))
        out = out.set_column(out.schema.get_field_index("nulls"), "nulls", pa.array(marked)).set_column(out.schema.get_field_index("m"), "m", pa.array(copies))
        yield from out.combine_chunks().to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= CHUNK_ROWS:
            yield from flush()
            held, n = [], 0
    if held:
        yield from flush()


def _screen(identifiers: int):
    """Rows sorted by time bucket, identifier and arrival in, batch by batch; out comes for each whether it is the first of its
    identifier in its bucket (``lead``), whether one before it in the bucket makes it superfluous (``dropped``), and in
    ``maybe`` the earlier buckets whose filters may hold its identifier, 0 meaning: in none of them. Held are the filters of
    this hash partition, sized for so many identifiers a bucket, and the last row."""

    def run(batches):
        chains: dict[int, BloomChain] = {}
        last: tuple | None = None  # identifier, first arrival and maybe of the group at hand
        for batch in batches:
            if not batch.num_rows:
                continue
            s, a, nulls = (batch.column(c).to_numpy() for c in ("s", "a", "nulls"))
            k, v, n = batch.column("k"), batch.column("v"), batch.column("nulls")
            t, h = (s >> _HASH_BITS).astype(np.int64), (s & ((1 << _HASH_BITS) - 1)).astype(np.uint64)
            known = (nulls & _DROPPED) != 0
            first = (t[0], k[0].as_py(), v[0].as_py(), n[0].as_py())
            same = np.concatenate([[last is not None and last[0] == first], _same(k) & _same(v) & _same(n) & (t[1:] == t[:-1])])
            group = np.maximum.accumulate(np.where(same, -1, np.arange(len(s))))  # -1: goes on from the batch before
            first_a = np.where(group >= 0, a[np.maximum(group, 0)], last[1] if last else 0)
            lead = ~same & ~known
            maybe = np.zeros(len(s), np.int64)
            for bucket in np.unique(t):
                here = np.flatnonzero(lead & (t == bucket))
                for earlier, chain in chains.items():
                    if earlier < bucket:
                        maybe[here] |= chain.may_contain(h[here]) * (np.int64(1) << np.int64(earlier))
                chains.setdefault(int(bucket), BloomChain(identifiers)).add(h[here])
            maybe = np.where(group >= 0, maybe[np.maximum(group, 0)], last[2] if last else 0)
            dropped = known | (same & (a > first_a))
            last = ((t[-1], k[-1].as_py(), v[-1].as_py(), n[-1].as_py()), int(first_a[-1]), int(maybe[-1]))
            maybe[known] = 0
            plain = np.where(known, nulls & (_NO_KEY | _NO_VERSION), nulls).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(t.astype(np.int32)), k, v, n, pa.array(plain), batch.column("a"), batch.column("m"), pa.array(maybe), pa.array(lead), pa.array(dropped)],
                ["t", "k", "v", "nulls", "plain", "a", "m", "maybe", "lead", "dropped"],
            )

    return run


_ID = ["k", "v", "nulls"]
_STORED = "t int, k string, v bigint, nulls int, plain int, a bigint, m bigint, maybe bigint, lead boolean, dropped boolean"


def _superfluous(rows: DataFrame, key: str, version: str, arrival: str, time_buckets: int) -> DataFrame:
    """``(k, v, nulls, a, m)``: the deliveries to drop, each once with its number of copies.

    1. Arrivals are cut into time buckets at quantiles, so an outlier moves no border; the same pass counts the rows. Chunks
       of the input are combined where they lie, so a message with a third of all copies is, but for rows already known to
       be dropped, which are spread, a few rows per partition before the shuffle.
    2. Hash partitions of the identifier, as many as keep each one's filters small, stream through the time buckets in order:
       each identifier is tested against the Bloom filters of the earlier buckets. Everything is stored once, bucketed by
       identifier, with the buckets that may hold it.
    3. Only possible repeats are verified, exactly, against only the stored time buckets that may hold them. The store's
       bucketing is the join's, so nothing is shuffled again. What is in no earlier bucket is new without a look.
    """
    spark = rows.sparkSession
    number = _number(rows, arrival)
    shares = [i / time_buckets for i in range(1, time_buckets)]
    n, borders = rows.agg(F.count("*"), F.percentile_approx(number, shares or [0.5], _EXACT)).first()
    borders = sorted({b for b in borders or []} if shares else set())
    parts = max(shuffle_partitions(spark), -(-n // PARTITION_ROWS))
    bucket = sum((F.when(number > b, 1).otherwise(0) for b in borders), F.lit(0)).cast("int")
    combined = in_arrow(_identified(rows, key, version, arrival, bucket), _combine, _KIND)
    sort = F.shiftleft(F.col("t").cast("long"), _HASH_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(*_ID), 64 - _HASH_BITS)).alias("s")
    placed = combined.repartition(parts, *_ID).select(sort, *_ID, "a", "m").sortWithinPartitions("s", *_ID, "a")
    screened = in_arrow(placed, _screen(max(64, 5 * n // (4 * parts * time_buckets))), _STORED)
    tables, name = BucketedTables(spark, fresh_path(spark, "deliveries"), _STORED, _ID), f"deliveries_{uuid.uuid4().hex}"
    store = tables.write_placed(screened, name, parts).read(name, parts)
    sure = store.where("dropped").select("k", "v", F.col("plain").alias("nulls"), "a", "m")
    asked = store.where("not dropped and maybe != 0").select(*_ID, "a", "m", "t", "maybe")
    there = store.where("lead").select(*[F.col(c).alias(f"_{c}") for c in _ID], F.col("t").alias("_t"))
    on = [F.col(c) == F.col(f"_{c}") for c in _ID] + [F.expr("_t < t and shiftright(maybe, _t) & 1 = 1")]
    again = asked.join(there.hint("merge"), on, "left_semi").select(*_ID, "a", "m")
    return sure.unionByName(again)


def repeats(rows: DataFrame, key: str, version: str, arrival: str, time_buckets: int = TIME_BUCKETS) -> DataFrame:
    """``(arrival, key, version)`` of the rows to drop, one row for each; see ``split_deliveries``. Nothing is joined with the
    rows again, so this is the cheaper form where those columns are enough. A null arrival comes out as null, and so does
    the least possible one."""
    kinds = dict(rows.dtypes)
    found = _superfluous(rows, key, version, arrival, time_buckets)
    each = found.withColumn("_copy", F.explode(F.expr("sequence(1L, m)")))
    at = F.when(F.col("a") != _BEFORE_ALL, F.col("a"))
    back = {"timestamp": F.timestamp_micros(at), "timestamp_ntz": F.timestamp_micros(at).cast("timestamp_ntz"), "date": F.date_from_unix_date(at.cast("int"))}.get(kinds[arrival], at.cast(kinds[arrival]) if kinds[arrival] not in ("timestamp", "timestamp_ntz", "date") else None)
    plain = lambda flag, c, kind: F.when(F.col("nulls").bitwiseAND(flag) == 0, F.col(c)).cast(kind)
    return each.select(back.alias(arrival), plain(_NO_KEY, "k", kinds[key]).alias(key), plain(_NO_VERSION, "v", kinds[version]).alias(version))


def _on(rows: DataFrame, key: str, version: str, arrival: str, names: list[str]) -> Column:
    """Whether a row is one of the deliveries whose k, v, nulls and a have these names."""
    k, v, nulls, a = map(F.col, names)
    same = (F.coalesce(F.col(key), F.lit("")) == k) & (F.coalesce(F.col(version), F.lit(0)).cast("long") == v)
    return same & (_flags(key, version) == nulls) & (F.coalesce(_number(rows, arrival), F.lit(_BEFORE_ALL)) == a)


def split_deliveries(rows: DataFrame, key: str, version: str, arrival: str, keep: bool, time_buckets: int = TIME_BUCKETS) -> DataFrame:
    """The rows to keep, or with ``keep=False`` the rows to drop; all columns of ``rows`` stay.

    Kept is, of all rows with the same (key, version), the one that arrived first. The last join is on the delivery, arrival
    included, so many copies of one message do not meet in one task; the deliveries to drop are broadcast when counted to
    be small, and then the rows are not shuffled.

    Nulls: a null in key or version is a value like any other, and different from ''; a null arrival comes before all others.
    Rows with the same identifier and the same arrival are the same delivery: none of them arrived earlier, so all are
    kept, or all dropped. An empty table gives no rows. Arrivals are whole numbers, dates or timestamps.
    """
    names = free_names(rows, "_k", "_v", "_nulls", "_at")
    found = written(_superfluous(rows, key, version, arrival, time_buckets).select(*_ID, "a").toDF(*names), "superfluous")
    return rows.join(broadcast_if_small(found), _on(rows, key, version, arrival, names), "left_anti" if keep else "left_semi")


#: So many time buckets are kept apart before the oldest half is merged into one.
MAX_BUCKETS = 16
_SEEN = "k string, v bigint, nulls int, a bigint"


class DeliveryLog:
    """Keeps exactly one copy of each message across batches, each batch being a time bucket.

    A bucket has a table of its identifiers, hash-bucketed on disk, and Bloom filters of each hash partition, of at most
    FILTER_IDS identifiers each. ``accept`` streams a batch's identifiers past the filters of their hash partition; those
    that no filter may hold are new without reading anything else, and the others are joined with only the tables of the
    buckets that may hold them, which are not shuffled. What is new is published as the batch's bucket by an atomic rename.
    Merges take more partitions when these have grown, so the filters of one stay small.

    A batch is known by its id: accepting it again, say after a failure, ignores its own bucket and gives the same rows, until
    the bucket is merged. Nulls, ties and empty batches are as in ``split_deliveries``; an identifier of an earlier batch
    counts as delivered earlier whatever its arrival.
    """

    def __init__(self, spark: SparkSession, root: str, partitions: int | None = None):
        self.spark, self.root = spark, root
        self.log, self._names = VersionLog(spark, root), NameSet(spark, root)
        self._tables = BucketedTables(spark, root, _SEEN, _ID)
        self.partitions = self.log.current()[1].get("partitions") or partitions or shuffle_partitions(spark)

    def _placed(self, df: DataFrame) -> DataFrame:
        """With the number of the hash partition and the hash that filters take."""
        return df.withColumns({"part": F.pmod(F.hash(*_ID), F.lit(self.partitions)), "h": F.xxhash64(*_ID)})

    def _table(self, name: str) -> DataFrame:
        return self._tables.read(name, self.partitions)

    def _write(self, ids: DataFrame) -> str:
        """A bucket's table, and beside it its filters."""
        name = self._tables.write(ids.select(*_ID, "a"), f"delivered_{uuid.uuid4().hex}", self.partitions)
        table = self._table(name)
        size = min(FILTER_IDS, max(64, 5 * table.count() // (4 * self.partitions)))  # counted from the footers

        def build(batches):
            part, chain = None, None

            def done():
                n = len(chain.filters)
                return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([name] * n), pa.array([f.bits for f in chain.filters], pa.int64()), pa.array([f.words.tobytes() for f in chain.filters], pa.binary())], ["part", "name", "bits", "words"])

            for batch in batches:
                parts, h = batch.column("part").to_numpy(), batch.column("h").to_numpy().view(np.uint64)
                for p in np.unique(parts):
                    if p != part:
                        if chain is not None:
                            yield done()
                        part, chain = int(p), BloomChain(size)
                    chain.add(h[parts == p])
            if chain is not None:
                yield done()

        hashes = self._placed(table).select("part", "h").repartition(self.partitions, "part").sortWithinPartitions("part")
        in_arrow(hashes, build, "part int, name string, bits long, words binary").write.parquet(f"{self.root}/{name}_filters")
        return name

    def accept(self, rows: DataFrame, key: str, version: str, arrival: str, batch: str) -> DataFrame:
        """The rows of the batch that are the first copy of their message; all columns stay."""
        number, document = self.log.current()
        if self._names.has(document.get("merged"), batch):
            raise ValueError(f"batch {batch} is merged and can't be accepted again")
        kept = [b for b in document.get("buckets", []) if b["batch"] != batch]
        combined = in_arrow(_identified(rows, key, version, arrival, F.lit(0)), _combine, _KIND)
        ids = combined.where(F.col("nulls").bitwiseAND(_DROPPED) == 0).groupBy(*_ID).agg(F.min("a").alias("a"))
        if kept:
            ids = self._unseen(ids, [b["name"] for b in kept])
        added = self._write(ids)
        self.log.commit(number + 1, {"partitions": self.partitions, "buckets": [*kept, {"batch": batch, "name": added}], "merged": document.get("merged")})
        names = free_names(rows, "_k", "_v", "_nulls", "_at")
        accepted = rows.join(self._table(added).select(*_ID, "a").toDF(*names), _on(rows, key, version, arrival, names), "left_semi")
        if len(kept) + 1 > MAX_BUCKETS:
            self.merge()
        return accepted

    def _unseen(self, ids: DataFrame, names: list[str]) -> DataFrame:
        def against(batches):
            """The filters of a hash partition come before its identifiers; only they are held."""
            part, filters = None, []
            for batch in batches:
                parts, kind = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
                for p in np.unique(parts):
                    if p != part:
                        part, filters = p, []
                    here = np.flatnonzero(parts == p)
                    for i in here[kind[here] == 0]:
                        filters.append((names.index(batch.column("name")[i].as_py()), Bloom.of(batch.column("bits")[i].as_py(), batch.column("words")[i].as_py())))
                    asked = batch.take(pa.array(here[kind[here] == 1]))
                    h, maybe = asked.column("h").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.zeros(asked.num_rows, np.int64)
                    for bit, bloom in filters:
                        maybe |= bloom.may_contain(h) * (np.int64(1) << np.int64(bit))
                    yield pa.RecordBatch.from_arrays([*(asked.column(c) for c in (*_ID, "a")), pa.array(maybe)], [*_ID, "a", "maybe"])

        filters = self.spark.read.schema("part int, name string, bits long, words binary").parquet(*[f"{self.root}/{n}_filters" for n in names]).withColumn("kind", F.lit(0))
        asked = self._placed(ids).withColumn("kind", F.lit(1))
        both = filters.unionByName(asked, allowMissingColumns=True).repartition(self.partitions, "part").sortWithinPartitions("part", "kind")
        screened = written(in_arrow(both, against, f"{_SEEN}, maybe bigint"), "screened")
        possible = screened.where("maybe != 0")
        hit = screened.agg(F.bit_or("maybe")).first()[0] or 0
        seen = None
        for i, name in enumerate(names):
            if hit >> i & 1:
                among = possible.where(F.expr(f"shiftright(maybe, {i}) & 1 = 1")).select(*_ID)
                again = among.join(self._table(name).select(*_ID).hint("merge"), _ID, "left_semi")
                seen = again if seen is None else seen.unionByName(again)
        if seen is not None:
            possible = possible.join(seen, _ID, "left_anti")
        return screened.where("maybe = 0").select(*_ID, "a").unionByName(possible.select(*_ID, "a"))

    def _union(self, buckets: list[dict]) -> DataFrame:
        union = self.spark.createDataFrame([], _SEEN)
        for b in buckets:
            union = union.unionByName(self._tables.files(b["name"]))
        return union

    def merge(self) -> None:
        """Make one bucket of the oldest half, or of all of them when there are too many identifiers for this number of
        partitions; identifiers are unique over all buckets, so nothing has to be compared."""
        number, document = self.log.current()
        rows = sum(self._table(b["name"]).count() for b in document["buckets"])  # from the footers
        partitions = self.partitions
        while rows > partitions * PARTITION_ROWS:
            partitions *= 2
        half = MAX_BUCKETS // 2 if partitions == self.partitions else len(document["buckets"])
        old, rest = document["buckets"][:half], document["buckets"][half:]
        union, before, self.partitions = self._union(old), self.partitions, partitions
        try:
            merged = {"batch": None, "name": self._write(union)}
            names = self._names.with_added(document.get("merged"), [b["batch"] for b in old if b["batch"] is not None])
            self.log.commit(number + 1, {"partitions": partitions, "buckets": [merged, *rest], "merged": names})
        except BaseException:
            self.partitions = before
            raise

    def vacuum(self) -> None:
        """Delete buckets that were merged or never published; results not yet evaluated that read them fail."""
        document = self.log.current()[1]
        keep = {b["name"] for b in document.get("buckets", [])} | {document.get("merged")}
        for name in self.log.files.names(self.root):
            if name.startswith(("delivered_", "names_")) and name.removesuffix("_filters") not in keep:
                self._tables.drop(name)
