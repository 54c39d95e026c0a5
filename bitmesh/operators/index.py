"""An append-only index of codes over partitioned parquet, with batched queries."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from bitmesh.functions import codes as C
from bitmesh.operators import pairs
from bitmesh.operators.blocks import block_pairs
from bitmesh.operators.pairs import exploded, first_agreeing
from bitmesh.plans.chunks import Plan, check

HITS = "query_id bigint, id bigint, dist int"
#: Buckets that keep more than this share of all codes for a query are no help: then each code is kept once.
WORTH = 0.5

MANIFEST = "seq bigint, batch string, first bigint, rows bigint, numbers array<bigint>, replaces array<string>, d_bytes int, k int"


class Index:
    """Codes of ``d_bytes`` bytes that can be searched for all within distance ``k``.

    Each batch is one immutable folder of bucket rows, partitioned by chunk,
    and counts from the moment on at which its manifest entry stands, so a
    query reads a snapshot; a batch that failed half-way has none and can be
    added again. An index that exists at ``path`` is opened with all its
    batches; ``refresh`` takes in what another session has added meanwhile.
    One session may add at a time, any number may search. Ids are dense, from
    0 on, in the order of the batches.
    """

    def __init__(self, spark: SparkSession, path: str, d_bytes: int, k: int):
        check(k, d_bytes, True)
        self.spark, self.path, self.d_bytes, self.k = spark, path.rstrip("/"), d_bytes, k
        self.plan = Plan.from_bits(d_bytes, k)
        self.parted = sum(2.0 ** -len(c) for c in self.plan.chunks) <= WORTH
        self._read: DataFrame | None = None
        self.refresh()

    def _exists(self, path: str) -> bool:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(found)

    def refresh(self) -> None:
        """Reads the manifest: one small entry for each batch."""
        rows = []
        if self._exists(f"{self.path}/manifest"):
            rows = sorted(self.spark.read.option("recursiveFileLookup", True).schema(MANIFEST).json(f"{self.path}/manifest").collect(), key=lambda r: r["seq"])
        for r in rows:
            if (r["d_bytes"], r["k"]) != (self.d_bytes, self.k):
                raise ValueError(f"the index at {self.path} is for {r['d_bytes']} bytes and k={r['k']}")
        gone = {name for r in rows for name in r["replaces"]}
        self.seq = len(rows)
        self.batches = [r["batch"] for r in rows if r["batch"] not in gone]
        self.numbers = {number: r["first"] for r in rows if not r["replaces"] for number in r["numbers"]}
        self.n = sum(r["rows"] for r in rows if r["batch"] not in gone)
        self.release()

    def _commit(self, batch: str, first: int, rows: int, numbers: list[int], replaces: list[str]) -> None:
        entry = self.spark.createDataFrame([(self.seq, batch, first, rows, numbers, replaces, self.d_bytes, self.k)], MANIFEST)
        entry.coalesce(1).write.json(f"{self.path}/manifest/{self.seq:09d}")
        self.refresh()

    def __len__(self) -> int:
        return self.n

    @property
    def is_empty(self) -> bool:
        return self.n == 0

    def _checked(self, rows: DataFrame) -> None:
        C.require_binary(rows)
        width = C.code_width(rows)
        if width not in (0, self.d_bytes):
            raise ValueError(f"codes have {width} bytes, the index has {self.d_bytes}")

    def add(self, code: bytes) -> int:
        """Adds one code and returns its id."""
        return self.add_batch(self.spark.createDataFrame([(0, bytearray(code))], "id bigint, code binary"))

    def add_batch(self, rows: DataFrame, order: str = "id", number: int | None = None) -> int | None:
        """Adds all codes, numbered by ``order``; returns the first new id, or None for an empty batch.

        Ids come from sorted partitions and their sizes, not from one sorted
        task. A batch with a ``number``, as streams give it, is added once: if
        the index has it already, its first id is returned.
        """
        if number is not None and number in self.numbers:
            return self.numbers[number]
        self._checked(rows)
        batch = uuid.uuid4().hex
        staged = f"{self.path}/codes/{batch}"
        sorted_ = rows.select(F.col(order).alias("o"), "code").sort("o", "code")
        sorted_.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()).write.parquet(staged)
        kept = self.spark.read.schema(StructType([*sorted_.schema, StructField("part", IntegerType()), StructField("seq", LongType())])).parquet(staged)
        sizes = kept.groupBy("part").agg(F.count("*").alias("c"), F.min("seq").alias("s"))
        before = F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sizes = sizes.select("part", "s", "c", before.alias("before"))
        total = sizes.agg(F.sum("c")).first()[0] or 0
        if not total:
            return None
        numbered = kept.join(F.broadcast(sizes), "part").select((F.col("seq") - F.col("s") + F.col("before") + self.n).alias("id"), "code")  # one row for each partition
        self._write(exploded(C.to_words(numbered, self.d_bytes), self.plan), batch)
        first = self.n
        self._commit(batch, first, total, [] if number is None else [number], [])
        return first

    @property
    def _keys(self) -> list[str]:
        return [f"k{i}" for i in range(max(len(m) for m in self.plan.masks()))]

    def _write(self, rows: DataFrame, batch: str) -> None:
        """By chunk, and sorted by key, so that a scan for a key skips most pages. The first chunk has every code; without useful buckets it is all that is kept."""
        rows = rows if self.parted else rows.where("pos = 0")
        rows.sortWithinPartitions("pos", *self._keys).write.partitionBy("pos").parquet(f"{self.path}/buckets/batch={batch}")

    def _buckets(self) -> DataFrame:
        """The bucket rows of all batches, by one scan, whose files are listed once for each snapshot."""
        if self._read is None:
            columns = ", ".join(f"{c} bigint" for c in ["id", *C.word_names(self.d_bytes), *self._keys])
            self._read = self.spark.read.option("basePath", f"{self.path}/buckets").schema(f"{columns}, batch string, pos int").parquet(*[f"{self.path}/buckets/batch={b}" for b in self.batches]).drop("batch")
        return self._read

    def hold(self) -> None:
        """Keeps the bucket rows of this snapshot with the executors, for many single queries, until ``release`` or a new snapshot."""
        if self.n:
            self._read = self._buckets().coalesce(self.spark.sparkContext.defaultParallelism).cache()
            self._read.count()

    def release(self) -> None:
        if self._read is not None:
            self._read.unpersist()
        self._read = None

    def _codes(self) -> DataFrame:
        """``id, w*`` of every code once."""
        return self._buckets().where("pos = 0").select("id", *C.word_names(self.d_bytes))

    def compact(self) -> None:
        """Rewrites all batches as one. Older snapshots still find their folders."""
        if len(self.batches) > 1:
            batch, old, n = uuid.uuid4().hex, self.batches, self.n
            self._write(self._buckets().repartition("pos"), batch)
            self._commit(batch, 0, n, [], old)

    def _hits(self, queries: DataFrame) -> DataFrame:
        """By the buckets; many queries whose buckets would be read again and again meet the codes block by block."""
        names = C.word_names(self.d_bytes)
        words = C.to_words(queries, self.d_bytes)
        rows = queries.count(), self.n
        if not self.parted or pairs._candidates(rows, self.plan) > pairs.MOST_CANDIDATES:
            if rows[0] * rows[1] <= pairs.NESTED_PAIRS:
                found = pairs._nested(words, self._codes(), self.d_bytes, self.k, False)
            else:
                found = block_pairs(words, self._codes(), rows, self.d_bytes, self.k, self.plan if self.parted else None)
            return found.withColumnsRenamed({"i": "query_id", "j": "id"})
        asked = exploded(words, self.plan).alias("q")
        stored = self._buckets().alias("s")
        if rows[0] * len(self.plan.chunks) > pairs.MOST_BROADCAST:
            stored = stored.hint("merge")
        x, y = [F.col(f"q.{n}") for n in names], [F.col(f"s.{n}") for n in names]
        on = F.col("q.pos") == F.col("s.pos")
        for i in range(max(len(m) for m in self.plan.masks())):
            on &= F.col(f"q.k{i}") == F.col(f"s.k{i}")
        dist = C.hamming(x, y)
        on &= (dist <= self.k) & (F.col("q.pos") == first_agreeing(x, y, self.plan))
        return asked.join(stored, on).select(F.col("q.id").alias("query_id"), F.col("s.id").alias("id"), dist.cast("int").alias("dist"))

    def query(self, code: bytes) -> list[tuple[int, int]]:
        """(id, distance) of all codes within k, by id; a stored code finds itself. One scan for the keys of its chunks."""
        if len(code) != self.d_bytes:
            raise ValueError(f"codes have {len(code)} bytes, the index has {self.d_bytes}")
        if not self.n:
            return []
        values = C.word_values(code)
        dist = C.hamming([F.col(c) for c in C.word_names(self.d_bytes)], [F.lit(v) for v in values])
        rows = self._buckets() if self.parted else self._codes()
        if self.parted:
            same = [reduce(and_, [F.col(name) == C.signed(values[w] & m) for name, (w, m) in zip(self._keys, sorted(own.items()), strict=False)]) for own in self.plan.masks()]
            rows = rows.where(reduce(or_, same))
        found = rows.select("id", dist.cast("int").alias("dist")).where(F.col("dist") <= self.k).collect()
        return sorted({r["id"]: r["dist"] for r in found}.items())  # a code may stand in several buckets

    def query_batch(self, queries: DataFrame, nested: bool = True) -> DataFrame:
        """All hits of each query: ``query_id, hits`` with an empty array where there are none, or ``query_id, id, dist``."""
        self._checked(queries)
        ids = queries.select(F.col("id").cast("bigint").alias("query_id"))
        found = self._hits(queries) if self.n else self.spark.createDataFrame([], HITS)
        if not nested:
            return found
        lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("id", "dist"))).alias("hits"))
        none = F.array().cast("array<struct<id:bigint,dist:int>>")
        return ids.join(lists, "query_id", "left").select("query_id", F.coalesce("hits", none).alias("hits"))
