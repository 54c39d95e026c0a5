"""Tables that are read, and intermediate tables that every executor can read again."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitmesh.sources.shared import shared_folder

#: Bytes and rows that one Arrow batch to a Python worker holds at most; more rows for operators that keep something from batch to batch.
BATCH_BYTES, BATCH_ROWS, LARGE_BATCH = 2 << 20, 500, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        path = f"{tempfile.mkdtemp(prefix='bitmesh-')}/{root.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(path)
        _shipped.add(context.applicationId)


def prepare(spark: SparkSession, times: int = 1) -> None:
    """For Python operators: the executors get this package, and batches bound a worker's memory however long the texts are."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(times * BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(times * BATCH_BYTES))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once however often they are used: a generator keeps the optimizer from repeating them."""
    for name, c in columns.items():
        df = df.select("*", F.explode_outer(F.array(c)).alias(name))
    return df


class Scratch:
    """Writes tables to the shared folder, so that what follows starts from files and not from the lineage.

    ``keep(df)`` writes and rereads a table; ``drop(*tables)`` deletes those that nothing reads any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/bitmesh/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        df.write.option("compression", "zstd").parquet(path)
        self.tidy()
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self.tables.append(out)
        return out

    def tidy(self) -> None:
        """Lets Spark delete the shuffle files of queries that have ended; it does so when their plans are collected."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths[id(t)])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
