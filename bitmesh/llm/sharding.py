"""Jump consistent hashing of stable keys to shards, and gapless slots inside each shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitmesh.llm.frames import Scratch, prepare
from bitmesh.llm.words import U64, mix

#: Step of the linear congruential generator that the jump hash is defined with (fixed value).
LCG = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key: the last jump of the key's own random walk that stays below ``shards``."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = mix(keys.astype(np.int64).view(U64) + U64(1))
    here, ahead = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    moving = ahead < shards
    while moving.any():
        here = np.where(moving, ahead, here)
        state = np.where(moving, state * U64(LCG) + U64(1), state)
        draw = ((state >> U64(33)) + U64(1)).astype(np.float64)
        ahead = np.where(moving, ((here + 1) * (float(1 << 31) / draw)).astype(np.int64), ahead)
        moving = ahead < shards
    return here


def assign(rows: DataFrame, key: str = "doc_id", shards: int = 16) -> DataFrame:
    """Adds ``shard``, ``grown_shard`` (with one shard more) and ``slot`` (gapless from 0 in each shard).

    Shards depend on the key and the number of shards alone. Slots are made
    in two steps: each task numbers its own rows per shard, and the written
    rows' counts per task and shard give each task's first slot, so that
    neither a hot key nor a shard ever meets in one task.

    A null key counts as 0. Rows with the same key share a shard and have
    slots of their own. An empty table stays empty. Columns named like the new
    ones are replaced.
    """
    spark = rows.sparkSession
    prepare(spark)
    own = ["shard", "grown_shard", "slot", "slot_task"]
    rows = rows.drop(*own)
    keyed = rows.withColumn("slot_task", F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(0).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(shards, np.int64)
        task = TaskContext.get().partitionId()
        for b in batches:
            keys = b["slot_task"].to_numpy(zero_copy_only=False)
            shard, grown = jump(keys, shards), jump(keys, shards + 1)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            slot = np.empty(len(shard), np.int64)
            slot[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts - seen, counts)
            seen += counts
            columns = [c for name, c in zip(b.schema.names, b.columns, strict=True) if name != "slot_task"]
            names = [name for name in b.schema.names if name != "slot_task"]
            new = [pa.array(shard.astype(np.int32)), pa.array(grown.astype(np.int32)), pa.array(slot), pa.array(np.full(len(shard), task, np.int64))]
            yield pa.RecordBatch.from_arrays(columns + new, names + own)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    numbered = Scratch(spark).keep(keyed.mapInArrow(run, f"{kinds}, shard int, grown_shard int, slot long, slot_task long"))
    counts = numbered.groupBy("shard", "slot_task").agg(F.count("*").alias("slot_rows"))
    before = Window.partitionBy("shard").orderBy("slot_task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "slot_task", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("slot_first"))
    placed = numbered.join(first, ["shard", "slot_task"])
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns], "shard", "grown_shard", (F.col("slot") + F.col("slot_first")).alias("slot"))


def shard_digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The rows of ``assign`` with the text's size and checksum in the text's place."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = assign(slim, "doc_id", shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
