"""Hamming joins by blocks: where chunks are too short to part the codes, all blocks of one table meet all of the other.

The rows are dealt evenly into blocks of bounded size, whatever the codes are,
and each pair of blocks is a task of its own. Within it, codes that agree in a
chunk are compared, or all codes if chunks leave most of them. So no task
depends on how often a chunk's bits occur, nothing is broadcast and the driver
gets a count of rows only. The work still grows with the square of the rows,
for which chunks of few bits leave no way around.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitmesh.functions import codes as C
from bitmesh.functions import compare
from bitmesh.plans.chunks import Plan

cloudpickle.register_pickle_by_value(compare)

#: Bytes of a block. Smaller tables make blocks of LEAST_ROWS rows at least, up to SPREAD blocks, so that several cores have work.
BLOCK_BYTES, LEAST_ROWS, SPREAD = 2 << 20, 8192, 8
MOST_TASKS = 4096


def n_blocks(rows: int, d_bytes: int) -> int:
    return max(1, math.ceil(rows * 8 * (1 + C.n_words(d_bytes)) / BLOCK_BYTES), min(SPREAD, math.ceil(rows / LEAST_ROWS)))


def _blocks(words: DataFrame, n: int, names: list[str]) -> DataFrame:
    dealt = words.select("id", *names).repartition(n).withColumn("block", F.spark_partition_id())
    return dealt.mapInArrow(partial(compare.pack, names=names), "block int, ids binary, gone binary, words binary")


def _cells(left: DataFrame, right: DataFrame | None, rows: tuple[int, int], d_bytes: int) -> DataFrame:
    """A partition for each pair of blocks, with both. Without ``right`` a table meets itself: each two blocks once, and each block itself."""
    names = C.word_names(d_bytes)
    n, m = (n_blocks(r, d_bytes) for r in rows)
    own = ["ids", "gone", "words"]
    here = F.col("block").cast("long")
    spread = lambda blocks, count: blocks.select(here.alias("block"), *own, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("other"))
    if right is None:
        count = n * (n + 1) // 2
        low, high = F.least("block", "other"), F.greatest("block", "other")
        # a number of low and high for low <= high, dense from 0 on
        placed = spread(_blocks(left.where(F.col("id").isNotNull()), n, names), n).select((F.floor(high * (high + 1) / 2) + low).alias("cell"), (F.col("block") == high).cast("int").alias("side"), (low == high).alias("alone"), *own)
    else:
        count = n * m
        sides = (spread(_blocks(left, n, names), m), F.col("block") * m + F.col("other"), 0), (spread(_blocks(right, m, names), n), F.col("other") * m + F.col("block"), 1)
        a, b = (rows.select(cell.alias("cell"), F.lit(side).alias("side"), F.lit(False).alias("alone"), *own) for rows, cell, side in sides)
        placed = a.unionByName(b)
    tasks = min(count, MOST_TASKS)
    return placed.repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int"))


def block_pairs(left: DataFrame, right: DataFrame | None, rows: tuple[int, int], d_bytes: int, k: int, plan: Plan | None) -> DataFrame:
    """``i, j, dist`` of two tables of words, or of one with itself (i < j), within k and alike in a chunk of the plan; without a plan all within k."""
    masks = plan and plan.masks()
    return _cells(left, right, rows, d_bytes).mapInArrow(partial(compare.pair_batches, k=min(k, 8 * d_bytes), masks=masks, own=right is None), "i bigint, j bigint, dist int")


def block_counts(left: DataFrame, right: DataFrame | None, rows: tuple[int, int], d_bytes: int, k: int, plan: Plan | None) -> DataFrame:
    """``dist, pairs``: the numbers of these pairs by distance, counted where the blocks meet."""
    masks = plan and plan.masks()
    counts = partial(compare.count_batches, k=k, masks=masks, own=right is None, bits=8 * d_bytes)
    return _cells(left, right, rows, d_bytes).mapInArrow(counts, "dist int, pairs bigint").groupBy("dist").agg(F.sum("pairs").alias("pairs"))
