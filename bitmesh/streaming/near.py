"""Near duplicates in streams of codes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitmesh.functions import codes as C
from bitmesh.operators.index import Index
from bitmesh.operators.pairs import exploded, first_agreeing, keys
from bitmesh.plans.chunks import Plan, check


def _rows(df: DataFrame, d_bytes: int, plan: Plan, time: str | None = None) -> DataFrame:
    """Exploded chunk rows, with the event time if there is one."""
    words = C.to_words(df.withColumn("id", F.col("id").cast("bigint")), d_bytes)
    if time is None:
        return exploded(words, plan)
    names = C.word_names(d_bytes)
    made = [F.conv(F.hex(F.substring("code", 8 * i + 1, 8)), 16, -10).cast("bigint").alias(w) for i, w in enumerate(names)]
    rows = [F.struct(F.lit(pos).alias("pos"), *[c.alias(f"k{i}") for i, c in enumerate(own)]) for pos, own in enumerate(keys([F.col(w) for w in names], plan))]
    return df.select(F.col("id").cast("bigint").alias("id"), F.col(time).alias("time"), *made).select("id", "time", *names, F.inline(F.array(*rows)))


#: Chunks serve a join within a time if they leave this share of the pairs at most; else every pair within the time is compared.
WORTH = 0.25


def _slot(spark: SparkSession, time: str, apart: str) -> Column:
    """A number of the time that grows with it. Times at most ``apart`` of each other have the same or neighbouring numbers; a day may have 25 hours."""
    micros = spark.sql(f"SELECT unix_micros(timestamp_seconds(0) + interval {apart}) AS m").first()["m"]
    return F.expr(f"unix_micros(CAST({time} AS TIMESTAMP)) div {micros * 25 // 24 + 1}L")


def _on(plan: Plan, k: int):
    names = C.word_names(plan.d_bytes)
    x, y = [F.col(f"a.{n}") for n in names], [F.col(f"b.{n}") for n in names]
    on = F.col("a.pos") == F.col("b.pos")
    for i in range(max(len(m) for m in plan.masks())):
        on &= F.col(f"a.k{i}") == F.col(f"b.k{i}")
    dist = C.hamming(x, y)
    if len(plan.chunks) > 1:
        on &= F.col("a.pos") == first_agreeing(x, y, plan)
    return on & (dist <= k), dist.cast("int").alias("dist")


def against(stream: DataFrame, known: DataFrame, k: int, d_bytes: int) -> DataFrame:
    """Stream-static join: ``i`` from the stream, ``j`` from a table of known codes, ``dist``. It needs no state."""
    check(k, d_bytes, True)
    plan = Plan.from_bits(d_bytes, k)
    on, dist = _on(plan, k)
    a, b = _rows(stream, d_bytes, plan).alias("a"), _rows(known, d_bytes, plan).alias("b")
    return a.join(b, on).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), dist)


def within_time(stream: DataFrame, other: DataFrame, k: int, d_bytes: int, time: str = "ts", delay: str = "1 hour", apart: str = "1 hour") -> DataFrame:
    """Pairs i < j of two readings of a stream that came at most ``apart`` of each other. Both sides keep state for as long as the watermark asks.

    The time is part of the join's key: each row of the first reading stands
    in the slot of its time and in both neighbours, so a row meets those of
    its own time only, however long the stream is.
    """
    check(k, d_bytes, True)
    plan = Plan.from_bits(d_bytes, k)
    if sum(2.0 ** -len(c) for c in plan.chunks) > WORTH:
        plan = Plan(d_bytes, ((),))
    on, dist = _on(plan, k)
    slot = _slot(stream.sparkSession, "time", apart)
    a = _rows(stream, d_bytes, plan, time).withWatermark("time", delay).withColumn("slot", F.explode(F.sequence(slot - 1, slot + 1))).alias("a")
    b = _rows(other, d_bytes, plan, time).withWatermark("time", delay).withColumn("slot", slot).alias("b")
    on &= F.col("a.slot") == F.col("b.slot")
    near = F.expr(f"b.time >= a.time - interval {apart} AND b.time <= a.time + interval {apart}")
    return a.join(b, on & near & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), dist)


def into_index(stream: DataFrame, index: Index, emit: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None):
    """Feeds a stream into an index, batch by batch: each batch is searched for in what came before and then added.

    ``emit(hits, batch)`` gets ``query_id, id, dist`` for each batch. The
    batch's number goes with it into the index, so a batch that a restarted
    stream repeats is searched for in the same codes and not added again.
    Returns the writer, to be started by the caller.
    """

    def step(batch: DataFrame, number: int) -> None:
        if emit is not None:
            found = index.query_batch(batch, nested=False)
            emit(found.where(F.col("id") < index.numbers[number]) if number in index.numbers else found, number)
        index.add_batch(batch, number=number)

    writer = stream.writeStream.foreachBatch(step)
    return writer.option("checkpointLocation", checkpoint) if checkpoint else writer
