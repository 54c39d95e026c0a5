"""Perspective rotation of dialogues, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitmesh.llm.frames import Scratch, once

#: The template's marks (fixed values). A mark inside a text or a name is escaped, and a line break in a name becomes a blank.
SYSTEM, ASSISTANT, USER, END = "<|system|>", "<|assistant|>", "<|user name=%s|>", "<|end|>"
#: Turns of one segment. A dialogue with more is rendered in consecutive segments, so that no task holds an unbounded one.
SEGMENT_TURNS = 1024
#: Rows of one part of a segment; only turn numbers that repeat thousands of times need a second part.
PART_ROWS = 4096
#: Characters of a text by which long dialogues are dealt into ranges; the order within a range is by whole texts.
RANGE_CHARS = 64


def _cut(rows: DataFrame, segment_turns: int, part_rows: int, scratch: Scratch) -> DataFrame:
    """``conv_id, segment, part, participant, turns`` of dialogues of any length, by ranks in the order of turns.

    Equal rows are counted and stand as one. The ranks within ranges of the
    order meet the counts of the ranges before, so that no task holds a
    dialogue, a turn number or copies of a row.
    """
    order = ["turn", "role", "text"]
    distinct = rows.groupBy("conv_id", *order).agg(F.count("*").alias("c"))
    ranges = distinct.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, RANGE_CHARS)).withColumn("slice", F.spark_partition_id())
    ranges = scratch.keep(ranges)
    within = Window.partitionBy("slice", "conv_id").orderBy(*order)
    local = ranges.withColumn("end", F.sum("c").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    local = scratch.keep(local.withColumn("nth", F.dense_rank().over(Window.partitionBy("slice", "conv_id").orderBy("turn"))))
    slices = local.groupBy("slice", "conv_id").agg(F.sum("c").alias("c"), F.max("nth").alias("d"), F.min_by(F.struct("turn"), "nth").alias("first"), F.max_by(F.struct("turn"), "nth").alias("last"))
    by = Window.partitionBy("conv_id").orderBy("slice")
    goes_on = F.coalesce(F.col("first").eqNullSafe(F.lag("last").over(by)) & (F.row_number().over(by) > 1), F.lit(False))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("on", goes_on.cast("long")).select("slice", "conv_id", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("rows"), (F.coalesce(F.sum("d").over(before), F.lit(0)) - F.sum("on").over(by.rowsBetween(Window.unboundedPreceding, 0))).alias("turns"))
    same = lambda a, b, *keys: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    placed = local.alias("x").join(slices.alias("y"), same("x", "y", "slice", "conv_id")).select(
        "x.conv_id", *order, "x.c", (F.col("rows") + F.col("end") - F.col("x.c")).alias("at"), F.floor((F.col("turns") + F.col("nth") - 1) / segment_turns).cast("long").alias("segment")
    )
    starts = placed.groupBy("conv_id", "segment").agg(F.min("at").alias("start"))
    placed = placed.alias("x").join(starts.alias("y"), same("x", "y", "conv_id", "segment")).select("x.conv_id", "x.segment", *order, "c", (F.col("at") - F.col("start")).alias("at"))
    parts = placed.select("*", F.explode(F.sequence(F.floor(F.col("at") / part_rows), F.floor((F.col("at") + F.col("c") - 1) / part_rows))).alias("part"))
    copies = F.least(F.col("at") + F.col("c"), (F.col("part") + 1) * part_rows) - F.greatest("at", F.col("part") * part_rows)
    whole = parts.groupBy("conv_id", "segment", "part").agg(F.sort_array(F.flatten(F.collect_list(F.array_repeat(F.struct(*order), copies.cast("int"))))).alias("turns"))
    whole = scratch.keep(whole)
    speakers = rows.where("role <> 'system'").select("conv_id", F.col("role").alias("participant")).distinct()
    keys = whole.select("conv_id", "segment", "part").alias("x").join(speakers.alias("y"), same("x", "y", "conv_id"), "left").select("x.*", "participant")
    return whole.alias("x").join(keys.alias("y"), same("x", "y", "conv_id", "segment", "part")).select("x.conv_id", "x.segment", "x.part", "participant", "turns")


def rotate(turns: DataFrame, segment_turns: int = SEGMENT_TURNS, part_rows: int = PART_ROWS) -> DataFrame:
    """One row for each dialogue (or part of one) and each participant: ``conv_id, segment, part, participant, n_turns, text, masks, n_mask_chars``.

    The participant's turns are the assistant's, all others are users with
    their names, and system turns stay. ``masks`` are the code point ranges
    start:end (end exclusive) that the assistant writes: its texts with their
    end marks.

    Turns are ordered by number, role and text, null numbers first. Segments
    hold segment_turns different turn numbers in this order and parts of them
    part_rows rows, so that a dialogue's parts one after the other are the
    dialogue; every participant of the dialogue gets all of them, those where
    it is silent too. Null roles are the speaker "unknown", null texts are
    empty, rows without conv_id form one dialogue. Repeated rows are rendered
    each. A dialogue of system turns alone gives one row for each part without
    participant and masks. Empty tables give no rows; other columns are
    ignored.
    """
    scratch = Scratch(turns.sparkSession)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("<\\|")).alias("text"),
    )
    # what has no more rows than this is its own only part
    long_ = scratch.keep(rows.groupBy("conv_id").agg(F.count("*").alias("c")).where(F.col("c") > min(segment_turns, part_rows)).select("conv_id"))
    some = not long_.isEmpty()
    x, y = rows.alias("x"), long_.alias("y")
    among = F.col("x.conv_id").eqNullSafe(F.col("y.conv_id"))
    short = x.join(y, among, "left_anti") if some else rows
    whole = short.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = F.array_sort(F.array_distinct(F.transform(F.filter("turns", lambda t: t["role"] != "system"), lambda t: t["role"])))
    views = whole.select("conv_id", F.lit(0).cast("long").alias("segment"), F.lit(0).cast("long").alias("part"), F.explode_outer(speakers).alias("participant"), "turns")
    if some:
        views = views.unionByName(_cut(x.join(y, among, "left_semi"), segment_turns, part_rows, scratch))
    quoted = lambda r: F.translate(F.replace(F.replace(r, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>")), "\n\r", "  ")
    own = lambda t: F.coalesce((t["role"] == F.col("participant")) & (t["role"] != "system"), F.lit(False))

    def head(t):
        name = F.concat(F.lit(USER.partition("%s")[0]), quoted(t["role"]), F.lit(USER.partition("%s")[2]))
        return F.concat(F.when(t["role"] == "system", F.lit(SYSTEM)).when(own(t), F.lit(ASSISTANT)).otherwise(name), F.lit("\n"))

    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("h"), F.concat(t["text"], F.lit("\n" + END)).alias("b"), own(t).alias("o")))
    views = once(views, pieces=pieces)
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["h"], p["b"], F.lit("\n"))), "")
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["h"]) + F.length(p["b"]) + 1).alias("at"),
            F.when(p["o"], F.concat(a["out"], F.array(F.struct((a["at"] + F.length(p["h"])).alias("s"), (a["at"] + F.length(p["h"]) + F.length(p["b"])).alias("e"))))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    views = once(views, spans=spans)
    return views.select(
        "conv_id", "segment", "part", "participant", F.size("turns").cast("long").alias("n_turns"), text.alias("text"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["s"].cast("string"), s["e"].cast("string"))), ",").alias("masks"),
        F.aggregate("spans", F.lit(0), lambda n, s: n + s["e"] - s["s"]).cast("long").alias("n_mask_chars"),
    )


SQL = r"""
WITH u AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '<\|') AS text FROM conversations
), v AS (
  SELECT *, (dense_rank() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1) // 1024 AS segment FROM u
), t AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, segment ORDER BY turn NULLS FIRST, role, text) - 1) // 4096 AS part FROM v
), p AS (
  SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'
), q AS (
  SELECT c.conv_id, p.participant FROM (SELECT DISTINCT conv_id FROM t) c LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM c.conv_id
), r AS (
  SELECT t.*, participant, coalesce(role = participant, false) AS own,
         CASE WHEN role = 'system' THEN '<|system|>' WHEN role = participant THEN '<|assistant|>'
              ELSE '<|user name=' || translate(replace(replace(role, '<|', '<\|'), '|>', '|\>'), chr(10) || chr(13), '  ') || '|>' END || chr(10) AS head,
         text || chr(10) || '<|end|>' AS body,
         row_number() OVER (PARTITION BY t.conv_id, t.segment, t.part, participant ORDER BY turn NULLS FIRST, role, text) AS k
  FROM t JOIN q ON q.conv_id IS NOT DISTINCT FROM t.conv_id
), s AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, segment, part, participant ORDER BY k) - length(body) - 1 AS pos FROM r
)
SELECT conv_id, segment::BIGINT AS segment, part::BIGINT AS part, participant, count(*)::BIGINT AS n_turns,
       string_agg(head || body || chr(10), '' ORDER BY k) AS text,
       coalesce(string_agg(pos::BIGINT || ':' || (pos + length(body))::BIGINT, ',' ORDER BY k) FILTER (WHERE own), '') AS masks,
       coalesce(sum(length(body)) FILTER (WHERE own), 0)::BIGINT AS n_mask_chars
FROM s GROUP BY conv_id, segment, part, participant
"""
