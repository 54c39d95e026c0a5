"""Removal of repeated runs of lines by winnowing over line hashes.

Two lines are equal if their words are. Lines without words count for nothing.
A window is the shortest run of lines from a line on with ``min_words`` words.
Its fingerprint is the least line hash in it, the last one of several; the
windows that share a least line in one place give one posting. Wherever a run
of at least ``min_words`` words repeats, its windows, and with them their
fingerprints, repeat too, so only windows under a fingerprint that stands in
several places are looked at further. A fingerprint's places are told apart by
the windows around them: each window meets the first place where it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitmesh.llm import words as W
from bitmesh.llm.frames import Scratch, prepare

MIN_WORDS = 50
#: Later texts that meet their original in one task at about, for each window that they share with it.
LATER_TEXTS = 256


def _hashes(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the hash of every run of ``code`` follows, and the factors that make it independent of the place."""
    up, down = W._power_tables(len(code) + 1)
    return np.r_[W.U64(0), np.cumsum(code * up[: len(code)])], down


def _runs(code: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each run ``code[first[i]:last[i]]``, which depends on the order."""
    total, down = _hashes(code)
    return W.mix((total[last] - total[first]) * down[first] + (last - first).astype(W.U64))


def fingerprint(texts: pa.Array, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's lines with words: hash, number in the text, key of the window that starts there (0: too short), place of that window's least line in the text, and the texts' borders."""
    words = W.scan(texts, fold=W.SAME)
    breaks = np.union1d(words.offsets[:-1], np.flatnonzero(words.buf == 0x0A) + 1)
    line = np.searchsorted(breaks, words.start, "right") - 1
    new = np.r_[True, line[1:] != line[:-1]] if len(line) else np.zeros(0, bool)
    opens = np.r_[np.flatnonzero(new), len(line)]
    code = _runs(words.code, opens[:-1], opens[1:])
    text = np.searchsorted(words.first, opens[:-1], "right") - 1
    number = line[opens[:-1]] - np.searchsorted(breaks, words.offsets[text])
    borders = np.searchsorted(text, np.arange(len(words.first)))
    here = np.arange(len(code))
    window = np.searchsorted(opens, opens[:-1] + min_words)
    has = window <= borders[text + 1]
    least, place = code.copy(), here.copy()
    reach = np.where(has, window, 0)
    for k in range(1, min_words + 1):
        at = np.flatnonzero(reach > here + k)
        if not len(at):
            break
        at = at[code[at + k] <= least[at]]
        least[at], place[at] = code[at + k], at + k
    key = np.where(has, _runs(code, here, np.where(has, window, here)), W.U64(0))
    return code, number, key, place - borders[text], borders


def _ragged(values: np.ndarray, borders: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(values, kind))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists one after the other, and the borders of the lists."""
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]


def _postings(borders: np.ndarray, key: np.ndarray, place: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, ...]:
    """Selected minima: text, place, hash, and the range of windows that share it."""
    has = np.flatnonzero(key)
    text = np.searchsorted(borders, has, "right") - 1
    at = place[has] + borders[text]
    # the windows of a text select places that never go back, so equal ones stand together
    new = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
    opens = np.flatnonzero(new)
    first = has[opens]
    last = has[np.r_[opens[1:], len(has)] - 1] + 1 if len(opens) else first
    return text[opens], place[has][opens], code[at[opens]], first, last


def _extend(later: np.ndarray, first: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest equal runs through the anchors (place p in later, place q in first), as disjoint ranges of ``later``.

    Lengths come from bisection over hashes of runs, for all anchors at once:
    n anchors cost n log n steps however often lines repeat.
    """
    (x, _), (y, _) = _hashes(later.view(W.U64)), _hashes(first.view(W.U64))
    down = W._power_tables(max(len(later), len(first)) + 1)[1]

    def equal(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (x[a + n] - x[a]) * down[a] == (y[b + n] - y[b]) * down[b]

    def longest(most: np.ndarray, same) -> np.ndarray:
        lo, hi = np.zeros(len(p), np.int64), most.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            good = same(mid)
            lo, hi = np.where(good, mid, lo), np.where(good, hi, mid - 1)
        return lo

    back = longest(np.minimum(p, q), lambda n: equal(p - n, q - n, n))
    ahead = longest(np.minimum(len(later) - p, len(first) - q), lambda n: equal(p, q, n))
    return _merged(p - back, p + ahead, 0)


def _merged(start: np.ndarray, end: np.ndarray, touch: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges (end exclusive) as disjoint ranges; empty ones go, and with ``touch`` 1 those that touch become one."""
    some = end > start
    order = np.argsort(start[some], kind="stable")
    start, reach = start[some][order], np.maximum.accumulate(end[some][order]) if some.any() else end[some]
    new = np.r_[True, start[1:] >= reach[:-1] + touch] if len(start) else np.zeros(0, bool)
    opens = np.flatnonzero(new)
    return start[opens], reach[np.r_[opens[1:], len(start)] - 1] if len(opens) else start[opens]


CUT = "array<struct<a:int,b:int>>"


def _ranges(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Ranges of each row as an Arrow column, both ends included."""
    a, b = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
    rows = pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["a", "b"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p[0]) for p in parts])], pa.int32()), rows)


def drop_repeats(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Adds ``n_lines, n_dropped, dropped, cleaned``: the lines, how many went and which (ranges a-b, both included, from 0), and the text without them.

    Of every repeated run of lines with at least ``min_words`` words the first
    stays: that of the smallest doc_id, text hash and place. A later window of
    ``min_words`` words is matched to the first place where it stands, the
    match is extended both ways as long as the lines agree, and goes. Runs may
    repeat inside one document. Every line that goes stands in an earlier
    place, so no content is lost.

    Matches are stars around the first place, so a passage that thousands of
    documents share gives one row for each of them, and its original goes to
    one task for about LATER_TEXTS of them. Null and empty texts have nothing
    to drop. Rows with the same doc_id and text count as one document
    and are treated alike; null doc_ids come last. Other columns pass through;
    columns named like new ones are replaced; an empty table stays empty.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    own = ["n_lines", "n_dropped", "dropped", "cleaned", "__o", "__h"]
    old = [c for c in docs.columns if c not in own]
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    identity = [F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("__o"), F.xxhash64(value).alias("__h")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, number, key, place, borders = fingerprint(b["t"], min_words)
            text, at, mark, first, last = _postings(borders, key, place, code)
            runs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(last - first)], pa.int32()), pa.array(key[np.flatnonzero(key)].view(np.int64)))
            posted = pa.StructArray.from_arrays([pa.array(mark.view(np.int64)), pa.array(at, pa.int32()), pa.array(first - borders[text], pa.int32()), runs], ["mark", "at", "p", "keys"])
            posted = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(borders))), pa.int32()), posted)
            yield pa.RecordBatch.from_arrays([b["__o"], b["__h"], _ragged(code.view(np.int64), borders, pa.int64()), _ragged(number, borders, pa.int32()), posted], ["o", "h", "code", "number", "posted"])

    lines = docs.select(*identity, value.alias("t")).mapInArrow(W.frugal(scan), "o long, h long, code array<long>, number array<int>, posted array<struct<mark:long,at:int,p:int,keys:array<long>>>")
    lines = scratch.keep(lines)
    posted = lines.select("o", "h", F.inline("posted"))
    marks = posted.groupBy("mark").agg(F.min(F.struct("o", "h", "at")).alias("f"), F.max(F.struct("o", "h", "at")).alias("l")).where("f <> l").select("mark")
    again = posted.drop("at").join(marks.hint("shuffle_hash"), "mark", "left_semi")
    windows = scratch.keep(again.select("o", "h", F.posexplode("keys").alias("k", "key"), "p").select("o", "h", (F.col("p") + F.col("k")).alias("p"), "key"))
    firsts = windows.groupBy("key").agg(F.min(F.struct("o", "h", "p")).alias("f"), F.max(F.struct("o", "h", "p")).alias("l"), F.count("*").alias("c")).where("f <> l").select("key", "f", "c")
    met = windows.join(firsts, "key").where(F.struct("o", "h", "p") != F.col("f"))
    pairs = met.groupBy("o", "h", F.col("f.o").alias("fo"), F.col("f.h").alias("fh")).agg(F.collect_set(F.struct("p", F.col("f.p").alias("q"))).alias("anchors"), F.max("c").alias("c"))
    # an original that many texts share is sent to several tasks, each with some of these
    pairs = scratch.keep(pairs.withColumn("part", F.pmod(F.xxhash64("o", "h"), F.ceil(F.col("c") / LATER_TEXTS)).cast("int")).drop("c"))
    once = lines.drop("posted").dropDuplicates(["o", "h"])
    firsts = pairs.select("fo", "fh", "part").distinct().join(once.select(F.col("o").alias("fo"), F.col("h").alias("fh"), F.col("code").alias("first")), ["fo", "fh"])
    whole = pairs.join(once.select("o", "h", "code", "number"), ["o", "h"]).join(firsts, ["fo", "fh", "part"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (code, x), (number, _), (first, y), (_, z) = (_lists(b[c]) for c in ("code", "number", "first", "anchors"))
            p, q = (b["anchors"].flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            out = []
            for i in range(len(b)):
                start, end = _extend(code[x[i] : x[i + 1]], first[y[i] : y[i + 1]], p[z[i] : z[i + 1]], q[z[i] : z[i + 1]])
                own = number[x[i] : x[i + 1]]
                out.append((own[start], own[end - 1]))
            yield pa.RecordBatch.from_arrays([b["o"], b["h"], _ranges(out)], ["o", "h", "cut"])

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, borders = _lists(b["cut"])
            a, e = (b["cut"].flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            out = []
            for i in range(len(b)):
                start, end = _merged(a[borders[i] : borders[i + 1]], e[borders[i] : borders[i + 1]] + 1, 1)
                out.append((start, end - 1))
            yield pa.RecordBatch.from_arrays([b["__o"], b["__h"], _ranges(out)], ["__o", "__h", "__cut"])

    cuts = whole.select("o", "h", "code", "number", "first", "anchors").mapInArrow(W.frugal(match), f"o long, h long, cut {CUT}")
    cuts = cuts.groupBy(F.col("o").alias("__o"), F.col("h").alias("__h")).agg(F.flatten(F.collect_list("cut")).alias("cut"))
    cuts = scratch.keep(cuts.mapInArrow(W.frugal(union), f"__o long, __h long, __cut {CUT}"))
    scratch.drop(lines)
    joined = docs.select(*[F.col(f"`{c}`") for c in old], *identity).join(cuts.hint("merge"), ["__o", "__h"], "left")
    split = F.split(value, "\n")
    none = F.array().cast(CUT)
    cut = F.coalesce(F.col("__cut"), none)
    gone = F.aggregate(cut, F.lit(0), lambda n, x: n + x["b"] - x["a"] + 1)
    edge = F.concat(cut, F.array(F.struct(F.size(split).alias("a"), F.size(split).alias("b"))))
    kept = F.flatten(F.transform(edge, lambda x, i: F.slice(split, F.when(i > 0, F.get(edge, i - 1)["b"] + 2).otherwise(1), F.greatest(x["a"] - F.when(i > 0, F.get(edge, i - 1)["b"] + 1).otherwise(0), F.lit(0)))))
    names = F.array_join(F.transform(cut, lambda x: F.concat_ws("-", x["a"].cast("string"), x["b"].cast("string"))), ",")
    return joined.select(
        *[F.col(f"`{c}`") for c in old], F.size(split).cast("long").alias("n_lines"), gone.cast("long").alias("n_dropped"), names.alias("dropped"),
        F.when(F.col("__cut").isNull(), value).otherwise(F.array_join(kept, "\n")).alias("cleaned"),
    )


def digest(docs: DataFrame) -> DataFrame:
    return drop_repeats(docs.select(F.col("doc_id").cast("long"), "text")).drop("text").withColumnRenamed("cleaned", "text")
