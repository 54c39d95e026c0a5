r"""Benchmark decontamination with an FM-index for each training shard.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z. A window
is ten consecutive words of a benchmark item; an item of fewer words is one
window. A shard is what a task has read of the training texts, up to
``SHARD_BYTES``. Its index holds the runs of words that some window uses and
that are long enough for one; no occurrence lies outside of these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitmesh.llm import words as W
from bitmesh.llm.fm_index import FMIndex
from bitmesh.llm.frames import Scratch, prepare

WINDOW = 10
SHARD_BYTES = 48 << 20
#: Bytes of benchmark text that are searched for in one pass, and held by the driver and each worker at a time; more go in blocks, one pass each.
BLOCK_BYTES = 4 << 20
SEARCH_ROWS = 1 << 18


class Phrases:
    """Distinct windows of a block of benchmark items, as rows of word numbers by length, and the items that have them."""

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW):
        words = W.scan(pa.array(texts, pa.large_string()), W.NOT_ALNUM)
        self.ids = ids
        self.vocabulary, numbers = np.unique(words.code, return_inverse=True)
        numbers = numbers + 1
        self.likely = np.zeros(1 << 16, bool)
        self.likely[(self.vocabulary & W.U64(0xFFFF)).astype(np.int64)] = True
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item in range(len(ids)):
            own = numbers[words.first[item] : words.first[item + 1]]
            if len(own):
                n = min(window, len(own))
                by_length.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(own, n), item))
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for rows in by_length.values():
            patterns, back = np.unique(np.concatenate([r for r, _ in rows]).astype(np.int32), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([back.ravel(), np.concatenate([np.full(len(r), i) for r, i in rows])], 1), axis=0)
            self.groups.append((patterns, np.searchsorted(pairs[:, 0], np.arange(len(patterns) + 1)), pairs[:, 1]))
        self.shortest = min(by_length, default=0)

    def numbers(self, code: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for words that no window has."""
        out = np.zeros(len(code), np.int64)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.likely[(code & W.U64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, code[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[at] == code[maybe], at + 1, 0)
        return out

    def find(self, code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[set[int]]]:
        """Which words of a shard's texts are hit, and the items that occur in each text."""
        hit, items = np.zeros(len(code), bool), [set() for _ in range(len(first) - 1)]
        number = self.numbers(code)
        # runs of known words inside one text
        known = number > 0
        start = known & ~np.r_[False, known[:-1]]
        opens = first[:-1][first[:-1] < len(code)]
        start[opens] = known[opens]
        run = np.cumsum(start)[known] - 1
        places = np.flatnonzero(known)
        sizes = np.bincount(run) if len(run) else np.zeros(0, np.int64)
        long = sizes >= max(self.shortest, 1)
        places, run = places[long[run]], run[long[run]]
        if not len(places) or not self.groups:
            return hit, items
        slot = np.arange(len(places)) + np.cumsum(np.r_[False, run[1:] != run[:-1]])  # one 0 between runs
        sequence, origin = np.zeros(slot[-1] + 1, np.int64), np.full(slot[-1] + 1, -1)
        sequence[slot], origin[slot] = number[places], places
        index = FMIndex(sequence, len(self.vocabulary) + 1)
        text_of = W.owners(first)
        for patterns, borders, owners in self.groups:
            for at in range(0, len(patterns), SEARCH_ROWS):
                lo, hi = index.search(patterns[at : at + SEARCH_ROWS])
                found = np.flatnonzero(hi > lo)
                count = (hi - lo)[found]
                which = np.repeat(found + at, count)
                rows = np.repeat(lo[found] - np.cumsum(count) + count, count) + np.arange(count.sum())
                words = origin[index.locate(rows)]
                for k in range(patterns.shape[1]):
                    hit[words + k] = True
                for text, pattern in np.unique(np.stack([text_of[words], which], 1), axis=0).tolist():
                    items[text].update(owners[borders[pattern] : borders[pattern + 1]].tolist())
        return hit, items


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    return b"".join(parts).decode()


def _clean(raw: bytes, spans: list[tuple[int, int]], phrases: Phrases | None) -> str:
    """The text without the spans, and without occurrences of these phrases that only the cuts have made."""
    text = _cut(raw, spans)
    while True:
        words = W.scan(pa.array([text], pa.large_string()), W.NOT_ALNUM)
        hit = phrases.find(words.code, words.first)[0] if phrases else np.zeros(0, bool)
        if not hit.any():
            return text
        text = _cut(text.encode(), _spans(words, hit, 0))


def _spans(words: W.Words, hit: np.ndarray, text: int) -> list[tuple[int, int]]:
    """Byte borders of the merged runs of hit words of a text."""
    a, b = words.first[text], words.first[text + 1]
    own = hit[a:b]
    starts = np.flatnonzero(own & ~np.r_[False, own[:-1]]) + a
    ends = np.flatnonzero(own & ~np.r_[own[1:], False]) + a
    base = words.offsets[text]
    return list(zip((words.start[starts] - base).tolist(), (words.end[ends] - base).tolist(), strict=True))


OWN = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "cleaned"]
#: What goes from one block's pass to the next: a bit for each word, and the items found.
STATE = ["__hit", "__found"]


def _pass(docs: DataFrame, block: Broadcast, with_text: bool, first: bool, last: bool) -> DataFrame:
    """Searches every shard of the documents for one block of phrases; the last pass gives the result columns instead of the state."""
    names = [c for c in docs.columns if c not in STATE]

    def shard(batches: list[pa.RecordBatch], phrases: Phrases) -> Iterator[pa.RecordBatch]:
        scanned = [W.scan(b["text"], W.NOT_ALNUM) for b in batches]
        code = np.concatenate([w.code for w in scanned])
        counts = np.concatenate([np.diff(w.first) for w in scanned])
        borders = np.r_[0, np.cumsum(counts)]
        hit, items = phrases.find(code, borders)
        found = [{phrases.ids[i] for i in x} for x in items]
        if not first:
            before = [x for b in batches for x in zip(b["__hit"].to_pylist(), b["__found"].to_pylist(), strict=True)]
            for i, (bits, ids) in enumerate(before):
                if ids:
                    hit[borders[i] : borders[i + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=int(counts[i])).astype(bool)
                    found[i].update(ids)
        n_hit = np.diff(np.r_[0, np.cumsum(hit)][borders])
        row = 0
        for b, words in zip(batches, scanned, strict=True):
            n = len(b)
            own, ids, hits = hit[borders[row] : borders[row + n]], found[row : row + n], n_hit[row : row + n]
            if last:
                digests = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in ids]
                new = [pa.array(np.diff(words.first)), pa.array(hits), pa.array([len(x) for x in ids], pa.int64()), pa.array(digests, pa.string()), pa.array(hits > 0)]
                if with_text:
                    texts = b["text"]
                    if hits.any():
                        values, raw = texts.to_pylist(), words.buf.tobytes()
                        for i in np.flatnonzero(hits).tolist():
                            values[i] = _clean(raw[words.offsets[i] : words.offsets[i + 1]], _spans(words, own, i), phrases if first else None)
                        texts = pa.array(values, pa.string())
                    new.append(texts)
            else:
                bits = [np.packbits(own[x:y]).tobytes() if h else b"" for x, y, h in zip(words.first[:-1], words.first[1:], hits, strict=True)]
                new = [pa.array(bits, pa.binary()), pa.array([sorted(x) for x in ids], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), *new], [*names, *(OWN[: len(new)] if last else STATE)])
            row += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = block.value
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= SHARD_BYTES:
                yield from shard(held, phrases)
                held, size = [], 0
        if held:
            yield from shard(held, phrases)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in STATE)
    new = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + ", cleaned string" * with_text
    return docs.mapInArrow(run, f"{kinds}, {new if last else '__hit binary, __found array<string>'}")


def find_contamination(docs: DataFrame, benchmark: DataFrame, with_text: bool = False, window: int = WINDOW) -> DataFrame:
    """Adds ``n_words, n_hit, n_items, items_sha256, contaminated`` to the documents; with ``with_text`` also ``cleaned``, the text without the hit spans.

    The benchmark is a stated query set. It is taken in blocks of about
    BLOCK_BYTES of text (a longer item is a block), one after the other: the
    driver and the workers hold one block at a time, however large the
    benchmark is. One block takes one pass over the documents, which are
    neither shuffled nor joined; of several blocks, each takes a pass that
    hands on which words were hit. Where cuts out of a text have joined the
    ends of further occurrences, these are cut too.

    Null texts have no words. Items without words occur nowhere; items with
    the same id count once, a null id counts as an empty one. Repeated
    documents are judged each; other columns pass through, and columns named
    like new ones are replaced; an empty table on either side gives no hits.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop(*OWN, *STATE, "__row").withColumn("text", F.col("text").cast("string"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = max(1, -(-size // BLOCK_BYTES))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))

    def block(k: int) -> Broadcast:
        rows = items.where(number == k).distinct().collect()  # BLOCK_BYTES at about
        return spark.sparkContext.broadcast(Phrases([r["item_id"] for r in rows], [r["text"] for r in rows], window))

    if count == 1:
        return _pass(docs, block(0), with_text, True, True)
    scratch = Scratch(spark)

    def searched(docs: DataFrame) -> DataFrame:
        for k in range(count):
            phrases = block(k)
            docs = scratch.keep(_pass(docs, phrases, with_text, k == 0, k == count - 1))
            phrases.destroy()
        return docs

    out = searched(docs)
    if not with_text:
        return out
    out = scratch.keep(out.withColumn("__row", F.monotonically_increasing_id()))
    clean, open_ = [], out.where("contaminated").select("__row", F.col("cleaned").alias("text"))
    while not open_.isEmpty():
        step = searched(open_)
        clean.append(step.where("NOT contaminated").select("__row", F.col("cleaned").alias("__found")))
        open_ = step.where("contaminated").select("__row", F.col("cleaned").alias("text"))
    if clean:
        out = out.join(reduce(DataFrame.unionByName, clean), "__row", "left").withColumn("cleaned", F.coalesce("__found", "cleaned")).drop("__found")
    return out.drop("__row")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (
  SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), m AS (
  SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON bw.g = dw.g AND bw.n = dw.n
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_contamination(docs.select(F.col("doc_id").cast("long"), "text"), benchmark).drop("text")
