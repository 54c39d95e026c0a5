"""Best-fit-decreasing packing of tokenised documents into windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitmesh.llm.frames import LARGE_BATCH, Scratch, prepare
from bitmesh.llm.tokens import VOCABULARY, IdStore, units

WINDOW, END_ID = 4096, 2
#: Pieces that are packed together at most about; more only save part of a window for each group.
GROUP_PIECES = 1 << 16


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree whose nodes tell whether any window lies below."""

    def __init__(self, capacity: int):
        self.half = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.half)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, window: int) -> None:
        self.stacks[room].append(window)
        node = room + self.half
        while node and not self.some[node]:
            self.some[node] = 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The room and number of the window with the least room that is enough; None if there is none."""
        node = length + self.half
        if not self.some[node]:
            while node > 1 and (node & 1 or not self.some[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.half:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        room = node - self.half
        window = self.stacks[room].pop()
        if not self.stacks[room]:
            self.some[node] = 0
            node >>= 1
            while node and not (self.some[2 * node] or self.some[2 * node + 1]):
                self.some[node] = 0
                node >>= 1
        return room, window


def best_fit(lengths: np.ndarray, capacity: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; the lengths come in falling order."""
    windows, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free, made = OpenWindows(capacity), 0
    for k, n in enumerate(lengths.tolist()):
        room, window = free.take(n) or (capacity, made)
        made += window == made
        windows[k], offsets[k] = window, capacity - room
        if room > n:
            free.put(room - n, window)
    return windows, offsets


def cut_tokens(docs: DataFrame, window: int = WINDOW, end_id: int | None = END_ID, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenises every text and cuts it into full windows and a rest: ``doc_id, start, length, ids_crc32, doc_tokens`` and, if asked for, ``ids`` (unsigned 32-bit, little-endian)."""
    prepare(docs.sparkSession, LARGE_BATCH)
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = IdStore(path, end_id)
        for b in batches:
            ids, borders = store.encode(units(b["text"]))
            total = np.diff(borders)
            pieces = -(-total // window)
            row = np.repeat(np.arange(len(total)), pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
            length = np.minimum(window, total[row] - start)
            raw = memoryview(ids.astype("<u4").tobytes())
            a = (borders[row] + start) * 4
            parts = [raw[x:y] for x, y in zip(a.tolist(), (a + 4 * length).tolist(), strict=True)]
            columns = [b["doc_id"].take(pa.array(row)), pa.array(start), pa.array(length), pa.array(np.array([zlib.crc32(p) for p in parts], np.int64)), pa.array(total[row])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array([bytes(p) for p in parts], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, window: int = WINDOW, end_id: int | None = END_ID, path: str | None = None, with_ids: bool = False, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Packs all documents into sequences of at most ``window`` tokens: the pieces of ``cut_tokens`` with ``sequence_id, offset``.

    Overlong documents are first cut into full windows, each a sequence of its
    own; the rests are packed best fit decreasing. Packing goes on in groups
    of about ``group_pieces`` pieces dealt out by hash, so that no task holds
    more; each group leaves at most a few windows part empty. Sequence ids are
    the group's number times 2**32 plus the window's.

    Null and empty texts are documents of the end id alone. Repeated rows are
    separate documents; ties in length are broken by doc_id, start and
    checksum, so a repeated task gives the same rows. An empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    pieces = scratch.keep(cut_tokens(docs, window, end_id, path, with_ids))
    groups = max(1, -(-pieces.count() // group_pieces))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        where, offset = best_fit(pdf["length"].to_numpy(), window)
        return pdf.assign(sequence_id=(pdf["packing_group"].to_numpy(np.int64) << 32) + where, offset=offset).drop(columns="packing_group")

    dealt = pieces.withColumn("packing_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("int"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("packing_group").applyInPandas(place, f"{kinds}, sequence_id long, offset long")
