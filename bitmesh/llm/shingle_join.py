"""N-gram Jaccard self-join of documents by prefixes under several global orders.

A document's set holds the distinct five-word shingles of its text. Two sets
with a Jaccard similarity of t or more share a token of their prefixes, the
first n - ceil(t * n) + 1 tokens, under every global order of the tokens. The
orders here sort frequent tokens last, by their counts, and the others by
independent hashes.

1. Frequent tokens are found by counting token fingerprints over all texts.
2. A second scan of all texts gives each one's set size, a hash of its set and its
   prefixes. Documents with equal sets form a class; its smallest row key stands for it. The
   key is the doc_id, or a hash of doc_id and text if an id is null or repeated.
3. Every class posts its prefix under the first order. One of every token's
   classes is the hub, and the others are candidates with it: a star, not all
   pairs. What links already connect needs no further look.
4. Classes that share a posted token but no component yet are paired, but for
   those that sizes, counts of shared prefix tokens or the distances to their
   hub rule out (Jaccard distance is a metric).
5. A pair of step 3 or 4 stays a candidate if the prefixes under each further
   order meet too. For that only 32-bit marks of these prefixes travel, a fifth
   of what the sets would take; a chance equality of marks costs a comparison,
   never a pair.
6. The sets of what is left are compared whole; only their texts are scanned once more.

Joins of tables that grow with the input are sort merge joins at every size,
so the plan measured on a small input is the one that runs on a large one.
A hub goes to one task for about HUB_ROWS of its partners, and every set is
streamed, so neither a large group nor a long text fills a worker.

No step drops a pair with a similarity of t or more: pairs are left out only
if they are connected already or if a bound excludes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitmesh.llm import words as W
from bitmesh.llm.components import connected
from bitmesh.llm.frames import Scratch, prepare

SHINGLE, PERCENT = 5, 80
#: A token is frequent if more fingerprints than this are equal to its own.
FREQUENT = 32
#: Frequent tokens that are broadcast at most (8 bytes each). Beyond it, the bar for being frequent rises; the join stays exact under any order.
MOST_FREQUENT = 1 << 20
#: Bytes of fingerprints that one counting task holds at about.
COUNT_BYTES = 12 << 20
#: Bytes of text to a token, for the number of counting tasks: few texts have more tokens.
TOKEN_BYTES = 4
#: Fingerprints that a task holds at about before it sends them: 4 MB, and a few times that while they are sorted and packed.
HELD = 1 << 19
#: Classes that are compared with a hub in one task at about.
HUB_ROWS = 256
#: Tasks that one document's partners of the last step are dealt to.
REST_SALTS = 8
#: Random hubs of a large group at most, and nodes that make a bucket large.
HUBS, LARGE = 8, 16
#: Seeds of the orders after the first (fixed values).
ORDERS = (0x51ED270B27B5A3C5, 0x2545F4914F6CDD1D)
#: Bits of a fingerprint by which most rare tokens are told without a search (a table of 4 MB).
KNOWN_BITS = 22


def prefix_length(n: np.ndarray | int, percent: int = PERCENT):
    return n - (percent * n + 99) // 100 + 1


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _fingerprints(code: np.ndarray) -> np.ndarray:
    """48 bits of a token's hash, by which tokens are counted."""
    return code >> W.U64(16)


def _frequent(docs: DataFrame, tokens: int, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of frequent tokens, sorted, and their counts.

    Each task packs the fingerprints of its texts by range; a range's counts
    meet in one task of about COUNT_BYTES, however skewed the tokens are,
    because a task sends each fingerprint once with the number of its
    occurrences, up to 255 at a time.
    """
    ranges = max(8, -(-int(tokens * 7) // COUNT_BYTES))
    width = -(-(2**48) // ranges)

    def emit(code: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(code)
        code.clear()
        every.sort()
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        mark, count = every[first], np.diff(np.r_[first, len(every)])
        del every, first
        lines = -(-count // 255)
        count = np.where(np.arange(lines.sum()) == np.repeat(np.cumsum(lines) - 1, lines), np.repeat(count - (lines - 1) * 255, lines), 255)
        mark = np.repeat(mark, lines)
        bounds = np.searchsorted(mark, np.arange(ranges + 1, dtype=np.uint64) * W.U64(width))
        raw = np.empty((len(mark), 7), np.uint8)
        raw[:, :6] = mark.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
        raw[:, 6] = count
        full = np.flatnonzero(np.diff(bounds))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([raw[bounds[k] : bounds[k + 1]].tobytes() for k in full.tolist()], pa.binary())], ["range", "packed"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            held.append(_fingerprints(W.shingle_runs(W.scan(b["text"]), SHINGLE)[0]))
            if sum(map(len, held)) > HELD:
                yield from emit(held)
        if any(map(len, held)):
            yield from emit(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []

        def told() -> pa.RecordBatch:
            wide = np.zeros((sum(map(len, held)), 8), np.uint8)
            np.concatenate(held, out=wide[:, 1:])
            every = wide.view(">u8").ravel().astype(np.uint64)  # a fingerprint, and behind it a number of its occurrences
            del wide
            every.sort()
            mark = every >> W.U64(8)
            first = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]])
            total = np.add.reduceat(every & W.U64(255), first).astype(np.int64)
            often = total > frequent
            return pa.RecordBatch.from_arrays([pa.array(mark[first[often]].astype(np.int64)), pa.array(total[often])], ["mark", "total"])

        for b in batches:
            for r, packed in zip(b["range"].to_pylist(), b["packed"], strict=True):
                if r != here and held:
                    yield told()
                    held = []
                here = r
                held.append(np.frombuffer(packed.as_buffer(), np.uint8).reshape(-1, 7))
        if held:
            yield told()

    packed = docs.select("text").mapInArrow(W.frugal(pack), "range long, packed binary")
    counts = packed.repartition(min(ranges, 4096), "range").sortWithinPartitions("range").mapInArrow(W.frugal(count), "mark long, total long")
    rows = counts.orderBy(F.desc("total"), "mark").limit(MOST_FREQUENT).toArrow()
    mark, total = rows["mark"].to_numpy().astype(np.uint64), rows["total"].to_numpy().astype(np.uint64)
    order = np.argsort(mark)
    return mark[order], total[order]


def _late(code: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the frequent tokens stand, and their counts. ``known`` tells the first KNOWN_BITS bits of frequent fingerprints, so few others are looked up."""
    marks, totals = frequent
    found = _fingerprints(code)
    late = np.flatnonzero(known[found >> W.U64(48 - KNOWN_BITS)])
    found = found[late]
    at = np.minimum(np.searchsorted(marks, found), max(len(marks) - 1, 0))
    same = marks[at] == found
    return late[same], totals[at[same]]


def _order(code: np.ndarray, late: np.ndarray, count: np.ndarray, seed: int) -> np.ndarray:
    """Sort keys of tokens under an order: rare tokens by hash, then frequent ones by count and hash. The highest bit tells the latter."""
    spread = W.mix(code ^ W.U64(seed)) if seed else code
    key = spread >> W.U64(1)
    key[late] = W.U64(1 << 63) | np.minimum(count, W.U64((1 << 23) - 1)) << W.U64(40) | spread[late] >> W.U64(24)
    return key


def _marks(key: np.ndarray, borders: np.ndarray, size: np.ndarray, prefix: np.ndarray) -> pa.Array:
    """32-bit marks of each set's prefix under a further order, as lists: 32 bits of the hash that the keys hold. ``key`` is left in another order."""
    for a, b, n in zip(borders[:-1].tolist(), borders[1:].tolist(), size.tolist(), strict=True):
        if n < b - a:
            key[a:b].partition(n - 1)
    mine = key[np.repeat(borders[:-1] - prefix[:-1], size) + np.arange(prefix[-1])]
    marks = np.where(mine >= W.U64(1 << 63), mine >> W.U64(8), mine >> W.U64(31)).astype(np.uint32)
    return pa.ListArray.from_arrays(pa.array(prefix, pa.int32()), pa.array(marks.view(np.int32)))


def _digests(docs: DataFrame, frequent) -> DataFrame:
    """All that is needed of each text until sets are compared, by one scan.

    ``n``: its set's size, ``rare``: how many of its tokens are rare, ``k1, k2``:
    a 128-bit hash of the set, ``tokens``: the prefix under the first order, in
    order, ``p1, p2``: the marks of the prefixes under the further orders.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(1 << KNOWN_BITS, bool)
        known[frequent.value[0] >> W.U64(48 - KNOWN_BITS)] = True
        for b in batches:
            code, borders = W.shingles(W.scan(b["text"]), SHINGLE)
            n = np.diff(borders)
            sums = []
            for salt in (1, 2):
                total = np.r_[W.U64(0), np.cumsum(W.mix(code + W.U64(salt)))]
                sums.append(pa.array((total[borders[1:]] - total[borders[:-1]]).view(np.int64)))
            late, count = _late(code, frequent.value, known)
            owner = np.searchsorted(borders, late, "right") - 1
            often = np.bincount(owner, minlength=len(n))
            rare = n - often
            size = np.where(n > 0, prefix_length(n), 0)
            prefix = np.r_[0, np.cumsum(size)]
            # a text's tokens come sorted by hash, so that only the frequent ones have to be sorted and moved behind the others
            tokens = np.zeros(prefix[-1], np.uint64)
            first = np.minimum(rare, size)
            others = np.delete(code, late)
            within = np.arange(first.sum()) - np.repeat(np.cumsum(first) - first, first)
            tokens[np.repeat(prefix[:-1], first) + within] = others[np.repeat(np.cumsum(rare) - rare, first) + within]
            order = np.lexsort((_order(code[late], np.arange(len(late)), count, 0), owner))
            place = rare[owner] + np.arange(len(late)) - np.repeat(np.cumsum(often) - often, often)
            mine = np.flatnonzero(place < size[owner])
            tokens[prefix[owner[mine]] + place[mine]] = code[late[order[mine]]]
            lists = pa.ListArray.from_arrays(pa.array(prefix, pa.int32()), pa.array(tokens.view(np.int64)))
            marks = [_marks(_order(code, late, count, seed), borders, size, prefix) for seed in ORDERS]
            yield pa.RecordBatch.from_arrays([b["doc"], b["id"], pa.array(n), pa.array(rare.astype(np.int32)), *sums, lists, *marks], ["doc", "id", "n", "rare", "k1", "k2", "tokens", "p1", "p2"])

    return docs.mapInArrow(W.frugal(run), "doc long, id long, n long, rare int, k1 long, k2 long, tokens array<long>, p1 array<int>, p2 array<int>")


def _sizes_fit(n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _overlap(n: Column, m: Column) -> Column:
    """The least intersection of sets of these sizes that are linked."""
    return F.ceil(PERCENT * (n + m) / (100 + PERCENT))


def _may_link(x: str, y: str) -> Column:
    """Whether a token that two sets share can make them candidates.

    Sets that share frequent tokens alone can't share more of them than the
    smaller number that they have. If that is not enough, they also share a
    rare token; as frequent tokens come last, all rare ones are posted, and
    the pair is met there.
    """
    n, m, r, q = (F.col(f"{t}.{c}") for c in ("n", "rare") for t in (x, y))
    return _sizes_fit(n, m) & (~F.col(f"{x}.late") | (F.least(n - r, m - q) >= _overlap(n, m)))


def _meet_here(x: str, y: str) -> Column:
    """Whether two sets are paired by a token that they share: a rare one, or a frequent one that could be the first of all that they share. What stands before the first one in either set is not shared."""
    n, m, p, q = (F.col(f"{t}.{c}") for c in ("n", "place") for t in (x, y))
    return _sizes_fit(n, m) & (~F.col(f"{x}.late") | (F.least(n - p, m - q) >= _overlap(n, m)))


def _candidates(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Those of the pairs ``hub, node, salt`` whose prefixes meet under every further order."""
    hubs = pairs.select("hub", "salt").distinct().join(marks.select(F.col("doc").alias("hub"), F.col("p1").alias("q1"), F.col("p2").alias("q2")).hint("merge"), "hub")
    both = pairs.join(marks.withColumnRenamed("doc", "node").hint("merge"), "node").join(hubs.hint("merge"), ["hub", "salt"])
    return both.where(F.arrays_overlap("p1", "q1") & F.arrays_overlap("p2", "q2")).select("hub", "node", "salt")


def _compare(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``hub, node, shared, n, m`` of the pairs ``hub, node, salt``: size of the intersection and of both sets.

    A hub's set goes once to each of its salts, a node's set once to each of
    its hubs. Rows go out one by one, so a worker holds a batch of sets and
    the bytes of one message, however many tasks need a set.
    """
    needs = pairs.select(F.col("node").alias("doc"), "hub", "salt", F.lit(1).alias("side")).unionByName(pairs.select(F.col("hub").alias("doc"), "hub", "salt", F.lit(0).alias("side")).distinct())
    sent = needs.join(sets.hint("merge"), "doc").select("hub", "salt", "side", "doc", "set")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", "side", "doc")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, hub = None, np.zeros(0, np.uint64)
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for h, salt, side, doc, packed in zip(*(batch[c].to_pylist() for c in ("hub", "salt", "side", "doc")), batch["set"], strict=True):
                code = np.frombuffer(packed.as_buffer(), np.uint64)
                if side == 0:
                    here, hub = (h, salt), code.copy()
                elif here == (h, salt):
                    out.append((h, doc, int(_in(code, hub).sum()), len(hub), len(code)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["hub", "node", "shared", "n", "m"])

    return sent.mapInArrow(W.frugal(meet), "hub long, node long, shared long, n long, m long")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``doc, set`` of the texts that ``nodes`` names: token hashes in order, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, borders = W.shingles(W.scan(b["text"]), SHINGLE)
            raw = memoryview(code.tobytes())
            yield pa.RecordBatch.from_arrays([b["doc"], pa.array([raw[8 * x : 8 * y] for x, y in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)], pa.binary())], ["doc", "set"])

    return docs.join(nodes, "doc", "left_semi").mapInArrow(W.frugal(run), "doc long, set binary")


def _verify(docs: DataFrame, pairs: DataFrame, marks: DataFrame, scratch: Scratch, repeated: bool) -> DataFrame:
    """Compares the pairs that are candidates under every further order too; ``repeated`` tells whether rows may share a key, and with it their text."""
    pairs = scratch.keep(_candidates(pairs, marks))
    nodes = scratch.keep(pairs.select(F.explode(F.array("hub", "node")).alias("doc")).distinct())
    sets = _sets(docs, nodes)
    return _compare(sets.dropDuplicates(["doc"]) if repeated else sets, pairs)


LINKED = f"100 * shared >= {PERCENT} * (n + m - shared)"


def row_key(docs: DataFrame) -> tuple[Column, bool]:
    """What tells rows with different ids or texts apart, and whether any doc_id is null or repeated."""
    doc_id = F.col("doc_id").cast("long")
    shared = not docs.select(doc_id.alias("id")).groupBy("id").agg(F.count("*").alias("c")).where("id IS NULL OR c > 1").isEmpty()
    return (F.xxhash64(doc_id, F.coalesce(F.col("text").cast("string"), F.lit(""))) if shared else doc_id), shared


def link(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each document.

    component_id is the smallest doc_id that links reach. A null or empty text
    has no shingles and is linked with nothing; its component is itself. Rows
    that share a doc_id count as one document that has each of their links.
    Rows with a null doc_id have the links of their own text alone; a
    component without any doc_id shows as null. An empty table gives no rows;
    other columns are ignored.
    """
    key, shared = row_key(docs)
    scratch = Scratch(docs.sparkSession)
    out = _reach(docs, key, scratch, by_id=shared, repeated=shared)
    label = F.col("component")
    if shared:
        out = scratch.keep(out)
        out = out.join(out.groupBy("component").agg(F.min("doc_id").alias("label")), "component")
        label = F.col("label")
    return out.select("doc_id", F.col("n").alias("n_shingles"), label.alias("component_id"))


def link_rows(docs: DataFrame, key: Column, repeated: bool = True) -> DataFrame:
    """``row, doc_id, n, component`` by the texts of rows alone, whatever ids they share: ``row`` is the key of row_key, ``component`` the smallest one that links reach."""
    return _reach(docs, key, Scratch(docs.sparkSession), by_id=False, repeated=repeated)


def _reach(docs: DataFrame, key: Column, scratch: Scratch, by_id: bool, repeated: bool) -> DataFrame:
    spark = docs.sparkSession
    prepare(spark)
    every = docs.select(key.alias("doc"), F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = every.select("doc", "text")
    tokens = (every.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // TOKEN_BYTES
    frequent = spark.sparkContext.broadcast(_frequent(own, tokens))  # at most MOST_FREQUENT numbers and their counts
    scratch.tidy()
    digests = scratch.keep(_digests(every, frequent))
    sets = scratch.keep(digests.select("doc", "id", "n", "k1", "k2"))
    classes = scratch.keep(sets.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc").alias("node")))
    copies = scratch.keep(sets.where("n > 0").join(classes.hint("merge"), ["k1", "k2", "n"]).where("doc <> node").select(F.col("node").alias("a"), F.col("doc").alias("b")).distinct())
    # of every class one row goes on
    first = digests.join(classes.select(F.col("node").alias("doc")).hint("merge"), "doc", "left_semi").select("doc", "n", "rare", "tokens", "p1", "p2")
    first = scratch.keep(first.dropDuplicates(["doc"]) if repeated else first)
    scratch.drop(digests)
    # Rows of a token that stands once go. Each row looks at its neighbours in the token's group, so postings are dealt once and not written before.
    beside = Window.partitionBy("token").orderBy("node")
    met = first.select(F.col("doc").alias("node"), F.col("n").cast("int").alias("n"), "rare", F.posexplode("tokens").alias("place", "token"))
    met = met.withColumn("before", F.lag("node").over(beside)).withColumn("after", F.lead("node").over(beside))
    met = met.where("before IS NOT NULL OR after IS NOT NULL")
    shared = scratch.keep(met.select("token", (F.col("place") >= F.col("rare")).alias("late"), "node", "n", "rare", "place"))
    nodes = scratch.keep(shared.select(F.col("node").alias("doc")).distinct())
    marks = scratch.keep(first.select("doc", "p1", "p2").join(nodes.hint("merge"), "doc", "left_semi"))
    scratch.drop(first)
    # The node with the fewest rare tokens stands in the middle of its group. Some tokens of large groups have other hubs, by HUBS random orders.
    order = F.pmod(F.xxhash64("token"), F.lit(2 * HUBS)).cast("int")
    middle = F.shiftleft(F.col("rare").cast("long"), 40).bitwiseOR(F.xxhash64("node").bitwiseAND(F.lit((1 << 40) - 1)))
    hubs = shared.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("c"), F.min_by("node", middle).alias("m"), F.min_by("node", F.xxhash64("node", order)).alias("r")).where("lo <> hi")
    hubs = hubs.select("token", "c", F.when((F.col("c") >= LARGE) & (order < HUBS), F.col("r")).otherwise(F.col("m")).alias("hub"))
    met = scratch.keep(shared.join(hubs.hint("merge"), "token"))
    scratch.drop(shared)
    x, y = met.alias("x"), met.where("node = hub").select("token", "n", "rare").alias("y")
    star = x.where("node <> hub").join(y.hint("merge"), F.col("x.token") == F.col("y.token")).where(_may_link("x", "y")).select("x.hub", "x.node", "x.c")
    # a pair that meets under several tokens is dealt by its larger bucket's hub, in as many salts as that bucket asks for
    star = star.groupBy(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).agg(F.max(F.struct("c", "hub")).alias("h"))
    salt = F.pmod(F.xxhash64("a", "b"), F.ceil(F.col("h.c") / HUB_ROWS)).cast("int").alias("salt")
    star = scratch.keep(star.select(F.col("h.hub").alias("hub"), F.when(F.col("a") == F.col("h.hub"), F.col("b")).otherwise(F.col("a")).alias("node"), salt))
    compared = scratch.keep(_verify(own, star, marks, scratch, repeated))
    links = compared.where(LINKED).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    parts = scratch.keep(connected(links, scratch))

    # buckets whose classes are not connected yet
    apart = (F.col("n") + F.col("m") - 2 * F.col("shared")) / (F.col("n") + F.col("m") - F.col("shared"))
    distance = compared.select("hub", "node", apart.alias("d")).unionByName(compared.select(F.col("node").alias("hub"), F.col("hub").alias("node"), apart.alias("d")))
    open_ = met.join(parts.hint("merge"), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    mixed = open_.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("token")
    open_ = open_.join(mixed.hint("merge"), "token", "left_semi").join(distance.hint("merge"), ["hub", "node"], "left")
    open_ = scratch.keep(open_.select("token", "late", "node", "n", "rare", "place", "part", F.when(F.col("node") == F.col("hub"), 0.0).otherwise(F.col("d")).alias("d")))
    x, y = open_.alias("x"), open_.alias("y")
    near = F.coalesce(F.abs(F.col("x.d") - F.col("y.d")) <= (100 - PERCENT) / 100 + 1e-9, F.lit(True))
    rest = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.part") != F.col("y.part")) & _meet_here("x", "y") & near)
    names = {"a": "x.node", "b": "y.node", "n": "x.n", "m": "y.n", "r": "x.rare", "q": "y.rare"}
    rest = rest.groupBy(*[F.col(c).alias(k) for k, c in names.items()]).agg(F.count("*").alias("c"))
    n, m, r, q = map(F.col, "nmrq")
    size = lambda n: n - F.ceil(PERCENT * n / 100) + 1
    # Frequent tokens alone may link the two, or the number of rare ones that they share has a bound: by what frequent ones can add, or, where
    # the shorter prefix ends with a rare token, by what follows it.
    by_rare = _overlap(n, m) - F.least(n - r, m - q)
    by_place = F.least(_overlap(n, m) - n + size(n), _overlap(n, m) - m + size(m))
    need = F.when(by_rare <= 0, F.lit(1)).when((r >= size(n)) | (q >= size(m)), by_place).otherwise(by_rare)
    # a pair of the star that is still apart has been compared or ruled out
    seen = star.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    rest = rest.where(F.col("c") >= need).select("a", "b").distinct().join(seen, ["a", "b"], "left_anti")
    rest = scratch.keep(rest.select(F.col("a").alias("hub"), F.col("b").alias("node"), F.pmod(F.xxhash64("b"), F.lit(REST_SALTS)).cast("int").alias("salt")))
    more = scratch.keep(_verify(own, rest, marks, scratch, repeated).where(LINKED).select(F.col("hub").alias("a"), F.col("node").alias("b")))
    edges = links.unionByName(more).unionByName(copies)
    if by_id:
        rows = sets.where("id IS NOT NULL").select("id", "doc").distinct()
        edges = edges.unionByName(rows.join(rows.groupBy("id").agg(F.min("doc").alias("a")), "id").where("doc <> a").select("a", F.col("doc").alias("b")))
    out = sets.join(connected(edges, scratch).withColumnRenamed("node", "doc"), "doc", "left")
    return out.select(F.col("doc").alias("row"), F.col("id").alias("doc_id"), "n", F.coalesce("component", "doc").alias("component"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n, b.n AS m, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p WHERE 100 * c >= 80 * (n + m - c)
), both_ways AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION SELECT b.y, r.root FROM reach r JOIN both_ways b ON b.x = r.node
), c AS (
  SELECT node, min(root) AS component_id FROM reach GROUP BY node
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id FROM s JOIN c ON c.node = s.doc_id
"""
