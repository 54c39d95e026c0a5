"""Joins by blocks, which large tables take, on small ones against plain counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitmesh.functions import compare
from bitmesh.operators import approx, blocks, pairs
from bitmesh.plans.chunks import Plan
from bitmesh.sources import generate
from bitmesh.sources.codes_io import from_numpy, to_tuples
from bitmesh.sources.shared import stored
from tests.test_pairs import brute, planted


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of a few rows, however small the table."""
    monkeypatch.setattr(pairs, "MOST_CANDIDATES", -1)
    monkeypatch.setattr(pairs, "NESTED_PAIRS", -1)
    monkeypatch.setattr(blocks, "LEAST_ROWS", 16)
    monkeypatch.setattr(blocks, "SPREAD", 4)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("d_bytes,k", [(8, 2), (8, 10), (13, 3), (32, 4), (40, 9), (128, 2)])
def test_self_and_cross_joins_by_blocks(spark, small_blocks, d_bytes, k):
    a, b = planted(80, d_bytes, k), planted(50, d_bytes, k, 1)
    codes, other = from_numpy(spark, a), from_numpy(spark, np.concatenate([b, a[:9]]))
    truth, crossed = brute(a, k=k), brute(a, np.concatenate([b, a[:9]]), k)
    assert truth and crossed
    for join in [pairs.find_pairs_self_bit, pairs.find_pairs_self_adaptive, pairs.find_pairs_brute] + [pairs.find_pairs_self] * (k < d_bytes):
        found = join(codes, k, d_bytes)
        assert "MapInArrow" in plan_of(found) and to_tuples(found) == truth, join.__name__
    for join in [pairs.find_pairs_cross_bit, pairs.find_pairs_cross_brute] + [pairs.find_pairs_cross] * (k < d_bytes):
        assert to_tuples(join(codes, other, k, d_bytes)) == crossed, join.__name__


def test_rows_of_one_id_and_without_one(spark, small_blocks):
    """Equal ids are no pair of a self join; a row without an id pairs in a cross join alone. The same by Spark's join."""
    rows = [(1, b"\0" * 8), (1, b"\0" * 8), (2, b"\0" * 7 + b"\1"), (None, b"\0" * 8)] + [(i, bytes([i]) * 8) for i in range(3, 60)]
    codes = spark.createDataFrame(rows, "id bigint, code binary")
    told = lambda df: sorted(map(str, df.collect()))
    by_blocks = [told(pairs.find_pairs_self_bit(codes, 3, 8)), told(pairs.find_pairs_cross_bit(codes, codes, 3, 8))]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pairs, "MOST_CANDIDATES", 1e9)
        assert by_blocks == [told(pairs.find_pairs_self_bit(codes, 3, 8)), told(pairs.find_pairs_cross_bit(codes, codes, 3, 8))]
    assert sum("i=1, j=2" in r for r in by_blocks[0]) == 2 and any("None" in r for r in by_blocks[1])


def test_buckets_and_whole_tiles_find_the_same():
    """Large and small buckets, chunks within and across words, and tables in which chunks leave too much."""
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 64, (2, 700), np.uint64)
    words[:, 300:] = words[:, rng.integers(0, 9, 400)] ^ (np.uint64(1) << rng.integers(0, 64, (2, 400)).astype(np.uint64))
    dist = np.bitwise_count(words[:, :, None] ^ words[:, None, :]).sum(axis=0)
    for plan in (Plan.from_bits(16, 9), Plan(16, (tuple(range(50, 75)), (0, 3, 4, 9, 127))), Plan.from_bits(16, 60)):
        masks = plan.masks()
        met = np.zeros(dist.shape, bool)
        for m in masks:
            met |= np.all([(words[w][:, None] ^ words[w][None]) & np.uint64(x) == 0 for w, x in m.items()], axis=0)
        for k in (0, 4, 9):
            found = [np.stack([x, y, d]) for x, y, d in compare.within(words, words, k, masks)]
            x, y, d = np.concatenate(found, axis=1)
            assert (d == dist[x, y]).all() and len(set(zip(x, y, strict=True))) == len(x) == (met & (dist <= k)).sum()
    # keys of up to 16 bits are put together: equal if, and only if, the masked bits are
    mask = 0b1011 << 60 | 0b1 << 33 | 0b11101 << 7
    keys, masked = compare.chunk_keys(words, {0: mask}), words[0] & np.uint64(mask)
    assert keys.dtype == np.uint16 and ((keys[:, None] == keys) == (masked[:, None] == masked)).all()


def test_many_small_buckets_are_listed_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(compare, "LISTED", 7)
    n_a, n_b = np.array([1, 3, 2, 1]), np.array([2, 2, 5, 1])
    at_a, at_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    got = [(int(x), int(y)) for xs, ys in compare.listed(at_a, n_a, at_b, n_b) for x, y in zip(xs, ys, strict=True)]
    assert got == [(s + i // m, t + i % m) for s, n, t, m in zip(at_a, n_a, at_b, n_b, strict=True) for i in range(n * m)]


def unhindered(df):
    """No table goes to the driver to be sent around, and the join has a task for each two blocks."""
    return "Broadcast" not in plan_of(df) and "MapInArrow" in plan_of(df)


def test_lsh_sends_no_table_around(spark):
    """20 rows for each code were broadcast, as the files they come from are small."""
    a = generate.clustered(8000, 8, dup_fraction=0.1, noise_bits=3)
    found = approx.lsh_pairs(stored(from_numpy(spark, a)), 6, 20, 16, d_bytes=8)
    assert unhindered(found)
    tables = approx.sampled_bits(8, 20, 16)
    bits = np.unpackbits(a[:900], axis=1)
    met = {(i, j) for i, j, _ in brute(a[:900], k=6) if any((bits[i, t] == bits[j, t]).all() for t in tables)}
    assert {(i, j) for i, j, _ in to_tuples(found.where((F.col("i") < 900) & (F.col("j") < 900)))} == met


def test_large_chunk_joins_are_never_broadcast(spark, monkeypatch):
    """Chunks long enough for Spark's join: from a stated size on it shuffles both sides."""
    monkeypatch.setattr(pairs, "MOST_BROADCAST", 100)
    codes = stored(from_numpy(spark, planted(80, 32, 2)))
    assert "Broadcast" not in plan_of(pairs.find_pairs_self_bit(codes, 2, 32))
    assert to_tuples(pairs.find_pairs_self_bit(codes, 2, 32)) == brute(planted(80, 32, 2), k=2)


def test_recall_sets_tables_side_by_side_in_one_shuffle(spark):
    """both tables were made distinct and then joined, which may broadcast one of them."""
    found = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "i bigint, j bigint")
    truth = spark.createDataFrame([(1, 2), (5, 6), (5, 6), (7, 8)], "i bigint, j bigint")
    got = approx.recall(found, truth)
    assert "Join" not in plan_of(got)
    assert got.first().asDict() == {"found": 2, "truth": 3, "common": 1, "recall": 1 / 3}


#: The queries' joins at their radii, which have chunks of few bits.
JOINS = {
    "F3 self_qgram_simhash": lambda c: pairs.find_pairs_qgram_self(c, 3, 10, 8),
    "F6 cross_bit_simhash": lambda c: pairs.find_pairs_cross_bit(c, c, 9, 8),
    "F8 self_bit_simhash": lambda c: pairs.find_pairs_self_bit(c, 10, 8),
    "F10 within_simhash": lambda c: pairs.find_pairs_within(c, 8, return_distances=False, d_bytes=8),
    "F13 self_byte_simhash": lambda c: pairs.find_pairs_self(c, 6, 8),
    "F14 cross_brute_signs": lambda c: pairs.find_pairs_cross_brute(c, c, 16, 8),
    "F15 self_brute_signs": lambda c: pairs.find_pairs_brute(c, 20, 8),
    "F16 cross_byte_simhash": lambda c: pairs.find_pairs_cross(c, c, 5, 8),
    "F17 self_adaptive_simhash": lambda c: pairs.find_pairs_self_adaptive(c, 6, 8),
}


@pytest.fixture(scope="module")
def many_codes(spark):
    return stored(from_numpy(spark, generate.clustered(40_000, 8, dup_fraction=0.02, noise_bits=3)))


@pytest.mark.parametrize("name", JOINS)
def test_joins_of_short_chunks_send_no_table_around(spark, many_codes, name):
    found = JOINS[name](many_codes)
    assert unhindered(found)
    assert found.rdd.getNumPartitions() >= 15


@pytest.mark.parametrize("k", [3, 12, 63, 64, 70])
def test_pairs_are_counted_where_blocks_meet(spark, small_blocks, k):
    """all pairs were listed to be counted. Rows of one id are no pair."""
    a = planted(70, 8, 12)
    codes = from_numpy(spark, a)
    codes = codes.unionByName(codes.where("id < 5"))
    rows = [(r["id"], bytes(r["code"])) for r in codes.collect()]
    truth = {}
    for i, x in rows:
        for j, y in rows:
            if i < j and (d := (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()) <= k:
                truth[d] = truth.get(d, 0) + 1
    counted = pairs.count_pairs_within(codes, k, 8)
    assert {r["dist"]: r["pairs"] for r in counted.collect()} == truth
    assert "Join" not in plan_of(counted)
    with pytest.raises(ValueError):
        pairs.count_pairs_within(codes, -1, 8)


def test_index_life_searches_all_queries_at_once(spark, monkeypatch):
    """each query was a Spark job of its own."""
    from bitmesh.operators.index import Index
    from bitmesh.plans import catalog

    monkeypatch.setattr(Index, "query", lambda self, code: pytest.fail("a single query"))
    d = "/root/testdata/sf0.001"
    found = catalog.queries()["index_add_reopen_query"](spark, d)
    codes = catalog.sign_codes(spark, d)
    assert sorted(map(tuple, found.collect())) == to_tuples(pairs.find_pairs_cross_bit(codes.where("id % 100 = 0"), codes, 20, 8))


@pytest.mark.parametrize("k", [3, 9, 20])
def test_index_queries_by_blocks_and_of_older_batches(spark, tmp_path, monkeypatch, k):
    """Queries of any number find the same; a batch that was written with all chunks, where one is kept now, too."""
    from bitmesh.operators.index import Index

    a = planted(80, 8, k)
    codes = from_numpy(spark, a)
    index = Index(spark, f"file://{tmp_path}/index", 8, k)
    parted, index.parted = index.parted, True
    index.add_batch(codes.where("id < 30"))
    index.parted = parted
    index.add_batch(codes.where("id >= 30"))
    truth = brute(a[:20], a, k)
    asked = codes.where("id < 20")
    told = lambda: sorted(map(tuple, index.query_batch(asked, nested=False).collect()))
    assert told() == truth
    for name in ("MOST_CANDIDATES", "NESTED_PAIRS"):
        monkeypatch.setattr(pairs, name, -1)
        assert told() == truth
    index.compact()
    assert told() == truth and [(0, i, d) for i, d in index.query(a[0].tobytes())] == [t for t in truth if not t[0]]


@pytest.mark.parametrize("k,d_bytes", [(3, 8), (20, 8), (2, 32), (0, 13), (5, 13)])
def test_a_single_query_is_one_job(spark, tmp_path, k, d_bytes):
    """it took a pass for the width and a join, after the files had been listed again."""
    from bitmesh.operators.index import Index

    a = planted(60, d_bytes, k)
    index = Index(spark, f"file://{tmp_path}/index", d_bytes, k)
    index.add_batch(from_numpy(spark, a))
    with pytest.raises(ValueError):
        index.query(b"\0" * (d_bytes + 1))
    truth = brute(a[:6], a, k)
    for held in (False, True):
        if held:
            index.hold()
        for i in range(6):
            group = f"one-{tmp_path}-{held}-{i}"
            spark.sparkContext.setJobGroup(group, "")
            got = index.query(a[i].tobytes())
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            assert [(i, *hit) for hit in got] == [t for t in truth if t[0] == i]
            assert not i or len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 1  # the first may list files
    index.release()


def test_stream_state_holds_a_row_for_its_time_and_not_for_each_chunk(spark, tmp_path):
    """with chunks of two or three bits a row stood in 23 states on both sides, and met all rows of any time there."""
    from bitmesh.streaming.near import within_time

    a = generate.clustered(300, 8, dup_fraction=0.3, noise_bits=6)
    rows = from_numpy(spark, a).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("id")))
    rows.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = within_time(stream(), stream(), 22, 8, apart="30 minutes").writeStream.format("memory").queryName("near_long").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    assert to_tuples(spark.table("near_long")) == [p for p in brute(a, k=22) if p[0] < p[1] and p[1] - p[0] <= 30]
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 4 * len(a)


def test_all_pairs_are_counted_as_tiles_of_distances():
    """a tile of distances becomes counts, for codes of one word and of more."""
    rng = np.random.default_rng(2)
    for n_words in (1, 4, 5):
        a, b = rng.integers(0, 1 << 64, (n_words, 70), np.uint64), rng.integers(0, 1 << 64, (n_words, 5000), np.uint64)
        dist = np.bitwise_count(a[:, :, None] ^ b[:, None, :]).sum(axis=0)
        assert (compare.Distances(n_words).counts(a, b) == np.bincount(dist.ravel(), minlength=64 * n_words + 1)).all()


def test_nearest_pairs_join_once(spark):
    """the join ran once for each direction of its pairs."""
    a = planted(120, 8, 6)
    found = approx.nearest_pairs(from_numpy(spark, a), 6, 1000, 8)
    assert "Join" not in plan_of(found) and "Generate" not in plan_of(found) and "FileScan" in plan_of(found)
    assert to_tuples(found) == brute(a, k=6)


@pytest.mark.parametrize("name", ["recall_cross", "recall_multi_probe"])
def test_texts_are_coded_once(spark, monkeypatch, name):
    """both tables of a recall made the codes anew."""
    from bitmesh.plans import catalog

    made, text_codes = [], catalog.text_codes
    monkeypatch.setattr(catalog, "text_codes", lambda *a: made.append(1) or text_codes(*a))
    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").first()["truth"] and len(made) == 1


def test_probes_without_flips_send_no_table_around(spark, many_codes):
    """one table of 16 bits, of which the rows of a bucket met in one task."""
    found = approx.multi_probe_pairs(stored(from_numpy(spark, np.repeat(generate.uniform(70_000, 8), 2, axis=0))), 6, 16, 0, 8)
    assert unhindered(found) and found.count() >= 70_000


def test_harness_makes_its_truth_once(spark, monkeypatch):
    """each method's recall ran the join of the truth again."""
    from bitmesh.operators import harness

    kept = []
    monkeypatch.setattr(harness, "stored", lambda df: kept.append(df.columns) or stored(df))
    codes = from_numpy(spark, planted(60, 8, 4))
    rows = harness.run(codes, "planted", 60, 64, 4, ["pairs bit", "pairs byte", "brute force"], pairs.find_pairs_self_bit(codes, 4, 8))
    assert kept == [["i", "j"]] and {r[8] for r in rows} == {1.0} and len({r[7] for r in rows}) == 1
