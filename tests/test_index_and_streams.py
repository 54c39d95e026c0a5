import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitmesh.operators import harness, pairs
from bitmesh.operators.index import Index
from bitmesh.sources import codes_io, generate
from bitmesh.sources.codes_io import from_numpy, to_tuples
from bitmesh.streaming.near import against, into_index, within_time


def hits(a, code, k):
    d = np.unpackbits(a ^ code, axis=1).sum(axis=1)
    return [(int(i), int(d[i])) for i in np.nonzero(d <= k)[0]]


def test_index(spark, tmp_path):
    a = generate.xorshift_bytes(60, 16, 0xB070)
    a[7] = a[3]
    index = Index(spark, f"file://{tmp_path}/one", 16, 3)
    assert index.is_empty and index.query(a[0].tobytes()) == []
    assert index.add_batch(from_numpy(spark, a[:0])) is None and len(index) == 0
    assert index.add_batch(from_numpy(spark, a[:40])) == 0
    assert index.add_batch(from_numpy(spark, a[40:59])) == 40
    assert index.add(a[59].tobytes()) == 59
    assert len(index) == 60
    assert index.query(a[3].tobytes()) == hits(a, a[3], 3) and len(hits(a, a[3], 3)) == 2
    asked = np.concatenate([a[:5], generate.xorshift_bytes(5, 16, 9)])
    got = {r["query_id"]: [tuple(h) for h in r["hits"]] for r in index.query_batch(from_numpy(spark, asked)).collect()}
    assert got == {i: hits(a, code, 3) for i, code in enumerate(asked)}
    assert index.query_batch(from_numpy(spark, asked[:0])).count() == 0
    with pytest.raises(ValueError):
        index.query(b"short")
    for d_bytes, k in ((0, 0), (1, 8)):
        with pytest.raises(ValueError):
            Index(spark, "file:///nowhere", d_bytes, k)


def test_index_equals_self_join(spark, tmp_path):
    a = generate.clustered(150, 32, dup_fraction=0.5, noise_bits=1)
    codes = from_numpy(spark, a)
    index = Index(spark, f"file://{tmp_path}/two", 32, 2)
    index.add_batch(codes)
    found = index.query_batch(codes, nested=False).where("query_id < id").select(F.col("query_id").alias("i"), F.col("id").alias("j"), "dist")
    assert to_tuples(found) == to_tuples(pairs.find_pairs_self(codes, 2)) != []


def test_index_is_opened_again(spark, tmp_path):
    a = generate.clustered(90, 8, dup_fraction=0.5, noise_bits=1)
    path = f"file://{tmp_path}/again"
    assert Index(spark, path, 8, 2).add_batch(from_numpy(spark, a[:30]), number=0) == 0
    index = Index(spark, path, 8, 2)
    assert len(index) == 30 and index.add_batch(from_numpy(spark, a[:30]), number=0) == 0 and len(index) == 30
    assert index.add_batch(from_numpy(spark, a[30:80])) == 30 and index.add(a[80].tobytes()) == 80
    other = Index(spark, path, 8, 2)
    other.compact()
    assert len(other.batches) == 1 and len(other) == 81 and other.numbers == {0: 0}
    assert index.query(a[5].tobytes()) == hits(a[:81], a[5], 2)  # an older snapshot goes on
    index.refresh()
    assert index.batches == other.batches and index.add_batch(from_numpy(spark, a[81:])) == 81
    found = Index(spark, path, 8, 2)
    assert [found.query(c.tobytes()) for c in a[::9]] == [hits(a, c, 2) for c in a[::9]]
    with pytest.raises(ValueError):
        Index(spark, path, 8, 3)


def test_a_batch_without_a_manifest_entry_does_not_count(spark, tmp_path):
    a = generate.clustered(40, 8, dup_fraction=0.5, noise_bits=1)
    path = f"file://{tmp_path}/half"
    index = Index(spark, path, 8, 2)
    index._commit = lambda *rest: 1 / 0
    with pytest.raises(ZeroDivisionError):
        index.add_batch(from_numpy(spark, a))
    index = Index(spark, path, 8, 2)
    assert index.is_empty and index.add_batch(from_numpy(spark, a)) == 0 and index.query(a[0].tobytes()) == hits(a, a[0], 2)


def _source(spark, tmp_path, a, name="in"):
    times = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)
    from_numpy(spark, a).withColumn("ts", times).write.parquet(f"{tmp_path}/{name}")
    return lambda: spark.readStream.schema("id bigint, code binary, ts timestamp").parquet(f"{tmp_path}/{name}")


def test_stream_against_table(spark, tmp_path):
    a = generate.clustered(80, 8, dup_fraction=0.5, noise_bits=1)
    stream = _source(spark, tmp_path, a)
    q = against(stream(), from_numpy(spark, a[:40]), 2, 8).writeStream.format("memory").queryName("near_static").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    q.awaitTermination()
    assert to_tuples(spark.table("near_static")) == to_tuples(pairs.find_pairs_cross_bit(from_numpy(spark, a), from_numpy(spark, a[:40]), 2))


def test_stream_within_time(spark, tmp_path):
    a = generate.clustered(60, 8, dup_fraction=0.5, noise_bits=1)
    stream = _source(spark, tmp_path, a)
    q = within_time(stream(), stream(), 2, 8, apart="10 minutes").writeStream.format("memory").queryName("near_time").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    q.awaitTermination()
    truth = [p for p in to_tuples(pairs.find_pairs_self_bit(from_numpy(spark, a), 2)) if p[1] - p[0] <= 10]
    assert truth and to_tuples(spark.table("near_time")) == truth


def test_stream_into_index(spark, tmp_path):
    a = generate.clustered(40, 8, dup_fraction=0.5, noise_bits=1)
    stream = _source(spark, tmp_path, a)
    index, seen = Index(spark, f"file://{tmp_path}/index", 8, 2), []
    q = into_index(stream().select("id", "code"), index, lambda found, n: seen.append(found.count()), f"{tmp_path}/c3").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(index) == 40 and seen


def test_restarted_stream_repeats_a_batch_without_adding_it_again(spark, tmp_path):
    a = generate.clustered(40, 8, dup_fraction=0.5, noise_bits=1)
    path, seen = f"file://{tmp_path}/restart", []
    emit = lambda found, n: seen.append(to_tuples(found))
    for part in (a[:25], a):  # the second run has a new file; a lost checkpoint makes it repeat the first batch
        stream = _source(spark, tmp_path, part[-25:] if len(part) == 25 else part[25:], f"in{len(part)}")
        into_index(stream().select("id", "code"), Index(spark, path, 8, 2), emit, f"{tmp_path}/ck{len(part)}").trigger(availableNow=True).start().awaitTermination()
    assert len(Index(spark, path, 8, 2)) == 25  # both runs call their batch 0
    again = Index(spark, path, 8, 2)
    assert again.add_batch(from_numpy(spark, a[25:]), number=1) == 25 and len(again) == 40


def test_record_files(spark, tmp_path):
    a = generate.xorshift_bytes(25, 8, 3)
    path = f"{tmp_path}/codes.bin"
    assert codes_io.write_records(from_numpy(spark, a).repartition(3), path) == 25
    assert (codes_io.to_numpy(codes_io.read_records(spark, path, 8)) == a).all()
    assert codes_io.read_records(spark, path, 8, limit=4).count() == 4
    assert codes_io.read_records(spark, f"{tmp_path}/none.bin", 8) is None


def test_spark_generators(spark):
    made = generate.spark_clustered(spark, 2000, 9, noise_bits=2).cache()
    assert made.select(F.octet_length("code")).distinct().collect()[0][0] == 9
    assert made.where("id >= 10").count() == 1990
    assert pairs.find_pairs_self_bit(made, 2).count() > 100
    assert generate.spark_uniform(spark, 100, 32).select("code").distinct().count() == 100


def test_duplicate_generator_golden(spark):
    codes = from_numpy(spark, generate.with_duplicates(500_000, 32)).repartition(4)
    assert pairs.find_pairs_self_bit(codes, 0).count() == 5_009


def test_harness(spark, tmp_path):
    assert len(harness.METHODS) == 20 and len(harness.PRESETS) == 16 and harness.by_id("15_cross").d_bits == 256
    small = harness.Preset("small", "clustered", (300, 200), 64, (8,), ("pairs byte", "pairs bit", "cross bit"))
    rows = harness.run_preset(spark, small, with_truth=False).collect()
    assert [r["n"] for r in rows] == [200] * 3 + [300] * 3
    assert rows[0]["time_s"] is None and "UnsupportedRegime" in rows[0]["extra"]["error"] and rows[0]["recall_vs_truth"] is None
    table = harness.run_preset(spark, harness.Preset("t", "clustered", (200, 300), 64, (2,), ("pairs byte",)), with_truth=True)
    assert {r["recall_vs_truth"] for r in table.collect()} == {1.0}
    assert harness.scaling(table).count() == 2
    codes_io.write_csv(table.drop("extra"), f"{tmp_path}/csv")
    codes_io.write_json_result({"a": 1, "_pairs": {1}}, f"{tmp_path}/r.json")
    assert "_pairs" not in open(f"{tmp_path}/r.json").read()
    s = harness.sweep_summary({1: [2.0, 2.2, 2.1], 4: [1.0, 0.7, 0.9]})
    told = harness.write_sweep({1: [2.0, 2.2, 2.1], 4: [1.0, 0.7, 0.9]}, 1000, 32, 2, f"{tmp_path}/sweep.json")
    assert told == json.load(open(f"{tmp_path}/sweep.json")) and told["results"] == s and told["config"]["threads"] == [1, 4]
    assert s[1]["speedup"] == pytest.approx(2.1 / 0.9) and s[1]["efficiency"] == pytest.approx(2.1 / 0.9 / 4)


def test_every_held_out_query_is_timed(spark):
    codes = from_numpy(spark, generate.clustered(600, 8, noise_bits=1)).cache()
    for row in harness.run(codes, "clustered", 600, 64, 2, harness.list_methods("streaming-index")):
        assert row[-1].get("queries") == "12.000000" and "error" not in row[-1], row
    codes.unpersist()


def test_presets_name_methods():
    names = set(harness.list_methods())
    assert all(set(p.methods) <= names for p in harness.PRESETS)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from bitmesh.sources.shared import shared_folder

    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf))
    with pytest.raises(RuntimeError):
        shared_folder(cluster)
