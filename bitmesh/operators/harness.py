"""Methods by name, presets, and runs of one against the other."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitmesh.functions import codes as C
from bitmesh.operators import approx, pairs
from bitmesh.operators.index import Index
from bitmesh.sources import generate
from bitmesh.sources.codes_io import from_numpy, write_json_result
from bitmesh.sources.shared import new_path, stored

RESULT = "dataset string, n bigint, d_bits int, k int, method string, category string, time_s double, pairs bigint, recall_vs_truth double, extra map<string,string>"


@dataclass(frozen=True)
class Method:
    """``run(codes, k)`` for self-joins, ``run(a, b, k)`` for cross joins, ``run(codes, k)`` with latencies for indexes."""

    name: str
    category: str
    run: Callable = field(compare=False)


HELD_OUT, WARM_UP = 1000, 10


def _held_out(codes: DataFrame, seed: int = 42) -> tuple[DataFrame, list[bytes], int]:
    """The codes without the held-out queries, these, and the width. Queries are the first min(1000, rows / 50), ten at least, by a hash of the id."""
    n = codes.count()
    place = F.xxhash64("id", F.lit(seed))
    some = codes.select(place.alias("p"), "code").orderBy("p").limit(min(HELD_OUT, max(10, n // 50))).collect()
    rest = codes.where(place > some[-1]["p"]) if some else codes
    return rest, [bytes(r["code"]) for r in some], len(some[0]["code"]) if some else 0


def _latencies(ask: Callable[[bytes], object], asked: list[bytes], built: float) -> dict[str, float]:
    """Seconds of a query: all held-out ones are timed, after the first ones have run once to warm up."""
    for code in asked[:WARM_UP]:
        ask(code)
    took = []
    for code in asked:
        t = time.perf_counter()
        ask(code)
        took.append(time.perf_counter() - t)
    return {"median_s": float(np.median(took)), "mean_s": float(np.mean(took)), "p99_s": float(np.percentile(took, 99)), "min_s": min(took), "build_s": built, "queries": len(took)}


def _index_latency(codes: DataFrame, k: int) -> dict[str, float]:
    """Single queries of the index."""
    rest, asked, width = _held_out(codes)
    start = time.perf_counter()
    index = Index(codes.sparkSession, new_path(codes.sparkSession, "index"), width, k)
    index.add_batch(rest)
    index.hold()
    try:
        return _latencies(index.query, asked, time.perf_counter() - start)
    finally:
        index.release()


def _search_latency(search: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], dict[str, float]]:
    """Single queries by a scan of the other codes, whose words the executors keep: ``search`` gets the rows within k as ``i, j, dist``."""

    def run(codes: DataFrame, k: int) -> dict[str, float]:
        rest, asked, width = _held_out(codes)
        start = time.perf_counter()
        kept = C.to_words(rest, width).coalesce(codes.sparkSession.sparkContext.defaultParallelism).cache()
        kept.count()
        built = time.perf_counter() - start

        def ask(code: bytes) -> list:
            dist = C.hamming([F.col(n) for n in C.word_names(width)], [F.lit(v) for v in C.word_values(code)])
            return search(kept.select(F.lit(0).cast("bigint").alias("i"), F.col("id").alias("j"), dist.cast("int").alias("dist")).where(F.col("dist") <= k)).collect()

        try:
            return _latencies(ask, asked, built)
        finally:
            kept.unpersist()

    return run


METHODS = [
    Method("pairs byte", "exact", pairs.find_pairs_self),
    Method("pairs bit", "exact", pairs.find_pairs_self_bit),
    Method("pairs adaptive", "exact", pairs.find_pairs_self_adaptive),
    Method("brute force", "exact", pairs.find_pairs_brute),
    Method("multi-index", "exact", approx.multi_index_pairs),
    Method("bit-sampling hash", "approximate-default", lambda c, k: approx.multi_probe_pairs(c, k, 16, 0)),
    Method("nearest 50", "approximate-default", lambda c, k: approx.nearest_pairs(c, k, 50)),
    Method("hash tables 10", "approximate-default", lambda c, k: approx.lsh_pairs(c, k, 10, 16)),
    Method("multi-index, tuned", "approximate-tunable", approx.multi_index_pairs),
    Method("bit-sampling hash, 4 flips", "approximate-tunable", lambda c, k: approx.multi_probe_pairs(c, k, 16, 4)),
    Method("nearest 200", "approximate-tunable", lambda c, k: approx.nearest_pairs(c, k, 200)),
    Method("hash tables 50", "approximate-tunable", lambda c, k: approx.lsh_pairs(c, k, 50, 16)),
    Method("index", "streaming-index", _index_latency),
    Method("brute force query", "streaming-index", _search_latency(lambda found: found)),
    Method("nearest query", "streaming-index", _search_latency(lambda found: found.orderBy("dist", "j").limit(50))),
    Method("cross byte", "cross-join", pairs.find_pairs_cross),
    Method("cross bit", "cross-join", pairs.find_pairs_cross_bit),
    Method("cross brute force", "cross-join", pairs.find_pairs_cross_brute),
    Method("cross within", "cross-join", lambda a, b, k: pairs.find_pairs_within(a, k, b)),
    Method("cross nearest 50", "cross-join", lambda a, b, k: approx.nearest(a, b, 50, k).select(F.col("query_id").alias("i"), F.col("id").alias("j"), "dist")),
]


def list_methods(category: str | None = None) -> list[str]:
    return [m.name for m in METHODS if category in (None, m.category)]


def method(name: str) -> Method:
    return next(m for m in METHODS if m.name == name)


@dataclass(frozen=True)
class Preset:
    id: str
    dataset: str
    n: tuple[int, ...]
    d_bits: int
    k: tuple[int, ...]
    methods: tuple[str, ...]


BYTE, BIT, FLAT, MULTI, HASH, NEAREST, TABLES = "pairs byte", "pairs bit", "brute force", "multi-index", "bit-sampling hash", "nearest 50", "hash tables 10"
CROSS = ("cross byte", "cross bit", "cross brute force", "cross within", "cross nearest 50")
#: Sizes, widths, radii and the methods that are compared (fixed values, by this library's method names).
PRESETS = [
    Preset("01_sanity", "uniform", (20_000,), 256, (2,), (BYTE, BIT, "pairs adaptive", FLAT, MULTI, HASH, NEAREST, TABLES)),
    Preset("02_phash_width", "clustered", (50_000,), 64, (2, 4), (BYTE, BIT, FLAT, MULTI, NEAREST, TABLES)),
    Preset("03_adaptive", "low entropy", (20_000,), 256, (4,), (BYTE, BIT, "pairs adaptive", FLAT)),
    Preset("04_high_k", "uniform", (50_000,), 256, (12, 16, 20), (BYTE, BIT, FLAT)),
    Preset("05_scaling", "uniform", (100_000, 500_000, 1_000_000), 256, (2,), (BYTE, FLAT, MULTI)),
    Preset("06_approximate", "clustered", (100_000,), 256, (4,), (BYTE, BIT, FLAT, MULTI, HASH, NEAREST, TABLES)),
    Preset("07_stress", "uniform", (2_000_000,), 256, (2,), (BYTE, FLAT)),
    Preset("08_clustered_scaling", "clustered", (100_000, 500_000, 1_000_000), 256, (4,), (BYTE, BIT, FLAT, MULTI, HASH, NEAREST, TABLES)),
    Preset("09_wide", "clustered", (200_000,), 512, (2, 8), (BYTE, BIT, FLAT, MULTI, HASH, NEAREST)),
    Preset("10_index", "clustered", (100_000,), 256, (2,), ("index", "brute force query", "nearest query")),
    Preset("11_exact_duplicates", "duplicates", (500_000, 1_000_000, 2_000_000), 256, (0,), (BYTE, BIT, FLAT, MULTI)),
    Preset("12_tuned", "clustered", (200_000,), 256, (4,), (BIT, FLAT, "multi-index, tuned", "bit-sampling hash, 4 flips", "nearest 200", "hash tables 50")),
    Preset("13_limit", "uniform", (5_000_000, 10_000_000), 256, (2,), (BYTE, BIT)),
    Preset("14_very_wide", "clustered", (100_000,), 1024, (2, 8), (BYTE, BIT, FLAT, MULTI, HASH, NEAREST)),
    Preset("15_cross", "clustered", (200_000,), 256, (2, 4), CROSS),
    Preset("16_cross_phash_width", "clustered", (50_000,), 64, (2, 4), CROSS),
]


def by_id(id: str) -> Preset:
    return next(p for p in PRESETS if p.id == id)


GENERATORS = {"uniform": generate.uniform, "clustered": generate.clustered, "low entropy": generate.low_entropy, "duplicates": generate.with_duplicates}


def run(codes: DataFrame, dataset: str, n: int, d_bits: int, k: int, names: list[str], truth: DataFrame | None = None) -> list[tuple]:
    """One result row for each method. A method that fails gives a row with the error and no figures; recall is null without truth or without true pairs."""
    out = []
    if truth is not None:  # each method is compared with it
        truth = stored(truth.select("i", "j"))
    for name in names:
        m = method(name)
        cross = m.category == "cross-join"
        start = time.perf_counter()
        try:
            found = m.run(*generate.split_in_half(codes, n), k) if cross else m.run(codes, k)
            if isinstance(found, dict):
                out.append((dataset, n, d_bits, k, name, m.category, time.perf_counter() - start, None, None, {a: f"{b:.6f}" for a, b in found.items()}))
                continue
            found = found.cache()
            count, took = found.count(), time.perf_counter() - start
            share = approx.recall(found, truth).first()["recall"] if truth is not None and {"i", "j"} <= set(found.columns) else None
            out.append((dataset, n, d_bits, k, name, m.category, took, count, share, {}))
            found.unpersist()
        except Exception as e:  # a failing method is a result of a comparison
            out.append((dataset, n, d_bits, k, name, m.category, None, None, None, {"error": f"{type(e).__name__}: {e}"[:500]}))
    return out


def run_preset(spark: SparkSession, preset: Preset, most_rows: int | None = None, with_truth: bool = False) -> DataFrame:
    """Results of a preset, the smallest number of rows first; ``most_rows`` leaves larger ones out."""
    rows = []
    for n in sorted(preset.n):
        if most_rows and n > most_rows:
            continue
        codes = from_numpy(spark, GENERATORS[preset.dataset](n, preset.d_bits // 8)).cache()
        for k in preset.k:
            truth = None
            if with_truth:
                cross = any(method(m).category == "cross-join" for m in preset.methods)
                truth = pairs.find_pairs_cross_bit(*generate.split_in_half(codes, n), k) if cross else pairs.find_pairs_self_bit(codes, k)
            rows += run(codes, preset.dataset, n, preset.d_bits, k, list(preset.methods), truth)
        codes.unpersist()
    return spark.createDataFrame(rows, RESULT)


def scaling(results: DataFrame) -> DataFrame:
    """Rows of methods that ran with at least two numbers of rows at the same width and radius."""
    seen = results.groupBy("method", "d_bits", "k").agg(F.count_distinct("n").alias("sizes")).where("sizes >= 2")
    return results.join(seen.drop("sizes"), ["method", "d_bits", "k"], "left_semi")


def sweep_summary(times: dict[int, list[float]]) -> list[dict[str, float]]:
    """Median, best and worst time for each number of threads, speedup and efficiency against the smallest."""
    base = None
    out = []
    for threads in sorted(times):
        own = sorted(times[threads])
        middle = own[len(own) // 2]
        base = base or (middle, threads)
        speedup = base[0] / middle
        out.append({"threads": threads, "median_s": middle, "best_s": own[0], "worst_s": own[-1], "speedup": speedup, "efficiency": speedup * base[1] / threads})
    return out


def thread_sweep(threads: list[int], n: int, d_bytes: int, k: int, reps: int = 3) -> dict[int, list[float]]:
    """Seconds of a self-join of uniform codes on ``local[t]`` for each t, each in a process of its own, without its start."""
    import json
    import subprocess
    import sys

    code = (
        "import json, sys, time\n"
        "from pyspark.sql import SparkSession\n"
        "from bitmesh.operators.pairs import find_pairs_self\n"
        "from bitmesh.sources.generate import spark_uniform\n"
        "t, n, d, k, reps = map(int, sys.argv[1:])\n"
        "s = SparkSession.builder.master(f'local[{t}]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', t).getOrCreate()\n"
        "codes = spark_uniform(s, n, d).repartition(t).cache(); codes.count()\n"
        "def once():\n"
        "    start = time.perf_counter(); find_pairs_self(codes, k).count(); return time.perf_counter() - start\n"
        "once(); print('TIMES', json.dumps([once() for _ in range(reps)]))\n"
    )
    out = {}
    for t in threads:
        run = subprocess.run([sys.executable, "-c", code, *map(str, (t, n, d_bytes, k, reps))], capture_output=True, text=True, check=True)
        out[t] = json.loads(run.stdout.rpartition("TIMES ")[2])
    return out


def write_sweep(times: dict[int, list[float]], n: int, d_bytes: int, k: int, path: str) -> dict:
    """A thread sweep as one JSON object: when, on what, with which settings, and a line for each number of threads."""
    import platform
    from datetime import UTC, datetime

    sweep = {
        "timestamp_utc": datetime.now(UTC).isoformat(timespec="seconds"),
        "machine": {"platform": platform.platform(), "machine": platform.machine(), "python": platform.python_version()},
        "config": {"n": n, "d_bits": 8 * d_bytes, "k": k, "reps": max(map(len, times.values()), default=0), "threads": sorted(times)},
        "results": sweep_summary(times),
    }
    write_json_result(sweep, path)
    return sweep


def latest(results: DataFrame, count: int = 20) -> DataFrame:
    """The last rows of a session's results that have a time, slowest first: what the session's chart shows."""
    rows = results.withColumn("place", F.monotonically_increasing_id())
    return rows.where(F.col("time_s").isNotNull()).orderBy(F.desc("place")).limit(count).orderBy(F.desc("time_s")).drop("place")
