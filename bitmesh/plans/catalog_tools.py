"""Queries of variants, plans, sources, generators, index life and harness, with the same queries as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitmesh.functions import codes as C
from bitmesh.operators import harness, pairs
from bitmesh.operators.index import Index
from bitmesh.plans import chunks as P
from bitmesh.plans.catalog import SIGNS, _add, _cross_sql, _self_sql, _simhash_sql, sign_codes, text_codes
from bitmesh.sources import codes_io, generate
from bitmesh.sources.shared import new_path, stored


def _rows(s: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return s.createDataFrame(rows, schema)


def _values(rows: list[tuple], *names: str) -> str:
    """A table of constants in SQL."""
    say = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)}) t({', '.join(names)})"


# joins under their further names, and how a radius is refused
for _name, _join in pairs.VARIANTS.items():
    _add(f"variant_{_name}", lambda s, d, join=_join: join(sign_codes(s, d), 19, 8), _self_sql(SIGNS, 19))
_add("cross_brute_signs", lambda s, d: pairs.find_pairs_cross_brute(sign_codes(s, d), sign_codes(s, d), 16, 8), _cross_sql(SIGNS, 16))
_add("within_signs", lambda s, d: pairs.find_pairs_within(sign_codes(s, d), 17, d_bytes=8), _self_sql(SIGNS, 17))
_add("within_any_radius", lambda s, d: pairs.count_pairs_within(sign_codes(s, d), 64, 8), f"WITH r AS ({_self_sql(SIGNS, 64)}) SELECT dist, count(*) AS pairs FROM r GROUP BY dist")


def _try(s: SparkSession, d: str) -> DataFrame:
    out = []
    for k in (2, 7, 8, 20):
        found, error = pairs.try_find_pairs_self(sign_codes(s, d), k, 8)
        out.append((k, None if found is None else found.count(), type(error).__name__ if error else None))
    return _rows(s, out, "k int, pairs bigint, error string")


_add("try_find_pairs", _try, f"WITH {SIGNS}, x AS (SELECT bit_count(xor(a.code, b.code)) AS dist FROM codes a JOIN codes b ON a.id < b.id) SELECT k::INT AS k, CASE WHEN k < 8 THEN (SELECT count(*) FROM x WHERE dist <= k) END AS pairs, CASE WHEN k >= 8 THEN 'UnsupportedRegime' END AS error FROM (VALUES (2), (7), (8), (20)) t(k)")


def _neighbours(s: SparkSession, d: str) -> DataFrame:
    words = C.to_words(sign_codes(s, d), 8)
    a, b = words.alias("a"), words.alias("b")
    return a.join(b, F.col("a.id") + 1 == F.col("b.id")).select(F.col("a.id").alias("i"), C.hamming_le([F.col("a.w0")], [F.col("b.w0")], 30).cast("int").alias("dist"))


_add("hamming_le", _neighbours, f"WITH {SIGNS} SELECT a.id AS i, CASE WHEN bit_count(xor(a.code, b.code)) <= 30 THEN bit_count(xor(a.code, b.code))::INT END AS dist FROM codes a JOIN codes b ON a.id + 1 = b.id")


_bytes = [("00ff", "0f0f"), ("", ""), ("ffffffffffffffffffffffff", "000000000000000000000000"), ("0123456789abcdef01", "fedcba987654321001"), ("80", "01")]
_add(
    "hamming_distance",
    lambda s, d: _rows(s, [(x, y, C.hamming_distance(bytes.fromhex(x), bytes.fromhex(y))) for x, y in _bytes], "x string, y string, dist int"),
    _values([(x, y, n) for (x, y), n in zip(_bytes, (8, 0, 96, 64, 2), strict=True)], "x", "y", "dist").replace("SELECT *", "SELECT x, y, dist::INT AS dist"),
)
_add("hex_codes", lambda s, d: C.to_words(s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), C.hex_code(F.md5(F.col("text").cast("binary"))).alias("code")), 16).select("id", F.hex("w0").alias("head")), "SELECT doc_id AS id, ltrim(upper(substr(md5(text), 1, 16)), '0') AS head FROM documents")

# plans
_add(
    "supported_regimes",
    lambda s, d: _rows(s, [(k, n, P.is_supported(k, n), P.is_supported_bit(k, n)) for k in range(-1, 70) for n in (1, 8, 32)], "k int, d_bytes int, by_byte boolean, by_bit boolean"),
    "SELECT k::INT AS k, n::INT AS d_bytes, k >= 0 AND k < n AS by_byte, k >= 0 AND k < 8 * n AS by_bit FROM range(-1, 70) t(k), (VALUES (1), (8), (32)) u(n)",
)
_add(
    "chunk_plans",
    lambda s, d: _rows(s, [(bits, k, a, b) for bits in (64, 104, 256, 1024) for k in range(12) for a, b in P.bit_chunks_for(bits, k)], "bits int, k int, lo int, hi int"),
    "WITH p AS (SELECT bits, k, greatest(k + 1, (bits + 127) // 128) AS parts FROM (VALUES (64), (104), (256), (1024)) t(bits), range(12) u(k) WHERE NOT (k = 0 AND bits > 128)), e AS (SELECT bits, k, i * bits // parts AS lo, (i + 1) * bits // parts AS hi FROM (SELECT *, unnest(range(parts)) AS i FROM p)) SELECT bits::INT AS bits, k::INT AS k, lo::INT AS lo, hi::INT AS hi FROM e WHERE hi > lo UNION ALL SELECT bits, 0, 0, 128 FROM (VALUES (256), (1024)) t(bits)",
)
_add(
    "byte_chunk_plans",
    lambda s, d: _rows(s, [(n, parts, a, b) for n in (3, 8, 13, 64) for parts in range(0, 15) for a, b in P.chunk_boundaries(n, parts)], "n int, parts int, lo int, hi int"),
    "SELECT n::INT AS n, parts::INT AS parts, (i * n // parts)::INT AS lo, ((i + 1) * n // parts)::INT AS hi FROM (SELECT n, parts, unnest(range(parts)) AS i FROM (VALUES (3), (8), (13), (64)) t(n), range(1, 15) u(parts)) WHERE (i + 1) * n // parts > i * n // parts",
)
_add(
    "memory_estimates",
    lambda s, d: _rows(s, [(n, k, P.estimate_memory_mb(n, 32, k, ["pairs bit"])) for n in (1000, 10**6, 10**9) for k in (3, 7)], "n bigint, k int, mb double"),
    "SELECT n::BIGINT AS n, k::INT AS k, 300::DOUBLE + (2 * n::BIGINT * (k + 1) * (16 + 8 * (1 + 4 + 2)))::DOUBLE / 1048576::DOUBLE AS mb FROM (VALUES (1000), (1000000), (1000000000)) t(n), (VALUES (3), (7)) u(k)",
)


def _adaptive(s: SparkSession, d: str) -> DataFrame:
    """Over any codes: every bit that varies stands in one chunk."""
    plan = pairs.adaptive_plan(sign_codes(s, d), 8, 6)
    return _rows(s, [(p,) for own in plan.chunks for p in own], "bit int")


_add("adaptive_plan_bits", _adaptive, f"WITH {SIGNS} SELECT bit::INT AS bit FROM codes, range(64) r(bit) GROUP BY bit HAVING sum((code >> (63 - bit)) & 1) BETWEEN 1 AND count(*) - 1")


# index life
def _index_life(s: SparkSession, d: str) -> DataFrame:
    """Codes added one by one and as batches, the index opened again and compacted in between, then searched for all queries."""
    path = new_path(s, "index")
    codes = stored(sign_codes(s, d))
    some = [bytes(r["code"]) for r in codes.where("id < 2").orderBy("id").collect()]
    index = Index(s, path, 8, 20)
    empty = index.is_empty
    ids = [index.add(c) for c in some]
    index = Index(s, path, 8, 20)
    ids += [index.add_batch(codes.where("id BETWEEN 2 AND 59"), number=7), index.add_batch(codes.where("id BETWEEN 2 AND 59"), number=7)]
    index.compact()
    index = Index(s, path, 8, 20)
    ids.append(index.add_batch(codes.where("id >= 60")))
    assert empty and ids == [0, 1, 2, 2, 60] and len(index) == codes.count()
    return index.query_batch(codes.where("id % 100 = 0"), nested=False)


_add("index_add_reopen_query", _index_life, f"WITH {SIGNS} SELECT a.id AS query_id, b.id AS id, bit_count(xor(a.code, b.code))::INT AS dist FROM codes a JOIN codes b ON bit_count(xor(a.code, b.code)) <= 20 WHERE a.id % 100 = 0")


# sources and sinks
def _records(s: SparkSession, d: str) -> DataFrame:
    """Codes to a file of records and back."""
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as folder:  # the record file of one process, as other tools write it
        path = os.path.join(folder, "codes.bin")
        codes_io.write_records(sign_codes(s, d), path)
        found = codes_io.to_numpy(codes_io.read_records(s, f"file://{path}", 8))
    return C.to_words(codes_io.from_numpy(s, found), 8).select("id", F.col("w0").alias("code"))


_add("record_file_round_trip", _records, f"WITH {SIGNS} SELECT id, code FROM codes")


def _csv(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "csv")
    codes_io.write_csv(pairs.find_pairs_self_bit(sign_codes(s, d), 18, 8), path)
    return s.read.option("header", True).schema("i bigint, j bigint, dist int").csv(path)


_add("csv_round_trip", _csv, _self_sql(SIGNS, 18))


def _json(s: SparkSession, d: str) -> DataFrame:
    import json
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "run.json")
        codes_io.write_json_result({"pairs": pairs.find_pairs_self_bit(sign_codes(s, d), 18, 8).count(), "method": "pairs bit", "_hidden": 1}, path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        sweep = harness.write_sweep({1: [2.0, 4.0, 3.0], 2: [1.5, 2.0, 1.0]}, 1000, 32, 2, path)
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
    assert read == sweep
    return _rows(s, [(key, str(value)) for key, value in told.items()] + [(f"speedup {r['threads']}", str(r["speedup"])) for r in read["results"]] + [("bits", str(read["config"]["d_bits"]))], "field string, value string")


_add("json_results", _json, f"WITH r AS ({_self_sql(SIGNS, 18)}) SELECT 'pairs' AS field, count(*)::VARCHAR AS value FROM r UNION ALL VALUES ('method', 'pairs bit'), ('speedup 1', '1.0'), ('speedup 2', '2.0'), ('bits', '256')")


# generators
def _xorshift(s: SparkSession, d: str) -> DataFrame:
    return _rows(s, [(i, int(x)) for i, x in enumerate(generate.xorshift_bytes(20, 8, 12345).ravel())], "place int, byte int")


_add(
    "xorshift_bytes",
    _xorshift,
    "WITH RECURSIVE g AS (SELECT -1 AS place, 12345::HUGEINT AS s UNION ALL SELECT place + 1, xor(b, (b * 131072) & 18446744073709551615::HUGEINT) FROM (SELECT place, xor(a, a >> 7) AS b FROM (SELECT place, xor(s, (s * 8192) & 18446744073709551615::HUGEINT) AS a FROM g)) WHERE place < 159) SELECT place::INT AS place, (((s * 2685821657736338717::HUGEINT) & 18446744073709551615::HUGEINT) >> 56)::INT AS byte FROM g WHERE place >= 0",
)


def _published(s: SparkSession, d: str) -> DataFrame:
    """Pairs of the seeded generators at published sizes."""
    made = [("clustered", generate.clustered(100_000, 32), 4), ("duplicates", generate.with_duplicates(500_000, 32), 0), ("low entropy", generate.low_entropy(20_000, 32), 4), ("uniform", generate.uniform(100_000, 32), 2)]
    return _rows(s, [(name, len(a), pairs.find_pairs_self_bit(codes_io.from_numpy(s, a), k, 32).count()) for name, a, k in made], "generator string, n bigint, pairs bigint")


_add("generators_published_pairs", _published, _values([("clustered", 100_000, 162_111), ("duplicates", 500_000, 5_009), ("low entropy", 20_000, 0), ("uniform", 100_000, 0)], "generator", "n", "pairs").replace("SELECT *", "SELECT generator, n::BIGINT AS n, pairs::BIGINT AS pairs"))


def _spark_made(s: SparkSession, d: str) -> DataFrame:
    made = [("uniform", generate.spark_uniform(s, 5000, 13)), ("clustered", generate.spark_clustered(s, 5000, 32, dup_fraction=0.0))]
    return s.createDataFrame([(name, t.count(), t.select("code").distinct().count(), t.agg(F.max(F.octet_length("code"))).first()[0]) for name, t in made], "generator string, n bigint, codes bigint, d_bytes int")


_add("generators_on_executors", _spark_made, "SELECT 'uniform' AS generator, 5000::BIGINT AS n, 5000::BIGINT AS codes, 13::INT AS d_bytes UNION ALL SELECT 'clustered', 5000, 5000, 32")


# harness
_add("harness_methods", lambda s, d: _rows(s, [(m.category, m.name) for m in harness.METHODS], "category string, method string").groupBy("category").agg(F.count("*").alias("methods")), _values([("exact", 5), ("approximate-default", 3), ("approximate-tunable", 4), ("streaming-index", 3), ("cross-join", 5)], "category", "methods").replace("SELECT *", "SELECT category, methods::BIGINT AS methods"))
_add(
    "harness_presets",
    lambda s, d: _rows(s, [(p.id[:2], max(p.n), p.d_bits, max(p.k), len(harness.by_id(p.id).methods)) for p in harness.PRESETS], "preset string, n bigint, d_bits int, k int, methods int"),
    _values([("01", 20_000, 256, 2, 8), ("02", 50_000, 64, 4, 6), ("03", 20_000, 256, 4, 4), ("04", 50_000, 256, 20, 3), ("05", 1_000_000, 256, 2, 3), ("06", 100_000, 256, 4, 7), ("07", 2_000_000, 256, 2, 2), ("08", 1_000_000, 256, 4, 7), ("09", 200_000, 512, 8, 6), ("10", 100_000, 256, 2, 3), ("11", 2_000_000, 256, 0, 4), ("12", 200_000, 256, 4, 6), ("13", 10_000_000, 256, 2, 2), ("14", 100_000, 1024, 8, 6), ("15", 200_000, 256, 4, 5), ("16", 50_000, 64, 4, 5)], "preset", "n", "d_bits", "k", "methods").replace("SELECT *", "SELECT preset, n::BIGINT AS n, d_bits::INT AS d_bits, k::INT AS k, methods::INT AS methods"),
)
RUN = ["pairs byte", "pairs bit", "pairs adaptive", "brute force", "multi-index", "cross bit", "cross brute force", "cross within"]


def _harness(s: SparkSession, d: str) -> DataFrame:
    """A comparison at a radius that bytes can't serve: that method's row has its error, the exact ones find the same pairs."""
    codes = stored(sign_codes(s, d))
    n = codes.count()
    out = harness.run(codes, "signs", n, 64, 12, [m for m in RUN if not m.startswith("cross")], pairs.find_pairs_self_bit(codes, 12, 8))
    out += harness.run(codes, "signs", n, 64, 12, [m for m in RUN if m.startswith("cross")], pairs.find_pairs_cross_bit(*generate.split_in_half(codes, n), 12, 8))
    rows = s.createDataFrame(out, harness.RESULT)
    return rows.select("method", "category", "pairs", F.coalesce(F.col("recall_vs_truth"), F.lit(-1.0)).alias("recall"), F.col("time_s").isNotNull().alias("timed"), F.substring_index(F.col("extra")["error"], ":", 1).alias("error"))


_add(
    "harness_run",
    _harness,
    f"WITH {SIGNS}, h AS (SELECT count(*) // 2 AS half FROM codes), x AS (SELECT a.id AS i, b.id AS j FROM codes a JOIN codes b ON a.id < b.id WHERE bit_count(xor(a.code, b.code)) <= 12), o AS (SELECT count(*) AS own, count(*) FILTER (WHERE i < half AND j >= half) AS crossed FROM x, h), c AS (SELECT method, CASE WHEN method LIKE 'cross%' THEN 'cross-join' ELSE 'exact' END AS category, CASE WHEN method = 'pairs byte' THEN NULL WHEN method LIKE 'cross%' THEN crossed ELSE own END AS pairs FROM o, ({_values([(m,) for m in RUN], 'method')})) "
    "SELECT method, category, pairs, CASE WHEN coalesce(pairs, 0) > 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS recall, pairs IS NOT NULL AS timed, CASE WHEN pairs IS NULL THEN 'UnsupportedRegime' END AS error FROM c",
)


def _results(s: SparkSession) -> DataFrame:
    rows = [("uniform", n, 256, 2, m, "exact", t, 0, 1.0, {}) for n, m, t in ((100, "pairs byte", 1.0), (1000, "pairs byte", 2.0), (100, "brute force", 4.0), (1000, "brute force", None), (100, "pairs bit", 3.0), (1000, "pairs bit", 9.0))]
    return s.createDataFrame([r for r in rows if r[4] != "pairs bit" or r[1] == 100], harness.RESULT)


_add("harness_scaling", lambda s, d: harness.scaling(_results(s)).select("method", "n"), "SELECT method, n::BIGINT AS n FROM (VALUES ('pairs byte', 100), ('pairs byte', 1000), ('brute force', 100), ('brute force', 1000)) t(method, n)")
_add("harness_latest", lambda s, d: harness.latest(_results(s), 3).select("method", "n", "time_s"), "SELECT method, n::BIGINT AS n, time_s::DOUBLE AS time_s FROM (VALUES ('pairs byte', 1000, 2.0), ('brute force', 100, 4.0), ('pairs bit', 100, 3.0)) t(method, n, time_s)")


def _latency(s: SparkSession, d: str) -> DataFrame:
    """The three ways to answer single queries: every held-out query is timed."""
    codes = stored(sign_codes(s, d))
    out = harness.run(codes, "signs", codes.count(), 64, 8, harness.list_methods("streaming-index"))
    rows = s.createDataFrame(out, harness.RESULT)
    e = lambda c: F.col("extra")[c].cast("double")
    return rows.select("method", e("queries").cast("int").alias("queries"), ((e("min_s") <= e("median_s")) & (e("median_s") <= e("p99_s")) & (e("mean_s") > 0) & (e("build_s") > 0)).alias("ordered"))


_add("harness_query_latency", _latency, "SELECT method, least(1000, greatest(10, count(*) // 50))::INT AS queries, TRUE AS ordered FROM embeddings, (VALUES ('index'), ('brute force query'), ('nearest query')) t(method) GROUP BY method")


def _recall_nearest(s: SparkSession, d: str) -> DataFrame:
    """Recall of the 10 nearest within the radius against all pairs within it."""
    from bitmesh.operators import approx

    codes = text_codes(s, d)
    return approx.recall(approx.nearest_pairs(codes, 6, 10, 8), pairs.find_pairs_self_bit(codes, 6, 8))


_add(
    "recall_nearest",
    _recall_nearest,
    f"WITH {_simhash_sql()}, p AS (SELECT a.id AS i, b.id AS j, bit_count(xor(a.code, b.code)) AS dist FROM codes a JOIN codes b ON a.id <> b.id WHERE bit_count(xor(a.code, b.code)) <= 6), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS place FROM p), f AS (SELECT count(*) AS found FROM (SELECT DISTINCT least(i, j), greatest(i, j) FROM r WHERE place <= 10)), t AS (SELECT count(*) // 2 AS truth FROM p) SELECT found, truth, found AS common, CASE WHEN truth > 0 THEN found::DOUBLE / truth END AS recall FROM f, t",
)
