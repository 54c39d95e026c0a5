"""The queries of the Hamming operators over the driver's tables, with the same queries as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitmesh.functions import codes as C
from bitmesh.operators import approx, pairs
from bitmesh.sources.generate import split_in_half
from bitmesh.sources.shared import new_path, stored

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sign_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), C.sign_code("embedding", 64).alias("code"))


def text_codes(spark: SparkSession, sf_dir: str, name: str = "documents", id: str = "doc_id") -> DataFrame:
    """SimHash codes of a table, made once: the joins read them several times."""
    return stored(C.simhash(_table(spark, sf_dir, name), id))


def digest_codes(spark: SparkSession, sf_dir: str, name: str = "documents", id: str = "doc_id") -> DataFrame:
    return _table(spark, sf_dir, name).select(F.col(id).alias("id"), C.md5_code("text").alias("code"))


def both(codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a cross join of a whole table with itself."""
    return codes, codes


SIGNS = """codes AS (
  SELECT vec_id AS id, cast(array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS BIGINT) AS code FROM embeddings
)"""


def _simhash_sql(table: str = "documents", id: str = "doc_id", name: str = "codes") -> str:
    return f"""{name}_w AS (
  SELECT DISTINCT {id} AS id, unnest(string_split_regex(lower(trim(text)), '\\s+')) AS w FROM {table}
), {name}_b AS (
  SELECT id, i, sum(CASE WHEN (('0x' || substr(md5(w), 1, 16))::UBIGINT >> i) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM {name}_w, range(64) r(i) GROUP BY id, i
), {name} AS (
  SELECT id, string_agg(CASE WHEN s > 0 THEN '1' ELSE '0' END, '' ORDER BY i DESC)::BIT::BIGINT AS code FROM {name}_b GROUP BY id
)"""


def _self_sql(codes: str, k: int) -> str:
    return f"WITH {codes} SELECT a.id AS i, b.id AS j, bit_count(xor(a.code, b.code))::INT AS dist FROM codes a JOIN codes b ON a.id < b.id WHERE bit_count(xor(a.code, b.code)) <= {k}"


def _cross_sql(codes: str, k: int) -> str:
    return f"WITH {codes} SELECT a.id AS i, b.id AS j, bit_count(xor(a.code, b.code))::INT AS dist FROM codes a JOIN codes b ON TRUE WHERE bit_count(xor(a.code, b.code)) <= {k}"


_found: dict[str, tuple[Query, str | None]] = {}


def _add(name: str, query: Query, sql: str | None) -> None:
    _found[name] = (query, sql)


DIGEST_SELF = "SELECT a.doc_id AS i, b.doc_id AS j, 0 AS dist FROM documents a JOIN documents b ON a.doc_id < b.doc_id AND md5(a.text) = md5(b.text)"

_add("self_bit_signs", lambda s, d: pairs.find_pairs_self_bit(sign_codes(s, d), 20, 8), _self_sql(SIGNS, 20))
_add("self_byte_signs", lambda s, d: pairs.find_pairs_self(sign_codes(s, d), 7, 8), _self_sql(SIGNS, 7))
_add("self_adaptive_signs", lambda s, d: pairs.find_pairs_self_adaptive(sign_codes(s, d), 18, 8), _self_sql(SIGNS, 18))
_add("self_byte_simhash", lambda s, d: pairs.find_pairs_self(text_codes(s, d), 6, 8), _self_sql(_simhash_sql(), 6))
_add("self_bit_simhash", lambda s, d: pairs.find_pairs_self_bit(text_codes(s, d), 10, 8), _self_sql(_simhash_sql(), 10))
_add("self_adaptive_simhash", lambda s, d: pairs.find_pairs_self_adaptive(text_codes(s, d), 6, 8), _self_sql(_simhash_sql(), 6))
_add("self_auto_simhash", lambda s, d: pairs.find_pairs_self_auto(text_codes(s, d), 3, 8), _self_sql(_simhash_sql(), 3))
_add("self_qgram_simhash", lambda s, d: pairs.find_pairs_qgram_self(text_codes(s, d), 3, 10, 8), _self_sql(_simhash_sql(), 3))
_add("self_brute_signs", lambda s, d: pairs.find_pairs_brute(sign_codes(s, d), 20, 8), _self_sql(SIGNS, 20))
_add("exact_duplicates_byte", lambda s, d: pairs.find_pairs_self(digest_codes(s, d), 0, 16), DIGEST_SELF)
_add("exact_duplicates_bit", lambda s, d: pairs.find_pairs_self_bit(digest_codes(s, d), 0, 16), DIGEST_SELF)
_add("within_simhash", lambda s, d: pairs.find_pairs_within(text_codes(s, d), 8, return_distances=False, d_bytes=8), f"WITH r AS ({_self_sql(_simhash_sql(), 8)}) SELECT i, j FROM r")
_add("cross_byte_simhash", lambda s, d: pairs.find_pairs_cross(*both(text_codes(s, d)), 5, 8), _cross_sql(_simhash_sql(), 5))
_add("cross_bit_simhash", lambda s, d: pairs.find_pairs_cross_bit(*both(text_codes(s, d)), 9, 8), _cross_sql(_simhash_sql(), 9))
_add("cross_bit_signs", lambda s, d: pairs.find_pairs_cross_bit(*both(sign_codes(s, d)), 20, 8), _cross_sql(SIGNS, 20))
_add("cross_within_signs", lambda s, d: pairs.find_pairs_within(sign_codes(s, d), 18, sign_codes(s, d), d_bytes=8), _cross_sql(SIGNS, 18))
_add(
    "cross_benchmark",
    lambda s, d: pairs.find_pairs_cross_bit(text_codes(s, d), text_codes(s, d, "benchmark", "item_id"), 16, 8),
    f"WITH {_simhash_sql()}, {_simhash_sql('benchmark', 'item_id', 'other')} SELECT a.id AS i, b.id AS j, bit_count(xor(a.code, b.code))::INT AS dist FROM codes a JOIN other b ON bit_count(xor(a.code, b.code)) <= 16",
)
NEAR = f"WITH {_simhash_sql()}, {_simhash_sql('benchmark', 'item_id', 'other')} SELECT id FROM codes a WHERE %s EXISTS (SELECT 1 FROM other b WHERE bit_count(xor(a.code, b.code)) <= 16)"
_add("semi_near", lambda s, d: pairs.near(text_codes(s, d), text_codes(s, d, "benchmark", "item_id"), 16, 8).select("id"), NEAR % "")
_add("anti_near", lambda s, d: pairs.not_near(text_codes(s, d), text_codes(s, d, "benchmark", "item_id"), 16, 8).select("id"), NEAR % "NOT")
_add(
    "nearest_signs",
    lambda s, d: approx.nearest(sign_codes(s, d).where("id % 100 = 0"), sign_codes(s, d), 10).withColumn("place", F.col("place").cast("bigint")),
    f"WITH {SIGNS}, r AS (SELECT a.id AS query_id, b.id, bit_count(xor(a.code, b.code))::INT AS dist, row_number() OVER (PARTITION BY a.id ORDER BY bit_count(xor(a.code, b.code)), b.id) AS place FROM codes a, codes b WHERE a.id % 100 = 0) SELECT * FROM r WHERE place <= 10",
)
_add("multi_index_simhash", lambda s, d: approx.multi_index_pairs(text_codes(s, d), 4, d_bytes=8), _self_sql(_simhash_sql(), 4))
#: Tables of 16 sampled bits: a pair at distance 6 meets in one of 20 with a chance of 0.97.
TABLES, BITS = 20, 16
_masks = [sum(1 << (63 - p) for p in own) for own in approx.sampled_bits(8, TABLES, BITS)]
_met = " OR ".join(f"(xor(a.code, b.code) & {m - (1 << 64) if m >> 63 else m}) = 0" for m in _masks)
_add("lsh_simhash", lambda s, d: approx.lsh_pairs(text_codes(s, d), 6, TABLES, BITS, d_bytes=8), f"{_self_sql(_simhash_sql(), 6)} AND ({_met})")


def _recall_lsh(s: SparkSession, d: str) -> DataFrame:
    codes = text_codes(s, d)
    return approx.recall(approx.lsh_pairs(codes, 6, TABLES, BITS, d_bytes=8), pairs.find_pairs_self_bit(codes, 6, 8))


_add("recall_lsh", _recall_lsh, f"WITH {_simhash_sql()}, t AS (SELECT ({_met}) AS met FROM codes a JOIN codes b ON a.id < b.id WHERE bit_count(xor(a.code, b.code)) <= 6) SELECT count(*) FILTER (WHERE met) AS found, count(*) AS truth, count(*) FILTER (WHERE met) AS common, CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE met)::DOUBLE / count(*) END AS recall FROM t")
_add(
    "multi_probe_simhash",
    lambda s, d: approx.multi_probe_pairs(text_codes(s, d), 6, 16, 2, 8),
    f"WITH {_simhash_sql()} SELECT a.id AS i, b.id AS j, bit_count(xor(a.code, b.code))::INT AS dist FROM codes a JOIN codes b ON a.id < b.id WHERE bit_count(xor(a.code, b.code)) <= 6 AND bit_count((xor(a.code, b.code) >> 48) & 65535) <= 2",
)


def _recall_multi_probe(s: SparkSession, d: str) -> DataFrame:
    codes = text_codes(s, d)
    return approx.recall(approx.multi_probe_pairs(codes, 6, 16, 0, 8), pairs.find_pairs_self_bit(codes, 6, 8))


_add(
    "recall_multi_probe",
    _recall_multi_probe,
    f"WITH {_simhash_sql()}, t AS (SELECT (xor(a.code, b.code) >> 48) & 65535 AS x FROM codes a JOIN codes b ON a.id < b.id WHERE bit_count(xor(a.code, b.code)) <= 6) SELECT count(*) FILTER (WHERE x = 0) AS found, count(*) AS truth, count(*) FILTER (WHERE x = 0) AS common, CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE x = 0)::DOUBLE / count(*) END AS recall FROM t",
)


def _words(s: SparkSession, d: str) -> DataFrame:
    return C.to_words(sign_codes(s, d), 8)


_add("code_words", lambda s, d: _words(s, d).select("id", F.col("w0").alias("code")), f"WITH {SIGNS} SELECT id, code FROM codes")
_add("code_round_trip", lambda s, d: C.to_words(_words(s, d).select("id", C.from_words([F.col("w0")], 8).alias("code")), 8).select("id", F.col("w0").alias("code")), f"WITH {SIGNS} SELECT id, code FROM codes")
_add("bit_range_keys", lambda s, d: _words(s, d).groupBy(C.extract_bits([F.col("w0")], 8, 24, 8)[0].alias("key")).agg(F.count("*").alias("codes")), f"WITH {SIGNS} SELECT code & 72056494526300160 AS key, count(*) AS codes FROM codes GROUP BY 1")
_add("bit_position_keys", lambda s, d: _words(s, d).groupBy(C.extract_bits_at([F.col("w0")], [1, 5, 63], 8)[0].alias("key")).agg(F.count("*").alias("codes")), f"WITH {SIGNS} SELECT code & 4899916394579099649 AS key, count(*) AS codes FROM codes GROUP BY 1")
_add("gram_values", lambda s, d: _words(s, d).select("id", C.gram_at([F.col("w0")], 40, 12, 8).alias("gram")), f"WITH {SIGNS} SELECT id, (code >> 12) & 4095 AS gram FROM codes")
_add(
    "bit_counts",
    lambda s, d: _words(s, d).select(F.posexplode(C.unpack_bits([F.col("w0")], 8)).alias("bit", "set")).groupBy("bit").agg(F.sum("set").alias("ones")),
    f"WITH {SIGNS} SELECT bit::INT AS bit, sum((code >> (63 - bit)) & 1)::BIGINT AS ones FROM codes, range(64) r(bit) GROUP BY bit",
)
_add(
    "distance_histogram",
    lambda s, d: pairs.count_pairs_within(text_codes(s, d), 12, 8),
    f"WITH r AS ({_self_sql(_simhash_sql(), 12)}) SELECT dist, count(*) AS pairs FROM r GROUP BY dist",
)


def _sql_function(s: SparkSession, d: str) -> DataFrame:
    C.register(s)
    _words(s, d).createOrReplaceTempView("bitmesh_sign_words")
    return s.sql("SELECT a.id AS i, b.id AS j, hamming(a.w0, b.w0) AS dist FROM bitmesh_sign_words a JOIN bitmesh_sign_words b ON a.id + 1 = b.id")


_add("sql_function", _sql_function, f"WITH {SIGNS} SELECT a.id AS i, b.id AS j, bit_count(xor(a.code, b.code))::INT AS dist FROM codes a JOIN codes b ON a.id + 1 = b.id")


def _index(s: SparkSession, d: str) -> DataFrame:
    from bitmesh.operators.index import Index

    codes = text_codes(s, d)
    index = Index(s, new_path(s, "index"), 8, 5)
    index.add_batch(codes)
    return index.query_batch(codes.where("id % 100 = 0"), nested=False)


_add(
    "index_queries",
    _index,
    f"WITH {_simhash_sql()}, n AS (SELECT row_number() OVER (ORDER BY id) - 1 AS place, code FROM codes) SELECT a.id AS query_id, n.place AS id, bit_count(xor(a.code, n.code))::INT AS dist FROM codes a JOIN n ON bit_count(xor(a.code, n.code)) <= 5 WHERE a.id % 100 = 0",
)


def _index_nested(s: SparkSession, d: str) -> DataFrame:
    from bitmesh.operators.index import Index

    codes = text_codes(s, d)
    index = Index(s, new_path(s, "index"), 8, 3)
    index.add_batch(codes.where("id < 100"))
    index.add_batch(codes.where("id >= 100"))
    found = index.query_batch(codes.where("id % 100 = 0"))
    return found.select("query_id", F.size("hits").cast("bigint").alias("hits"))


_add(
    "index_nested_queries",
    _index_nested,
    f"WITH {_simhash_sql()} SELECT a.id AS query_id, count(b.id) AS hits FROM codes a LEFT JOIN codes b ON bit_count(xor(a.code, b.code)) <= 3 WHERE a.id % 100 = 0 GROUP BY a.id",
)


def _split(s: SparkSession, d: str) -> DataFrame:
    codes = sign_codes(s, d)
    return pairs.find_pairs_cross_bit(*split_in_half(codes, codes.count()), 20)


_add("cross_split_halves", _split, f"WITH {SIGNS}, n AS (SELECT count(*) // 2 AS half FROM codes) SELECT a.id AS i, b.id - half AS j, bit_count(xor(a.code, b.code))::INT AS dist FROM n, codes a JOIN codes b ON bit_count(xor(a.code, b.code)) <= 20 WHERE a.id < half AND b.id >= half")
_add("self_qgram_fallback", lambda s, d: pairs.find_pairs_qgram_self(sign_codes(s, d), 18, 8, 8), _self_sql(SIGNS, 18))


def _recall_cross(s: SparkSession, d: str) -> DataFrame:
    codes = text_codes(s, d)
    return approx.recall(pairs.find_pairs_cross(*both(codes), 3, 8), pairs.find_pairs_cross_bit(*both(codes), 6, 8))


_add(
    "recall_cross",
    _recall_cross,
    f"WITH r AS ({_cross_sql(_simhash_sql(), 6)}) SELECT count(*) FILTER (WHERE dist <= 3) AS found, count(*) AS truth, count(*) FILTER (WHERE dist <= 3) AS common, CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE dist <= 3)::DOUBLE / count(*) END AS recall FROM r",
)


def _finished(s: SparkSession, found: DataFrame) -> DataFrame:
    """What a stream gives until its source has no more."""
    folder = new_path(s, "stream")
    found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(found.schema).parquet(f"{folder}/out")


def _code_stream(s: SparkSession, d: str) -> DataFrame:
    schema = s.read.parquet(f"{d}/embeddings.parquet").schema
    rows = s.readStream.schema(schema).parquet(f"{d}/embeddings.parque[t]")
    return rows.select(F.col("vec_id").alias("id"), C.sign_code("embedding", 64).alias("code"), F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("vec_id")).alias("ts"))


def _stream_within(s: SparkSession, d: str) -> DataFrame:
    """Pairs of embeddings that come at most 30 minutes of each other, one a minute."""
    from bitmesh.streaming.near import within_time

    return _finished(s, within_time(_code_stream(s, d), _code_stream(s, d), 22, 8, apart="30 minutes"))


_add("stream_within_time", _stream_within, f"WITH r AS ({_self_sql(SIGNS, 22)}) SELECT * FROM r WHERE j - i <= 30")


def _stream(s: SparkSession, d: str) -> DataFrame:
    """A stream of the embeddings' codes against the table itself, run to its end."""
    from bitmesh.streaming.near import against

    return _finished(s, against(_code_stream(s, d).drop("ts"), sign_codes(s, d), 18, 8).where("i < j"))


_add("stream_against_table", _stream, _self_sql(SIGNS, 18))


def _entropies(s: SparkSession, d: str) -> DataFrame:
    """Entropy of each bit over all codes."""
    ones = _words(s, d).select(F.posexplode(C.unpack_bits([F.col("w0")], 8)).alias("bit", "set")).groupBy("bit").agg(F.avg("set").alias("p"))
    p, q = F.col("p"), 1 - F.col("p")
    return ones.select("bit", F.when((p == 0) | (p == 1), 0.0).otherwise(F.round(-(p * F.log2(p) + q * F.log2(q)), 9)).alias("entropy"))


_add(
    "bit_entropies",
    _entropies,
    f"WITH {SIGNS}, p AS (SELECT bit::INT AS bit, avg((code >> (63 - bit)) & 1) AS p FROM codes, range(64) r(bit) GROUP BY bit) SELECT bit, CASE WHEN p IN (0, 1) THEN 0.0::DOUBLE ELSE round(-(p * log2(p) + (1 - p) * log2(1 - p)), 9) END AS entropy FROM p",
)


def queries() -> dict[str, Query]:
    from bitmesh.plans import catalog_tools  # noqa: F401  it adds its queries to these

    return {k: q for k, (q, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    from bitmesh.plans import catalog_tools  # noqa: F401

    return {k: sql for k, (_, sql) in _found.items() if sql}
