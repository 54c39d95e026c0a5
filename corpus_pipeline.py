"""The corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, packing.

Every stage takes documents (doc_id, text, lang, source, n_chars) and all but
the last return them. A stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitmesh.llm import decontaminate, line_dedup, quality, shingle_join
from bitmesh.llm.frames import Scratch
from bitmesh.llm.packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """Documents with another text and its length."""
    return docs.withColumn("text", F.col(text)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their failing lines."""
    return _with_text(quality.judge(docs).where("kept"), "cleaned")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go, and documents that held nothing else."""
    out = line_dedup.drop_repeats(docs)
    return _with_text(out.where((F.col("n_dropped") == 0) | F.col("cleaned").rlike(r"[^\x20\x09-\x0D]")), "cleaned")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar texts the row with the smallest doc_id stays, whatever ids rows share; null ids come last."""
    key, shared = shingle_join.row_key(docs)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    stay = shingle_join.link_rows(docs, key, shared).groupBy("component").agg(first.alias("first")).select(F.col("first.row").alias("__key"))
    rows = docs.withColumn("__key", key).join(stay, "__key", "left_semi")
    if shared:  # rows with the same id and text
        rows = rows.groupBy("__key").agg(F.min(F.struct(*COLUMNS)).alias("__row")).select("__row.*")
    return rows.select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out, and documents that held nothing else go."""
    out = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_text=True)
    return _with_text(out.where(~F.col("contaminated") | F.col("cleaned").rlike(r"[^\x20\x09-\x0D]")), "cleaned")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: Tokens and near-duplicate components can't be expressed in SQL; tests/llm hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents; between two of them the rows are written to the shared folder."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs)
    return docs
