"""Codes from and to arrays, raw record files, and result files."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_numpy(spark: SparkSession, codes: np.ndarray, first_id: int = 0) -> DataFrame:
    """``id, code`` of a (rows, bytes) uint8 matrix; ids are row numbers."""
    if codes.dtype != np.uint8:
        raise TypeError(f"codes must be uint8, not {codes.dtype}")
    if codes.ndim != 2:
        raise ValueError(f"codes must have two dimensions, not {codes.ndim}")
    if codes.shape[1] < 1:
        raise ValueError("codes must have at least one byte")
    if not len(codes):
        return spark.createDataFrame([], "id bigint, code binary")
    rows = np.ascontiguousarray(codes)
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(first_id, first_id + len(rows)), "code": [r.tobytes() for r in rows]}), "id bigint, code binary")


def to_numpy(codes: DataFrame) -> np.ndarray:
    """The (rows, bytes) matrix of a table that fits into the driver, by id."""
    rows = [bytes(r["code"]) for r in codes.orderBy("id").collect()]
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


def to_tuples(pairs: DataFrame) -> list[tuple[int, ...]]:
    """Pairs as a sorted list, for results that fit into the driver."""
    return sorted(tuple(r) for r in pairs.collect())


def read_records(spark: SparkSession, path: str, d_bytes: int, limit: int | None = None) -> DataFrame | None:
    """``id, code`` of a file of fixed-length records, ids by place; None if there is no such file."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return None
    records = spark.sparkContext.binaryRecords(path, d_bytes).zipWithIndex()
    df = records.map(lambda r: (r[1], bytearray(r[0]))).toDF("id bigint, code binary")
    return df.where(F.col("id") < limit) if limit is not None else df


def write_records(codes: DataFrame, path: str) -> int:
    """Writes codes by id as one file of records and returns their number; partition by partition, so the driver holds one at a time."""
    n = 0
    with open(path, "wb") as f:
        for r in codes.sort("id").select("code").toLocalIterator():
            f.write(bytes(r["code"]))
            n += 1
    return n


def write_json_result(result: dict, path: str) -> None:
    """One benchmark run as JSON, without the fields whose names begin with an underscore."""
    Path(path).write_text(json.dumps({k: v for k, v in result.items() if not k.startswith("_")}, indent=2, default=str))


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)
