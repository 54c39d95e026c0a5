"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitmesh.llm.frames import Scratch

#: Tasks over which the edges of one node are spread.
SALTS = 64


def _with_least(edges: DataFrame, key: str, other: str, least: Column) -> DataFrame:
    """The edges with ``m``, the least of ``least`` over all edges of their ``key`` node.

    Edges are dealt by (key, salt of the other end); each node's least number
    goes back to the salts that it has. So a node with any number of edges
    sends at most SALTS rows to one task, and its edges spread over as many.
    """
    salted = edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    each = salted.groupBy(key, "salt").agg(F.min(least).alias("m"))
    whole = each.groupBy(key).agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))
    return salted.join(whole.select(key, "m", F.explode("salts").alias("salt")), [key, "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to its least neighbour (itself included)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = _with_least(both, "a", "b", F.least("a", "b"))
    return found.where("b > a AND m <> b").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them; edges run from the smaller to the larger node."""
    found = _with_least(edges, "b", "a", F.col("a"))
    down = found.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return down.unionByName(found.select(F.col("m").alias("a"), "b")).distinct()


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component``: for each node of an edge, the least node that can be reached.

    Edges are ``a, b`` in any direction; loops and repeated edges do no harm.
    Each round writes its edges, and the rounds end when they no longer
    change, after a number of rounds that grows with the logarithm of the
    longest path. Only a count and a checksum reach the driver.
    """
    edges = scratch.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    told = None
    while True:
        new = scratch.keep(_small_star(_large_star(edges)))
        scratch.drop(edges)
        edges = new
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == told:
            break
        told = state
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
