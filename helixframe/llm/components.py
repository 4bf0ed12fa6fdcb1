"""Connected components of a graph of any size: alternating star contractions, or one task where few links are left."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from helixframe.llm._common import dropped, written


#: Up to so many links, some 16 MB, one task finds the components.
FEW = 500_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lead: dict[int, int] = {}
    for b in batches:
        for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
            ends = []
            for x in (u, v):
                while (y := lead.setdefault(x, x)) != x:
                    lead[x] = x = lead[y]
                ends.append(x)
            lead[max(ends)] = min(ends)
    nodes, least = list(lead), []
    for x in nodes:
        while lead[x] != x:
            x = lead[x]
        least.append(x)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(least, pa.int64())], names=["node", "component"])


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One contraction: neighbours on one side of each node are linked to the least of its neighbourhood instead.

    ``edges`` holds each link once, as (u, v) with u > v. A node with very many links is met by partial sums in the
    aggregate and by a join whose large partitions Spark splits.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if larger:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return moved.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with a link; ``edges`` has two long columns u and v, component is the least node.

    Self-links, repeated links and rows with a null are ignored; without links there are no rows. The number of rounds
    grows with the logarithm of the longest path; each round is written to the shared folder.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        if now.count() <= FEW:
            return written(now.coalesce(1).mapInArrow(_joined, "node long, component long"), "members")
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (mark["n"], mark["h"]) == state:
            break
        state = (mark["n"], mark["h"])
        before, now = now, written(_star(_star(now, larger=True), larger=False), "edges")
        dropped(before)
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
