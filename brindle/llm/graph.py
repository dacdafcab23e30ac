"""Connected components of a link table, by rounds of large-star and small-star."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _local(batches):
    """A task's links as stars: every node linked to the smallest node that its links reach."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def stars() -> pa.RecordBatch:
        nodes = [n for n in parent if root(n) != n]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(n) for n in nodes], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 500_000:
            yield stars()
            parent.clear()
    yield stars()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): the smallest node it reaches.

    Self-links and repeated links make no difference. Nodes without a link to another node
    have no row. Tasks first shrink their own links to stars; then each round links every
    node's larger neighbours, then its smaller ones, to the smallest node that it knows, until
    nothing changes. The links stay in tables all the time.
    """
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    now = checkpointed(now.mapInArrow(_local, "a long, b long").distinct())
    mark = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            break
        mark = new
        # Only larger nodes are looked up, and the lookups are tables of their own: both sides of
        # each join are then plain shuffles, which adaptive execution splits where one node has many links.
        up = _smallest(now)
        large = checkpointed(now.join(up.select(F.col("a").alias("b"), "m"), "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct())
        low = _smallest(large)
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpointed(moved.unionByName(low.withColumnRenamed("m", "b")).distinct())
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)


def _smallest(links: DataFrame) -> DataFrame:
    """(a, m): the smallest of each larger node's smaller neighbours."""
    return checkpointed(links.groupBy("a").agg(F.min("b").alias("m")))
