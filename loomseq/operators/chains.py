"""Chains of nodes with at most one successor and one predecessor each: head and rank of every node, by pointer doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import forget, written

_ONE_TASK = 4_000_000  # links that are ranked in one task


def ranked(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(head, rank) of every place of `before` (its predecessor, or itself); a circle is cut before its least place."""
    before = before.copy()
    while True:
        up, far, least = before.copy(), (before != np.arange(before.size)).astype(np.int64), np.minimum(before, np.arange(before.size))
        for _ in range(max(1, int(before.size).bit_length()) + 1):
            over = up[up]
            far, least = far + far[up], np.minimum(least, least[up])
            if (over == up).all():
                break
            up = over
        circle = before[up] != up
        if not circle.any():
            return up, far
        cut = np.unique(least[circle])
        before[cut] = cut


def rank(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, head, rank from 0) of all nodes of the links; a circle is cut before its least node."""
    node, both = np.unique(np.concatenate([src, dst]), return_inverse=True)
    both = both.reshape(-1)
    before = np.arange(node.size)
    before[both[src.size :]] = both[: src.size]
    up, far = ranked(before)
    return node, node[up], far


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = list(batches)
    src, dst = (np.concatenate([np.empty(0, np.int64), *(b.column(c).to_numpy().astype(np.int64) for b in got)]) for c in ("src", "dst"))
    if src.size:
        node, head, at = rank(src, dst)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(head), pa.array(at)], ["node", "head", "rank"])


def _doubled(x: DataFrame, n: int) -> DataFrame:
    """(node, up, far, least) after as many doublings as n nodes need; stops when nothing moves. Only the last round stays on disk."""
    before = None
    for _ in range(max(1, n.bit_length()) + 1):
        y = x.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"), F.col("least").alias("least2"))
        x = x.join(y, "up").select("node", F.col("up2").alias("up"), (F.col("far") + F.col("far2")).alias("far"), F.least("least", "least2").alias("least"), (F.col("up") != F.col("up2")).alias("moved"))
        x = written(x, "rank")
        if before is not None:
            forget(before)
        before = x
        if x.where("moved").isEmpty():
            break
    return x


def list_rank(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, head, rank) of every node of a link: head is the first node of its chain, whose rank is 0.

    Nodes are bigint; a node has at most one link out and one in (more raise no error and give one of the chains). A circle is
    cut before its least node. The rounds grow with the logarithm of the longest chain, every round is a join of written
    tables and no chain is one task's work; up to 4,000,000 links are ranked in one task, with the same result."""
    e = written(links.select(F.col(src).cast("bigint").alias("src"), F.col(dst).cast("bigint").alias("dst")).where("src <> dst"), "links")
    if e.count() <= _ONE_TASK:
        return written(e.coalesce(1).mapInArrow(_small, "node bigint, head bigint, rank bigint"), "ranks")
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    before = nodes.join(e.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("src")), "node", "left").select("node", F.coalesce("src", "node").alias("up"))
    before = written(before, "before")
    n = before.count()
    while True:
        start = before.select("node", "up", (F.col("node") != F.col("up")).cast("bigint").alias("far"), F.least("node", "up").alias("least"))
        x = _doubled(start, n)
        heads = before.where("node = up").select(F.col("node").alias("up"))
        cut = written(x.join(heads, "up", "left_anti").select(F.col("least").alias("node")).distinct(), "cut")
        if cut.isEmpty():
            return x.select("node", F.col("up").alias("head"), F.col("far").alias("rank"))
        before = written(before.join(cut.withColumn("cut", F.lit(True)), "node", "left").select("node", F.when(F.col("cut"), F.col("node")).otherwise(F.col("up")).alias("up")), "before")
