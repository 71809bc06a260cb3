"""Connected components of an edge table, by alternating star contractions; every round is a written table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import written

_ONE_TASK = 4_000_000  # edges of a graph that is settled in one task (64 MB)


def settle(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (u, v) and the least node of the component of each: labels hooked to the least, then halved."""
    node, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = both.reshape(-1)[: u.size], both.reshape(-1)[u.size :]
    up = np.arange(node.size)
    while True:
        x, y = up[a], up[b]
        go = x != y
        if not go.any():
            return node, node[up]
        a, b = x[go], y[go]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while True:
            over = up[up]
            if (over == up).all():
                break
            up = over


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = list(batches)
    u, v = (np.concatenate([np.empty(0, np.int64), *(b.column(c).to_numpy().astype(np.int64) for b in got)]) for c in "uv")
    node, comp = settle(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(comp)], ["node", "component"])


def components(edges: DataFrame, src: str = "a", dst: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node of its component, for every node of an edge.

    Large-star and small-star steps link each node's neighbours to the least one; the number of rounds grows with the
    logarithm of the graph's diameter. Minima are taken by map-side aggregation and joined back, so a node with a third
    of all edges is no list in one task. A graph of up to 4,000,000 edges is settled by union-find in one task, with the same
    result. Null ends are left out; loops and repeated edges are allowed."""
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("u"), F.col(dst).alias("v"))
    e = written(e.distinct(), "cc-input")
    if dict(e.dtypes)["u"] in ("bigint", "int") and e.count() <= _ONE_TASK:
        kind = e.schema["u"].dataType.simpleString()
        one = e.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).coalesce(1).mapInArrow(_small, "node bigint, component bigint")
        return written(one.select(F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component")), "cc")
    nodes = written(e.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "cc-nodes")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "cc-edges")
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "cc-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v"))).where("u <> v")
        e = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
        state = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()  # an unchanged set of edges
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.join(e.groupBy("u").agg(F.min("v").alias("component")), nodes["node"] == F.col("u"), "left").select("node", F.coalesce("component", "node").alias("component"))
