"""Filling containers of fixed capacity along a space-filling curve.

A text becomes a vector: every run of four bytes is hashed and its bits add +1 or -1 in each of a few dimensions. The
vectors are quantised and numbered along a Hilbert curve, so that texts with similar content are neighbours; the items
are range-partitioned and sorted by that number and each task packs its part of the curve: a window of neighbours at a
time, largest first, each into the fullest open container with room for it.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flat import flat_bytes, slices
from ..functions.scratch import written

_DIMS, _BITS = 3, 10
_BLOCK = 4 << 20
_WINDOW = 256  # neighbours that are packed together
_OPEN = 32  # containers left open for the next window, those with the most room
_PER_TASK = 2000  # containers a task fills, about


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Number along the Hilbert curve of points (n x dims, each 0 .. 2^bits - 1)."""
    x = x.astype(np.int64).T.copy()
    n = x.shape[0]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(hit, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = off.size - 1
    vec = np.zeros((n, _DIMS))
    if data.size >= 4:
        d = data.astype(np.uint32)
        g = d[:-3] | (d[1:-2] << 8) | (d[2:-1] << 16) | (d[3:] << 24)
        g = g * np.uint32(0x9E3779B1)
        g ^= g >> np.uint32(15)
        g *= np.uint32(0x85EBCA77)
        g ^= g >> np.uint32(13)
        last = np.maximum(off[1:] - 3, off[:-1])
        has = np.flatnonzero(last > off[:-1])
        for i in range(_DIMS):
            s = np.concatenate([[0], np.cumsum(((g >> np.uint32(7 * i)) & np.uint32(1)).astype(np.int64) * 2 - 1)])
            vec[has, i] = (s[last[has]] - s[off[has]]) / np.sqrt(last[has] - off[has])
    cell = (1 / (1 + np.exp(-np.clip(vec, -8, 8))) * (1 << _BITS)).astype(np.int64)
    return hilbert(np.minimum(cell, (1 << _BITS) - 1), _BITS)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", _BLOCK):
        data, off = flat_bytes(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("item"), pa.array(np.diff(off) + 1), pa.array(curve_keys(data, off))], ["item", "size", "curve"])


class _Packer:
    """Best fit into open containers, kept in order of their free space."""

    def __init__(self, part: int) -> None:
        self.free: list[tuple[int, int]] = []
        self.next = part << 36

    def new(self) -> int:
        self.next += 1
        return self.next

    def put(self, size: int, capacity: int) -> int:
        at = bisect.bisect_left(self.free, (size, -1))
        room, box = self.free.pop(at) if at < len(self.free) else (capacity, self.new())
        if room > size:
            bisect.insort(self.free, (room - size, box))
        return box

    def trim(self) -> None:
        if len(self.free) > _OPEN:
            self.free = self.free[-_OPEN:]


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(TaskContext.get().partitionId())
        for b in batches:
            for lo in range(0, b.num_rows, _WINDOW):
                size = b.column("size").slice(lo, _WINDOW).to_numpy()
                n_pieces = -(-size // capacity)
                row = np.repeat(np.arange(size.size), n_pieces)
                piece = np.arange(row.size) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces) + 1
                tokens = np.minimum(size[row] - (piece - 1) * capacity, capacity)
                box = np.zeros(row.size, np.int64)
                for i in np.lexsort((np.arange(row.size), -tokens)).tolist():
                    box[i] = packer.put(int(tokens[i]), capacity)
                packer.trim()
                item = b.column("item").slice(lo, _WINDOW).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(box), item, pa.array(piece.astype(np.int32)), pa.array(n_pieces[row].astype(np.int32)), pa.array((piece - 1) * capacity), pa.array(tokens)], ["container", "item", "piece", "n_pieces", "from_token", "n_tokens"])

    return run


def pack(df: DataFrame, item: str = "doc_id", text: str = "text", capacity: int = 2048) -> DataFrame:
    """Items (texts of UTF-8 bytes + 1 tokens) in containers of `capacity` tokens.

    Returns container, the item's id (under its name), piece (1..n_pieces), n_pieces, from_token, n_tokens. Only an item
    larger than the capacity is split: into full pieces and a rest. Rows with a null text are no items; an empty text has
    one token; a null id is kept; every row is an item of its own, repeated ids too. An empty table gives no rows, further
    columns are ignored. Container numbers are unique but not dense.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    rows = df.where(F.col(text).isNotNull()).select(F.col(item).cast("bigint").alias("item"), F.col(text).alias("text"))
    keyed = rows.mapInArrow(_keys, "item bigint, size bigint, curve bigint").withColumn("salt", F.rand(5))  # repeated rows spread too
    keyed = written(keyed, "pack-keys")  # three numbers an item: the range sort reads them twice, the texts are read once
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n = max(1, min(1 << 20, total // (capacity * _PER_TASK)))
    lined = keyed.repartitionByRange(n, "curve", "item", "salt").sortWithinPartitions("curve", "item", "salt").drop("salt")
    return lined.mapInArrow(_pack(capacity), "container bigint, item bigint, piece int, n_pieces int, from_token bigint, n_tokens bigint").withColumnRenamed("item", item)


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, pieces, tokens, unused share of the room."""
    n = F.count_distinct("container")
    tokens = F.coalesce(F.sum("n_tokens"), F.lit(0))
    return packed.agg(n.alias("n_containers"), F.count(F.lit(1)).alias("n_pieces"), tokens.alias("n_tokens"), F.when(n > 0, 1 - tokens / (n * capacity)).alias("unused_share"))
