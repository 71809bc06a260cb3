"""Many small rows as one binary value per bucket, so that a shuffle moves arrays and not rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def pack_bits(codes: np.ndarray) -> np.ndarray:
    """Four bases a byte."""
    pad = (-codes.size) % 4
    c = np.concatenate([codes, np.zeros(pad, np.uint8)]).reshape(-1, 4)
    return c[:, 0] | (c[:, 1] << 2) | (c[:, 2] << 4) | (c[:, 3] << 6)


def unpack_bits(raw: np.ndarray, n: int) -> np.ndarray:
    out = np.empty((raw.size, 4), np.uint8)
    for i in range(4):
        out[:, i] = (raw >> np.uint8(2 * i)) & np.uint8(3)
    return out.reshape(-1)[:n]


def dump(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def load(raw: bytes, *kinds: type) -> list[np.ndarray]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    at, out = 8 * (n + 1), []
    for s, k in zip(sizes, kinds):
        out.append(np.frombuffer(raw, k, int(s) // np.dtype(k).itemsize, at))
        at += int(s)
    return out


def rows(buckets: list[int], values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(values, pa.binary())], ["bucket", "blob"])


def by_bucket(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Split equal-length arrays by bucket."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(b[1:] != b[:-1]) + 1
    edges = [0, *cut.tolist(), b.size] if b.size else [0]
    sorted_ = [a[order] for a in arrays]
    for lo, hi in zip(edges[:-1], edges[1:]):
        yield int(b[lo]), [a[lo:hi] for a in sorted_]
