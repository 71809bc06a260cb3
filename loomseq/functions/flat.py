"""NumPy helpers over whole Arrow batches: strings become one flat array and its offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BAD = 4


def _lut() -> np.ndarray:
    t = np.full(256, BAD, np.uint8)
    for i, c in enumerate("ACGT"):
        t[ord(c)] = t[ord(c.lower())] = i
    return t


BASE = _lut()


def flat_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null has length 0."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if isinstance(arr, pa.ChunkedArray):  # more than one chunk is left only beyond 2 GB
        arr = pa.concat_arrays([c.cast(pa.large_binary()) for c in arr.chunks])
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if len(arr) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def flat_codes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As flat_bytes, with bases as 0..3 and anything else as BAD; case is ignored."""
    data, off = flat_bytes(arr)
    return BASE[data], off


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose strings in `column` hold at most `most` bytes (a longer one comes alone)."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        _, off = flat_bytes(b.column(column))
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
            yield b.slice(lo, min(hi, n) - lo)
            lo = min(hi, n)


def window_ok(codes: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """For each start of a window of k: whether it holds bases only and lies in one record."""
    n = codes.size
    if n < k:
        return np.zeros(0, bool)
    bad = np.zeros(n + 1, np.int32)
    np.cumsum(codes == BAD, out=bad[1:])
    first = np.zeros(n + 1, np.int32)
    np.add.at(first, off[1:-1], 1)
    np.cumsum(first, out=first)
    m = n - k + 1
    return (bad[k : k + m] == bad[:m]) & (first[k - 1 : k - 1 + m] == first[:m])


def kmers(codes: np.ndarray, k: int) -> np.ndarray:
    """Packed k-mers (k <= 32) at each start, by doubling; BAD counts as A."""
    c = np.where(codes == BAD, 0, codes).astype(np.uint64 if k > 16 else np.uint32)
    kind = c.dtype.type
    out, size, have, step = None, 0, c, 1
    while True:
        if k & step:
            if out is None:
                out, size = have, step
            else:  # the piece of `step` goes before what is there
                m = max(0, have.size - step) if size else have.size
                m = min(have.size, max(0, out.size - step))
                out = (have[:m] << kind(2 * size)) | out[step : step + m]
                size += step
        if size == k:
            return out[: max(0, codes.size - k + 1)]
        m = max(0, have.size - step)
        have = (have[:m] << kind(2 * step)) | have[step : step + m]
        step *= 2


def rc_kmers(codes: np.ndarray, k: int) -> np.ndarray:
    """Packed reverse complements of the k-mers at each start."""
    c = np.where(codes == BAD, 0, 3 - codes.astype(np.int8)).astype(np.uint64 if k > 16 else np.uint32)
    kind = c.dtype.type
    out, size, have, step = None, 0, c, 1
    while True:
        if k & step:
            if out is None:
                out, size = have, step
            else:
                m = min(have.size, max(0, out.size - step))
                out = (out[step : step + m] << kind(2 * step)) | have[:m]
                size += step
        if size == k:
            return out[: max(0, codes.size - k + 1)]
        m = max(0, have.size - step)
        have = (have[step : step + m] << kind(2 * step)) | have[:m]
        step *= 2


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (shift-multiply finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unmix64(x: np.ndarray) -> np.ndarray:
    """Inverse of mix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x *= np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x ^= (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x *= np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    x ^= (x >> np.uint64(30)) ^ (x >> np.uint64(60))
    return x


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    have, step = x, 1
    while step * 2 <= w:
        have = np.minimum(have[: have.size - step], have[step:]) if have.size > step else have[:0]
        step *= 2
    if step < w:
        d = w - step
        have = np.minimum(have[: have.size - d], have[d:]) if have.size > d else have[:0]
    return have


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length at the end."""
    n = sorted_keys.size
    if n == 0:
        return np.zeros(1, np.int64)
    cut = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    return np.concatenate([[0], cut, [n]]).astype(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each length, one after another."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if total == 0:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - before, lengths)
