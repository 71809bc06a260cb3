"""Most frequent items with bounded memory: code-based identification.

A 64-bit value is mixed by a bijection; the leading bits name one of about 4 / share groups, the others are cut into
symbols of 4 bits and written as a codeword of 16 symbols (a systematic Reed-Solomon code over GF(16), so as many symbols
as there are data symbols give the value and the others check it). For each group and position every symbol is counted.
The counts add up, so tasks count alone and the arrays, fixed in size by the share alone, are summed. All symbols of a
value that fills a share phi of the rows have counts of at least phi, whatever else is in its group; so all codewords made of
heavy symbols are decoded, none is missed, and the candidates are counted exactly.

Groups are never made larger. Where several heavy values meet in one group of a repetition, so that the combinations are
too many to try, they are found in another repetition; the counts of what is found are then peeled off and the rest
decoded; if a group of every repetition stays crowded, the sketch is taken again with other bijections.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flat import mix64, unmix64
from ..functions.scratch import parts

_LEN = 16  # symbols of a codeword
_CELLS = _LEN * 16  # counters of a group
_BLOCK = 1 << 17
_TRIES = 1 << 16  # combinations of heavy symbols that are tried in a group
_LEAST_PPM = 100  # smallest share: 65,536 groups, 64 MB of counters a repetition
_ROUNDS = 8
_SLICES = 16


def _field() -> tuple[np.ndarray, np.ndarray]:
    """Logarithms and powers of GF(16), polynomial x^4 + x + 1."""
    exp, log, x = np.zeros(30, np.int64), np.zeros(16, np.int64), 1
    for i in range(15):
        exp[i] = exp[i + 15] = x
        log[x] = i
        x = (x << 1) ^ (0x13 if x & 8 else 0)
    return log, exp


_LOG, _EXP = _field()


def _mul(a, b):
    return np.where((a == 0) | (b == 0), 0, _EXP[_LOG[a] + _LOG[b]])


def _inverse(m: np.ndarray) -> np.ndarray:
    """Gauss-Jordan over the field."""
    n = m.shape[0]
    m = np.concatenate([m, np.eye(n, dtype=np.int64)], axis=1)
    for c in range(n):
        p = next(r for r in range(c, n) if m[r, c])
        m[[c, p]] = m[[p, c]]
        m[c] = _mul(m[c], _EXP[15 - _LOG[m[c, c]]])
        for r in range(n):
            if r != c and m[r, c]:
                m[r] ^= _mul(m[c], m[r, c])
    return m[:, n:]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((a.shape[0], b.shape[1]), np.int64)
    for i in range(a.shape[1]):
        out ^= _mul(a[:, i : i + 1], b[i : i + 1, :])
    return out


class Code:
    """Values of `bits` bits as codewords of 16 symbols; the first ceil(bits / 4) are the value itself."""

    def __init__(self, bits: int) -> None:
        self.n = -(-bits // 4)
        if not 1 <= self.n <= _LEN - 2:
            raise ValueError("a code needs at least two check symbols")
        points = np.arange(_LEN)
        vander = np.array([[1 if e == 0 else 0 if x == 0 else _EXP[(_LOG[x] * e) % 15] for e in range(self.n)] for x in points], np.int64)
        self.rows = _product(vander, _inverse(vander[: self.n]))  # data symbols -> all symbols
        times = _mul(self.rows[:, :, None], np.arange(16)[None, None, :])  # position, data symbol, its value
        self.checks = times[self.n :].astype(np.uint8)
        self.known: dict[tuple[int, ...], np.ndarray] = {}  # matrices from the symbols at some positions to the data

    def back(self, at: list[int]) -> np.ndarray:
        if tuple(at) not in self.known:
            self.known[tuple(at)] = _inverse(self.rows[at]).T
        return self.known[tuple(at)]

    def encode(self, values: np.ndarray) -> np.ndarray:
        """Codewords (n x 16) of the values."""
        out = np.zeros((values.size, _LEN), np.uint8)
        v = values.astype(np.uint64)
        for i in range(self.n):
            out[:, i] = (v >> np.uint64(4 * i)) & np.uint64(15)
            for c in range(_LEN - self.n):
                out[:, self.n + c] ^= self.checks[c, i][out[:, i]]
        return out

    def decode(self, heavy: list[list[int]]) -> np.ndarray | None:
        """All values whose codeword has one of the heavy symbols at every position; None: too many combinations."""
        if any(not h for h in heavy):
            return np.empty(0, np.uint64)
        at = sorted(sorted(range(_LEN), key=lambda j: len(heavy[j]))[: self.n])
        if np.prod([float(len(heavy[j])) for j in at]) > _TRIES:
            return None
        words = np.array(list(itertools.product(*(heavy[j] for j in at))), np.int64)
        data = _product(words, self.back(at))
        values = np.zeros(data.shape[0], np.uint64)
        for i in range(self.n):
            values |= data[:, i].astype(np.uint64) << np.uint64(4 * i)
        code = self.encode(values)
        ok = np.all([np.isin(code[:, j], heavy[j]) for j in range(_LEN)], axis=0)
        return np.unique(values[ok])


class Layout:
    """Where a value is counted in each repetition of a round."""

    def __init__(self, share_ppm: int, reps: int, round_no: int) -> None:
        self.bits = max(8, (4_000_000 // share_ppm - 1).bit_length())  # log2 of the groups
        self.groups, self.reps = 1 << self.bits, reps
        self.code = Code(64 - self.bits)
        self.seeds = [np.uint64((0x9E3779B97F4A7C15 * (round_no * reps + r + 1)) % (1 << 64)) for r in range(reps)]

    def split(self, values: np.ndarray, rep: int) -> tuple[np.ndarray, np.ndarray]:
        """(group, what is coded) of 64-bit values."""
        u = mix64(values.astype(np.uint64) + self.seeds[rep])
        return (u >> np.uint64(64 - self.bits)).astype(np.int64), u & np.uint64((1 << (64 - self.bits)) - 1)

    def join(self, group: int, coded: np.ndarray, rep: int) -> np.ndarray:
        return unmix64(coded | np.uint64(group << (64 - self.bits))) - self.seeds[rep]

    def cells(self, values: np.ndarray, rep: int) -> np.ndarray:
        """Cells (n x 16) of values in a repetition."""
        group, coded = self.split(values, rep)
        return (rep * self.groups + group)[:, None] * _CELLS + np.arange(_LEN) * 16 + self.code.encode(coded)


def _sketch(layout: Layout):
    size = layout.reps * layout.groups * _CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)  # a task reads fewer than 2^32 rows
        wait: list[np.ndarray] = []

        def flush() -> None:
            v, n = np.unique(np.concatenate(wait), return_counts=True)
            wait.clear()
            for r in range(layout.reps):
                np.add.at(total, layout.cells(v, r).reshape(-1), np.repeat(n, _LEN).astype(np.uint32))

        held = 0
        for b in batches:
            v = b.column("v").drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            wait.append(v)
            held += v.size
            if held >= _BLOCK:
                flush()
                held = 0
        if held:
            flush()
        for s, x in enumerate(np.split(total, _SLICES)):
            if x.any():
                yield _slice(s, x.astype(np.int64))

    return run


def _slice(s: int, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([pa.compress(x.tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["slice", "cells"])


def _add(n: int, floor: int | None):
    """Sum the arrays of a slice as they stream by; with a floor, return the cells that reach it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, x in zip(b.column("slice").to_pylist(), b.column("cells")):
                got = np.frombuffer(pa.decompress(x.as_py(), 8 * n, codec="zstd", asbytes=True), np.int64)
                sums[s] = sums[s] + got if s in sums else got
        for s, x in sums.items():
            if floor is None:
                yield _slice(s, x)
            else:
                at = np.flatnonzero(x >= floor)
                yield pa.RecordBatch.from_arrays([pa.array(at + s * n), pa.array(x[at])], ["cell", "count"])

    return run


def _decode(layout: Layout, count: dict[int, int], done: set[tuple[int, int]]) -> tuple[set[int], bool]:
    """Values that the heavy cells allow in the groups not yet done, and whether some repetition is done in all its groups."""
    heavy: dict[tuple[int, int], list[list[int]]] = defaultdict(lambda: [[] for _ in range(_LEN)])
    for cell in count:
        group, rest = divmod(cell, _CELLS)
        heavy[divmod(group, layout.groups)][rest // 16].append(rest % 16)
    got: list[list[np.ndarray]] = [[] for _ in range(layout.reps)]
    crowded = set()
    todo = {k: v for k, v in heavy.items() if k not in done}
    alone = [k for k, v in todo.items() if all(len(x) == 1 for x in v)]  # one heavy symbol everywhere: all at once
    if alone:
        words = np.array([[x[0] for x in todo[k]] for k in alone], np.uint8)
        coded = np.zeros(len(alone), np.uint64)
        for i in range(layout.code.n):
            coded |= words[:, i].astype(np.uint64) << np.uint64(4 * i)
        good = (layout.code.encode(coded) == words).all(axis=1)
        done.update(alone)
        for (rep, group), c, ok in zip(alone, coded, good):
            if ok:
                got[rep].append(layout.join(group, np.array([c], np.uint64), rep))
    for (rep, group), symbols in todo.items():
        if (rep, group) in done:
            continue
        coded = layout.code.decode(symbols)
        if coded is None:
            crowded.add(rep)
            continue
        done.add((rep, group))
        got[rep].append(layout.join(group, coded, rep))
    found: set[int] = set()
    there = np.fromiter(count, np.int64, len(count))
    for rep, many in enumerate(got):
        v = np.concatenate([np.empty(0, np.uint64), *many])
        for other in range(layout.reps):  # heavy everywhere
            if other != rep and v.size:
                v = v[np.isin(layout.cells(v, other), there).all(axis=1)]
        found |= {int(x) for x in v.view(np.int64)}
    return found, len(crowded) < layout.reps


def heavy_hitters(df: DataFrame, column: str = "hashcode", share_ppm: int = 5_000, reps: int = 2) -> DataFrame:
    """Values of `column` that fill at least share_ppm millionths of all rows (rows with null included in the rows).

    Returns the value (under the column's name), approx_rows (from the sketch: the least count among the cells of its
    codewords, never too low), n_rows (exact) and share. Integers are coded as they are, values of another type by a 64-bit
    hash whose candidates are counted by value. Memory: reps x groups x 256 counters of 4 bytes a task, the groups being 4 / share
    rounded up to a power of two, whatever the input: 2 MB at 5,000 ppm, 128 MB at 100 ppm. Smaller shares are refused, and so are
    reps outside 1..2. Where rows x share is at most one row every value is heavy; there are then at most 10,000 of them.
    Null is never a value. An empty table gives no rows; ties at the limit are all returned; other columns are ignored.
    """
    if not _LEAST_PPM <= share_ppm <= 1_000_000:
        raise ValueError(f"share_ppm must be {_LEAST_PPM} to 1000000")
    if reps not in (1, 2):
        raise ValueError("reps must be 1 or 2")
    spark, total = df.sparkSession, df.count()
    whole = dict(df.select(column).dtypes)[column] in ("bigint", "int", "smallint", "tinyint")
    code = F.col(column).cast("bigint") if whole else F.when(F.col(column).isNotNull(), F.xxhash64(F.col(column)))
    floor = max(1, -(-total * share_ppm // 1_000_000))
    coded = df.select(code.alias("v"))

    def counted(values: set[int]) -> dict[int, int]:
        if not values:
            return {}
        asked = F.broadcast(spark.createDataFrame([(v,) for v in values], "v bigint"))  # candidates: of the order of 1e6 / share_ppm
        return dict(coded.join(asked, "v").groupBy("v").agg(F.count(F.lit(1))).collect())

    approx: dict[int, int] = {}
    known: dict[int, int] = {}  # exact rows of candidates
    for round_no in range(_ROUNDS if total else 0):
        layout = Layout(share_ppm, reps, round_no)
        size = reps * layout.groups * _CELLS // _SLICES
        wide = parts(spark)
        sums = coded.mapInArrow(_sketch(layout), "slice int, cells binary")
        sums = sums.repartition(4 * wide, F.expr("struct(slice, rand(7))")).mapInArrow(_add(size, None), "slice int, cells binary")
        cells = sums.repartition(min(_SLICES, wide), "slice").mapInArrow(_add(size, floor), "cell bigint, count bigint").collect()  # at most reps x 16 x 1e6 / share_ppm rows
        first = dict(cells)
        left, done = dict(first), set()
        for v, n in known.items():
            _peel(layout, left, v, n, floor)
        while True:
            found, whole_rep = _decode(layout, left, done)
            new = found - set(known)
            rows = counted(new)
            known.update({v: rows.get(v, 0) for v in new})
            if whole_rep or not new:
                break
            for v in new:
                _peel(layout, left, v, known[v], floor)
        for v in known:
            x = np.array([v], np.int64).view(np.uint64)
            approx[v] = min(first.get(int(c), 0) for r in range(reps) for c in layout.cells(x, r)[0])
        if whole_rep:  # every heavy value was decoded, in this repetition or before
            break
    else:
        if total:
            raise RuntimeError(f"heavy values still share groups after {_ROUNDS} rounds")
    heavy = sorted(v for v, n in known.items() if n >= floor)
    if not heavy:
        return df.select(F.col(column)).where(F.lit(False)).select(F.col(column), *(F.lit(None).cast(t).alias(n) for n, t in (("approx_rows", "bigint"), ("n_rows", "bigint"), ("share", "double"))))
    sketch = spark.createDataFrame([(v, approx[v]) for v in heavy], "_c bigint, approx_rows bigint")
    if whole:
        exact = spark.createDataFrame([(v, known[v]) for v in heavy], "_c bigint, n_rows bigint").withColumn("_v", F.col("_c").cast(df.schema[column].dataType))
    else:
        exact = df.where(code.isin(heavy)).select(F.col(column).alias("_v"), code.alias("_c")).groupBy("_v", "_c").agg(F.count(F.lit(1)).alias("n_rows"))
    return exact.where(F.col("n_rows") >= floor).join(F.broadcast(sketch), "_c").select(F.col("_v").alias(column), "approx_rows", "n_rows", (F.col("n_rows") / F.lit(total)).alias("share"))  # at most 1e6 / share_ppm rows


def _peel(layout: Layout, count: dict[int, int], v: int, n: int, floor: int) -> None:
    """Take the rows of a found value off its cells; cells below the floor are heavy no more."""
    x = np.array([v], np.int64).view(np.uint64)
    for r in range(layout.reps):
        for c in layout.cells(x, r)[0].tolist():
            if c in count:
                count[c] -= n
                if count[c] < floor:
                    del count[c]
