"""Has this key been seen before? Sorted hash partitions in Elias-Fano form.

Keys are spread by a bijection of 64-bit words, so two keys never fall together, and cut into partitions by the leading
bits of the result. A partition keeps its sorted words in Elias-Fano form: the high bits in unary, the low bits packed,
about 2 + log2(range / keys) bits a key. Rows come in order of arrival; each block asks the store by a successor search
and its new keys are merged in sequence. With fewer bits than 64 the store is smaller and errs: two keys may share a
word. The rate of that is reported.

A hot key can't burden one task: a task that reads rows decides all rows of a block but the first of each key by itself.

The store outlives a run: `save_store` writes a partition's set as one row, `seen_before(..., store=...)` asks it without the
earlier keys being sent again, and `save_store(..., store=...)` merges a new batch into it, partition by partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.flat import mix64
from ..functions.scratch import parts
from .blobs import dump, load

_BLOCK = 1 << 18
_PER_TASK = 4_000_000
_SUPER = 8  # words of 64 bits per entry of the directory


class EliasFano:
    """A sorted set of 64-bit words within [0, 2^bits)."""

    def __init__(self, words: np.ndarray, bits: int = 64) -> None:
        self.n, self.bits = words.size, bits
        self.low = max(0, bits - max(1, self.n).bit_length())  # high part: about one bit a key
        high = (words >> np.uint64(self.low)).astype(np.int64) if self.low < 64 else np.zeros(self.n, np.int64)
        ones = high + np.arange(self.n)
        length = int(high[-1]) + self.n + 1 if self.n else 1
        mask = np.zeros(-(-length // 512) * 512, np.uint8)
        mask[ones] = 1
        mask[length:] = 1  # no zeros behind the end
        self.upper = np.packbits(mask, bitorder="little").view(np.uint64)
        ones_in = np.bitwise_count(self.upper).astype(np.int64).reshape(-1, _SUPER).sum(axis=1)
        self.zeros = np.concatenate([[0], np.cumsum(64 * _SUPER - ones_in)])  # before each entry
        self.last_high = int(high[-1]) if self.n else -1
        self.packed = self._pack(words)

    def _pack(self, words: np.ndarray) -> np.ndarray:
        if not self.low or not self.n:
            return np.zeros(2, np.uint64)
        x = words & np.uint64((1 << self.low) - 1)
        at = np.arange(self.n, dtype=np.int64) * self.low
        out = np.zeros(int(at[-1] + self.low) // 64 + 2, np.uint64)
        w, s = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(out, w, x << s)
        over = (at & 63) + self.low > 64
        np.bitwise_or.at(out, w[over] + 1, x[over] >> (np.uint64(64) - s[over]))
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(i.size, np.uint64)
        at = i * self.low
        w, s = at >> 6, (at & 63).astype(np.uint64)
        x = self.packed[w] >> s
        over = s > 0
        x[over] |= self.packed[w[over] + 1] << (np.uint64(64) - s[over])
        return x & np.uint64((1 << self.low) - 1)

    def _after_zero(self, k: np.ndarray) -> np.ndarray:
        """Position behind the k-th zero (k from 1) of the unary part."""
        block = np.searchsorted(self.zeros, k, side="left") - 1
        left = k - self.zeros[block]
        word = block * _SUPER
        for _ in range(_SUPER - 1):
            z = 64 - np.bitwise_count(self.upper[word]).astype(np.int64)
            go = left > z
            if not go.any():
                break
            left = np.where(go, left - z, left)
            word = np.where(go, word + 1, word)
        bits = np.unpackbits((~self.upper[word]).view(np.uint8), bitorder="little").reshape(-1, 64)
        return word * 64 + np.argmax(np.cumsum(bits, axis=1, dtype=np.int8) == left[:, None], axis=1) + 1

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least word >= x of the set, and whether there is one."""
        out, there = np.zeros(x.size, np.uint64), np.zeros(x.size, bool)
        if not self.n or not x.size:
            return out, there
        high = (x >> np.uint64(self.low)).astype(np.int64)
        at = np.flatnonzero(high <= self.last_high)
        h = high[at]
        start = np.zeros(at.size, np.int64)
        pos = h > 0
        start[pos] = self._after_zero(h[pos])
        i, bit = start - h, start
        want = x[at] & np.uint64((1 << self.low) - 1) if self.low else np.zeros(at.size, np.uint64)
        while at.size:  # a step within the bucket, or on to the next bucket that has a word
            one = (self.upper[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
            low = self._low(np.minimum(i, self.n - 1))
            got = one & ((low >= want) | (h > high[at])) & (i < self.n)
            out[at[got]] = (h[got].astype(np.uint64) << np.uint64(self.low)) | low[got]
            there[at[got]] = True
            i, h, bit = np.where(one, i + 1, i), np.where(one, h, h + 1), bit + 1
            keep = ~got & (h <= self.last_high)
            at, i, h, bit, want = at[keep], i[keep], h[keep], bit[keep], want[keep]
        return out, there

    def has(self, x: np.ndarray) -> np.ndarray:
        word, there = self.successor(x)
        return there & (word == x)

    def all(self) -> np.ndarray:
        bits = np.unpackbits(self.upper.view(np.uint8), bitorder="little")
        ones = np.flatnonzero(bits)[: self.n]
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)) | self._low(np.arange(self.n, dtype=np.int64))

    def nbytes(self) -> int:
        return self.upper.nbytes + self.zeros.nbytes + self.packed.nbytes

    def dump(self) -> bytes:
        return dump(np.array([self.n, self.bits, self.low, self.last_high]), self.upper, self.zeros, self.packed)

    @staticmethod
    def load(raw: bytes) -> EliasFano:
        out = EliasFano.__new__(EliasFano)
        head, out.upper, out.zeros, out.packed = load(raw, np.int64, np.uint64, np.int64, np.uint64)
        out.n, out.bits, out.low, out.last_high = (int(x) for x in head)
        return out


class Store:
    """An Elias-Fano set and the newest words, still plain; these are merged in when a quarter is new."""

    def __init__(self, bits: int) -> None:
        self.bits, self.old, self.new = bits, EliasFano(np.empty(0, np.uint64), bits), np.empty(0, np.uint64)

    def has(self, x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.new, x), max(0, self.new.size - 1))
        return self.old.has(x) | ((self.new[at] == x) if self.new.size else False)

    def add(self, fresh: np.ndarray) -> None:
        """`fresh`: sorted, distinct, not yet in the store."""
        self.new = np.sort(np.concatenate([self.new, fresh]), kind="stable")
        if self.new.size > max(1 << 16, self.old.n // 4):
            self.old = EliasFano(np.sort(np.concatenate([self.old.all(), self.new]), kind="stable"), self.bits)
            self.new = np.empty(0, np.uint64)


def _words(keys: np.ndarray, bits: int) -> np.ndarray:
    return mix64(keys.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)


def _first_in_block(n_parts: int):
    """Rows that are not the first of their key in a block are decided here; the others go on to their key's partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(wait).combine_chunks()
            wait.clear()
            key, no = t.column("key").to_numpy().astype(np.int64), t.column("no").to_numpy().astype(np.int64)
            order = np.lexsort((no, key))
            key, no = key[order], no[order]
            first = np.ones(key.size, bool)
            first[1:] = key[1:] != key[:-1]
            word = mix64(key.view(np.uint64))
            part = ((word >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int32)
            part[~first] = (no[~first] % n_parts).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(no), pa.array(key), pa.array(~first)], ["part", "no", "key", "decided"])

        held = 0
        for b in batches:
            wait.append(b)
            held += b.num_rows
            if held >= _BLOCK:
                yield from flush()
                held = 0
        if held:
            yield from flush()

    return run


def _probe(bits: int):
    """Rows of one partition in order of arrival -> the answer of the store for each; the saved set, then `known` keys come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(bits)
        for b in batches:
            for raw in b.column("saved").drop_null():
                store.old = EliasFano.load(raw.as_py())
            b = b.filter(pc.is_null(b.column("saved")))
            if not b.num_rows:
                continue
            key, no = b.column("key").to_numpy().astype(np.int64), b.column("no").to_numpy(zero_copy_only=False).astype(np.int64)
            known, seen = b.column("known").to_numpy(zero_copy_only=False), b.column("decided").to_numpy(zero_copy_only=False).astype(bool)
            ask = np.flatnonzero(~seen)
            word = _words(key[ask], bits)
            uniq, first, inv = np.unique(word, return_index=True, return_inverse=True)
            old = store.has(uniq)
            answer = old[inv]
            later = np.ones(ask.size, bool)
            later[first] = False
            seen = seen.copy()
            seen[ask] = answer | later
            store.add(uniq[~old])
            out = ~known
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(no[out]), pa.array(key[out]), pa.array(seen[out])], ["no", "key", "seen"])

    return run


_ROWS = "part int, no bigint, key bigint, decided boolean"


def _spread(df: DataFrame, n_parts: int) -> DataFrame:
    """Rows by partition of their key: partition p is task p, in order of arrival."""
    return df.repartitionById(n_parts, F.col("part")).sortWithinPartitions(F.col("known").desc(), "no")


def _blocks(rows: DataFrame, n_parts: int, known: bool) -> DataFrame:
    return rows.mapInArrow(_first_in_block(n_parts), _ROWS).withColumn("known", F.lit(known)).withColumn("saved", F.lit(None).cast("binary"))


def _keys(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(F.lit(-(1 << 63) + 1).cast("bigint").alias("no"), F.col(key).cast("bigint").alias("key")).distinct()


def _saved(spark: SparkSession, store: str, bits: int) -> tuple[DataFrame, int]:
    s = spark.read.parquet(store)
    head = s.agg(F.max("n_parts"), F.max("bits"), F.min("bits"), F.count(F.lit(1))).first()
    if head[3] != head[0] or head[1] != bits or head[2] != bits:
        raise ValueError(f"{store} is no whole store of {bits} bits")
    rows = s.select("part", F.lit(-(1 << 63)).cast("bigint").alias("no"), F.lit(0).cast("bigint").alias("key"), F.lit(False).alias("decided"), F.lit(True).alias("known"), "saved")
    return rows, int(head[0])


def _size(df: DataFrame, known: DataFrame | None) -> int:
    return df.count() + (known.count() if known is not None else 0)


def seen_before(df: DataFrame, known: DataFrame | None = None, key: str = "hashcode", order: str = "arrival_no", known_key: str = "hashcode", bits: int = 64, store: str | None = None) -> DataFrame:
    """For each row with a non-null key: (order, key, seen) - whether the key is in `known`, in the saved `store` (a folder
    written by save_store with as many bits) or in a row of smaller `order`.

    `key` and `order` are integers; rows with a null key or a null `order` get no answer. bits=64 is exact; fewer bits
    save memory at a rate of wrong answers of about keys / 2^bits, all of them "seen" (see error_rate). Rows with equal
    `order` and key: one of them counts as the first. Other columns are ignored; an empty table gives no rows.
    """
    if not 8 <= bits <= 64:
        raise ValueError("bits must be 8 to 64")
    spark = df.sparkSession
    saved, n_parts = _saved(spark, store, bits) if store else (None, max(parts(spark), _size(df, known) // _PER_TASK))
    rows = df.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(F.col(order).cast("bigint").alias("no"), F.col(key).cast("bigint").alias("key"))
    rows = _blocks(rows, n_parts, False)
    if known is not None:
        rows = rows.unionByName(_blocks(_keys(known, known_key), n_parts, True))
    if saved is not None:
        rows = rows.unionByName(saved)
    rows = _spread(rows, n_parts).select("no", "key", "decided", "known", "saved")
    return rows.mapInArrow(_probe(bits), "no bigint, key bigint, seen boolean").select(F.col("no").alias(order), F.col("key").alias(key), "seen")


def _merge(bits: int, n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, part = Store(bits), TaskContext.get().partitionId()
        for b in batches:
            for raw in b.column("saved").drop_null():
                store.old = EliasFano.load(raw.as_py())
            key = b.filter(pc.and_(pc.is_null(b.column("saved")), pc.invert(b.column("decided")))).column("key")
            word = np.unique(_words(key.to_numpy().astype(np.int64), bits))
            store.add(word[~store.has(word)])
        whole = EliasFano(np.sort(np.concatenate([store.old.all(), store.new]), kind="stable"), bits)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n_parts], pa.int32()), pa.array([bits], pa.int32()), pa.array([whole.n], pa.int64()), pa.array([whole.dump()], pa.binary())], ["part", "n_parts", "bits", "n_keys", "saved"])

    return run


def save_store(keys: DataFrame, path: str, key: str = "hashcode", bits: int = 64, store: str | None = None, n_parts: int | None = None) -> None:
    """Write the keys (with those of an earlier `store`, which is left as it is) as a store at `path`: a row a partition.

    A store keeps the number of its partitions; choose n_parts for the keys that are to come (4,000,000 a partition). Null keys
    are left out; an empty table gives an empty store. `path` must not be the folder of `store`."""
    spark = keys.sparkSession
    saved, n = _saved(spark, store, bits) if store else (None, n_parts or max(parts(spark), keys.count() // _PER_TASK))
    rows = _blocks(_keys(keys, key), n, False)
    if saved is not None:
        rows = rows.unionByName(saved)
    merged = _spread(rows, n).select("key", "decided", "saved").mapInArrow(_merge(bits, n), "part int, n_parts int, bits int, n_keys bigint, saved binary")
    merged.write.mode("errorifexists").parquet(path)


def error_rate(df: DataFrame, known: DataFrame | None = None, key: str = "hashcode", order: str = "arrival_no", known_key: str = "hashcode", bits: int = 32) -> DataFrame:
    """One row: answers, seen, wrong answers of a store of `bits` bits against the exact one, and their rate."""
    a = seen_before(df, known, key, order, known_key, bits).select(F.col(order).alias("no"), F.col("seen").cast("bigint").alias("got"), F.lit(0).cast("bigint").alias("true"))
    b = seen_before(df, known, key, order, known_key, 64).select(F.col(order).alias("no"), F.lit(0).cast("bigint").alias("got"), F.col("seen").cast("bigint").alias("true"))
    both = a.unionByName(b).groupBy("no").agg(F.sum("got").alias("got"), F.sum("true").alias("true"))
    wrong = F.sum(F.abs(F.col("got") - F.col("true")))
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum("true"), F.lit(0)).alias("n_seen"),
        F.coalesce(wrong, F.lit(0)).alias("n_wrong"),
        F.coalesce(wrong / F.count(F.lit(1)), F.lit(0.0)).alias("wrong_rate"),
        F.lit(bits).alias("bits"),
    )
