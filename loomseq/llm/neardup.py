"""Near-duplicate records with small edits: tensored banding of MinHash values.

Instead of rows x bands independent hash functions, two small collections A (m functions) and B (16 functions) of MinHash
values are computed, and every pair (a_i, b_j) is the key of one of 16 m tables: m + 16 functions serve them all. A record is
sent once for each a_i, with one byte of each B value and four bits of each A value; the tables (a_i, b_j) are formed inside the bucket of a_i, whatever
the size of a group. Records that meet there and agree in two values of B (five of A and B together) are candidates: one
common word makes hardly any. Two records of similarity 0.6 miss each other with a chance of about 0.012 % at m = 10.
Candidates are verified by the exact similarity of their whole word sets.

Where the tables (a_i, b_j) of a group make too many meetings a record, its tables take a third value, (a_i, b_j, b_k);
that loses nothing, as candidates agree in two values of B anyway. A group in which that is not enough shares a long text
(an adapter in a third of all reads): MinHash can't tell its pairs apart at any width, as they are nearly similar. Its
records, and those of an a_i too frequent for one task, are joined exactly on the words they do not all share: words are
ordered by their frequency, the shared text comes last, and a pair that is similar enough must have a word in common
among the first n - ceil(n 2t / (1 + t)) + 1 of the smaller and the first n - ceil(n t) + 1 of the larger record. A bit map of a record's
infrequent words goes with them and bounds what two records can share, so pairs that share the long text only are never
made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flat import flat_codes, kmers, mix64, ranges, rc_kmers, runs, slices, window_ok
from ..functions.scratch import parts, written
from ..operators.components import components
from .blobs import by_bucket, dump, load, rows
from .spans import records

_BLOCK = 1 << 20
_HOLD = 12 << 20
_PER_BUCKET = 50_000
_PER_TASK = 8  # buckets
_PAIRS = 2 << 20  # pairs looked at at once
_MEET = (128, 240)  # meetings a record in tables (a_i, b_j), and (a_i, b_j, b_k), above which the next way takes the group
_SLOTS = 1 << 20  # counters of a_i values and of words, whatever the input
_HOT = 4096  # entries of one a_i value (or 64 times the mean of a counter, if that is more) that are not sent
_FREQUENT = 100  # a word of more than one in so many records of the exact join is frequent
_PER_WORD = 100_000  # entries of one word in a block
_MAP = 8  # machine words of a record's bit map
_B = 16
_LEAST_B, _LEAST = 2, 5  # equal values of B, and of A and B together, that make a candidate
_RNG = np.random.default_rng(20)
_ODD = (_RNG.integers(0, 1 << 31, (2, 64), dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_PLUS = _RNG.integers(0, 1 << 32, 64, dtype=np.uint32)


def words(codes: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Canonical words (the lesser of word and reverse complement, as numbers) of all records and the record of each."""
    ok = np.flatnonzero(window_ok(codes, off, k))
    w = np.minimum(kmers(codes, k), rc_kmers(codes, k))[ok]
    return w, np.searchsorted(off, ok, side="right") - 1


def _signature(w: np.ndarray, rec: np.ndarray, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Records that have words, and n MinHash values (from function `first` on) of each."""
    start = runs(rec)[:-1]
    if not w.size:
        return np.empty(0, np.int64), np.empty((n, 0), np.uint32)
    h = w.astype(np.uint32) if w.dtype == np.uint32 else (mix64(w) >> np.uint64(32)).astype(np.uint32)
    h = h * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(16)
    out = np.empty((n, start.size), np.uint32)
    for i in range(n):
        g = h * _ODD[0, first + i] + _PLUS[first + i]
        g ^= g >> np.uint32(15)
        g *= _ODD[1, first + i]
        g ^= g >> np.uint32(13)
        out[i] = np.minimum.reduceat(g, start)
    return rec[start], out


def _bucket(a: np.ndarray, n_buckets: int) -> np.ndarray:
    """a: m x records -> bucket of each entry; the table's number is part of the key."""
    key = (np.arange(a.shape[0], dtype=np.uint64)[:, None] << np.uint64(32)) | a
    return (mix64(key) % np.uint64(n_buckets)).astype(np.int64)


def _slot(a: np.ndarray) -> np.ndarray:
    return (mix64((np.arange(a.shape[0], dtype=np.uint64)[:, None] << np.uint64(32)) | a) % np.uint64(_SLOTS)).astype(np.int64)


def _counted(n: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["slot", "n"])


def _count(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(_SLOTS, np.int64)
        for b in slices(batches, "seq", _BLOCK):
            n += np.bincount(_slot(_signature(*words(*flat_codes(b.column("seq")), k), 0, m)[1]).reshape(-1), minlength=_SLOTS)
        yield _counted(n)

    return run


class _Held:
    """Arrays with the bucket of each entry until there are enough of them; only then are they split, once for many blocks."""

    def __init__(self) -> None:
        self.got: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def put(self, bucket: np.ndarray, *arrays: np.ndarray) -> None:
        self.got.append((bucket, *arrays))
        self.size += sum(x.nbytes for x in arrays)

    def flush(self) -> pa.RecordBatch:
        out = [(b, dump(*x)) for b, x in by_bucket(*(np.concatenate([g[i] for g in self.got]) for i in range(len(self.got[0]))))]
        self.got, self.size = [], 0
        return rows([b for b, _ in out], [v for _, v in out])


def _send(k: int, m: int, n_buckets: int, hot: np.ndarray):
    """Entries of a_i by bucket; the records of a hot a_i go out with bucket -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for b in slices(batches, "seq", _BLOCK):
            ids = b.column("id").to_numpy().astype(np.int64)
            rec, sig = _signature(*words(*flat_codes(b.column("seq")), k), 0, m + _B)
            if not rec.size:
                continue
            a, low = sig[:m], np.ascontiguousarray((sig[m:] >> np.uint32(8)).astype(np.uint8).T)
            tag = np.bitwise_or.reduce([((x & np.uint32(15)).astype(np.uint64)) << np.uint64(4 * i) for i, x in enumerate(a)])
            tag = tag.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (m + 1) // 2]
            too_many = np.isin(_slot(a), hot) if hot.size else np.zeros(a.shape, bool)
            member = np.flatnonzero(too_many.any(axis=0))
            if member.size:
                yield rows([-1], [dump(ids[rec[member]])])
            i, r = np.nonzero(~too_many)
            held.put(_bucket(a, n_buckets)[i, r], i.astype(np.uint8), a[i, r], ids[rec[r]], low[r], tag[r])
            if held.size > _HOLD:
                yield held.flush()
        if held.size:
            yield held.flush()

    return run


def _distinct(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.minimum(x, y) * n + np.maximum(x, y)
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])] if key.size else key
    return key // n, key % n


def _pairs_of(order: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within the runs of `order`, some millions at once: each place with those before it in its run."""
    at, first, n = ranges(start, size), np.repeat(start, size), ranges(np.zeros(size.size, np.int64), size)
    upto = np.cumsum(n)
    cut = np.unique(np.concatenate([[0], np.searchsorted(upto, np.arange(_PAIRS, int(upto[-1]) if n.size else 0, _PAIRS)), [n.size]]))
    for lo, hi in zip(cut[:-1], cut[1:]):
        yield order[ranges(first[lo:hi], n[lo:hi])], order[np.repeat(at[lo:hi], n[lo:hi])]


def _equal_b(wide: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal bytes of records x and y over all words: a byte of the difference that is not zero leaves its highest bit."""
    seven, n = np.uint64(0x7F7F7F7F7F7F7F7F), np.full(x.size, 8 * len(wide), np.int64)
    for w in wide:
        z = w[x]
        z ^= w[y]
        high = z & seven
        high += seven
        high |= z
        n -= np.bitwise_count(high & ~seven)
    return n


def _equal_a(x: np.ndarray, y: np.ndarray, m: int) -> np.ndarray:
    """Equal values of A at most, by four bits of each."""
    z = x ^ y
    z |= z >> np.uint64(1)
    z |= z >> np.uint64(2)
    return m - np.bitwise_count(z & np.uint64(0x1111111111111111)).astype(np.int64)


def _meet(m: int):
    """Candidate pairs of a bucket with their equal B values, and the records for the exact join (id_b null)."""
    levels = ([(j,) for j in range(_B)], [(j, k) for k in range(_B) for j in range(k)])

    def run(table: pa.Table) -> pa.Table:
        none = np.empty(0, np.int64)
        if table.column("bucket")[0].as_py() == -1:
            i, j, n_b, member = none, none, none, np.concatenate([load(v.as_py(), np.int64)[0] for v in table.column("blob")])
            ids = none
        else:
            got = [load(v.as_py(), np.uint8, np.uint32, np.int64, np.uint8, np.uint8) for v in table.column("blob")]
            table_no, a, ids, low, tag = (np.concatenate([g[i] for g in got]) for i in range(5))
            low = low.reshape(-1, _B)
            tag = np.pad(tag.reshape(ids.size, -1), ((0, 0), (0, 8 - (m + 1) // 2))).view("<u8").reshape(-1).astype(np.uint64)
            wide = [np.ascontiguousarray(w) for w in np.ascontiguousarray(low).view(np.uint64).T]
            key = (table_no.astype(np.uint64) << np.uint64(32)) | a
            group = np.unique(key, return_inverse=True)[1].reshape(-1)
            per = np.bincount(group)
            rest = np.flatnonzero(per[group] > 1)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for level, limit in zip(levels, _MEET):
                tables, meet = [], np.zeros(per.size, np.int64)
                for js in level:
                    t = key[rest]
                    for j in js:
                        t = mix64(t ^ mix64(low[rest, j].astype(np.uint64) | np.uint64((j + 1) << 8)))
                    order = np.argsort(t)
                    edge = runs(t[order])
                    size = np.diff(edge)
                    more = size > 1
                    start, size = edge[:-1][more], size[more]
                    np.add.at(meet, group[rest[order[start]]], size * (size - 1) // 2)
                    tables.append((rest[order], start, size))
                ok = meet <= limit * per
                for order, start, size in tables:
                    pick = ok[group[order[start]]]
                    for x, y in _pairs_of(order, start[pick], size[pick]):
                        n_b = _equal_b(wide, x, y)
                        good = np.flatnonzero(n_b >= _LEAST_B)
                        x, y, n_b = x[good], y[good], n_b[good]
                        good = _equal_a(tag[x], tag[y], m) + n_b >= _LEAST  # others can't become candidates: most pairs, and the more the larger the input
                        found.append((x[good], y[good]))
                rest = rest[~ok[group[rest]]]
            member = ids[rest]
            i, j = _distinct(*(np.concatenate([none, *(f[c] for f in found)]) for c in (0, 1)), max(1, key.size))
            n_b = _equal_b(wide, i, j)
        x, y = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        two = x != y
        x, y, n_b = x[two], y[two], n_b[two]
        w = np.unique(member)
        return pa.table({"id_a": np.concatenate([x, w]), "id_b": pa.concat_arrays([pa.array(y), pa.nulls(w.size, pa.int64())]), "n_b": np.concatenate([n_b, np.zeros(w.size, np.int64)]).astype(np.int32)})

    return run


def _exact(k: int, num: int, den: int):
    """Pairs with their texts -> pairs with |both| / |either| >= num / den, compared as whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in slices(batches, "seq_a", _BLOCK):
            for b in slices(iter([big]), "seq_b", _BLOCK):
                sets = []
                for c in ("seq_a", "seq_b"):
                    w, rec = words(*flat_codes(b.column(c)), k)
                    if k <= 16:
                        key = (rec.astype(np.uint64) << np.uint64(32)) | w
                        key.sort()
                        sets.append(key[np.append(True, key[1:] != key[:-1])] if key.size else key)
                n_a, n_b = (np.bincount((s >> np.uint64(32)).astype(np.int64), minlength=b.num_rows) for s in sets)
                both = np.bincount((np.intersect1d(*sets, assume_unique=True) >> np.uint64(32)).astype(np.int64), minlength=b.num_rows)
                either = n_a + n_b - both
                ok = (both * den >= either * num) & (both > 0)
                if ok.any():
                    t = pa.RecordBatch.from_arrays([b.column("id_a"), b.column("id_b"), pa.array(both), pa.array(either)], ["id_a", "id_b", "n_both", "n_either"])
                    yield t.filter(pa.array(ok))

    return run


def _sets(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each record of a batch and the record of each, in order."""
    w, rec = words(*flat_codes(b.column("seq")), k)
    key = np.unique((rec.astype(np.uint64) << np.uint64(32)) | w)
    return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), (key >> np.uint64(32)).astype(np.int64)


def _word_slot(w: np.ndarray) -> np.ndarray:
    return (mix64(w.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) % np.uint64(_SLOTS)).astype(np.int64)


def _word_counts(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(_SLOTS, np.int64)
        for b in slices(batches, "seq", _BLOCK):
            n += np.bincount(_word_slot(_sets(b, k)[0]), minlength=_SLOTS)
        yield _counted(n)

    return run


def _prefixes(k: int, num: int, den: int, often: bytes, frequent: int, n_buckets: int):
    """The first words of each record by frequency, to the bucket of the word, with the record's size and bit map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(pa.decompress(often, 8 * _SLOTS, codec="zstd", asbytes=True), np.int64)
        held = _Held()
        for b in slices(batches, "seq", _BLOCK):
            ids = b.column("id").to_numpy().astype(np.int64)
            w, rec = _sets(b, k)
            if not w.size:
                continue
            f = counts[_word_slot(w)]
            order = np.lexsort((w, f, rec))
            w, f = w[order], f[order]
            start = runs(rec)[:-1]
            size = np.diff(np.append(start, rec.size))
            n = np.repeat(size, size)
            rank = np.arange(w.size) - np.repeat(start, size)
            rare = f <= frequent
            bits = np.zeros((start.size, _MAP), np.uint64)
            no = np.repeat(np.arange(start.size), size)
            bit = (mix64(w.astype(np.uint64)) >> np.uint64(40)) % np.uint64(64 * _MAP)
            np.bitwise_or.at(bits, (no[rare], (bit[rare] >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit[rare] & np.uint64(63)))
            n_rare = np.add.reduceat(rare.astype(np.int64), start)
            probe = np.flatnonzero(rank <= n - -(-n * num // den))
            first = rank <= n - -(-2 * num * n // (num + den))
            blocks = 1 + f[probe] // _PER_WORD  # a word of many records: its first words in columns, all its words in rows of blocks
            own = (mix64(ids[rec[probe]].astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
            for is_first, at, o, nb in ((True, probe[first[probe]], own[first[probe]], blocks[first[probe]]), (False, probe, own, blocks)):
                other, at2, o2, nb2 = ranges(np.zeros(at.size, np.int64), nb), np.repeat(at, nb), np.repeat(o, nb), np.repeat(nb, nb)
                cell = o2 * nb2 + other if is_first else other * nb2 + o2
                to = (mix64(mix64(w[at2].astype(np.uint64)) + cell.astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
                held.put(to, (w[at2].astype(np.uint64) << np.uint64(32)) | cell.astype(np.uint64), np.full(at2.size, is_first), ids[rec[at2]], n[at2].astype(np.int32), n_rare[no[at2]].astype(np.int32), bits[no[at2]])
            if held.size > _HOLD:
                yield held.flush()
        if held.size:
            yield held.flush()

    return run


def _meet_words(num: int, den: int):
    """Pairs of a first word of one record and a word of another, which their sizes and bit maps allow."""

    def run(table: pa.Table) -> pa.Table:
        got = [load(v.as_py(), np.uint64, np.bool_, np.int64, np.int32, np.int32, np.uint64) for v in table.column("blob")]
        word, is_first, ids, n, n_rare, bits = (np.concatenate([g[i] for g in got]) for i in range(6))
        bits = bits.reshape(-1, _MAP)
        n, n_rare = n.astype(np.int64), n_rare.astype(np.int64)
        doubled = n_rare - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)  # rare words whose bit was set before
        order = np.lexsort((~is_first, word))
        edge = runs(word[order])
        n_first = np.add.reduceat(is_first[order].astype(np.int64), edge[:-1]) if word.size else np.empty(0, np.int64)
        n_all = np.diff(edge) - n_first
        x = ranges(edge[:-1], n_first)  # places of first words; each meets the n_all words behind them
        behind, many = np.repeat(edge[:-1] + n_first, n_first), np.repeat(n_all, n_first)
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        upto = np.cumsum(many)
        cut = np.unique(np.concatenate([[0], np.searchsorted(upto, np.arange(_PAIRS, int(upto[-1]) if many.size else 0, _PAIRS)), [x.size]]))
        for lo, hi in zip(cut[:-1], cut[1:]):
            i = order[np.repeat(x[lo:hi], many[lo:hi])]
            j = order[ranges(behind[lo:hi], many[lo:hi])]
            ok = ((n[i] < n[j]) | ((n[i] == n[j]) & (ids[i] < ids[j]))) & (n[i] * den >= n[j] * num)
            i, j = i[ok], j[ok]
            most = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64) + np.minimum(doubled[i], doubled[j]) + np.minimum(n[i] - n_rare[i], n[j] - n_rare[j])
            ok = most * (num + den) >= num * (n[i] + n[j])
            out.append((np.minimum(ids[i[ok]], ids[j[ok]]), np.maximum(ids[i[ok]], ids[j[ok]])))
        a, b = (np.concatenate([o[c] for o in out]) for c in (0, 1))
        at = np.lexsort((b, a))
        a, b = a[at], b[at]
        new = np.ones(a.size, bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return pa.table({"id_a": a[new], "id_b": b[new]})

    return run


def _exact_join(members: DataFrame, recs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Candidates among `members` by an exact prefix filter; those it leaves out can't be similar enough."""
    mem = written(recs.join(members.distinct().hint("shuffle_hash"), "id", "left_semi"), "near-members")
    n = mem.count()
    slots = mem.mapInArrow(_word_counts(k), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # _SLOTS rows at most
    often = np.zeros(_SLOTS, np.int64)
    often[slots.column("slot").to_numpy()] = slots.column("n").to_numpy()
    n_words = int(often.sum())
    n_buckets = n_words // _PER_BUCKET + 4
    packed = pa.compress(often.tobytes(), codec="zstd", asbytes=True)
    sent = mem.mapInArrow(_prefixes(k, num, den, packed, max(4, n // _FREQUENT), n_buckets), "bucket bigint, blob binary")
    sent = sent.repartition(max(parts(recs.sparkSession), n_buckets // _PER_TASK), "bucket")
    return sent.groupBy("bucket").applyInArrow(_meet_words(num, den), "id_a bigint, id_b bigint")


def candidates(recs: DataFrame, k: int = 12, num: int = 3, den: int = 5, m: int = 10) -> DataFrame:
    """Distinct candidate pairs (id_a, id_b) of records (id, seq); pairs not among them are dissimilar, but for chance."""
    spark = recs.sparkSession
    n = recs.count()
    n_buckets = n * m // _PER_BUCKET + 16
    counts = recs.mapInArrow(_count(k, m), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    limit = max(_HOT, 64 * n * m // _SLOTS)
    hot = np.array([r[0] for r in counts.where(F.col("n") > limit).collect()], np.int64)  # at most _SLOTS / 64 rows
    sent = recs.mapInArrow(_send(k, m, n_buckets, hot), "bucket bigint, blob binary")
    salt = F.when(F.col("bucket") == -1, (F.rand(3) * n_buckets).cast("int")).otherwise(0)
    sent = sent.withColumn("salt", salt).repartition(max(parts(spark), n_buckets // _PER_TASK), "bucket", "salt")
    met = written(sent.groupBy("bucket", "salt").applyInArrow(_meet(m), "id_a bigint, id_b bigint, n_b int"), "near-candidates")
    pairs = met.where("id_b is not null").groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("n_a"), F.max("n_b").alias("n_b"))
    pairs = pairs.where(F.col("n_a") + F.col("n_b") >= _LEAST).select("id_a", "id_b")
    members = met.where("id_b is null").select(F.col("id_a").alias("id"))
    if not members.isEmpty():
        pairs = pairs.unionByName(_exact_join(members, recs, k, num, den)).distinct()
    return pairs


def near_pairs(df: DataFrame, rec_id: str, seq: str, merge_equal: bool = False, k: int = 12, num: int = 3, den: int = 5, m: int = 10) -> DataFrame:
    """Pairs of records whose sets of canonical k-letter words have a similarity (both / either) of at least num / den.

    Returns id_a < id_b, n_both, n_either. Words hold A, C, G, T only (any case), each replaced by its reverse complement
    if that is less; a record without words is in no pair. merge_equal: equal texts are one record under their least id.
    Rows with a null id or text are no records. Whole texts of any length are compared. An empty table gives no rows;
    further columns are ignored. k <= 16.
    """
    if not 1 <= k <= 16 or not 1 <= m <= 16:
        raise ValueError("k and m must be 1 to 16")
    recs = written(records(df, rec_id, seq, merge_equal), "near-records")
    pairs = written(candidates(recs, k, num, den, m), "near-pairs")
    ids = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    texts = written(recs.join(ids.hint("shuffle_hash"), "id", "left_semi"), "near-texts")  # ids grow with the records: never a broadcast
    a, b = (texts.select(F.col("id").alias(f"id_{s}"), F.col("seq").alias(f"seq_{s}")) for s in "ab")
    full_pairs = pairs.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", "seq_a", "seq_b")
    return full_pairs.mapInArrow(_exact(k, num, den), "id_a bigint, id_b bigint, n_both bigint, n_either bigint")


def near_groups(df: DataFrame, rec_id: str, seq: str, merge_equal: bool = False, **how) -> DataFrame:
    """One row a record: rec_id, class_id (the least id it is linked to over any number of near pairs) and n_links.

    With merge_equal every id of an equal text has a row, and the class and links of the record that stands for them; else
    copies are records of their own. A record without partners is a class of its own with 0 links. Rows with a null id or
    text have no row."""
    pairs = written(near_pairs(df, rec_id, seq, merge_equal, **how).select("id_a", "id_b"), "near-links")
    both = pairs.unionByName(pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    linked = both.groupBy(F.col("id_a").alias("id")).agg(F.count(F.lit(1)).alias("n_links")).join(components(pairs, "id_a", "id_b").withColumnRenamed("node", "id"), "id")
    text = F.substring(F.unhex(F.sha2(F.upper(F.col(seq)), 256)), 1, 16) if merge_equal else F.lit(None).cast("binary")
    ids = df.where(F.col(rec_id).isNotNull() & F.col(seq).isNotNull()).select(F.col(rec_id).cast("bigint").alias("rec_id"), text.alias("text")).distinct()
    if merge_equal:  # members find the record that stands for them by a digest of the text, not by the text
        ids = ids.join(ids.groupBy("text").agg(F.min("rec_id").alias("id")), "text").select("rec_id", "id").distinct()
    else:
        ids = ids.select("rec_id", F.col("rec_id").alias("id"))
    out = ids.join(linked, "id", "left")
    return out.select("rec_id", F.coalesce("component", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
