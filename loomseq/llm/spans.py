"""Long exact spans shared between records: paragraph MinHash banding with exact verification.

A paragraph is a window of `min_len` letters; each of its MinHash values is the least of one hash function over its
k-letter words. Values are tuned into bands of rows (`tune_bands`): of all bands that find a pair of the similarity wanted
with the recall wanted, the cheapest ones, counted in what is sent and in what meets by chance. A span must be the same
letter for letter, so paragraphs have a similarity of 1: one band has full recall, and rows are added only while they save
more chance meetings than they cut stretches. Neighbouring paragraphs mostly share their values, so a record falls into few
stretches, each sent once to the bucket of its band. In a bucket the paragraphs are verified at edit distance 0: compared
letter for letter (32 letters a machine word), those that stand in two different records are shared. No pairs are made: a
run of equal paragraphs is settled by its least and greatest record, and records are clustered by components of stars.

A first pass counts the stretches of each bucket. The stretches of a bucket that is too full for one task (a hot MinHash)
are cut into their paragraphs and settled among themselves inside each block. What goes on, spread by their own hash, is
every place of a paragraph that only one record of the block holds, as its verdict is still open, and of a paragraph that
is shared in the block, whose places are all marked there, two places.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.flat import flat_codes, kmers, mix64, ranges, slices, sliding_min, window_ok
from ..functions.scratch import parts, written
from ..operators.components import components
from .blobs import by_bucket, dump, load, pack_bits, rows, unpack_bits

_BLOCK = 1 << 20  # letters a task works on at once
_HOLD = 8 << 20
_PER_BUCKET = 50_000
_PER_TASK = 8  # buckets
_FULL = 4 * _PER_BUCKET


def tune_bands(letters: int, min_len: int, k: int, similarity: float = 1.0, recall: float = 0.9999, most: int = 16) -> tuple[int, int]:
    """(bands, rows) with 1 - (1 - similarity^rows)^bands >= recall at the least cost a paragraph.

    Cost: stretches sent (a value changes every (w + 1) / 2 paragraphs of w words, each of the rows by itself) and paragraphs
    of other texts met by chance (letters / 4^k for one row, a 4^k-th of that for each row more)."""
    w = min_len - k + 1
    options = []
    for rows in range(1, most + 1):
        hit = similarity**rows
        if hit >= recall:
            bands = 1
        elif hit > 0:
            bands = math.ceil(math.log(1 - recall) / math.log(1 - hit))
        else:
            continue
        stretches = bands * min(1.0, 2 * rows / (w + 1))
        options.append((stretches * (min_len / w + letters * (4.0**-k) ** rows), rows, bands))
    if not options:
        raise ValueError("no bands reach the recall")
    _, rows, bands = min(options)
    return bands, rows


def _min_hash(codes: np.ndarray, min_len: int, k: int, no: int) -> np.ndarray:
    """MinHash value of function `no` of the paragraph at each place."""
    h = kmers(codes, k)
    h = (h * np.uint32(0x9E3779B1)) if h.dtype == np.uint32 else mix64(h)
    if no:
        h = (mix64(h.astype(np.uint64) + np.uint64(no << 40)) >> np.uint64(32)).astype(np.uint32)
    if h.dtype == np.uint32:
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        h ^= h >> np.uint32(13)
    return sliding_min(h, min_len - k + 1)


def _stretches(codes: np.ndarray, off: np.ndarray, min_len: int, k: int, bands: tuple[int, int], n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of paragraphs and buckets of the runs of paragraphs with one band, of all bands."""
    ok = window_ok(codes, off, min_len)
    none = np.empty(0, np.int64)
    if not ok.any():
        return none, none, none
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for band in range(bands[0]):
        key = mix64(_min_hash(codes, min_len, k, band * bands[1]).astype(np.uint64) + np.uint64(band << 40))
        for row in range(1, bands[1]):
            key = mix64(key ^ _min_hash(codes, min_len, k, band * bands[1] + row).astype(np.uint64))
        new = ok.copy()
        new[1:] &= ~ok[:-1] | (key[1:] != key[:-1])
        start = np.flatnonzero(new)
        stop = ok.copy()
        stop[:-1] &= ~ok[1:] | new[1:]
        out.append((start, np.flatnonzero(stop) - start + 1, (key[start] % np.uint64(n_buckets)).astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _paragraph_words(codes: np.ndarray, at: np.ndarray, min_len: int) -> list[np.ndarray]:
    """The letters of the paragraphs at `at`, 32 a machine word."""
    out = []
    if min_len >= 32:
        w = kmers(codes, 32)
        out = [w[at + p] for p in range(0, min_len - 31, 32)]
    if min_len % 32:
        out.append(kmers(codes, min_len % 32)[at + min_len - min_len % 32].astype(np.uint64))
    return out


def _settle(words: list[np.ndarray], rec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shared?, hash) of each paragraph, of each distinct one the places of its least and greatest record, and for each
    paragraph the least record that holds it."""
    h = mix64(words[0])
    for w in words[1:]:
        h = mix64(h ^ (w + np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(h)
    hs = h[order]
    new = np.ones(h.size, bool)
    new[1:] = hs[1:] != hs[:-1]
    differ = np.zeros(h.size, bool)
    for w in words:
        ws = w[order]
        differ[1:] |= ws[1:] != ws[:-1]
    if (differ & ~new).any():  # two paragraphs with one hash: order by the letters themselves
        order = np.lexsort(words)
        new = np.zeros(h.size, bool)
        new[0] = True
        for w in words:
            ws = w[order]
            new[1:] |= ws[1:] != ws[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, h.size))
    rs = rec[order]
    low, high = np.minimum.reduceat(rs, start), np.maximum.reduceat(rs, start)
    shared = np.zeros(h.size, bool)
    shared[order] = np.repeat(low != high, size)
    least = np.empty(h.size, np.int64)
    least[order] = np.repeat(low, size)
    pick = np.flatnonzero(rs == np.repeat(low, size))
    run = np.repeat(np.arange(start.size), size)
    first = pick[np.unique(run[pick], return_index=True)[1]]
    pick = np.flatnonzero((rs == np.repeat(high, size)) & np.repeat(low != high, size))
    last = pick[np.unique(run[pick], return_index=True)[1]]
    return shared, h, order[first], order[last], least


def _spans(shared: np.ndarray, rec: np.ndarray, pos: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of shared neighbouring paragraphs -> (record, from, to), 1-based."""
    at = np.flatnonzero(shared)
    if not at.size:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    r, p = rec[at], pos[at]
    new = np.ones(at.size, bool)
    new[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)
    s = np.flatnonzero(new)
    e = np.append(s[1:], at.size) - 1
    return r[s], p[s] + 1, p[e] + min_len


def _count(min_len: int, k: int, bands: tuple[int, int], n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_buckets, np.int64)
        for b in slices(batches, "seq", _BLOCK):
            n += np.bincount(_stretches(*flat_codes(b.column("seq")), min_len, k, bands, n_buckets)[2], minlength=n_buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    return run


def _send(min_len: int, k: int, bands: tuple[int, int], n_buckets: int, full: np.ndarray):
    """Stretches by bucket; what is settled in here (full buckets only) goes out with bucket -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        size = 0

        def put(codes, ids, rec, off, start, n_par, bucket) -> None:
            nonlocal size
            length = n_par + min_len - 1
            for b, (s, ln, r) in by_bucket(bucket, start, length, rec):
                x = [ids[r], s - off[r], ln.astype(np.int32), codes[ranges(s, ln)]]
                held.setdefault(b, []).append(x)
                size += sum(a.nbytes for a in x)

        def flush() -> pa.RecordBatch:
            nonlocal size
            out = [(b, dump(*(np.concatenate([x[i] for x in xs]) for i in range(3)), pack_bits(np.concatenate([x[3] for x in xs])))) for b, xs in held.items()]
            held.clear()
            size = 0
            return rows([b for b, _ in out], [v for _, v in out])

        for b in slices(batches, "seq", _BLOCK):
            codes, off = flat_codes(b.column("seq"))
            ids = b.column("id").to_numpy().astype(np.int64)
            start, n_par, bucket = _stretches(codes, off, min_len, k, bands, n_buckets)
            rec = np.searchsorted(off, start, side="right") - 1
            hot = np.isin(bucket, full)
            if hot.any():
                at = ranges(start[hot], n_par[hot])
                r = np.repeat(rec[hot], n_par[hot])
                shared, h, first, last, least = _settle(_paragraph_words(codes, at, min_len), ids[r])
                i, lo, hi = _spans(shared, r, at - off[r], min_len)
                if i.size:
                    yield rows([-1], [dump(ids[i], lo, hi, *_stars(shared, ids[r], least))])
                pending = ~shared
                pending[first] = pending[last] = True
                go = np.flatnonzero(pending)
                to = n_buckets + (mix64(h[go] + np.uint64(1)) % np.uint64(n_buckets)).astype(np.int64)
                new = np.ones(go.size, bool)  # neighbours for one bucket, as in a run of one letter, are one stretch
                new[1:] = (at[go[1:]] != at[go[:-1]] + 1) | (r[go[1:]] != r[go[:-1]]) | (to[1:] != to[:-1])
                s = np.flatnonzero(new)
                put(codes, ids, r[go[s]], off, at[go[s]], np.diff(np.append(s, go.size)), to[s])
                start, n_par, bucket, rec = start[~hot], n_par[~hot], bucket[~hot], rec[~hot]
            put(codes, ids, rec, off, start, n_par, bucket)
            if size > _HOLD:
                yield flush()
        if held:
            yield flush()

    return run


def _unpack(table: pa.Table, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of a bucket; of each paragraph its place in them, its record and its position there."""
    got = [load(v.as_py(), np.int64, np.int64, np.int32, np.uint8) for v in table.column("blob")]
    ids, first = (np.concatenate([g[i] for g in got]) for i in range(2))
    length = np.concatenate([g[2] for g in got]).astype(np.int64)
    codes = np.concatenate([unpack_bits(g[3], int(g[2].sum())) for g in got])
    n_par = length - min_len + 1
    return codes, ranges(np.cumsum(length) - length, n_par), np.repeat(ids, n_par), ranges(first, n_par)


def _stars(shared: np.ndarray, rec: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = shared & (rec != least)
    if not keep.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.unique(np.stack([rec[keep], least[keep]]), axis=1)
    return a, b


def _verify(min_len: int):
    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() == -1:
            got = [load(v.as_py(), np.int64, np.int64, np.int64, np.int64, np.int64) for v in table.column("blob")]
            rec, lo, hi = (np.concatenate([g[i] for g in got]) for i in range(3))
        else:
            codes, at, rec, pos = _unpack(table, min_len)
            shared = _settle(_paragraph_words(codes, at, min_len), rec)[0]
            rec, lo, hi = _spans(shared, rec, pos, min_len)
        return pa.table({"id": rec, "lo": lo, "hi": hi})

    return run


def _links(min_len: int):
    """Each record of a shared paragraph with the least record that holds it: stars, no pairs."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() == -1:  # settled inside blocks, whose least records go on and meet
            got = [load(v.as_py(), np.int64, np.int64, np.int64, np.int64, np.int64) for v in table.column("blob")]
            a, b = (np.concatenate([g[i] for g in got]) for i in (3, 4))
        else:
            codes, at, rec, _ = _unpack(table, min_len)
            shared, _, _, _, least = _settle(_paragraph_words(codes, at, min_len), rec)
            a, b = _stars(shared, rec, least)
        return pa.table({"a": a, "b": b})

    return run


def _shared_in(recs: DataFrame, min_len: int, k: int, out=None, schema: str = "id bigint, lo bigint, hi bigint") -> DataFrame:
    """(id, lo, hi): shared stretches, they may overlap; or what `out` makes of a bucket."""
    letters = recs.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
    bands = tune_bands(letters, min_len, k)
    n_buckets = int(letters * 2 * bands[0] * bands[1] // ((min_len - k + 2) * _PER_BUCKET)) + 16
    counts = recs.mapInArrow(_count(min_len, k, bands, n_buckets), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    full = np.array([r[0] for r in counts.where(F.col("n") > _FULL).collect()], np.int64)  # at most letters / _FULL rows
    sent = recs.mapInArrow(_send(min_len, k, bands, n_buckets, full), "bucket bigint, blob binary")
    salt = F.when(F.col("bucket") == -1, (F.rand(3) * n_buckets).cast("int")).otherwise(0)
    sent = sent.withColumn("salt", salt).repartition(max(parts(recs.sparkSession), n_buckets // _PER_TASK), "bucket", "salt")
    return sent.groupBy("bucket", "salt").applyInArrow((out or _verify)(min_len), schema)


def records(df: DataFrame, rec_id: str, seq: str, merge_equal: bool) -> DataFrame:
    """(id, seq): upper-cased; equal texts under their least id if merge_equal, else one row an id."""
    x = df.where(F.col(rec_id).isNotNull() & F.col(seq).isNotNull()).select(F.col(rec_id).cast("bigint").alias("id"), F.upper(F.col(seq)).alias("seq"))
    return x.groupBy("seq").agg(F.min("id").alias("id")).select("id", "seq") if merge_equal else x.groupBy("id").agg(F.max("seq").alias("seq"))


def shared_spans(df: DataFrame, rec_id: str, seq: str, min_len: int, merge_equal: bool = False, k: int = 16) -> DataFrame:
    """Maximal runs of positions that lie in a stretch of at least `min_len` letters A, C, G, T standing in another record too.

    Returns rec_id bigint, from_pos, to_pos (1-based, both included). Case is ignored. merge_equal: equal texts are one
    record under their least id. Rows with a null id or text are no records; of repeated ids the greatest text counts.
    Texts shorter than min_len or without such letters have no spans; whole texts of any length are compared. An empty
    table gives no rows; further columns are ignored.
    """
    k = min(k, 16, min_len)
    recs = written(records(df, rec_id, seq, merge_equal), "span-records")
    hits = _shared_in(recs, min_len, k)
    w = Window.partitionBy("id").orderBy("lo", "hi")
    new = F.when(F.col("lo") <= F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, 0).otherwise(1)
    island = hits.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("id", "island").agg(F.min("lo").alias("from_pos"), F.max("hi").alias("to_pos")).select(F.col("id").alias("rec_id"), "from_pos", "to_pos")


def shared_portion(df: DataFrame, rec_id: str, seq: str, min_len: int, merge_equal: bool = False) -> DataFrame:
    """For each record: letters, letters shared with other records (in spans of at least min_len) and their share."""
    spans = shared_spans(df, rec_id, seq, min_len, merge_equal).groupBy("rec_id").agg(F.sum(F.expr("to_pos - from_pos + 1")).alias("n_shared"), F.count(F.lit(1)).alias("n_spans"))
    recs = records(df, rec_id, seq, merge_equal).select(F.col("id").alias("rec_id"), F.length("seq").cast("bigint").alias("n_letters"))
    out = recs.join(spans, "rec_id", "left").fillna(0, ["n_shared", "n_spans"])
    return out.withColumn("share", F.when(F.col("n_letters") > 0, F.col("n_shared") / F.col("n_letters")).otherwise(0.0))


def span_classes(df: DataFrame, rec_id: str, seq: str, min_len: int, merge_equal: bool = False, k: int = 16) -> DataFrame:
    """One row a record that shares a span of at least min_len with another one: rec_id and class_id, the least id of all
    records it is linked to by such spans. Records as in shared_spans."""
    recs = written(records(df, rec_id, seq, merge_equal), "span-records")
    links = _shared_in(recs, min_len, min(k, 16, min_len), _links, "a bigint, b bigint").distinct()
    return components(links).select(F.col("node").alias("rec_id"), F.col("component").alias("class_id"))
