"""Contigs of genomes of any size: unitigs by relational compaction, then votes of reads only where these end.

Every k-mer that enough reads hold is a node, once on each strand. K-mers are counted in bins of their minimisers, to which
reads go as spans of letters. Each k-mer that counts goes to the bins of its first and of its last k - 1 letters; there all
k-mers around such a word meet, and where one comes in and one goes out, the two are linked and written as pieces of
paths. Pieces, an eighth of the k-mers, are ranked by pointer doubling and put together as unitigs. At each end of a unitig
the reads that share a k-mer with its tail extend it by their votes, a small task of its own; an extension that runs into
another unitig, and is run into by that one's, joins the two. No component and no contig is one task's work; a unitig's
text is one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import revcomp
from ..functions.blobs import by_bucket, dump, load, rows
from ..functions.flat import BASE, flat_codes, kmers, mix64, ranges, rc_kmers, runs, slices, sliding_min, window_ok
from ..functions.scratch import forget, parts, written
from ..params import DEFAULT, Params
from .assemble import Assembler
from .chains import list_rank, ranked
from .kmers import kmer_text
from .scaffold import renumber, scaffold_seqs

_BLOCK = 1 << 20
_PIECE = 10_000  # pieces of a unitig that are put together at once
_M = 11  # letters of a minimiser
_BINS = 4096  # bins of minimisers, whatever the input
_HOLD = 1 << 20  # spans or k-mers that are held before they are sent
_CHUNK = 4 << 20  # bytes of whole bins that are counted at once; of k-mers four times as many are linked at once


def _turned(code: np.ndarray, k: int) -> np.ndarray:
    """Reverse complements of packed k-mers, by swaps of letters, pairs of letters and bytes."""
    x = ~code.astype(np.uint64)
    for step, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        x = ((x >> np.uint64(step)) & np.uint64(mask)) | ((x & np.uint64(mask)) << np.uint64(step))
    return (x.byteswap() >> np.uint64(64 - 2 * k)).astype(code.dtype)


def _rank_of(words: np.ndarray, m: int) -> np.ndarray:
    """A random rank of packed m-mers, the same on both strands; the least in a window is its minimiser."""
    return (mix64(np.minimum(words, _turned(words, m)).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def _bin(least: np.ndarray) -> np.ndarray:
    return (mix64(least.astype(np.uint64)) & np.uint64(_BINS - 1)).astype(np.int64)


def _cut(codes: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Runs of k-mers with one minimiser: start, number of k-mers, their letters packed in two words, bin of the minimiser."""
    m, most = min(_M, k - 2), 65 - k
    ok = window_ok(codes, off, k)
    if not ok.any():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    least = sliding_min(_rank_of(kmers(codes, m).astype(np.uint64), m), k - m + 1)
    new = np.append(True, (least[1:] != least[:-1]) | ~ok[:-1])
    edge = np.append(np.flatnonzero(new | ~ok), ok.size)
    at, n = edge[:-1][ok[edge[:-1]]], np.diff(edge)[ok[edge[:-1]]]
    cuts = -(-n // most)
    skip = ranges(np.zeros(at.size, np.int64), cuts) * most
    at, n = np.repeat(at, cuts) + skip, np.minimum(np.repeat(n, cuts) - skip, most)
    w = kmers(np.concatenate([codes, np.zeros(64, np.uint8)]), 32)
    letters = n + k - 1
    w0, w1 = w[at], w[at + 32]
    w0 &= ~np.uint64(0) << (2 * np.maximum(32 - letters, 0)).astype(np.uint64)
    w1 = np.where(letters > 32, w1 & (~np.uint64(0) << (2 * np.minimum(64 - letters, 31)).astype(np.uint64)), np.uint64(0))
    return at, n, w0, w1, _bin(least[at])


def _letters(k: int, n: np.ndarray, w0: np.ndarray, w1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans that hold letters, one span after another, and where each begins."""
    n_bytes = (n + k + 2) // 4
    return np.stack([w0, w1], axis=1).astype(">u8").view(np.uint8)[np.arange(16) < n_bytes[:, None]], np.append(0, np.cumsum(n_bytes))


def _canonical(k: int, n: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Canonical k-mers of spans of n k-mers each, in their order."""
    wide = np.zeros((n.size, 16), np.uint8)
    wide[np.arange(16) < ((n + k + 2) // 4)[:, None]] = letters
    w = wide.view(">u8").astype(np.uint64)
    end = (ranges(np.zeros(n.size, np.int64), n) + k).astype(np.uint64)  # letters up to the end of each k-mer
    w0, w1, two, half = np.repeat(w[:, 0], n), np.repeat(w[:, 1], n), np.uint64(2), np.uint64(32)
    code = np.where(end <= half, w0 >> (two * (half - np.minimum(end, half))), (w0 << np.minimum(two * (np.maximum(end, half) - half), np.uint64(63))) | (w1 >> (two * np.minimum(half + half - end, np.uint64(31))))) & np.uint64((1 << 2 * k) - 1)
    return np.minimum(code, _turned(code, k))


def _spans(k: int):
    """Runs of k-mers with one minimiser, as packed letters, to its bin; equal ones of a block are sent once with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in slices(batches, "seq", _BLOCK):
            _, n, w0, w1, to = _cut(*flat_codes(b.column("seq")), k)
            held.append((w0, w1, n, to))
            size += n.size
            if size > _HOLD:
                yield _packed(k, held)
                held, size = [], 0
        if size:
            yield _packed(k, held)

    return run


def _packed(k: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    w0, w1, n, to = (np.concatenate([h[i] for h in held]) for i in range(4))
    key = (to.astype(np.uint64) << np.uint64(52)) | (mix64(w0 ^ mix64(w1 + n.astype(np.uint64))) >> np.uint64(12))
    order = np.argsort(key)
    key, w0, w1, n, to = (x[order] for x in (key, w0, w1, n, to))
    same = np.append(False, (key[1:] == key[:-1]) & (w0[1:] == w0[:-1]) & (w1[1:] == w1[:-1]) & (n[1:] == n[:-1]))
    first = np.flatnonzero(~same)
    times = np.diff(np.append(first, n.size)).astype(np.int32)
    w0, w1, n, to = (x[first] for x in (w0, w1, n, to))
    flat, end = _letters(k, n, w0, w1)
    cut, n, none = runs(to), n.astype(np.uint8), np.empty(0, np.int32)
    return rows(to[cut[:-1]].tolist(), [dump(n[lo:hi], times[lo:hi] if times[lo:hi].max() > 1 else none, flat[end[lo] : end[hi]]) for lo, hi in zip(cut[:-1], cut[1:])])


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[bytes]]:
    """Values of rows sorted by bin, some whole bins at once."""
    held: list[bytes] = []
    size, last = 0, None
    for b in batches:
        for bucket, v in zip(b.column("bucket").to_pylist(), b.column("blob")):
            if size > most and bucket != last:
                yield held
                held, size = [], 0
            held.append(v.as_py())
            size, last = size + len(held[-1]), bucket
    if held:
        yield held


def _by_bin(sent: DataFrame) -> DataFrame:
    return sent.repartition(parts(sent.sparkSession), "bucket").sortWithinPartitions("bucket")


def _counted(k: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values in _chunks(batches, _CHUNK):
            got = [load(v, np.uint8, np.int32, np.uint8) for v in values]
            n = np.concatenate([g[0] for g in got]).astype(np.int64)
            times = np.concatenate([g[1] if g[1].size else np.ones(g[0].size, np.int32) for g in got])
            code, weight = _canonical(k, n, np.concatenate([g[2] for g in got])), np.repeat(times, n)
            if (weight == 1).all():
                code.sort()
                edge = runs(code)
                n = np.diff(edge)
            else:
                order = np.argsort(code)
                code = code[order]
                edge = runs(code)
                n = np.add.reduceat(weight[order].astype(np.int64), edge[:-1])
            keep = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(code[edge[:-1][keep]].astype(np.int64)), pa.array(n[keep])], ["code", "n"])

    return run


def counts(reads: DataFrame, p: Params = DEFAULT, least: int = 1) -> DataFrame:
    """(code, n): canonical k-mers that stand `least` times or more in the reads, and how often.

    Neighbouring k-mers mostly have one minimiser, so they are sent together as a span of letters, some ten bytes for eight k-mers."""
    sent = reads.select("seq").mapInArrow(_spans(p.k), "bucket bigint, blob binary")
    return _by_bin(sent).mapInArrow(_counted(p.k, least), "code bigint, n bigint")


def _to_words(k: int):
    """K-mers to the bins of their first and last k - 1 letters; flag 1: the first word is settled there, 2: the last."""
    m = min(_M, k - 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in batches:
            code, n = (b.column(c).to_numpy().astype(np.int64) for c in ("code", "n"))
            rank_at = [_rank_of((code >> (2 * (k - m - j))) & ((1 << 2 * m) - 1), m) for j in range(k - m + 1)]
            inner = np.minimum.reduce(rank_at[1:-1])
            left, right = _bin(np.minimum(rank_at[0], inner)), _bin(np.minimum(rank_at[-1], inner))
            two = left != right
            held += [(left, code, n, np.where(two, 1, 3).astype(np.uint8)), (right[two], code[two], n[two], np.full(int(two.sum()), 2, np.uint8))]
            size += code.size
            if size > _HOLD:
                yield _sent(held)
                held, size = [], 0
        if size:
            yield _sent(held)

    return run


def _sent(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    out = list(by_bucket(*(np.concatenate([h[i] for h in held]) for i in range(4))))
    return rows([to for to, _ in out], [dump(*x) for _, x in out])


def _pieces(k: int):
    """Unbranched paths as far as one task's words go, on both strands; a k-mer whose two words are settled in two tasks ends a
    piece of the one and begins a piece of the other, so (first, last) of an open piece links it to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values in _chunks(batches, 4 * _CHUNK):
            got = [load(v, np.int64, np.int64, np.uint8) for v in values]
            code, n, flag = (np.concatenate([g[i] for g in got]) for i in range(3))
            order = np.argsort(code)
            start = runs(code[order])[:-1]
            code, n, flag = code[order[start]], n[order[start]], np.bitwise_or.reduceat(flag[order], start)
            both = np.concatenate([code, _turned(code, k)])
            order = np.argsort(both)
            node, n = both[order], np.tile(n, 2)[order]
            place = np.empty_like(order)
            place[order] = np.arange(order.size)
            mate = place[(order + code.size) % order.size]
            has_in = np.concatenate([(flag & 1) > 0, (flag & 2) > 0])[order]
            has_out = has_in[mate]
            outs, ins = np.flatnonzero(has_out), np.flatnonzero(has_in)
            w_out, o_at, o_n = np.unique(node[outs] & ((1 << (2 * k - 2)) - 1), return_index=True, return_counts=True)
            w_in, i_at, i_n = np.unique(node[ins] >> 2, return_index=True, return_counts=True)
            _, x, y = np.intersect1d(w_out[o_n == 1], w_in[i_n == 1], assume_unique=True, return_indices=True)
            src, dst = outs[o_at[o_n == 1][x]], ins[i_at[i_n == 1][y]]
            good = (src != dst) & (mate[src] != dst)
            before = np.arange(node.size)
            before[dst[good]] = src[good]
            head, far = ranked(before)
            order = np.lexsort((far, head))
            edge = runs(head[order])
            first, last, size = order[edge[:-1]], order[edge[1:] - 1], np.diff(edge)
            open_ = ~has_out[last]
            ring = before[first] != first
            twin = np.where(ring, node[np.minimum.reduceat(mate[order], edge[:-1])], node[mate[last]])
            keep = np.where(open_, size > 1, ~has_in[first] | (node[first] <= twin))
            letter = np.frombuffer(b"ACGT", np.uint8)[node[order] & 3]
            rest = np.repeat(keep, size)
            rest[edge[:-1]] = False
            total = np.add.reduceat(n[order], edge[:-1]) - np.where(open_, n[last], 0)
            ends = np.concatenate([[0], np.cumsum(size[keep] - 1)]).astype(np.int32)
            text = pa.Array.from_buffers(pa.string(), ends.size - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(letter[rest].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(node[first[keep]]), pa.array(node[last[keep]]), pa.array(open_[keep]), pa.array(twin[keep]), text, pa.array((size - open_)[keep]), pa.array(total[keep])], ["node", "last", "open", "twin", "rest", "n_kmers", "n"])

    return run


def _rings(k: int):
    """Circles over several pieces, opened before the least k-mer; of the two strands the one whose least is less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, n, mean in zip(*(b.column(c).to_pylist() for c in ("seq", "n_kmers", "mean_n"))):
                codes = BASE[np.frombuffer(text.encode(), np.uint8)][: n + k - 1]
                w = kmers(codes, k).astype(np.int64)
                at = int(np.argmin(w))
                if w[at] <= _turned(w, k).min():
                    out.append((int(w[at]), "".join(np.array(list("ACGT"))[codes[:n]][(at + np.arange(n + k - 1)) % n]), n, mean))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.float64()))], ["unitig_id", "seq", "n_kmers", "mean_n"])

    return run


def unitigs(reads: DataFrame, p: Params = DEFAULT, least: int | None = None) -> DataFrame:
    """(unitig_id, seq, n_kmers, mean_n): maximal unbranched paths of k-mers that stand `least` times or more in the reads, each on one strand.

    least: by default 3 where k-mers that stand twice or more stand more than 8 times on average, else 2. The id is the packed first
    k-mer. A circle opens before its least k-mer. k must be odd and at most 31. Reads shorter than k give nothing; an empty
    table gives no rows."""
    k = p.k
    if k % 2 == 0 or not 3 <= k <= 31:
        raise ValueError("k must be odd and at most 31")
    c = written(counts(reads, p, 2), "kmer-counts")
    if least is None:
        least = 3 if (c.agg(F.avg("n")).first()[0] or 0) > 8 else 2
    kinds = "node bigint, last bigint, open boolean, twin bigint, rest string, n_kmers bigint, n bigint"
    sent = c.where(F.col("n") >= least).mapInArrow(_to_words(k), "bucket bigint, blob binary")
    x = written(_by_bin(sent).mapInArrow(_pieces(k), kinds), "unitig-pieces")
    forget(c)
    place = list_rank(x.where("open").select(F.col("node").alias("src"), F.col("last").alias("dst")))
    x = x.join(place, "node", "left").withColumn("head", F.coalesce("head", "node")).withColumn("rank", F.coalesce("rank", F.lit(0)))
    end = F.max(F.struct("rank", "open", "twin", "last")).alias("end")
    sums = [F.sum("n_kmers").alias("n_kmers"), F.sum("n").alias("n"), F.max("end").alias("end")]
    text = lambda key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "rest"))), lambda s: s["rest"]), "").alias("rest")
    x = x.select("head", F.floor(F.col("rank") / _PIECE).alias("piece"), "rank", "rest", "n_kmers", "n", "open", "twin", "last").repartition("head")
    x = x.groupBy("head", "piece").agg(text("rank"), F.sum("n_kmers").alias("n_kmers"), F.sum("n").alias("n"), end)
    x = x.groupBy("head").agg(text("piece"), *sums).where("end.open or head <= end.twin")  # a path and its mirror share their k-mers
    out = x.select(F.col("head").alias("unitig_id"), F.concat(kmer_text(k)(F.col("head")), "rest").alias("seq"), "n_kmers", (F.col("n") / F.col("n_kmers")).alias("mean_n"), F.col("end.open").alias("ring"))
    out = written(out, "unitigs-glued")
    rings = out.where("ring").drop("ring").mapInArrow(_rings(k), "unitig_id bigint, seq string, n_kmers bigint, mean_n double")
    return out.where("not ring").drop("ring").unionByName(rings)


def _tails(u: DataFrame, p: Params) -> DataFrame:
    """(end_id, tail): the last two read lengths of each unitig on either strand; end_id = 2 x unitig number + strand."""
    reach = 2 * p.read_len
    sides = F.array(F.struct(F.lit(0).alias("s"), F.expr(f"right(seq, {reach})").alias("tail")), F.struct(F.lit(1).alias("s"), revcomp(F.expr(f"left(seq, {reach})")).alias("tail")))
    return u.select("contig_id", F.explode(sides).alias("e")).select((2 * F.col("contig_id") + F.col("e.s")).cast("bigint").alias("end_id"), "e.tail")


def _codes(df: DataFrame, key: str, text: str, p: Params, both: bool) -> DataFrame:
    """(key, code, pos) of every k-mer of a text; canonical or, with `both` false, as it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", _BLOCK):
            codes, off = flat_codes(b.column("t"))
            at = np.flatnonzero(window_ok(codes, off, p.k))
            w = kmers(codes, p.k)
            w = (np.minimum(w, rc_kmers(codes, p.k)) if both else w)[at].astype(np.int64)
            rec = np.searchsorted(off, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(rec)), pa.array(w), pa.array(at - off[rec])], ["key", "code", "pos"])

    return df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("t")).mapInArrow(run, "key bigint, code bigint, pos bigint")


def _owned(k: int):
    """As _spans, each with the id of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in slices(batches, "seq", _BLOCK):
            codes, off = flat_codes(b.column("seq"))
            at, n, w0, w1, to = _cut(codes, off, k)
            held.append((w0, w1, n, to, b.column("id").to_numpy()[np.searchsorted(off, at, side="right") - 1]))
            size += n.size
            if size > _HOLD:
                yield _with_ids(k, held)
                held, size = [], 0
        if size:
            yield _with_ids(k, held)

    return run


def _with_ids(k: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    w0, w1, n, to, ids = (np.concatenate([h[i] for h in held]) for i in range(5))
    order = np.argsort(to, kind="stable")
    w0, w1, n, to, ids = (x[order] for x in (w0, w1, n, to, ids))
    flat, end = _letters(k, n, w0, w1)
    cut, n, least = runs(to), n.astype(np.uint8), int(ids.min())
    far = ids - least
    far = far.astype(np.uint32) if far.max() < 1 << 32 else far
    return rows(to[cut[:-1]].tolist(), [dump(n[lo:hi], np.array([least]), far[lo:hi], flat[end[lo] : end[hi]]) for lo, hi in zip(cut[:-1], cut[1:])])


def _portions(values: Iterator[bytes], most: int) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for v in values:
        held.append(v)
        size += len(v)
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _shared(k: int, most_n: float):
    """(end_id, rid) of tails and reads with a common k-mer, from bins in which the tails (kind 0) come before the reads (kind 1).

    A bin's reads pass by in portions; of their k-mers only those of its tails are kept, and none that was met more than most_n times."""

    def unpacked(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n, least, far, letters = zip(*(load(v, np.uint8, np.int64, np.uint8, np.uint8) for v in values))
        ids = np.concatenate([f.view(np.uint32 if f.size == 4 * x.size else np.int64).astype(np.int64) + low[0] for x, low, f in zip(n, least, far)])
        n = np.concatenate(n).astype(np.int64)
        return _canonical(k, n, np.concatenate(letters)), np.repeat(ids, n)

    def of_bin(tails: list[bytes], reads: Iterator[list[bytes]]) -> pa.RecordBatch:
        code, ends = unpacked(tails)
        order = np.argsort(code)
        ends, edge = ends[order], runs(code[order])
        code, n_ends = code[order[edge[:-1]]], np.diff(edge)
        met = np.zeros(code.size, np.int64)
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for values in reads:
            c, rid = unpacked(values)
            at = np.minimum(np.searchsorted(code, c), code.size - 1)
            ok = code[at] == c
            at, rid = at[ok], rid[ok]
            met += np.bincount(at, minlength=code.size)
            few = met[at] <= most_n
            kept.append((at[few], rid[few]))
        at, rid = (np.concatenate([x[i] for x in kept]) for i in range(2))
        few = met[at] <= most_n
        at, rid = at[few], rid[few]
        end, rid = ends[ranges(edge[at], n_ends[at])], np.repeat(rid, n_ends[at])
        order = np.lexsort((rid, end))
        end, rid = end[order], rid[order]
        new = np.append(True, (end[1:] != end[:-1]) | (rid[1:] != rid[:-1]))[: end.size]
        return pa.RecordBatch.from_arrays([pa.array(end[new]), pa.array(rid[new])], ["end_id", "rid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = ((bucket, kind, v) for b in batches for bucket, kind, v in zip(b.column("bucket").to_pylist(), b.column("kind").to_pylist(), b.column("blob")))
        for _, all_kinds in groupby(sent, itemgetter(0)):
            tails: list[bytes] = []
            for kind, one_kind in groupby(all_kinds, itemgetter(1)):
                values = (v.as_py() for _, _, v in one_kind)
                if kind == 0:
                    tails = list(values)
                elif tails:
                    yield of_bin(tails, _portions(values, _CHUNK))

    return run


def _hits(tails: DataFrame, reads: DataFrame, p: Params, most_n: float) -> DataFrame:
    """Distinct (end_id, rid) of tails and reads that share a k-mer of the tail's last read length which stands in most_n places at most."""
    near = tails.select(F.col("end_id").cast("bigint").alias("id"), F.expr(f"right(tail, {p.read_len})").alias("seq"))
    mine = reads.select(F.col("rid").cast("bigint").alias("id"), "seq")
    sent = [x.mapInArrow(_owned(p.k), "bucket bigint, blob binary").withColumn("kind", F.lit(kind)) for kind, x in enumerate((near, mine))]
    sent = sent[0].unionByName(sent[1]).repartition(parts(tails.sparkSession), "bucket").sortWithinPartitions("bucket", "kind")
    return sent.mapInArrow(_shared(p.k, most_n), "end_id bigint, rid bigint").distinct()


def _extended(tails: DataFrame, reads: DataFrame, p: Params, most_n: float) -> DataFrame:
    """(end_id, n_tail, made): tails with what the votes of their reads put behind them.

    The reads of a tail share one of the k-mers of its last read length; k-mers of more than most_n places (a repeat) bring none, so a
    tail has at most read_len x most_n reads. Reads meet tails in the bins of minimisers, and are sent to each once. How many rows a
    step in NumPy returns Spark can't tell, so no join here is left to its estimates: none is broadcast."""
    hits = written(_hits(tails, reads, p, most_n), "tail-reads")
    per = hits.join(reads.select("rid", "seq").hint("merge"), "rid").groupBy("end_id").agg(F.array_sort(F.collect_list(F.struct("rid", "seq"))).alias("reads"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g in pdf.itertuples(index=False):
                a = Assembler([r["rid"] for r in g.reads], [r["seq"] for r in g.reads], p)
                out.append((g.end_id, len(g.tail), a.extend(g.tail, {}, len(g.tail) + 2 * p.read_len)))
            yield pd.DataFrame(out, columns=["end_id", "n_tail", "made"])

    return tails.join(per.hint("merge"), "end_id").select("end_id", "tail", "reads").mapInPandas(run, "end_id bigint, n_tail int, made string")


def _joined(u: DataFrame, made: DataFrame, p: Params) -> DataFrame:
    """(src, dst, fill, overlap): ends whose extension is the first to meet another unitig's first k-mer, and the other way round."""
    first = F.array(F.struct((2 * F.col("contig_id")).alias("node"), F.expr(f"left(seq, {p.k})").alias("t")), F.struct((2 * F.col("contig_id") + 1).alias("node"), revcomp(F.expr(f"right(seq, {p.k})")).alias("t")))
    starts = _codes(u.select(F.explode(first).alias("f")).select("f.node", "f.t"), "node", "t", p, False).select(F.col("key").alias("dst"), "code")
    skip = F.greatest(F.col("n_tail") - p.k + 1, F.lit(0))  # k-mers that begin before lie within the tail
    new = made.select("end_id", F.expr(f"substring(made, greatest(n_tail - {p.k} + 1, 0) + 1)").alias("new"))
    met = _codes(new, "end_id", "new", p, False).withColumnRenamed("key", "src").join(starts.hint("merge"), "code").where("src <> dst and floor(src / 2) <> floor(dst / 2)")
    x = met.groupBy("src").agg(F.min(F.struct("pos", "dst")).alias("at")).select("src", "at.*")
    x = x.join(made.select(F.col("end_id").alias("src"), "n_tail", "made").hint("merge"), "src").withColumn("pos", F.col("pos") + skip)
    over = F.greatest(F.col("n_tail") - F.col("pos"), F.lit(0)).cast("int")
    fill = F.expr("substring(made, n_tail + 1, greatest(cast(pos as int) - n_tail, 0))")
    x = written(x.select("src", "dst", fill.alias("fill"), over.alias("overlap")), "unitig-joins")
    back = x.select(F.col("dst").bitwiseXOR(F.lit(1)).alias("src"), F.col("src").bitwiseXOR(F.lit(1)).alias("dst"))
    return x.join(back, ["src", "dst"])


def assemble(reads: DataFrame, p: Params = DEFAULT, least_len: int | None = None, least: int | None = None) -> DataFrame:
    """(contig_id, seq, n_unitigs) from valid reads (rid, seq of A, C, G, T): unitigs, joined across their ends.

    Unitigs shorter than 2 k (tips and the arms of small bubbles) are no ends to start from or to meet; reads vote across them.
    Contigs of at least least_len bases (default: one base more than a read), numbered from 1 in order of their first unitig."""
    shortest = p.read_len + 1 if least_len is None else least_len
    reads = written(reads.select("rid", "seq"), "assembled-reads")  # they are read three times
    u = written(unitigs(reads, p, least).where(F.length("seq") >= 2 * p.k), "unitigs")
    u = written(renumber(u, "unitig_id", "contig_id").select("contig_id", "seq", "mean_n"), "unitigs-numbered")
    most = p.upper_factor * (u.agg(F.avg("mean_n")).first()[0] or 1.0)
    made = written(_extended(written(_tails(u, p), "tails"), reads, p, most), "extended")
    links = written(_joined(u, made, p), "unitig-chain")
    place = list_rank(links).join(links.select(F.col("dst").alias("node"), "fill", "overlap"), "node", "left")
    x = place.withColumn("contig_id", F.floor(F.col("node") / 2).cast("bigint")).withColumn("orient", (F.col("node") % 2).cast("int"))
    x = written(x, "unitig-places")
    per = x.groupBy("head").agg(F.min("contig_id").alias("scaffold_id"), F.min_by("orient", "contig_id").alias("turn"), F.count(F.lit(1)).alias("n"), F.count_distinct("contig_id").alias("m"))
    per = per.where("turn = 0 and n = m").groupBy("scaffold_id").agg(F.min("head").alias("head"))
    first = F.col("rank") == 0
    rows = x.join(per, "head").select("scaffold_id", (F.col("rank") + 1).cast("int").alias("ord"), "contig_id", "orient", F.lit(None).cast("double").alias("gap"), F.lit(0).alias("n_pairs"), F.when(~first, F.col("fill")).alias("fill"), F.when(~first, F.col("overlap")).otherwise(0).alias("fill_overlap"), F.when(first, "start").otherwise("filled").alias("decision"))
    rows = written(rows, "unitig-rows")
    joined = scaffold_seqs(rows, u, p).select("scaffold_id", "seq", F.col("n_contigs").alias("n_unitigs"))
    alone = u.join(rows.select("contig_id"), "contig_id", "left_anti").select(F.col("contig_id").alias("scaffold_id"), "seq", F.lit(1).cast("bigint").alias("n_unitigs"))
    out = written(joined.unionByName(alone).where(F.length("seq") >= shortest), "contigs-joined")
    return renumber(out, "scaffold_id", "contig_id").select("contig_id", "seq", "n_unitigs")
