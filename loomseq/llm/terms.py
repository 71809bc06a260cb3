"""Frequency of every term: suffix-sorted n-gram counting.

Each record is cut at every token (a letter, a word or a whole key) into a suffix of at most `sigma` tokens. A task sorts the
suffixes of a record, so that it knows of each how many leading tokens it shares with the one before; where it shares n tokens,
its prefixes of more than n tokens are met in this record for the first time. That number stands for the record set: records are
whole within a task, so a suffix is sent on with its occurrences, counted by it, and no record ids are sent. Equal suffixes of
a task are sent once.

Suffixes are routed by their first tokens, so all suffixes with a common prefix of so many tokens meet in one group. There they
are sorted in reverse lexicographic order (every prefix behind what it begins), and one pass counts the prefixes of every
length: a stack holds the open prefixes, a prefix is closed when the next suffix shares fewer tokens, and what it has counted is
passed down. The stack is kept as arrays: at depth n an entry is pushed where fewer than n tokens are shared with the
suffix before. Only prefixes shorter than the route are counted in several groups and added up after that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flat import BAD, flat_codes, kmers, mix64, runs, slices
from ..functions.scratch import parts, written
from .blobs import by_bucket, dump, load

_BLOCK = 3 << 20
_HELD = 1 << 21  # different suffixes a task holds before it sends them
_PER_ROUTE = 1 << 21  # suffixes of a group, about
_SEQ, _KEY, _WORD = 0, 1, 2


class Suffixes:
    """Sorted suffixes of records: tokens (one column a depth, 0 behind the end), length, shared with the one before in its record."""

    def __init__(self, tokens: np.ndarray, length: np.ndarray, shared: np.ndarray, n: np.ndarray) -> None:
        self.tokens, self.length, self.shared, self.n = tokens, length, shared, n

    def merged(self) -> Suffixes:
        """Equal suffixes with equal `shared` once."""
        depth = self.tokens.shape[1]
        if self.tokens.dtype == np.int64:  # packed letters
            key = (self.tokens[:, 0] << 10) | (self.length << 5) | self.shared
            order = np.argsort(key)
            key = key[order]
            start = runs(key)[:-1] if key.size else np.empty(0, np.int64)
            at = order[start]
            return Suffixes(self.tokens[at], self.length[at], self.shared[at], np.add.reduceat(self.n[order], start) if start.size else self.n)
        order = np.lexsort((self.shared, self.length, *(self.tokens[:, d] for d in range(depth - 1, -1, -1))))
        t, ln, sh, n = self.tokens[order], self.length[order], self.shared[order], self.n[order]
        new = np.ones(n.size, bool)
        new[1:] = (t[1:] != t[:-1]).any(axis=1) | (ln[1:] != ln[:-1]) | (sh[1:] != sh[:-1])
        start = np.flatnonzero(new)
        return Suffixes(t[start], ln[start], sh[start], np.add.reduceat(n, start) if start.size else n)

    @staticmethod
    def of(many: list[Suffixes]) -> Suffixes:
        return Suffixes(*(np.concatenate([getattr(s, f) for s in many]) for f in ("tokens", "length", "shared", "n")))


def common(tokens: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Tokens each suffix shares with the one before; 0 for the first."""
    out = np.zeros(length.size, np.int64)
    if length.size > 1:
        same = tokens[1:] == tokens[:-1]
        out[1:] = np.minimum(np.minimum(np.argmin(np.concatenate([same, np.zeros((same.shape[0], 1), bool)], axis=1), axis=1), length[1:]), length[:-1])
    return out


def closed(s: Suffixes, packed: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """One pass of the stack over all suffixes of a route: depth, the suffix that opened each prefix, occurrences, records."""
    depth = s.tokens.shape[1]
    order = (np.lexsort([s.tokens[:, d] for d in range(depth - 1, -1, -1)]) if packed is None else np.argsort((packed << 5) | s.length))[::-1]
    t, ln, sh, n = s.tokens[order], s.length[order], s.shared[order], s.n[order]
    lcp = common(t, ln)
    for d in range(depth, 0, -1):
        at = np.flatnonzero(ln >= d)
        if not at.size:
            continue
        start = np.flatnonzero(lcp[at] < d)  # pushed here, closed before the next push
        yield d, order[at[start]], np.add.reduceat(n[at], start), np.add.reduceat(np.where(sh[at] < d, n[at], 0), start)


def letter_suffixes(codes: np.ndarray, off: np.ndarray, sigma: int) -> Suffixes:
    """Suffixes of texts of A, C, G, T; a suffix is one number here (two bits a letter), so depth is unpacked at the end."""
    n = codes.size
    at = np.arange(n, dtype=np.int64)
    stop = np.where(codes == BAD, at, n)
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    lengths = np.diff(off)
    run = np.minimum(np.minimum(stop, np.repeat(off[1:], lengths)) - at, sigma)
    words = kmers(np.concatenate([codes, np.zeros(sigma - 1, np.uint8)]), sigma).astype(np.int64)
    words &= ~((np.int64(1) << (2 * (sigma - run))) - 1)
    keys = ((np.repeat(np.arange(lengths.size, dtype=np.int64), lengths) << (2 * sigma + 5)) | (words << 5) | run)[run > 0]
    keys.sort()
    word, size = (keys >> 5) & ((1 << (2 * sigma)) - 1), keys & 31
    shared = np.zeros(keys.size, np.int64)
    if keys.size > 1:
        differ = (keys[1:] >> 5) ^ (keys[:-1] >> 5)  # the record in front of the letters
        first = np.frexp(differ.astype(np.float64))[1]  # bits up to the first difference
        shared[1:] = np.minimum(np.minimum(np.clip(sigma - (first + 1) // 2, 0, sigma), size[1:]), size[:-1])
    key = (word << 10) | (size << 5) | shared
    key, count = np.unique(key, return_counts=True)
    return Suffixes((key >> 10)[:, None], (key >> 5) & 31, key & 31, count)


def unpacked(word: np.ndarray, sigma: int) -> np.ndarray:
    """Packed letters -> a column a letter, 1..4, so that 0 is the end."""
    return ((word[:, None] >> (2 * np.arange(sigma - 1, -1, -1))) & 3) + 1


def token_suffixes(tokens: np.ndarray, off: np.ndarray, sigma: int) -> Suffixes:
    """Suffixes of records of 64-bit tokens."""
    n = tokens.size
    lengths = np.diff(off)
    rec = np.repeat(np.arange(lengths.size, dtype=np.int64), lengths)
    size = np.minimum(np.repeat(off[1:], lengths) - np.arange(n), sigma)
    padded = np.concatenate([tokens, np.zeros(sigma, np.uint64)])
    grid = np.stack([np.where(size > d, padded[d : d + n], np.uint64(0)) for d in range(sigma)], axis=1) if n else np.empty((0, sigma), np.uint64)
    order = np.lexsort((size, *(grid[:, d] for d in range(sigma - 1, -1, -1)), rec))
    grid, size, rec = grid[order], size[order], rec[order]
    shared = common(grid, size)
    shared[1:][rec[1:] != rec[:-1]] = 0
    return Suffixes(grid, size, shared, np.ones(n, np.int64)).merged()


def _words(b: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Tokens (64-bit hashes) of texts cut at blanks, offsets, and the different words."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(b, "")))
    off = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    code = flat.indices.to_numpy(zero_copy_only=False)
    names = flat.dictionary
    hashed = np.array([xxhash.xxh64_intdigest(w) | 1 for w in names.to_pylist()], np.uint64)  # never 0; once a different word
    keep = np.array(pc.binary_length(names)) > 0 if len(names) else np.zeros(0, bool)
    tokens = hashed[code] if code.size else np.empty(0, np.uint64)
    good = keep[code] if code.size else np.zeros(0, bool)  # a text of blanks alone gives one empty word
    before = np.concatenate([[0], np.cumsum(good)])
    off = off - off[0]
    return tokens[good], before[off].astype(np.int64), names


def _send(field: int, sigma: int, depth: int, n_routes: int, n_key_routes: int, with_key: bool):
    def route(tokens: np.ndarray) -> np.ndarray:
        """Group of each suffix by its first `depth` tokens."""
        if field == _SEQ:
            return (mix64((tokens[:, 0] >> (2 * (sigma - depth))).astype(np.uint64)) % np.uint64(n_routes)).astype(np.int64)
        h = tokens[:, 0].astype(np.uint64)
        for d in range(1, depth):
            h = mix64(h) ^ tokens[:, d].astype(np.uint64)
        return (mix64(h) % np.uint64(n_routes)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Suffixes] = []
        keys: list[np.ndarray] = []
        names: dict[int, str] = {}
        size = records = n_keys = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size, n_keys
            out: list[tuple[int, int, bytes]] = []
            if held:
                s = Suffixes.of(held).merged()
                for r, (t, ln, sh, n) in by_bucket(route(s.tokens), s.tokens, s.length, s.shared, s.n):
                    text = b""
                    if field == _WORD:
                        own = np.unique(t)
                        text = "\n".join(names[int(x)] for x in own if x).encode()
                    out.append((field, r, dump(t, ln.astype(np.int8), sh.astype(np.int8), n, np.frombuffer(text, np.uint8))))
            if keys:
                k, n = np.unique(np.concatenate(keys), return_counts=True)
                for r, (t, c) in by_bucket((mix64(k.view(np.uint64)) % np.uint64(n_key_routes)).astype(np.int64), k, n):
                    one = np.ones(t.size, np.int8)
                    out.append((_KEY, r, dump(t, one, one - 1, c, np.empty(0, np.uint8))))
            held.clear()
            keys.clear()
            names.clear()
            size = n_keys = 0
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], ["field", "route", "blob"])

        for b in slices(batches, "seq", _BLOCK):
            records += b.num_rows
            if field == _SEQ:
                codes, off = flat_codes(b.column("seq"))
                s = letter_suffixes(codes, off, sigma)
            else:
                tokens, off, words = _words(b.column("seq"))
                names.update((xxhash.xxh64_intdigest(w) | 1, w) for w in words.to_pylist())
                s = token_suffixes(tokens, off, sigma)
            held.append(s)
            size += s.n.size
            if with_key:
                k = b.column("key").drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                keys.append(k)
                n_keys += k.size
            if size > _HELD:
                merged = Suffixes.of(held).merged()
                held[:] = [merged]
                size = merged.n.size
            if size > _HELD or n_keys > _HELD:
                yield from flush()
        if held or keys:
            yield from flush()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([dump(np.array([records]))], pa.binary())], ["field", "route", "blob"])

    return run


def _count(sigma: int):
    """Term counts of a group."""

    def run(table: pa.Table) -> pa.Table:
        field = table.column("field")[0].as_py()
        blobs = [v.as_py() for v in table.column("blob")]
        if field == -1:
            total = int(sum(load(v, np.int64)[0][0] for v in blobs))
            return pa.table({"field": [-1], "n": pa.array([0], pa.int32()), "term": [""], "occ": [total], "recs": [total]})
        kind = np.uint64 if field == _WORD else np.int64
        got = [load(v, kind, np.int8, np.int8, np.int64, np.uint8) for v in blobs]
        depth = sigma if field == _WORD else 1
        s = Suffixes(*(np.concatenate([g[i] for g in got]) for i in range(4)))
        s.tokens, s.length, s.shared = s.tokens.reshape(-1, depth), s.length.astype(np.int64), s.shared.astype(np.int64)
        packed = s.tokens[:, 0]
        if field == _SEQ:
            s.tokens = unpacked(packed, sigma) * (np.arange(sigma) < s.length[:, None])
        name = {xxhash.xxh64_intdigest(w) | 1: w for g in got for w in g[4].tobytes().decode().split("\n")} if field == _WORD else {}
        ids = np.array(sorted(name), np.uint64)
        names = pa.array([name[int(x)] for x in ids], pa.string())
        out: list[list] = [[], [], [], []]
        for d, at, occ, recs in closed(s, packed if field == _SEQ else None):
            if field == _SEQ:
                letters = (np.frombuffer(b"\0ACGT", np.uint8))[s.tokens[at, :d]]
                term = pa.Array.from_buffers(pa.binary(d), at.size, [None, pa.py_buffer(np.ascontiguousarray(letters))]).cast(pa.binary()).cast(pa.string())
            elif field == _KEY:
                term = pa.array(packed[at]).cast(pa.string())
            else:
                term = pc.binary_join_element_wise(*(names.take(pa.array(np.searchsorted(ids, s.tokens[at, i]))) for i in range(d)), " ")
            for o, x in zip(out, (pa.array(np.full(at.size, 0 if field == _KEY else d, np.int32)), term, pa.array(occ), pa.array(recs))):
                o.append(x)
        n, term, occ, recs = (pa.concat_arrays(o) for o in out)
        return pa.table({"field": pa.array(np.full(len(n), field, np.int64)), "n": n, "term": term, "occ": occ, "recs": recs})

    return run


def _counted(recs: DataFrame, rows: int, field: int, sigma: int, with_key: bool) -> DataFrame:
    """(field, n, term, n_occ, n_records) of all terms, and the number of records under field -1."""
    wide = parts(recs.sparkSession)
    depth = min(sigma, 4) if field == _SEQ else min(sigma, 2)
    n_routes = max(wide, min(256 if field == _SEQ else 1 << 20, rows * (8 if field == _SEQ else 32) // _PER_ROUTE + 1))
    n_key_routes = max(wide, rows // _PER_ROUTE + 1)
    sent = recs.mapInArrow(_send(field, sigma, depth, n_routes, n_key_routes, with_key), "field int, route bigint, blob binary")
    sent = sent.repartition(max(wide, (n_routes + n_key_routes) // 4), "field", "route")
    got = written(sent.groupBy("field", "route").applyInArrow(_count(sigma), "field bigint, n int, term string, occ bigint, recs bigint"), "terms")
    short = (F.col("field") == field) & (F.col("n") < depth)  # counted in several groups
    cols = ["field", "n", "term", F.col("occ").alias("n_occ"), F.col("recs").alias("n_records")]
    added = got.where(short | (F.col("field") == -1)).groupBy("field", "n", "term").agg(F.sum("occ").alias("n_occ"), F.sum("recs").alias("n_records"))
    return got.where(~short & (F.col("field") >= 0)).select(*cols).unionByName(added)


def _first(df: DataFrame, rec_id: str, seq: str, key: str | None, order: str | None) -> DataFrame:
    cols = [F.col(seq).alias("seq")] + ([F.col(key).cast("bigint").alias("key")] if key else [])
    at = F.col(order) if order else F.lit(0)
    recs = df.where(F.col(seq).isNotNull()).select(F.col(rec_id).alias("_id"), at.alias("_order"), F.struct(*cols).alias("_row"))
    return recs.groupBy("_id").agg(F.min_by("_row", "_order").alias("_row"), F.first("_row").alias("_any")).select(F.coalesce("_row", "_any").alias("_row")).select("_row.*")


def _result(counts: DataFrame, names: dict[int, str], common_ppm: int, rare_ppm: int, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    total = counts.where("field = -1").agg(F.coalesce(F.sum("n_records"), F.lit(0))).first()[0]
    name = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("field").cast("int")]
    out = counts.where("field >= 0").select(name.alias("field"), "term", "n", "n_occ", "n_records", F.lit(total).cast("bigint").alias("total"))
    return finish(out).withColumn("mark", mark(F.col("n_records"), F.col("total"), common_ppm, rare_ppm))


def term_counts(df: DataFrame, rec_id: str = "rid", seq: str = "seq", key: str | None = "hashcode", order: str = "arrival_no", sigma: int = 8, common_ppm: int = 10_000, rare_ppm: int = 200) -> DataFrame:
    """Occurrences and records of every word of 1..sigma letters of `seq`, and of every value of `key`.

    Returns field (`seq` or `hashcode`: the column's name), term, n (letters of a word, 0 for a key), n_occ, n_records,
    total (all records) and mark: `common` above common_ppm millionths of all records, else `rare` when one record or
    fewer than rare_ppm millionths hold it, else null.

    A record is a distinct `rec_id` with a non-null `seq`; of repeated rows the one of least `order` counts. Null ids are
    one record. Null keys are no term, an empty text is a record without words; letters other than A, C, G, T (any case)
    end a word. An empty table gives no rows. Further columns are ignored. Whole texts are counted, of any length.
    1 <= sigma <= 12.
    """
    if not 1 <= sigma <= 12:
        raise ValueError("sigma must be 1 to 12")
    recs = _first(df, rec_id, seq, key, order)
    return _result(_counted(recs, df.count(), _SEQ, sigma, key is not None), {_SEQ: seq, _KEY: key or "key"}, common_ppm, rare_ppm, lambda x: x)


def word_counts(df: DataFrame, rec_id: str = "doc_id", text: str = "text", order: str | None = None, sigma: int = 3, common_ppm: int = 10_000, rare_ppm: int = 200) -> DataFrame:
    """As term_counts for texts of words: occurrences and records of every phrase of 1..sigma words.

    Words are cut at ASCII blanks and line breaks and kept as they are; a phrase is written with single spaces. Returns term,
    n (words), n_occ, n_records, total and mark. Of repeated ids the text of least `order` counts (any, where the order is
    not given). Null texts are no records; empty ones are records without words. 1 <= sigma <= 8.
    """
    if not 1 <= sigma <= 8:
        raise ValueError("sigma must be 1 to 8")
    recs = _first(df, rec_id, text, None, order)
    return _result(_counted(recs, df.count(), _WORD, sigma, False), {_WORD: text}, common_ppm, rare_ppm, lambda x: x.drop("field"))


def mark(n: Column, total: Column, common_ppm: int, rare_ppm: int) -> Column:
    return F.when(n * 1_000_000 > total * common_ppm, "common").when((n == 1) | (n * 1_000_000 < total * rare_ppm), "rare")
