"""k-mers of reads: sampled positions, counts, postings, seeds, lookups.

k-mers are packed numbers (two bits a base, k <= 31) from the reads to the last step; they are written out as text at the end.
Only words of A, C, G, T are k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import revcomp
from ..functions.flat import flat_codes, kmers, ranges, slices, window_ok
from ..functions.scratch import written
from ..params import DEFAULT, Params

_BLOCK = 1 << 20
_LETTERS = np.frombuffer(b"ACGT", np.uint8)


def sampled_positions(seqlen: np.ndarray, p: Params = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """(read, 1-based start): every second place of a short head and tail block, or of the whole read (and its last place) if they meet."""
    n = seqlen - p.k + 1
    head, tail = -(-seqlen * p.head_sample_pct // 100), -(-seqlen * p.tail_sample_pct // 100)
    step, meet = p.sample_step, head + tail >= n
    n1 = np.where(n < 1, 0, np.where(meet, -(-n // step), -(-head // step)))
    n2 = np.where(n < 1, 0, np.where(meet, (n - 1) % step > 0, -(-tail // step)))
    rec = np.repeat(np.arange(n.size), n1 + n2)
    at = ranges(np.zeros(n.size, np.int64), n1 + n2)
    behind = at >= n1[rec]
    pos = np.where(behind, np.where(meet, n, n - tail + 1)[rec] + (at - n1[rec]) * step, 1 + at * step)
    return rec, pos


def kmer_text(k: int):
    """Packed k-mers as text."""

    @F.arrow_udf("string")
    def text(code: pa.Array) -> pa.Array:
        c = code.to_numpy(zero_copy_only=False).astype(np.int64)
        letters = _LETTERS[(c[:, None] >> (2 * np.arange(k - 1, -1, -1))) & 3]
        return pa.StringArray.from_buffers(c.size, pa.py_buffer(np.arange(0, k * (c.size + 1), k, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(letters)))

    return text


def _sampled(b: pa.RecordBatch, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(read, pos, code, places of the read) of the sampled k-mers of a batch."""
    codes, off = flat_codes(b.column("seq"))
    n = np.diff(off)
    rec, pos = sampled_positions(n, p)
    at = off[rec] + pos - 1
    ok = window_ok(codes, off, p.k)[at] if at.size else np.zeros(0, bool)
    rec, pos, at = rec[ok], pos[ok], at[ok]
    return rec, pos, kmers(codes, p.k)[at].astype(np.int64), n - p.k + 1


def codes_at(reads: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(code, rid, pos, last) at the sampled positions; `last`: the last place of the read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "seq", _BLOCK):
            rec, pos, code, n = _sampled(b, p)
            yield pa.RecordBatch.from_arrays([pa.array(code), b.column("rid").take(pa.array(rec)), pa.array(pos.astype(np.int32)), pa.array(pos == n[rec])], ["code", "rid", "pos", "last"])

    return reads.select(F.col("rid").cast("bigint").alias("rid"), "seq").mapInArrow(run, "code bigint, rid bigint, pos int, last boolean")


def explode_kmers(reads: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(kmer, rid, pos) at the sampled positions, forward strand; reads shorter than k give none."""
    return codes_at(reads, p).select(kmer_text(p.k)(F.col("code")).alias("kmer"), "rid", "pos")


def _per_read(p: Params):
    """Distinct k-mers of each read: code, rid, copies in the read, whether it starts the read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "seq", _BLOCK):
            rec, pos, code, _ = _sampled(b, p)
            order = np.lexsort((pos, code, rec))
            rec, pos, code = rec[order], pos[order], code[order]
            new = np.ones(rec.size, bool)
            new[1:] = (rec[1:] != rec[:-1]) | (code[1:] != code[:-1])
            start = np.flatnonzero(new)
            copies = np.diff(np.append(start, rec.size))
            yield pa.RecordBatch.from_arrays([pa.array(code[start]), b.column("rid").take(pa.array(rec[start])), pa.array(copies.astype(np.int64)), pa.array(pos[start] == 1)], ["code", "rid", "copies", "start"])

    return run


def _codes(reads: DataFrame, p: Params) -> DataFrame:
    x = reads.select(F.col("rid").cast("bigint").alias("rid"), "seq").mapInArrow(_per_read(p), "code bigint, rid bigint, copies bigint, start boolean")
    return x.groupBy("code").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("n_reads"), F.max("copies").alias("most_copies"), F.max("start").alias("at_start"))


def table(reads: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Per k-mer: n postings, n_reads, most copies in one read, whether it starts some read. `reads` has one row a read: repeats
    within a read are counted before the shuffle, so one shuffle with map-side aggregation gives distinct reads too."""
    return _codes(reads, p).select(kmer_text(p.k)(F.col("code")).alias("kmer"), "n", "n_reads", "most_copies", "at_start")


def postings(kmers: DataFrame, most: int | None = None) -> DataFrame:
    """Sorted posting lists. `most` splits a longer list into numbered chunks, so that no list outgrows a row.

    With `most` postings are numbered in two steps, over ranges of reads and within each, so a k-mer of very many reads is spread
    over as many tasks as it has ranges (65,536 reads each)."""
    one = F.array_sort(F.collect_list(F.struct("rid", "pos"))).alias("postings")
    if most is None:
        return kmers.groupBy("kmer").agg(one)
    x = kmers.withColumn("range", F.shiftright("rid", 16))
    per = x.groupBy("kmer", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("kmer").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.row_number().over(Window.partitionBy("kmer", "range").orderBy("rid", "pos")) - 1
    x = x.withColumn("n", n).join(per.select("kmer", "range", before.alias("before")), ["kmer", "range"])
    return x.withColumn("chunk", F.floor((F.col("n") + F.col("before")) / most).cast("int")).groupBy("kmer", "chunk").agg(one)


def seed_bounds(per: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row from a k-mer table: mean occurrence of a k-mer, and the least and greatest multiplicity of a seed."""
    n = p.read_len - p.k + 1
    sampled = -(-p.read_len * p.head_sample_pct // 100) + -(-p.read_len * p.tail_sample_pct // 100)
    mean = F.greatest(F.sum("n") / F.count(F.lit(1)) * n / sampled / 1.6, F.lit(1.0))
    x = per.agg(F.coalesce(mean, F.lit(1.0)).alias("avg_occ"))
    lower = F.greatest(F.least(F.col("avg_occ") * p.lower_factor, F.lit(float(p.lower_max))), F.lit(float(p.lower_min)))
    return x.withColumn("lower", lower).withColumn("upper", F.col("avg_occ") * p.upper_factor)


def seeds(reads: DataFrame, p: Params = DEFAULT, consumed: DataFrame | None = None) -> DataFrame:
    """k-mers fit to start a contig: multiplicity within the bounds and mostly unconsumed, not one letter only, at the start
    of some read, never twice in one read. `consumed` (rid): reads already used; they are taken out before their k-mers are."""
    whole = written(_codes(reads, p), "kmers")  # used twice: for the bounds and for the seeds
    per = whole.withColumnRenamed("n", "arraysize").withColumn("multiplicity", F.col("arraysize"))
    if consumed is not None:
        live = _codes(reads.join(consumed.select("rid").distinct(), "rid", "left_anti"), p).withColumnRenamed("n", "multiplicity")
        per = live.join(whole.select("code", F.col("n").alias("arraysize")), "code")
    per = per.crossJoin(F.broadcast(seed_bounds(whole, p)))  # one row
    one_letter = [sum(base << (2 * i) for i in range(p.k)) for base in range(4)]
    ok = F.col("multiplicity").between(F.col("lower"), F.col("upper")) & (F.col("multiplicity") >= F.col("arraysize") * p.fresh_share)
    return per.where(ok & ~F.col("code").isin(one_letter) & F.col("at_start") & (F.col("most_copies") == 1)).select(kmer_text(p.k)(F.col("code")).alias("kmer"), "multiplicity", "arraysize")


def multi_copy(reads: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """k-mers that stand twice in one read, and the reads: settled within each row, without a shuffle."""
    x = reads.select(F.col("rid").cast("bigint").alias("rid"), "seq").mapInArrow(_per_read(p), "code bigint, rid bigint, copies bigint, start boolean")
    return x.where("copies > 1").select(kmer_text(p.k)(F.col("code")).alias("kmer"), "rid", "copies")


def at_read_end(reads: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Sampled k-mers at the last place of some read."""
    return codes_at(reads, p).where("last").select("code").distinct().select(kmer_text(p.k)(F.col("code")).alias("kmer"))


def strand_lookup(per: DataFrame) -> DataFrame:
    """k-mers of a table whose reverse complement is a k-mer too: both counts."""
    c = per.select("kmer", "n")
    other = c.select(revcomp(F.col("kmer")).alias("kmer"), F.col("n").alias("n_reverse"))
    return c.join(other, "kmer")


def consume(reads: DataFrame, consumed: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Multiplicity after the postings of consumed reads are taken out (the postings themselves are never changed).

    Reads are marked before the explode, so both counts come out of one aggregation."""
    x = reads.select("rid", "seq").join(consumed.select("rid").distinct().withColumn("gone", F.lit(1)), "rid", "left")
    x = x.select(F.when(F.col("gone").isNull(), F.lit(1)).otherwise(0).cast("bigint").alias("rid"), "seq")  # the column carries the mark
    x = codes_at(x, p).groupBy("code").agg(F.count(F.lit(1)).alias("arraysize"), F.sum("rid").alias("multiplicity"))
    return x.select(kmer_text(p.k)(F.col("code")).alias("kmer"), "arraysize", "multiplicity")
