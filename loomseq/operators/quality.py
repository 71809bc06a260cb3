"""Read quality: which reads are valid, and what a set of reads looks like."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import share_of, unknown_bases
from ..functions.flat import flat_bytes
from ..params import DEFAULT, Params


def first_delivery(read_buf: DataFrame, columns: tuple[str, ...] = ("pair_id", "mate", "run_id", "seq", "qual")) -> DataFrame:
    """One row a read: its first delivery with bases (rid and `columns`; only these are read). Null rids are dropped.

    The first arrival of each read is found over two numbers a row; texts are then matched to it by (rid, arrival_no), so
    they are neither sorted nor is a read with very many deliveries one task's work. arrival_no is unique; a null one comes last."""
    no = F.coalesce(F.col("arrival_no"), F.lit((1 << 63) - 1)).alias("_no")
    x = read_buf.where("rid is not null and seq is not null").select("rid", no, *columns)
    first = x.groupBy("rid").agg(F.min("_no").alias("_no"))
    return x.join(first.hint("shuffle_hash"), ["rid", "_no"], "left_semi").select("rid", *columns)


def _quality_ok(p: Params):
    """Arrow function over whole batches: every quality high enough, tail and head good on average. A null passes."""

    @F.arrow_udf("boolean")
    def ok(qual: pa.Array) -> pa.Array:
        raw, off = flat_bytes(qual)
        n = np.diff(off)
        score = raw.astype(np.int64) - 33
        run = np.concatenate([[0], np.cumsum(score)])
        low = np.concatenate([[0], np.cumsum(score < p.single_qual)])
        tail = np.ceil(n * p.tail_share).astype(np.int64)
        cut = off[1:] - tail
        with np.errstate(invalid="ignore"):
            tail_mean = (run[off[1:]] - run[cut]) / tail
            head_mean = (run[cut] - run[off[:-1]]) / (n - tail)
        good = (low[off[1:]] == low[off[:-1]]) & ((tail == 0) | (tail_mean >= p.tail_mean_qual)) & ((n == tail) | (head_mean >= p.head_mean_qual))
        return pa.array(good | qual.is_null().to_numpy(zero_copy_only=False))

    return ok


def valid(seq: Column, qual: Column, p: Params = DEFAULT) -> Column:
    """No unknown base, not mostly A, every quality high enough, tail and head good on average. A null qual passes."""
    bases = (unknown_bases(seq) == 0) & (F.length(seq) > 0) & (share_of(seq, "A") < p.artefact_share_a)
    return F.coalesce(bases, F.lit(False)) & _quality_ok(p)(qual)


def flagged(reads: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Reads keep their ids, so mates stay aligned; invalid ones are only marked."""
    return reads.withColumn("valid", valid(F.col("seq"), F.col("qual"), p))


def valid_reads(reads: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return flagged(reads, p).where("valid").withColumn("seq", F.upper("seq"))


def profile(reads: DataFrame, group: str, order: str, p: Params = DEFAULT, fastq: bool = False) -> DataFrame:
    """Per group: reads, letters, longest, shortest and mean length of its first 10,000 reads (FASTA rounds, FASTQ rounds up)."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    mean = F.avg(F.length("seq"))
    return (
        reads.withColumn("n", n)
        .where(F.col("n") <= p.profile_reads)
        .groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("n_reads"),
            F.sum(F.length("seq")).alias("n_bases"),
            F.max(F.length("seq")).alias("max_len"),
            F.min(F.length("seq")).alias("min_len"),
            (F.ceil(mean) if fastq else F.round(mean)).cast("bigint").alias("mean_len"),
        )
    )


def distinct_seqs(reads: DataFrame) -> DataFrame:
    """Dictionary of distinct sequences: how many reads hold each, and the least rid."""
    return reads.groupBy("seq").agg(F.min("rid").alias("first_rid"), F.count(F.lit(1)).alias("n_reads"))
