"""Unique placement of reads on contigs by relational division, contig ends, coverage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.flat import flat_codes, kmers, ranges, rc_kmers, slices, window_ok
from ..params import DEFAULT, Params

_BLOCK = 1 << 20


def end_regions(contigs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(contig_id, end, first, last, seq): 5' and 3' regions of the region size, halves of a shorter contig, or the whole (end 2)."""
    s, n = F.lit(p.align_region), F.length("seq")
    half = F.floor(n / 2).cast("int")
    size = F.when(n > 2 * s, s).when(n > s, half).otherwise(n)
    five = F.struct(F.when(n > s, 0).otherwise(2).alias("end"), F.lit(1).alias("first"), size.alias("last"))
    three = F.struct(F.lit(1).alias("end"), (n - size + 1).alias("first"), n.alias("last"))
    x = contigs.where("contig_id is not null and seq is not null")
    return x.select("contig_id", "seq", F.explode(F.when(n > s, F.array(five, three)).otherwise(F.array(five))).alias("r")).select("contig_id", "r.*", "seq")


def end_kmers(contigs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Every k-mer of A, C, G, T in the end regions: (code, contig_id, pos, end); code has two bits a base (k <= 31).

    Regions go through NumPy as flat arrays, so a region is never copied once a k-mer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "piece", _BLOCK):
            codes, off = flat_codes(b.column("piece"))
            at = np.flatnonzero(window_ok(codes, off, p.k))
            rec = np.searchsorted(off, at, side="right") - 1
            take = pa.array(rec)
            pos = b.column("first").to_numpy()[rec] + (at - off[rec])
            yield pa.RecordBatch.from_arrays([pa.array(kmers(codes, p.k)[at].astype(np.int64)), b.column("contig_id").take(take), pa.array(pos.astype(np.int32)), b.column("end").take(take)], ["code", "contig_id", "pos", "end"])

    r = end_regions(contigs, p).select(F.col("contig_id").cast("bigint").alias("contig_id"), F.col("end").cast("int").alias("end"), F.col("first").cast("int").alias("first"), F.expr("substring(seq, first, last - first + 1)").alias("piece"))
    return r.mapInArrow(run, "code bigint, contig_id bigint, pos int, end int")


def tiles(reads: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Tiles of both strands at 0, k, 2k, .. and length - k: (code, rid, seqlen, n_tiles, orient, off). Tiles with other letters are missing."""
    k = p.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "seq", _BLOCK):
            codes, start = flat_codes(b.column("seq"))
            n = np.diff(start)
            use = np.flatnonzero(n >= k)
            if not use.size:
                continue
            rest = n[use] - k
            n_tiles = rest // k + 1 + (rest % k > 0)
            rec = np.repeat(use, n_tiles)
            off = np.minimum(ranges(np.zeros(use.size, np.int64), n_tiles) * k, np.repeat(rest, n_tiles))
            ok, plus, minus = window_ok(codes, start, k), kmers(codes, k), rc_kmers(codes, k)
            for orient, code, at in ((0, plus, start[rec] + off), (1, minus, start[rec] + np.repeat(rest, n_tiles) - off)):
                good = ok[at]
                r = rec[good]
                yield pa.RecordBatch.from_arrays([pa.array(code[at][good].astype(np.int64)), b.column("rid").take(pa.array(r)), pa.array(n[r].astype(np.int32)), pa.array(np.repeat(n_tiles, n_tiles)[good].astype(np.int32)), pa.array(np.full(r.size, orient, np.int32)), pa.array(off[good].astype(np.int32))], ["code", "rid", "seqlen", "n_tiles", "orient", "off"])

    return reads.select(F.col("rid").cast("bigint").alias("rid"), "seq").mapInArrow(run, "code bigint, rid bigint, seqlen int, n_tiles int, orient int, off int")


def map_unique(reads: DataFrame, contigs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(rid, contig_id, pos, orient, end, seqlen): reads with exactly one place where all their tiles match.

    Tiles of both strands are joined to the k-mers of contig ends; a place counts when every tile hits the same contig at
    its offset (relational division by counting: a tile meets a place once)."""
    ends = end_kmers(contigs, p)
    hits = tiles(reads, p).join(ends, "code").groupBy("rid", "orient", "contig_id", (F.col("pos") - F.col("off")).alias("pos"))
    hits = hits.agg(F.count(F.lit(1)).alias("n"), F.max("n_tiles").alias("n_tiles"), F.max("seqlen").alias("seqlen"), F.max(F.when(F.col("off") == 0, F.col("end"))).alias("end")).where("n = n_tiles")
    one = hits.groupBy("rid").agg(F.count(F.lit(1)).alias("total"), F.min(F.struct("contig_id", "pos", "orient", "end", "seqlen")).alias("p"))
    return one.where("total = 1").select("rid", "p.*")


def classify_end(placements: DataFrame, contigs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """End of the contig each placement belongs to: 0, 1, 2 (short contig) or -1 (inside)."""
    size = contigs.select("contig_id", F.length("seq").alias("clen"))
    n, pos, stop = F.col("clen"), F.col("contig_pos"), F.col("contig_pos") + F.col("seqlen") - 1
    s = F.lit(p.align_region)
    half = F.floor(n / 2)
    end = F.when(n <= s, 2).when(n <= 2 * s, F.when(stop <= half, 0).when(pos > n - half, 1).otherwise(-1)).when(stop <= s, 0).when(pos > n - s, 1).otherwise(-1)
    return placements.join(size, "contig_id").withColumn("end_class", end).drop("clen")


def end_reads(placements: DataFrame) -> DataFrame:
    """Reads of contig ends in order of position: rank within (contig, end)."""
    w = Window.partitionBy("contig_id", "contig_end").orderBy("contig_pos", "rid")
    return placements.where("contig_end >= 0").withColumn("ord", F.row_number().over(w)).select("contig_id", "contig_end", "ord", "contig_pos", "rid")


def end_coverage(placements: DataFrame, contigs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Reads per base of each contig end against the mean over all ends of contigs that have both."""
    r = end_regions(contigs, p).select("contig_id", "end", F.expr("last - first + 1").alias("region"))
    reads = placements.where("contig_end >= 0").groupBy("contig_id", F.col("contig_end").alias("end")).agg(F.count(F.lit(1)).alias("n_reads"))
    x = r.join(reads, ["contig_id", "end"], "left").fillna(0, ["n_reads"])
    mean = x.where("end < 2").agg((F.sum("n_reads") / F.sum("region")).alias("mean_cov"))
    return x.crossJoin(F.broadcast(mean)).withColumn("ratio", F.col("n_reads") / F.col("region") / F.col("mean_cov")).select("contig_id", "end", "n_reads", "region", "ratio")  # mean: one row


def coverage_bins(placements: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Tumbling bins of 30 bases per contig end: reads that start in each, and the bin before it."""
    x = placements.where("contig_end >= 0").withColumn("bin", F.floor((F.col("contig_pos") - 1) / p.coverage_bin))
    per = x.groupBy("contig_id", "contig_end", "bin").agg(F.count(F.lit(1)).alias("n_reads"))
    w = Window.partitionBy("contig_id", "contig_end")
    per = per.withColumn("mean_reads", F.avg("n_reads").over(w))
    return per.withColumn("before", F.lag("n_reads").over(w.orderBy("bin")))


def filter_bins(bins: DataFrame, links: DataFrame, high: float = 3.0) -> DataFrame:
    """Bins to drop: coverage above `high` times the mean (above 1 times after a dropped bin) while linked to many contigs.

    `links`: contig_id, contig_end, bin, n_links, second_share. The rule looks at the bin before, so each contig end runs
    through its bins in order; an end has at most region / 30 bins."""
    x = bins.join(links, ["contig_id", "contig_end", "bin"], "left").fillna(0)
    many = (F.col("n_links") > 5) | ((F.col("n_links") > 2) & (F.col("second_share") > 0.2))
    x = x.withColumn("ratio", F.col("n_reads") / F.col("mean_reads")).withColumn("many", many)
    steps = F.array_sort(F.collect_list(F.struct("bin", "ratio", "many")))
    per = x.groupBy("contig_id", "contig_end").agg(steps.alias("steps"))
    start = F.struct(F.lit(False).alias("prev"), F.array().cast("array<bigint>").alias("dropped"))

    def step(acc, s):
        hit = s["many"] & (s["ratio"] > F.when(acc["prev"] | (s["bin"] == 0), 1.0).otherwise(high))
        return F.struct(hit.alias("prev"), F.when(hit, F.concat(acc["dropped"], F.array(s["bin"]))).otherwise(acc["dropped"]).alias("dropped"))

    return per.select("contig_id", "contig_end", F.explode(F.aggregate("steps", start, step)["dropped"]).alias("bin"))


def bin_links(pairs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Per bin of a contig end: contigs its mates lie on, and the share of the second against the first (links.end_pairs)."""
    n = pairs.withColumn("bin", F.floor((F.col("pos1") - 1) / p.coverage_bin)).groupBy("c1", "e1", "bin", "c2").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("c1", "e1", "bin").orderBy(F.desc("n"), "c2")
    n = n.withColumn("rn", F.row_number().over(w))
    first, second = (F.max(F.when(F.col("rn") == i, F.col("n"))) for i in (1, 2))
    n = n.groupBy("c1", "e1", "bin").agg(F.count(F.lit(1)).alias("n_links"), (F.coalesce(second, F.lit(0)) / first).alias("second_share"))
    return n.select(F.col("c1").alias("contig_id"), F.col("e1").alias("contig_end"), "bin", "n_links", "second_share")


def without_bins(placements: DataFrame, dropped: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Placements that start in none of the dropped bins."""
    x = placements.withColumn("bin", F.floor((F.col("contig_pos") - 1) / p.coverage_bin))
    return x.join(dropped.select("contig_id", "contig_end", "bin"), ["contig_id", "contig_end", "bin"], "left_anti").drop("bin")


def uncovered_end(placements: DataFrame, contigs: DataFrame) -> DataFrame:
    """Distance from each end to the nearest read; the whole length of a contig without reads."""
    per = placements.groupBy("contig_id").agg(F.min("contig_pos").alias("lo"), F.max(F.col("contig_pos") + F.col("seqlen") - 1).alias("hi"))
    x = contigs.select("contig_id", F.length("seq").alias("clen")).join(per, "contig_id", "left")
    return x.select("contig_id", F.coalesce(F.col("lo") - 1, F.col("clen")).cast("int").alias("bare5"), F.coalesce(F.greatest(F.col("clen") - F.col("hi"), F.lit(0)), F.col("clen")).cast("int").alias("bare3"))
