"""Length statistics and windows along positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def length_stats(df: DataFrame, length: str = "len", least: int = 0) -> DataFrame:
    """One row: count, total, max, N50, mean and median of the lengths of at least `least`.

    N50: first length, longest first, whose running sum reaches half of the total (cut to a whole number). Median: the
    element after half of the list, longest first. Lengths are counted first, so the ordered window runs over distinct
    lengths only, never over all rows."""
    per = df.where(F.col(length) >= least).groupBy(F.col(length).cast("bigint").alias("l")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("l")).rowsBetween(Window.unboundedPreceding, 0)  # one row a distinct length
    run = per.withColumn("rank", F.sum("c").over(w)).withColumn("run", F.sum(F.col("c") * F.col("l")).over(w))
    tot = per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("c") * F.col("l")), F.lit(0)).alias("total"), F.max("l").alias("max_len"))
    x = run.crossJoin(F.broadcast(tot))  # tot: one row
    return x.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("n"),
        F.coalesce(F.max("total"), F.lit(0)).alias("total"),
        F.max("max_len").alias("max_len"),
        F.max(F.when(F.col("run") >= F.floor(F.col("total") / 2), F.col("l"))).alias("n50"),
        F.max(F.col("total") / F.col("n")).alias("mean_len"),
        F.max(F.when(F.col("rank") >= F.floor(F.col("n") / 2) + 1, F.col("l"))).alias("median_len"),
    )


def density_ratio(placements: DataFrame, contigs: DataFrame, read_len: int) -> DataFrame:
    """Reads that end within the last read_len positions against the mean density of the contig, at each end position."""
    x = placements.withColumn("pos", F.col("contig_pos") + F.col("seqlen") - 1).groupBy("contig_id", "pos").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("contig_id")
    x = x.withColumn("region_reads", F.sum("n").over(w.orderBy("pos").rangeBetween(-(read_len - 1), 0))).withColumn("total", F.sum("n").over(w))
    x = x.join(contigs.select("contig_id", F.length("seq").alias("clen")), "contig_id")
    return x.select("contig_id", "pos", "region_reads", (F.col("region_reads") * F.col("clen") / (F.col("total") * F.least(F.lit(read_len), F.col("clen")))).alias("ratio"))


def uncovered_runs(placements: DataFrame, contigs: DataFrame, read_len: int, factor: float = 1.5) -> DataFrame:
    """Longest run of positions without the end of a read in the last factor x read_len positions of each contig.

    Gaps between neighbouring ends give the runs; no position is listed."""
    ends = placements.select("contig_id", (F.col("contig_pos") + F.col("seqlen") - 1).alias("pos")).distinct()
    size = contigs.select("contig_id", F.length("seq").alias("clen")).withColumn("first", F.greatest(F.lit(1), F.col("clen") - int(factor * read_len) + 1))
    edge = size.select("contig_id", (F.col("clen") + 1).alias("pos"))
    x = ends.unionByName(edge).join(size, "contig_id").where("pos between first and clen + 1")
    before = F.lag("pos").over(Window.partitionBy("contig_id").orderBy("pos"))
    x = x.withColumn("run", F.col("pos") - F.coalesce(before, F.col("first") - 1) - 1)
    return x.groupBy("contig_id").agg(F.max("run").cast("int").alias("longest_run"))


def tail_guards(votes: DataFrame) -> DataFrame:
    """Counts over windows behind each position that the stop rules of the extension test.

    `votes`: contig_id, pos, pe_max, pe_sec, se_max, se_sec. Gives per position: c30_single (of the last 30 positions those
    with one single-end vote and no mate vote), c50_pe (of the last 50 with mate votes), c100_ambiguous (of the last 100 with a second
    at 0.6 of the first or more) and stop: all 30 single, or three ambiguous ones."""
    w = Window.partitionBy("contig_id").orderBy("pos")
    single = ((F.col("pe_max") == 0) & (F.col("se_max") == 1)).cast("int")
    second = ((F.col("pe_sec") + F.col("se_sec")) >= 0.6 * (F.col("pe_max") + F.col("se_max"))) & (F.col("pe_sec") + F.col("se_sec") > 0)
    x = votes.withColumn("c30_single", F.sum(single).over(w.rangeBetween(-29, 0)))
    x = x.withColumn("c50_pe", F.sum((F.col("pe_max") > 0).cast("int")).over(w.rangeBetween(-49, 0)))
    x = x.withColumn("c100_ambiguous", F.sum(second.cast("int")).over(w.rangeBetween(-99, 0)))
    return x.select("contig_id", "pos", "c30_single", "c50_pe", "c100_ambiguous", ((F.col("c30_single") >= 30) | (F.col("c100_ambiguous") >= 3)).alias("stop"))
