"""Gaps of chains: the reads near them, their filling and what becomes of the chain rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import revcomp
from ..functions.scratch import written
from ..params import DEFAULT, Params
from .assemble import fill_gaps


def gap_table(rows: DataFrame, contigs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(gap_id, scaffold_id, ord, gap, left_contig, right_contig, left_end, right_end): neighbours whose decision is a gap or a
    cut, with the two read lengths of bases on either side of it."""
    reach = 2 * p.read_len
    tips = contigs.select("contig_id", F.expr(f"right(upper(seq), {reach})").alias("last"), F.expr(f"left(upper(seq), {reach})").alias("first"))
    w = Window.partitionBy("scaffold_id").orderBy("ord")
    x, minus = rows.select("scaffold_id", "ord", "contig_id", "orient", "gap", "decision").join(tips, "contig_id"), F.col("orient") == 1
    x = x.withColumn("right_end", F.when(minus, revcomp(F.col("last"))).otherwise(F.col("first")))
    x = x.withColumn("left_end", F.lag(F.when(minus, revcomp(F.col("first"))).otherwise(F.col("last"))).over(w)).withColumn("left_contig", F.lag("contig_id").over(w))
    x = x.where("decision in ('gap', 'cut') and left_contig is not null")
    return x.select(F.xxhash64("scaffold_id", "ord").alias("gap_id"), "scaffold_id", "ord", "gap", "left_contig", F.col("contig_id").alias("right_contig"), "left_end", "right_end")


def near_reads(gaps: DataFrame, placements: DataFrame, reads: DataFrame) -> DataFrame:
    """(gap_id, reads): valid reads placed at the ends of the two contigs of each gap, and their mates, placed or not. An end is
    a region of fixed size, so a gap has some thousand reads at usual depths."""
    mate = F.col("rid") + F.when(F.col("rid") % 2 == 1, 1).otherwise(-1)
    near = placements.where("contig_end >= 0").select("contig_id", F.explode(F.array(F.col("rid"), mate)).alias("rid"))
    sides = gaps.select("gap_id", F.explode(F.array("left_contig", "right_contig")).alias("contig_id"))
    x = sides.join(near, "contig_id").select("gap_id", "rid").distinct().join(reads.select("rid", "seq"), "rid")
    return x.groupBy("gap_id").agg(F.array_sort(F.collect_list(F.struct("rid", "seq"))).alias("reads"))


def fill(rows: DataFrame, contigs: DataFrame, placements: DataFrame, reads: DataFrame, sdev: float, p: Params = DEFAULT, insert: float | None = None) -> DataFrame:
    """Rows with their gaps filled: decision `filled` with fill and fill_overlap; where a gap stays open, what was won on either
    side stands around the unknown bases; where the ends run past each other, `break`."""
    gaps = written(gap_table(rows, contigs, p), "gaps")
    done = fill_gaps(gaps.join(near_reads(gaps, placements, reads), "gap_id", "left"), p, sdev, insert)
    done = written(done.join(gaps.select("gap_id", "scaffold_id", "ord"), "gap_id"), "fills")
    unknown = F.repeat(F.lit("N"), F.greatest(F.coalesce(F.round("rest"), F.lit(0)).cast("int"), F.lit(p.min_gap_bases)))
    text = F.when(F.col("state") == "merged", F.col("fill")).otherwise(F.concat("won_left", unknown, "won_right"))
    got = done.select("scaffold_id", "ord", "state", text.alias("fill"), F.col("overlap").alias("fill_overlap"), F.col("drop").alias("fill_drop"))
    x = rows.join(got, ["scaffold_id", "ord"], "left")
    verdict = F.when(F.col("state").isNull(), F.col("decision")).when(F.col("state") == "break", "break").otherwise("filled")
    return x.withColumn("decision", verdict).drop("state")
