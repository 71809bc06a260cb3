"""Placements, mates and insert sizes. Placements: contig_id, contig_pos, matchlen, rid, seqlen, orientation, contig_end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT, Params

COLS = ("contig_id", "contig_pos", "matchlen", "rid", "seqlen", "orientation", "contig_end")


def pair_of(rid: Column) -> Column:
    """Odd rid and the next even one are mates."""
    return F.floor((rid + 1) / 2).cast("bigint")


def placed(match_info: DataFrame) -> DataFrame:
    """Distinct placements on a contig; unmapped (0), invalidated (-1) and null ones are left out."""
    return match_info.where("contig_id > 0 and rid is not null").select(*COLS).distinct()


def placement_groups(match_info: DataFrame) -> DataFrame:
    """Per read: length, number of placements, placements in order."""
    p = placed(match_info)
    return p.groupBy("rid").agg(F.max("seqlen").alias("seqlen"), F.count(F.lit(1)).alias("n_places"), F.array_sort(F.collect_list(F.struct("contig_id", "contig_pos", "orientation", "matchlen"))).alias("places"))


def unique_placements(match_info: DataFrame) -> DataFrame:
    """Reads placed exactly once, however often the row is repeated: least and greatest placement are the same. One shuffle
    with map-side aggregation, no distinct."""
    one = F.struct(*[F.col(c) for c in COLS if c != "rid"])
    x = match_info.where("contig_id > 0 and rid is not null").groupBy("rid").agg(F.min(one).alias("p"), F.max(one).alias("q"))
    return x.where("p <=> q").select("rid", "p.*")


def last_placement(match_info: DataFrame, order: str) -> DataFrame:
    """Per read its placement of greatest `order`: a later row overwrites an earlier one."""
    row = F.struct(*[F.col(c) for c in COLS if c != "rid"])
    return match_info.where("rid is not null").groupBy("rid").agg(F.max_by(row, F.col(order)).alias("p")).select("rid", "p.*")


def mates(placements: DataFrame) -> DataFrame:
    """Both mates in one row: pair_id and the columns of the odd (_1) and even (_2) read. `placements` has one row a read, so a
    pair is an aggregation of two rows: one shuffle on pair_id and no join."""
    cols = [c for c in placements.columns if c != "pair_id"]
    row, odd = F.struct(*cols), F.col("rid") % 2 == 1
    x = placements.groupBy(pair_of(F.col("rid")).alias("pair_id")).agg(F.max(F.when(odd, row)).alias("a"), F.max(F.when(~odd, row)).alias("b"))
    x = x.where("a is not null and b is not null")
    return x.select("pair_id", *[F.col(f"a.{c}").alias(f"{c}_1") for c in cols], *[F.col(f"b.{c}").alias(f"{c}_2") for c in cols])


def fragments(placements: DataFrame) -> DataFrame:
    """Fragment sizes of pairs on one contig, fully matched, the left read plus and the right one minus."""
    m = mates(placements).where("contig_id_1 = contig_id_2 and matchlen_1 = seqlen_1 and matchlen_2 = seqlen_2 and orientation_1 <> orientation_2")
    plus = F.col("orientation_1") == 0
    left, right = (F.when(plus, F.col(f"contig_pos_{a}")).otherwise(F.col(f"contig_pos_{b}")) for a, b in (("1", "2"), ("2", "1")))
    length = F.when(plus, F.col("matchlen_2")).otherwise(F.col("matchlen_1"))
    return m.withColumn("frag", (right + length - left).cast("int")).where(left <= right).select("pair_id", F.col("contig_id_1").alias("contig_id"), "frag")


def insert_stats(frags: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row: pairs, mean and sample deviation of fragments of at most 5,000."""
    x = frags.where(F.col("frag") <= p.max_insert)
    return x.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("frag").alias("mean_insert"), F.stddev_samp("frag").alias("sdev_insert"))


def valid_mates(placements: DataFrame, mean: float, sdev: float) -> DataFrame:
    """Pairs whose fragment is at least mean - 2 sdev (short inserts: mean - 0.1 mean)."""
    low = min(mean - 2 * sdev, mean - 0.1 * mean)
    return fragments(placements).where(F.col("frag") >= low)


def window_partners(placements: DataFrame, mean: float, sdev: float, read_len: int, k: int, factor: float = 3.0, least_width: int = 80) -> DataFrame:
    """Band join: for each placed read the plus-strand reads of its contig that lie mean +/- factor x sdev - (L-k+1) behind it.

    Positions are cut into bins as wide as the band, so each row meets two or three bins by an equi-join and the
    band is a residual filter; no cross join inside a contig."""
    mid, half = mean - (read_len - k + 1), max(factor * sdev, least_width / 2)
    lo, hi = int(mid - half), int(mid + half)
    width = max(hi - lo, 1)
    a = placements.select("contig_id", F.col("rid").alias("tail_rid"), F.col("contig_pos").alias("tail_pos"))
    a = a.withColumn("bin", F.explode(F.sequence(F.floor((F.col("tail_pos") - hi) / width), F.floor((F.col("tail_pos") - lo) / width))))
    b = placements.where("orientation = 0").select("contig_id", "rid", "contig_pos", F.floor(F.col("contig_pos") / width).alias("bin"))
    return a.join(b, ["contig_id", "bin"]).where(F.col("tail_pos") - F.col("contig_pos") >= lo).where(F.col("tail_pos") - F.col("contig_pos") <= hi).where("rid <> tail_rid").drop("bin")


def gap_reads(reads: DataFrame, match_info: DataFrame) -> DataFrame:
    """Reads kept for gap filling, of pairs with both reads valid: mate 1 if unmapped and mate 2 is at a contig end or
    unmapped; else mate 2 by the mirrored test. Invalidated reads are out."""
    per = match_info.groupBy("rid").agg(F.max("contig_id").alias("contig_id"), F.min("contig_id").alias("low"), F.max(F.coalesce("contig_end", F.lit(-1))).alias("contig_end"))
    x = reads.where("valid").select("rid").join(per, "rid", "left").fillna(0, ["contig_id", "low"]).fillna(-1, ["contig_end"])
    m = mates(x)
    un = {s: (F.col(f"contig_id_{s}") == 0) & (F.col(f"low_{s}") == 0) for s in "12"}
    end = {s: (F.col(f"contig_id_{s}") > 0) & (F.col(f"contig_end_{s}") >= 0) for s in "12"}
    pick = F.when(un["1"] & (end["2"] | un["2"]), F.col("rid_1")).when(un["2"] & end["1"], F.col("rid_2"))
    return m.select(pick.alias("rid")).where("rid is not null")
