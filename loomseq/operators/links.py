"""Edges between contig ends, their ranking and the thresholds of scaffolding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from .pairs import mates

ENDS = ("c1", "e1", "c2", "e2")


def end_pairs(placements: DataFrame) -> DataFrame:
    """Pairs whose mates lie at ends of two different contigs, seen from both sides."""
    m = mates(placements.where("contig_end >= 0")).where("contig_id_1 <> contig_id_2")

    def side(a: str, b: str) -> DataFrame:
        cols = ("contig_id", "contig_end", "contig_pos", "orientation", "seqlen", "rid")
        return m.select("pair_id", *[F.col(f"{c}_{x}").alias(f"{n}{y}") for x, y in ((a, "1"), (b, "2")) for c, n in zip(cols, ("c", "e", "pos", "o", "len", "rid"))])

    return side("1", "2").unionByName(side("2", "1"))


def situation(e1: Column, o1: Column, e2: Column, o2: Column) -> Column:
    """0..3: how the two contigs lie to each other: (+,+), (+,-), (-,-), (-,+); null when strand and end don't fit."""
    near5_1, near3_1 = e1.isin(0, 2) & (o1 == 1), e1.isin(1, 2) & (o1 == 0)
    near5_2, near3_2 = e2.isin(0, 2) & (o2 == 1), e2.isin(1, 2) & (o2 == 0)
    return F.when(near3_1 & near5_2, 0).when(near3_1 & near3_2, 1).when(near5_1 & near3_2, 2).when(near5_1 & near5_2, 3)


def edges(pairs: DataFrame) -> DataFrame:
    """Per pair of contig ends the number of mates in each of the four situations; ends without any are left out."""
    s = situation(F.col("e1"), F.col("o1"), F.col("e2"), F.col("o2"))
    x = pairs.withColumn("s", s).groupBy(*ENDS).agg(*[F.sum(F.when(F.col("s") == i, 1).otherwise(0)).cast("int").alias(f"n{i}") for i in range(4)])
    return x.where("n0 + n1 + n2 + n3 > 0")


def clean(contig_edges: DataFrame) -> DataFrame:
    """Distinct stored edges as n0..n3 columns; those with no count are dropped."""
    x = contig_edges.where("n is not null").select(*ENDS, *[F.coalesce(F.get("n", F.lit(i)), F.lit(0)).alias(f"n{i}") for i in range(4)], "gap").distinct()
    return x.where("n0 + n1 + n2 + n3 > 0")


def ranked(e: DataFrame) -> DataFrame:
    """Best and second situation of each edge; equal counts go to the lower number."""
    order = F.array_sort(F.array(*[F.struct((-F.col(f"n{i}")).alias("neg"), F.lit(i).alias("s")) for i in range(4)]))
    x = e.withColumn("r", order)
    return x.select(*e.columns, F.col("r")[0]["s"].alias("best"), (-F.col("r")[0]["neg"]).alias("n_best"), F.col("r")[1]["s"].alias("second"), (-F.col("r")[1]["neg"]).alias("n_second"))


def gap_sizes(pairs: DataFrame, contigs: DataFrame, mean_insert: float) -> DataFrame:
    """Mean over linking pairs of insert - base1 - base2 in each situation, cut to whole bases a pair."""
    size = contigs.select(F.col("contig_id").alias("c"), F.length("seq").alias("n"))
    x = pairs.withColumn("s", situation(F.col("e1"), F.col("o1"), F.col("e2"), F.col("o2"))).where("s is not null")
    x = x.join(size.select(F.col("c").alias("c1"), F.col("n").alias("n1")), "c1").join(size.select(F.col("c").alias("c2"), F.col("n").alias("n2")), "c2")
    right1, left1 = F.expr("n1 - pos1 + 1"), F.expr("pos1 + len1 - 1")
    right2, left2 = F.expr("n2 - pos2 + 1"), F.expr("pos2 + len2 - 1")
    b1 = F.when(F.col("s").isin(0, 1), right1).otherwise(left1)
    b2 = F.when(F.col("s").isin(0, 3), left2).otherwise(right2)
    return x.groupBy(*ENDS, "s").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg((F.lit(mean_insert) - b1 - b2).cast("int")).alias("gap"))


def top2(r: DataFrame) -> DataFrame:
    """Best and second edge of each contig end."""
    w = Window.partitionBy("c1", "e1").orderBy(F.desc("n_best"), "c2", "e2")
    return r.withColumn("rank", F.row_number().over(w)).where("rank <= 2")


def thresholds(r: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row: mean links an edge, over the 5' lists only with both totals halved down, and the limits made of it."""
    x = r.where("e1 <> 1").agg(F.coalesce(F.sum("n_best"), F.lit(0)).alias("pairs"), F.count(F.lit(1)).alias("edges"))
    a = F.floor(F.col("pairs") / 2) / F.floor(F.col("edges") / 2)
    x = x.select(F.when(F.col("edges") >= 2, a).otherwise(0.0).alias("avg_links"))
    return x.withColumn("max_links", F.col("avg_links") * p.link_max_factor).withColumn("min_links", F.least(F.col("avg_links") * p.link_min_factor, F.lit(float(p.link_min)))).withColumn("max_second", F.lit(p.link_second))


def min_pairs(r: DataFrame) -> DataFrame:
    """One row: 1 if more than a tenth of the links have a single pair, else 2."""
    share = F.avg((F.col("n_best") == 1).cast("int"))
    return r.agg(F.coalesce(share, F.lit(0.0)).alias("single_share"), F.when(share > 0.1, 1).otherwise(2).alias("min_pairs"))


def single_links(r: DataFrame, share: float = 0.1) -> DataFrame:
    """Edges whose end has no other edge with more than `share` of their support."""
    w = Window.partitionBy("c1", "e1")
    x = r.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n_best"), "c2", "e2")))
    x = x.withColumn("other", F.max(F.when(F.col("rank") > 1, F.col("n_best"))).over(w))
    return x.where("rank = 1").where(F.coalesce(F.col("other"), F.lit(0)) <= F.col("n_best") * share).drop("rank", "other")


def sane(r: DataFrame, coverage: DataFrame) -> DataFrame:
    """Drop links with gap < -500, or gap < -200 where an end is covered more than twice the mean (`coverage`: contig_id, cov)."""
    c = coverage.groupBy("contig_id").agg(F.max("cov").alias("cov"))
    x = r.join(c.withColumnRenamed("contig_id", "c1").withColumnRenamed("cov", "cov1"), "c1", "left").join(c.withColumnRenamed("contig_id", "c2").withColumnRenamed("cov", "cov2"), "c2", "left")
    high = F.greatest(F.coalesce("cov1", F.lit(0.0)), F.coalesce("cov2", F.lit(0.0))) > 2
    gap = F.when(~F.isnan("gap"), F.col("gap"))
    return x.where(~F.coalesce((gap < -500) | ((gap < -200) & high), F.lit(False))).drop("cov1", "cov2")


def linked_contigs(pairs: DataFrame) -> DataFrame:
    """Per contig end the two contigs most of its mates lie on."""
    n = pairs.groupBy("c1", "e1", "c2").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("c1", "e1").orderBy(F.desc("n"), "c2")
    return n.withColumn("rank", F.row_number().over(w)).where("rank <= 2")


def qualified_pairs(pairs: DataFrame, contigs: DataFrame, k: int, region: int) -> DataFrame:
    """Per edge: pairs with both reads between 1.5 k and `region` of their ends (valid), and the others."""
    size = contigs.select(F.col("contig_id").alias("c"), F.length("seq").alias("n"))
    x = pairs.join(size.select(F.col("c").alias("c1"), F.col("n").alias("n1")), "c1").join(size.select(F.col("c").alias("c2"), F.col("n").alias("n2")), "c2")

    def inside(i: str) -> Column:
        d = F.when(F.col(f"e{i}") == 1, F.col(f"n{i}") - F.col(f"pos{i}") + 1).otherwise(F.col(f"pos{i}"))
        return d.between(int(1.5 * k) + 1, region)

    ok = inside("1") & inside("2")
    return x.groupBy(*ENDS).agg(F.sum(ok.cast("int")).alias("n_valid"), F.sum((~ok).cast("int")).alias("n_other"))
