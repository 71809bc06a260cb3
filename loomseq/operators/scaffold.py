"""Chains of contigs: linking by mutual best links, splitting at breaks, concatenation, union with what stays unlinked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import revcomp
from ..functions.scratch import written
from ..params import DEFAULT, Params
from .chains import list_rank

CHAIN = "scaffold_id bigint, ord int, contig_id bigint, orient int, gap double, n_pairs bigint"
_TURN = {0: (0, 0), 1: (0, 1), 2: (1, 1), 3: (1, 0)}  # situation -> strands of the two contigs


def strand_links(ranked: DataFrame, contigs: DataFrame, p: Params = DEFAULT, thresholds: DataFrame | None = None, min_pairs: DataFrame | None = None) -> DataFrame:
    """(src, dst, gap, n_pairs, alone): the one link out of a contig strand, from both ends its clear best.

    A node is 2 x contig + strand. A link stands when no other one of either of its ends has more than second_share of its
    pairs, when both ends name each other as the best, and, with the one-row tables of links.thresholds and links.min_pairs, when
    its pairs lie within the limits. alone: no other link of the end has more than a tenth of its pairs."""
    size = contigs.select(F.col("contig_id").cast("bigint").alias("c"))
    e = ranked.where("n_best > 0").select(F.col("c1").cast("bigint").alias("c1"), F.col("c2").cast("bigint").alias("c2"), "best", "n_best", "n_second", "gap").where("c1 <> c2")
    turned = F.when(F.col("best") == 0, 2).when(F.col("best") == 2, 0).otherwise(F.col("best"))
    back = e.select(F.col("c2").alias("c1"), F.col("c1").alias("c2"), turned.alias("best"), "n_best", "n_second", "gap")
    e = e.unionByName(back).groupBy("c1", "c2", "best").agg(F.max("n_best").alias("n_best"), F.min("n_second").alias("n_second"), F.min(F.when(~F.isnan("gap"), F.col("gap"))).alias("gap"))
    e = e.join(size.withColumnRenamed("c", "c1"), "c1", "left_semi").join(size.withColumnRenamed("c", "c2"), "c2", "left_semi")
    strands = F.create_map(*[F.lit(x) for k, (x, y) in _TURN.items() for x in (k, 2 * x + y)])[F.col("best")]
    e = e.select((2 * F.col("c1") + F.floor(strands / 2)).cast("bigint").alias("src"), (2 * F.col("c2") + strands % 2).cast("bigint").alias("dst"), "n_best", "n_second", "gap")
    w = Window.partitionBy("src").orderBy(F.desc("n_best"), "dst")
    e = e.withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("n_best").over(w)).where("rn = 1")
    e = e.withColumn("rival", F.greatest("n_second", F.coalesce("next", F.lit(0)))).withColumn("clear", (F.col("n_best") >= p.link_second) & (F.col("rival") <= F.col("n_best") * p.second_share))
    if thresholds is not None:
        e = e.crossJoin(F.broadcast(thresholds.select("min_links", "max_links"))).where("n_best >= min_links and n_best <= max_links")  # one row
    if min_pairs is not None:
        e = e.crossJoin(F.broadcast(min_pairs.select("min_pairs"))).where("n_best >= min_pairs")  # one row
    e = e.where("clear").select("src", "dst", "gap", F.col("n_best").cast("bigint").alias("n_pairs"), (F.col("rival") <= 0.1 * F.col("n_best")).alias("alone"))
    mate = e.select(F.col("dst").bitwiseXOR(F.lit(1)).alias("src"), F.col("src").bitwiseXOR(F.lit(1)).alias("dst"), F.col("alone").alias("alone_back"))
    return e.join(mate, ["src", "dst"]).select("src", "dst", "gap", "n_pairs", (F.col("alone") & F.col("alone_back")).alias("alone"))


def link(ranked: DataFrame, contigs: DataFrame, p: Params = DEFAULT, thresholds: DataFrame | None = None, min_pairs: DataFrame | None = None) -> DataFrame:
    """Chain rows (CHAIN) from ranked edges (c1, c2, best, n_best, n_second, gap), relationally: the links of strand_links make
    chains of contig strands, each twice (read from either end), which are ranked by pointer doubling; no chain or component is
    one task's work. Of a chain and its mirror the one stays in which the longest contig (least id on ties) lies plus. A chain
    needs a link that is alone, from which it would start; chains that meet their own mirror are left out. A circle opens
    before its least strand."""
    e = written(strand_links(ranked, contigs, p, thresholds, min_pairs), "strand-links")
    size = contigs.select(F.col("contig_id").cast("bigint").alias("contig_id"), F.length("seq").alias("n"))
    x = list_rank(e).join(e.select(F.col("dst").alias("node"), F.col("src").alias("from"), "gap", "n_pairs", "alone"), "node", "left")
    x = x.withColumn("contig_id", F.floor(F.col("node") / 2).cast("bigint")).withColumn("orient", (F.col("node") % 2).cast("int")).join(size, "contig_id")
    first = F.col("rank") == 0  # of a circle, too
    x = written(x.select("head", "rank", "contig_id", "orient", "n", F.when(~first, F.col("gap")).alias("gap"), F.when(first, F.lit(0)).otherwise(F.col("n_pairs")).cast("bigint").alias("n_pairs"), F.when(~first, F.col("alone")).alias("alone")), "strands")
    longest = F.max_by("orient", F.struct("n", -F.col("contig_id"), -F.col("orient")))
    per = x.groupBy("head").agg(longest.alias("turn"), F.min("contig_id").alias("scaffold_id"), F.count_distinct("contig_id").alias("n_contigs"), F.count(F.lit(1)).alias("n"), F.bool_or("alone").alias("alone"))
    per = per.where("turn = 0 and n = n_contigs and alone")
    # a circle of contigs that opens at two places in its two mirrors is kept once
    per = per.groupBy("scaffold_id").agg(F.min("head").alias("head"))
    return x.join(per, "head").select("scaffold_id", (F.col("rank") + 1).cast("int").alias("ord"), "contig_id", "orient", "gap", "n_pairs")


def split_breaks(rows: DataFrame) -> DataFrame:
    """Sub-chains: a row whose decision is `break` starts a new one; ids are made of scaffold and part, order starts again at 1."""
    w = Window.partitionBy("scaffold_id").orderBy("ord")
    x = rows.withColumn("part", F.sum((F.col("decision") == "break").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumn("new_ord", F.row_number().over(Window.partitionBy("scaffold_id", "part").orderBy("ord")))


def weak_links(rows: DataFrame, contigs: DataFrame, direct: DataFrame, short: int = 300, overlap: int = 60) -> DataFrame:
    """Rows to break: a middle contig shorter than `short` that overlaps a neighbour by more than `overlap` while no pair links
    the two around it. `direct`: (c1, c2) contigs linked by pairs."""
    w = Window.partitionBy("scaffold_id").orderBy("ord")
    x = rows.join(contigs.select("contig_id", F.length("seq").alias("clen")), "contig_id")
    x = x.withColumn("c1", F.lag("contig_id").over(w)).withColumn("c2", F.lead("contig_id").over(w)).withColumn("after", F.lead("exact").over(w))
    x = x.where((F.col("clen") < short) & (F.greatest("exact", F.coalesce("after", F.lit(0))) > overlap) & F.col("c1").isNotNull() & F.col("c2").isNotNull())
    return x.join(direct.select("c1", "c2").distinct(), ["c1", "c2"], "left_anti").select("scaffold_id", "ord", "contig_id")


def break_weak(rows: DataFrame, weak: DataFrame) -> DataFrame:
    """Rows with a break on both sides of the weak ones: the middle contig goes its own way."""
    w = Window.partitionBy("scaffold_id").orderBy("ord")
    x = rows.join(weak.select("scaffold_id", "ord").distinct().withColumn("weak", F.lit(True)), ["scaffold_id", "ord"], "left").withColumn("weak", F.coalesce("weak", F.lit(False)))
    hit = (F.col("weak") | F.coalesce(F.lag("weak").over(w), F.lit(False))) & (F.col("decision") != "start")
    return x.withColumn("decision", F.when(hit, "break").otherwise(F.col("decision"))).drop("weak")


def joints(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """How each row is joined to the one before: letters to drop from its end, text put between, letters to skip at the start.

    merge: the exact overlap (behind cut ends) is skipped, or an imperfect one is replaced on both sides by its consensus; filled: the
    new bases stand between, the overlap is skipped; gap: max(gap, 2) unknown bases; start and break: nothing."""
    have = rows.columns
    col = {c: (F.coalesce(F.col(c), F.lit(0)) if c in have else F.lit(0)) for c in ("exact", "aligned", "aligned_left", "cut_left", "cut_right", "fill_overlap", "fill_drop")}
    text = {c: (F.col(c) if c in have else F.lit(None).cast("string")) for c in ("consensus", "fill")}
    d = F.col("decision")
    exact, imperfect, filled = (d == "merge") & (col["exact"] > 0), (d == "merge") & (col["exact"] <= 0), d == "filled"
    unknown = F.repeat(F.lit("N"), F.greatest(F.coalesce(F.round("gap"), F.lit(0)).cast("int"), F.lit(p.min_gap_bases)))
    drop = F.when(exact, col["cut_left"]).when(imperfect, col["aligned_left"]).when(filled, col["fill_drop"]).otherwise(0)
    skip = F.when(exact, col["cut_right"] + col["exact"]).when(imperfect, col["aligned"]).when(filled, col["fill_overlap"]).otherwise(0)
    between = F.when(imperfect, text["consensus"]).when(filled, text["fill"]).when(d == "gap", unknown)
    return rows.withColumns({"drop": drop.cast("int"), "skip": skip.cast("int"), "between": F.coalesce(between, F.lit(""))})


def scaffold_seqs(rows: DataFrame, contigs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(scaffold_id, part, n_contigs, len, seq): pieces in order, joined as `joints` says; minus strand reverse-complemented. A
    row that is cut is followed by unknown bases. A scaffold's text is one row."""
    x = rows.withColumn("decision", F.when(F.col("decision") == "cut", "gap").otherwise(F.col("decision")))
    x = split_breaks(joints(x, p))
    x = x.withColumn("drop_next", F.coalesce(F.lead("drop").over(Window.partitionBy("scaffold_id", "part").orderBy("ord")), F.lit(0)))
    x = x.join(contigs.select("contig_id", F.upper("seq").alias("seq")), "contig_id")
    seq = F.when(F.col("orient") == 1, revcomp(F.col("seq"))).otherwise(F.col("seq"))
    lead = F.when(F.col("new_ord") == 1, 0).otherwise(F.col("skip"))
    body = F.substring(seq, lead + 1, F.greatest(F.length("seq") - lead - F.col("drop_next"), F.lit(0)))
    piece = F.concat(F.when(F.col("new_ord") == 1, "").otherwise(F.col("between")), body)
    g = x.withColumn("piece", piece).groupBy("scaffold_id", "part").agg(F.array_sort(F.collect_list(F.struct("new_ord", "piece"))).alias("ps"), F.count(F.lit(1)).alias("n_contigs"))
    text = F.array_join(F.transform("ps", lambda s: s["piece"]), "")
    return g.select("scaffold_id", "part", "n_contigs", F.length(text).alias("len"), text.alias("seq"))


def with_unlinked(seqs: DataFrame, rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """Scaffolds and the contigs in none of them, each a scaffold of its own."""
    alone = contigs.join(rows.select("contig_id").distinct(), "contig_id", "left_anti")
    alone = alone.select(F.col("contig_id").cast("bigint").alias("scaffold_id"), F.lit(0).cast("bigint").alias("part"), F.lit(1).cast("bigint").alias("n_contigs"), F.length("seq").alias("len"), F.upper("seq").alias("seq"))
    return seqs.unionByName(alone)


def renumber(df: DataFrame, order: str, name: str) -> DataFrame:
    """Dense numbers 1.. in order, by ranges: counts of the ranges first, then a rank within each."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = df.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    x = written(x, "renumber")
    per = x.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    x = x.join(F.broadcast(per.withColumn("_before", before).drop("_n")), "_part")  # a row a range
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return x.withColumn(name, (rank + F.col("_before")).cast("bigint")).drop("_part", "_before")


def merged_contigs(seqs: DataFrame, rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """Contigs after merging overlapped chains: each chain becomes its least contig, the others go; dense new numbers."""
    whole = with_unlinked(seqs, rows, contigs)
    return renumber(whole.select("scaffold_id", "part", "seq", "len").withColumn("key", F.struct("scaffold_id", "part")), "key", "contig_id").drop("key")
