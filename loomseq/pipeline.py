"""The staged pipeline: reads and k-mers -> contigs -> scaffolds, with a snapshot between the stages."""

from __future__ import annotations

from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scratch import written
from .operators import gaps, kmers, links, mapping, overlap, pairs, quality, scaffold, stats, unitigs
from .params import Params
from .sources import fastx, sinks


def resolve(spark: SparkSession, paths: list[str], k: int = 25, cut: int = 0, **more) -> Params:
    """Parameters from the reads themselves: the longest read (or the cut), an odd k, the size of end regions."""
    recs = fastx.records(spark, paths)
    longest = recs.agg(F.max(F.length("seq"))).first()[0]
    if not longest:
        raise ValueError("no reads")
    size = min(cut, longest) if cut else longest
    if k > size:
        raise ValueError(f"k = {k} is longer than the reads ({size})")
    return replace(Params(k=k, read_len=size), **more).resolved()


def index(spark: SparkSession, paths: list[str], out: str, paired: int = 0, k: int = 25, cut: int = 0, **more) -> Params:
    """Stage 1: numbered, quality-flagged reads and the k-mers of the valid ones."""
    p = resolve(spark, paths, k, cut, **more)
    reads = written(quality.flagged(fastx.reads(spark, paths, paired, cut), p), "reads")
    good = reads.where("valid").withColumn("seq", F.upper("seq"))
    sinks.save_snapshot(out, reads, kmers.explode_kmers(good, p), asdict(p) | {"paired": paired})
    return p


def _load(spark: SparkSession, out: str) -> tuple[Params, int, DataFrame]:
    got = sinks.load_snapshot(spark, out, "params")
    paired = got.pop("paired", 0)
    got.pop("insert", None)
    return Params(**got), paired, sinks.load_snapshot(spark, out, "reads").where("valid").withColumn("seq", F.upper("seq"))


def contigs(spark: SparkSession, out: str, least_len: int | None = None, name: str = "contigs") -> DataFrame:
    """Stage 2: contigs from a snapshot, overlapping ones merged, written as `contigs` (parquet) and `contigs.fa`, with the
    placements of the reads on their ends (`match_info`)."""
    p, paired, reads = _load(spark, out)
    made = unitigs.assemble(reads, p, p.min_contig_len if least_len is None else least_len)
    c = written(made.select("contig_id", "seq"), "assembled")
    if paired:
        c = merged(reads, c, p)
    c.select("contig_id", "seq", F.length("seq").alias("len")).write.mode("overwrite").parquet(f"{out}/contigs")
    c = spark.read.parquet(f"{out}/contigs")
    place(reads, c, p).write.mode("overwrite").parquet(f"{out}/match_info")
    sinks.write_contigs(c, f"{out}/{name}.fa")
    return c


def place(reads: DataFrame, c: DataFrame, p: Params) -> DataFrame:
    """Placements of reads that lie on contig ends at exactly one place."""
    hits = mapping.map_unique(reads, c, p)
    end = F.coalesce("end", F.lit(-1)).alias("contig_end")
    return written(hits.select(F.col("contig_id"), F.col("pos").alias("contig_pos"), F.col("seqlen").alias("matchlen"), "rid", "seqlen", F.col("orient").alias("orientation"), end), "placements")


def chain_rows(hits: DataFrame, c: DataFrame, insert: float, sdev: float, p: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, edges, placements used): links from mates, weeded, made to chains, with the overlap of neighbours decided.

    Reads in over-covered bins that link to many contigs are left out first; edges with implausible gaps go; the limits on
    pairs come from the edges; weakly linked short contigs in the middle of a chain are broken out."""
    dropped = mapping.filter_bins(mapping.coverage_bins(hits, p), mapping.bin_links(links.end_pairs(hits), p))
    hits = written(mapping.without_bins(hits, dropped, p), "kept-placements")
    ends = written(links.end_pairs(hits), "end-pairs")
    ranked = links.ranked(links.edges(ends))
    gaps = links.gap_sizes(ends, c, insert).select(*links.ENDS, F.col("s").alias("best"), "gap")
    coverage = mapping.end_coverage(hits, c, p).select("contig_id", F.col("ratio").alias("cov"))
    ranked = written(links.sane(ranked.join(gaps, [*links.ENDS, "best"], "left"), coverage), "edges")
    chain = written(scaffold.link(ranked, c, p, links.thresholds(ranked, p), links.min_pairs(ranked)), "chain")
    rows = written(overlap.neighbour_overlaps(chain, c, sdev, p, mapping.uncovered_end(hits, c)), "rows")
    weak = scaffold.weak_links(rows, c, ranked.select("c1", "c2").unionByName(ranked.select(F.col("c2").alias("c1"), F.col("c1").alias("c2"))))
    return written(scaffold.break_weak(rows, weak), "rows"), ranked, hits


def _insert(hits: DataFrame, p: Params, insert: float | None, sdev: float | None) -> tuple[float, float]:
    if insert is None:
        s = pairs.insert_stats(pairs.fragments(hits), p).first()
        insert, sdev = s.mean_insert or 2.0 * p.read_len, s.sdev_insert or sdev
    return insert, sdev or p.sdev_share * insert


def merged(reads: DataFrame, c: DataFrame, p: Params, least: int = 8) -> DataFrame:
    """Contigs after chains of contigs that overlap by `least` bases or more were joined; the others stay apart."""
    hits = place(reads, c, p)
    rows, _, _ = chain_rows(hits, c, *_insert(hits, p, None, None), p)
    long = (F.col("decision") == "merge") & (F.greatest("exact", F.coalesce("aligned", F.lit(0))) >= least)
    rows = written(rows.withColumn("decision", F.when(long | (F.col("decision") == "start"), F.col("decision")).otherwise("break")), "merge-rows")
    return written(scaffold.merged_contigs(scaffold.scaffold_seqs(rows, c, p), rows, c).select("contig_id", "seq"), "merged")


def scaffolds(spark: SparkSession, out: str, contig_files: list[str] | None = None, insert: float | None = None, sdev: float | None = None, fill_gaps: bool = True, name: str = "scaffolds", match_file: str | None = None, region: int | None = None) -> DataFrame:
    """Stage 3: reads mapped to contigs, ends linked by mates, overlaps decided, gaps filled, texts joined; written as
    `scaffolds.fa`, with the layout (`layout.txt`) and the overlaps (`overlaps.txt`).

    match_file: placements of the reads on these contigs (as `match_info` of stage 2), which are then not made again; region:
    size of the regions at contig ends in which reads are placed."""
    p, paired, reads = _load(spark, out)
    if region:
        p = replace(p, align_region=max(region, 2 * p.read_len))
    c = fastx.contigs(spark, contig_files, 0) if contig_files else spark.read.parquet(f"{out}/contigs")
    c = written(c.select("contig_id", "seq"), "contigs")
    if not paired:
        rows = spark.createDataFrame([], scaffold.CHAIN + ", exact int, aligned int, aligned_left int, consensus string, cut_left int, cut_right int, decision string")
    else:
        hits = spark.read.parquet(match_file) if match_file else place(reads, c, p)
        insert, sdev = _insert(hits, p, insert, sdev)
        sinks.save_params(spark, out, {**{k: v for k, v in asdict(p).items()}, "paired": paired, "insert": [insert, sdev]})
        rows, _, hits = chain_rows(hits, c, insert, sdev, p)
        if fill_gaps:
            rows = written(gaps.fill(rows, c, hits, reads, sdev, p, insert), "filled-rows")
        sinks.write_layout(hits, f"{out}/layout.txt")
        sinks.write_overlaps(rows, f"{out}/overlaps.txt")
    joined = written(scaffold.with_unlinked(scaffold.scaffold_seqs(rows, c, p), rows, c), "scaffolds")
    made = scaffold.renumber(joined.withColumnRenamed("scaffold_id", "first").withColumn("key", F.struct("first", "part")), "key", "scaffold_id").select("scaffold_id", "n_contigs", "len", "seq")
    made.write.mode("overwrite").parquet(f"{out}/scaffolds")
    s = spark.read.parquet(f"{out}/scaffolds")
    sinks.write_scaffolds(s, f"{out}/{name}.fa")
    return s


def report(df: DataFrame) -> dict:
    return stats.length_stats(df).first().asDict()
