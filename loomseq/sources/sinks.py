"""Text sinks, and the snapshot that hands work from one command to the next."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_contigs(contigs: DataFrame, path: str, least_len: int = 0) -> None:
    """`>ID length: LEN` and one line of bases each, in order of ids; one part file a partition."""
    x = contigs.where(F.length("seq") >= least_len).orderBy("contig_id")
    x.select(F.concat(F.lit(">"), F.col("contig_id").cast("string"), F.lit(" length: "), F.length("seq").cast("string"), F.lit("\n"), F.col("seq")).alias("value")).write.mode("overwrite").text(path)


def write_scaffolds(scaffolds: DataFrame, path: str) -> None:
    """`>ID TAB contigs TAB length` and one line of bases each."""
    head = F.concat_ws("\t", F.concat(F.lit(">"), F.col("scaffold_id").cast("string")), F.col("n_contigs").cast("string"), F.length("seq").cast("string"))
    scaffolds.orderBy("scaffold_id").select(F.concat(head, F.lit("\n"), F.col("seq")).alias("value")).write.mode("overwrite").text(path)


def write_layout(placed: DataFrame, path: str) -> None:
    """Per contig position a line: position, number of reads, (rid,pos,matchnum,strand) of each."""
    item = F.concat(F.lit("("), F.concat_ws(",", "rid", "contig_pos", "matchlen", "orientation"), F.lit(")"))
    x = placed.groupBy("contig_id", "contig_pos").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(item)), " ").alias("reads"))
    x.orderBy("contig_id", "contig_pos").select(F.concat_ws("\t", "contig_id", "contig_pos", "n", "reads").alias("value")).write.mode("overwrite").text(path)


def write_overlaps(rows: DataFrame, path: str) -> None:
    """Tab-separated chain rows with overlap, gap and decision."""
    rows.orderBy("scaffold_id", "ord").select("scaffold_id", "ord", "contig_id", "orient", "exact", "aligned", "gap", "decision", "n_pairs").write.mode("overwrite").option("sep", "\t").csv(path)


def end_placements(placements: DataFrame, contigs: DataFrame, region: int) -> DataFrame:
    """Placements within `region` of an end (short contigs: all), as handed on to merging."""
    x = placements.join(contigs.select("contig_id", F.length("seq").alias("clen")), "contig_id")
    return x.where((F.col("clen") <= 2 * region) | (F.col("contig_pos") <= region) | (F.col("contig_pos") > F.col("clen") - region)).drop("clen")


def save_snapshot(path: str, reads: DataFrame, kmers: DataFrame, params: dict) -> None:
    """Reads, k-mer postings and a one-row table of parameters."""
    reads.write.mode("overwrite").parquet(f"{path}/reads")
    kmers.write.mode("overwrite").parquet(f"{path}/kmers")
    save_params(reads.sparkSession, path, params)


def save_params(spark: SparkSession, path: str, params: dict) -> None:
    """Overwrite the parameters of a snapshot only."""
    spark.createDataFrame([(json.dumps(params),)], "params string").coalesce(1).write.mode("overwrite").parquet(f"{path}/params")


def load_snapshot(spark: SparkSession, path: str, what: str) -> DataFrame | dict:
    """`reads`, `kmers` or `params` of a snapshot; only that part is read."""
    x = spark.read.parquet(f"{path}/{what}")
    return json.loads(x.first()[0]) if what == "params" else x
