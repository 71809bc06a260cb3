"""Queries of the operators in this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import heavy, lookalike, mixing, neardup, packing, seen, spans, terms


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_counts(_t(spark, d, "read_buf")).select("field", "term", "n", "n_occ", "n_records", "mark")


def p1_words(spark: SparkSession, d: str) -> DataFrame:
    """The same for the words of the documents, phrases of up to three words."""
    return terms.word_counts(_t(spark, d, "documents")).select("term", "n", "n_occ", "n_records", "mark")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    t = terms.term_counts(_t(spark, d, "read_buf"))
    return t.where("(field = 'seq' and n = 8 and mark is not null) or (field = 'hashcode' and mark = 'common')").select("field", "term", "mark")


def _both(reads: DataFrame, contigs: DataFrame, id_cols: dict[str, str]) -> DataFrame:
    out = [x.select(F.lit(kind).alias("rec_kind"), *(F.col(a).cast("bigint").alias(b) for a, b in id_cols.items())) for kind, x in (("read", reads), ("contig", contigs))]
    return out[0].unionByName(out[1])


def _kinds(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    return reads.select(F.lit("read").alias("rec_kind"), "*").unionByName(contigs.select(F.lit("contig").alias("rec_kind"), "*"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    reads = spans.shared_spans(_t(spark, d, "read_buf"), "rid", "seq", 40, merge_equal=True)
    contigs = spans.shared_spans(_t(spark, d, "contigs"), "contig_id", "contigseq", 100)
    return _both(reads, contigs, {"rec_id": "rec_id", "from_pos": "from_pos", "to_pos": "to_pos"})


def p2_portion(spark: SparkSession, d: str) -> DataFrame:
    reads = spans.shared_portion(_t(spark, d, "read_buf"), "rid", "seq", 40, merge_equal=True)
    contigs = spans.shared_portion(_t(spark, d, "contigs"), "contig_id", "contigseq", 100)
    return _kinds(reads, contigs).withColumn("share", F.round("share", 6))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    reads = spans.span_classes(_t(spark, d, "read_buf"), "rid", "seq", 40, merge_equal=True)
    return _kinds(reads, spans.span_classes(_t(spark, d, "contigs"), "contig_id", "contigseq", 100))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy.heavy_hitters(_t(spark, d, "read_buf")).select("hashcode")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return heavy.heavy_hitters(_t(spark, d, "read_buf"), share_ppm=2_000).select("hashcode", "n_rows")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    reads = neardup.near_pairs(_t(spark, d, "read_buf"), "rid", "seq", merge_equal=True)
    contigs = neardup.near_pairs(_t(spark, d, "contigs"), "contig_id", "contigseq")
    return _both(reads, contigs, {"id_a": "id_a", "id_b": "id_b"})


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    reads = neardup.near_groups(_t(spark, d, "read_buf"), "rid", "seq", merge_equal=True)
    return _kinds(reads, neardup.near_groups(_t(spark, d, "contigs"), "contig_id", "contigseq"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.seen_before(_t(spark, d, "read_buf"), _t(spark, d, "known_seqs")).where("seen").select("arrival_no")


def p6_rate(spark: SparkSession, d: str) -> DataFrame:
    return seen.error_rate(_t(spark, d, "read_buf"), _t(spark, d, "known_seqs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_t(spark, d, "documents")).where("n_pieces > 1 and piece = 1").select("doc_id").distinct()


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(_t(spark, d, "documents")))


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for any packing: all tokens are there, no container is overfull, only larger items are split, little is left."""
    x = packing.pack(_t(spark, d, "documents"))
    n = F.count(F.lit(1))
    boxes = x.groupBy("container").agg(F.sum("n_tokens").alias("t")).agg(F.count_if(F.col("t") > 2048).alias("n_overfull"), n.alias("n"), F.sum("t").alias("all"))
    boxes = boxes.select("n_overfull", (F.col("n") <= 1.05 * F.ceil(F.col("all") / 2048) + 1).alias("tight"))
    items = x.agg(F.count_if(F.col("piece") == 1).alias("n_items"), F.sum("n_tokens").alias("n_tokens"), n.alias("n_pieces"), F.count_if((F.col("n_pieces") > 1) & (F.col("piece") < F.col("n_pieces")) & (F.col("n_tokens") < 2048)).alias("n_early_cuts"))
    return items.crossJoin(F.broadcast(boxes))  # one row each


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for any mix: no document is used too often, a short source is used up, the others come near their share."""
    made, report = mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))
    uses = made.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    uses = uses.groupBy("source").agg(F.max("n").alias("most"))
    x = report.join(uses, "source", "left")
    left = F.when(F.col("short"), F.col("limit_tokens") - F.col("used_tokens")).otherwise(0)
    near = F.col("short") | (F.abs(F.col("used_tokens") - F.col("target_tokens")) <= F.col("target_tokens") * 0.05 + 4 * 2048)
    return x.select("source", "n_docs", "n_tokens", F.round("target_tokens", 3).alias("target_tokens"), "limit_tokens", "short", (F.coalesce("most", F.lit(0)) > F.col("max_repeats")).alias("too_often"), left.alias("left_over"), near.alias("near"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[1].where("short").select("source")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[1]


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))[0]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_look(_t(spark, d, "documents"), _t(spark, d, "look_alikes"))


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.one_form(_t(spark, d, "documents"), _t(spark, d, "look_alikes")).select("doc_id", "form")


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_classes(_t(spark, d, "documents"), _t(spark, d, "look_alikes"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_terms, p1_words, p2_found, p2_portion, p2_classes, p4_found, p4_counts, p5_found, p5_classes, p6_found, p6_rate, p7_found, p7_fill, p7_limits, p8_found, p8_shares, p8_limits, p8_mix, p9_found, p9_forms, p9_classes)}
