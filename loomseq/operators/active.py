"""Reads that run along the tail of a contig: state transitions, locking, one row for each of them, stop rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params


def status(p: Params = DEFAULT) -> Column:
    """failed, success or assembling of an active read (mismatches, matched, base_pos, seqlen, ratio, contig_len).

    More than 3 mismatches fail; at its end a read succeeds with 0.9 of its bases matched, on a long contig of more than 1.5
    times the usual density only with one mismatch at most."""
    c = F.col
    strict = (c("ratio") > 1.5) & (c("contig_len") > 3 * p.read_len)
    good = (c("matched") / c("seqlen") >= 0.9) & (~strict | (c("mismatches") <= 1))
    return F.when(c("mismatches") > p.max_mismatch, "failed").when(c("base_pos") < c("seqlen"), "assembling").when(good, "success").otherwise("failed")


def settle(active: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Active reads with their status; of several rows of one read that succeed only the one of least mismatches does."""
    x = active.withColumn("status", status(p))
    w = Window.partitionBy("contig_id", "rid").orderBy(F.when(F.col("status") == "success", 0).otherwise(1), "mismatches", F.desc("base_pos"), "orientation")
    again = (F.col("status") == "success") & (F.row_number().over(w) > 1)
    return x.withColumn("status", F.when(again, "failed").otherwise(F.col("status")))


def unmate_failed(settled: DataFrame) -> DataFrame:
    """`mated` is dropped from reads whose partner failed."""
    lost = settled.where("status = 'failed'").select("contig_id", (F.col("rid") + F.when(F.col("rid") % 2 == 1, 1).otherwise(-1)).alias("rid")).distinct().withColumn("lost", F.lit(True))
    return settled.join(lost, ["contig_id", "rid"], "left").withColumn("mated", F.col("mated") & F.col("lost").isNull()).drop("lost")


def lock(active: DataFrame, least_occ: int, avg_occ: float) -> DataFrame:
    """When locked reads are fewer than twice least_occ or than the mean, all reads that agree with the tail are locked."""
    w = Window.partitionBy("contig_id")
    n = F.sum(F.col("locked").cast("int")).over(w)
    return active.withColumn("locked", F.when((n < 2 * least_occ) | (n < avg_occ), F.col("run") > 0).otherwise(F.col("locked")))


def best_row(active: DataFrame) -> DataFrame:
    """One row a read: least tail errors + mismatches + unaligned prefix, on ties the longest tail."""
    cost = F.col("tail_errors") + F.col("mismatches") + F.col("bare_prefix")
    w = Window.partitionBy("contig_id", "rid").orderBy(cost, F.desc("tail_len"), "orientation")
    return active.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def any_long_success(placements: DataFrame, read_len: int, share: float = 0.8) -> DataFrame:
    """Per contig whether some placed read matches at least `share` of a read's length."""
    return placements.groupBy("contig_id").agg(F.coalesce(F.bool_or(F.col("matchlen") >= share * read_len), F.lit(False)).alias("has_long"))


def window_counts(votes: DataFrame, read_len: int) -> DataFrame:
    """Counts behind each position that the stop rules read.

    votes: contig_id, pos, pe_max, pe_sec, se_max, se_sec, covered (a placed read ends here). Every count is a range window
    over positions of one contig; all windows share one sort. c_<span>_<rule>: positions of the last <span> bases that pass;
    runs_<span>: uncovered runs of at least 25 positions that end in the span."""
    L = read_len
    w = Window.partitionBy("contig_id").orderBy("pos")
    c = F.col
    ratio = F.when(c("pe_max") > 0, c("pe_sec") / c("pe_max")).otherwise(0.0)
    se_ratio = F.when(c("se_max") > 0, c("se_sec") / c("se_max")).otherwise(0.0)
    last = F.last(F.when(c("covered"), c("pos")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = votes.withColumns({"_r": ratio, "_s": se_ratio, "_gap": F.when(c("covered") & (c("pos") - last - 1 >= 25), 1).otherwise(0)})

    def n(cond: Column, span: int) -> Column:
        return F.sum(cond.cast("int")).over(w.rangeBetween(-(span - 1), 0))

    r, sec = c("_r"), c("pe_sec")
    counts = {
        "c_30_single": n((c("pe_max") == 0) & (c("se_max") == 1), 30),
        "c_50_pe": n(c("pe_max") > 0, 50),
        "c_65_pe": n(c("pe_max") > 0, 65),
        "mean_50": F.avg(c("se_max")).over(w.rangeBetween(-49, 0)),
        "c_50_se": n(((c("se_max") >= 3) & (c("_s") > 0.2)) | (c("_s") > 0.3), 50),
        "c_l_60": n(r >= 0.6, L),
        "c_l_close": n((r >= 0.5) & (c("pe_max") - sec < 2), L),
        "c_l_25": n(r >= 0.25, L),
        "c_2l_50": n(r >= 0.5, 2 * L),
        "c_l_80": n((r > 0.8) & (sec > 3), L),
        "c_l_30": n((r > 0.3) & (sec > 3), L),
        "c_l_70": n((r > 0.7) & (sec > 3), L),
        "c_2l_30": n((r > 0.3) & (sec > 3), 2 * L),
        "c_4l_20": n((r >= 0.2) & (sec >= 3), 4 * L),
        "c_3l_20": n((r > 0.2) & (sec >= 3), 3 * L),
        "c_h_25": n((r > 0.25) & (sec >= 5), L // 2),
        "c_l_30b": n((r > 0.3) & (sec >= 3), L),
        "c_l_75": n((r > 0.75) & (sec > 3), L),
        "c_l_40": n((r > 0.4) & (sec > 3), L),
        "runs_l": F.sum("_gap").over(w.rangeBetween(-(L - 1), 0)),
        "runs_2l": F.sum("_gap").over(w.rangeBetween(-(2 * L - 1), 0)),
        "runs_4l": F.sum("_gap").over(w.rangeBetween(-(4 * L - 1), 0)),
    }
    return x.withColumns(counts).drop("_r", "_s", "_gap")


def tail_state(votes: DataFrame, placements: DataFrame, contigs: DataFrame, read_len: int) -> DataFrame:
    """votes (contig_id, pos, se_max, se_sec, pe_max, pe_sec) with what lies behind each position: covered (a placed read ends here), tail
    (positions since the last such end) and ratio (read ends of the last read_len positions against the mean of the contig)."""
    ends = placements.groupBy("contig_id", (F.col("contig_pos") + F.col("seqlen") - 1).alias("pos")).agg(F.count(F.lit(1)).alias("n_ends"))
    total = placements.groupBy("contig_id").agg(F.count(F.lit(1)).alias("total"))
    x = votes.join(ends, ["contig_id", "pos"], "left").fillna(0, ["n_ends"]).join(total, "contig_id").join(contigs.select("contig_id", F.length("seq").alias("clen")), "contig_id")
    w = Window.partitionBy("contig_id").orderBy("pos")
    covered = F.col("n_ends") > 0
    last = F.last(F.when(covered, F.col("pos")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    near = F.sum("n_ends").over(w.rangeBetween(-(read_len - 1), 0))
    ratio = near * F.col("clen") / (F.col("total") * F.least(F.lit(read_len), F.col("clen")))
    return x.withColumns({"covered": covered, "tail": (F.col("pos") - F.coalesce(last, F.lit(0))).cast("bigint"), "ratio": ratio}).drop("n_ends", "total", "clen")


#: State of the extension at a position, with the value it has when a caller doesn't track it.
STATE = {"length": 0, "turn": 0, "tail": 0, "ratio": 1.0, "navi": 0, "pre_navi": 0, "n_paths": 1, "path_max": 1, "path_second": 0, "path_left": 1000, "tandem_ok": False, "tandem_sec": 0, "tandem_max": 1, "tandem_agrees": True, "navi_is_max": False, "single_pe": False, "path_agrees": True, "path_share": 1.0, "pe_known": True}


def stop_rule(read_len: int, avg_occ: float, min_pe: int, min_gap_len: int) -> Column:
    """Number of the first of 18 guard rules that forbids extension, null if none: over window_counts and STATE columns."""
    c, L = F.col, read_len
    two = c("n_paths") >= 2
    long = c("pe_known") & (c("length") > 10 * min_pe)
    r, sec = F.when(c("pe_max") > 0, c("pe_sec") / c("pe_max")).otherwise(0.0), c("pe_sec")
    nine = long & (c("pre_navi") > 0) & (c("navi") < 0.5 * L) & two & ~c("tandem_ok") & (r >= 0.3) & (sec > 3)
    rules = [
        c("c_30_single") >= 30,
        c("pe_known") & (c("length") > 5 * min_pe + c("turn")) & (c("c_50_pe") == 0) & ((c("mean_50") > 4) | (c("c_50_se") > 0)),
        c("pe_known") & (c("length") > min_gap_len + c("turn")) & (c("c_65_pe") == 0),
        c("pe_known") & (c("length") > 2 * min_pe) & (c("c_l_60") >= 3),
        c("pe_known") & (c("tail") > 40) & (c("ratio") < 0.6) & ((c("c_l_close") > 0) | (c("runs_2l") >= 3)),
        c("pe_known") & (c("tail") > 40) & ((c("ratio") > 2) | (c("ratio") < 0.3)) & (c("c_2l_50") >= 2) & (c("runs_2l") >= 2),
        c("pe_known") & (c("tail") > 50) & (c("ratio") < 0.7) & (c("c_l_25") >= 1),
        long & (c("navi") == 0) & two & (c("tail") > 20) & (c("path_max") < 0.5 * c("path_second")) & (c("path_left") < 10),
        nine & (c("c_l_80") >= 1) & (c("c_l_30") >= 2),
        nine & (c("navi") == 0) & (c("pre_navi") < L) & (c("c_l_70") >= 1),
        long & (c("navi") < 0.5 * L) & (c("pre_navi") < 0.5 * L) & two & (c("tail") > 0.4 * L) & (c("ratio") > 1.5) & (c("c_2l_30") >= 2),
        long & (c("path_second") > 3 * avg_occ) & (c("path_max") > 2 * c("path_second")) & (c("ratio") > 2) & c("navi_is_max") & c("tandem_ok") & (c("tandem_sec") > avg_occ) & (c("tandem_sec") / c("tandem_max") >= 0.4) & ~c("tandem_agrees"),
        long & (c("navi") < 0.5 * L) & (c("pre_navi") < 0.5 * L) & (c("tail") > 0.3 * L) & (c("c_4l_20") >= 5) & (c("runs_4l") >= 2),
        long & (c("navi") < 0.5 * L) & (c("n_paths") >= 3) & (c("c_3l_20") >= 5) & (c("c_h_25") >= 2),
        long & (c("navi") < 3 * L) & (c("pre_navi") < L) & two & (c("c_l_30b") >= 2) & (c("runs_l") >= 1),
        long & (c("navi") < L) & two & (c("c_l_75") >= 1) & (c("c_l_40") >= 2),
        long & (c("navi") < L) & two & (c("path_second") > 8 * avg_occ) & (c("path_max") > 2 * c("path_second")) & (c("tail") > 0.3 * L),
        c("single_pe") & (c("n_paths") > 2) & (c("navi") < L) & ~c("path_agrees") & (c("path_share") < 0.6),
    ]
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule, i).otherwise(out)
    return out


def with_state(df: DataFrame) -> DataFrame:
    """Columns of STATE that are missing, at their neutral values."""
    return df.withColumns({k: F.lit(v) for k, v in STATE.items() if k not in df.columns})
