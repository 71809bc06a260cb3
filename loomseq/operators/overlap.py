"""Overlaps of neighbouring contigs: exact, by alignment with consensus, and the decision between merge, gap and break."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bases import revcomp
from ..params import DEFAULT, Params


def orient(seq: Column, minus: Column) -> Column:
    return F.when(minus, revcomp(seq)).otherwise(seq)


def _closest(left: str | None, right: str | None, gap: float | None, longest: int, least: int) -> int:
    if left is None or right is None:
        return 0
    n = min(longest, len(left), len(right))
    hits = (i for i in range(n, least - 1, -1) if right.startswith(left[-i:]))
    return min(hits, key=lambda i: (abs(i + (gap or 0.0)), -i), default=0)


def exact_overlap(left: Column, right: Column, gap: Column, longest: int, least: int = 2) -> Column:
    """Length n of the suffix of `left` equal to the prefix of `right` that is closest to -gap; longer ones first on ties; 0 if none.

    Only the last and first `longest` letters go to the function."""

    @F.arrow_udf("int")
    def find(a: pa.Array, b: pa.Array, g: pa.Array) -> pa.Array:
        return pa.array([_closest(x, y, z, longest, least) for x, y, z in zip(a.to_pylist(), b.to_pylist(), g.to_pylist())], pa.int32())

    n = F.lit(longest)
    return find(F.substring(left, F.greatest(F.length(left) - longest + 1, F.lit(1)), n), F.substring(right, F.lit(1), n), gap.cast("double"))


def _align(a: str, b: str, p: Params) -> tuple[int, str, int, int]:
    """Overlap of a suffix of `a` with a prefix of `b` by dynamic programming, one anti-dependent row at a time.

    Free start in `a`, the overlap ends with the end of `a`. Returns length on `b`, consensus, mismatches and length on `a`;
    length 0 when the path does not start at the beginning of `b`."""
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    n, m = x.size, y.size
    if not n or not m:
        return 0, "", 0, 0
    score = np.zeros((n + 1, m + 1), np.int32)
    cols = np.arange(m + 1, dtype=np.int32) * p.gap
    for i in range(1, n + 1):
        best = np.empty(m + 1, np.int32)
        best[0] = 0
        best[1:] = np.maximum(score[i - 1, :-1] + np.where(y == x[i - 1], p.match, p.mismatch), score[i - 1, 1:] + p.gap)
        score[i] = np.maximum.accumulate(best - cols) + cols  # gaps along the row
    j = int(np.argmax(score[n]))
    end, i, out, wrong = j, n, [], 0
    if score[n, j] <= 0:
        return 0, "", 0, 0
    while i > 0 and j > 0:
        same = x[i - 1] == y[j - 1]
        if score[i, j] == score[i - 1, j - 1] + (p.match if same else p.mismatch):
            out.append((chr(x[i - 1]), chr(y[j - 1])))
            wrong += not same
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] + p.gap:
            out.append((chr(x[i - 1]), "-"))
            i, wrong = i - 1, wrong + 1
        else:
            out.append(("-", chr(y[j - 1])))
            j, wrong = j - 1, wrong + 1
    if j > 0:
        return 0, "", 0, 0
    out.reverse()
    third = len(out) // 3
    middle = out[third : len(out) - third]
    if any(s != t for s, t in middle):
        return 0, "", wrong, 0
    text = "".join(s for s, _ in out[: len(out) - third]) + "".join(t for _, t in out[len(out) - third :])
    return end, text.replace("-", ""), wrong, n - i


@F.pandas_udf(T.StructType([T.StructField("overlap", T.IntegerType()), T.StructField("consensus", T.StringType()), T.StructField("mismatches", T.IntegerType()), T.StructField("on_left", T.IntegerType())]))
def dovetail(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Alignment of the end of `left` with the start of `right` (pass in no more than two read lengths of each)."""
    rows = [_align(a or "", b or "", DEFAULT) for a, b in zip(left, right)]
    return pd.DataFrame(rows, columns=["overlap", "consensus", "mismatches", "on_left"])


def decide(gap: Column, n_pairs: Column, sdev: float, exact: Column, aligned: Column, mismatches: Column, p: Params = DEFAULT) -> Column:
    """merge, gap, cut or break of two neighbours.

    gap < -500, or < -300 with fewer than two pairs: break. gap up to one deviation: an exact overlap within reach merges,
    else an alignment with few mismatches; a short alignment cuts the ends; else they stay apart."""
    near = gap <= sdev
    ok_exact = near & (exact >= p.min_exact_overlap)
    few = (mismatches <= p.max_mismatch) | (mismatches <= aligned * 0.1)
    return (
        F.when((gap < p.max_gap_break) | ((gap < p.weak_gap_break) & (n_pairs < 2)), "break")
        .when(ok_exact, "merge")
        .when(near & (aligned >= p.min_overlap) & few, "merge")
        .when(near & (aligned >= p.min_overlap), "cut")
        .otherwise("gap")
    )


def neighbour_overlaps(chain: DataFrame, contigs: DataFrame, sdev: float, p: Params = DEFAULT, bare: DataFrame | None = None) -> DataFrame:
    """Chain rows (scaffold_id, ord, contig_id, orient, gap, n_pairs; the gap is to the row before) with their overlap to the
    row before: exact, aligned, aligned_left, consensus, cut_left, cut_right and decision. Only contig ends of two read lengths are
    looked at. With `bare` (mapping.uncovered_end) an overlap that asks for a cut, or a short gap, is tried again without the uncovered ends."""
    from pyspark.sql import Window

    reach = 2 * p.read_len
    w = Window.partitionBy("scaffold_id").orderBy("ord")
    tips = contigs.select("contig_id", F.expr(f"right(upper(seq), {reach})").alias("last"), F.expr(f"left(upper(seq), {reach})").alias("first"))
    if bare is not None:
        tips = tips.join(bare.select("contig_id", "bare5", "bare3"), "contig_id", "left")
    x, minus = chain.join(tips, "contig_id"), F.col("orient") == 1
    x = x.withColumn("right_end", F.when(minus, revcomp(F.col("last"))).otherwise(F.col("first")))
    x = x.withColumn("left_end", F.lag(F.when(minus, revcomp(F.col("first"))).otherwise(F.col("last"))).over(w))
    x = x.withColumn("exact", exact_overlap(F.col("left_end"), F.col("right_end"), F.col("gap"), reach))
    x = x.withColumn("a", dovetail("left_end", "right_end"))
    verdict = decide(F.col("gap"), F.col("n_pairs"), sdev, F.col("exact"), F.col("a.overlap"), F.col("a.mismatches"), p)
    x = x.withColumn("decision", F.when(F.col("ord") == 1, "start").otherwise(F.coalesce(verdict, F.lit("gap"))))
    exact = F.when(F.col("exact") >= p.min_exact_overlap, F.col("exact")).otherwise(0)
    if bare is None:
        x = x.withColumn("cut", F.lit(None).cast("struct<round: int, cut_left: int, cut_right: int, overlap: int>"))
    else:
        x = x.withColumn("bare_left", F.lag(F.when(minus, F.col("bare5")).otherwise(F.col("bare3"))).over(w))
        x = x.withColumn("bare_right", F.when(minus, F.col("bare3")).otherwise(F.col("bare5")))
        usable = (F.col("bare_left") + F.col("bare_right") > 0) & (F.greatest("bare_left", "bare_right") < reach)
        retry = (F.col("decision") == "cut") | ((F.col("decision") == "gap") & (F.col("gap") <= sdev))
        x = x.withColumn("cut", F.when(retry & usable, cut_retry(F.col("left_end"), F.col("right_end"), F.col("bare_left"), F.col("bare_right"), F.col("gap"), reach)))
    done = F.coalesce(F.col("cut.round"), F.lit(0)) > 0
    x = x.withColumn("exact", F.when(done, F.col("cut.overlap")).otherwise(exact)).withColumn("decision", F.when(done, "merge").otherwise(F.col("decision")))
    cuts = [F.when(done, F.col(f"cut.{c}")).otherwise(0).alias(c) for c in ("cut_left", "cut_right")]
    return x.select("scaffold_id", "ord", "contig_id", "orient", "gap", "n_pairs", "exact", F.col("a.overlap").alias("aligned"), F.col("a.on_left").alias("aligned_left"), F.col("a.consensus").alias("consensus"), *cuts, "decision")


def cut_retry(left: Column, right: Column, bare_left: Column, bare_right: Column, gap: Column, longest: int) -> Column:
    """Three rounds of cutting uncovered ends: the shorter one, the other one, both; the first exact overlap found.

    Struct of round (0: none), cut_left, cut_right, overlap."""
    short_left = bare_left <= bare_right
    zero = F.lit(0)
    cuts = [(F.when(short_left, bare_left).otherwise(zero), F.when(short_left, zero).otherwise(bare_right)), (F.when(short_left, zero).otherwise(bare_left), F.when(short_left, bare_right).otherwise(zero)), (bare_left, bare_right)]
    out = F.struct(*[zero.alias(c) for c in ("round", "cut_left", "cut_right", "overlap")])
    for i, (cl, cr) in reversed(list(enumerate(cuts, 1))):
        a = F.substring(left, F.lit(1), F.length(left) - cl)
        b = F.substring(right, cr + 1, F.length(right))
        n = exact_overlap(a, b, gap, longest)
        out = F.when(n >= 3, F.struct(F.lit(i).alias("round"), cl.cast("int").alias("cut_left"), cr.cast("int").alias("cut_right"), n.alias("overlap"))).otherwise(out)
    return out


def close_gap(gap: Column, left: Column, right: Column, n_left: Column, n_right: Column, longest: int, sdev: float = 0.0, p: Params = DEFAULT) -> Column:
    """After n_left and n_right bases were put to the two ends of a gap: the gap that is left, the exact overlap of the ends nearest
    to it, and the state: merged, break (ends that would have to overlap by far more than they do) or gap."""
    rest = gap - n_left - n_right
    n = exact_overlap(left, right, rest, longest)
    ok = (n >= p.min_overlap) & ((F.abs(n + rest) <= F.greatest(F.lit(3.0 * sdev), F.lit(0.5) * F.abs(gap), F.lit(1.0 * p.k))) | (n >= p.k))
    return F.struct(rest.alias("gap"), F.when(ok, n).otherwise(0).alias("overlap"), F.when(ok, "merged").when(rest < p.max_gap_break, "break").otherwise("gap").alias("state"))


def splice(seq: Column, new_bases: Column, at_end: Column) -> Column:
    """Filled-in bases at the end, or before the start, of a contig."""
    return F.when(at_end, F.concat(seq, new_bases)).otherwise(F.concat(new_bases, seq))
