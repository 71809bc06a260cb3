"""Votes of placed reads for bases: pile-ups, winners, consensus columns, the decision cascades and kernel scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bases import hamming, revcomp
from ..functions.flat import flat_codes, ranges, slices

BASES = "ACGT"
_BIN = 128


def oriented(placements: DataFrame, reads: DataFrame) -> DataFrame:
    """Placed reads with their bases in the direction of the contig."""
    seq = F.when(F.col("orientation") == 1, revcomp(F.upper("seq"))).otherwise(F.upper("seq"))
    return placements.join(reads.select("rid", "seq"), "rid").withColumn("oseq", seq).drop("seq")


def pile_up(placed_seqs: DataFrame) -> DataFrame:
    """(contig_id, pos, base, n): reads that show each base at each contig position. One row a base before the shuffle is
    summed map-side, so a deep column costs no more than a shallow one."""
    x = placed_seqs.select("contig_id", "contig_pos", F.posexplode(F.split("oseq", "")).alias("i", "base"))
    return x.groupBy("contig_id", (F.col("contig_pos") + F.col("i")).alias("pos"), "base").agg(F.count(F.lit(1)).alias("n"))


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes of a block of reads, summed a column."""
    for b in slices(batches, "oseq", 1 << 20):
        codes, off = flat_codes(b.column("oseq"))
        n = np.diff(off)
        contig, at = np.repeat(b.column("contig_id").to_numpy(), n), ranges(b.column("contig_pos").to_numpy(), n)
        key, inv = np.unique((contig << 32) | at, return_inverse=True)
        count = np.bincount(inv.reshape(-1) * 5 + codes, minlength=5 * key.size).reshape(-1, 5)
        yield pa.RecordBatch.from_arrays([pa.array(key >> 32), pa.array((key & 0xFFFFFFFF).astype(np.int32)), *(pa.array(np.ascontiguousarray(count[:, i])) for i in range(4))], ["contig_id", "pos", *(f"n_{x}" for x in BASES)])


def next_base_votes(placed_seqs: DataFrame, mated: DataFrame | None = None, one_row_a_read: bool = False) -> DataFrame:
    """Votes for A, C, G, T at each position; each read votes once. `mated` (rid): only these reads vote (paired-end votes).

    The four counters of a block of reads are summed a column before they are sent. one_row_a_read: placements are unique already."""
    x = placed_seqs
    if not one_row_a_read:
        rest = [c for c in x.columns if c not in ("contig_id", "rid")]
        first = F.min(F.struct("contig_pos", "orientation", *[c for c in rest if c not in ("contig_pos", "orientation")])).alias("p")
        x = x.groupBy("contig_id", "rid").agg(first).select("contig_id", "rid", "p.*")
    if mated is not None:
        x = x.join(mated.select("rid").distinct(), "rid", "left_semi")
    x = x.select(F.col("contig_id").cast("bigint").alias("contig_id"), F.col("contig_pos").cast("int").alias("contig_pos"), "oseq")
    x = x.mapInArrow(_columns, "contig_id bigint, pos int, " + ", ".join(f"n_{b} bigint" for b in BASES))
    return x.groupBy("contig_id", "pos").agg(*[F.sum(f"n_{b}").alias(f"n_{b}") for b in BASES])


def winners(votes: DataFrame) -> DataFrame:
    """First and second base of each column (ties to the first letter) with their votes and the total."""
    order = F.array_sort(F.array(*[F.struct((-F.col(f"n_{b}")).alias("neg"), F.lit(b).alias("base")) for b in BASES]))
    x = votes.withColumn("r", order).withColumn("total", sum((F.col(f"n_{b}") for b in BASES), F.lit(0)))
    return x.select("contig_id", "pos", F.col("r")[0]["base"].alias("base"), (-F.col("r")[0]["neg"]).alias("n_max"), F.col("r")[1]["base"].alias("second"), (-F.col("r")[1]["neg"]).alias("n_second"), "total")


def incorrect(n_max: Column, n_second: Column, total: Column, share: float = 0.9) -> Column:
    """Whether a consensus column is doubtful: with 10 votes or more by the winner's share, else by the second's."""
    return ((total >= 10) & (n_max / total < share)) | ((total < 10) & (n_second > 0) & (n_max / n_second < 4))


def incorrect_columns(w: DataFrame) -> DataFrame:
    return w.groupBy("contig_id").agg(F.count(F.lit(1)).alias("n_columns"), F.sum(incorrect(F.col("n_max"), F.col("n_second"), F.col("total")).cast("int")).alias("n_incorrect"))


def corrected(placed_seqs: DataFrame, w: DataFrame, least_votes: int = 10) -> DataFrame:
    """Bases of reads in columns of least_votes votes or more where the read's base is the second one with a single vote: the winner
    stands instead. (rid, contig_id, pos, base, corrected). The few odd columns meet reads by bins of positions; no base of
    a read that lies on none is a row."""
    odd = w.where(F.col("total") >= least_votes).where("n_second = 1").select("contig_id", "pos", "base", "second", F.floor(F.col("pos") / _BIN).alias("bin"))
    last = F.col("contig_pos") + F.length("oseq") - 1
    x = placed_seqs.where(F.length("oseq") > 0).select("rid", "contig_id", "contig_pos", "oseq", F.explode(F.sequence(F.floor(F.col("contig_pos") / _BIN), F.floor(last / _BIN))).alias("bin"))
    x = x.join(odd, ["contig_id", "bin"]).where((F.col("pos") >= F.col("contig_pos")) & (F.col("pos") <= last))
    x = x.withColumn("b", F.substring(F.col("oseq"), (F.col("pos") - F.col("contig_pos") + 1).cast("int"), F.lit(1)))
    return x.where("b = second").select("rid", "contig_id", "pos", F.col("b").alias("base"), F.col("base").alias("corrected"))


def shift_distance(a: Column, b: Column, most_shift: int = 10, most_mismatch: int = 1) -> Column:
    """Struct of shift, kind and mismatches of the first shift 0..most_shift of `a` (kind 1) that leaves at most most_mismatch
    differing letters, else of the first one of `b` (kind 2); null if there is none, or nothing is left to compare."""
    out = F.lit(None).cast("struct<shift: int, kind: int, mismatches: int>")
    for kind, s in reversed([(k, s) for k in (1, 2) for s in range(most_shift + 1)]):
        x, y = (F.substring(a, F.lit(s + 1), F.length(a)), b) if kind == 1 else (a, F.substring(b, F.lit(s + 1), F.length(b)))
        wrong = hamming(x, y)
        hit = (F.length(x) > 0) & (F.length(y) > 0) & (wrong <= most_mismatch)
        out = F.when(hit, F.struct(F.lit(s).alias("shift"), F.lit(kind).alias("kind"), wrong.cast("int").alias("mismatches"))).otherwise(out)
    return out


# --- kernel scorer ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class KernelModel:
    """Support vectors, their weights, bias and a shift and factor per feature. Read from a table or fitted; never built in."""

    vectors: tuple[tuple[float, ...], ...]
    alpha: tuple[float, ...]
    bias: float
    shift: tuple[float, ...] = ()
    factor: tuple[float, ...] = ()

    @staticmethod
    def from_rows(df: DataFrame, bias: float, shift: tuple[float, ...] = (), factor: tuple[float, ...] = (), most: int = 10_000) -> KernelModel:
        """Rows (alpha double, features array<double>); a model has at most `most` vectors."""
        rows = df.select("alpha", "features").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} support vectors")
        return KernelModel(tuple(tuple(r[1]) for r in rows), tuple(r[0] for r in rows), bias, shift, factor)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def kernel(x: Column, y: Column, kind: str = "polynomial") -> Column:
    """linear <x,y>; rbf exp(-d2/2); polynomial d (1+d)^2 with d = <x,y>."""
    d = dot(x, y)
    if kind == "linear":
        return d
    if kind == "rbf":
        diff = F.zip_with(x, y, lambda a, b: a - b)
        return F.exp(dot(diff, diff) * -0.5)
    if kind == "polynomial":
        return d * (1 + d) * (1 + d)
    raise ValueError(kind)


def decision_score(features: Column, model: KernelModel, kind: str = "polynomial") -> Column:
    """sum of alpha x kernel + bias over scaled features; a score below 0 means: extend."""
    x = features
    if model.shift:
        scale = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(f).alias("f")) for s, f in zip(model.shift, model.factor)])
        x = F.zip_with(features, scale, lambda v, c: c["f"] * (v + c["s"]))
    out = F.lit(model.bias)
    for a, v in zip(model.alpha, model.vectors):
        out = out + kernel(F.array(*[F.lit(t) for t in v]), x, kind) * a
    return out


def score(features: tuple[float, ...], model: KernelModel) -> float:
    """decision_score with the polynomial kernel for one row of features."""
    x = np.asarray(features, float)
    if model.shift:
        x = (x + np.asarray(model.shift)) * np.asarray(model.factor)
    d = np.asarray(model.vectors) @ x
    return float(model.bias + np.asarray(model.alpha) @ (d * (1 + d) ** 2))


def fit_kernel(rows: list[tuple[list[float], int]], kind: str = "polynomial", rounds: int = 20, most: int = 2000) -> KernelModel:
    """Kernel perceptron on at most `most` labelled rows (features, label -1 extend / +1 stop), features scaled to 0..1."""
    import numpy as np

    x = np.array([r[0] for r in rows[:most]], float)
    y = np.array([r[1] for r in rows[:most]], float)
    lo, hi = x.min(axis=0), x.max(axis=0)
    shift, factor = -lo, 1 / np.where(hi > lo, hi - lo, 1)
    z = (x + shift) * factor
    d = z @ z.T
    k = d if kind == "linear" else d * (1 + d) ** 2 if kind == "polynomial" else np.exp(-0.5 * ((z[:, None] - z[None]) ** 2).sum(-1))
    alpha, bias = np.zeros(len(y)), 0.0
    for _ in range(rounds):
        wrong = 0
        for i in range(len(y)):
            if y[i] * (alpha @ k[i] + bias) <= 0:
                alpha[i] += y[i]
                bias += y[i]
                wrong += 1
        if not wrong:
            break
    keep = np.flatnonzero(alpha)
    return KernelModel(tuple(map(tuple, z[keep].tolist())), tuple(alpha[keep].tolist()), float(bias), tuple(shift.tolist()), tuple(factor.tolist()))


# --- decision cascades over precomputed columns ----------------------------------------------------------------------


def single_end_gate(read_len: int, avg_occ: float) -> Column:
    """Columns navi, tail, ratio, length, n_paths, path_max, path_second, n_max, n_second, score -> whether to extend.

    Order: long uncovered tail or thin density without a followed path fails; an early fork without a clear path fails; with a
    second base the scorer decides, then a narrow lead or a strong second fails."""
    c = F.col
    thin = (c("navi") < 2 * read_len) & ((c("tail") > 0.3 * read_len) | (c("ratio") < 0.3 * 0.1))
    fork = (c("length") < 0.8 * read_len) & (c("n_paths") >= 2) & (c("path_max") < 3 * c("path_second"))
    lead = (c("n_max") - c("n_second") < 2) | (c("n_second") > avg_occ) | ((c("n_second") >= 0.5 * avg_occ) & (c("n_second") / c("n_max") >= 0.6))
    return F.when(thin, False).when(fork, False).when((c("n_second") > 0) & (c("score") >= 0), False).when((c("n_second") > 0) & lead, False).when(c("n_max") == 0, False).otherwise(True)


def path_decision(share_second: float = 0.7) -> Column:
    """Candidate paths: fail with more than 3 incorrect columns, or near ties with more than one, or a winner below 0.6 with more than two."""
    c = F.col
    bad = (c("n_second") / c("n_max") > share_second) & (c("n_incorrect") > 1) & (c("total") > 10)
    weak = (c("n_max") / c("total") < 0.6) & (c("n_incorrect") > 2)
    return F.when(c("n_incorrect") > 3, False).when(c("n_max") == 0, False).when(bad | weak, False).otherwise(True)


def tandem_decision() -> Column:
    """Tandem paths: one path succeeds; else as candidate paths with limits 0.8 (incorrect > 1, sum > 10) and 0.7 (incorrect > 2)."""
    c = F.col
    r = c("n_second") / c("n_max")
    return F.when(c("n_paths") == 1, True).when(c("n_incorrect") > 3, False).when((r > 0.8) & (c("n_incorrect") > 1) & (c("total") > 10), False).when((r > 0.7) & (c("n_incorrect") > 2), False).otherwise(True)


def paired_gate(avg_occ: float) -> Column:
    """Mate votes: thin density with a fork stops; a long tail with few votes fails; with a second base the scorer decides,
    a threefold lead wins and a strong second with few votes fails."""
    c = F.col
    r = c("n_second") / c("n_max")
    fork = (c("ratio") < 0.3 * 0.1) & (c("n_paths") >= 2)
    tail = (c("n_paths") >= 2) & (c("tail") > 50) & (c("ratio") < 0.4) & (c("n_max") <= 5)
    scored = F.when(c("n_max") / c("n_second") >= 3, True).when((r >= 0.25) & (c("n_max") < 0.3 * avg_occ), False).otherwise(c("score") < 0)
    return F.when(fork | tail | (c("n_max") == 0), False).when(c("n_second") > 0, scored).otherwise(True)
