"""Reads to contigs: independent components by shared minimizers, then greedy extension inside each.

Reads that overlap by at least k + w - 1 bases, on either strand, share a canonical minimizer and so a component. A
component is assembled in one task: seeds by multiplicity, extension base by base on the votes of the reads that match the
tail, first to the right, then (as reverse complement) to the left; reads used up are taken out before the next seed.
Seeds are visited by multiplicity and k-mer, so the result doesn't depend on partitions.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flat import flat_codes, kmers, mix64, rc_kmers, slices, sliding_min, window_ok
from ..params import DEFAULT, Params
from .components import components
from .model import PAIRED
from .overlap import close_gap
from .pairs import fragments, insert_stats
from .paths import Followed, prune_tandem, tandem_decision, tandem_paths
from .votes import KernelModel, score

_TURN = str.maketrans("ACGT", "TGCA")
CONTIG = "component bigint, contig_no int, seq string, n_reads int, placements array<struct<rid: bigint, pos: int, orient: int, matchlen: int>>, votes array<int>"


def revcomp(s: str) -> str:
    return s.translate(_TURN)[::-1]


def minimizers(reads: DataFrame, k: int, w: int) -> DataFrame:
    """Distinct (rid, key): hashed canonical k-mers that are least in some window of w neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "seq", 1 << 20):
            codes, off = flat_codes(b.column("seq"))
            ok = window_ok(codes, off, k + w - 1)
            if not ok.any():
                continue
            at = np.flatnonzero(ok)
            least = sliding_min(mix64(np.minimum(kmers(codes, k), rc_kmers(codes, k))), w)[at]
            rec = np.searchsorted(off, at, side="right") - 1
            new = np.ones(at.size, bool)
            new[1:] = (least[1:] != least[:-1]) | (rec[1:] != rec[:-1])
            yield pa.RecordBatch.from_arrays([b.column("rid").take(pa.array(rec[new])), pa.array(least[new].astype(np.int64))], ["rid", "key"])

    return reads.select("rid", "seq").mapInArrow(run, "rid bigint, key bigint").distinct()


def read_components(reads: DataFrame, p: Params = DEFAULT, w: int = 16) -> DataFrame:
    """(rid, component) of reads that share a minimizer with another read; each key links to its least read, no pairs."""
    m = minimizers(reads, p.k, w)
    least = m.groupBy("key").agg(F.min("rid").alias("root"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return components(m.join(least, "key").select(F.col("rid").alias("a"), F.col("root").alias("b")), "a", "b").select(F.col("node").alias("rid"), "component")


class Assembler:
    """Greedy extension over the reads of one component."""

    def __init__(self, rids: list[int], seqs: list[str], p: Params, insert: tuple[float, float] | None = None, model: KernelModel = PAIRED) -> None:
        self.p, self.rids, self.insert, self.model = p, rids, insert, model
        self.ids = {r: i for i, r in enumerate(rids)}
        self.ends: list[int] = []
        self.seen = (0, 0, 0, 0)
        self.text = [(s, revcomp(s)) for s in seqs]
        self.live = [True] * len(rids)
        self.starts: dict[str, list[tuple[int, int]]] = defaultdict(list)  # first k-mer of each read, either strand
        self.count: Counter[str] = Counter()
        for i, two in enumerate(self.text):
            for strand, s in enumerate(two):
                if len(s) >= p.k:
                    self.starts[s[: p.k]].append((i, strand))
                    for at in range(len(s) - p.k + 1):
                        self.count[s[at : at + p.k]] += 1
        self.avg = max(1.0, sum(self.count.values()) / max(1, len(self.count)))

    def seeds(self) -> list[str]:
        """First k-mers of reads that occur more than once, are not one letter only, the most frequent first."""
        return sorted((m for m in self.starts if self.count[m] > 1 and len(set(m)) > 1), key=lambda m: (-self.count[m], m))

    def expand(self, seed: str) -> str:
        """The longest live read that starts with the seed."""
        reads = [self.text[i][s] for i, s in self.starts[seed] if self.live[i]]
        return max(reads, key=lambda s: (len(s), s), default="")

    def active_at(self, contig: str, known: set[tuple[int, int]]) -> list[list]:
        """Reads that begin within the contig and run on beyond it, with few mismatches: [read, strand, matched, mismatches, run]."""
        out, k = [], self.p.k
        reach = max((len(t[0]) for t in self.text), default=0)
        for at in range(max(0, len(contig) - reach), len(contig) - k + 1):
            out += self.admit(contig, at, known)
        return out

    def admit(self, contig: str, at: int, known: set[tuple[int, int]]) -> list[list]:
        out = []
        for i, strand in self.starts.get(contig[at : at + self.p.k], ()):
            s = self.text[i][strand]
            over = contig[at : at + len(s)]
            if not self.live[i] or (i, strand) in known:
                continue
            wrong = sum(a != b for a, b in zip(over, s))
            if wrong <= self.p.max_mismatch:
                known.add((i, strand))
                run = 0
                while run < len(over) and over[-1 - run] == s[len(over) - 1 - run]:
                    run += 1
                out.append([i, strand, len(over), wrong, run, at])
        return out

    def votes(self, active: list[list], least: int, mated: set[int] | None = None) -> Counter:
        """One vote a read for its next base; only reads that match the last `least` bases (and, if given, have a placed mate)."""
        best: dict[int, list] = {}
        for a in active:
            if a[2] < len(self.text[a[0]][a[1]]) and a[4] >= least and (mated is None or a[0] in mated):
                if a[0] not in best or best[a[0]][2] < a[2]:
                    best[a[0]] = a
        return Counter(self.text[a[0]][a[1]][a[2]] for a in best.values())

    def paths(self, active: list[list]) -> list[tuple[str, int]]:
        """Candidate paths: what the reads say beyond the tail, prefixes merged into longer ones, by support."""
        tails = sorted((self.text[a[0]][a[1]][a[2] :] for a in active if a[2] < len(self.text[a[0]][a[1]]) and a[4] >= 8), key=lambda t: (-len(t), t))
        merged: list[list] = []
        for t in tails:
            hit = next((m for m in merged if m[0].startswith(t)), None)
            if hit:
                hit[1] += 1
            else:
                merged.append([t, 1])
        return sorted(((t, n) for t, n in merged), key=lambda m: (-m[1], m[0]))

    def by_paths(self, active: list[list]) -> str | None:
        """Majority base of the candidate paths, unless too many of their columns are doubtful."""
        paths = self.paths(active)
        if not paths:
            return None
        wrong = 0
        for col in range(max(len(t) for t, _ in paths)):
            n = Counter()
            for t, c in paths:
                if col < len(t):
                    n[t[col]] += c
            top = n.most_common(2)
            total, first, second = sum(n.values()), top[0][1], top[1][1] if len(top) > 1 else 0
            wrong += (total >= 10 and first / total < self.p.incorrect_share) or (total < 10 and second > 0 and first / second < 4)
        n = Counter()
        for t, c in paths:
            n[t[0]] += c
        top = sorted(n.items(), key=lambda x: (-x[1], x[0]))
        first, second = top[0][1], top[1][1] if len(top) > 1 else 0
        if wrong > 3 or (first and second / first > 0.7 and wrong > 1 and sum(n.values()) > 10) or (first / sum(n.values()) < 0.6 and wrong > 2) or first == second:
            return None
        return top[0][0]

    def tandem(self, active: list[list], contig: str, placed: dict[int, tuple[int, int, int]]) -> str | None:
        """Next base by whole reads that lie alike on the tail, pruned by the fragments of their mates and by what came before."""
        reads = []
        for i, strand, done, _, run, at in (a[:6] for a in active):
            if run >= 8:
                mate = placed.get(self.ids.get(self.rids[i] + (1 if self.rids[i] % 2 else -1), -1))
                reads.append((self.text[i][strand], done, float(at + len(self.text[i][strand]) - mate[0]) if mate else None))
        found = tandem_paths(reads)
        if self.insert:
            found = prune_tandem(found, contig, *self.insert)
        base, ok = tandem_decision(found)
        return base if ok else None

    def density(self, contig: str) -> float:
        """Reads that ended in the last read length against the mean of the contig."""
        near = sum(at > len(contig) - self.p.read_len for at in self.ends)
        return near * len(contig) / (len(self.ends) * min(self.p.read_len, len(contig))) if self.ends else 1.0

    def next_base(self, active: list[list], mated: set[int], contig: str, placed: dict[int, tuple[int, int, int]], bare: int, ahead: Followed) -> str | None:
        """Mate votes and their scorer first, then candidate, tandem and followed paths; else single-end votes at falling overlap,
        where near ties go the same way. What was counted is kept in `seen`."""

        def by_ways() -> str | None:
            return self.by_paths(active) or self.tandem(active, contig, placed) or ahead.decide(bool(mated))

        pe = sorted(self.votes(active, 8, mated).items(), key=lambda x: (-x[1], x[0])) if mated else []
        first, second = pe[0][1] if pe else 0, pe[1][1] if len(pe) > 1 else 0
        self.seen = (first, second, 0, 0)
        if first >= 2:
            if not second or first >= 3 * second:
                return pe[0][0]
            weak = second >= 0.25 * first and first < 0.3 * self.avg
            if not weak and score((first, second, self.density(contig), bare), self.model) < 0:
                return pe[0][0]
            got = by_ways()
            if got:
                return got
        k, long = self.p.k, int(0.8 * self.p.read_len)
        step = max(1, (long - k) // 5)
        for size in [*range(long, k, -step), k, 8]:
            n = sorted(self.votes(active, size).items(), key=lambda x: (-x[1], x[0]))
            if not n:
                continue
            first, second = n[0][1], n[1][1] if len(n) > 1 else 0
            if first >= 2 or size <= k:
                self.seen = (*self.seen[:2], first, second)
                if second and (first - second < 2 or second > 3 * self.avg or second / first >= 0.6):
                    return by_ways()
                return n[0][0]
        return by_ways() if active else None

    def stopped(self, evidence: list[tuple[int, int, int, int]], length: int, paired: bool) -> int | None:
        """The first of the guard rules over votes alone (1 to 4 of active.stop_rule) that forbids going on."""
        if len(evidence) >= 30 and all(e[0] == 0 and e[2] == 1 for e in evidence[-30:]):
            return 1
        if not (paired and self.insert):
            return None
        reach = int(self.insert[0])
        last = evidence[-50:]
        if length > 5 * reach and len(last) == 50 and not any(e[0] for e in last):
            clear = sum((e[2] >= 3 and e[3] > 0.2 * e[2]) or e[3] > 0.3 * e[2] for e in last)
            if sum(e[2] for e in last) > 4 * 50 or clear:
                return 2
        if length > reach + 3 * int(self.insert[1]) and len(evidence) >= 65 and not any(e[0] for e in evidence[-65:]):
            return 3
        if length > 2 * reach and sum(e[0] > 0 and e[1] >= 0.6 * e[0] for e in evidence[-self.p.read_len :]) >= 3:
            return 4
        return None

    def extend(self, contig: str, placed: dict[int, tuple[int, int, int]], most: int | None = None, evidence: list[tuple[int, int, int, int]] | None = None) -> str:
        """The contig with what the reads put behind it; votes (first and second with mates, first and second of all) of each new base go to `evidence`."""
        known: set[tuple[int, int]] = set()
        active = self.active_at(contig, known)
        mated: set[int] = set()
        bare = 0
        evidence = [] if evidence is None else evidence
        self.ends = []

        def settle() -> None:
            nonlocal active, bare
            keep = []
            for a in active:
                n = len(self.text[a[0]][a[1]])
                if a[2] >= n:
                    if a[3] <= self.p.max_mismatch and (n - a[3]) / n >= 0.9 and a[0] not in placed:
                        placed[a[0]] = (a[5], a[1], n)
                        self.ends.append(a[5] + n)
                        bare = 0
                        partner = self.ids.get(self.rids[a[0]] + (1 if self.rids[a[0]] % 2 else -1))
                        if partner is not None:
                            mated.add(partner)
                elif a[3] <= self.p.max_mismatch:
                    keep.append(a)
            active = keep

        settle()
        used: set[str] = set()
        ahead = Followed(interval=max(1, int(0.4 * self.p.read_len)))
        while True:
            tail = contig[-self.p.read_len :]
            if tail in used:  # the tail came before: a repeat that leads back to itself
                return contig
            used.add(tail)
            if ahead.due():
                ahead = ahead.refresh([(self.rids[a[0]], self.text[a[0]][a[1]][a[2] :], a[2]) for a in active if a[4] >= 8], self.p.read_len)
            base = self.next_base(active, mated, contig, placed, bare, ahead)
            if base is None or self.stopped(evidence, len(contig), bool(mated)) is not None:
                return contig
            contig += base
            evidence.append(self.seen)
            ahead = ahead.step(base)
            bare += 1
            for a in active:
                hit = self.text[a[0]][a[1]][a[2]] == base
                a[2] += 1
                a[3] += not hit
                a[4] = a[4] + 1 if hit else 0
            active += self.admit(contig, len(contig) - self.p.k, known)
            settle()
            if bare > self.p.read_len - 7 or (most is not None and len(contig) >= most):
                return contig

    def build(self, least_len: int) -> list[tuple[str, list[tuple[int, int, int, int]], list[int]]]:
        """(contig, placements, votes of all reads for each base; 0 in the read it started from)."""
        out = []
        for seed in self.seeds():
            first = self.expand(seed)
            if not first:
                continue
            placed: dict[int, tuple[int, int, int]] = {}
            ahead: list[tuple[int, int, int, int]] = []
            contig = self.extend(first, placed, evidence=ahead)
            cut = max((at + n for at, _, n in placed.values()), default=len(first))
            contig = contig[: max(cut, len(first))]
            right = len(contig)
            back: dict[int, tuple[int, int, int]] = {}
            behind: list[tuple[int, int, int, int]] = []
            turned = self.extend(revcomp(contig), back, evidence=behind)
            cut = max((at + n for at, _, n in back.values()), default=len(contig))
            contig = revcomp(turned[: max(cut, len(contig))])
            n = len(contig)
            grown = n - right  # bases put before what the first round had
            reads = {i: (n - at - m, 1 - s, m) for i, (at, s, m) in back.items()}
            for i, (at, s, m) in placed.items():
                reads.setdefault(i, (at + grown, s, m))
            for i in reads:
                self.live[i] = False
            for i, s in self.starts[seed]:
                if self.text[i][s] == first:
                    self.live[i] = False
            if n >= least_len:
                heights = [max(e[0], e[2]) for e in behind][:grown][::-1] + [0] * len(first) + [max(e[0], e[2]) for e in ahead][: right - len(first)]
                out.append((contig, sorted((self.rids[i], at + 1, s, m) for i, (at, s, m) in reads.items()), heights))
        return out


def assemble(reads: DataFrame, p: Params = DEFAULT, least_len: int | None = None, insert: tuple[float, float] | None = None) -> DataFrame:
    """Contigs (component, contig_no, seq, n_reads, placements) from valid reads (rid, seq of A, C, G, T).

    Contigs of at least least_len bases (default: one base more than a read). A component is one task's work; reads without
    any overlap of k + 15 bases form none. Empty input gives no rows."""
    least = p.read_len + 1 if least_len is None else least_len
    x = reads.select("rid", "seq").join(read_components(reads, p), "rid")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid")
        made = Assembler(pdf["rid"].tolist(), pdf["seq"].tolist(), p, insert).build(least)
        comp = int(pdf["component"].iloc[0])
        return pd.DataFrame([(comp, i + 1, s, len(pl), [dict(zip(("rid", "pos", "orient", "matchlen"), t)) for t in pl], ev) for i, (s, pl, ev) in enumerate(made)], columns=["component", "contig_no", "seq", "n_reads", "placements", "votes"])

    return x.groupBy("component").applyInPandas(run, CONTIG)


def pilot_insert(reads: DataFrame, p: Params = DEFAULT, most_contigs: int = 100) -> DataFrame:
    """Insert size from a pilot assembly: the `most_contigs` components with the most reads are assembled, and pairs placed on
    one contig are measured. One row, as insert_stats. The limit is the point of a pilot; the real assembly has none."""
    comp = read_components(reads, p)
    top = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(most_contigs).select("component")
    chosen = reads.join(comp.join(F.broadcast(top), "component").select("rid"), "rid")  # top: at most most_contigs rows
    made = assemble(chosen, p).withColumn("contig_id", F.xxhash64("component", "contig_no"))
    x = made.select("contig_id", F.explode("placements").alias("p"))
    placed = x.select("contig_id", F.col("p.pos").alias("contig_pos"), F.col("p.matchlen").alias("matchlen"), F.col("p.rid").alias("rid"), F.col("p.matchlen").alias("seqlen"), F.col("p.orient").alias("orientation"), F.lit(-1).alias("contig_end"))
    return insert_stats(fragments(placed), p)


def fill_gaps(gaps: DataFrame, p: Params = DEFAULT, sdev: float = 0.0, insert: float | None = None) -> DataFrame:
    """Gaps (gap_id, left_end, right_end, gap, reads array<struct<rid, seq>>) closed by local assembly, from the left end and from
    the right one, each up to the other end and a read beyond.

    Returns gap_id, state (merged, gap or break), fill (bases between the two ends, or behind what is dropped), drop (letters of the left end given
    up), overlap (letters of the right end that the fill has already), n_left and n_right (bases won on either side) and rest (the
    gap that is left). A gap is closed where the right end's first k letters (or the left end's last ones) are met, else where the two
    extended ends overlap (overlap.close_gap). What was won on both sides of an open gap stays. Gaps are independent: one row each;
    a gap's reads are those of its two ends."""

    def one(ends: tuple[str, str], gap: float, reads: list) -> tuple[str, str]:
        """(left end and what follows, what precedes and right end), each extended."""
        out = []
        for left, right in (ends, (revcomp(ends[1]), revcomp(ends[0]))):
            a = Assembler([r["rid"] for r in reads], [r["seq"] for r in reads], p, (insert, sdev) if insert else None)
            most = len(left) + max(0, int(gap)) + int(3 * sdev) + len(right) + p.read_len
            out.append(a.extend(left, {}, most) if left and reads else left)
        return out[0], revcomp(out[1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g in pdf.itertuples(index=False):
                reads = list(g.reads) if g.reads is not None else []
                left, right = g.left_end or "", g.right_end or ""
                made, back = one((left, right), 0.0 if g.gap is None or g.gap != g.gap else g.gap, reads)
                met = made.find(right[: p.k], max(0, len(left) - p.k)) if len(right) >= p.k else -1
                if met >= 0 and right.startswith(made[met:]) | made[met:].startswith(right):
                    out.append((g.gap_id, made, right, met, None))
                    continue
                met = back.rfind(left[-p.k :], 0, len(back) - len(right) + p.k) if len(left) >= p.k else -1
                if met >= 0:
                    out.append((g.gap_id, left, back[met:], len(left) - p.k, None))
                    continue
                out.append((g.gap_id, made, back, -1, back))
            yield pd.DataFrame(out, columns=["gap_id", "made", "back", "met", "open"])

    got = gaps.select("gap_id", "left_end", "right_end", "gap", "reads").mapInPandas(run, "gap_id bigint, made string, back string, met int, open string")
    got = gaps.select("gap_id", "left_end", "right_end", "gap").join(got, "gap_id")
    n1, n2, nl, nr = F.length("made"), F.length("back"), F.length(F.coalesce("left_end", F.lit(""))), F.length(F.coalesce("right_end", F.lit("")))
    closed = F.col("met") >= 0
    gap = F.coalesce(F.when(~F.isnan("gap"), F.col("gap")), F.lit(0.0))
    got = got.withColumn("c", close_gap(gap, F.col("made"), F.col("back"), n1 - nl, n2 - nr, 2 * p.read_len, sdev, p))
    state = F.when(closed, "merged").otherwise(F.col("c.state"))
    # the joined text: left end and fill and right end
    whole = F.when(closed, F.concat(F.expr("left(made, met)"), F.col("back"))).when(F.col("c.state") == "merged", F.concat(F.col("made"), F.expr("substring(back, c.overlap + 1)")))
    got = got.withColumns({"state": state, "whole": whole, "n_left": n1 - nl, "n_right": n2 - nr})
    size = F.length("whole")
    over = F.when(size - nl < nr, nr - (size - nl)).otherwise(0)  # the ends themselves overlap by so much
    fill = F.when(F.col("whole").isNotNull(), F.expr("substring(whole, length(left_end) + 1, greatest(length(whole) - length(left_end) - length(right_end), 0))"))
    return got.select("gap_id", "state", fill.alias("fill"), F.lit(0).alias("drop"), F.when(F.col("whole").isNotNull(), over).otherwise(0).cast("int").alias("overlap"), "n_left", "n_right", F.when(F.col("whole").isNull(), F.col("c.gap")).alias("rest"), F.expr("substring(made, length(left_end) + 1)").alias("won_left"), F.expr("left(back, length(back) - length(right_end))").alias("won_right"))
