"""Look-ahead paths: what the reads at a tail say comes next, merged, cleaned, pruned and followed.

A key (a contig tail) has at most a few hundred active reads, so each key is one small pandas group. Candidate and followed paths are not
limited; tandem paths are at most twenty, as the rule has it.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT

MOST = 20
SCHEMA = "key bigint, path_no int, n_paths int, seq string, support bigint, n_incorrect int, first_base string, n_max bigint, n_second bigint, total bigint, decision boolean"


def by_prefix(tails: list[tuple[str, int]], mismatches: int = 0, merge_equal: bool = True) -> list[tuple[str, int]]:
    """Texts whose shorter one is a prefix of the longer (up to `mismatches` differing letters) become one path: the longer text,
    added supports. Without merge_equal two paths of equal support stay apart."""
    out: list[list] = []
    for t, n in sorted(tails, key=lambda x: (-len(x[0]), -x[1], x[0])):
        hit = next((p for p in out if sum(a != b for a, b in zip(p[0], t)) <= mismatches and (merge_equal or p[1] != n)), None)
        if hit:
            hit[1] += n
        else:
            out.append([t, n])
    return sorted(((t, n) for t, n in out), key=lambda x: (-x[1], x[0]))


def columns(paths: list[tuple[str, int]]) -> list[Counter]:
    out: list[Counter] = []
    for t, n in paths:
        for i, b in enumerate(t):
            if i == len(out):
                out.append(Counter())
            out[i][b] += n
    return out


def doubtful(col: Counter, share: float = DEFAULT.incorrect_share) -> bool:
    top = col.most_common(2)
    total, first, second = sum(col.values()), top[0][1], top[1][1] if len(top) > 1 else 0
    return (first / total < share) if total >= 10 else (second > 0 and first / second < 4)


def corrected(paths: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """In a column of ten votes or more whose second base has a single vote, that base becomes the first one."""
    swap = {}
    for i, col in enumerate(columns(paths)):
        top = sorted(col.items(), key=lambda x: (-x[1], x[0]))
        if sum(col.values()) >= 10 and len(top) > 1 and top[1][1] == 1:
            swap[i, top[1][0]] = top[0][0]
    return [("".join(swap.get((i, b), b) for i, b in enumerate(t)), n) for t, n in paths]


def decide(paths: list[tuple[str, int]], most_incorrect: int = 3) -> tuple[str | None, int, bool]:
    """First base by majority, doubtful columns, and whether the paths may decide."""
    cols = columns(paths)
    if not cols:
        return None, 0, False
    wrong = sum(doubtful(c) for c in cols)
    top = sorted(cols[0].items(), key=lambda x: (-x[1], x[0]))
    total, first, second = sum(cols[0].values()), top[0][1], top[1][1] if len(top) > 1 else 0
    bad = wrong > most_incorrect or (second / first > 0.7 and wrong > 1 and total > 10) or (first / total < 0.6 and wrong > 2)
    return top[0][0], wrong, not bad


def shift_of(a: str, b: str, most: int = 10, mismatches: int = 1) -> tuple[int, int, int] | None:
    """(shift, kind, mismatches): the first shift of `a` (kind 1) that leaves at most `mismatches` differing letters, else of `b` (kind 2)."""
    for kind, s in ((k, s) for k in (1, 2) for s in range(most + 1)):
        x, y = (a[s:], b) if kind == 1 else (a, b[s:])
        wrong = sum(c != d for c, d in zip(x, y))
        if x and y and wrong <= mismatches:
            return s, kind, wrong
    return None


def candidate_paths(tails: DataFrame, key: str = "key", tail: str = "tail") -> DataFrame:
    """Candidate paths of each key from the tails of its reads: merged, singletons corrected, with the decision.

    Equal tails are counted before the groups are formed, so a deep tail sends no more rows than it has different texts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        paths = by_prefix(corrected(list(zip(pdf["tail"], pdf["n"].astype(int)))))
        base, wrong, ok = decide(paths)
        votes = sorted(columns(paths)[0].values(), reverse=True)
        rest = (wrong, base, votes[0], votes[1] if len(votes) > 1 else 0, sum(votes), ok)
        return pd.DataFrame([(int(pdf["key"].iloc[0]), i + 1, len(paths), t, n, *rest) for i, (t, n) in enumerate(paths)], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    per = tails.where(F.length(tail) > 0).groupBy(F.col(key).cast("bigint").alias("key"), F.col(tail).alias("tail")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("key").applyInPandas(run, SCHEMA)


@dataclass(frozen=True)
class Path:
    """A path that is kept from base to base."""

    seq: str
    support: int
    max_overlap: int = 0
    rids: frozenset[int] = frozenset()


@dataclass(frozen=True)
class Followed:
    """Paths ahead of a contig, and how long the chosen one has been right."""

    paths: tuple[Path, ...] = ()
    chosen: str = ""
    navi: int = 0
    pre_navi: int = 0
    steps: int = 0
    interval: int = field(default=int(0.4 * DEFAULT.read_len))

    def step(self, base: str) -> Followed:
        """One base is appended: paths that said so move on, the others go; the run of right guesses grows or ends."""
        kept = tuple(replace(p, seq=p.seq[1:]) for p in self.paths if p.seq[:1] == base and len(p.seq) > 1)
        right = self.chosen[:1] == base
        navi, pre = (self.navi + 1, self.pre_navi) if right else (0, self.navi or self.pre_navi)
        return replace(self, paths=kept, chosen=self.chosen[1:] if right else "", navi=navi, pre_navi=pre, steps=self.steps + 1)

    def due(self) -> bool:
        return self.steps % self.interval == 0 or not self.chosen

    def refresh(self, reads: list[tuple[int, str, int]], read_len: int) -> Followed:
        """Paths anew from active reads (rid, tail, overlap with the contig): merged, corrected, pruned, ordered, one chosen."""
        groups: list[list] = [[p.seq, set(p.rids), p.max_overlap] for p in self.paths]
        for rid, tail, over in sorted(reads, key=lambda x: (-len(x[1]), x[1], x[0])):
            if not tail:
                continue
            hit = next((g for g in groups if g[0].startswith(tail) or tail.startswith(g[0])), None)
            if hit:
                hit[0] = max(hit[0], tail, key=len)
                hit[1].add(rid)
                hit[2] = max(hit[2], over)
            else:
                groups.append([tail, {rid}, over])
        live = {r for r, _, _ in reads}
        paths = [Path(t, len(ids & live), over, frozenset(ids & live)) for t, ids, over in groups]
        return replace(self, paths=prune(paths, read_len)).choose()

    def choose(self) -> Followed:
        best = max(self.paths, key=lambda p: (p.support, p.seq), default=None)
        keep = next((p for p in self.paths if self.chosen and p.seq.startswith(self.chosen)), None)
        return replace(self, chosen=keep.seq if keep else best.seq if best else "")

    def decide(self, paired: bool) -> str | None:
        """The chosen path decides after 200 right bases, if the second is weak enough (0.8 with mates, 0.3 without); after 2,000 always."""
        if not self.chosen or self.navi < 200:
            return None
        top = sorted((p.support for p in self.paths), reverse=True)
        ratio = top[1] / top[0] if len(top) > 1 and top[0] else 0.0
        return self.chosen[0] if self.navi >= 2000 or ratio <= (0.8 if paired else 0.3) else None


def prune(paths: list[Path], read_len: int, overlap_share: float = 0.5) -> tuple[Path, ...]:
    """Paths without text, of one read beside better ones, of short overlap, or that only repeat the start of a better one, go."""
    paths = sorted((p for p in paths if p.seq and p.support > 0), key=lambda p: (-p.support, p.seq))
    if any(p.support > 1 for p in paths):
        paths = [p for p in paths if p.support > 1]
    if any(p.max_overlap >= overlap_share * read_len for p in paths):
        paths = [p for p in paths if p.max_overlap >= overlap_share * read_len]
    out: list[Path] = []
    for p in paths:
        if not any(q.seq.startswith(p.seq) for q in out):
            out.append(p)
    return tuple(out)


@dataclass(frozen=True)
class Tandem:
    """Whole reads that lie alike on the tail: their joint text, its place before the tail's end, fragments of their mates."""

    seq: str
    over: int
    support: int
    frag: float | None = None


def tandem_paths(reads: list[tuple[str, int, float | None]]) -> list[Tandem]:
    """Cluster active reads (text, bases that lie on the contig, fragment size) by compatible text at the same place."""
    out: list[dict] = []
    for t, over, frag in sorted(reads, key=lambda x: (-len(x[0]), x[0], x[1])):
        hit = next((g for g in out if _fits(g, t, over)), None)
        if hit:
            hit["n"] += 1
            if frag is not None:
                hit["frags"].append(frag)
        elif len(out) < MOST:
            out.append({"t": t, "over": over, "n": 1, "frags": [] if frag is None else [frag]})
    return sorted((Tandem(g["t"], g["over"], g["n"], sum(g["frags"]) / len(g["frags"]) if g["frags"] else None) for g in out), key=lambda x: (-x.support, x.seq))


def _fits(g: dict, t: str, over: int, mismatches: int = 1) -> bool:
    d = g["over"] - over
    a, b = (g["t"][d:], t) if d >= 0 else (g["t"], t[-d:])
    return bool(a and b) and sum(x != y for x, y in zip(a, b)) <= mismatches


def prune_tandem(paths: list[Tandem], contig: str, mean: float, sdev: float, overlap: int = 10) -> list[Tandem]:
    """Drop paths whose mates are too near or far and that disagree with the tail, that came before within two inserts, or that
    overlap a better path with at most one mismatch."""
    kept: list[Tandem] = []
    best = max((p.support for p in paths), default=0)
    for p in paths:
        off = p.frag is not None and (abs(p.frag - mean) > 2 * sdev or abs(p.frag - mean) > 0.1 * mean)
        tail = contig[len(contig) - p.over :] if p.over else ""
        wrong = sum(a != b for a, b in zip(p.seq, tail))
        if (off and wrong > 1) or wrong >= 2 or (off and p.support < 0.5 * best and abs(p.frag - mean) > 0.2 * mean):
            continue
        ahead = p.seq[p.over :]
        before = contig[-int(2 * mean) :]
        if len(ahead) >= overlap and any(sum(a != b for a, b in zip(before[i:], ahead)) <= 3 for i in range(len(before) - len(ahead) + 1)):
            continue
        if any(len(q.seq[q.over :]) >= overlap and sum(a != b for a, b in zip(q.seq[q.over :], ahead)) <= 1 for q in kept):
            continue
        kept.append(p)
    return kept


def tandem_decision(paths: list[Tandem]) -> tuple[str | None, bool]:
    """One path succeeds; several as candidate paths, with limits 0.8 (more than one doubtful column, more than 10 reads) and 0.7 (more than two)."""
    ahead = [(p.seq[p.over :], p.support) for p in paths if len(p.seq) > p.over]
    if not ahead:
        return None, False
    if len(ahead) == 1:
        return ahead[0][0][0], True
    cols = columns(ahead)
    wrong = sum(doubtful(c) for c in cols)
    top = sorted(cols[0].items(), key=lambda x: (-x[1], x[0]))
    r = (top[1][1] if len(top) > 1 else 0) / top[0][1]
    return top[0][0], not (wrong > 3 or (r > 0.8 and wrong > 1 and sum(cols[0].values()) > 10) or (r > 0.7 and wrong > 2))


def mean_fragments(fragments: DataFrame, by: str = "contig_id") -> DataFrame:
    """Mean fragment size of each path or contig."""
    return fragments.groupBy(by).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("frag").alias("mean_frag"))

