"""Thresholds of the pipeline in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # They decide results and must stay as they are.
    k: int = 25
    read_len: int = 100
    single_qual: int = 2
    tail_mean_qual: float = 3.0
    head_mean_qual: float = 10.0
    tail_share: float = 0.2
    artefact_share_a: float = 0.9
    head_sample_pct: int = 3
    tail_sample_pct: int = 8
    sample_step: int = 2
    lower_factor: float = 0.5
    lower_min: int = 3
    lower_max: int = 6
    upper_factor: int = 10
    fresh_share: float = 0.9
    max_insert: int = 5000
    sdev_share: float = 0.15
    profile_reads: int = 10_000
    max_mismatch: int = 3
    align_region: int = 2000
    coverage_bin: int = 30
    incorrect_share: float = 0.9
    match: int = 1
    mismatch: int = -2
    gap: int = -4
    min_overlap: int = 3
    min_exact_overlap: int = 2
    max_gap_break: int = -500
    weak_gap_break: int = -300
    min_gap_bases: int = 2
    link_max_factor: int = 13
    link_min_factor: float = 0.1
    link_min: int = 3
    link_second: int = 1
    second_share: float = 0.4

    def resolved(self) -> Params:
        """Forced odd k; the end region follows the read length."""
        return replace(self, k=self.k - 1 + self.k % 2, align_region=max(self.align_region, 10 * self.read_len))

    @property
    def min_contig_len(self) -> int:
        return max(200, 2 * self.read_len)


DEFAULT = Params().resolved()
