"""Sequence scalars as Column expressions (no Python in the plan)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def revcomp(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def pack2(seq: Column) -> Column:
    """Up to 31 bases as one BIGINT, two bits a base, the first base highest; null where other letters occur."""
    digits = F.translate(F.upper(seq), "ACGT", "0123")
    return F.when(digits.rlike("^[0-3]{1,31}$"), F.conv(digits, 4, 10).cast("bigint"))


def unpack2(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def base_at(seq: Column, pos: Column, n: int = 1) -> Column:
    return F.substring(seq, pos, F.lit(n))


def unknown_bases(seq: Column) -> Column:
    return F.length(seq) - F.length(F.translate(seq, "Nn.", ""))


def replace_unknown(seq: Column, by: str = "C") -> Column:
    return F.regexp_replace(seq, "[Nn.]", by)


def share_of(seq: Column, base: str) -> Column:
    return (F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))) / F.length(seq)


def is_homopolymer(seq: Column) -> Column:
    return F.length(F.replace(seq, F.substring(seq, 1, 1), F.lit(""))) == 0


def shift_hash(seq: Column, table_size: int) -> Column:
    """h = 5381, then h = 33 h + base (mod 2^64) for each base 0..3; mod table_size."""
    digits = F.split(F.translate(seq, "ACGT", "0123"), "")
    big = F.expr("CAST(18446744073709551616 AS DECIMAL(22,0))")
    h = F.aggregate(
        digits,
        F.lit(5381).cast("decimal(20,0)"),
        lambda acc, d: F.pmod((acc * F.lit(33).cast("decimal(2,0)") + d.cast("decimal(1,0)")).cast("decimal(22,0)"), big).cast("decimal(20,0)"),
    )
    return F.pmod(h, F.lit(table_size).cast("decimal(20,0)")).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    """Differing letters of two strings, up to the shorter length."""
    n = F.least(F.length(a), F.length(b))
    pairs = F.zip_with(F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(n > 0, F.aggregate(pairs, F.lit(0), lambda s, x: s + x)).otherwise(0)
