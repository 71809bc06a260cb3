"""Mixing sources to target weights: a low-discrepancy source schedule over shuffled blocks of equal size.

Slot i of the mix is a point of the golden-ratio sequence, mapped through the cumulative weights to a source; the sequence
is so even that every stretch of slots holds each source close to its weight. Slots are ranked per source, and rank r takes
the r-th block of that source. A source's blocks come from its documents in shuffled order, laid end to end (pass after
pass, each shuffled anew) and cut every `block` tokens; a document belongs to the block it starts in. Running sums are made
in two steps, over fixed ranges of the shuffle hash and within each, so that a source with most of the rows is no hot key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import written

_MOST_SOURCES = 10_000
_SLOT_RANGE = 1 << 16
_PER_RANGE = 20_000


@dataclass(frozen=True)
class Target:
    source: str
    weight: float
    max_repeats: int


def _targets(df: DataFrame) -> list[Target]:
    """The table of targets is a setting: it is read whole, up to a fixed number of rows."""
    rows = df.where("source is not null").select("source", F.coalesce("weight", F.lit(0.0)).cast("double"), F.coalesce("max_repeats", F.lit(1)).cast("int")).limit(_MOST_SOURCES + 1).collect()
    if len(rows) > _MOST_SOURCES:
        raise ValueError(f"more than {_MOST_SOURCES} targets")
    out = sorted((Target(*r) for r in rows), key=lambda t: t.source)
    if len({t.source for t in out}) < len(out) or any(t.weight < 0 or t.max_repeats < 0 for t in out):
        raise ValueError("targets must have one row a source and no negative values")
    return out


def _pick(values: list, index: Column, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), index)


def mix(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(mix, report). `block`: tokens of a block; by default 1/4096 of all tokens, within 2,048 and 2^20.

    mix: slot, source, block, pass_no, doc_id, n_tokens - documents in the order of slots (UTF-8 bytes + 1 tokens each).
    report: per target source weight, max_repeats, n_docs, n_tokens, target_tokens (weight x all tokens of documents whose
    source has a target), limit_tokens (n_tokens x max_repeats), n_slots (its slots in the schedule), unfilled (slots for which
    its documents, each used as often as it may, have no block), used_tokens, share (of all used tokens) and `short`: slots
    stay empty, or nearly so, and the sizes confirm limit_tokens < target_tokens (a schedule tells shares but for a few blocks).
    A short source is used as often as it may and its other slots stay empty.
    Documents with null text, null source or a source without target are left out; a target source without documents has
    size 0; a null weight is 0, a null max_repeats 1. Repeated rows are documents of their own. Empty tables give an empty
    mix. Targets: columns source, weight, max_repeats (at most 10,000 rows, no source twice).
    """
    spark, goals = docs.sparkSession, _targets(targets)
    names = [t.source for t in goals]
    no = F.array_position(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col(source)).cast("int")
    d = docs.where(F.col(text).isNotNull() & F.col(source).isNotNull()).select(no.alias("no"), F.col(doc_id).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("n_tokens"))
    # repeated rows get copy numbers, so that they are shuffled apart; in two steps, as a row may be repeated without limit
    d = d.where("no > 0").groupBy("no", "doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    d = d.withColumn("block", F.explode(F.expr(f"sequence(0, (n - 1) div {_SLOT_RANGE})")))
    d = d.withColumn("copy", F.explode(F.expr(f"sequence(block * {_SLOT_RANGE}, least(n, (block + 1) * {_SLOT_RANGE}) - 1)"))).drop("n", "block")
    d = written(d, "mix-docs")
    sizes = {r[0]: (r[1], r[2]) for r in d.groupBy("no").agg(F.sum("n_tokens"), F.count(F.lit(1))).collect()}  # a row a target
    size = [sizes.get(i + 1, (0, 0))[0] for i in range(len(goals))]
    count = [sizes.get(i + 1, (0, 0))[1] for i in range(len(goals))]
    total, weights = sum(size), sum(t.weight for t in goals)
    block = block or min(1 << 20, max(2048, total // 4096))
    n_slots = -(-total // block) if weights > 0 else 0

    edges, at = [], 0.0
    for t in goals:
        at += t.weight / weights if weights > 0 else 0
        edges.append(at)
    edges = edges[:-1] or [2.0]
    phi = (math.sqrt(5) - 1) / 2
    point = F.expr(f"id * {phi!r}D - floor(id * {phi!r}D)")
    slots = spark.range(n_slots).withColumn("range", F.expr(f"id div {_SLOT_RANGE}"))
    which = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("point"))) + 1
    slots = slots.withColumn("point", point).select(F.col("id").alias("slot"), "range", which.cast("int").alias("no"))
    per = slots.groupBy("no", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("no", "range").orderBy("slot")) - 1
    slots = slots.withColumn("rank", rank).join(per.withColumn("before", before).drop("n"), ["no", "range"]).select("slot", "no", (F.col("rank") + F.col("before")).alias("block"))

    n_ranges = 1 << max(4, (sum(count) // _PER_RANGE).bit_length())
    passes = [min(t.max_repeats, -(-math.ceil(t.weight / weights * total + 2 * block) // s) if s else 0) if weights > 0 else 0 for t, s in zip(goals, size)]
    if not goals:
        passes = [0]
    d = d.withColumn("pass_no", F.explode(F.sequence(F.lit(1), F.greatest(_pick(passes, F.col("no"), "int"), F.lit(1))))).where(F.col("pass_no") <= _pick(passes, F.col("no"), "int"))
    d = d.withColumn("h", F.xxhash64("doc_id", "copy", "pass_no", F.lit(seed))).withColumn("range", F.expr(f"shiftrightunsigned(h, {64 - (n_ranges.bit_length() - 1)})"))
    key = ["no", "pass_no", "range"]
    sums = d.groupBy(*key).agg(F.sum("n_tokens").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("no", "pass_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("n_tokens").over(Window.partitionBy(*key).orderBy("h", "doc_id", "n_tokens", "copy").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    d = d.withColumn("within", within).join(sums.withColumn("earlier", earlier).drop("n"), key)
    start = (F.col("pass_no") - 1) * _pick(size or [0], F.col("no"), "bigint") + F.col("earlier") + F.col("within")
    d = d.withColumn("block", F.floor(start / F.lit(block)).cast("bigint"))
    mixed = slots.join(d, ["no", "block"]).select("slot", _pick(names or [""], F.col("no"), "string").alias("source"), "block", "pass_no", "doc_id", "n_tokens")

    made = written(mixed, "mix")
    used = made.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"))
    all_used = made.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    # what the schedule asks of each source and what its documents, laid end to end, can fill
    asked = per.groupBy("no").agg(F.sum("n").alias("n_slots"))
    laid = d.groupBy("no").agg(F.max(start + F.col("n_tokens")).alias("laid_tokens"))
    slack = 8 + n_slots.bit_length()  # the sequence gives a source as many slots as its weight says, but for so many
    rows = [(i + 1, t.source, t.weight, t.max_repeats, c, s, t.weight * total, s * t.max_repeats) for i, (t, c, s) in enumerate(zip(goals, count, size))]
    report = spark.createDataFrame(rows, "no int, source string, weight double, max_repeats int, n_docs bigint, n_tokens bigint, target_tokens double, limit_tokens bigint")
    report = report.join(used, "source", "left").join(asked, "no", "left").join(laid, "no", "left").fillna(0, ["used_tokens", "n_slots", "laid_tokens"])
    full = F.floor(F.col("laid_tokens") / F.lit(block))
    report = report.withColumn("unfilled", F.greatest(F.col("n_slots") - full, F.lit(0)))
    tight = F.col("n_slots") + F.lit(slack) > full  # slots stay empty, or so few blocks are left that the sizes must tell
    share = F.col("used_tokens") / F.lit(all_used) if all_used else F.lit(0.0)
    report = report.withColumn("share", share).withColumn("short", tight & (F.col("limit_tokens") < F.col("target_tokens")))
    return made, report.select("source", "weight", "max_repeats", "n_docs", "n_tokens", "target_tokens", "limit_tokens", "n_slots", "unfilled", "used_tokens", "share", "short")
