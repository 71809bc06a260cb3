"""Portions and classes come out for reads and for contigs, as the spans and pairs do."""

from collections import defaultdict

from loomseq.llm import queries


def test_portions_and_classes_of_spans(spark, sf):
    n = defaultdict(int)
    for r in queries.p2_found(spark, sf).collect():
        n[r.rec_kind, r.rec_id] += r.to_pos - r.from_pos + 1
    assert {k for k, _ in n} == {"read", "contig"}
    got = queries.p2_portion(spark, sf).collect()
    assert {(r.rec_kind, r.rec_id): r.n_shared for r in got if r.n_shared} == n
    reads = spark.read.parquet(f"{sf}/read_buf.parquet").where("seq is not null").selectExpr("upper(seq)").distinct().count()
    contigs = spark.read.parquet(f"{sf}/contigs.parquet").where("contigseq is not null").count()
    assert (sum(r.rec_kind == "read" for r in got), sum(r.rec_kind == "contig" for r in got)) == (reads, contigs)
    assert {(r.rec_kind, r.rec_id) for r in queries.p2_classes(spark, sf).collect()} == set(n)


def test_classes_of_pairs(spark, sf):
    up = {}
    pairs = [((r.rec_kind, r.id_a), (r.rec_kind, r.id_b)) for r in queries.p5_found(spark, sf).collect()]
    for a, b in pairs:
        for x in (a, b):
            up.setdefault(x, x)
    for _ in up:
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    got = {(r.rec_kind, r.rec_id): r.class_id for r in queries.p5_classes(spark, sf).collect()}
    assert {k for k, _ in got} == {"read", "contig"}
    assert {x: got[x] for x in up} == {x: least[1] for x, least in up.items()}
    assert sum(k == "contig" for k, _ in got) == spark.read.parquet(f"{sf}/contigs.parquet").where("contigseq is not null").count()
