import random

from loomseq.operators import assemble, chains, mapping, overlap, scaffold, stats
from loomseq.operators import components as components_module
from loomseq.operators.components import components
from loomseq.params import Params
from pyspark.sql import functions as F

TURN = str.maketrans("ACGT", "TGCA")


def roots(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(150)] + [(7, 7), (5000, 5000)] + [(9000, i) for i in range(9001, 9100)]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a bigint, b bigint")
    assert {x.node: x.component for x in components(df).collect()} == roots(edges)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def genome(seed, n):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def shred(g, n, size, seed, first=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        p = min(max(0, int(i * (len(g) - size) / (n - 1))), len(g) - size)
        s = g[p : p + size]
        out.append((first + 2 * i, s.translate(TURN)[::-1] if r.random() < 0.5 else s))
    return out


def test_assembly_finds_the_planted_sequences(spark):
    gs = [genome(i, 600) for i in range(3)]
    reads = [x for i, g in enumerate(gs) for x in shred(g, 90, 100, i, 1 + 1000 * i)]
    reads.append((9001, genome(99, 100)))
    df = spark.createDataFrame(reads, "rid bigint, seq string")
    got = assemble.assemble(df, Params()).collect()
    assert len(got) == 3
    text = {s: s.translate(TURN)[::-1] for s in gs}
    by_rid = dict(reads)
    for c in got:
        assert any(c.seq in g or c.seq in t for g, t in text.items()) and len(c.seq) >= 590
        assert c.n_reads == len(c.placements) > 60
        assert len(c.votes) == len(c.seq) and sum(v > 0 for v in c.votes) >= len(c.seq) - 100
        for p in c.placements:
            s = by_rid[p.rid]
            s = s.translate(TURN)[::-1] if p.orient else s
            assert c.seq[p.pos - 1 : p.pos - 1 + p.matchlen] == s
    assert assemble.assemble(spark.createDataFrame([], df.schema)).count() == 0


def test_guards_and_scorer():
    a = assemble.Assembler([1, 2], ["A" * 100, "C" * 100], Params(), (240.0, 20.0))
    one, none, both = (0, 0, 1, 0), (0, 0, 6, 0), (5, 4, 9, 4)
    assert a.stopped([one] * 29, 900, True) is None and a.stopped([one] * 30, 900, False) == 1
    assert a.stopped([none] * 60, 2000, True) == 2 and a.stopped([none] * 60, 2000, False) is None
    assert a.stopped([(0, 0, 2, 0)] * 70, 400, True) == 3 and a.stopped([(5, 0, 5, 0)] * 97 + [both] * 3, 900, True) == 4
    assert a.stopped([(5, 0, 5, 0)] * 100, 9000, True) is None and a.density("A" * 50) == 1.0
    from loomseq.operators import model, votes

    assert votes.score((30.0, 1.0, 1.0, 2.0), model.PAIRED) < 0  # thirty mates against one
    assert isinstance(votes.score((3.0, 12.0, 2.5, 40.0), model.PAIRED), float)


def test_assembly_outvotes_an_error(spark):
    g = genome(5, 500)
    reads = shred(g, 100, 100, 5)
    rid, s = reads[40]
    reads[40] = (rid, s[:50] + ("A" if s[50] != "A" else "C") + s[51:])
    got = assemble.assemble(spark.createDataFrame(reads, "rid bigint, seq string")).collect()
    assert any(c.seq in g or c.seq in g.translate(TURN)[::-1] for c in got if len(c.seq) > 400)


def test_gap_filling(spark):
    g = genome(6, 400)
    all_reads = [{"rid": r, "seq": s} for r, s in shred(g, 80, 100, 6)]
    at = {r["rid"]: min(i for i in (g.find(r["seq"]), g.find(r["seq"].translate(TURN)[::-1])) if i >= 0) for r in all_reads}
    right_only = [r for r in all_reads if at[r["rid"]] > 130]  # the left end has no read that goes on
    sides = [r for r in all_reads if at[r["rid"]] + 100 <= 230 or at[r["rid"]] >= 170]
    few = [r for r in all_reads if at[r["rid"]] + 100 <= 170 or at[r["rid"]] >= 185]
    schema = "gap_id bigint, left_end string, right_end string, gap double, reads array<struct<rid: bigint, seq: string>>"
    rows = [(1, g[:150], g[200:350], 50.0, all_reads), (2, g[:150], g[200:350], 50.0, None), (3, g[:150], g[200:350], 50.0, right_only), (4, g[:150], g[200:350], 50.0, sides), (5, g[:150], g[200:350], 50.0, few), (6, g[:150], g[130:300], -20.0, all_reads), (7, None, g[:100], None, None)]
    got = {r.gap_id: r for r in assemble.fill_gaps(spark.createDataFrame(rows, schema), sdev=10.0).collect()}
    for i in (1, 3, 4):
        assert (got[i].state, got[i].fill, got[i].overlap) == ("merged", g[150:200], 0)
    assert got[2].state == "gap" and got[2].rest == 50.0 and got[7].state == "gap"
    assert got[5].state == "gap" and g[150:200].startswith(got[5].won_left) and g[150:200].endswith(got[5].won_right) and got[5].n_left + got[5].n_right > 10
    assert (got[6].state, got[6].fill, got[6].overlap) == ("merged", "", 20)


def test_list_rank(spark, monkeypatch):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (200, 201), (201, 202), (202, 200), (7000, 7001)]
    want = {i: (1, i - 1) for i in range(1, 41)} | {100: (100, 0), 90: (100, 1), 95: (100, 2), 200: (200, 0), 201: (200, 1), 202: (200, 2), 7000: (7000, 0), 7001: (7000, 1)}
    df = spark.createDataFrame([*links, (5, 5)], "src bigint, dst bigint")
    for most in (4_000_000, 0):  # in one task, and by joins
        monkeypatch.setattr(chains, "_ONE_TASK", most)
        monkeypatch.setattr(components_module, "_ONE_TASK", most)
        assert {r.node: (r.head, r["rank"]) for r in chains.list_rank(df).collect()} == want
        assert chains.list_rank(df.limit(0)).count() == 0
        edges = [(3, 9), (9, 4), (20, 21), (8, 8)]
        assert {x.node: x.component for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} == roots(edges)


def test_cut_and_consensus_in_the_text(spark):
    """An overlap hidden behind uncovered ends, and one with an error, come out right in the scaffold."""
    g, junk = genome(20, 1200), genome(21, 30)
    bad = list(g[560:860])
    bad[2] = "A" if bad[2] != "A" else "C"
    contigs = spark.createDataFrame([(1, g[:300] + junk[:7]), (2, junk[7:12] + g[260:600]), (3, "".join(bad)), (4, g[900:])], "contig_id bigint, seq string")
    chain = spark.createDataFrame([(1, 1, 1, 0, None, 0), (1, 2, 2, 0, -40.0, 5), (1, 3, 3, 0, -40.0, 5), (1, 4, 4, 0, 40.0, 5)], scaffold.CHAIN)
    bare = spark.createDataFrame([(1, 0, 7), (2, 5, 0), (3, 0, 0), (4, 0, 0)], "contig_id bigint, bare5 int, bare3 int")
    rows = overlap.neighbour_overlaps(chain, contigs, 10.0, bare=bare)
    got = {r.ord: r for r in rows.collect()}
    assert [got[i].decision for i in (1, 2, 3, 4)] == ["start", "merge", "merge", "gap"]
    assert (got[2].cut_left, got[2].cut_right, got[2].exact) == (7, 5, 40) and got[3].exact == 0 and got[3].aligned_left == 40
    (s,) = scaffold.scaffold_seqs(rows, contigs).collect()
    assert s.seq == g[:860] + "N" * 40 + g[900:]
    weak = spark.createDataFrame([(1, 2)], "scaffold_id bigint, ord int")
    assert [r.decision for r in scaffold.break_weak(rows, weak).orderBy("ord").collect()] == ["start", "break", "break", "gap"]
    assert sorted(r.n_contigs for r in scaffold.scaffold_seqs(scaffold.break_weak(rows, weak), contigs).collect()) == [1, 1, 2]


def test_weak_middle(spark):
    contigs = spark.createDataFrame([(1, "A" * 500), (2, "C" * 200), (3, "G" * 500)], "contig_id bigint, seq string")
    rows = spark.createDataFrame([(1, 1, 1, 0, 0), (1, 2, 2, 0, 80), (1, 3, 3, 0, 10)], "scaffold_id bigint, ord int, contig_id bigint, orient int, exact int")
    none = spark.createDataFrame([], "c1 bigint, c2 bigint")
    assert [(r.scaffold_id, r.ord) for r in scaffold.weak_links(rows, contigs, none).collect()] == [(1, 2)]
    assert scaffold.weak_links(rows, contigs, spark.createDataFrame([(1, 3)], none.schema)).count() == 0


def test_filter_bins(spark):
    """A bin far over the mean falls when it links to many contigs, and so does the one behind it."""
    reads = [(1, 0, 30 * b + 1, n) for b, n in enumerate([2, 2, 40, 10, 2, 2, 2, 2])]
    x = spark.createDataFrame([(c, e, pos, i) for c, e, pos, n in reads for i in range(n)], "contig_id bigint, contig_end int, contig_pos int, rid bigint")
    links = spark.createDataFrame([(1, 0, 2, 9, 0.9), (1, 0, 3, 3, 0.5), (1, 0, 4, 1, 0.0)], "contig_id bigint, contig_end int, bin bigint, n_links bigint, second_share double")
    dropped = mapping.filter_bins(mapping.coverage_bins(x), links)
    assert sorted(r.bin for r in dropped.collect()) == [2, 3]
    assert mapping.without_bins(x, dropped).count() == x.count() - 50


def test_overlaps(spark):
    left, right = genome(7, 300), genome(8, 300)
    mid = genome(9, 40)
    bad = mid[:3] + ("A" if mid[3] != "A" else "C") + mid[4:]
    df = spark.createDataFrame([(left + mid, mid + right, -40.0), (left + mid, bad + right, -40.0), (left, right, 10.0), ("", right, 0.0)], "l string, r string, g double")
    df = df.withColumn("exact", overlap.exact_overlap(F.col("l"), F.col("r"), F.col("g"), 200)).withColumn("a", overlap.dovetail(F.expr("right(l, 200)"), F.expr("left(r, 200)")))
    a, b, c, d = df.collect()
    assert a.exact == 40 and a.a.overlap == 40 and a.a.consensus == mid and a.a.mismatches == 0
    assert b.exact < 40 and b.a.overlap == 40 and b.a.consensus == mid and b.a.mismatches == 1
    assert c.a.overlap < 15 and d.exact == 0 and d.a.overlap == 0
    cut = overlap.cut_retry(F.lit(left + mid + "ACGTA"), F.lit(mid + right), F.lit(5), F.lit(9), F.lit(-40.0), 100)
    x = spark.range(1).select(cut.alias("c")).first().c
    assert x.round == 1 and x.cut_left == 5 and x.overlap == 40


def test_scaffold_text(spark):
    g = genome(10, 900)
    one, two, three = g[:300], g[260:560].translate(TURN)[::-1], g[570:]
    contigs = spark.createDataFrame([(1, one), (2, two), (3, three), (4, "ACGT")], "contig_id bigint, seq string")
    chain = spark.createDataFrame([(1, 1, 1, 0, None, 0), (1, 2, 2, 1, -38.0, 5), (1, 3, 3, 0, 25.0, 4)], scaffold.CHAIN)
    rows = overlap.neighbour_overlaps(chain, contigs, 10.0)
    assert [r.decision for r in rows.orderBy("ord").collect()] == ["start", "merge", "gap"]
    (s,) = scaffold.scaffold_seqs(rows, contigs).collect()
    assert s.seq == g[:560] + "N" * 25 + three and s.n_contigs == 3 and s.len == len(s.seq)
    assert {r.seq for r in scaffold.with_unlinked(scaffold.scaffold_seqs(rows, contigs), rows, contigs).collect()} == {s.seq, "ACGT"}
    broken = rows.withColumn("decision", F.when(F.col("ord") == 3, "break").otherwise(F.col("decision")))
    assert sorted(r.len for r in scaffold.scaffold_seqs(broken, contigs).collect()) == [len(three), 560]
    assert [r.contig_id for r in scaffold.merged_contigs(scaffold.scaffold_seqs(broken, contigs), broken, contigs).orderBy("contig_id").collect()] == [1, 2, 3]


def test_linking(spark):
    contigs = spark.createDataFrame([(i, "A" * (1000 - i)) for i in range(1, 8)], "contig_id bigint, seq string")
    edges = [(1, 2, 0, 9, 0, 5.0), (2, 3, 1, 7, 0, 4.0), (5, 6, 0, 4, 0, 1.0), (5, 7, 0, 4, 0, 1.0)]
    got = scaffold.link(spark.createDataFrame(edges, "c1 bigint, c2 bigint, best int, n_best int, n_second int, gap double"), contigs)
    assert [(r["ord"], r.contig_id, r.orient) for r in got.where("scaffold_id = 1").orderBy("ord").collect()] == [(1, 1, 0), (2, 2, 0), (3, 3, 1)]
    assert got.where("contig_id in (5, 6, 7)").count() == 0


def test_length_stats(spark):
    df = spark.createDataFrame([(x,) for x in (10, 9, 8, 7, 6, 5)], "len int")
    r = stats.length_stats(df).first()
    assert (r.n, r.total, r.max_len, r.n50, r.mean_len, r.median_len) == (6, 45, 10, 8, 7.5, 7)
    assert stats.length_stats(df.limit(0)).first().n == 0


def test_renumber(spark):
    df = spark.range(100).selectExpr("(id * 37) % 101 as v")
    got = [tuple(r) for r in scaffold.renumber(df, "v", "no").orderBy("v").collect()]
    assert [n for _, n in got] == list(range(1, 101))
