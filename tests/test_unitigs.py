"""Unitigs against a walk in plain Python, and contigs of planted genomes."""

import random
from collections import Counter

import pytest

from loomseq.operators import chains, unitigs
from loomseq.params import Params

TURN = str.maketrans("ACGT", "TGCA")


def turn(s):
    return s.translate(TURN)[::-1]


def walk(reads, k, least):
    """Maximal unbranched paths, as sets of canonical texts."""
    n = Counter(min(s[i : i + k], turn(s[i : i + k])) for s in reads for i in range(len(s) - k + 1))
    solid = {w for w, c in n.items() if c >= least}
    nodes = solid | {turn(w) for w in solid}

    def after(w):
        return [w[1:] + b for b in "ACGT" if w[1:] + b in nodes]

    def next_of(w):
        a = after(w)
        if len(a) == 1 and sum(b + w[1:] in nodes for b in "ACGT") == 1 and a[0] not in (w, turn(w)):
            return a[0]
        return None

    out, used = set(), set()
    for w in sorted(nodes):
        if w in used:
            continue
        x, seen = w, {w}
        while (y := turn(z) if (z := next_of(turn(x))) else None) is not None and y not in seen:
            x = y
            seen.add(y)
        if y is not None:  # a circle: it opens before its least k-mer
            x = min(seen)
        path, cur = x, x
        nodes_of = {x}
        while (cur := next_of(cur)) is not None and cur not in nodes_of:
            path += cur[-1]
            nodes_of.add(cur)
        used |= nodes_of
        out.add((min(path, turn(path)), y is not None))
    return out


def sample(g, depth, size, seed, errors=0.0):
    r = random.Random(seed)
    out = []
    for i in range(len(g) * depth // size):
        p = r.randrange(len(g) - size + 1)
        s = list(g[p : p + size])
        for j in range(size):
            if r.random() < errors:
                s[j] = r.choice("ACGT")
        s = "".join(s)
        out.append((2 * i + 1, turn(s) if r.random() < 0.5 else s))
    return out


@pytest.mark.parametrize("one_task", [4_000_000, 0])
def test_like_a_walk(spark, monkeypatch, one_task):
    monkeypatch.setattr(chains, "_ONE_TASK", one_task)
    r = random.Random(3)
    repeat = "".join(r.choices("ACGT", k=60))
    g = ["".join(r.choices("ACGT", k=n)) for n in (200, 150, 100)]
    text = g[0] + repeat + g[1] + repeat + g[2]
    ring = "".join(r.choices("ACGT", k=80))
    reads = [s for _, s in sample(text, 12, 50, 1)] + [(ring * 3)[i : i + 50] for i in range(0, 80, 3)] * 2 + ["", "ACGT", "N" * 60]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(reads)], "rid bigint, seq string")
    got = unitigs.unitigs(df, Params(k=21), 2).collect()
    want = walk([s for s in reads if "N" not in s], 21, 2)
    found = {min(x.seq, turn(x.seq)) for x in got}
    lines = {s for s, circle in want if not circle}
    (round_,) = found - lines  # the ring opens at some place: 80 k-mers
    assert lines <= found and len(got) == len(found) and len(round_) == 100
    assert {c for c in (min(round_[i : i + 21], turn(round_[i : i + 21])) for i in range(80))} == {min(w, turn(w)) for w in ((ring * 2)[i : i + 21] for i in range(80))}
    assert all(len(x.seq) == x.n_kmers + 20 for x in got)
    assert unitigs.unitigs(df.limit(0), Params(k=21)).count() == 0


def test_planted_genome(spark):
    """Errors, and repeats longer than k but shorter than a read: contigs are true and cover the genome."""
    r = random.Random(8)
    repeat = "".join(r.choices("ACGT", k=50))
    parts = ["".join(r.choices("ACGT", k=1500)) for _ in range(4)]
    g = repeat.join(parts)
    df = spark.createDataFrame(sample(g, 40, 100, 2, 0.004), "rid bigint, seq string")
    p = Params()
    u = unitigs.unitigs(df, p).collect()
    got = unitigs.assemble(df, p, 200).collect()
    assert all(x.seq in g or turn(x.seq) in g for x in got)
    assert sum(len(x.seq) for x in got) >= 0.95 * len(g) and max(len(x.seq) for x in got) > max(len(x.seq) for x in u)
    assert sorted(x.contig_id for x in got) == list(range(1, len(got) + 1))
    assert unitigs.assemble(df.limit(0), p).count() == 0


def test_bins_on_their_own(spark, monkeypatch):
    """Paths and circles over many bins, each settled by itself, are those of a walk; a circle opens before its least k-mer."""
    monkeypatch.setattr(unitigs, "_CHUNK", 0)
    r = random.Random(5)
    line, *rings = ("".join(r.choices("ACGT", k=n)) for n in (700, 300, 40))
    reads = [line] * 2 + [(g * 3)[i : i + 60] for g in rings for i in range(0, len(g), 5)] * 2
    got = unitigs.unitigs(spark.createDataFrame([(i, s) for i, s in enumerate(reads)], "rid bigint, seq string"), Params(k=21), 2).collect()
    number = lambda w: int("".join(str("ACGT".index(c)) for c in w), 4)
    for g in rings:
        (x,) = [x for x in got if x.seq[:21] in g * 3 or turn(x.seq[:21]) in g * 3]
        first = min((s * 2)[i : i + 21] for s in (g, turn(g)) for i in range(len(g)))
        assert x.unitig_id == number(first) and x.seq.startswith(first) and x.n_kmers == len(g) and len(x.seq) == len(g) + 20
        assert x.seq in g * 3 or turn(x.seq) in g * 3
    (x,) = [x for x in got if min(x.seq, turn(x.seq)) == min(line, turn(line))]
    assert len(got) == 3 and x.n_kmers == 680 and x.mean_n == 2 and x.unitig_id == number(x.seq[:21]) < number(turn(x.seq)[:21])


def test_few_bytes_sent(spark):
    """K-mers go out as spans: reads that share nothing take fewer bytes of shuffle files than they have letters, not a number a k-mer."""
    r = random.Random(6)
    df = spark.createDataFrame([(i, "".join(r.choices("ACGT", k=100))) for i in range(10_000)], "rid bigint, seq string").repartition(4).cache()
    df.count()
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = sent()
    assert unitigs.unitigs(df, Params()).count() == 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert sent() - before < 1.5 * 100 * 10_000


def test_reads_of_tails(spark, monkeypatch):
    """Tails get the reads that share a k-mer with them, but for repeats, and nothing is broadcast, however small Spark takes it to be."""
    plans = []
    kept = unitigs.written
    monkeypatch.setattr(unitigs, "written", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or kept(df, name))
    monkeypatch.setattr(unitigs, "_CHUNK", 0)
    r = random.Random(9)
    g, p, most = "".join(r.choices("ACGT", k=3000)), Params(), 40
    reads = sample(g, 30, 100, 4, 0.01) + [(10_000 + i, g[700:760]) for i in range(60)] + [(1 << 40, g[980:1080])]
    tails = [(i, g[max(0, 150 * i - 200) : 150 * i]) for i in range(1, 20)]
    made = unitigs._extended(kept(spark.createDataFrame(tails, "end_id bigint, tail string"), "t"), kept(spark.createDataFrame(reads, "rid bigint, seq string"), "r"), p, most)
    plans.append(made._jdf.queryExecution().toString())
    words = lambda s: [min(s[i : i + p.k], turn(s[i : i + p.k])) for i in range(len(s) - p.k + 1)]
    n = Counter(w for _, s in reads for w in words(s))
    want = {}
    for end, tail in tails:
        near = {w for w in words(tail[-p.read_len :]) if n[w] <= most}
        if mine := [x for x in reads if near & set(words(x[1]))]:
            rids, seqs = zip(*sorted(mine))
            want[end] = (len(tail), unitigs.Assembler(list(rids), list(seqs), p).extend(tail, {}, len(tail) + 2 * p.read_len))
    assert {x.end_id: (x.n_tail, x.made) for x in made.collect()} == want and any(len(m) > n + 20 for n, m in want.values())
    assert not any("Broadcast" in x for x in plans)
