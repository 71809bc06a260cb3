import random

import pytest

from loomseq import cli, pipeline
from loomseq.operators.quality import valid
from loomseq.sources import fastx, sinks
from loomseq.streaming import arrivals
from pyspark.sql import functions as F

TURN = str.maketrans("ACGT", "TGCA")


def fastq(path, rows):
    path.write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in rows))
    return str(path)


def some(n, seed=1):
    r = random.Random(seed)
    return [(f"r{i}", "".join(r.choices("ACGT", k=r.randrange(20, 60))), None) for i in range(n)]


@pytest.mark.parametrize("size", [16, 97, 1000, 1 << 20])
def test_fastq_ranges(spark, tmp_path, size):
    rows = [(n, s, "@" + "I" * (len(s) - 1)) for n, s, _ in some(60)]
    p = fastq(tmp_path / "a.fq", rows)
    got = fastx.records(spark, [p], range_bytes=size).orderBy("offset").collect()
    assert [(r.name, r.seq, r.qual) for r in got] == rows


@pytest.mark.parametrize("size", [16, 97, 1 << 20])
def test_fasta_ranges(spark, tmp_path, size):
    rows = some(40)
    p = tmp_path / "a.fa"
    p.write_text("".join(f">{n}\n{s[:15]}\n{s[15:]}\n" for n, s, _ in rows))
    got = fastx.records(spark, [str(p)], range_bytes=size).orderBy("offset").collect()
    assert [(r.name, r.seq, r.qual) for r in got] == rows


@pytest.mark.parametrize("block", [7, 64, 4 << 20])
@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_blocks(tmp_path, block, ending):
    """Records that span blocks, other line ends, no line end at the end."""
    rows = [(n, s, "+" + "@" * (len(s) - 1)) for n, s, _ in some(30)]
    p = tmp_path / "a.fq"
    p.write_bytes("".join(ending.join((f"@{n}", s, "+", q, "")) for n, s, q in rows).rstrip().encode())
    q = tmp_path / "a.fa"
    q.write_bytes("".join(ending.join((f">{n}", s[:9], s[9:], "")) for n, s, _ in rows).encode() + (">empty" + ending).encode())
    for size in (50, 500, 1 << 20):
        got, fa = [], []
        for lo in range(0, p.stat().st_size, size):
            with fastx._open(str(p)) as f:
                for off, *cols in fastx.fastq_batches(f, lo, lo + size, block):
                    got += zip(*(c.to_pylist() for c in cols))
        for lo in range(0, q.stat().st_size, size):
            with fastx._open(str(q)) as f:
                for off, name, seq, _ in fastx.fasta_batches(f, lo, lo + size, block):
                    fa += zip(name.to_pylist(), seq.to_pylist())
        assert got == rows and fa == [(n, s) for n, s, _ in rows] + [("empty", "")]


def test_compressed(spark, tmp_path):
    import gzip

    rows = [(n, s, "I" * len(s)) for n, s, _ in some(50)]
    p = fastq(tmp_path / "a.fq", rows)
    with gzip.open(tmp_path / "a.fq.gz", "wb") as f:
        f.write((tmp_path / "a.fq").read_bytes())
    got = fastx.records(spark, [str(tmp_path / "a.fq.gz"), p]).orderBy("file_no", "offset").collect()
    assert [(r.name, r.seq, r.qual) for r in got] == rows * 2


def test_pairing(spark, tmp_path):
    a, b = some(30, 1), some(30, 2)
    pa_, pb = (fastq(tmp_path / f"{x}.fq", [(n, s, "I" * len(s)) for n, s, _ in rows]) for x, rows in (("a", a), ("b", b)))
    got = fastx.reads(spark, [pa_, pb], 1, range_bytes=200).orderBy("rid").collect()
    assert [r.seq for r in got] == [x for i in range(30) for x in (a[i][1], b[i][1])]
    assert [(r.rid, r.pair_id, r.mate) for r in got[:4]] == [(1, 1, 1), (2, 1, 2), (3, 2, 1), (4, 2, 2)]
    got = fastx.reads(spark, [pa_], 2, cut=10).orderBy("rid").collect()
    assert got[3].pair_id == 2 and all(r.seqlen == 10 for r in got)
    assert fastx.reads(spark, [pa_, pb]).where("pair_id is null").count() == 60
    with pytest.raises(ValueError):
        fastx.reads(spark, [pa_], 1)


def test_bad_files(spark, tmp_path):
    a = fastq(tmp_path / "a.fq", [("r", "ACGT", "IIII")])
    (tmp_path / "b.fa").write_text(">x\nACGT\n")
    (tmp_path / "c.txt").write_text("ACGT\n")
    (tmp_path / "d.fq").write_text("@r\nACGT\n+\n")
    with pytest.raises(ValueError):
        fastx.sniff([a, str(tmp_path / "b.fa")])
    with pytest.raises(ValueError):
        fastx.sniff([str(tmp_path / "c.txt")])
    with pytest.raises(Exception, match="cut-off"):
        fastx.records(spark, [str(tmp_path / "d.fq")]).count()
    c = fastx.contigs(spark, [str(tmp_path / "b.fa")], 3)
    assert c.first().asDict() == {"contig_id": 1, "title": "x", "seq": "ACGT", "len": 4}


def test_truth_and_lengths(spark, tmp_path):
    a = fastq(tmp_path / "a.fq", [("g_x_1_250", "ACGTA", "IIIII"), ("g_x_2_7", "ACG", "III"), ("plain", "ACGT", "IIII")])
    recs = fastx.records(spark, [a])
    got = {r.name: (r.true_strand, r.true_pos) for r in fastx.truth(recs).select("name", "true_strand", "true_pos").collect()}
    assert got["g_x_1_250"] == ("1", 250) and got["g_x_2_7"] == ("2", 7) and got["plain"] == (None, None)
    assert [tuple(r) for r in fastx.min_lengths(recs).collect()] == [(0, 3, 5)]


def test_quality(spark):
    good = "I" * 50
    rows = [("ACGT" * 10, None, True), ("ACGN" * 10, None, False), ("A" * 50, None, False), ("A" * 44 + "C" * 6, None, True), ("A" * 45 + "C" * 5, None, False), ("ACGTA" * 10, good, True), ("ACGTA" * 10, good[:20] + '"' + good[21:], False), ("ACGTA" * 10, good[:40] + "#" * 10, False), ("ACGTA" * 10, "*" * 40 + "I" * 10, False), ("ACGTA" * 10, "+" * 40 + "$" * 10, True), ("", None, False), (None, None, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, seq string, qual string, want boolean")
    for r in df.withColumn("got", valid(F.col("seq"), F.col("qual"))).collect():
        assert r.got == r.want, r


def test_snapshot(spark, tmp_path):
    reads = spark.createDataFrame([(1, "ACGT")], "rid bigint, seq string")
    sinks.save_snapshot(str(tmp_path / "s"), reads, reads, {"k": 25})
    sinks.save_params(spark, str(tmp_path / "s"), {"k": 27})
    assert sinks.load_snapshot(spark, str(tmp_path / "s"), "params") == {"k": 27}
    assert sinks.load_snapshot(spark, str(tmp_path / "s"), "reads").count() == 1


def test_whole_pipeline(spark, tmp_path):
    g = "".join(random.Random(4).choices("ACGT", k=1500))
    rows = []
    for i in range(400):
        p = int(i * (len(g) - 240) / 399)
        rows += [(f"r{i}/1", g[p : p + 100], "I" * 100), (f"r{i}/2", g[p + 140 : p + 240].translate(TURN)[::-1], "I" * 100)]
    f = fastq(tmp_path / "r.fq", rows)
    out = str(tmp_path / "out")
    got = cli.main(["all", "-f", f, "-p", "2", "-d", out, "-m", "200"])
    assert got["contigs"]["max_len"] >= 1400 and got["scaffolds"]["max_len"] >= 1400
    seqs = [r.seq for r in spark.read.parquet(f"{out}/contigs").collect()]
    assert all(s in g or s in g.translate(TURN)[::-1] for s in seqs)
    half = fastx_file(tmp_path, g)
    whole = {g, g.translate(TURN)[::-1]}
    (s,) = pipeline.scaffolds(spark, out, [half], 240.0, 20.0).collect()
    assert s.n_contigs == 2 and s.seq in whole  # the 30 bases between are filled in
    (s,) = pipeline.scaffolds(spark, out, [half], 240.0, 20.0, fill_gaps=False, name="open").collect()
    assert s.n_contigs == 2 and "N" in s.seq and len(s.seq) == pytest.approx(1500, abs=20)
    assert sum(1 for r in spark.read.text(f"{out}/open.fa").collect() if r.value.startswith(">")) == 1
    assert spark.read.csv(f"{out}/overlaps.txt", sep="\t").count() == 2 and spark.read.text(f"{out}/layout.txt").count() > 100
    with pytest.raises(SystemExit):
        cli.main(["sf", "-g", str(tmp_path / "nowhere")])
    again = cli.main(["sf", "-g", out, "-mf", f"{out}/match_info", "-gf", "n", "-s", "500", "-o", "again"])
    assert again["scaffolds"]["max_len"] >= 1400 and (tmp_path / "out" / "again_scaffolds.fa").exists()


def fastx_file(tmp_path, g):
    p = tmp_path / "c.fa"
    p.write_text(f">1\n{g[:700]}\n>2\n{g[730:].translate(TURN)[::-1]}\n")
    return str(p)


def test_stream(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/read_buf.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    q = arrivals.once(arrivals.deliveries(spark, str(tmp_path / "in")), "3650 days").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    want = src.where("sequenced_at is not null").select("rid").distinct().count()
    assert spark.table("once").count() == want
    q = arrivals.run_counts(arrivals.deliveries(spark, str(tmp_path / "in"))).writeStream.format("memory").outputMode("complete").queryName("runs").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("runs").agg(F.sum("n_reads")).first()[0] == src.where("sequenced_at is not null").count()
