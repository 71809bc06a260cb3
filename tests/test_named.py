"""Operators that no query calls by themselves."""

import pytest

from loomseq.operators import overlap, pairs, votes
from pyspark.sql import functions as F


def test_model_from_rows(spark):
    df = spark.createDataFrame([(1.5, [0.5, 0.1]), (-2.0, [0.1, 0.4])], "alpha double, features array<double>")
    m = votes.KernelModel.from_rows(df, -0.25, (1.0, 1.0), (0.5, 0.5))
    assert sorted(zip(m.alpha, m.vectors)) == [(-2.0, (0.1, 0.4)), (1.5, (0.5, 0.1))]
    x = spark.createDataFrame([([3.0, 7.0],)], "f array<double>")
    assert x.select(votes.decision_score(F.col("f"), m).alias("s")).first().s == pytest.approx(votes.score((3.0, 7.0), m))
    with pytest.raises(ValueError):
        votes.KernelModel.from_rows(df, 0.0, most=1)


def test_splice(spark):
    df = spark.createDataFrame([("ACG", "TT", True), ("ACG", "TT", False)], "s string, n string, e boolean")
    assert [r.x for r in df.select(overlap.splice(F.col("s"), F.col("n"), F.col("e")).alias("x")).collect()] == ["ACGTT", "TTACG"]


def test_close_gap(spark):
    rows = [(50.0, "AAAACGTACGTT", "ACGTACGTTGGG", 20, 30), (50.0, "AAAA", "CCCC", 10, 10), (-450.0, "AAAA", "CCCC", 60, 60)]
    df = spark.createDataFrame(rows, "g double, l string, r string, a int, b int")
    got = [r.c for r in df.select(overlap.close_gap(F.col("g"), F.col("l"), F.col("r"), F.col("a"), F.col("b"), 200, 5.0).alias("c")).collect()]
    assert [(c.state, c.overlap, c.gap) for c in got] == [("merged", 9, 0.0), ("gap", 0, 30.0), ("break", 0, -570.0)]


def test_valid_mates(spark):
    rows = [(1, 1, 100, 1, 100, 0, 0), (1, 141, 100, 2, 100, 1, 0), (2, 1, 100, 3, 100, 0, 0), (2, 20, 100, 4, 100, 1, 0)]
    df = spark.createDataFrame(rows, "contig_id int, contig_pos int, matchlen int, rid bigint, seqlen int, orientation int, contig_end int")
    assert [r.frag for r in pairs.valid_mates(df, 240.0, 20.0).collect()] == [240]


def test_scratch_needs_a_shared_folder():
    from loomseq.functions.scratch import shared_dir

    class Conf:
        def __init__(self, **kw):
            self.kw = kw

        def get(self, name, default=None):
            return self.kw.get(name.split(".")[-1] if name != "spark.checkpoint.dir" else "dir", default)

    class Session:
        def __init__(self, **kw):
            self.conf = Conf(**kw)

    with pytest.raises(ValueError):
        shared_dir(Session(master="spark://host:7077"))
    assert shared_dir(Session(master="spark://host:7077", dir="hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(Session(master="local[4]")).startswith("file:")
