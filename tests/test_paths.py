import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomseq.operators import active, assemble, paths, votes
from loomseq.operators.paths import Followed, Path, Tandem
from loomseq.params import DEFAULT


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text("ACGT", min_size=1, max_size=6), st.integers(1, 9)), max_size=12))
def test_merging_keeps_support(tails):
    got = paths.by_prefix(tails)
    assert sum(n for _, n in got) == sum(n for _, n in tails)
    assert all(any(t.startswith(s) for t, _ in got) for s, _ in tails)
    assert not any(a != b and a.startswith(b) for a, _ in got for b, _ in got)


def test_equal_support_stays_apart():
    assert len(paths.by_prefix([("ACGT", 3), ("AC", 3)], merge_equal=False)) == 2
    assert paths.by_prefix([("ACGT", 3), ("ACCT", 1)], mismatches=1) == [("ACGT", 4)]


def test_correction_and_decision():
    assert paths.corrected([("ACG", 11), ("ATG", 1)]) == [("ACG", 11), ("ACG", 1)]
    assert paths.decide([("ACG", 11), ("ATG", 1)]) == ("A", 0, True)
    assert paths.decide([("ACGTA", 6), ("CATGC", 5)]) == ("A", 5, False)
    assert paths.decide([]) == (None, 0, False)
    assert paths.shift_of("ACGTACGT", "GTACGTAA", mismatches=1) == (2, 1, 0)
    assert paths.shift_of("GTACGTAA", "ACGTACGT") == (2, 1, 1) and paths.shift_of("GGGGTTTT", "ACGGGGTT", mismatches=0) == (2, 2, 0)
    assert paths.shift_of("A", "CC", mismatches=0) is None and paths.shift_of("", "A") is None


def test_followed_path():
    f = Followed().refresh([(1, "ACGT" * 80, 60), (2, "ACGT" * 60, 70), (3, "CCCC", 60)], 100)
    assert f.chosen.startswith("ACGT") and [p.support for p in f.paths] == [2]
    for b in "ACGT" * 50:
        assert f.decide(True) is None
        f = f.step(b)
    assert f.navi == 200 and f.decide(True) == "A"
    f = f.step("T")
    assert f.navi == 0 and f.pre_navi == 200 and f.decide(True) is None
    two = Followed(paths=(Path("A", 10), Path("C", 5)), chosen="A", navi=300)
    assert two.decide(True) == "A" and two.decide(False) is None


def test_tandem():
    got = paths.tandem_paths([("ACGTAC", 4, 200.0), ("CGTACC", 3, 210.0), ("ACGTGG", 4, 500.0)])
    assert [(t.seq, t.support, t.frag) for t in got] == [("ACGTAC", 2, 205.0), ("ACGTGG", 1, 500.0)]
    kept = paths.prune_tandem([Tandem("ACGTAC", 4, 3, 205.0), Tandem("ACGTGG", 4, 1, 900.0), Tandem("TTTTTT", 4, 1)], "GGACGT", 200.0, 20.0)
    assert [t.seq for t in kept] == ["ACGTAC"]
    assert paths.tandem_decision(kept) == ("A", True)
    assert paths.tandem_decision([]) == (None, False)


def test_status(spark):
    rows = [(1, 1, 0, 4, 90, 100, 100, 1.0, 500), (1, 2, 0, 0, 50, 50, 100, 1.0, 500), (1, 3, 0, 1, 99, 100, 100, 1.0, 500), (1, 3, 1, 0, 100, 100, 100, 1.0, 500), (1, 4, 0, 2, 98, 100, 100, 2.0, 500), (1, 5, 0, 0, 80, 100, 100, 1.0, 500)]
    df = spark.createDataFrame(rows, "contig_id int, rid bigint, orientation int, mismatches int, matched int, base_pos int, seqlen int, ratio double, contig_len int")
    got = {(r.rid, r.orientation): r.status for r in active.settle(df).collect()}
    assert got == {(1, 0): "failed", (2, 0): "assembling", (3, 0): "failed", (3, 1): "success", (4, 0): "failed", (5, 0): "failed"}
    mates = active.unmate_failed(active.settle(df).withColumn("mated", F.lit(True))).where("rid = 2").first()
    assert mates.mated is False
    best = active.best_row(df.withColumns({"tail_errors": F.lit(0), "bare_prefix": F.lit(0), "tail_len": F.lit(1)}))
    assert best.where("rid = 3").first().orientation == 1


@pytest.mark.parametrize("change,rule", [({}, None), ({"c_30_single": 30}, 1), ({"length": 5000, "c_50_pe": 0, "c_50_se": 1}, 2), ({"length": 900, "c_65_pe": 0}, 3), ({"length": 900, "c_l_60": 3}, 4), ({"tail": 41, "ratio": 0.5, "runs_2l": 3}, 5), ({"tail": 41, "ratio": 2.5, "c_2l_50": 2, "runs_2l": 2}, 6), ({"tail": 51, "ratio": 0.65, "c_l_25": 1}, 7), ({"length": 5000, "n_paths": 2, "tail": 21, "path_max": 1, "path_second": 3, "path_left": 5}, 8), ({"length": 5000, "n_paths": 3, "c_3l_20": 5, "c_h_25": 2}, 14), ({"single_pe": True, "n_paths": 3, "path_agrees": False, "path_share": 0.5}, 18)])
def test_stop_rules(spark, change, rule):
    names = "c_30_single c_50_se c_l_60 c_l_close c_l_25 c_2l_50 c_l_80 c_l_30 c_l_70 c_2l_30 c_4l_20 c_3l_20 c_h_25 c_l_30b c_l_75 c_l_40 runs_l runs_2l runs_4l pe_sec".split()
    row = dict.fromkeys(names, 0) | {"c_50_pe": 50, "c_65_pe": 65, "mean_50": 2.0, "pe_max": 9} | active.STATE | change
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()])
    assert df.select(active.stop_rule(100, 4.0, 240, 300).alias("r")).first().r == rule


def test_window_counts(spark):
    rows = [(1, p, 0 if p > 40 else 3, 2 if p == 30 else 0, 1 if p > 40 else 4, 0, p in (5, 40)) for p in range(1, 81)]
    df = spark.createDataFrame(rows, "contig_id int, pos int, pe_max int, pe_sec int, se_max int, se_sec int, covered boolean")
    got = {r.pos: r for r in active.window_counts(df, 100).collect()}
    assert got[80].c_30_single == 30 and got[45].c_30_single == 5 and got[80].c_l_60 == 1 and got[80].runs_l == 1 and got[39].runs_l == 0


def test_kernel_fit(spark):
    rows = [([float(a), float(b)], 1 if a + b > 9 else -1) for a in range(10) for b in range(10) if a + b != 9]
    m = votes.fit_kernel(rows, "linear", 200)
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "f array<double>, want int")
    wrong = df.where((votes.decision_score(F.col("f"), m, "linear") >= 0) != (F.col("want") > 0)).count()
    assert wrong <= 4


def test_more_than_twenty_candidate_paths(spark):
    """20 tails of two reads say A, 45 of one read say C: all of them vote, in the query and in the assembly."""
    codes = ["".join(x) for x in itertools.product("ACGT", repeat=4)]
    tails = [("A" + c, 2) for c in codes[::12][:20]] + [("C" + c, 1) for c in codes[::5][:45]]
    rows = [(1, t) for t, n in tails for _ in range(n)]
    got = paths.candidate_paths(spark.createDataFrame(rows, "key bigint, tail string")).collect()
    assert len(got) == 65 and sum(r.support for r in got) == 85 and {r.first_base for r in got} == {"C"}
    whole = assemble.Assembler(list(range(1, 86)), ["ACGT" * 9 + t for _, t in rows], DEFAULT)
    found = whole.paths([[i, 0, 36, 0, 36, 0] for i in range(85)])
    assert len(found) == 65 and sum(n for _, n in found) == 85
