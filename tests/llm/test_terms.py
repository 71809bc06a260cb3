from collections import Counter, defaultdict

import pytest

from loomseq.llm.terms import term_counts

SCHEMA = "rid bigint, arrival_no bigint, seq string, hashcode bigint, mark string, n int"
ROWS = [
    (1, 1, "ACGTACGTACGT", 5, "x", 1),
    (1, 9, "ACGTACGTACGT", 5, "x", 1),
    (2, 2, "acgtNacgtacg", None, None, 1),
    (3, 3, "", 7, None, 1),
    (4, 4, None, 7, None, 1),
    (5, 5, "AAAAAAAAAAAAAAAAAAAA", 5, None, None),
    (None, 6, "CC", 8, None, None),
    (6, None, "GATTACA", -3, None, None),
]


def brute(rows, sigma):
    recs = {}
    for rid, no, seq, key, *_ in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0)):
        if seq is not None:
            recs.setdefault(rid, (seq.upper(), key))
    occ, held = Counter(), defaultdict(set)
    for rid, (seq, key) in recs.items():
        for n in range(1, sigma + 1):
            for i in range(len(seq) - n + 1):
                if set(seq[i : i + n]) <= set("ACGT"):
                    occ["seq", seq[i : i + n]] += 1
                    held["seq", seq[i : i + n]].add(rid)
        if key is not None:
            occ["hashcode", str(key)] += 1
            held["hashcode", str(key)].add(rid)
    return {k: (n, len(held[k])) for k, n in occ.items()}, len(recs)


@pytest.mark.parametrize("sigma", [1, 3, 8, 12])
def test_counts(spark, sigma):
    want, total = brute(ROWS, sigma)
    got = term_counts(spark.createDataFrame(ROWS, SCHEMA), sigma=sigma).collect()
    assert {(r.field, r.term): (r.n_occ, r.n_records) for r in got} == want
    assert all(r.total == total for r in got)
    assert all(r.n == (len(r.term) if r.field == "seq" else 0) for r in got)


def test_marks(spark):
    rows = [(i, i, "AC" if i < 51 else "GG", 1 if i < 30 else i, None, None) for i in range(1, 5001)]
    got = {(r.field, r.term): r.mark for r in term_counts(spark.createDataFrame(rows, SCHEMA), sigma=2).collect()}
    assert got["seq", "AC"] is None  # 50 of 5,000 are exactly 1 %
    assert got["seq", "GG"] == "common"
    assert got["hashcode", "1"] is None and got["hashcode", "77"] == "rare"


@pytest.mark.parametrize("held,per_route", [(1 << 21, 1 << 21), (3, 1)])
def test_words(spark, monkeypatch, held, per_route):
    """Phrases of words; with many groups and small blocks too."""
    import random

    from loomseq.llm import terms

    monkeypatch.setattr(terms, "_HELD", held)
    monkeypatch.setattr(terms, "_PER_ROUTE", per_route)
    r = random.Random(4)
    texts = [" ".join(r.choices(["the", "cat", "sat", "Ünïcode", "x", "a"], k=r.randrange(9))) for _ in range(60)] + ["", "  ", " a\n\tb  the ", "the " * 300, None]
    occ, held_by = Counter(), defaultdict(set)
    for i, t in enumerate(texts):
        w = (t or "").split()
        for n in range(1, 4):
            for p in range(len(w) - n + 1):
                occ[" ".join(w[p : p + n])] += 1
                held_by[" ".join(w[p : p + n])].add(i)
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in enumerate(texts)], "doc_id bigint, text string, n int, term string").repartition(3)
    got = terms.word_counts(df).collect()
    assert {x.term: (x.n_occ, x.n_records) for x in got} == {t: (n, len(held_by[t])) for t, n in occ.items()}
    assert len(got) == len(occ) and all(x.total == 64 and x.n == len(x.term.split(" ")) for x in got)
    assert terms.word_counts(df.limit(0)).count() == 0


def test_empty(spark):
    assert term_counts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_text(spark):
    got = term_counts(spark.createDataFrame([(1, 1, "ACGT" * 1_000_000, None, None, None)], SCHEMA), sigma=4)
    assert {r.term: r.n_occ for r in got.where("n = 4").collect()} == {"ACGT": 1_000_000, "CGTA": 999_999, "GTAC": 999_999, "TACG": 999_999}
