import random
from collections import defaultdict

import pytest

from loomseq.llm import spans
from loomseq.llm.spans import shared_portion, shared_spans, span_classes


def brute(recs, m):
    where = defaultdict(set)
    for i, s in recs.items():
        for p in range(len(s) - m + 1):
            where[s[p : p + m]].add(i)
    out = set()
    for i, s in recs.items():
        hit = [False] * (len(s) + 2)
        for p in range(len(s) - m + 1):
            w = s[p : p + m]
            if set(w) <= set("ACGT") and len(where[w]) > 1:
                hit[p + 1 : p + m + 1] = [True] * m
        p = 1
        while p <= len(s):
            if hit[p]:
                q = p
                while hit[q + 1]:
                    q += 1
                out.add((i, p, q))
                p = q
            p += 1
    return out


def sample(seed, n, size):
    r = random.Random(seed)
    base = ["".join(r.choices("ACGT", k=size)) for _ in range(6)]
    out = []
    for i in range(n):
        s = list(r.choice(base)[r.randrange(20) : size - r.randrange(20)])
        for _ in range(r.randrange(4)):
            s[r.randrange(len(s))] = r.choice("ACGTNacgt.")
        out.append((i + 1, "".join(s)))
    return out


@pytest.mark.parametrize("min_len,full", [(12, None), (33, None), (40, None), (64, None), (40, 3)])
def test_spans(spark, monkeypatch, min_len, full):
    if full:  # every bucket counts as too full
        monkeypatch.setattr(spans, "_FULL", full)
    rows = [*sample(min_len, 60, 150), (900, "A" * 200), (901, "a" * 90), (902, ""), (903, None), (904, "ACGT"), (905, "AC" * 70), (906, "CA" * 50)]
    want = brute({i: s.upper() for i, s in rows if s is not None}, min_len)
    df = spark.createDataFrame([(i, s, "x", 7) for i, s in rows], "id bigint, seq string, from_pos string, lo int")
    got = shared_spans(df, "id", "seq", min_len)
    assert {tuple(r) for r in got.collect()} == want
    portion = {r.rec_id: r.n_shared for r in shared_portion(df, "id", "seq", min_len).collect()}
    assert portion == {i: sum(b - a + 1 for j, a, b in want if j == i) for i, s in rows if s is not None}
    up = {}
    for s in range(len(rows)):
        for t in range(s):
            a, b = (rows[i][1].upper() if rows[i][1] else "" for i in (s, t))
            wa, wb = ({x[p : p + min_len] for p in range(len(x) - min_len + 1) if set(x[p : p + min_len]) <= set("ACGT")} for x in (a, b))
            if wa & wb:
                up.setdefault(rows[s][0], set()).add(rows[t][0])
                up.setdefault(rows[t][0], set()).add(rows[s][0])
    classes = {}
    for i in sorted(up):
        todo = [i] if i not in classes else []
        while todo:
            j = todo.pop()
            if j not in classes:
                classes[j] = i
                todo += up[j]
    assert {r.rec_id: r.class_id for r in span_classes(df, "id", "seq", min_len).collect()} == classes


def test_bands():
    """Whole equality needs one band; less similarity needs more bands for the same recall, or fewer rows."""
    assert spans.tune_bands(10**9, 40, 16)[0] == 1
    assert spans.tune_bands(10**6, 40, 16) == (1, 1)
    assert spans.tune_bands(10**12, 40, 16) == (1, 2)  # words meet by chance: a row is added
    for sim, recall in ((0.9, 0.99), (0.8, 0.999), (0.5, 0.9)):
        b, r = spans.tune_bands(10**9, 40, 16, sim, recall)
        assert 1 - (1 - sim**r) ** b >= recall


@pytest.mark.parametrize("bands", [(1, 3), (2, 2)])
def test_any_bands(spark, monkeypatch, bands):
    monkeypatch.setattr(spans, "tune_bands", lambda *a: bands)
    rows = sample(3, 50, 130)
    df = spark.createDataFrame(rows, "id bigint, seq string")
    assert {tuple(r) for r in shared_spans(df, "id", "seq", 40).collect()} == brute({i: s.upper() for i, s in rows}, 40)


def test_equal_texts_are_one(spark):
    s = "".join(random.Random(3).choices("ACGT", k=80))
    df = spark.createDataFrame([(5, s), (3, s.lower()), (9, s), (None, s)], "id bigint, seq string")
    assert shared_spans(df, "id", "seq", 40, merge_equal=True).count() == 0
    df = df.union(spark.createDataFrame([(1, "T" + s[:50] + "A" if s[50] != "A" else "T" + s[:50] + "C")], df.schema))
    assert {r.rec_id for r in shared_spans(df, "id", "seq", 40, merge_equal=True).collect()} == {1, 3}


def test_empty_and_long(spark):
    assert shared_spans(spark.createDataFrame([], "id bigint, seq string"), "id", "seq", 40).count() == 0
    s = "".join(random.Random(4).choices("ACGT", k=2_500_000))
    df = spark.createDataFrame([(1, s), (2, s[1_000_000:1_000_100]), (3, s[2_400_000:] + "N" + s[:60])], "id bigint, seq string")
    assert {tuple(r) for r in shared_spans(df, "id", "seq", 60).collect()} == {(1, 1, 60), (1, 1_000_001, 1_000_100), (1, 2_400_001, 2_500_000), (2, 1, 100), (3, 1, 100_000), (3, 100_002, 100_061)}


@pytest.mark.parametrize("min_len", [16, 40])
def test_full_bucket_repeats_in_own_block(spark, monkeypatch, min_len):
    """Each record is a block of its own, every bucket too full: all places of a repeat count, not the first alone."""
    monkeypatch.setattr(spans, "_FULL", 0)
    r = random.Random(5)
    rep, *other = ("".join(r.choices("ACGT", k=90)) for _ in range(7))
    rows = [(1, other[0] + rep + other[1] + rep + other[2] + rep), (2, rep[5:80] + other[3] + rep[:60]), (3, "A" * 150 + other[4]), (4, "A" * 60 + "C" + "A" * 70), (5, other[5] * 2)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        df = spark.createDataFrame(rows, "id bigint, seq string")
        assert {tuple(x) for x in shared_spans(df, "id", "seq", min_len).collect()} == brute(dict(rows), min_len)
        assert {x.rec_id: x.class_id for x in span_classes(df, "id", "seq", min_len).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
