import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomseq.llm import neardup
from loomseq.llm.neardup import near_groups, near_pairs

TURN = str.maketrans("ACGT", "TGCA")
TURN_ONE = dict(zip("ACGT", "CGTA"))


def words(s, k):
    out = set()
    for i in range(len(s) - k + 1):
        w = s[i : i + k]
        if set(w) <= set("ACGT"):
            out.add(min(w, w.translate(TURN)[::-1]))
    return out


def brute(recs, k, num, den):
    w = {i: words(s, k) for i, s in recs.items()}
    ids = sorted(w)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if w[a] & w[b] and len(w[a] & w[b]) * den >= len(w[a] | w[b]) * num}


def sample(seed, n, size, edits):
    r = random.Random(seed)
    base = ["".join(r.choices("ACGT", k=size)) for _ in range(12)]
    rows = []
    for i in range(n):
        s = list(r.choice(base))
        for _ in range(r.randrange(edits)):
            p = r.randrange(len(s))
            s[p] = r.choice(["A", "C", "g", "T", "", "AC", "N"])
        s = "".join(s)
        rows.append((i + 1, s.upper().translate(TURN)[::-1] if r.random() < 0.3 else s))
    return rows


@pytest.mark.parametrize("meet,hot", [((128, 240), 4096), ((1, 240), 4096), ((0, 0), 4096), ((128, 240), 3)])
def test_pairs(spark, monkeypatch, meet, hot):
    """By the tables of two values, of three, by the exact join, and by it for frequent values alone."""
    monkeypatch.setattr(neardup, "_MEET", meet)
    monkeypatch.setattr(neardup, "_HOT", hot)
    rows = [*sample(1, 120, 120, 5), (900, "A" * 60), (901, "T" * 30), (902, ""), (903, None), (904, "ACG"), (905, "N" * 50)]
    want = brute({i: s.upper() for i, s in rows if s is not None}, 12, 3, 5)
    df = spark.createDataFrame([(i, s, 1, 2) for i, s in rows], "id bigint, seq string, id_a int, n int")
    got = near_pairs(df, "id", "seq").collect()
    found = {(r.id_a, r.id_b) for r in got}
    assert len(found) == len(got) and found <= want
    assert len(found) >= 0.999 * len(want) and (900, 901) in found
    assert all(r.n_both * 5 >= r.n_either * 3 for r in got)


@pytest.mark.parametrize("num,den,per_word,pairs", [(3, 5, 100_000, 2 << 20), (4, 5, 7, 50), (1, 2, 3, 2 << 20)])
def test_exact_join(spark, monkeypatch, num, den, per_word, pairs):
    """With every record in the exact join no pair is lost, in blocks of a word too."""
    monkeypatch.setattr(neardup, "_MEET", (-1, -1))
    monkeypatch.setattr(neardup, "_HOT", 0)
    monkeypatch.setattr(neardup, "_PER_WORD", per_word)
    monkeypatch.setattr(neardup, "_PAIRS", pairs)
    rows = sample(5, 150, 100, 8) + [(1000 + i, s[: 40 + i]) for i, s in sample(6, 40, 90, 3)]
    want = brute({i: s.upper() for i, s in rows}, 12, num, den)
    recs = spark.createDataFrame([(i, s.upper()) for i, s in rows], "id bigint, seq string")
    pairs = {(r.id_a, r.id_b) for r in neardup._exact_join(recs.select("id"), recs, 12, num, den).collect()}
    assert want <= pairs
    assert {(r.id_a, r.id_b) for r in near_pairs(recs, "id", "seq", num=num, den=den).collect()} == want


@pytest.mark.parametrize("adapter", [45, 65, 68, 75])
def test_reads_that_share_an_adapter(spark, adapter):
    """No pairs are made of reads that share the adapter only, however much of them it is."""
    r = random.Random(adapter)
    ad = "".join(r.choices("ACGT", k=adapter))
    n = 6_000
    rows = [(i, ad + "".join(r.choices("ACGT", k=100 - adapter))) for i in range(1, n)]
    want = set()
    for i in range(300):
        s = rows[7 * i][1]
        p = r.randrange(100)
        t = s[:p] + TURN_ONE[s[p]] + s[p + 1 :]
        a, b = words(s, 12), words(t, 12)
        if len(a & b) * 5 >= len(a | b) * 3:
            want.add((rows[7 * i][0], 100_000 + i))
        rows.append((100_000 + i, t))
    df = spark.createDataFrame(rows, "id bigint, seq string")
    got = {(x.id_a, x.id_b) for x in neardup.candidates(neardup.records(df, "id", "seq", True)).collect()}
    assert len(want & got) >= 0.99 * len(want) > 100
    alike = {(x.id_a, x.id_b) for x in near_pairs(df, "id", "seq", True).collect()}  # with 75 letters those with 3 more in common
    assert want & got <= alike <= got and len(got - alike) < 20 * n


def test_empty_and_repeats(spark):
    assert near_pairs(spark.createDataFrame([], "id bigint, seq string"), "id", "seq").count() == 0
    s = "".join(random.Random(3).choices("ACGT", k=80))
    df = spark.createDataFrame([(5, s), (3, s.lower()), (3, s), (None, s), (8, s[:79])], "id bigint, seq string")
    assert [(r.id_a, r.id_b) for r in near_pairs(df, "id", "seq", merge_equal=True).collect()] == [(3, 8)]
    assert {(r.id_a, r.id_b) for r in near_pairs(df, "id", "seq").collect()} == {(3, 5), (3, 8), (5, 8)}


def test_groups(spark):
    rows = sample(9, 60, 120, 4) + [(500, "ACGT" * 3), (501, ""), (502, None), (503, sample(9, 60, 120, 4)[0][1])]
    df = spark.createDataFrame(rows, "id bigint, seq string")
    pairs = {(r.id_a, r.id_b) for r in near_pairs(df, "id", "seq", merge_equal=True).collect()}
    got = {r.rec_id: r for r in near_groups(df, "id", "seq", merge_equal=True).collect()}
    assert set(got) == {i for i, s in rows if s is not None}
    assert got[503].class_id == got[1].class_id and got[500].class_id == 500 and got[500].n_links == 0
    for a, b in pairs:
        assert got[a].class_id == got[b].class_id <= min(a, b)
    first = {}
    for i, t in sorted((i, t.upper()) for i, t in rows if t is not None):
        assert (got[i].class_id, got[i].n_links) == (got[first.setdefault(t, i)].class_id, got[first[t]].n_links)
    assert sum(got[i].n_links for i in first.values()) == 2 * len(pairs)


def test_unlikely_pairs_are_not_sent():
    """Of records that meet by chance only those pairs go on that can become candidates, and no candidate is lost."""
    r = random.Random(12)
    base = ["".join(r.choices("ACGT", k=100)) for _ in range(900)]
    seqs = base + [s[:50] + "".join(r.choices("ACGT", k=10)) + s[60:] for s in base[:60]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(seqs))), pa.array(seqs)], ["id", "seq"])
    sent = list(neardup._send(7, 10, 1, np.empty(0, np.int64))(iter([batch])))
    met = neardup._meet(10)(pa.Table.from_batches(sent))
    assert met.column("id_b").null_count == 0
    n_a = Counter(zip(met.column("id_a").to_pylist(), met.column("id_b").to_pylist()))
    n_b = dict(zip(n_a, [0] * len(n_a))) | {(a, b): n for a, b, n in zip(*(met.column(c).to_pylist() for c in ("id_a", "id_b", "n_b")))}
    _, sig = neardup._signature(*neardup.words(*neardup.flat_codes(batch.column("seq")), 7), 0, 26)
    low, want = (sig[10:] >> np.uint32(8)).astype(np.uint8), {}
    for a in range(len(seqs)):
        same_a, same_b = (np.count_nonzero(x[:, a : a + 1] == x[:, a + 1 :], axis=0) for x in (sig[:10], low))
        want |= {(a, a + 1 + int(j)): (int(same_a[j]), int(same_b[j])) for j in np.flatnonzero((same_a > 0) & (same_b >= 2) & (same_a + same_b >= 5))}
    assert {p: (n_a[p], n_b[p]) for p in n_a if n_a[p] + n_b[p] >= 5} == want and len(want) >= 60
    assert met.num_rows < 2 * sum(n for n, _ in want.values())
