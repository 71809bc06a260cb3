import random
from collections import Counter

import numpy as np
import pytest

from loomseq.llm import heavy
from loomseq.llm.heavy import Code, Layout, heavy_hitters


@pytest.mark.parametrize("bits", [8, 48, 53, 56])
def test_code_round_trip(bits):
    code = Code(bits)
    v = np.random.default_rng(bits).integers(0, 1 << bits, 300, dtype=np.uint64)
    words = code.encode(v)
    for i in range(0, 300, 30):
        one = [[int(x)] for x in words[i]]
        assert code.decode(one).tolist() == [int(v[i])]
        two = [sorted({int(x), int(words[i + 1, j])} if j < 12 else {int(x)}) for j, x in enumerate(words[i])]
        assert int(v[i]) in code.decode(two).tolist()
    if bits > 16:
        assert code.decode([list(range(16))] * 16) is None
    assert code.decode([[1]] * 15 + [[]]).size == 0


def test_any_symbols_give_the_value():
    code = Code(48)
    v = np.array([0x123456789ABC], np.uint64)
    word = code.encode(v)[0]
    for wide in ([0, 1, 2], [5, 13, 15]):  # these positions hold other symbols too
        heavy_symbols = [sorted({int(x), (int(x) + 3) % 16, (int(x) + 7) % 16}) if j in wide else [int(x)] for j, x in enumerate(word)]
        assert code.decode(heavy_symbols).tolist() == v.tolist()


@pytest.mark.parametrize("share_ppm", [5_000, 100, 1_000_000])
def test_layout(share_ppm):
    layout = Layout(share_ppm, 2, 3)
    v = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 50).view(np.uint64)
    for rep in (0, 1):
        group, coded = layout.split(v, rep)
        assert [int(layout.join(int(g), coded[i : i + 1], rep)[0]) for i, g in enumerate(group)] == v.tolist()
    assert layout.reps * layout.groups * 256 * 4 <= 128 << 20


@pytest.mark.parametrize("tries,bits", [(1 << 16, None), (1, None), (200, 0)])
def test_hitters(spark, monkeypatch, tries, bits):
    """Few groups and few tries: found by peeling and further rounds."""
    monkeypatch.setattr(heavy, "_TRIES", tries)
    r = random.Random(tries)
    values = [x for x in range(-5, 60) for _ in range(r.randrange(1, 120))] + [r.getrandbits(62) for _ in range(4000)] + [None] * 500
    r.shuffle(values)
    df = spark.createDataFrame([(v, 1, "a") for v in values], "hashcode bigint, n_rows int, _v string").repartition(5)
    c = Counter(v for v in values if v is not None)
    want = {v: n for v, n in c.items() if n * 200 >= len(values)}
    got = {x.hashcode: x for x in heavy_hitters(df).collect()}
    assert {v: x.n_rows for v, x in got.items()} == want
    assert all(x.approx_rows >= x.n_rows and abs(x.share - x.n_rows / len(values)) < 1e-12 for x in got.values())


def test_ten_thousand_heavy_values(spark):
    """As many heavy values as the smallest share allows, in 128 MB of counters, one scan for the sketch."""
    n = 9_900
    df = spark.range(n * 100 + 10_000, numPartitions=2).selectExpr(f"if(id < {n} * 100, id % {n} * 7919, xxhash64(id)) as hashcode")
    got = heavy_hitters(df, share_ppm=100, reps=2)
    assert got.count() == n and got.where("n_rows <> 100 or approx_rows < 100 or hashcode % 7919 <> 0").count() == 0


def test_shares_that_are_refused(spark):
    df = spark.createDataFrame([(1,)], "hashcode bigint")
    for how in ({"share_ppm": 99}, {"share_ppm": 0}, {"reps": 3}):
        with pytest.raises(ValueError):
            heavy_hitters(df, **how)


def test_text_ties_empty(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",), ("b",), ("é" * 9000,)], "hashcode string")
    assert {r.hashcode for r in heavy_hitters(df, share_ppm=300_000).collect()} == {"a", "b"}
    assert heavy_hitters(spark.createDataFrame([], "hashcode bigint")).count() == 0
    assert heavy_hitters(spark.createDataFrame([(None,)] * 3, "hashcode bigint")).count() == 0
