import random

import numpy as np
import pytest

from loomseq.functions.flat import mix64, unmix64
from loomseq.llm import seen
from loomseq.llm.seen import EliasFano, error_rate, seen_before


@pytest.mark.parametrize("n,bits", [(0, 64), (1, 64), (2, 8), (200, 8), (1000, 20), (5000, 64), (70_000, 64), (3000, 12)])
def test_elias_fano(n, bits):
    rng = np.random.default_rng(n)
    top = 1 << bits
    x = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=False) if bits < 64 else mix64(rng.integers(0, 1 << 63, n, dtype=np.uint64)))
    f = EliasFano(x, bits)
    assert (f.all() == x).all()
    ask = np.concatenate([x, x + np.uint64(1), rng.integers(0, top - 1, 500, dtype=np.uint64), np.array([0, top - 1], np.uint64)])
    ask = ask[ask < top] if bits < 64 else ask
    at = np.searchsorted(x, ask)
    word, there = f.successor(ask)
    assert (there == (at < x.size)).all()
    assert (word[there] == x[at[there]]).all()
    assert (f.has(ask) == np.isin(ask, x)).all()
    if n > 4000:
        assert f.nbytes() < 8 * n * 0.95


def test_clustered():
    x = np.unique(np.concatenate([np.arange(5000, dtype=np.uint64), np.array([1 << 63, (1 << 63) + 1], np.uint64)]))
    f = EliasFano(x)
    assert (f.all() == x).all() and f.has(x).all() and not f.has(x[-2:] + np.uint64(2)).any()


def test_mixing_is_a_bijection():
    x = np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert (unmix64(mix64(x)) == x).all()


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_seen(spark, monkeypatch, block):
    monkeypatch.setattr(seen, "_BLOCK", block)
    r = random.Random(2)
    rows = [(i, r.choice([1, 1, 1, -7, None, r.randrange(400), 1 << 62])) for i in range(1500)]
    r.shuffle(rows)
    known = [5, 5, None, 399]
    df = spark.createDataFrame([(a, k, True, 1) for a, k in rows], "arrival_no bigint, hashcode bigint, known boolean, part int").repartition(6)
    got = {x.arrival_no: x.seen for x in seen_before(df, spark.createDataFrame([(k,) for k in known], "hashcode bigint")).collect()}
    old, want = set(known), {}
    for a, k in sorted(rows, key=lambda x: x[0]):
        if k is not None:
            want[a] = k in old
            old.add(k)
    assert got == want


def test_rate_and_empty(spark):
    df = spark.range(20_000).selectExpr("id as arrival_no", "id * 7919 as hashcode")
    exact = error_rate(df, bits=64).first()
    assert (exact.n_rows, exact.n_seen, exact.n_wrong) == (20_000, 0, 0)
    rough = error_rate(df, bits=20).first()
    assert 0 < rough.wrong_rate < 0.05
    none = spark.createDataFrame([], "arrival_no bigint, hashcode bigint")
    assert seen_before(none).count() == 0 and error_rate(none).first().n_rows == 0


@pytest.mark.parametrize("bits", [64, 24])
def test_store_outlives_a_run(spark, tmp_path, bits):
    """Two batches against a store that was saved after the first one give what one run over both gives."""
    r = random.Random(9)
    rows = [(i, r.choice([1, r.randrange(300), r.getrandbits(60), None])) for i in range(4000)]
    df = spark.createDataFrame(rows, "arrival_no bigint, hashcode bigint")
    first, second = df.where("arrival_no < 1500"), df.where("arrival_no >= 1500")
    a, b, c = (str(tmp_path / x) for x in "abc")
    seen.save_store(first, a, bits=bits, n_parts=7)
    whole = {x.arrival_no: x.seen for x in seen_before(df, bits=bits).collect()}
    got = {x.arrival_no: x.seen for x in seen_before(second, bits=bits, store=a).collect()}
    assert got == {i: s for i, s in whole.items() if i >= 1500} and any(got.values())
    seen.save_store(second, b, bits=bits, store=a)
    seen.save_store(df, c, bits=bits, n_parts=7)
    assert [tuple(x) for x in spark.read.parquet(b).orderBy("part").collect()] == [tuple(x) for x in spark.read.parquet(c).orderBy("part").collect()]
    assert spark.read.parquet(a).count() == 7
    with pytest.raises(ValueError):
        seen_before(second, bits=32, store=a)


def test_partitions_are_spread(spark):
    """Partition p is task p: none is empty while another holds several."""
    rows = spark.range(6_000).selectExpr("id as arrival_no", "id as hashcode", "id % 17 as part", "false as known", "id as no")
    sizes = [x["count"] for x in seen._spread(rows.withColumn("part", rows["part"].cast("int")), 17).selectExpr("spark_partition_id() as p").groupBy("p").count().collect()]
    assert len(sizes) == 17 and max(sizes) - min(sizes) <= 1
