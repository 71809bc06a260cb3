import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomseq.functions import bases, flat

TURN = str.maketrans("ACGT", "TGCA")


def code(s):
    return int("".join("0123"["ACGT".index(c)] for c in s) or "0", 4)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("ACGTNacgt", max_size=70), max_size=8), st.integers(1, 32))
def test_kmers(texts, k):
    codes, off = flat.flat_codes(pa.array(texts, pa.string()))
    ok = flat.window_ok(codes, off, k)
    got, rc = flat.kmers(codes, k), flat.rc_kmers(codes, k)
    want = []
    for t, o in zip(texts, off):
        for i in range(len(t) - k + 1):
            w = t[i : i + k].upper()
            if set(w) <= set("ACGT"):
                want.append((o + i, code(w), code(w.translate(TURN)[::-1])))
    assert [(i, int(got[i]), int(rc[i])) for i in np.flatnonzero(ok)] == want


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 99), max_size=40), st.integers(1, 20))
def test_sliding_min(xs, w):
    assert flat.sliding_min(np.array(xs, np.int64), w).tolist() == [min(xs[i : i + w]) for i in range(len(xs) - w + 1)]


def test_slices_and_nulls():
    arr = pa.array(["aa", None, "", "b" * 10, "c"], pa.string())
    b = pa.RecordBatch.from_arrays([arr], ["s"])
    assert [x.num_rows for x in flat.slices(iter([b]), "s", 3)] == [3, 1, 1]
    data, off = flat.flat_bytes(arr.slice(2))
    assert off.tolist() == [0, 0, 10, 11] and bytes(data) == b"b" * 10 + b"c"


def test_scalars(spark):
    r = random.Random(1)
    rows = [("".join(r.choices("ACGT", k=25)), "".join(r.choices("ACGT", k=25))) for _ in range(30)]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = F.col("a"), F.col("b")
    out = df.select("a", "b", bases.revcomp(bases.revcomp(a)).alias("same"), bases.unpack2(bases.pack2(a), 25).alias("unpacked"), bases.shift_hash(a, 15_728_681).alias("h"), bases.hamming(a, b).alias("d"), bases.is_homopolymer(a).alias("one"), bases.is_homopolymer(F.lit("AAAA")).alias("homo"))
    for x in out.collect():
        h = 5381
        for c in x.a:
            h = (h + ((h << 5) | "ACGT".index(c))) % (1 << 64)
        assert x.same == x.unpacked == x.a and x.h == h % 15_728_681
        assert x.d == sum(p != q for p, q in zip(x.a, x.b)) and not x.one and x.homo


def test_scalars_on_odd_text(spark):
    df = spark.createDataFrame([("",), (None,), ("ACN",)], "a string")
    out = [tuple(r) for r in df.select(bases.pack2(F.col("a")), bases.unknown_bases(F.col("a"))).collect()]
    assert out[0] == (None, 0) and out[1] == (None, None) and out[2] == (None, 1)


@pytest.mark.parametrize("n", [0, 5])
def test_ranges_runs(n):
    assert flat.ranges(np.array([3, 10]), np.array([2, n])).tolist() == [3, 4, *range(10, 10 + n)]
    assert flat.runs(np.array([1, 1, 2])).tolist() == [0, 2, 3]


def test_scratch_tables(spark):
    import os

    from loomseq.functions import scratch

    df = scratch.written(spark.range(5).toDF("x"), "t")
    path = scratch._tables[-1].removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path)
    scratch.cleanup(spark)
    assert not os.path.exists(path)
