import random

import numpy as np
import pytest

from loomseq.llm import packing
from loomseq.llm.packing import fill_report, hilbert, pack


def test_hilbert_is_a_walk():
    side = 8
    pts = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    key = hilbert(pts, 3)
    assert sorted(key.tolist()) == list(range(side**3))
    walk = pts[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("capacity,per_task", [(64, 2000), (64, 3), (1, 2000), (2048, 2000)])
def test_pack(spark, monkeypatch, capacity, per_task):
    monkeypatch.setattr(packing, "_PER_TASK", per_task)
    r = random.Random(5)
    rows = [(i, "".join(r.choices("abcdé €", k=r.choice([0, 3, 20, 63, 64, 200])))) for i in range(400)] + [(7, "x"), (7, "x"), (None, "y"), (8, None), (9, "z" * 5000)]
    df = spark.createDataFrame([(i, t, 3, 4) for i, t in rows], "doc_id bigint, text string, size int, item int")
    got = pack(df, capacity=capacity).collect()
    load = {}
    for x in got:
        load[x.container] = load.get(x.container, 0) + x.n_tokens
    assert max(load.values()) <= capacity
    size = sorted((i if i is not None else -1, len(t.encode()) + 1) for i, t in rows if t is not None)
    back = {}
    for x in got:
        assert x.n_pieces == 1 or x.n_tokens == capacity or x.piece == x.n_pieces
        assert x.from_token == (x.piece - 1) * capacity
    whole = sorted((x.doc_id if x.doc_id is not None else -1, x.from_token + x.n_tokens) for x in got if x.piece == x.n_pieces)
    assert whole == size
    assert sum(load.values()) == sum(s for _, s in size)
    assert all((x.n_pieces > 1) == (x.from_token + x.n_tokens > capacity or x.piece < x.n_pieces) for x in got)


def test_little_space_left(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert fill_report(pack(docs)).first().unused_share < 0.02


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert pack(df).count() == 0
    assert fill_report(pack(df)).first().n_containers == 0


def test_neighbours_share_containers(spark):
    """Texts of one kind lie together along the curve: they share containers more often than chance has it."""
    r = random.Random(3)
    kinds = [r.choices("abcdefghijklmnopqrstuvwxyz ", k=30) for _ in range(8)]
    rows = [(i, "".join(r.choice(kinds[i % 8]) if r.random() < 0.02 else kinds[i % 8][j % 30] for j in range(r.randrange(80, 300)))) for i in range(3000)]
    got = pack(spark.createDataFrame(rows, "doc_id bigint, text string"), capacity=2048).collect()
    boxes = {}
    for x in got:
        boxes.setdefault(x.container, []).append(x.doc_id % 8)
    pairs = [(a == b) for ks in boxes.values() for i, a in enumerate(ks) for b in ks[i + 1 :]]
    assert sum(pairs) / len(pairs) > 2 / 8
