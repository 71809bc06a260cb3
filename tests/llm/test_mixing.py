import pytest

from loomseq.llm.mixing import mix

DOC = "doc_id bigint, text string, source string, no int, h bigint"
GOAL = "source string, weight double, max_repeats int"


def data(spark):
    docs = [(i, "x" * (50 + i * 37 % 100), "big", None, None) for i in range(3000)]
    docs += [(10_000 + i, "y" * (20 + i * 13 % 60), "small", None, None) for i in range(300)]
    docs += [(20_000 + i, "z" * 30, "tiny", None, None) for i in range(5)]
    docs += [(30_000, None, "big", None, None), (30_001, "q", None, None, None), (30_002, "q", "other", None, None)]
    return spark.createDataFrame(docs, DOC), spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 20), ("tiny", 0.08, 2), ("none", 0.02, 9)], GOAL)


def test_shares(spark):
    docs, goals = data(spark)
    got, report = mix(docs, goals, block=2048)
    rep = {r.source: r for r in report.collect()}
    size = {"big": sum(51 + i * 37 % 100 for i in range(3000)), "small": sum(21 + i * 13 % 60 for i in range(300)), "tiny": 155, "none": 0}
    total = sum(size.values())
    for s, r in rep.items():
        assert r.n_tokens == size[s] and r.short == (size[s] * r.max_repeats < r.weight * total)
        if not r.short:
            assert abs(r.used_tokens / total - r.weight) < 0.02
    assert rep["tiny"].used_tokens <= 2 * 155 and rep["tiny"].short and rep["none"].used_tokens == 0
    assert abs(sum(r.share for r in rep.values()) - 1) < 1e-9
    rows = got.collect()
    used = {}
    for r in rows:
        used[r.source, r.doc_id] = used.get((r.source, r.doc_id), 0) + 1
    limit = {"big": 1, "small": 20, "tiny": 2}
    assert all(n <= limit[s] for (s, _), n in used.items())
    assert len({(r.doc_id, r.pass_no) for r in rows}) == len(rows)
    n = max(r.slot for r in rows) + 1  # any stretch of slots keeps near the weights
    first = {r.slot for r in rows if r.source == "big" and r.slot < n // 2}
    assert abs(len(first) / (n // 2) - 0.5) < 0.05


def test_same_again(spark):
    docs, goals = data(spark)
    a, b = (sorted(map(tuple, mix(docs.repartition(n), goals, block=4096)[0].collect())) for n in (1, 7))
    assert a == b


def test_empty_and_odd(spark):
    docs, goals = data(spark)
    none = spark.createDataFrame([], DOC)
    assert mix(none, goals)[0].count() == 0
    assert {r.source: r.n_tokens for r in mix(none, goals)[1].collect()} == dict.fromkeys(["big", "small", "tiny", "none"], 0)
    assert mix(docs, spark.createDataFrame([], GOAL))[0].count() == 0
    odd = spark.createDataFrame([("big", None, None), ("small", 1.0, 3), (None, 0.1, 1)], GOAL)
    rep = {r.source: r for r in mix(docs, odd, block=2048)[1].collect()}
    assert rep["big"].used_tokens == 0 and rep["small"].used_tokens > 0
    with pytest.raises(ValueError):
        mix(docs, spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 1)], GOAL))


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a" * 99, "s", None, None)] * 50, DOC)
    got, rep = mix(docs, spark.createDataFrame([("s", 1.0, 1)], GOAL), block=2048)
    assert got.count() == 50 and rep.first().used_tokens == 5000
