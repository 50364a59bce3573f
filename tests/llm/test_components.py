import random

import pytest

from netquarry.llm import components as C


def brute(pairs):
    up = {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is None or b is None:
            continue
        up.setdefault(a, a)
        up.setdefault(b, b)
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def run(spark, pairs):
    got = C.components(spark.createDataFrame([(*p, "x") for p in pairs], "a string, b string, component string")).collect()
    assert len(got) == len({r.node for r in got})
    return {r.node: r.component for r in got}


@pytest.mark.parametrize("chunk", [1_000_000, 7])
def test_shapes(spark, monkeypatch, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(chunk, 10_000))
    rnd = random.Random(2)
    n = lambda k: f"n{k:03d}"
    pairs = [(n(k), n(k + 1)) for k in range(60)] + [(n(100), n(k)) for k in range(101, 160)] + [(n(k), n(299)) for k in range(200, 260)]
    pairs += [(n(rnd.randrange(400, 500)), n(rnd.randrange(400, 500))) for _ in range(60)] + [(n(700), n(700)), (None, n(1)), (n(1), None)]
    pairs += pairs[:30] + [(b, a) for a, b in pairs[:30]]
    rnd.shuffle(pairs)
    try:
        assert run(spark, pairs) == brute(pairs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_and_self(spark):
    assert run(spark, []) == {}
    assert run(spark, [("a", "a")]) == {"a": "a"}


def test_net_groups(spark):
    rows = [(1, "b\\[1\\] ", "c"), (1, "c", "d"), (2, "c", "a"), (1, "1'b0", "d"), (1, None, "d"), (1, "", "x"), (1, "é", "Z"), (3, "s", "s"), (None, "p", "q")]
    got = C.net_groups(spark.createDataFrame(rows, "src_id long, lhs string, rhs string")).collect()
    assert {tuple(r) for r in got} == {(1, "b[1]", "b[1]"), (1, "b[1]", "c"), (1, "b[1]", "d"), (2, "a", "a"), (2, "a", "c"), (1, "Z", "é"), (1, "Z", "Z"), (3, "s", "s")}
