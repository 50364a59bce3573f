import math
import random

import pytest

from netquarry.operators import grid

ARGS = dict(key=["d", "s"], step_key=["d"], start="f", end="t", value="v", step="step")
W = "d long, s string, f double, t double, v long, extra string"
S = "d long, step double, extra int"


def brute(rows, steps):
    step, cov = {}, {}
    for d, s, _ in steps:
        if d is not None and s and s > 0:
            step[d] = max(s, step.get(d, 0))
    for d, s, f, t, v, _ in rows:
        if None in (d, s, f, t, v) or not t > f or v < 0 or d not in step:
            continue
        for k in range(max(0, int(f / step[d]) - 2), int(t / step[d]) + 3):
            if f <= (k + 0.5) * step[d] < t:
                cov.setdefault((d, s), set()).add(k)
    return {(*key, k) for key, c in cov.items() for k in range(min(c), max(c)) if k not in c}


def test_missing_slots(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        f = rnd.choice([rnd.randrange(400) * 0.25, rnd.random() * 100])
        rows.append((rnd.choice([1, 1, 1, 2, None, 9]), rnd.choice(["a", "b", None]), f if rnd.random() > 0.05 else None, f + rnd.choice([0.3, 0.5, 1.0, 7.0, -1.0]), rnd.choice([0, 5, -1, None]), "x"))
    rows += rows[:50]
    steps = [(1, 0.5, 0), (1, 0.5, 0), (2, 0.25, 0), (3, None, 0)]
    got = grid.fill(spark.createDataFrame(rows, W), spark.createDataFrame(steps, S), **ARGS)
    found = [tuple(r) for r in got.select("d", "s", "slot").collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, steps)


def test_filled_values_follow_season_and_trend(spark):
    value = lambda k: 100 + 0.5 * k + 20 * math.sin(2 * math.pi * k / 24)
    rows = [(1, "a", float(k), k + 1.0, int(value(k) * 1000), "") for k in range(200) if not 90 <= k < 100]
    got = grid.fill(spark.createDataFrame(rows, W), spark.createDataFrame([(1, 1.0, 0)], S), **ARGS).collect()
    assert len(got) == 10
    assert all(abs(r.filled - value(r.slot) * 1000) < 100 for r in got)


@pytest.mark.parametrize("offset", [0, 10_000_000, 10_000_000_000])
@pytest.mark.parametrize("period", [24, 60])
def test_large_slots_cost_no_precision(spark, offset, period):
    value = lambda k: 30_000 + 0.5 * k + 20_000 * math.sin(2 * math.pi * k / period) + 3_000 * math.cos(4 * math.pi * k / period)
    rows = [(1, "a", float(offset + k), offset + k + 1.0, int(value(k)), "") for k in range(400) if not 150 <= k < 198]
    got = grid.fill(spark.createDataFrame(rows, W), spark.createDataFrame([(1, 1.0, 0)], S), **ARGS).collect()
    assert len(got) == 48 and max(abs(r.filled - value(r.slot - offset)) for r in got) < 200  # 1 % of the amplitude


def test_long_readings_count_by_their_slots(spark, monkeypatch):
    monkeypatch.setattr(grid, "BLOCK", 64)  # the sums of many blocks are moved to one start
    value = lambda k: 1000 + 300 * math.sin(2 * math.pi * k / 24)
    mean = lambda a, b: sum(value(k) for k in range(a, b)) / (b - a)
    rnd, rows, k = random.Random(5), [], 0
    while k < 2000:
        n = rnd.choice([1, 2, 5, 9])
        if rnd.random() > 0.2:
            rows.append((1, "a", float(k), float(k + n), round(mean(k, k + n) * n * 1000), ""))
        k += n
    got = grid.fill(spark.createDataFrame(rows, W), spark.createDataFrame([(1, 1.0, 0)], S), **ARGS).collect()
    assert len(got) > 100 and max(abs(r.predicted - value(r.slot) * 1000) for r in got) < 3000


def test_regression_is_in_the_plan(spark):
    import __spark_entry__ as entry

    assert "ArrowEvalPython" in entry.queries()["p1_found"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(grid, "BLOCK", 8)
    rows = [(1, "a", float(k), k + 1.0, 1, "") for k in (0, 1, 3, 30, 90)] + [(1, "a", 40.0, 60.0, 9, "")]
    w, s = spark.createDataFrame(rows, W), spark.createDataFrame([(1, 1.0, 0)], S)
    assert {r.slot for r in grid.fill(w, s, **ARGS).collect()} == {r[2] for r in brute(rows, [(1, 1.0, 0)])}
    assert grid.fill(w.limit(0), s, **ARGS).count() == 0
    full = grid.regular(w, s, **ARGS).collect()
    assert sorted(r.slot for r in full) == list(range(91)) and sum(not r.missing for r in full) == 25
