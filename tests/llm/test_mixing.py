import itertools

import pytest

from netquarry.llm import mixing as M

pytest.importorskip("tiktoken")
DOC = "doc_id long, source string, text string, copies long"
TARGET = "source string, weight double, max_repeats int"


def test_flow_is_cheapest():
    supply = {("a",): 4, ("a", "b"): 6, ("b",): 2}
    quota, repeats = {"a": 8, "b": 9}, {"a": 2, "b": 3}
    got = M.min_cost_flow(supply, quota, repeats)
    sent = {s: sum(n for (_, x), n in got.items() if x == s) for s in quota}
    assert sent == quota

    def cost(flow):
        total = 0
        for p, n in supply.items():
            use = sum(v for (q, _), v in flow.items() if q == p)
            k = 0
            while use > 0:
                total += k * min(n, use)
                use -= n
                k += 1
        return total

    best = 1 << 30
    for a, ab_a, ab_b in itertools.product(range(9), range(13), range(19)):
        b = 9 - ab_b
        if a + ab_a == 8 and 0 <= b <= 6 and a <= 8 and ab_a <= 12 and ab_b <= 18:
            best = min(best, cost({(("a",), "a"): a, (("a", "b"), "a"): ab_a, (("a", "b"), "b"): ab_b, (("b",), "b"): b}))
    assert cost(got) == best
    assert M.min_cost_flow({}, quota, repeats) == {}


def test_mixture(spark):
    docs = [(i, ["Big", " small ", "SMALL", "other", None][i % 5], f"def f{i}(x): return x + {i}", 9) for i in range(200)] + [(900, "big", "", 9), (901, "big", None, 9)]
    docs += docs[:20] + [(902, "small", docs[0][2], 9)]
    d = spark.createDataFrame(docs, DOC)
    t = spark.createDataFrame([("big", 50.0, 1), ("Small ", 50.0, 3), ("absent", 0.0, 4), (None, 5.0, 1)], TARGET)
    mixed, report = M.mix(d, t, total_tokens=800)
    rows = mixed.collect()
    r = {x.source: x for x in report.collect()}
    assert set(r) == {"big", "small"} and len(rows) == len({(x.doc_id, x.source) for x in rows})
    assert {x.source for x in rows} == {"big", "small"} and not {900, 901} & {x.doc_id for x in rows}
    for s in r:
        assert abs(r[s].tokens - 400) < 20 and r[s].tokens == sum(x.copies * x.n_tokens for x in rows if x.source == s)
    again = {tuple(x) for x in M.mix(d, t, total_tokens=800)[0].collect()}
    assert again == {tuple(x) for x in rows}
    mixed, report = M.mix(d, t, total_tokens=10**6)  # beyond reach: every record as often as allowed
    r = {x.source: x for x in report.collect()}
    assert r["big"].shortfall_tokens == r["big"].quota_tokens - r["big"].tokens > 0 and r["big"].reachable_tokens == r["big"].held_tokens
    assert r["big"].tokens == r["big"].held_tokens and r["small"].most_copies == 3 and r["small"].tokens == 3 * r["small"].held_tokens
    assert M.mix(d.limit(0), t)[0].count() == 0 and M.mix(d, t.limit(0))[0].count() == 0


def test_sources_of_one_pattern_share_its_records(spark):
    text = lambda i: f"def shared_{i}(x): return x + {i} * {i % 7}"
    docs = [(2 * i + k, s, text(i), 0) for i in range(400) for k, s in enumerate(("a", "b"))]
    t = spark.createDataFrame([("a", 50.0, 2), ("b", 50.0, 2)], TARGET)
    d = spark.createDataFrame(docs, DOC)
    used = {}
    for r in M.mix(d, t)[0].collect():  # half of the tokens each: every text once
        used[r.doc_id // 2] = used.get(r.doc_id // 2, 0) + r.copies
    assert used == dict.fromkeys(range(400), 1)
    # beyond the supply: the flow's cost is paid, no text a third time before all were used twice
    held = sum(r.n_tokens for r in M.count_tokens(d).filter("source = 'a'").collect())
    rows = M.mix(d, t, total_tokens=int(2.5 * held))[0].collect()
    used = {}
    for r in rows:
        assert r.copies <= 2
        used[r.doc_id // 2] = used.get(r.doc_id // 2, 0) + r.copies
    assert set(used.values()) == {2, 3} and len(used) == 400
    n = {r.doc_id // 2: r.n_tokens for r in rows}
    cost = sum(n[i] * (u * (u - 1) // 2) for i, u in used.items())
    flow = M.min_cost_flow({("a", "b"): held}, {"a": int(1.25 * held), "b": int(1.25 * held)}, {"a": 2, "b": 2})
    sent = sum(flow.values())
    assert abs(cost - (held + 2 * (sent - 2 * held))) <= 4 * max(n.values())


def test_documents_of_one_text_in_one_source_count_each(spark):
    docs = [(i, "a", "x = 1", 0) for i in range(30)] + [(100 + i, "b", "x = 1", 0) for i in range(10)] + [(5, "a", "x = 1", 0)]
    one = {(r.copy, tuple(tuple(d) for d in r.docs)) for r in M.records(M.count_tokens(spark.createDataFrame(docs, DOC))).collect()}
    assert one == {(k, (("a", k), ("b", 100 + k)) if k < 10 else (("a", k),)) for k in range(30)}
    targets = [(f"s{k}", 1.0, 1) for k in range(30)]  # more targets than a machine word has bits to spare
    many = spark.createDataFrame([(k, f"s{k}", f"y = {k}", 0) for k in range(30)], DOC)
    assert M.mix(many, spark.createDataFrame(targets, TARGET))[1].count() == 30
