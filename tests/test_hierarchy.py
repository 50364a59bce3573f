import random

import pytest

from netquarry.operators import hierarchy as H


def brute(nodes, links):
    known = {i for i, _, _ in nodes}
    name = {i: n for i, _, n in nodes}
    up = {}
    for c, p in links:
        if c in known and p in known:
            up[c] = min(p, up.get(c, p))
    out, below = {}, dict.fromkeys(known, 0)
    for i in known:
        chain, seen, c, bad = [i], {i}, i, False
        while c in up:
            c = up[c]
            if c in seen:
                bad = True
                break
            seen.add(c)
            chain.append(c)
        out[i] = None if bad else chain
        if not bad:
            for a in chain[1:]:
                below[a] += 1
    return {i: None if c is None else (c[-1], len(c) - 1, below[i], "/".join(name[x] for x in reversed(c))) for i, c in out.items()}


def run(spark, nodes, links, **kw):
    got = H.hierarchy(spark.createDataFrame(nodes, "id long, grp long, name string"), spark.createDataFrame(links, "child long, parent long"), **kw).collect()
    assert len(got) == len({r.id for r in got})
    return {r.id: None if r.cyclic else (r.root, r.depth, r.n_below, r.path) for r in got}


@pytest.mark.parametrize("block,span", [(1 << 19, 1 << 16), (5, 8)])
def test_random_forest(spark, monkeypatch, block, span):
    monkeypatch.setattr(H, "SPAN", span)
    rnd = random.Random(5)
    nodes = [(i, i % 3, f"m{i}") for i in range(240)]
    links = [(i, rnd.randrange(i // 3 * 3 + i % 3) // 3 * 3 + i % 3) for i in range(3, 240) if rnd.random() > 0.1]
    links = [(c, p) for c, p in links if p < c] + [(6, 9), (9, 6), (12, 12), (None, 4), (5, None), (7, 9999), (9999, 7)]
    links += links[:40]
    assert run(spark, nodes, links, block=block) == brute(nodes, links)


def test_long_chain_in_small_blocks_needs_doubling(spark):
    n = 60
    nodes = [(i, 1, f"n{i}") for i in range(n)]
    links = [(i, i - 1) for i in range(1, n)] + [(0, 0)]
    assert set(run(spark, nodes, links, block=4).values()) == {None}
    links = links[:-1]
    assert run(spark, nodes, links, block=4) == brute(nodes, links)


def test_empty(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [(4, 1, "x")], []) == {4: (4, 0, 0, "x")}


def test_module_links_by_case_and_escape(spark):
    m = spark.createDataFrame([(1, 1, "\\Top ", "v"), (2, 1, "sub", "v"), (3, 2, "INV", "sp"), (4, 2, "Cell", "sp"), (5, 1, None, "v")], "module_id long, src_id long, module_name string, fmt string")
    i = spark.createDataFrame([(1, "Top", "sub "), (1, "top", "Sub"), (1, None, "sub"), (1, "Top", None)], "src_id long, parent_name string, cell string")
    x = spark.createDataFrame([(2, "cell", "X", "inv"), (2, "cell", "M", "cell"), (2, "cell", "x", None)], "src_id long, subckt string, kind string, model string")
    nodes, links = H.module_links(m, i, x)
    assert {r["name"] for r in nodes.collect()} == {"Top", "sub", "INV", "Cell"}
    assert {tuple(r) for r in links.collect()} == {(2, 1), (3, 4)}


def test_nodes_with_several_parents_are_told(spark):
    links = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (4, 2), (None, 2), (5, None)], "child long, parent long")
    assert [tuple(r) for r in H.several_parents(links).collect()] == [(1, 2)]
