import random

from netquarry.operators import geometry as G


def cells(rs):
    return {(s, x, y) for s, x0, y0, x1, y1 in rs for x in range(x0, x1) for y in range(y0, y1)}


def test_polygons_against_flood_fill(spark):
    rnd = random.Random(4)
    rs = []
    for s in range(40):
        for _ in range(rnd.randrange(1, 12)):
            x, y = rnd.randrange(14), rnd.randrange(14)
            rs.append((s, x, y, x + rnd.randrange(0, 6), y + rnd.randrange(0, 6)))
    df = spark.createDataFrame(rs, "set_id long, x0 int, y0 int, x1 int, y1 int")
    slabs = G.from_rects(df)
    got = {}
    for r in G.polygons(slabs).collect():
        got.setdefault(r.set_id, []).append(r)
    all_cells = cells(rs)
    for s in {c[0] for c in all_cells}:
        own = {c[1:] for c in all_cells if c[0] == s}

        def parts(todo, near):
            todo, n = set(todo), 0
            while todo:
                n += 1
                work = [todo.pop()]
                while work:
                    x, y = work.pop()
                    for d in near:
                        q = (x + d[0], y + d[1])
                        if q in todo:
                            todo.remove(q)
                            work.append(q)
            return n

        side = [(0, 1), (1, 0), (0, -1), (-1, 0)]
        outside = {(x, y) for x in range(-1, 22) for y in range(-1, 22)} - own
        loops = got[s]
        assert sum(r.area2 > 0 for r in loops) == parts(own, side)
        assert sum(r.area2 < 0 for r in loops) == parts(outside, side + [(1, 1), (1, -1), (-1, 1), (-1, -1)]) - 1
        assert sum(r.area2 for r in loops) == 2 * len(own)
        assert all(r.hole_of is not None for r in loops if r.area2 < 0)
    rnd.shuffle(rs)
    again = G.from_rects(spark.createDataFrame(rs + rs, "set_id long, x0 int, y0 int, x1 int, y1 int"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, slabs.collect()))


def test_empty_and_rectangles(spark):
    df = spark.createDataFrame([(1, 0, 0, 3, 2), (1, 3, 0, 4, 2), (1, 9, 9, 9, 12), (None, 0, 0, 1, 1), (2, 0, 0, 9, 9)], "set_id long, x0 int, y0 int, x1 int, y1 int")
    slabs = G.from_rects(df)
    assert sorted(map(tuple, slabs.collect())) == [(1, 0, 0, 4, 2), (2, 0, 0, 9, 9)]
    assert [tuple(r) for r in G.keep_sized(G.polygons(slabs), 1, 5, 1, 5).collect()] == [(1, 0, 0, 4, 2)]
    assert G.from_rects(df.limit(0)).count() == 0
