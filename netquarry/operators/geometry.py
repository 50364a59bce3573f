"""Rectilinear regions: sets of integer rectangles (set_id, x0, y0, x1, y1), half open, as canonical slabs and as polygons.

A set is cut at every x of its rectangles; in each slab the covered y intervals are merged, and neighbouring slabs with the same
intervals are joined. Two sets cover the same points if and only if their slabs are equal. Rectangles meet their slabs by the rank of
their cuts, not by a range join. Empty rectangles cover nothing; null sets or coordinates are left out.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.core import broadcast_if_small, materialise, salted_join

XY = ["x0", "y0", "x1", "y1"]


def is_empty(r: str = "") -> Column:
    p = f"{r}." if r else ""
    return (F.col(p + "x1") <= F.col(p + "x0")) | (F.col(p + "y1") <= F.col(p + "y0"))


def combine(a: DataFrame, b: DataFrame | None, keep: Callable[[Column, Column], Column]) -> DataFrame:
    """Canonical slabs of the points for which keep(in a, in b) holds."""
    tagged = a.select("set_id", *[F.col(c).cast("long").alias(c) for c in XY], F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    if b is not None:
        tagged = tagged.unionByName(b.select("set_id", *[F.col(c).cast("long").alias(c) for c in XY], F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    tagged = tagged.dropna(subset=["set_id", *XY]).filter(~is_empty()).distinct()
    cuts = tagged.select("set_id", F.explode(F.array("x0", "x1")).alias("x")).distinct()
    cuts = cuts.withColumn("_k", F.row_number().over(Window.partitionBy("set_id").orderBy("x")))
    at = lambda c, k: cuts.select("set_id", F.col("x").alias(c), F.col("_k").alias(k))
    r = tagged.join(at("x0", "_i"), ["set_id", "x0"]).join(at("x1", "_j"), ["set_id", "x1"])
    r = r.select("set_id", F.explode(F.sequence("_i", F.col("_j") - 1)).alias("_k"), "y0", "y1", "_a", "_b")
    edges = r.select("set_id", "_k", F.inline(F.array(F.struct(F.col("y0").alias("y"), F.col("_a").alias("da"), F.col("_b").alias("db")), F.struct(F.col("y1").alias("y"), (-F.col("_a")).alias("da"), (-F.col("_b")).alias("db")))))
    edges = edges.groupBy("set_id", "_k", "y").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    slab = Window.partitionBy("set_id", "_k").orderBy("y")
    sofar = slab.rowsBetween(Window.unboundedPreceding, 0)
    e = edges.withColumn("_in", keep(F.sum("da").over(sofar) > 0, F.sum("db").over(sofar) > 0)).withColumn("_next", F.lead("y").over(slab))
    # an interval goes on while its predecessor is in
    e = e.withColumn("_start", (F.col("_in") & ~F.coalesce(F.lag("_in").over(slab), F.lit(False))).cast("int")).withColumn("_run", F.sum("_start").over(sofar))
    runs = e.filter("_in and _next is not null").groupBy("set_id", "_k", "_run").agg(F.min("y").alias("y0"), F.max("_next").alias("y1"))
    slabs = runs.groupBy("set_id", "_k").agg(F.array_sort(F.collect_list(F.struct("y0", "y1"))).alias("ys"))
    order = Window.partitionBy("set_id").orderBy("_k")
    same = (F.lag("_k").over(order) == F.col("_k") - 1) & (F.lag("ys").over(order) == F.col("ys"))
    s = slabs.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.groupBy("set_id", "_g").agg(F.min("_k").alias("_i"), (F.max("_k") + 1).alias("_j"), F.first("ys").alias("ys"))
    s = s.join(at("x0", "_i"), ["set_id", "_i"]).join(at("x1", "_j"), ["set_id", "_j"])
    return s.select("set_id", "x0", "x1", F.inline("ys")).select("set_id", *XY)


def from_rects(a: DataFrame) -> DataFrame:
    return combine(a, None, lambda x, _: x)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine(a, b, lambda x, y: x | y)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine(a, b, lambda x, y: x & ~y)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine(a, b, lambda x, y: x & y)


def _grown(a: DataFrame, w: int, e: int, s: int, n: int) -> DataFrame:
    return a.filter(~is_empty()).select("set_id", (F.col("x0") - w).alias("x0"), (F.col("y0") - s).alias("y0"), (F.col("x1") + e).alias("x1"), (F.col("y1") + n).alias("y1"))


def bloat(a: DataFrame, w: int, e: int, s: int, n: int) -> DataFrame:
    return from_rects(_grown(a, *(max(0, v) for v in (w, e, s, n))))


def shrink(a: DataFrame, w: int, e: int, s: int, n: int) -> DataFrame:
    """What stays after the borders move inwards: what is outside grows by the mirrored amounts within a frame."""
    w, e, s, n = (max(0, v) for v in (w, e, s, n))
    a = materialise(a, "region")
    frame = _grown(bounds(a), w + e + 1, w + e + 1, s + n + 1, s + n + 1)
    return difference(frame, _grown(materialise(difference(frame, a), "outside"), e, w, n, s))


def bounds(a: DataFrame) -> DataFrame:
    return a.filter(~is_empty()).groupBy("set_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def area(slabs: DataFrame) -> DataFrame:
    return slabs.groupBy("set_id").agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))


def sides(rects: DataFrame) -> DataFrame:
    """rects with width and height, 0 for an empty one."""
    return rects.withColumn("width", F.greatest(F.lit(0), F.col("x1") - F.col("x0"))).withColumn("height", F.greatest(F.lit(0), F.col("y1") - F.col("y0")))


COLUMNS = 1024  # into which the points of a set are sorted by x


def contains(slabs: DataFrame, points: DataFrame) -> DataFrame:
    """points (set_id, x, y) that the slabs cover. Each set is cut into COLUMNS columns; a point meets the slabs of its column only."""
    span = slabs.groupBy("set_id").agg(F.min("x0").alias("_at"), F.greatest(F.lit(1), F.ceil((F.max("x1") - F.min("x0")) / COLUMNS)).cast("long").alias("_w"))
    column = lambda x: F.floor((x - F.col("_at")) / F.col("_w"))
    side, small = broadcast_if_small(span)
    near = lambda d, by: d.join(side, "set_id") if small else salted_join(d, span, ["set_id"], by=F.col(by))
    s = near(slabs, "y0").withColumn("_c", F.explode(F.sequence(column(F.col("x0")), column(F.col("x1") - 1)))).drop("_at", "_w")
    p = near(points, "y").withColumn("_c", column(F.col("x"))).drop("_at", "_w")
    hit = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return p.join(s, ["set_id", "_c"]).filter(hit).select(*points.columns).distinct()


def _minus(have: list[tuple[int, int]], other: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for a, b in have:
        for c, d in other:
            if d <= a or c >= b:
                continue
            if c > a:
                out.append((a, c))
            a = max(a, d)
        if a < b:
            out.append((a, b))
    return out


def signed_area2(loop: list[tuple[int, int]]) -> int:
    return sum(x * loop[(k + 1) % len(loop)][1] - loop[(k + 1) % len(loop)][0] * y for k, (x, y) in enumerate(loop))


def _inside(p: tuple[float, float], loop: list[tuple[int, int]]) -> bool:
    odd = False
    for k, (ax, ay) in enumerate(loop):
        bx, by = loop[(k + 1) % len(loop)]
        if ax == bx and (ay > p[1]) != (by > p[1]) and ax > p[0]:
            odd = not odd
    return odd


def outlines(slabs: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Loops of canonical slabs (x0, y0, x1, y1): the region lies on the left, so outlines run counter-clockwise and holes clockwise."""
    begin: dict[int, list] = {}
    end: dict[int, list] = {}
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x0, y0, x1, y1 in sorted(slabs):
        begin.setdefault(x0, []).append((y0, y1))
        end.setdefault(x1, []).append((y0, y1))
        out.setdefault((x0, y0), []).append((x1, y0))
        out.setdefault((x1, y1), []).append((x0, y1))
    for x in begin.keys() | end.keys():
        for a, b in _minus(begin.get(x, []), end.get(x, [])):
            out.setdefault((x, b), []).append((x, a))
        for a, b in _minus(end.get(x, []), begin.get(x, [])):
            out.setdefault((x, a), []).append((x, b))
    loops = []
    while out:
        start = min(out)
        loop, at, way = [start], start, None
        while True:
            ways = out[at]
            sign = lambda v: (v > 0) - (v < 0)
            if way is None or len(ways) == 1:
                to = ways[0]
            else:  # at a pinch the turn furthest to the left
                to = max(ways, key=lambda q: way[0] * sign(q[1] - at[1]) - way[1] * sign(q[0] - at[0]))
            ways.remove(to)
            if not ways:
                del out[at]
            way, at = (sign(to[0] - at[0]), sign(to[1] - at[1])), to
            if at == start:
                break
            loop.append(at)
        k = len(loop)
        corner = [p for i, p in enumerate(loop) if not (loop[i - 1][0] == p[0] == loop[(i + 1) % k][0] or loop[i - 1][1] == p[1] == loop[(i + 1) % k][1])]
        loops.append(corner)
    return loops


def polygons(slabs: DataFrame) -> DataFrame:
    """set_id, piece, hole_of (piece of the outline around a hole, null for outlines), area2 (signed), xs, ys of each loop.

    A loop starts at its smallest corner; pieces are numbered in that order. A hole belongs to the smallest outline around it."""

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        loops = outlines([tuple(map(int, r)) for r in pdf[XY].itertuples(index=False)])
        loops = [lp[(k := lp.index(min(lp))) :] + lp[:k] for lp in loops]
        loops = sorted(loops)
        areas = [signed_area2(lp) for lp in loops]
        rows = []
        for k, (lp, a) in enumerate(zip(loops, areas, strict=True)):
            hole_of = None
            if a < 0:
                # a point just outside the hole's lowest left corner lies in its outline
                p = (lp[0][0] - 0.25, lp[0][1] + 0.25)
                around = [(areas[j], j) for j in range(len(loops)) if areas[j] > 0 and _inside(p, loops[j])]
                hole_of = min(around)[1] if around else None
            rows.append((pdf["set_id"].iloc[0], k, hole_of, a, [p[0] for p in lp], [p[1] for p in lp]))
        return pd.DataFrame(rows, columns=["set_id", "piece", "hole_of", "area2", "xs", "ys"]).astype({"hole_of": "Int64"})

    kind = dict(slabs.dtypes)["set_id"]
    return slabs.groupBy("set_id").applyInPandas(trace, f"set_id {kind}, piece long, hole_of long, area2 long, xs array<long>, ys array<long>")


def keep_sized(polys: DataFrame, min_w: int, max_w: int, min_h: int, max_h: int) -> DataFrame:
    """The pieces that are plain rectangles, without holes, of a size within the limits: set_id, x0, y0, x1, y1."""
    holes = polys.filter("hole_of is not null").select("set_id", F.col("hole_of").alias("piece")).distinct()
    r = polys.filter((F.size("xs") == 4) & (F.col("area2") > 0)).join(holes, ["set_id", "piece"], "left_anti")
    r = r.select("set_id", F.array_min("xs").alias("x0"), F.array_min("ys").alias("y0"), F.array_max("xs").alias("x1"), F.array_max("ys").alias("y1"))
    return r.filter((F.col("x1") - F.col("x0")).between(min_w, max_w) & (F.col("y1") - F.col("y0")).between(min_h, max_h))
