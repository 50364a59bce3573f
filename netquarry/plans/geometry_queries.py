"""Region queries: parts as rectangles on a 40 x 40 grid, counted cell by cell in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.core import read
from netquarry.operators import geometry as G


def rects(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    p = read(spark, sf_dir, "part").filter(F.col("p_partkey") % 2 == odd)
    k = F.col("p_partkey")
    x, y = (k * 7) % 41, (k * 13 + F.col("p_size")) % 37
    return p.select((F.col("p_size") * 3 + k % 3).alias("set_id"), x.alias("x0"), y.alias("y0"), (x + k % 7).alias("x1"), (y + 1 + F.col("p_size") % 9).alias("y1"))


def each_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts, each side a set of its own."""
    a, b = (rects(spark, sf_dir, odd).withColumn("set_id", F.col("set_id") * 2 + odd) for odd in (0, 1))
    return a.unionByName(b)


SQL = """WITH r AS (SELECT p_size * 3 + p_partkey % 3 AS set_id, p_partkey % 2 AS odd, p_partkey * 7 % 41 AS x, (p_partkey * 13 + p_size) % 37 AS y, p_partkey % 7 AS w, 1 + p_size % 9 AS h FROM part),
cell AS (SELECT DISTINCT set_id, odd, x + i.range AS x, y + j.range AS y FROM r, range(6) i, range(9) j WHERE i.range < w AND j.range < h),
a AS (SELECT set_id, x, y FROM cell WHERE odd = 0), b AS (SELECT set_id, x, y FROM cell WHERE odd = 1), e AS (SELECT set_id * 2 + odd AS set_id, x, y FROM cell)
"""


def _area(f):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return G.area(f(rects(spark, sf_dir, 0), rects(spark, sf_dir, 1))).filter("area > 0")

    return q


def _own_area(f):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return G.area(f(each_rect(spark, sf_dir))).filter("area > 0")

    return q


def rect_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bounds(G.from_rects(each_rect(spark, sf_dir)))


def rect_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    slabs = G.from_rects(each_rect(spark, sf_dir))
    pts = read(spark, sf_dir, "part").select(((F.col("p_size") * 3 + F.col("p_partkey") % 3) * 2 + F.col("p_partkey") % 2).alias("set_id"), (F.col("p_partkey") % 41).alias("x"), (F.col("p_partkey") % 37).alias("y")).distinct()
    return G.contains(slabs, pts)


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and holes of each set; the signed areas of its loops add up to the area."""
    p = G.polygons(G.union(rects(spark, sf_dir, 0), rects(spark, sf_dir, 1)))
    return p.groupBy("set_id").agg(F.sum("area2").alias("area2"))


def polygon_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.polygons(G.union(rects(spark, sf_dir, 0), rects(spark, sf_dir, 1)))


def sized_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.keep_sized(G.polygons(G.from_rects(each_rect(spark, sf_dir))), 2, 5, 2, 6)


QUERIES = {
    "rect_union_area": _area(G.union), "rect_difference": _area(G.difference), "rect_intersection": _area(G.intersection), "bloat": _own_area(lambda a: G.bloat(a, 1, 2, 0, 3)), "shrink": _own_area(lambda a: G.shrink(G.from_rects(a), 1, 1, 0, 1)),
    "rect_bounds": rect_bounds, "rect_contains": rect_contains, "polygons": polygons, "polygon_loops": polygon_loops, "sized_rects": sized_rects,
}
ORACLE_SQL = {
    # a rectangle of cells without a cell beside it; touching at a corner does not join
    "sized_rects": SQL + """, c AS (SELECT * FROM e WHERE (set_id, x - 1, y) NOT IN (SELECT (set_id, x, y) FROM e) AND (set_id, x, y - 1) NOT IN (SELECT (set_id, x, y) FROM e)),
t AS (SELECT set_id, x, y, w.range AS w, h.range AS h FROM c, range(2, 6) w, range(2, 7) h),
n AS (SELECT t.set_id, t.x, t.y, w, h, count(*) FILTER (e.x BETWEEN t.x AND t.x + w - 1 AND e.y BETWEEN t.y AND t.y + h - 1) AS inside, count(*) FILTER (e.x BETWEEN t.x AND t.x + w - 1 OR e.y BETWEEN t.y AND t.y + h - 1) AS near FROM t JOIN e ON e.set_id = t.set_id AND e.x BETWEEN t.x - 1 AND t.x + w AND e.y BETWEEN t.y - 1 AND t.y + h GROUP BY ALL)
SELECT set_id, x AS x0, y AS y0, x + w AS x1, y + h AS y1 FROM n WHERE inside = w * h AND near = inside""",
    "rect_union_area": SQL + "SELECT set_id, count(*) AS area FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY 1",
    "rect_difference": SQL + "SELECT set_id, count(*) AS area FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY 1",
    "rect_intersection": SQL + "SELECT set_id, count(*) AS area FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY 1",
    "bloat": SQL + "SELECT set_id, count(*) AS area FROM (SELECT DISTINCT set_id, x + i.range - 1 AS x, y + j.range AS y FROM e, range(4) i, range(4) j) GROUP BY 1",
    "shrink": SQL + "SELECT set_id, count(*) AS area FROM (SELECT p.set_id, p.x, p.y FROM e p JOIN e q ON p.set_id = q.set_id AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y AND p.y + 1 GROUP BY 1, 2, 3 HAVING count(*) = 6) GROUP BY 1",
    "rect_bounds": SQL + "SELECT set_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM e GROUP BY 1",
    "rect_contains": SQL + "SELECT DISTINCT set_id, x, y FROM e JOIN (SELECT (p_size * 3 + p_partkey % 3) * 2 + p_partkey % 2 AS set_id, p_partkey % 41 AS x, p_partkey % 37 AS y FROM part) USING (set_id, x, y)",
    "polygons": SQL + "SELECT set_id, 2 * count(*) AS area2 FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY 1",
}
