"""Library, coverage and parasitic queries: table columns play the parts of cells, pins, nets and resistors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netquarry.core import read, sorted_side
from netquarry.operators import coverage as C
from netquarry.operators import library as L
from netquarry.operators import parasitics as R

GRID_1, GRID_2 = [5.0, 20.0, 35.0], [0.01, 0.04, 0.07]
A = lambda xs: F.array(*[F.lit(x) for x in xs])


def nldm_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane 3 + 2 x + 100 y sampled on a grid: inside it is met exactly, outside it is held."""
    t = F.array(*[A([3 + 2 * a + 100 * b for b in GRID_2]) for a in GRID_1])
    li = read(spark, sf_dir, "lineitem").select("l_quantity", "l_discount").distinct()
    return li.select("l_quantity", "l_discount", F.round(L.lookup(A(GRID_1), A(GRID_2), t, F.col("l_quantity"), F.col("l_discount")), 9).alias("value"))


def nldm_one_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that lack an axis have one value; axes of one point are that point."""
    p = read(spark, sf_dir, "part")
    s, none = F.col("p_size").cast("double"), F.array().cast("array<double>")
    one, row = F.array(s), F.array(F.array(s, s * 2, s * 3))
    v = F.when(F.col("p_partkey") % 4 == 0, L.lookup(none, A([1.0, 2.0, 3.0]), row, s, F.lit(2.5))).when(F.col("p_partkey") % 4 == 1, L.lookup(one, A([1.0, 2.0, 3.0]), row, F.lit(9.0), F.lit(2.5)))
    v = v.when(F.col("p_partkey") % 4 == 2, L.lookup(F.lit(None).cast("array<double>"), none, row, s, s)).otherwise(L.lookup(one, one, F.array().cast("array<array<double>>"), s, s))
    return p.select("p_partkey", v.alias("value"))


def lib_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds as fractions, defaults for what is missing or out of range."""
    p = read(spark, sf_dir, "part")
    s = F.col("p_size").cast("double")
    d = F.map_from_arrays(F.array(F.lit("slew_lower_threshold_pct_rise"), F.lit("slew_upper_threshold_pct_fall"), F.lit("slew_derate_from_library")), F.array(s * 3, F.lit(100.0) - s, s - 20))
    t = L.thresholds(d)
    return p.select("p_partkey", F.round(t["slew_lower_rise"], 9).alias("slew_lower_rise"), F.round(t["slew_upper_fall"], 9).alias("slew_upper_fall"), t["input_rise"].alias("input_rise"), t["slew_derate"].alias("slew_derate"), F.round(t["slew_span"], 9).alias("slew_span"))


def lib_voltage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as libraries in the order of their numbers; the first ones state no voltage."""
    p = read(spark, sf_dir, "part")
    return L.merged_voltage(p.select(F.col("p_partkey").alias("lib_id"), F.when(F.col("p_partkey") > 7, F.col("p_size") / 10.0).otherwise(0.0).alias("voltage")))


def constraint_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = L.constraint(F.col("l_tax") * F.lit(2.0), F.col("l_discount"))
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(c), 4).alias("total"))


def slew_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    s = F.col("p_size").cast("double")
    return p.select("p_partkey", F.round(L.slew_span(s, s * 2, s, s + 50), 9).alias("span"))


def receiver_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    s = F.col("p_size").cast("double")
    g = lambda c: F.when(c, F.array(F.array(s, s + 1), F.array(s + 2, s + 3))).otherwise(F.array().cast("array<array<double>>"))
    k = F.col("p_partkey")
    return p.select("p_partkey", F.round(L.receiver_load(g(k % 2 == 0), g(k % 3 == 0), g(k % 5 == 0), g(k % 7 == 0)), 9).alias("load"))


def state_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") != "click", F.col("event_type")).alias("state"), F.floor("value").alias("value"))
    return L.state_leakage(e, ["user_id"]).select("user_id", F.round("leakage", 6).alias("leakage"))


def internal_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_custkey", F.array(F.array(F.floor("o_totalprice").cast("double"), -F.floor("o_totalprice").cast("double") / 2)).alias("v"))
    return L.internal_energy(o, ["o_custkey"], "v").select("o_custkey", F.round("energy", 4).alias("energy"))


def pin_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookup with default 0, and output pins that are tied."""
    p, li = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    cap = p.filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_type")
    j = li.select("l_partkey").distinct().join(cap, "l_partkey", "left")
    tied = L.constant_output(F.lit("output"), F.when(F.col("p_size") % 2 == 0, " 1 ").otherwise(F.col("p_type")))
    return j.select("l_partkey", F.coalesce("p_size", F.lit(0)).alias("cap"), tied.alias("tied"), L.load_cap(F.col("p_size") - 40, F.lit(7)).alias("load"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cells: a third has a footprint, a seventh is sequential; pins follow the type."""
    p = read(spark, sf_dir, "part")
    pins = p.select(F.col("p_partkey").alias("cell"), F.inline(F.array(F.struct(F.lit("A").alias("pin"), F.lit("input").alias("direction"), F.lit(None).cast("string").alias("function")), F.struct(F.lit("Y").alias("pin"), F.lit("output").alias("direction"), F.when(F.col("p_size") > 2, F.concat("p_type", F.col("p_size").cast("string"))).alias("function")))))
    c = p.select(F.col("p_partkey").alias("cell"), F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", "p_type")).alias("footprint"), (F.col("p_partkey") % 7 == 0).alias("is_seq"), F.col("p_retailprice").alias("area"))
    return c.join(sorted_side(L.signatures(pins)), "cell")


def cell_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of cells that can stand for each other, and each cell's place in them."""
    return L.ladder(L.classes(_cells(spark, sf_dir))).select("cell", "rule", "class_id", "has_footprint", "place", "n_cells")


def upsize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell with every larger cell that can stand for it."""
    return L.upsize_candidates(L.classes(_cells(spark, sf_dir)))


def downsize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell with every smaller cell that can stand for it."""
    return L.downsize_candidates(L.classes(_cells(spark, sf_dir)))


_CELL_SQL = """WITH c AS (SELECT p_partkey AS cell, CASE WHEN p_partkey % 3 = 0 THEN p_brand || p_type END AS fp, p_partkey % 7 = 0 AS seq, p_retailprice AS area, CASE WHEN p_size > 2 THEN regexp_replace(p_type || p_size, '\\s', '', 'g') END AS f FROM part),
m AS (SELECT cell, area, fp IS NOT NULL AS has_footprint, 'footprint' AS rule, fp AS k FROM c WHERE fp IS NOT NULL UNION ALL SELECT cell, area, fp IS NOT NULL, 'function', f FROM c WHERE NOT seq AND f IS NOT NULL UNION ALL SELECT cell, area, false, 'self', 'c' || cell FROM c WHERE fp IS NULL AND (seq OR f IS NULL)),
l AS (SELECT *, min(cell) OVER w AS class_id, row_number() OVER (w ORDER BY area, cell) AS place, count(*) OVER w AS n_cells,
  (SELECT count(*) FROM m b WHERE b.rule = m.rule AND b.k = m.k AND b.area > m.area) AS n_larger, (SELECT count(*) FROM m b WHERE b.rule = m.rule AND b.k = m.k AND b.area < m.area) AS n_smaller,
  (SELECT arg_min(b.cell, (b.area, b.cell)) FROM m b WHERE b.rule = m.rule AND b.k = m.k AND b.area > m.area) AS next_larger, (SELECT arg_min(b.cell, (-b.area, b.cell)) FROM m b WHERE b.rule = m.rule AND b.k = m.k AND b.area < m.area) AS next_smaller
  FROM m WINDOW w AS (PARTITION BY rule, k))
"""
_SIZE_SQL = _CELL_SQL + "SELECT a.cell, a.rule, a.class_id, b.cell AS candidate, coalesce(b.area, 0) AS area FROM l a JOIN l b ON a.rule = b.rule AND a.k = b.k AND (a.rule = 'footprint' OR NOT (a.has_footprint AND b.has_footprint)) WHERE NOT isnan(coalesce(a.area, 0)) AND NOT isnan(coalesce(b.area, 0)) AND "


def lib_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.concat("p_brand", "p_type").alias("cell"), F.struct("p_size", "p_partkey").alias("lib_id"), "p_retailprice")
    return L.merge(p).select("cell", F.col("lib_id.p_partkey").alias("p_partkey"), "p_retailprice")


def ceffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax").distinct()
    return li.select("l_quantity", "l_discount", "l_tax", F.round(L.ceff(F.col("l_quantity"), F.col("l_quantity") * 2, F.col("l_discount"), F.col("l_tax")), 6).alias("c"))


def ceff_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slew grows with the load, so the loop is run until it settles."""
    li = read(spark, sf_dir, "lineitem").select("l_quantity", "l_discount").distinct()
    q = F.col("l_quantity") / 100.0
    return li.select("l_quantity", "l_discount", F.round(L.ceff_fixpoint(q, q, F.lit(0.05), lambda c: F.col("l_discount") + 0.01 + c * 0.2), 4).alias("c"))


def ccs_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constant current charges linearly: half the swing at half the time."""
    p = read(spark, sf_dir, "part").filter("p_size > 0")
    s = F.col("p_size").cast("double")
    d = L.waveform_delay(F.array(F.lit(0.0), s / 4, s), F.array(*[F.lit(2.0)] * 3), F.lit(0.5), F.lit(0.25))
    return p.select("p_partkey", F.round(d["delay"], 6).alias("delay"), F.round(d["slew"], 6).alias("slew"))


def nearest_waveform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a waveform and a point; 25 parts make an arc, whose grid is as small as a table's."""
    p, arc = read(spark, sf_dir, "part"), F.floor(F.col("p_partkey") / 25).alias("arc")
    wf = p.select(arc, F.col("p_partkey").alias("ord"), F.col("p_size").cast("double").alias("in_slew"), F.floor("p_retailprice").cast("double").alias("out_cap"))
    pt = p.select(arc, F.col("p_partkey").alias("id"), (F.col("p_size") / 10.0).alias("slew"), F.floor("p_retailprice").cast("double").alias("load"))
    return L.nearest(pt, wf, ["arc"])


def coverage_netlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are instances, parts below size 40 the library, flags name their pins."""
    li = read(spark, sf_dir, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("inst"), F.col("l_partkey").alias("cell"), F.when(F.col("l_returnflag") == "A", "vdd_core").when(F.col("l_returnflag") == "N", "\\VNB").otherwise("A").alias("pin"))
    return C.netlist(li.select("inst", "cell"), li.filter("pin <> '\\\\VNB' or cell % 2 = 0").select("inst", "pin"), read(spark, sf_dir, "part").filter("p_size < 40").select(F.col("p_partkey").alias("cell")))


def coverage_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are cells: tie cells, outputs without arcs and flops without constraints are told by their size."""
    li, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    cell, s = F.col("p_partkey").alias("cell"), F.col("p_size")
    pins = p.select(cell, F.when(s % 4 > 0, "output").otherwise("input").alias("direction"), F.when(s % 8 == 1, " 1 ").otherwise("!A").alias("function"))
    arcs = p.filter("p_size % 3 > 0").select(cell, (s % 5 == 0).alias("ccs_declared"), (s % 10 == 0).alias("ccs_usable"))
    return C.library(li.select(F.col("l_partkey").alias("cell")), p.filter("p_size < 45").select(cell, (s % 2 == 0).alias("is_seq")), pins, arcs, p.filter("p_size % 7 > 1").select(cell))


def coverage_parasitics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    return C.parasitics(c.filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("net")), o.select(F.col("o_custkey").alias("net")), o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("net")))


def top_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first module that no instance of its source names; names are compared as they stand."""
    m = read(spark, sf_dir, "nl_module").dropDuplicates(["module_id"]).select("src_id", "ord", F.col("module_name").alias("module"))
    return C.top_module(m, read(spark, sf_dir, "nl_inst").select("src_id", "cell"))


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six files of one design rendered from the tables, which disagree about some of their names."""
    o, c, p, s, n, li = (read(spark, sf_dir, t) for t in ("orders", "customer", "part", "supplier", "nation", "lineitem"))
    pin = F.concat(F.lit("p"), F.col("l_linenumber").cast("string"))
    inst = F.col("l_orderkey").alias("inst")
    lines = li.select(inst, F.col("l_partkey").alias("cell"), pin.alias("pin"), F.col("l_suppkey").alias("net")).distinct()
    design = {
        "nets": c.filter("c_custkey % 5 > 0").select(F.col("c_custkey").alias("net")), "spef_nets": o.select(F.col("o_custkey").alias("net")), "dump_nets": c.filter("c_nationkey < 23").select(F.col("c_custkey").alias("net")),
        "insts": o.select(F.col("o_orderkey").alias("inst"), F.col("o_custkey").alias("cell")), "conns": lines.select("inst", "pin", "net"),
        "spef_pins": o.select(F.col("o_orderkey").alias("inst"), F.concat(F.lit("p"), (F.col("o_custkey") % 8).cast("string")).alias("pin")),
        "lib_pins": c.filter("c_custkey % 7 > 0").select(F.col("c_custkey").alias("cell"), F.explode(F.array(*[F.lit(f"p{k}") for k in range(1, 6)])).alias("pin")),
        "ports": n.select(F.col("n_name").alias("port")), "sdc_clocks": s.select(F.col("s_name").alias("clock"), F.when(F.col("s_suppkey") % 4 == 0, "").when(F.col("s_suppkey") % 4 == 1, "u1/q").when(F.col("s_suppkey") % 4 == 2, "nowhere").otherwise("FRANCE").alias("source")),
        "sdc_io": p.select(F.when(F.col("p_size") == 7, "lost").otherwise("CANADA").alias("port"), (F.col("p_partkey") % 2 == 0).alias("is_default")),
    }
    return C.composition(design).groupBy("check").agg(F.count("*").alias("n"), F.min("subject").alias("first_subject"), F.min("detail").alias("first_detail"))


def coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as listings of node pairs part:1 and supplier:2; nodes of parts belong to their brand, supplier nodes to what stands
    before the colon."""
    li = read(spark, sf_dir, "lineitem")
    a, b = F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(":1")), F.concat(F.lit("s"), (F.col("l_suppkey") % 50).cast("string"), F.lit(":2"))
    flip = F.col("l_linenumber") % 2 == 0
    listed = li.select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("ord"), F.when(flip, a).otherwise(b).alias("a"), F.when(flip, b).otherwise(a).alias("b"), F.col("l_quantity").alias("cc"))
    own = read(spark, sf_dir, "part").filter("p_partkey % 4 > 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(":1")).alias("node"), F.col("p_brand").alias("net"))
    sup = read(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), (F.col("s_suppkey") % 50).cast("string")).alias("node"), F.concat(F.lit("s"), (F.col("s_suppkey") % 50).cast("string")).alias("net")).distinct()
    return R.coupling(listed, own.unionByName(sup)).select("net", "other", F.round("cc", 3).alias("cc"))


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as a chain of resistors from node 0; the k-th line's resistor ends in node k, with its capacitor."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).alias("k"), F.round(F.col("l_tax") * 100).alias("r"), F.col("l_quantity").alias("c"))
    n = lambda c: c.cast("string")
    res = li.select(F.col("l_orderkey").alias("net"), F.col("k").alias("ord"), n(F.col("k") - 1).alias("a"), n(F.col("k")).alias("b"), F.col("r").alias("r"))
    cap = li.select(F.col("l_orderkey").alias("net"), F.col("k").alias("ord"), n(F.col("k")).alias("node"), F.col("c"))
    return R.net_rows(res, cap)


_CHAIN_SQL = """WITH li AS (SELECT l_orderkey AS net, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k, round(l_tax * 100) AS r, l_quantity AS c FROM lineitem),
s AS (SELECT *, sum(c) OVER (PARTITION BY net ORDER BY k DESC) AS below, sum(r) OVER (PARTITION BY net ORDER BY k) AS path FROM li)
"""


def elmore_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _chain(spark, sf_dir).select("net", F.inline(R.elmore("res", "caps", F.lit("0"))))
    return d.filter("node <> '0'").select("net", "node", F.round("delay", 9).alias("delay"))


def pi_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _chain(spark, sf_dir).select("net", R.pi_reduce("res", "caps", F.lit("1")).alias("p"))
    return d.select("net", F.round("p.c1", 6).alias("c1"), F.round("p.tau", 9).alias("tau"))


def xtalk_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("net"), F.col("l_linenumber").alias("node"), F.col("l_quantity").alias("c"))
    return R.spread_crosstalk(li, F.lit(10.0)).groupBy("net", "node").agg(F.round(F.sum("c"), 6).alias("c"))


def wire_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    cap = F.when(F.col("p_partkey") % 3 > 0, F.floor("p_retailprice").cast("double"))
    return p.select("p_partkey", R.wire_load_pf(cap).alias("load_pf"), F.round(R.lumped_delay_ns(F.col("p_size").cast("double"), cap), 9).alias("delay_ns"))


QUERIES = {
    "nldm_lookup": nldm_lookup, "constraint_eval": constraint_eval, "slew_span": slew_spans, "recv_load": receiver_load, "state_leakage": state_leakage, "internal_energy": internal_energy, "pin_caps": pin_caps,
    "cell_equivalence": cell_equivalence, "upsize": upsize, "downsize": downsize, "lib_merge": lib_merge, "ceff": ceffs, "ceff_fixpoint": ceff_fixpoint, "ccs_delay": ccs_delay, "nearest_waveform": nearest_waveform,
    "coverage_netlist": coverage_netlist, "coverage_library": coverage_library, "coverage_parasitics": coverage_parasitics, "top_module": top_module, "composition": composition, "nldm_one_axis": nldm_one_axis, "lib_thresholds": lib_thresholds, "lib_voltage": lib_voltage,
    "coupling": coupling, "elmore_chain": elmore_chain, "pi_reduce": pi_reduce, "xtalk_spread": xtalk_spread, "wire_loads": wire_loads,
}
_CEFF = "round(CASE WHEN {tau} <= 0 OR {t} <= 0 THEN {c1} + {c2} ELSE {c1} + {c2} * (1 - (1 - exp(-({t} / nullif({tau}, 0)))) / nullif({t} / nullif({tau}, 0), 0)) END, 6) AS c"
ORACLE_SQL = {
    "nldm_lookup": "SELECT DISTINCT l_quantity, l_discount, round(3 + 2 * greatest(5, least(35, l_quantity)) + 100 * greatest(0.01::DOUBLE, least(0.07::DOUBLE, l_discount)), 9) AS value FROM lineitem",
    "constraint_eval": "SELECT l_returnflag, round(sum(greatest(l_tax * 2, l_discount)), 4) AS total FROM lineitem GROUP BY 1",
    "slew_span": "SELECT p_partkey, round(CASE WHEN (p_size + 50) / 200.0 > 0 AND (p_size + 50) / 200.0 <= 1 THEN (p_size + 50) / 200.0 ELSE 0.6 END, 9)::DOUBLE AS span FROM part",
    "recv_load": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN p_size + 1.5::DOUBLE ELSE 0.0::DOUBLE END AS load FROM part",
    "state_leakage": "SELECT user_id, round(avg(v), 6) AS leakage FROM (SELECT user_id, sum(floor(value)) AS v FROM events GROUP BY user_id, CASE WHEN event_type = 'click' THEN 'c' || event_id ELSE event_type END) GROUP BY 1",
    "internal_energy": "SELECT o_custkey, round(avg(floor(o_totalprice)) * 0.75, 4) AS energy FROM orders GROUP BY 1",
    "pin_caps": "SELECT DISTINCT l_partkey, coalesce(p_size, 0) AS cap, coalesce(p_size % 2 = 0, false) AS tied, CASE WHEN p_size - 40 > 0 THEN p_size - 40 ELSE 7 END AS load FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON l_partkey = p_partkey",
    "cell_equivalence": _CELL_SQL + "SELECT cell, rule, class_id, has_footprint, place, n_cells FROM l",
    "upsize": _SIZE_SQL + "coalesce(b.area, 0) > coalesce(a.area, 0)",
    "downsize": _SIZE_SQL + "coalesce(b.area, 0) < coalesce(a.area, 0)",
    "lib_merge": "SELECT cell, p_partkey, p_retailprice FROM (SELECT p_brand || p_type AS cell, *, row_number() OVER (PARTITION BY p_brand || p_type ORDER BY p_size, p_partkey) AS n FROM part) WHERE n = 1",
    "ceff": "SELECT DISTINCT l_quantity, l_discount, l_tax, " + _CEFF.format(tau="l_discount", t="l_tax", c1="l_quantity", c2="(l_quantity * 2)") + " FROM lineitem",
    # eight steps written out; a step no longer moves once two differ by less than 1e-5
    "ceff_fixpoint": "WITH RECURSIVE q AS (SELECT DISTINCT l_quantity, l_discount, l_quantity / 100.0::DOUBLE AS q FROM lineitem), r(l_quantity, l_discount, q, n, c, done) AS (SELECT l_quantity, l_discount, q, 0, q * 2, false FROM q UNION ALL SELECT l_quantity, l_discount, q, n + 1, CASE WHEN done THEN c ELSE x END, done OR abs(x - c) < 1e-5 FROM (SELECT *, CASE WHEN q <= 0 THEN q * 2 ELSE q + q * (1 - (1 - exp(-(l_discount + 0.01::DOUBLE + c * 0.2) / 0.05)) / ((l_discount + 0.01::DOUBLE + c * 0.2) / 0.05)) END AS x FROM r WHERE n < 8)) SELECT l_quantity, l_discount, round(c, 4) AS c FROM r WHERE n = 8",
    "ccs_delay": "SELECT p_partkey, round(greatest(p_size / 2.0 - 0.25, 0), 6)::DOUBLE AS delay, round(p_size * 0.6, 6)::DOUBLE AS slew FROM part WHERE p_size > 0",
    "nearest_waveform": "WITH w AS (SELECT p_partkey // 25 AS arc, p_partkey AS ord, p_size::DOUBLE AS s, floor(p_retailprice) AS c FROM part), p AS (SELECT p_partkey // 25 AS arc, p_partkey AS id, p_size / 10.0::DOUBLE AS s, floor(p_retailprice) AS c FROM part) SELECT p.arc, id, arg_min(ord, (pow((w.s - p.s) / greatest(abs(p.s), 1e-9), 2) + pow((w.c - p.c) / greatest(abs(p.c), 1e-9), 2), ord)) AS ord FROM p JOIN w USING (arc) GROUP BY 1, 2",
    "coverage_netlist": """WITH i AS (SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS inst, l_partkey AS cell, l_returnflag AS f FROM lineitem), p AS (SELECT inst, bool_and(f <> 'R') AS power FROM i WHERE f <> 'N' OR cell % 2 = 0 GROUP BY 1),
j AS (SELECT i.*, coalesce(power, true) AS power, b.p_partkey IS NULL AS lost FROM i LEFT JOIN p USING (inst) LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 40) b ON cell = p_partkey)
SELECT count(*) AS instances, count(DISTINCT cell) AS masters, count(*) FILTER (NOT lost) AS resolved, count(*) FILTER (lost AND power) AS physical_only, count(*) FILTER (lost AND NOT power) AS unresolved_signal, greatest(0, count(*) - count(*) FILTER (lost AND power) - count(*) FILTER (lost AND NOT power)) AS analysable FROM j""",
    "coverage_library": "WITH j AS (SELECT * FROM part WHERE p_size < 45 AND p_partkey IN (SELECT l_partkey FROM lineitem)) SELECT (SELECT count(*) FROM part WHERE p_size < 45) AS cells_in_lib, count(*) AS resolved_masters, count(*) FILTER (p_size % 4 > 0 AND p_size % 8 <> 1 AND p_size % 3 = 0) AS driving_without_arcs, count(*) FILTER (p_size % 2 = 0 AND p_size % 7 <= 1) AS sequential_without_constraints, count(*) FILTER (p_size % 3 > 0 AND p_size % 5 = 0) AS ccs_declared, count(*) FILTER (p_size % 3 > 0 AND p_size % 10 = 0) AS ccs_usable FROM j",
    "coverage_parasitics": """WITH d AS (SELECT c_custkey AS net FROM customer WHERE c_custkey % 3 > 0), f AS (SELECT DISTINCT o_custkey AS net FROM orders), x AS (SELECT (SELECT count(*) FROM d) AS dn, (SELECT count(*) FROM f) AS fn, (SELECT count(*) FROM d JOIN f USING (net)) AS m, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS ar, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT net FROM d)) AS a)
SELECT dn AS design_nets, fn AS file_nets, m AS matched, dn - m AS design_nets_unmatched, fn - m AS file_nets_unmatched, ar AS coupling_refs, a AS coupling_unresolved, m * 100.0::DOUBLE / dn AS percent, fn > 0 AND m = 0 AS read_but_unmatched, fn = m AND a = 0 AS names_all_correspond FROM x""",
    "top_module": "WITH m AS (SELECT DISTINCT module_id, src_id, ord, module_name FROM nl_module), f AS (SELECT m.*, EXISTS (SELECT 1 FROM nl_inst i WHERE i.src_id = m.src_id AND i.cell = m.module_name) AS used FROM m) SELECT src_id, coalesce(arg_min(module_name, ord) FILTER (NOT used), arg_max(module_name, ord)) AS top FROM f GROUP BY 1",
    "composition": """WITH lp AS (SELECT c_custkey AS cell, 'p' || unnest(range(1, 6)) AS pin FROM customer WHERE c_custkey % 7 > 0), conn AS (SELECT DISTINCT l_orderkey AS inst, 'p' || l_linenumber AS pin FROM lineitem), nets AS (SELECT c_custkey AS net FROM customer WHERE c_custkey % 5 > 0),
sc AS (SELECT s_name AS clock, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'u1/q' WHEN 2 THEN 'nowhere' ELSE 'FRANCE' END AS source FROM supplier),
x AS (SELECT DISTINCT 'net of the parasitics' AS "check", CAST(o_custkey AS VARCHAR) AS subject, NULL AS detail FROM orders WHERE o_custkey NOT IN (SELECT net FROM nets)
UNION ALL SELECT DISTINCT 'pin of the parasitics', CAST(o_orderkey AS VARCHAR), 'p' || (o_custkey % 8) FROM orders WHERE (o_orderkey, 'p' || (o_custkey % 8)) NOT IN (SELECT (inst, pin) FROM conn)
UNION ALL SELECT DISTINCT 'cell of the netlist', CAST(o_custkey AS VARCHAR), NULL FROM orders WHERE o_custkey NOT IN (SELECT cell FROM lp)
UNION ALL SELECT DISTINCT 'pin of the netlist', CAST(o_custkey AS VARCHAR), conn.pin FROM conn JOIN orders ON o_orderkey = inst WHERE o_custkey IN (SELECT cell FROM lp) AND (o_custkey, conn.pin) NOT IN (SELECT (cell, pin) FROM lp)
UNION ALL SELECT DISTINCT 'port of the constraints', source, 'clock ' || clock FROM sc WHERE source <> '' AND source NOT LIKE '%/%' AND source NOT IN (SELECT n_name FROM nation)
UNION ALL SELECT DISTINCT 'port of the constraints', port, 'io delay' FROM (SELECT CASE WHEN p_size = 7 THEN 'lost' ELSE 'CANADA' END AS port FROM part WHERE p_partkey % 2 <> 0) WHERE port NOT IN (SELECT n_name FROM nation)
UNION ALL SELECT DISTINCT 'net of the dump', CAST(net AS VARCHAR), NULL FROM nets WHERE net NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 23))
SELECT "check", count(*) AS n, min(subject) AS first_subject, min(detail) AS first_detail FROM x GROUP BY 1""",
    "nldm_one_axis": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN 2.5 * p_size WHEN 2 THEN p_size ELSE 0 END::DOUBLE AS value FROM part",
    "lib_thresholds": "WITH t AS (SELECT p_partkey, CASE WHEN p_size * 3 <= 100 THEN p_size * 3 ELSE 20 END / 100.0::DOUBLE AS lo, (100 - p_size) / 100.0::DOUBLE AS up, CASE WHEN p_size > 20 THEN p_size - 20 ELSE 1 END::DOUBLE AS d FROM part), u AS (SELECT *, ((0.8 - lo) + (up - 0.2)) / 2 AS s FROM t) SELECT p_partkey, round(lo, 9) AS slew_lower_rise, round(up, 9) AS slew_upper_fall, 0.5::DOUBLE AS input_rise, d AS slew_derate, round(CASE WHEN s > 0 AND s <= 1 THEN s ELSE 0.6 END, 9)::DOUBLE AS slew_span FROM u",
    "lib_voltage": "SELECT p_size / 10.0::DOUBLE AS voltage FROM part WHERE p_partkey > 7 AND p_size <> 0 ORDER BY p_partkey LIMIT 1",
    "coupling": """WITH l AS (SELECT 'p' || l_partkey AS p, 's' || (l_suppkey % 50) AS s, l_quantity AS cc, row_number() OVER (PARTITION BY l_partkey, l_suppkey % 50 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, l_partkey FROM lineitem),
e AS (SELECT b.p_brand AS a, s AS b, cc FROM l JOIN part b ON b.p_partkey = l.l_partkey AND b.p_partkey % 4 > 0 WHERE n = 1), y AS (SELECT a AS net, b AS other, cc FROM e UNION ALL SELECT b, a, cc FROM e) SELECT net, other, round(sum(cc), 3) AS cc FROM y GROUP BY 1, 2""",
    "elmore_chain": _CHAIN_SQL + "SELECT net, CAST(k AS VARCHAR) AS node, round(sum(r * below) OVER (PARTITION BY net ORDER BY k) * 1e-6, 9) AS delay FROM s",
    "pi_reduce": _CHAIN_SQL + "SELECT net, round(sum(c) FILTER (k = 1), 6) AS c1, round(sum(c * (path - first)) * 1e-6, 9) AS tau FROM (SELECT *, min(CASE WHEN k = 1 THEN r END) OVER (PARTITION BY net) AS first FROM s) GROUP BY 1",
    "xtalk_spread": "SELECT net, node, round(sum(c), 6) AS c FROM (SELECT l_orderkey AS net, l_linenumber AS node, l_quantity + 10 * l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS c FROM lineitem) GROUP BY 1, 2",
    "wire_loads": "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN floor(p_retailprice) / 1000 ELSE 0 END AS load_pf, CASE WHEN p_partkey % 3 > 0 THEN round(p_size * floor(p_retailprice) * 1e-6, 9) ELSE 0 END AS delay_ns FROM part",
}
