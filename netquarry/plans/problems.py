"""Queries of the data-processing problems that belong to the core: p1, p2, p4, p5, p6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.core import read
from netquarry.operators import grid, hierarchy, orphans, rejects, units

SERIES = dict(key=["dump_id", "sig_path"], step_key=["dump_id"], start="from_s", end="to_s", value="toggles", step="step_s")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.fill(read(spark, sf_dir, "sweep_window"), read(spark, sf_dir, "act_dump"), **SERIES).select("dump_id", "sig_path", "slot")


def p1_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.regular(read(spark, sf_dir, "sweep_window"), read(spark, sf_dir, "act_dump"), **SERIES).select("dump_id", "sig_path", "slot", F.round("value", 6).alias("value"), "missing")


def p1_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots of p1_grid that a usable reading measured."""
    got = grid.regular(read(spark, sf_dir, "sweep_window"), read(spark, sf_dir, "act_dump"), **SERIES)
    return got.filter("not missing").select("dump_id", "sig_path", "slot", F.round("value", 4).alias("value"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, links = hierarchy.module_links(*(read(spark, sf_dir, t) for t in ("nl_module", "nl_inst", "sp_device")))
    return hierarchy.hierarchy(nodes, links).join(nodes.select("id", F.col("grp").alias("src_id")), "id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = ~F.col("cyclic")
    return _tree(spark, sf_dir).select(
        "src_id", F.col("name").alias("module_name"), F.when(ok, F.col("root_name")).otherwise("").alias("root_name"), F.when(ok, F.col("depth")).otherwise(-1).cast("long").alias("node_depth"),
        F.when(ok, F.col("n_below")).otherwise(-1).cast("long").alias("n_below"), F.when(ok, F.col("path")).otherwise("").alias("full_path"),
    )


def p2_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry and exit ranks: x lies below y if they share the root and y.entry < x.entry < y.leave."""
    return _tree(spark, sf_dir).select("src_id", F.col("name").alias("module_name"), "root_name", "cyclic", "entry", "leave")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.reasons(read(spark, sf_dir, "raw_line"))


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = rejects.split(read(spark, sf_dir, "raw_line"))
    return good.select("line_id", "src_id", "fmt", "line_block").distinct()


def _converted(spark: SparkSession, sf_dir: str, prior: float = units.SPEC) -> DataFrame:
    return units.convert(*(read(spark, sf_dir, t) for t in ("spef_net", "sdc_clock", "act_dump", "src_unit")), prior)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.found(_converted(spark, sf_dir))


def p5_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every readable value in its common unit, with the decoded unit and whether one is stated."""
    return _converted(spark, sf_dir).select("tbl", "rec_id", "quantity", (F.col("freq") | F.col("stated").isNotNull()).alias("is_stated"), F.round("decoded", 9).alias("decoded"), F.round("value", 6).alias("value"))


def p5_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a unit whose values jump from their device's level by a power of 1000: the unit the chain decodes when nothing but
    a weak prior speaks for the common one."""
    return units.switches(_converted(spark, sf_dir, prior=2.0))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.cascade(*(read(spark, sf_dir, t) for t in ("nl_inst", "nl_module", "lib_cell", "spef_net")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direct orphans of the cascade."""
    return _orphans(spark, sf_dir).filter("level = 0").drop("level")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table, field, cause and month, direct and inherited, and the longest chain."""
    direct = F.col("level") == 0
    found = _orphans(spark, sf_dir)
    return found.groupBy("tbl", "ref_field", "cause", "seen_month").agg(F.count(F.when(direct, 1)).alias("n_direct"), F.count(F.when(~direct, 1)).alias("n_inherited"), F.max("level").cast("long").alias("deepest"))


QUERIES = {"p1_found": p1_found, "p1_grid": p1_grid, "p1_covered": p1_covered, "p2_found": p2_found, "p2_intervals": p2_intervals, "p4_found": p4_found, "p4_loaded": p4_loaded, "p5_found": p5_found, "p5_converted": p5_converted, "p5_switches": p5_switches, "p6_found": p6_found, "p6_report": p6_report}


_SLOTS_SQL = """WITH s AS (SELECT dump_id, max(step_s) AS s FROM act_dump GROUP BY 1),
w AS (SELECT DISTINCT dump_id, sig_path, from_s AS f, to_s AS t, s FROM sweep_window JOIN s USING (dump_id) WHERE from_s IS NOT NULL AND to_s IS NOT NULL AND toggles IS NOT NULL AND to_s > from_s AND toggles >= 0),
c AS (SELECT DISTINCT dump_id, sig_path, k FROM (SELECT *, unnest(range(greatest(0, CAST(floor(f / s) AS BIGINT) - 1), CAST(ceil(t / s) AS BIGINT) + 2)) AS k FROM w) WHERE (k + 0.5::DOUBLE) * s >= f AND (k + 0.5::DOUBLE) * s < t),
b AS (SELECT dump_id, sig_path, min(k) AS lo, max(k) AS hi FROM c GROUP BY 1, 2), g AS (SELECT dump_id, sig_path, unnest(range(lo, hi + 1)) AS slot FROM b)
"""
_TREE_SQL = r"""WITH RECURSIVE m AS (SELECT src_id, CASE WHEN fmt = 'sp' THEN lower(n) ELSE n END AS k, min(n) AS n FROM (SELECT src_id, fmt, rtrim(replace(module_name, '\', '')) AS n FROM nl_module) GROUP BY 1, 2),
f AS (SELECT DISTINCT src_id, fmt FROM nl_module),
r AS (SELECT src_id, cell AS c, parent_name AS p FROM nl_inst UNION ALL SELECT src_id, model, subckt FROM sp_device WHERE upper(kind) = 'X'),
q AS (SELECT DISTINCT src_id, CASE WHEN fmt = 'sp' THEN lower(c) ELSE c END AS c, CASE WHEN fmt = 'sp' THEN lower(p) ELSE p END AS p FROM (SELECT r.src_id, fmt, rtrim(replace(c, '\', '')) AS c, rtrim(replace(p, '\', '')) AS p FROM r JOIN f USING (src_id))),
l AS (SELECT q.src_id, c, min(p) AS p FROM q JOIN m a ON a.src_id = q.src_id AND a.k = c JOIN m b ON b.src_id = q.src_id AND b.k = p GROUP BY 1, 2),
t(src_id, k, root, depth, path, above) AS (SELECT m.src_id, m.k, m.n, 0, m.n, CAST([] AS VARCHAR[]) FROM m LEFT JOIN l ON l.src_id = m.src_id AND l.c = m.k WHERE l.c IS NULL
  UNION ALL SELECT m.src_id, m.k, t.root, t.depth + 1, t.path || '/' || m.n, list_append(t.above, t.k) FROM t JOIN l ON l.src_id = t.src_id AND l.p = t.k JOIN m ON m.src_id = l.src_id AND m.k = l.c),
b AS (SELECT src_id, a AS k, count(*) AS n FROM (SELECT src_id, unnest(above) AS a FROM t) GROUP BY 1, 2)
"""

def _units_sql(found: bool) -> str:
    """p5_found and p5_converted by the rule alone: a unit in the text, else in the remark or timescale, else in the header, else the common
    one."""
    ohm = chr(8486)
    n, unit = units.NUMBER, r"[^\s\[\]=0-9.+][^\s\[\]=0-9]*"
    front, back = rf"^({n})\s*(?:\[\s*({unit})\s*\]|({unit}))?$", rf"^({unit})\s*[= ]\s*({n})$"
    head = rf"(?:^|[\s:])({n})?\s*([A-Za-zµμΩω{ohm}-]+)\s*$"
    low = lambda c: f"replace(lower({c}), chr(8486), 'ω')"
    words = ", ".join(f"('{k}', '{w}', {p}, {str(f).lower()})" for k in ("cap", "res", "time") for w, (p, f) in units.unit_table(k).items())
    spoken = lambda k: "MAP {" + ", ".join(f"'{w}': {p}" for w, (p, f) in (units.unit_table(k) | ({"ω": (0, False)} if k == "res" else {})).items() if (len(w) > 1 or w == "ω") and not f) + "}"
    fields = " UNION ALL ".join(f"SELECT '{t}' AS tbl, {i} AS rec_id, src_id, '{q}' AS quantity, '{k}' AS kind, trim({c}, chr(32)||chr(9)||chr(13)||chr(10)) AS x, {'remark' if t == 'spef_net' else 'NULL'} AS remark, {'timescale' if t == 'act_dump' else 'NULL'} AS scale FROM {t}" for q, t, i, c, k in units.FIELDS)
    said = lambda c, k: f"CASE WHEN u.fr IS NOT TRUE AND coalesce(try_cast(nullif(regexp_extract({c}, '{head}', 1), '') AS DOUBLE), 1) > 0 THEN log10(coalesce(try_cast(nullif(regexp_extract({c}, '{head}', 1), '') AS DOUBLE), 1)) + CASE WHEN regexp_extract({c}, '{head}', 2) = 'f' THEN -15 ELSE u.p END END"
    start = f"""WITH u(kind, w, p, fr) AS (VALUES {words}),
h AS (SELECT src_id, q, max_by(v, (loaded_at, v)) AS v FROM (SELECT s.src_id, s.loaded_at, CASE s.q WHEN 'time' THEN 'period' ELSE s.q END AS q, {said("s.unit_text", "s.q")} AS v
  FROM (SELECT *, CASE lower(quantity) WHEN 'capacitance' THEN 'cap' WHEN 'resistance' THEN 'res' WHEN 'time' THEN 'time' END AS q FROM src_unit) s JOIN u ON u.kind = s.q AND u.w = {low(f"regexp_extract(s.unit_text, '{head}', 2)")}) WHERE v IS NOT NULL GROUP BY 1, 2),
d AS (SELECT scale, {said("scale", "'time'")} AS v FROM (SELECT DISTINCT timescale AS scale FROM act_dump) a JOIN u ON u.kind = 'time' AND u.w = {low(f"regexp_extract(a.scale, '{head}', 2)")}),
t AS ({fields}),
r AS (SELECT *, CASE WHEN regexp_matches(x, '{front}') THEN regexp_extract(x, '{front}', 1) WHEN regexp_matches(x, '{back}') THEN regexp_extract(x, '{back}', 2) END AS num,
  CASE WHEN regexp_matches(x, '{front}') THEN regexp_extract(x, '{front}', 2) || regexp_extract(x, '{front}', 3) ELSE regexp_extract(x, '{back}', 1) END AS word,
  list_filter(list_transform(regexp_extract_all(remark, '[A-Za-zµμΩω{ohm}][A-Za-zµμΩω{ohm}-]*'), lambda y: CASE kind WHEN 'cap' THEN ({spoken("cap")})[{low("y")}] ELSE ({spoken("res")})[{low("y")}] END), lambda y: y IS NOT NULL)[1] AS spoken FROM t),
k AS (SELECT r.*, CASE WHEN word = 'f' THEN -15 ELSE u.p END AS p, word <> 'f' AND coalesce(u.fr, false) AS fr, CAST(num AS DOUBLE) AS val FROM r LEFT JOIN u ON u.kind = r.kind AND u.w = {low("word")} WHERE num IS NOT NULL),
e AS (SELECT k.*, CASE quantity WHEN 'cap' THEN -15 WHEN 'period' THEN -9 ELSE 0 END AS common, CASE quantity WHEN 'cap' THEN 3 WHEN 'res' THEN 3 WHEN 'period' THEN 6 ELSE 15 END AS fine, coalesce(k.p, k.spoken, d.v, h.v) AS unit
  FROM k LEFT JOIN d ON k.quantity = 'sim_time' AND d.scale = k.scale LEFT JOIN h ON h.src_id = k.src_id AND h.q = k.quantity WHERE word = '' OR k.p IS NOT NULL)"""
    if not found:
        return start + """ SELECT DISTINCT tbl, rec_id, quantity, fr OR unit IS NOT NULL AS is_stated, CASE WHEN fr THEN 0.0::DOUBLE ELSE round(coalesce(unit - common, 0.0::DOUBLE), 9) END AS decoded,
round(CASE WHEN fr AND val > 0 THEN 1.0 / (val * pow(10.0, unit)) / pow(10.0, common) WHEN NOT fr THEN val * pow(10.0, round(coalesce(unit - common, 0), 12)) END, 6) AS value FROM e"""
    return (
        start
        + """, f AS (SELECT *, round(unit - common, 12) + fine AS s FROM e WHERE val > 0 AND (fr OR abs(unit - common) > 1e-9))
SELECT DISTINCT tbl, rec_id, quantity, CAST(round(CASE WHEN fr THEN pow(10.0, 15.0 - unit) / val WHEN s >= 0 THEN val * pow(10.0, s) ELSE val / pow(10.0, -s) END) AS BIGINT) AS val_int FROM f"""
    )


_ORPHANS_SQL = r"""WITH m AS (SELECT src_id, fmt, rtrim(replace(module_name,'\',''), chr(32)||chr(9)||chr(13)||chr(10)) AS n, min(loaded_at) AS at FROM nl_module GROUP BY ALL),
i AS (SELECT DISTINCT inst_id, src_id, rtrim(replace(cell,'\',''), chr(32)||chr(9)||chr(13)||chr(10)) AS k, loaded_at AS t FROM nl_inst
  WHERE cell IS NOT NULL AND len(list_filter(conns, lambda c: NOT regexp_matches(upper(coalesce(c.pin,'')), '^(VDD|VSS|VPWR|VGND)|^(VPB|VNB)$'))) > 0),
l AS (SELECT rtrim(replace(cell_name,'\',''), chr(32)||chr(9)) AS k, added_at, deleted_at FROM lib_cell),
lk AS (SELECT DISTINCT k FROM l),
lf AS (SELECT DISTINCT i.inst_id FROM i JOIN l ON i.k = l.k AND l.added_at <= i.t AND (l.deleted_at IS NULL OR i.t < l.deleted_at)),
ld AS (SELECT DISTINCT i.inst_id FROM i JOIN l ON i.k = l.k AND l.deleted_at <= i.t),
mm AS (SELECT i.inst_id, bool_or(m.at <= i.t) AS ok FROM i JOIN m ON i.src_id = m.src_id AND lower(i.k) = lower(m.n) AND (m.fmt = 'sp' OR m.n = i.k) GROUP BY 1),
n AS (SELECT src_id, rtrim(replace(c.net,'\',''), chr(32)||chr(9)||chr(13)||chr(10)) AS k, min(loaded_at) AS at FROM (SELECT src_id, loaded_at, unnest(conns) AS c FROM nl_inst) GROUP BY 1, 2),
r AS (SELECT net_id, src_id, 'net' AS f, net AS x, loaded_at AS t FROM spef_net UNION ALL SELECT net_id, src_id, 'coupling', c.other_net, loaded_at FROM (SELECT net_id, src_id, loaded_at, unnest(coupling) AS c FROM spef_net)),
rk AS (SELECT DISTINCT net_id, src_id, f, rtrim(replace(x,'\',''), chr(32)||chr(9)||chr(13)||chr(10)) AS k, t FROM r WHERE x IS NOT NULL)
"""
_DIRECT_SQL = """SELECT 'nl_inst' AS tbl, 'cell' AS ref_field, i.inst_id AS rec_id, i.k AS missing_key, CASE WHEN ld.inst_id IS NOT NULL THEN 'deleted' WHEN lk.k IS NOT NULL OR mm.inst_id IS NOT NULL THEN 'late' ELSE 'missing' END AS cause, strftime(i.t, '%Y-%m') AS seen_month
FROM i LEFT JOIN lf USING (inst_id) LEFT JOIN ld USING (inst_id) LEFT JOIN mm USING (inst_id) LEFT JOIN lk ON i.k = lk.k WHERE lf.inst_id IS NULL AND NOT coalesce(mm.ok, false)
UNION ALL SELECT 'spef_net', rk.f, rk.net_id, rk.k, CASE WHEN n.k IS NULL THEN 'missing' ELSE 'late' END, strftime(rk.t, '%Y-%m') FROM rk LEFT JOIN n ON rk.src_id = n.src_id AND rk.k = n.k WHERE n.k IS NULL OR n.at > rk.t
"""
# links between modules, modules at or below one that comes too late with the fewest steps, the instances in them, nets of orphaned instances only
_CASCADE_SQL = (
    r"""dir AS (""" + _DIRECT_SQL + r"""),
ii AS (SELECT DISTINCT inst_id, src_id, lower(rtrim(replace(cell,'\',''), chr(32)||chr(9)||chr(13)||chr(10))) AS c, lower(rtrim(replace(parent_name,'\',''), chr(32)||chr(9)||chr(13)||chr(10))) AS p, rtrim(replace(cell,'\',''), chr(32)||chr(9)||chr(13)||chr(10)) AS k, loaded_at AS t, conns FROM nl_inst),
served AS (SELECT DISTINCT ii.inst_id FROM ii JOIN l ON ii.k = l.k AND l.added_at <= ii.t AND (l.deleted_at IS NULL OR ii.t < l.deleted_at)),
im AS (SELECT DISTINCT ii.inst_id, ii.src_id, ii.c, ii.p FROM ii JOIN m ON ii.src_id = m.src_id AND ii.c = lower(m.n) AND (m.fmt = 'sp' OR m.n = ii.k) LEFT JOIN served USING (inst_id) WHERE served.inst_id IS NULL),
lk2 AS (SELECT DISTINCT src_id, c, p FROM im WHERE p IS NOT NULL AND p <> c),
bel(src_id, low, level) AS (SELECT DISTINCT im.src_id, im.c, 1 FROM im JOIN dir ON dir.tbl = 'nl_inst' AND dir.rec_id = im.inst_id UNION SELECT lk2.src_id, lk2.c, bel.level + 1 FROM bel JOIN lk2 ON lk2.src_id = bel.src_id AND lk2.p = bel.low WHERE bel.level < 2000),
bl AS (SELECT src_id, low, min(level) AS level FROM bel GROUP BY 1, 2),
inn AS (SELECT ii.inst_id, ii.src_id, ii.p AS low, ii.t, bl.level FROM ii JOIN bl ON bl.src_id = ii.src_id AND bl.low = ii.p),
orp AS (SELECT inst_id, min(level) AS level FROM (SELECT inst_id, level FROM inn UNION ALL SELECT rec_id, 0 FROM dir WHERE tbl = 'nl_inst') GROUP BY 1),
en AS (SELECT inst_id, src_id, rtrim(replace(c.net,'\',''), chr(32)||chr(9)||chr(13)||chr(10)) AS k FROM (SELECT inst_id, src_id, unnest(conns) AS c FROM ii) WHERE c.net IS NOT NULL),
hn AS (SELECT en.src_id, en.k, min(orp.level) + 1 AS level FROM en LEFT JOIN orp USING (inst_id) GROUP BY 1, 2 HAVING count(*) = count(orp.level)),
allo AS (SELECT *, 0 AS level FROM dir UNION ALL SELECT DISTINCT 'nl_inst', 'parent_name', inst_id, low, 'inherited', strftime(t, '%Y-%m'), level FROM inn
  UNION ALL SELECT DISTINCT 'spef_net', rk.f, rk.net_id, rk.k, 'inherited', strftime(rk.t, '%Y-%m'), hn.level FROM rk JOIN hn USING (src_id, k) JOIN n USING (src_id, k) WHERE n.at <= rk.t)
SELECT tbl, ref_field, cause, seen_month, count(*) FILTER (level = 0) AS n_direct, count(*) FILTER (level > 0) AS n_inherited, CAST(max(level) AS BIGINT) AS deepest FROM allo GROUP BY ALL
"""
)


ORACLE_SQL = {
    "p5_found": _units_sql(True),
    "p5_converted": _units_sql(False),
    "p1_covered": _SLOTS_SQL.replace("from_s AS f, to_s AS t, s FROM", "from_s AS f, to_s AS t, toggles AS v, s FROM").replace("c AS (", "x AS (SELECT dump_id, sig_path, v * s / (t - f) AS y, unnest(range(greatest(0, CAST(floor(f / s) AS BIGINT) - 1), CAST(ceil(t / s) AS BIGINT) + 2)) AS k, f, t, s FROM w), c AS (", 1)
    + "SELECT dump_id, sig_path, k AS slot, round(avg(y), 4) AS value FROM x WHERE (k + 0.5::DOUBLE) * s >= f AND (k + 0.5::DOUBLE) * s < t GROUP BY ALL",
    "p1_found": _SLOTS_SQL + "SELECT g.dump_id, g.sig_path, g.slot FROM g LEFT JOIN c ON c.dump_id = g.dump_id AND c.sig_path = g.sig_path AND c.k = g.slot WHERE c.k IS NULL",
    "p2_found": _TREE_SQL + "SELECT m.src_id, m.n AS module_name, coalesce(t.root, '') AS root_name, CAST(coalesce(t.depth, -1) AS BIGINT) AS node_depth, CAST(CASE WHEN t.k IS NULL THEN -1 ELSE coalesce(b.n, 0) END AS BIGINT) AS n_below, coalesce(t.path, '') AS full_path FROM m LEFT JOIN t ON t.src_id = m.src_id AND t.k = m.k LEFT JOIN b ON b.src_id = m.src_id AND b.k = m.k",
    "p6_found": _ORPHANS_SQL + _DIRECT_SQL,
    "p6_report": _ORPHANS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + "," + _CASCADE_SQL,
}
