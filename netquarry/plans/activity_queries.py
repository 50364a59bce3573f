"""Switching-activity queries over `events`: a user is a net, the event type a nine-state level, the time in µs a tick."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.core import read
from netquarry.functions import names
from netquarry.operators import activity as A
from netquarry.sources import saif, vcd

LEVELS = {"click": "1", "view": "0", "purchase": "x", "error": "h", "signup": "l"}
HOUR = 3_600_000_000
START = 1_704_067_200_000_000  # 2024-01-01
END = START + 20 * 24 * HOUR


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    value = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("net"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("tick"), F.try_element_at(value, F.col("event_type")).alias("value"))


SQL = """WITH ev AS (SELECT 'u' || user_id AS net, event_id AS seq, epoch_us(ts) AS tick, value AS num, props,
  CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 1 WHEN 'view' THEN 0 WHEN 'signup' THEN 0 END AS level FROM events),
kn AS (SELECT *, lag(level) OVER (PARTITION BY net ORDER BY seq) AS prev FROM ev WHERE level IS NOT NULL),
tg AS (SELECT ev.*, CAST(coalesce(kn.level <> kn.prev, false) AS BIGINT) AS toggle FROM ev LEFT JOIN kn USING (net, seq))
"""


def toggle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events rendered as a dump, its lines scanned and its toggles counted."""
    c = changes(spark, sf_dir)
    head = spark.range(1).select(F.lit(0).cast("long").alias("seq"), F.lit("$timescale 1us $end $scope module top $end").alias("line"))
    decl = c.select("net").distinct().select(F.lit(1).cast("long").alias("seq"), F.concat(F.lit("$var wire 1 "), F.col("net"), F.lit(" "), F.col("net"), F.lit(" $end")).alias("line"))
    close = spark.range(1).select(F.lit(2).cast("long").alias("seq"), F.lit("$upscope $end $enddefinitions $end").alias("line"))
    body = c.select((F.col("seq") * 2 + 10).alias("seq"), F.inline(F.array(F.struct(F.lit(0).alias("k"), F.concat(F.lit("#"), F.col("tick").cast("string")).alias("line")), F.struct(F.lit(1).alias("k"), F.concat("value", "net").alias("line")))))
    lines = head.unionByName(decl).unionByName(close).unionByName(body.select((F.col("seq") + F.col("k")).alias("seq"), "line")).withColumn("src_id", F.lit(1).cast("long"))
    decls, found = vcd.scan(lines)
    counted = A.toggle_count(found.filter("kind = 'scalar'").withColumnRenamed("sym", "net"))
    # every name a code is declared with is credited
    return decls.select(F.col("sym").alias("net"), "path").join(counted, "net").select("path", "n_toggles")


def vcd_free_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a dump in free form: comments that hold changes, dump commands and several changes in a line, a value and its symbol
    in two lines, two names for each code. Every name is credited."""
    c = changes(spark, sf_dir)
    net, k = F.col("net"), F.col("seq") % 4
    head = spark.range(1).select(F.lit(0).cast("long").alias("seq"), F.lit("$timescale 1us $end $scope module top $end").alias("line"))
    decl = c.select("net").distinct().select(F.lit(1).cast("long").alias("seq"), F.concat(F.lit("$var wire 1 "), net, F.lit(" "), net, F.lit(" $end $var wire 1 "), net, F.lit(" same_"), net, F.lit(" $end")).alias("line"))
    close = spark.range(1).select(F.lit(2).cast("long").alias("seq"), F.lit("$upscope $end $enddefinitions $end").alias("line"))
    time, change = F.concat(F.lit("#"), F.col("tick").cast("string")), F.concat("value", net)
    one = F.when(k == 0, F.concat(F.lit("  "), time, F.lit(" "), change)).when(k == 1, F.concat(F.lit("$comment #1 0"), net, F.lit(" 1"), net)).when(k == 2, F.concat(time, F.lit(" $dumpvars "), change)).otherwise(F.concat(F.lit("\t"), time, F.lit(" b"), F.col("value")))
    two = F.when(k == 0, F.lit("")).when(k == 1, F.concat(F.lit("x"), net, F.lit(" $end "), time, F.lit(" "), change)).when(k == 2, F.lit("$end $dumpoff $end")).otherwise(F.concat(F.lit(" "), net))
    body = c.select((F.col("seq") * 2 + 10).alias("seq"), F.inline(F.array(F.struct(F.lit(0).alias("k"), one.alias("line")), F.struct(F.lit(1).alias("k"), two.alias("line")))))
    lines = head.unionByName(decl).unionByName(close).unionByName(body.select((F.col("seq") + F.col("k")).alias("seq"), "line")).withColumn("src_id", F.lit(1).cast("long"))
    decls, found = vcd.scan(lines)
    counted = A.toggle_count(found.filter("length(value) = 1").withColumnRenamed("sym", "net"))
    return decls.select(F.col("sym").alias("net"), "path").join(counted, "net").select("path", "n_toggles")


def sweep_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of every net in every window of a bounded sweep; most windows are empty."""
    c = changes(spark, sf_dir).withColumn("path", F.concat(F.lit("tb.dut."), F.col("net")))
    b = A.sweep_bounds(spark, START, END, 24 * HOUR, 48 * HOUR, END, 1e-6)
    nets = c.select("net").distinct().unionByName(spark.createDataFrame([("unknown",)], "net string"))
    return A.window_rates(nets, A.sweep(c, START, END, 24 * HOUR, 48 * HOUR, ["path"]), b, "dut").select("win", "net", F.round("rate", 9).alias("rate"))


def toggle_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.window_toggles(changes(spark, sf_dir), START + 24 * HOUR, START + 72 * HOUR)


def _sweep(window: int, step: int):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return A.sweep(changes(spark, sf_dir), START, END, window * HOUR, step * HOUR)

    return q


def _sweep_sql(window: int, step: int) -> str:
    n = (END - START) // (step * HOUR)
    return SQL + f"""SELECT w.win AS win, net, CAST(sum(toggle) AS BIGINT) AS n_toggles, count(*) AS n_events FROM (SELECT range AS win FROM range({n})) w
JOIN tg ON tg.tick >= {START} + w.win * {step * HOUR} AND tg.tick < {START} + w.win * {step * HOUR} + {window * HOUR} AND tg.tick < {END} GROUP BY 1, 2"""


def sweep_folded_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump that ends within the sweep: windows after its end have no duration and fold into the last that has."""
    cut = START + 10 * 24 * HOUR
    b = A.sweep_bounds(spark, START, END, 24 * HOUR, 24 * HOUR, cut, 1e-6)
    return A.fold_tail(A.sweep(changes(spark, sf_dir), START, END, 24 * HOUR, 24 * HOUR), b)


def net_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rates of all nets of the dump, and of three that it does not have."""
    c = A.toggle_count(changes(spark, sf_dir)).select(F.concat(F.lit("tb.dut."), F.col("net")).alias("path"), "n_toggles")
    known = read(spark, sf_dir, "events").filter("user_id is not null").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("net"))
    nets = known.distinct().unionByName(spark.range(0, 3).select(F.concat(F.lit("unknown"), F.col("id").cast("string")).alias("net")))
    return A.rates(nets, c, F.lit(1000.0), "dut").select("net", F.round("rate", 9).alias("rate"))


def real_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("net"), F.col("event_id").alias("seq"), F.floor(F.col("value")).cast("long").cast("string").alias("value"))
    return A.real_changes(e)


def vector_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0))
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("net"), F.col("event_id").alias("seq"), F.bin(F.pmod(k, F.lit(256))).alias("value"), F.lit(8).alias("width"))
    return A.toggle_count(A.vector_bits(e), ["net", "bit"])


def saif_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts rendered as s-expressions, one file of nets in nested instances, scanned back."""
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("tc"))
    net = F.format_string("(INSTANCE u%d (NET (a\\[0\\] (T0 10) (T1 5) (TX 1) (TC %d))))", F.col("user_id"), F.col("tc"))
    files = e.select(F.col("user_id").alias("src_id"), F.concat(F.lit('(SAIFILE (TIMESCALE 1 ns) (DURATION 50) (INSTANCE "top" '), net, F.lit("))")).alias("text"))
    return saif.scan(files).select("path", "tc", "t_known", "t_x", F.round("rate", 3).alias("rate"))


def net_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as nets, region.nation.customer as paths; half the leaves are made to collide."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    leaf = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("k"), (F.col("c_custkey") % 50).cast("string"))).otherwise(F.col("c_name"))
    p = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(leaf.alias("net"), F.concat_ws(".", "r_name", "n_name", leaf).alias("path"))
    return names.resolve(p, p)


def leaf_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.concat_ws(".", "p_brand", "p_type", (F.col("p_partkey") % 100).cast("string")).alias("path"))
    return names.collisions(p)


QUERIES = {
    "toggle_count": toggle_count, "toggle_window": toggle_window, "toggle_sweep_tumbling": _sweep(12, 12), "toggle_sweep_hopping": _sweep(6, 2), "toggle_sweep_gapped": _sweep(2, 8),
    "sweep_folded_tail": sweep_folded_tail, "net_rates": net_rates, "vcd_free_form": vcd_free_form, "sweep_rates": sweep_rates, "real_changes": real_changes, "vector_toggles": vector_toggles, "saif_rate": saif_rate, "net_resolve": net_resolve, "leaf_collisions": leaf_collisions,
}
ORACLE_SQL = {
    "toggle_count": SQL + "SELECT 'top.' || net AS path, CAST(sum(toggle) AS BIGINT) AS n_toggles FROM tg GROUP BY 1",
    "toggle_window": SQL + f"SELECT net, CAST(sum(toggle) AS BIGINT) AS n_toggles, count(*) AS n_events FROM tg WHERE tick >= {START + 24 * HOUR} AND tick < {START + 72 * HOUR} GROUP BY 1",
    "toggle_sweep_tumbling": _sweep_sql(12, 12),
    "toggle_sweep_hopping": _sweep_sql(6, 2),
    "toggle_sweep_gapped": _sweep_sql(2, 8),
    "sweep_folded_tail": SQL + f"SELECT least(CAST(floor((tick - {START}) / {24 * HOUR}.0) AS BIGINT), 9) AS win, net, CAST(sum(toggle) AS BIGINT) AS n_toggles, count(*) AS n_events FROM tg WHERE tick >= {START} AND tick < {END} GROUP BY 1, 2",
    "vcd_free_form": SQL + "SELECT 'top.' || x AS path, n_toggles FROM (SELECT net, CAST(sum(toggle) AS BIGINT) AS n_toggles, unnest([net, 'same_' || net]) AS x FROM tg GROUP BY net)",
    "sweep_rates": SQL + f"SELECT w.win, n.net, round(coalesce(sum(toggle), 0) / 86400.0, 9)::DOUBLE AS rate FROM (SELECT range AS win FROM range(10)) w CROSS JOIN (SELECT DISTINCT net FROM ev UNION ALL SELECT 'unknown') n LEFT JOIN tg ON tg.net = n.net AND tg.tick >= {START} + w.win * {48 * HOUR} AND tg.tick < {START} + w.win * {48 * HOUR} + {24 * HOUR} AND tg.tick < {END} GROUP BY 1, 2",
    "net_rates": SQL + "SELECT n.net, round(coalesce(sum(toggle), 0) / 1000.0, 9) AS rate FROM (SELECT DISTINCT 'u' || user_id AS net FROM events WHERE user_id IS NOT NULL UNION ALL SELECT 'unknown' || range FROM range(3)) n LEFT JOIN tg USING (net) GROUP BY 1",
    "real_changes": "WITH p AS (SELECT user_id AS net, CAST(floor(value) AS BIGINT) AS v, lag(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT net, CAST(sum(CASE WHEN v <> p THEN 1 ELSE 0 END) AS BIGINT) AS n_changes FROM p GROUP BY 1",
    "vector_toggles": "WITH b AS (SELECT user_id AS net, event_id, r.range AS bit, (coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), 0) % 256 >> CAST(r.range AS INT)) & 1 AS v FROM events, range(8) r), p AS (SELECT net, bit, v, lag(v) OVER (PARTITION BY net, bit ORDER BY event_id) AS p FROM b) SELECT net, bit, CAST(sum(CASE WHEN v <> p THEN 1 ELSE 0 END) AS BIGINT) AS n_toggles FROM p GROUP BY 1, 2",
    "saif_rate": "SELECT 'top.u' || user_id || '.a[0]' AS path, CAST(count(*) AS DOUBLE) AS tc, 15.0::DOUBLE AS t_known, 1.0::DOUBLE AS t_x, round(count(*) / 50e-9, 3) AS rate FROM events GROUP BY user_id",
    "net_resolve": "WITH p AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'k' || (c_custkey % 50) ELSE c_name END AS net, r_name || '.' || n_name || '.' || CASE WHEN c_custkey % 2 = 0 THEN 'k' || (c_custkey % 50) ELSE c_name END AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT net, CASE WHEN count(*) = 1 THEN min(path) END AS path, count(*) AS candidates FROM p GROUP BY 1",
    "leaf_collisions": "SELECT leaf, count(*) AS n_paths FROM (SELECT DISTINCT CAST(p_partkey % 100 AS VARCHAR) AS leaf, p_brand, p_type FROM part) GROUP BY 1 HAVING count(*) > 1",
}
