"""Format queries: table rows are rendered as the text of a format, scanned, and queried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.core import canon, materialise, read
from netquarry.functions import names as N
from netquarry.operators import parasitics as R
from netquarry.operators.library import lookup
from netquarry.sources import layout, lef, liberty, sdc, spef, spice, tables, units_of_text, verilog, yosys

S = lambda c: F.col(c).cast("string")


def _join(df: DataFrame, key: str, line, order: str, head="", tail="", sep: str = "\n") -> DataFrame:
    """One text a key from ordered lines."""
    t = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("x"))
    return t.select(F.col(key).alias("src_id"), F.concat(F.lit(head) if isinstance(head, str) else head, F.array_join(F.col("x.l"), sep), F.lit(tail) if isinstance(tail, str) else tail).alias("text"))


def _verilog_conns(li: DataFrame) -> DataFrame:
    """A module for each order, an instance for each line: a bus bit, an escaped name and a constant are connected."""
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    inst = F.format_string("  P%d u%d_%d_%d (.A(a[%d]), .B(1'b0), .Y(\\n%d.y ), .C({a[7:6], b}));", "l_partkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_linenumber") % 8, "l_suppkey")
    files = _join(li, "l_orderkey", inst, "l_linenumber", "/* P9 x(.A(b)); */ module m (input [7:0] a, input b); // head\n", "\nendmodule\n")
    p = materialise(units_of_text.scan(files, verilog.parse, verilog.SCHEMA), "parsed")
    conns, insts = units_of_text.table(p, "conns"), units_of_text.table(p, "insts")
    j = conns.select("src_id", "inst", "pin", "net").join(insts.select("src_id", F.col("ord").cast("long").alias("inst"), "cell", "name"), ["src_id", "inst"])
    return j.select(F.col("src_id").alias("l_orderkey"), "cell", "name", "pin", "net")


def verilog_conns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verilog_conns(read(spark, sf_dir, "lineitem"))


def yosys_conns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module for each region, a cell for each nation; nets and ports share bit numbers."""
    n = read(spark, sf_dir, "nation")
    cell = F.format_string('"%s": {"type": "\\\\N", "connections": {"A": [%d], "B": ["0"], "Q": [%d, %d]}}', "n_name", 2 + F.col("n_nationkey") % 3, 10 + F.col("n_nationkey"), F.lit(5))
    head = '{"modules": {"leaf": {"attributes": {}, "ports": {}, "cells": {}, "netnames": {}}, "top": {"attributes": {"top": "00000001"}, "ports": {"p": {"direction": "input", "bits": [2]}, "q": {"direction": "output", "bits": [3, 5]}}, "cells": {'
    tail = '}, "netnames": {"\\\\w": {"bits": [2]}, "v": {"bits": [4]}}}}}'
    t = yosys.scan(_join(n, "n_regionkey", cell, "n_nationkey", head, tail, ","))
    return t["conn"].join(t["inst"].select("src_id", "inst", "cell"), ["src_id", "inst"]).select(F.col("src_id").alias("n_regionkey"), "inst", "cell", "pin", "net")


def _sdc_exceptions(s: DataFrame) -> DataFrame:
    """False and multicycle paths from suppliers to nations' pins, and which of them cover each supplier."""
    line = F.when(F.col("s_suppkey") % 3 == 0, F.format_string("set_false_path -from [get_cells {s%d s%d}] -to [get_pins n%d/Q]", "s_suppkey", F.col("s_suppkey") + 1, "s_nationkey")).otherwise(F.format_string("set_multicycle_path %d -from [get_ports s%d] \\\n  -to [all_outputs]", F.col("s_suppkey") % 5 + 1, "s_suppkey"))
    files = _join(s, "s_nationkey", line, "s_suppkey", "# head\nset_driving_cell x; ")
    p = units_of_text.scan(files, sdc.parse, sdc.SCHEMA)
    e = units_of_text.table(p, "exceptions")
    return e.select(F.col("src_id").alias("s_nationkey"), "kind", F.coalesce("mult", F.lit(0)).alias("mult"), F.array_join("from_set", ",").alias("from_set"), F.array_join("to_set", ",").alias("to_set"))


def sdc_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sdc_exceptions(read(spark, sf_dir, "supplier"))


def sdc_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends that the exceptions of sdc_exceptions spell out."""
    s = read(spark, sf_dir, "supplier")
    line = F.format_string("set_false_path -from [get_cells {s%d s%d}] -to [all_outputs]", "s_suppkey", F.col("s_suppkey") + 1)
    p = units_of_text.scan(_join(s, "s_nationkey", line, "s_suppkey", "# head\n"), sdc.parse, sdc.SCHEMA)
    return sdc.named_endpoints(units_of_text.table(p, "exceptions")).groupBy(F.col("src_id").alias("s_nationkey"), "side", "name").agg(F.count("*").alias("n"))


def spef_pin_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the pins that the parasitics of the orders hook up, and of pins they lack."""
    t = spef.scan(spef_lines(spark, sf_dir))
    pins = read(spark, sf_dir, "customer").select(F.lit(1).cast("long").alias("src_id"), F.format_string("net[%d]", "c_custkey").alias("inst"), F.when(F.col("c_custkey") % 4 > 0, "Y").otherwise("A").alias("pin"))
    return spef.pin_nodes(t["conn"], pins).select("inst", "pin", "node")


def sdc_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that are not modelled, and whether ignoring them can move a slack."""
    e = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    cmd = F.when(F.col("event_type") == "click", "set_driving_cell a").when(F.col("event_type") == "view", "set_max_area 0").when(F.col("event_type") == "error", "group_path -name x").otherwise("set_load 1")
    p = units_of_text.scan(_join(e, "user_id", cmd, "event_type"), sdc.parse, sdc.SCHEMA)
    i = units_of_text.table(p, "ignored")
    return i.select(F.col("src_id").alias("user_id"), "command", F.col("command").isin(sdc.TIMING_AFFECTING).alias("affects"), sdc.effect("command").alias("effect")).distinct()


def spef_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of mapped nets: customers with an order that is taken; capacitors and resistors as triplets, in pF and kilo-ohm."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("v"))
    c = o.groupBy("o_custkey").agg(F.sum("v").alias("t"))
    big = 1 << 32
    head = spark.createDataFrame([(0, "*SPEF x"), (1, "*c_unit 1 pf"), (2, "*R_UNIT 1 KOHM // x"), (3, "*NAME_MAP")], "seq long, line string")
    m = c.select((F.col("o_custkey") + 10).alias("seq"), F.format_string("*%d net\\[%d\\]", "o_custkey", "o_custkey").alias("line"))
    at = F.col("o_custkey") * big + big
    blocks = c.select(F.inline(F.array(
        F.struct(at.alias("seq"), F.format_string("*d_net *%d %d", "o_custkey", "t").alias("line")), F.struct((at + 1).alias("seq"), F.lit("*CONN").alias("line")), F.struct((at + 2).alias("seq"), F.format_string("*I *%d:Y O *L 0.5:1:2", "o_custkey").alias("line")),
        F.struct((at + 3).alias("seq"), F.lit("*Cap").alias("line")), F.struct((at + (big >> 1)).alias("seq"), F.lit("*RES").alias("line")), F.struct((at + big - 1).alias("seq"), F.lit("*END").alias("line")),
    )))
    el = o.select(F.inline(F.array(
        F.struct((at + 10 + F.col("o_orderkey")).alias("seq"), F.format_string("%d *%d:%d %d:1:2", "o_orderkey", "o_custkey", "o_orderkey", "v").alias("line")),
        F.struct((at + (big >> 1) + 10 + F.col("o_orderkey")).alias("seq"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("1 broken")).otherwise(F.format_string("%d *%d:Y *%d:%d %d", "o_orderkey", "o_custkey", "o_custkey", "o_orderkey", F.col("o_orderkey") % 100)).alias("line")),
    )))
    return head.unionByName(m).unionByName(blocks).unionByName(el).withColumn("src_id", F.lit(1).cast("long"))


def spef_units_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spef.scan(spef_lines(spark, sf_dir))
    g = t["gcap"].groupBy("net").agg(F.sum("c").alias("g"), F.count("*").alias("n_gcap"))
    r = t["res"].groupBy("net").agg(F.sum("r").alias("r"))
    return t["net"].join(g, "net", "left").join(r, "net", "left").select("net", "cap_ff", F.col("g").alias("gcap_ff"), "n_gcap", F.coalesce("r", F.lit(0.0)).alias("res_ohm"))


def spef_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spef.scan(spef_lines(spark, sf_dir))["health"].drop("src_id")


def spef_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned, written, scanned again: the same sums by net."""
    t = spef.scan(spef_lines(spark, sf_dir))
    again = spef.scan(spef.placed(spef.write(t), 2))
    g = again["gcap"].groupBy("net").agg(F.sum("c").alias("g"))
    return again["net"].join(g, "net", "left").select("net", "cap_ff", F.col("g").alias("gcap_ff"))


def lef_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A technology for each brand, a layer for each type; parts as macros with a pin."""
    p = read(spark, sf_dir, "part")
    ly = p.groupBy("p_brand", "p_type").agg(F.min("p_size").alias("w")).withColumn("l", F.format_string("LAYER %s\n  TYPE ROUTING ;\n  WIDTH %d ;\n  RESISTANCE RPERSQ 0.%d ;\nEND %s", F.translate("p_type", " ", "_"), "w", "w", F.translate("p_type", " ", "_")))
    mc = p.withColumn("l", F.format_string("MACRO m%d\n  SIZE %d BY 2.5 ;\n  PIN A\n    DIRECTION INPUT ;\n    PORT\n      LAYER x ;\n      RECT 0 0 1 1 ;\n    END\n  END A\nEND m%d", "p_partkey", "p_size", "p_partkey"))
    rows = ly.select("p_brand", F.concat(F.lit("0"), "p_type").alias("o"), "l").unionByName(mc.select("p_brand", F.concat(F.lit("1"), S("p_partkey")).alias("o"), "l"))
    brands = rows.select(F.col("p_brand"), F.xxhash64("p_brand").alias("b"), "o", "l")
    parsed = materialise(units_of_text.scan(_join(brands, "b", F.col("l"), "o", "VERSION 5.8 ;\n", "\nEND LIBRARY\n"), lef.parse, lef.SCHEMA), "parsed")
    one = brands.select(F.col("b").alias("src_id"), "p_brand").distinct()
    m = units_of_text.table(parsed, "macros").groupBy("src_id").agg(F.count("*").alias("n_macros"), F.sum("width").alias("width"))
    pins = units_of_text.table(parsed, "pins").groupBy("src_id").agg(F.count_if(F.col("direction") == "input").alias("n_inputs"))
    la = units_of_text.table(parsed, "layers").groupBy("src_id").agg(F.count_if("routing").alias("n_routing"), F.sum("width_um").alias("layer_width"), F.max("routing_ord").alias("last_ord"))
    return m.join(la, "src_id").join(pins, "src_id").join(one, "src_id").drop("src_id")


def def_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nets of one step right and one up, the second with a carried coordinate, then a via."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 100).alias("v"))
    line = F.format_string("- o%d ( u%d A ) ( PIN p ) + USE SIGNAL + NONDEFAULTRULE wide + ROUTED met1 ( 1000 2000 ) ( %d * ) ( * %d ) via1_2 ;", "o_orderkey", "o_custkey", 2000 + F.col("v"), 3000 + F.col("v"))
    files = _join(o, "o_custkey", line, "o_orderkey", "DESIGN d ;\nUNITS DISTANCE MICRONS 2000 ;\nNONDEFAULTRULES 1 ;\n- wide + LAYER met1 WIDTH 400 ;\nEND NONDEFAULTRULES\nNETS 1 ;\n", "\nEND NETS\nEND DESIGN\n")
    p = materialise(units_of_text.scan(files, layout.parse, layout.SCHEMA), "parsed")
    s = layout.segment_facts(layout.widths(units_of_text.table(p, "segs").drop("ord"), units_of_text.table(p, "rules").drop("ord")))
    return s.groupBy("net").agg(F.count("*").alias("n_segs"), F.round(F.sum("len_um"), 6).alias("len_um"), F.count_if("is_horizontal").alias("n_horizontal"), F.round(F.sum((F.col("fx1") - F.col("fx0")) * (F.col("fy1") - F.col("fy0"))), 6).alias("area"))


def _def_pins_oriented(p: DataFrame) -> DataFrame:
    """Parts as placed pins in all eight orientations."""
    o = F.element_at(F.array(*[F.lit(x) for x in ("N", "S", "W", "E", "FN", "FS", "FW", "FE")]), (F.col("p_partkey") % 8 + 1).cast("int"))
    line = F.format_string("- p%d + NET n%d + DIRECTION INPUT + USE POWER + LAYER met2 ( -10 0 ) ( %d 40 ) + PLACED ( %d 500 ) %s ;", "p_partkey", "p_partkey", "p_size", F.col("p_partkey") * 10, o)
    parsed = materialise(units_of_text.scan(_join(p, "p_size", line, "p_partkey", "PINS 1 ;\n", "\nEND PINS\n"), layout.parse, layout.SCHEMA), "parsed")
    return layout.placed(units_of_text.table(parsed, "pins").drop("ord"), units_of_text.table(parsed, "pin_rects").drop("ord")).select("pin", "x1", "y1", "x2", "y2")


def def_pins_oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _def_pins_oriented(read(spark, sf_dir, "part"))


def _liberty_cells(p: DataFrame) -> DataFrame:
    """A library for each brand, parts as cells with states of leakage, a table and two pins; the table is looked up."""
    cell = F.format_string(
        'cell (c%d) { area : %d; cell_footprint : "f%d"; leakage_power () { when : "A"; value : %d; } leakage_power () { value : 3; } ff (q, qn) { clear : "!R"; }\n pin (R) { direction : input; capacitance : 0.%d; }\n'
        ' pin (Y) { direction : output; function : "!A"; /* x { */ timing () { related_pin : "R"; cell_rise (t) { index_1 ("0, 10"); index_2 ("0, 1"); values ("0, 5", \\\n "%d, %d"); } } } }',
        "p_partkey", "p_size", F.col("p_partkey") % 4, "p_size", "p_size", "p_size", F.col("p_size") + 5,
    )
    files = _join(p.withColumn("b", F.xxhash64("p_brand")), "b", cell, "p_partkey", 'library (l) {\n nom_voltage : 1.2;\n leakage_power_unit : "1nW"; capacitive_load_unit (1, pf);\n', "\n}\n")
    parsed = materialise(units_of_text.scan(files, liberty.parse, liberty.SCHEMA), "parsed")
    c, a = units_of_text.table(parsed, "cells"), units_of_text.table(parsed, "arcs")
    t = a.select("src_id", "cell", lookup("cell_rise.index_1", "cell_rise.index_2", "cell_rise.values", F.lit(5.0), F.lit(0.5)).alias("delay"))
    return c.join(t, ["src_id", "cell"]).select("cell", "area", F.round(F.col("leakage_w") * 1e9, 6).alias("leakage_nw"), "is_seq", "cell_footprint", F.array_join("async_reset_pins", ",").alias("resets"), F.round("delay", 6).alias("delay"))


def liberty_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _liberty_cells(read(spark, sf_dir, "part"))


def spice_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations call their region's subcircuit, which holds a transistor, a resistor and a call that stands for a transistor."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    sub = r.select(F.lit(1).alias("k"), F.col("r_regionkey").alias("o"), F.format_string(".subckt R%d a b\nM1 a n1 b vss nch w=1u\n+ l=60n ; x\nR1 n1 0 1k\nX9 a b vss vss my_pfet\n.ends", "r_regionkey").alias("l"))
    call = n.select(F.lit(1).alias("k"), (F.col("n_nationkey") + 100).alias("o"), F.format_string("X%d in%d out R%d", "n_nationkey", "n_nationkey", "n_regionkey").alias("l"))
    files = _join(sub.unionByName(call), "k", F.col("l"), "o", "* title\n.global vss\n")
    p = materialise(units_of_text.scan(files, spice.parse, spice.SCHEMA), "parsed")
    s, d = units_of_text.table(p, "subckts"), units_of_text.table(p, "devices")
    got = spice.flatten(s.select("subckt", "ports"), d.select("subckt", "kind", "name", "nodes", "model", "params"), "", ["vss"])
    return got.select("path", "kind", "name", F.array_join("nodes", " ").alias("nodes"), F.round(F.coalesce(F.try_element_at("params", F.lit("w")), F.try_element_at("params", F.lit("value")), F.lit(0.0)), 9).alias("value"))


def em_by_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as geometry, written and read again."""
    li = read(spark, sf_dir, "lineitem").select(F.lit(1).cast("long").alias("src_id"), F.monotonically_increasing_id().alias("seq"), F.concat(F.lit("o"), S("l_orderkey")).alias("net"), F.lit("a").alias("a"), F.lit("b").alias("b"), F.col("l_returnflag").alias("layer"), (F.col("l_tax") + 0.5).alias("width_um"), F.col("l_quantity").alias("length_um"), (F.col("l_discount") * 10).alias("res_ohm"))
    short = spark.createDataFrame([(1, -1, "SEG too short"), (1, -2, "DESIGN x")], "src_id long, seq long, line string")
    got = tables.by_net(tables.em_geometry(tables.em_text(li).unionByName(short)))
    return got.select("net", "n_segments", F.round("length_um", 4).alias("length_um"), F.round("res_ohm", 4).alias("res_ohm"), F.round("min_width_um", 4).alias("min_width_um"))


def klayout_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as NET lines with a grounded capacitor and a segment for each line of theirs."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", F.floor("l_quantity").alias("q"), F.monotonically_increasing_id().alias("i"))
    big = 1 << 34
    nets = li.select("l_orderkey").distinct().select((F.col("l_orderkey") * big).alias("seq"), F.format_string("NET o%d", "l_orderkey").alias("line"))
    k = F.col("l_orderkey") * big + 1 + 2 * (F.pmod(F.xxhash64("i"), F.lit(big // 4)))
    el = li.select(F.inline(F.array(F.struct(k.alias("seq"), F.format_string("GCAP n1 %d", "q").alias("line")), F.struct((k + 1).alias("seq"), F.format_string("SEG a b %d", F.col("q") * 2).alias("line")))))
    t = tables.net_dump(nets.unionByName(el).withColumn("src_id", F.lit(1).cast("long")))
    g = t["gcap"].groupBy("net").agg(F.sum("c").alias("cap"), F.count("*").alias("n"))
    return g.join(t["seg"].groupBy("net").agg(F.sum("r").alias("res")), "net")


def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins, bits, escapes, leaves and identifiers of rendered names."""
    p = read(spark, sf_dir, "part")
    k = S("p_partkey")
    name = F.concat(F.lit("a/b"), k, F.lit("/Y"))
    bit = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x["), k, F.lit("]"))).when(F.col("p_partkey") % 3 == 1, F.lit("x[3:0]")).otherwise(F.concat(F.lit("["), k, F.lit("]")))
    esc = F.concat(F.lit("n\\["), k, F.lit("\\]\\"))
    return p.select("p_partkey", N.split_inst_pin(name)["inst"].alias("inst"), N.split_inst_pin(name)["pin"].alias("pin"), N.split_bit_select(bit)["base"].alias("base"), N.split_bit_select(bit)["bit"].alias("bit"), N.unescape(esc).alias("plain"), N.leaf_of(F.concat(F.lit("t.u."), k)).alias("leaf"), F.array_join(N.idents_in(F.concat(F.lit("!(A"), k, F.lit(" & 1) | b_c"))), ",").alias("idents"))


def _port_expand(p: DataFrame) -> DataFrame:
    return p.select("p_partkey", F.explode(N.expand_bits(F.lit("d"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("long")), F.lit(2).cast("long"))).alias("port"))


def port_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _port_expand(read(spark, sf_dir, "part"))


def spice_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("k", "MEG", "u", "", "nF", "x1")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return p.select("p_partkey", spice.number(F.concat(S("p_size"), suffix)).alias("v"))


def rc_from_spef(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays on scanned nets: each order's node hangs on the driver by its own resistor."""
    t = spef.scan(spef_lines(spark, sf_dir))
    rows = R.net_rows(t["res"].select("net", "ord", "a", "b", "r"), t["gcap"].select("net", "ord", "node", "c"))
    d = rows.select("net", F.inline(R.elmore("res", "caps", F.concat("net", F.lit(":Y")))))
    return d.filter(~F.endswith("node", F.lit(":Y"))).select("net", "node", F.round("delay", 6).alias("delay"))


def sdc_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constraint file for each supplier, every second one in ps: clocks, delays, uncertainty, latency, transition, load, derates, groups."""
    s = read(spark, sf_dir, "supplier")
    text = F.format_string(
        "%screate_clock -name c -period %d [get_ports ck]\ncreate_generated_clock -name g -source ck -divide_by 4 [get_pins u/q]\nset_input_delay 2.5 -clock c [get_ports {a b}]\nset_output_delay %d -clock c [all_outputs]\n"
        "set_clock_uncertainty -setup 0.5 c\nset_clock_uncertainty 0.25 c\nset_clock_latency 3 c\nset_input_transition 0.125 [all_inputs]\nset_load %d [all_outputs]\nset_timing_derate -late 1.05\nset_timing_derate -early 0.95\n"
        "set_clock_groups -asynchronous -group {c} -group {g x}\n",
        F.when(F.col("s_suppkey") % 2 == 0, "set_units -time 1ps\n").otherwise(""), "s_suppkey", F.col("s_nationkey"), F.col("s_nationkey") + 1,
    )
    p = units_of_text.scan(s.select(F.col("s_suppkey").alias("src_id"), text.alias("text")), sdc.parse, sdc.SCHEMA)
    clock = lambda name: F.get(F.filter("clocks", lambda c: c["name"] == name), F.lit(0))["period"]
    delay = lambda way: F.get(F.filter("io_delays", lambda d: d["dir"] == way), F.lit(0))
    r = lambda c: F.round(c, 9)
    return p.select(
        F.col("src_id").alias("s_suppkey"), r(clock("c")).alias("period"), r(clock("g")).alias("generated"), r(delay("input")["value"]).alias("in_delay"), F.array_join(delay("input")["ports"], ",").alias("in_ports"),
        r(delay("output")["value"]).alias("out_delay"), delay("output")["is_default"].alias("out_default"), r(F.col("setup_uncertainty")).alias("setup_u"), r(F.col("hold_uncertainty")).alias("hold_u"), r(F.col("clock_latency")).alias("latency"),
        r(F.col("input_transition")).alias("transition"), r(F.col("load")).alias("load"), "late_derate", "early_derate", F.transform("groups", lambda g: F.array_join(g["clocks"], ","))[1].alias("second_group"),
    )


def declared_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges that the nets of the parasitics span in each source."""
    n = read(spark, sf_dir, "spef_net").select("src_id", canon("net").alias("name"))
    return N.declared_ranges(n, ["src_id"])


def clock_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Virtual and other clocks of each source."""
    c = read(spark, sf_dir, "sdc_clock").select("src_id", "clock_id", sdc.is_virtual(F.col("source_obj")).alias("v")).distinct()
    return c.groupBy("src_id").agg(F.count_if("v").alias("n_virtual"), F.count_if(~F.col("v")).alias("n_real"))


def written_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name a net is written with: as it was read, else the plain one."""
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", layout.write_name(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("\\"), "p_brand")).when(F.col("p_size") % 3 == 1, ""), F.col("p_brand")).alias("name"))


def coupling_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as couplings of orders' nets, in the order they are written."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src_id"), F.col("l_orderkey").alias("net"), (F.col("l_quantity") % 3).alias("node"), F.col("l_partkey").alias("other"), F.col("l_linenumber").alias("other_node"), F.col("l_quantity").alias("cc")).distinct()
    return R.coupling_order(li)


def power_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as power nets of customers: marked as such, else by a known name, else the first."""
    o = read(spark, sf_dir, "orders")
    net = F.when(F.col("o_orderkey") % 5 == 0, layout.POWER_NETS[1]).when(F.col("o_orderkey") % 5 == 1, layout.POWER_NETS[0]).otherwise(F.concat(F.lit("n"), S("o_orderkey")))
    return layout.power_net(o.select(F.col("o_custkey").alias("src_id"), F.col("o_orderkey").alias("ord"), net.alias("net"), (F.col("o_orderkey") % 11 == 0).alias("use_power"))).select(F.col("src_id").alias("o_custkey"), "net")


QUERIES = {
    "declared_ranges": declared_ranges, "clock_kinds": clock_kinds, "written_names": written_names, "coupling_order": coupling_order,
    "sdc_values": sdc_values, "sdc_endpoints": sdc_endpoints, "spef_pin_nodes": spef_pin_nodes, "power_net": power_net,
    "verilog_conns": verilog_conns, "yosys_conns": yosys_conns, "sdc_exceptions": sdc_exceptions, "sdc_ignored": sdc_ignored, "spef_units_triplets": spef_units_triplets, "spef_health": spef_health, "spef_roundtrip": spef_roundtrip,
    "lef_layers": lef_layers, "def_segments": def_segments, "def_pins_oriented": def_pins_oriented, "liberty_cells": liberty_cells, "spice_flatten": spice_flatten, "em_by_net": em_by_net, "klayout_net": klayout_net,
    "name_parts": name_parts, "port_expand": port_expand, "spice_numbers": spice_numbers, "rc_from_spef": rc_from_spef,
}
_F = "o AS (SELECT o_custkey AS c, o_orderkey AS o, floor(o_totalprice) AS v FROM orders)"
ORACLE_SQL = {
    "declared_ranges": r"SELECT src_id, b AS base, max(k) AS msb, min(k) AS lsb FROM (SELECT src_id, regexp_extract(n, '^([^\[]*)\[([+-]?[0-9]+)\]$', 1) AS b, try_cast(regexp_extract(n, '^([^\[]*)\[([+-]?[0-9]+)\]$', 2) AS BIGINT) AS k FROM (SELECT src_id, rtrim(replace(net, '\', ''), chr(32)||chr(9)||chr(13)||chr(10)) AS n FROM spef_net)) WHERE k IS NOT NULL GROUP BY 1, 2",
    "clock_kinds": "SELECT src_id, count(*) FILTER (v) AS n_virtual, count(*) FILTER (NOT v) AS n_real FROM (SELECT DISTINCT src_id, clock_id, coalesce(source_obj, '') = '' AS v FROM sdc_clock) GROUP BY 1",
    "written_names": r"SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '\' || p_brand ELSE p_brand END AS name FROM part",
    "coupling_order": "SELECT *, row_number() OVER (PARTITION BY src_id, net ORDER BY node, other, other_node, cc) AS place FROM (SELECT DISTINCT l_suppkey AS src_id, l_orderkey AS net, l_quantity % 3 AS node, l_partkey AS other, l_linenumber AS other_node, l_quantity AS cc FROM lineitem)",
    "sdc_endpoints": "SELECT s_nationkey, '-from' AS side, 's' || k AS name, count(*) AS n FROM (SELECT s_nationkey, unnest([s_suppkey, s_suppkey + 1]) AS k FROM supplier) GROUP BY ALL",
    "spef_pin_nodes": "SELECT 'net[' || c_custkey || ']' AS inst, CASE WHEN c_custkey % 4 > 0 THEN 'Y' ELSE 'A' END AS pin, CASE WHEN c_custkey % 4 > 0 AND c_custkey IN (SELECT o_custkey FROM orders) THEN 'net[' || c_custkey || ']:Y' END AS node FROM customer",
    "sdc_values": "SELECT s_suppkey, round(s_suppkey * t, 9) AS period, round(s_suppkey * t * 4, 9) AS generated, round(2.5 * t, 9) AS in_delay, 'a,b' AS in_ports, round(s_nationkey * t, 9) AS out_delay, true AS out_default, round(0.5 * t, 9) AS setup_u, round(0.25 * t, 9) AS hold_u, round(3 * t, 9) AS latency, round(0.125 * t, 9) AS transition, (s_nationkey + 1)::DOUBLE AS load, 1.05::DOUBLE AS late_derate, 0.95::DOUBLE AS early_derate, 'g,x' AS second_group FROM (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END AS t FROM supplier)",
    "power_net": f"SELECT o_custkey, arg_min(net, (r, o_orderkey)) AS net FROM (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN 0 WHEN o_orderkey % 5 <= 1 THEN 1 ELSE 2 END AS r, CASE o_orderkey % 5 WHEN 0 THEN '{layout.POWER_NETS[1]}' WHEN 1 THEN '{layout.POWER_NETS[0]}' ELSE 'n' || o_orderkey END AS net FROM orders) GROUP BY 1",
    "verilog_conns": """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber AS n, l_partkey AS p, l_suppkey AS s FROM lineitem)
SELECT l_orderkey, 'P' || p AS cell, 'u' || n || '_' || p || '_' || s AS name, u.pin, CASE u.pin WHEN 'A' THEN 'a[' || (n % 8) || ']' WHEN 'Y' THEN 'n' || s || '.y' WHEN 'C[2]' THEN 'a[7]' WHEN 'C[1]' THEN 'a[6]' ELSE 'b' END AS net FROM l, (VALUES ('A'), ('Y'), ('C[2]'), ('C[1]'), ('C[0]')) u(pin)""",
    "yosys_conns": "SELECT n_regionkey, n_name AS inst, 'N' AS cell, u.pin, CASE u.pin WHEN 'A' THEN CASE n_nationkey % 3 WHEN 0 THEN 'p' WHEN 1 THEN 'q[0]' ELSE 'v' END WHEN 'Q[0]' THEN '$n' || (10 + n_nationkey) ELSE 'q[1]' END AS net FROM nation, (VALUES ('A'), ('Q[0]'), ('Q[1]')) u(pin)",
    "sdc_exceptions": "SELECT s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN 'false' ELSE 'multicycle' END AS kind, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey % 5 + 1 END AS mult, CASE WHEN s_suppkey % 3 = 0 THEN least('s' || s_suppkey, 's' || (s_suppkey + 1)) || ',' || greatest('s' || s_suppkey, 's' || (s_suppkey + 1)) ELSE 's' || s_suppkey END AS from_set, CASE WHEN s_suppkey % 3 = 0 THEN 'n' || s_nationkey ELSE '*' END AS to_set FROM supplier",
    "sdc_ignored": "SELECT DISTINCT user_id, CASE event_type WHEN 'click' THEN 'set_driving_cell' WHEN 'view' THEN 'set_max_area' ELSE 'group_path' END AS command, event_type <> 'view' AS affects, CASE event_type WHEN 'view' THEN 'benign' ELSE 'timing' END AS effect FROM events WHERE event_type IN ('click', 'view', 'error')",
    "spef_units_triplets": "WITH " + _F + " SELECT 'net[' || c || ']' AS net, sum(v) * 1000.0 AS cap_ff, sum(v) * 1000.0 AS gcap_ff, count(*) AS n_gcap, coalesce(sum(CASE WHEN o % 7 <> 0 THEN o % 100 END), 0) * 1000.0::DOUBLE AS res_ohm FROM o GROUP BY 1, c",
    "spef_health": "WITH " + _F + " SELECT count(*) FILTER (o % 7 = 0) AS skipped, true AS triplets, 0 AS reduced, 0 AS pnets FROM o",
    "spef_roundtrip": "WITH " + _F + " SELECT 'net[' || c || ']' AS net, sum(v) * 1000.0 AS cap_ff, sum(v) * 1000.0 AS gcap_ff FROM o GROUP BY 1, c",
    "lef_layers": "WITH l AS (SELECT p_brand, p_type, min(p_size) AS w FROM part GROUP BY 1, 2), a AS (SELECT p_brand, count(*) AS n_routing, CAST(sum(w) AS DOUBLE) AS layer_width, count(*) - 1 AS last_ord FROM l GROUP BY 1), m AS (SELECT p_brand, count(*) AS n_macros, CAST(sum(p_size) AS DOUBLE) AS width, count(*) AS n_inputs FROM part GROUP BY 1) SELECT * FROM a JOIN m USING (p_brand)",
    "def_segments": "SELECT 'o' || o_orderkey AS net, 2 AS n_segs, round((1000 + v + 1000 + v) / 2000.0, 6)::DOUBLE AS len_um, 1 AS n_horizontal, round(((1000 + v) / 2000.0 + 0.2) * 0.2 + ((1000 + v) / 2000.0 + 0.2) * 0.2, 6)::DOUBLE AS area FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 100) AS BIGINT) AS v FROM orders)",
    "def_pins_oriented": """WITH p AS (SELECT 'p' || p_partkey AS pin, p_partkey % 8 AS o, p_size AS s, p_partkey * 10 AS x FROM part),
q AS (SELECT *, CASE WHEN o IN (0, 5) THEN -10 WHEN o IN (1, 4) THEN -s WHEN o IN (3, 6) THEN 0 ELSE -40 END AS ax, CASE WHEN o IN (0, 5) THEN s WHEN o IN (1, 4) THEN 10 WHEN o IN (3, 6) THEN 40 ELSE 0 END AS bx, CASE WHEN o IN (0, 4) THEN 0 WHEN o IN (1, 5) THEN -40 WHEN o IN (2, 6) THEN -10 ELSE -s END AS ay, CASE WHEN o IN (0, 4) THEN 40 WHEN o IN (1, 5) THEN 0 WHEN o IN (2, 6) THEN s ELSE 10 END AS by_ FROM p)
SELECT pin, x + ax AS x1, 500 + ay AS y1, x + bx AS x2, 500 + by_ AS y2 FROM q""",
    "liberty_cells": "SELECT 'c' || p_partkey AS cell, p_size::DOUBLE AS area, round((p_size + 3) / 2.0, 6)::DOUBLE AS leakage_nw, true AS is_seq, 'f' || (p_partkey % 4) AS cell_footprint, 'R' AS resets, round((0 + 5 + p_size + p_size + 5) / 4.0, 6)::DOUBLE AS delay FROM part",
    "spice_flatten": """SELECT 'X' || n_nationkey || '/' AS path, u.kind, u.name, CASE u.name WHEN 'M1' THEN 'in' || n_nationkey || ' X' || n_nationkey || '/n1 out vss' WHEN 'R1' THEN 'X' || n_nationkey || '/n1 0' ELSE 'in' || n_nationkey || ' out vss vss' END AS nodes, u.v::DOUBLE AS value FROM nation, (VALUES ('M', 'M1', 1e-6), ('R', 'R1', 1000.0), ('M', 'X9', 0.0)) u(kind, name, v)""",
    "em_by_net": "SELECT 'o' || l_orderkey AS net, count(*) AS n_segments, round(sum(l_quantity), 4) AS length_um, round(sum(round(l_discount * 10, 6)), 4) AS res_ohm, round(min(round(l_tax + 0.5, 6)), 4)::DOUBLE AS min_width_um FROM lineitem GROUP BY 1",
    "klayout_net": "SELECT 'o' || l_orderkey AS net, sum(floor(l_quantity)) AS cap, count(*) AS n, sum(floor(l_quantity)) * 2 AS res FROM lineitem GROUP BY 1",
    "name_parts": "SELECT p_partkey, 'a/b' || p_partkey AS inst, 'Y' AS pin, CASE WHEN p_partkey % 3 = 0 THEN 'x' END AS base, CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS bit, 'n[' || p_partkey || ']' AS plain, CAST(p_partkey AS VARCHAR) AS leaf, 'A' || p_partkey || ',b_c' AS idents FROM part",
    "port_expand": "SELECT p_partkey, 'd[' || u || ']' AS port FROM (SELECT p_partkey, unnest(range(least(p_size, 2), greatest(p_size, 2) + 1)) AS u FROM part WHERE p_partkey % 2 = 0) UNION ALL SELECT p_partkey, 'd' FROM part WHERE p_partkey % 2 <> 0",
    "spice_numbers": "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size * 1e3 WHEN 1 THEN p_size * 1e6 WHEN 2 THEN p_size * 1e-6 WHEN 3 THEN p_size::DOUBLE WHEN 4 THEN p_size * 1e-9 END AS v FROM part",
    "rc_from_spef": "WITH " + _F + " SELECT 'net[' || c || ']' AS net, 'net[' || c || ']:' || o AS node, round((o % 100) * 1000.0 * v * 1000.0 * 1e-6, 6)::DOUBLE AS delay FROM o WHERE o % 7 <> 0",
}
