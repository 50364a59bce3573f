import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from netquarry.operators import activity as A
from netquarry.sources import fst, layout, lef, liberty, saif, sdc, spef, spice, tables, vcd, verilog, yosys


def lines(spark, text, src=1):
    return spark.createDataFrame([(src, k, x) for k, x in enumerate(text.split("\n"))], "src_id long, seq long, line string")


DUMP = """$timescale 10 ns $end
$scope module tb $end
$var wire 1 ! clk $end $var wire 4 " bus [3:0] $end
$scope module $end
$var real 64 # f $end
$var wire 1 $ one [2] $end $var wire 1 ! alias $end
$upscope $end $upscope $end
$enddefinitions $end
#0
0! b01x1 " r1.5 #
x$
#3.5
1! r1.50 #
b1 "
#7
U!
h!
l!
b1x00 "
1$
0$"""


def test_dump(spark):
    d, c = vcd.scan(lines(spark, DUMP))
    decls = {r.path: (r.sym, r.width, r.timescale_s) for r in d.collect()}
    assert decls == {"tb.clk": ("!", 1, 1e-8), "tb.bus": ('"', 4, 1e-8), "tb.f": ("#", 64, 1e-8), "tb.one[2]": ("$", 1, 1e-8), "tb.alias": ("!", 1, 1e-8)}
    rows = [(r.tick, r.sym, r.kind, r.value) for r in c.orderBy("seq").collect()]
    assert rows[:4] == [(0.0, "!", "scalar", "0"), (0.0, '"', "vector", "01x1"), (0.0, "#", "real", "1.5"), (0.0, "$", "scalar", "x")] and rows[4][0] == 3.5
    n = {r.net: r.n_toggles for r in A.toggle_count(c.filter("kind = 'scalar'").withColumnRenamed("sym", "net")).collect()}
    assert n == {"!": 2, "$": 1}
    v = A.vector_bits(c.filter("kind = 'vector'").select(F.col("sym").alias("net"), "seq", "tick", "value", F.lit(4).alias("width")))
    assert {r.bit: r.n_toggles for r in A.toggle_count(v, ["net", "bit"]).collect()} == {3: 1, 2: 1, 1: 0, 0: 1}
    assert A.real_changes(c.filter("kind = 'real'").withColumnRenamed("sym", "net")).first().n_changes == 1


def test_blocks_do_not_matter(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), k, k * 10, rnd.choice("01xzhl")) for k in range(300)]
    df = spark.createDataFrame(rows, "net string, seq long, tick long, value string")
    out = [{r.net: r.n_toggles for r in A.toggle_count(df, block=b).collect()} for b in (1 << 16, 7)]
    want = {}
    last = {}
    for net, _, _, v in rows:
        lv = {"0": 0, "l": 0, "1": 1, "h": 1}.get(v)
        if lv is not None:
            want[net] = want.get(net, 0) + (last.get(net, lv) != lv)
            last[net] = lv
    assert out[0] == out[1] == want
    tumbling = A.sweep(df, 0, 3000, 250, 250)
    assert {r.net: r.n for r in tumbling.groupBy("net").agg(F.sum("n_toggles").alias("n")).collect()} == want
    third = {r.net: r.n_toggles for r in tumbling.filter("win = 2").collect()}
    assert third == {r.net: r.n_toggles for r in A.window_toggles(df, 500, 750).collect()}
    for bad in ((0, 0, 1, 1), (0, 10, 0, 1), (0, 10, 1, -1), (0, float("inf"), 1, 1), (0, 1e9, 1, 1)):
        with pytest.raises(ValueError):
            A.n_windows(*bad)


FREE = """$timescale 1 ns $end $scope module t $end
$var wire 1 ! a $end $var wire 1 b b $end $var wire 4 r r $end $var real 64 s s $end
$upscope $end $enddefinitions $end #0 $dumpvars 0! 1b
b0101 r r0.5 s $end
  $comment here #999 1! is no change
 b1 ! 0b
   r9 s $end #5 1!
	#6
b0011
r
bx01
  b
b1111 r 0!
$comment one line #7 1! $end 1!
#7.5   $dumpoff x! xb $end $dumpon
r1.5
s 0b r2.5 s b1 b
S
b b0 b $end
#nan
0!"""


def plain_scan(text):
    """Word by word, as the format is defined."""
    words, out, tick, k, body = text.split(), [], 0.0, 0, False
    while k < len(words):
        w = words[k]
        k += 1
        if not body:
            body = w == "$enddefinitions"
        elif w == "$comment":
            while words[k] != "$end":
                k += 1
        elif w[0] == "#":
            t = float(w[1:])
            tick = t if t == t else tick
        elif w[0] in "bBrRsS":
            out.append((tick, words[k] if k < len(words) else None, w[1:]))
            k += 1
        elif w[0] in vcd.LEVELS and len(w) > 1:
            out.append((tick, w[1:], w[0]))
    return out


def test_free_form_dump(spark):
    want = plain_scan(FREE)
    for text in (FREE, " ".join(FREE.split()), "\n".join(FREE.split())):
        assert plain_scan(text) == want
        _, c = vcd.scan(lines(spark, text))
        assert [(r.tick, r.sym, r.value) for r in c.orderBy("seq").collect()] == want
    rnd = random.Random(4)
    for _ in range(2):
        words = [x for _ in range(150) for x in (rnd.choice(["0b", "1!", "b1 b", "b10 r", "r1 s", "S b", "bb r", "#%d" % rnd.randrange(9), "$comment b0 #3 1! $end", "$dumpvars", "$end", "zs"])).split()]
        text = "$enddefinitions $end " + "".join(w + rnd.choice([" ", " ", "\n", "\n \n"]) for w in words)
        _, c = vcd.scan(lines(spark, text))
        assert [(r.tick, r.sym, r.value) for r in c.orderBy("seq").collect()] == plain_scan(text)


def test_many_changes_in_a_line_and_a_dump_beyond_8_gib(spark):
    head = [(0, 0, "$var wire 1 ! a $end $enddefinitions $end")]
    far = 9 << 30  # the second split starts there
    rows = head + [(0, 1, "#1 " + " ".join("01"[k % 2] + "!" for k in range(1800))), (far, 0, "#2"), (far, 1, "0!"), (far, 2, "#3"), (far, 3, "1!")]
    df = spark.createDataFrame([(1, a, b, x) for a, b, x in rows], "src_id long, a long, b long, line string").select("src_id", F.struct(F.col("a").alias("start"), F.col("b").alias("line")).alias("seq"), "line")
    _, c = vcd.scan(df)
    assert A.toggle_count(c.withColumnRenamed("sym", "net")).first().n_toggles == 1799 + 2
    assert [r.tick for r in c.orderBy("seq").collect()][-2:] == [2.0, 3.0]


def test_lines_of_a_file_in_splits(spark, tmp_path):
    text = "\n".join(f"line {k}" for k in range(5000))
    (tmp_path / "a.txt").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = vcd.read_lines(spark, str(tmp_path / "a.txt"))
        assert got.select("seq.start").distinct().count() > 3
        assert [r.line for r in got.orderBy("seq").collect()] == text.split("\n")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_annotated_copy(spark):
    src = ["$timescale 10ns $end", "$scope module t $end", "$var wire 1 ! a $end", "$upscope $end", "$enddefinitions $end", "$dumpvars", "0!", "$end", "#3", "1!", "#7", "0!", "#7", "#9", "1!"]
    series = [("p", 0.0, 1.0), ("p", 5e-8, 2.5), ("p", 7e-8, 3.25), ("q", 0.0, -0.125), ("q", 2.96e-8, 1e-12), ("q", 9e-6, 3.0)]
    out, stats = vcd.annotate(lines(spark, "\n".join(src)), "power", spark.createDataFrame(series, "name string, t_s double, value double"))
    got = [r.line for r in out.orderBy("at").collect()]
    p, q = "~!1", "~!2"
    assert got == [
        *src[:4], "$scope module power $end", f"$var real 64 {p} p $end", f"$var real 64 {q} q $end", "$upscope $end", *src[4:7], f"r1.000000e0 {p}", f"r-1.250000e-1 {q}", "$end",
        "#3", f"r1.000000e-12 {q}", "1!", "#5", f"r2.500000e0 {p}", "#7", f"r3.250000e0 {p}", "0!", "#7", "#9", "1!",
    ]
    assert tuple(stats.first())[1:] == (2, 5, 1, 1e-8)


def test_every_window_of_a_bounded_sweep(spark):
    df = spark.createDataFrame([("t.a", 1, 5, "0"), ("t.a", 2, 12, "1"), ("t.b", 3, 55, "0")], "path string, seq long, tick long, value string")
    b = A.sweep_bounds(spark, 0, 60, 20, 20, 50, 1e-9)
    counts = A.sweep(df, 0, 60, 20, 20, ["path"])
    full = {(r.win, r.path): (r.n_toggles, r.n_events) for r in A.every_window(counts, b, df.select("path").distinct(), ["path"]).collect()}
    assert full == {(0, "t.a"): (1, 2), (1, "t.a"): (0, 0), (2, "t.a"): (0, 0), (0, "t.b"): (0, 0), (1, "t.b"): (0, 0), (2, "t.b"): (0, 1)}
    nets = spark.createDataFrame([("a",), ("b",), ("c",)], "net string")
    got = {(r.win, r.net): r.rate for r in A.window_rates(nets, counts, b, "t").collect()}
    assert len(got) == 9 and abs(got[0, "a"] - 5e7) < 1 and sum(got.values()) == got[0, "a"]


def block(kind, body):
    return bytes([kind]) + struct.pack(">Q", len(body) + 8) + body


def varint(n):
    out = bytearray()
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def signed(n):
    out = bytearray()
    while True:
        x = n & 127
        n >>= 7
        if (n == 0 and not x & 64) or (n == -1 and x & 64):
            out.append(x)
            return bytes(out)
        out.append(x | 128)


def binary_dump():
    head = struct.pack(">QQ", 0, 50) + b"\0" * 48 + struct.pack("b", -9) + b"\0" * 200
    v = lambda tag, name, w, alias=0: bytes([tag, 0]) + name + b"\0" + varint(w) + varint(alias)
    tree = b"\xfe\0tb\0\0" + v(16, b"clk", 1) + v(16, b"bus [3:0]", 4) + v(3, b"f", 8) + v(16, b"same", 1, 1) + b"\xff"
    hier = struct.pack(">Q", len(tree)) + zlib.compress(tree)
    clk = b"".join(varint(1 << 2 | (k & 1) << 1) for k in (1, 0, 1)) + varint(0 << 4 | 0 << 1 | 1) + varint(1 << 2)
    bus = varint(1 << 1) + b"\xa0" + varint(1 << 1 | 1) + b"1x10"
    real = varint(1 << 1 | 1) + struct.pack("<d", 2.0)
    frame = b"0" + b"0000" + struct.pack("<d", 1.0)
    chains, index, at = b"", b"", 1
    last = 0
    for c in (clk, bus, real):
        chains += varint(0) + c
        index += signed((at - last) << 1 | 1)
        last = at
        at += 1 + len(c)
    times = b"".join(map(varint, [0, 10, 10, 10, 10]))
    body = struct.pack(">QQQ", 0, 50, 0) + varint(len(frame)) * 2 + varint(3) + frame + varint(3) + b"4" + chains + index + struct.pack(">Q", len(index)) + times + struct.pack(">QQQ", len(times), len(times), 5)
    return block(0, head) + block(8, body) + block(4, hier)


def test_binary_dump(spark):
    f = spark.createDataFrame([(1, bytearray(binary_dump()))], "src_id long, content binary")
    got = {(r.path, r.bit): r.n_toggles for r in fst.scan(f).collect()}
    # clk 0 -> 1 0 1 x 0; bus 0000 -> 1010 -> 1x10
    assert got == {("tb.clk", 0): 4, ("tb.same", 0): 4, ("tb.bus", 3): 1, ("tb.bus", 2): 0, ("tb.bus", 1): 1, ("tb.bus", 0): 0, ("tb.f", -1): 1}
    part = {(r.path, r.bit): (r.n_toggles, r.seconds) for r in fst.scan(f, (20, 40)).collect()}
    assert part["tb.clk", 0] == (2, pytest.approx(2e-8)) and part["tb.bus", 3][0] == 0
    with pytest.raises(ValueError):
        list(fst.blocks(binary_dump()[:-3]))
    # broken off: a block still being written, or one whose length was never filled in, ends the data
    for tail in (block(255, b"half a block")[:14], bytes([8]) + bytes(8) + b"rest"):
        broken = spark.createDataFrame([(1, bytearray(binary_dump() + tail))], "src_id long, content binary")
        assert {(r.path, r.bit): r.n_toggles for r in fst.scan(broken).collect()} == got
    assert fst._fastlz(bytes([2]) + b"abc" + bytes([1 << 5, 2, 0]) + b"z", 7) == b"abcabcz" and fst._fastlz(bytes([2 | 1 << 5]) + b"abc" + bytes([7 << 5, 255, 4, 2]), 271) == (b"abc" * 91)[:271]
    assert fst.lz4_block(bytes([0x35]) + b"abc" + bytes([3, 0]) + bytes([0x10]) + b"z", 13) == b"abcabcabcabcz"


def test_saif():
    rows, span, tick = saif.parse('(SAIFILE (TIMESCALE 10 ps) (INSTANCE "t" top (NET (a (T0 1) (T1 2) (TX 3) (TC 4))) (INSTANCE u (NET (b\\[1\\] (TC 7))))))')
    assert rows == [("top.a", 4.0, 3.0, 3.0), ("top.u.b[1]", 7.0, 0.0, 0.0)] and span == 6.0 and tick == pytest.approx(1e-11)
    for bad in ("(a", "a)", "(INSTANCE)"):
        with pytest.raises(ValueError):
            saif.parse(bad)


def test_verilog_and_json_agree(spark):
    text = "module leaf(a); input a; endmodule\nmodule top(input [1:0] d, output q); wire n1; leaf u1 (.a(d[0])); leaf u2 (.a(n1)); leaf u3 (.a(q)); endmodule"
    p = verilog.parse(text)
    bits = {"d": [2, 3], "q": [4], "n1": [5]}
    cell = lambda n, b: (n, {"type": "leaf", "connections": {"a": [b]}})
    j = {"modules": {"leaf": {}, "top": {"attributes": {"top": "1"}, "ports": {"d": {"direction": "input", "bits": bits["d"]}, "q": {"direction": "output", "bits": bits["q"]}}, "cells": dict([cell("u1", 2), cell("u2", 5), cell("u3", 4)]), "netnames": {k: {"bits": b} for k, b in bits.items()}}}}
    t = yosys.scan(spark.createDataFrame([(1, json.dumps(j))], "src_id long, text string"))
    assert {(r.inst, r.pin, r.net) for r in t["conn"].collect()} == {(p["insts"][c["inst"]]["name"], c["pin"], c["net"]) for c in p["conns"]}
    assert p["top"] == "top" and t["module"].first().module == "top"
    with pytest.raises(ValueError):
        verilog.parse("// nothing")


def test_quirks():
    assert verilog.parse("module m(a); input a; B u (.P({4{a}})); endmodule")["conns"][-1]["net"] == "a"  # replication is not expanded
    s = sdc.parse("create_clock -period 2 -name c\nset_input_delay -clock c 0.3\nset_multicycle_path -setup 3 -to x\nset_false_path -from [all_inputs]\nset_output_delay 0.2 -clock c")
    assert s["io_delays"][0]["value"] == 0.0 and s["exceptions"][0]["mult"] == 1 and s["exceptions"][1]["from_set"] == ["*"] and len(s["notes"]) == 2
    assert s["io_delays"][1] == {"dir": "output", "value": 0.2, "is_default": True, "ports": []} and s["clocks"][0]["source"] == ""
    with pytest.raises(ValueError):
        sdc.parse("create_clock -name c")
    assert liberty.parse("library(x){cell(a){area:1;} cell(a){area:2;}}")["cells"][0]["area"] == 2.0
    for bad in ("x", "library(l){}"):
        with pytest.raises(ValueError):
            liberty.parse(bad)
    with pytest.raises(ValueError):
        lef.parse("VERSION 5 ;")
    assert spice.spice_number("2meg") == 2e6 and spice.spice_number("3kohm") == 3e3 and spice.spice_number("x") is None


def test_unknown_keywords_do_not_move_values():
    known = "library(l){ nom_voltage : 1.2; @ cell(INV){ area : 2; @ pin(A){ direction : input; capacitance : 3; @ } } }"
    want = liberty.parse(known.replace("@", ""))
    for word in ("some_attr : 5;", 'other ("a", "b");', "a_group(x) { area : 9; capacitance : 7; }", "/* cell(B){ */"):
        assert liberty.parse(known.replace("@", word)) == want
    base = "set_load 2 [get_ports a]\n@\nset_false_path -from a -to b"
    want = sdc.parse(base.replace("@", ""))
    for word in ("set_max_area 0", "foo -bar [baz {x y}]", "puts {a; b}"):
        assert sdc.parse(base.replace("@", word)) | {"ignored": []} == want


def test_layout_statements():
    text = """DESIGN d ; UNITS DISTANCE MICRONS 1000 ;
SPECIALNETS 2 ; - VSS + USE GROUND + ROUTED met1 200 + SHAPE STRIPE ( 0 0 ) ( 100 * ) NEW met2 300 ( 0 0 ) ( * 50 ) ; - VPWR ( * VPWR ) + USE POWER ; END SPECIALNETS
COMPONENTS 2 ; - u1 INV + PLACED ( 10 20 ) FS ; - u2 INV + UNPLACED ; END COMPONENTS
VIAS 1 ; - v1 + RECT met1 ( 0 0 ) ( 1 1 ) + RECT cut ( 0 0 ) ( 1 1 ) + RECT cut ( 2 2 ) ( 3 3 ) + RECT met2 ( 0 0 ) ( 1 1 ) ; END VIAS
NETS 1 ; - a\\[0\\] ( u1 A ) + ROUTED met1 ( 0 0 ) ( 1000 * ) v1 NEW met1 ( 0 0 ) TAPERRULE w ( * 2000 ) + USE CLOCK ; END NETS"""
    d = layout.parse(text)
    assert [(s["layer"], s["width_dbu"], s["x2"], s["y2"]) for s in d["psegs"]] == [("met1", 200, 100, 0), ("met2", 300, 0, 50)]
    assert [c["name"] for c in d["comps"]] == ["u1"] and d["via_defs"][0] == {"via": "v1", "cut_layer": "cut", "below": "met1", "above": "met2", "cuts": 2}
    n = d["nets"][0]
    assert (n["name"], n["raw_name"], n["vias"]) == ("a[0]", "a\\[0\\]", 1) and n["vias_raw"] >= 3
    assert sorted((s["x1"], s["y1"]) for s in d["segs"]) == [(0.0, 2.0), (1.0, 0.0)]


def test_parasitics_file(spark):
    text = '*SPEF "x"\n*C_UNIT 1 PF\n*R_UNIT 1 OHM\n*NAME_MAP\n*1 n\\[1\\]\n*2 n2\n*D_NET *1 0.5\n*CONN\n*I u1:Y O *L 0.1\n*P p I\n*CAP\n1 *1:1 0.2:0.3:0.4\n2 *1:1 *2:7 0.02\n*RES\n1 u1:Y *1:1 10\n2 bad\n*END\n*d_net *2 1 // x\n*cap\n1 *2:7 *1:1 0.05\n2 *2:7 0.1\n*END\n*R_NET *2 1\n*END'
    t = spef.scan(lines(spark, text))
    assert {(r.net, r.cap_ff) for r in t["net"].collect()} == {("n[1]", 500.0), ("n2", 1000.0)}
    assert {(r.net, r.node, r.c) for r in t["gcap"].collect()} == {("n[1]", "n[1]:1", 200.0), ("n2", "n2:7", 100.0)}
    assert {tuple(r)[1:] for r in t["health"].collect()} == {(1, True, 1, 0)}
    assert {(r.inst, r.pin, r.dir, r.cap_ff, r.is_port) for r in t["conn"].collect()} == {("u1", "Y", "O", 100.0, False), ("", "p", "I", 0.0, True)}
    from netquarry.operators import parasitics as R

    own = spef.owners(t).select("node", "net")
    cc = {(r.net, r.other): r.cc for r in R.coupling(t["cc"], own).collect()}
    assert cc == {("n[1]", "n2"): pytest.approx(20.0), ("n2", "n[1]"): pytest.approx(20.0)}
    seen = []
    for _ in range(2):  # a fixed point of writing and reading
        w = [r.line for r in spef.write(t).orderBy("part", "no", "k").collect()]
        seen.append(w)
        t = spef.scan(lines(spark, "\n".join(w)))
    assert seen[0] == seen[1]


def test_written_parasitics_of_any_number_of_nets_are_read_again(spark, monkeypatch):
    import __spark_entry__ as entry
    from netquarry import core
    from tests.compare import compare

    # nets numbered as behind 300,000 others: more than a number with a fixed share for each net's lines can hold
    monkeypatch.setattr(spef, "numbered", lambda df, by, name="n", start=1: core.numbered(df, by, name, start + 300_000 * (name == "no")))
    assert compare(spark, "/root/testdata/sf0.001", "spef_roundtrip", entry.queries()["spef_roundtrip"], entry.oracle_sql()["spef_roundtrip"]) is None


def test_tree_delays(spark):
    from netquarry.operators import parasitics as R

    res = [("n", 1, "d", "a", 100.0), ("n", 2, "a", "b", 200.0), ("n", 3, "a", "c", 50.0), ("loop", 1, "d", "a", 1.0), ("loop", 2, "a", "d", 1.0)]
    cap = [("n", 1, "a", 10.0), ("n", 2, "b", 20.0), ("n", 3, "c", 30.0)]
    rows = R.net_rows(spark.createDataFrame(res, "net string, ord int, a string, b string, r double"), spark.createDataFrame(cap, "net string, ord int, node string, c double"))
    got = {r.net: r for r in rows.select("net", R.elmore("res", "caps", F.lit("d")).alias("e"), R.pi_reduce("res", "caps", F.lit("d")).alias("p"), R.transient("res", "caps", F.lit("d"), 0.01).alias("t"), R.elmore("res", "caps", F.lit("zz")).alias("none")).collect()}
    e = {x.node: x.delay for x in got["n"].e}
    assert e == {"d": 0.0, "a": pytest.approx(100 * 60e-6), "b": pytest.approx(100 * 60e-6 + 200 * 20e-6), "c": pytest.approx(100 * 60e-6 + 50 * 30e-6)}
    assert got["loop"].e is None and got["loop"].t is None and got["n"].none is None
    assert got["n"].p.tau == pytest.approx((10 * 100 + 20 * 300 + 30 * 150) * 1e-6)
    t = {x.node: x.delay for x in got["n"].t}
    assert t["d"] == pytest.approx(0, abs=1e-6) and 0 < t["a"] < t["c"] < t["b"] < 1.05 * e["b"]


def test_sidecars(spark):
    t = tables.net_dump(lines(spark, "DESIGN x\nNET clk\nPIN u1/A clk:1\nSEG a b 390 met1 0.2 5\nCCAP other clk:1 2\nGCAP clk:1 3\n# c\nNET q"))
    assert t["seg"].first().r == 390.0 and t["ccap"].first().other == "other" and t["net"].count() == 2
    em = tables.em_geometry(lines(spark, "DESIGN x\nSEG n a b met1 0.1234567 2.50 3\nSEG short"))
    assert [r.line for r in tables.em_text(em).collect()] == ["SEG n a b met1 0.123457 2.5 3"]


def test_library_currents_and_receivers(spark):
    text = """library(l){ cell(a){ pin(Y){ direction : output; receiver_capacitance(){ receiver_capacitance1_rise(t){ values("1,2"); } }
      timing(){ related_pin : "A"; ocv_sigma_cell_rise(t){ values("0.1"); } output_current_rise(){ vector(v){ reference_time : 0.5; index_1("0.1"); index_2("0.02"); index_3("0,1,2"); values("0,2,0"); } } }
      timing(){ timing_type : setup_rising; rise_constraint(t){ values("0.3"); } } timing(){ timing_type : clear; } } } }"""
    d = liberty.parse(text)
    assert d["ccs"] == [{"cell": "a", "pin": "Y", "arc": 0, "edge": "rise", "in_slew": 0.1, "out_cap": 0.02, "ref_time": 0.5, "time": [0.0, 1.0, 2.0], "current": [0.0, 2.0, 0.0]}]
    assert d["receivers"][0]["c1_rise"]["values"] == [[1.0, 2.0]] and d["receivers"][0]["c2_fall"] is None and d["arcs"][0]["sigma_rise"]["values"] == [[0.1]]
    assert len(d["arcs"]) == 1 and [c["kind"] for c in d["constraints"]] == ["setup"]
    less = liberty.parse(text, skip_ccs=True)
    assert less["ccs"] == [] and less["receivers"] == [] and less["arcs"] == d["arcs"]
    rows = spark.createDataFrame([(1, text)], "src_id long, text string")
    from netquarry.sources import units_of_text as U

    got = U.table(U.scan(rows, liberty.parse, liberty.SCHEMA), "ccs").first()
    assert got.time == [0.0, 1.0, 2.0]
    p = lef.parse("LAYER m\n TYPE ROUTING ;\n WIDTH 0.2 ;\n THICKNESS 0.3 ;\nEND m\nMACRO c\n PIN a\n DIRECTION INPUT ;\n PORT\n LAYER m ;\n RECT 0 0 1 1 ;\n END\n END a\nEND c\n")
    la = spark.createDataFrame([(x["layer"], x["width_um"], x["thickness_um"]) for x in p["layers"]], "layer string, width_um double, thickness_um double")
    assert {tuple(r) for r in lef.with_layer(spark.createDataFrame([("m",), ("n",)], "layer string"), la).collect()} == {("m", 0.2, 0.3), ("n", 0.0, 0.0)}
    pins = spark.createDataFrame([(x["macro"], x["pin"], x["direction"]) for x in p["pins"]], "macro string, pin string, direction string")
    assert {r.direction for r in lef.with_direction(spark.createDataFrame([("c", "a"), ("c", "b")], "macro string, pin string"), pins).collect()} == {"input", "unknown"}
    e = spark.createDataFrame([(["*"], ["x"]), ([], ["y"]), (["a"], ["x"])], "f array<string>, t array<string>")
    assert [r[0] for r in e.select(sdc.covered(F.col("f"), F.col("t"), F.lit("b"), F.lit("x"))).collect()] == [True, False, False]
    assert sdc.covers(["*"], ["x"], "b", "x") and not sdc.covers([], ["y"], "b", "x")
