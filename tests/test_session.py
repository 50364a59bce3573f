import json

import pytest
from pyspark.sql import functions as F

from netquarry.operators import coverage as C
from netquarry.session import DesignSession, library_json, main
from netquarry.streaming.toggles import toggle_stream

# A set-reset cell of two cross-coupled gates with an enable, and a clocked copy of its output.
FILES = {
    "keeper.v": """// two modules: the gate pair is brought in once
module pair(s_n, r_n, q, q_n);
  input s_n, r_n; output q, q_n;
  ND2 upper(.A(s_n), .B(q_n), .Z(q));
  ND2 lower(.A(r_n), .B(q), .Z(q_n));
endmodule
module keeper(en, d, ck, out);
  input en, d, ck; output out;
  wire hold, inv_d, \\sel[0] ;
  assign out = hold;
  IV flip(.A(d), .Z(inv_d));
  ND2 gate_s(.A(d), .B(en), .Z(\\sel[0] ));
  pair sr(.s_n(\\sel[0] ), .r_n(inv_d), .q(q1), .q_n(q2));
  FD1 keep(.D(\\sel[0] ), .CP(ck), .Q(hold));
  FILL7 pad0();
endmodule
""",
    "gates.lib": """library(gates){ nom_voltage : 0.9; capacitive_load_unit(1, ff);
  cell(ND2){ area : 2.25; pin(A){ direction : input; capacitance : 1.2; } pin(B){ direction : input; capacitance : 1.3; }
    pin(Z){ direction : output; function : "!(A B)"; timing(){ related_pin : "A"; cell_rise(t){ index_1("4,8,12"); index_2("1,3"); values("1,2","3,4","5,6"); } } } }
  cell(FD1){ area : 6.5; ff(IQ,IQN){ next_state : "D"; clocked_on : "CP"; } pin(CP){ direction : input; clock : true; capacitance : 0.8; } pin(D){ direction : input; capacitance : 1.0; } pin(Q){ direction : output; function : "IQ"; } } }
""",
    "keeper.sdc": "create_clock -name fast -period 0.75 [get_ports ck]\ncreate_clock -name idle -period 0\nset_output_delay 0.2 -clock fast [get_ports out]\nset_max_area 0\nset_driving_cell -lib_cell ND2 d\n",
    "keeper.spef": '*SPEF "x"\n*C_UNIT 1 PF\n*NAME_MAP\n*7 hold\n*D_NET *7 0.004\n*CAP\n1 *7:1 0.0025\n2 *7:2 oops\n*RES\n1 keep:Q *7:1 40\n*END\n',
    "stack.LEF": "LAYER m5\n TYPE ROUTING ;\n WIDTH 0.4 ;\nEND m5\nMACRO ND2\n SIZE 1.5 BY 3 ;\nEND ND2\n",
    "keeper.def": "DESIGN keeper ;\nCOMPONENTS 2 ;\n- flip IV + PLACED ( 10 20 ) N ;\n- pad0 FILL7 + FIXED ( 0 0 ) FS ;\nEND COMPONENTS\n",
}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("design")
    for n, t in FILES.items():
        (d / n).write_text(t)
    return d


def test_design(spark, files):
    d = DesignSession(spark)
    assert [d.load(str(files / n)) for n in FILES] == ["netlist", "liberty", "sdc", "spef", "lef", "def"]
    d.load(str(files / "gates.lib"))  # from the cache
    assert d.lib_cell_count() == 4 and d.merged_cells().count() == 2
    assert [s["summary"] for s in d.steps] == ["5 insts", "2 cells", "2 clocks", "1 nets", "1 macros", "0 nets", "2 cells"]
    assert d.tables["netlist"].first().top == "keeper" and d.steps_table().count() == 7
    conns = {(r.inst, r.pin, r.net) for r in d.tables["netlist_conns"].collect()}
    # the alias makes one net of out and hold, which keeps its port's name or its own
    assert {(i, p) for i, p, _ in conns} == {(0, "A"), (0, "Z"), (1, "A"), (1, "B"), (1, "Z"), (2, "s_n"), (2, "r_n"), (2, "q"), (2, "q_n"), (3, "D"), (3, "CP"), (3, "Q")} and {n for i, p, n in conns if (i, p) in ((1, "Z"), (2, "s_n"), (3, "D"))} == {"sel[0]"}
    h = d.health()
    assert h["netlist"].startswith("2 modules in a file; keeper") and "1 aliases" in h["netlist"]
    assert h["sdc"] == "1 clocks without a usable period, the first: idle; 2 commands ignored, of which these can move a slack: set_driving_cell" and h["spef"] == "1 entries could not be read" and h["lef"] is None
    assert json.loads(d.to_json())["counts"]["netlist_insts"] == 5 and "sdc: 2 clocks" in d.summary()
    cells, pins, arcs = (d.tables[f"liberty_{k}"].filter("lib_id = 0") for k in ("cells", "pins", "arcs"))
    j = {r.cell: json.loads(r.json) for r in library_json(cells, pins, arcs).collect()}
    assert [p["pin"] for p in j["ND2"]["pins"]] == ["A", "B", "Z"] and j["ND2"]["pins"][2]["arcs"][0]["cell_rise"] == [3, 2]
    net = d.tables["spef_net"].first()
    assert (net.net, net.cap_ff) == ("hold", 4.0)
    with pytest.raises(ValueError):
        d.load("x.unknown")
    (files / "bad.sdc").write_text("create_clock -name c")
    with pytest.raises(ValueError, match="1 of the files failed"):
        d.load(str(files / "bad.sdc"))


def test_coverage_and_composition_of_the_design(spark, files):
    d = DesignSession(spark, cache=False)
    for n in FILES:
        d.load(str(files / n))
    t = d.tables
    insts = t["netlist_insts"].select(F.col("ord").cast("long").alias("inst"), "cell", "name")
    conns = t["netlist_conns"].select("inst", "pin", "net")
    lib = t["liberty_cells"].select("cell", "is_seq")
    assert C.netlist(insts, conns, lib).first().asDict() == {"instances": 5, "masters": 5, "resolved": 2, "physical_only": 1, "unresolved_signal": 2, "analysable": 2}
    arcs = t["liberty_arcs"].select("cell", "ccs_declared", F.lit(False).alias("ccs_usable"))
    got = C.library(insts, lib, t["liberty_pins"], arcs, t["liberty_constraints"]).first().asDict()
    assert got == {"cells_in_lib": 2, "resolved_masters": 2, "driving_without_arcs": 1, "sequential_without_constraints": 1, "ccs_declared": 0, "ccs_usable": 0}
    got = C.composition({
        "nets": conns.select("net").distinct(), "spef_nets": t["spef_net"].select("net"), "insts": insts.select("inst", "cell"), "conns": conns, "lib_pins": t["liberty_pins"].select("cell", "pin"), "ports": t["netlist_ports"].select(F.col("name").alias("port")),
        "sdc_clocks": t["sdc_clocks"].select(F.col("name").alias("clock"), F.coalesce("source", F.lit("")).alias("source")), "dump_nets": spark.createDataFrame([("inv_d",), ("sel[0]",)], "net string"),
    })
    rows = {(r.check, r.subject) for r in got.collect()}
    assert ("cell of the netlist", "IV") in rows and ("cell of the netlist", "FILL7") in rows and ("net of the dump", "d") in rows and not any(c == "port of the constraints" for c, _ in rows)
    with pytest.raises(ValueError):
        C.composition({})


def test_broken_json_is_told_with_its_place(spark, tmp_path):
    (tmp_path / "cut.json").write_text('{"modules": {\n  "t": {"ports": {},, }}}')
    with pytest.raises(ValueError, match="line 2, column"):
        DesignSession(spark).load(str(tmp_path / "cut.json"))


def test_calls(capsys):
    assert main(["inspect"]) == 2 and main(["version"]) == 0 and main([]) == 0 and main(["--help"]) == 0 and main(["nonsense", "x"]) == 2 and main(["check", "--odd", "x"]) == 2
    capsys.readouterr()
    assert main(["--describe"]) == 0 and json.loads(capsys.readouterr().out)["commands"] == ["inspect", "check"]


def test_stream(spark, tmp_path):
    rows = [("a", 1, "0"), ("a", 2, "1"), ("b", 3, "x"), ("a", 4, "z"), ("a", 5, "0"), ("b", 6, "1")]
    for k in range(2):
        spark.createDataFrame(rows[3 * k : 3 * k + 3], "net string, seq long, value string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("net string, seq long, value string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = toggle_stream(s).writeStream.outputMode("update").format("memory").queryName("toggles_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {}
    for r in spark.table("toggles_out").collect():
        got[r.net] = max(got.get(r.net, 0), r.n_toggles)
    assert got == {"a": 2, "b": 0}
