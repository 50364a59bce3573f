"""Coverage: what of one file finds its partner in another. Names are joined, never looped over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.core import salted_join

# Supply, well and bias pin names.
POWER_PINS = [
    "VPWR", "VGND", "VPB", "VNB", "VDD", "VSS", "VDDA", "VSSA", "VCC", "VEE", "VPP", "GND",
    "VNEG", "VCCD", "VCCD1", "VCCD2", "VSSD", "VSSD1", "VSSD2", "VDDIO", "VSSIO", "VDDPST",
    "VSSPST", "KAPWR", "VSWITCH", "VCCHIB", "VNW", "VPW", "VNWELL", "VPWELL", "VWELL", "VSUBS",
    "VBP", "VBN", "VBB", "VBG", "VB", "VBODY", "AVDD", "AVSS", "DVDD", "DVSS", "VPWRIN",
]


def is_power_pin(name: Column | str) -> Column:
    n = F.upper(F.translate(F.col(name) if isinstance(name, str) else name, "\\", ""))
    return n.isin(POWER_PINS) | n.rlike("^(VDD|VSS|VPWR|VGND)")


def netlist(insts: DataFrame, conns: DataFrame, lib_cells: DataFrame) -> DataFrame:
    """One row: instances, masters, resolved, physical_only, unresolved_signal, analysable. insts (inst, cell), conns (inst, pin),
    lib_cells (cell). Analysable is what is neither physical only nor unresolved."""
    power = conns.groupBy("inst").agg(F.bool_and(is_power_pin("pin")).alias("_power"))
    known = lib_cells.select("cell").distinct().withColumn("_known", F.lit(True))
    masters = insts.groupBy("cell").agg(F.count("*").alias("_n")).agg(F.count("cell").alias("masters"), F.coalesce(F.sum("_n"), F.lit(0)).alias("instances"))
    # instances whose cell is known need no look at their pins; the cells of the others are few
    lost = salted_join(insts, insts.select("cell").distinct().join(known, "cell", "left_anti"), ["cell"], by=F.col("inst")).unionByName(insts.filter("cell is null"))
    phys = F.coalesce("_power", F.lit(True))
    kinds = lost.join(power, "inst", "left").agg(F.count_if(phys).alias("physical_only"), F.count_if(~phys).alias("unresolved_signal"))
    out = masters.crossJoin(F.broadcast(kinds))  # one row each
    rest = F.col("instances") - F.col("physical_only") - F.col("unresolved_signal")
    return out.select("instances", "masters", rest.alias("resolved"), "physical_only", "unresolved_signal", F.greatest(rest, F.lit(0)).alias("analysable"))


def library(used: DataFrame, lib_cells: DataFrame, pins: DataFrame, arcs: DataFrame, constraints: DataFrame) -> DataFrame:
    """One row on the masters in use: cells_in_lib, resolved_masters, driving_without_arcs (an output that is not tied, and no arc at all),
    sequential_without_constraints, ccs_declared and ccs_usable (arcs).

    used (cell), lib_cells (cell, is_seq), pins (cell, direction, function), arcs (cell, ccs_declared, ccs_usable), constraints (cell)."""
    from netquarry.operators.library import constant_output

    lib = lib_cells.groupBy("cell").agg(F.bool_or("is_seq").alias("_seq"))
    drives = pins.groupBy("cell").agg(F.bool_or((F.col("direction") == "output") & ~constant_output("direction", "function")).alias("_drives"))
    a = arcs.groupBy("cell").agg(F.count("*").alias("_arcs"), F.count_if("ccs_declared").alias("_d"), F.count_if(F.col("ccs_declared") & F.col("ccs_usable")).alias("_u"))
    c = constraints.select("cell").distinct().withColumn("_con", F.lit(True))
    j = used.select("cell").distinct().join(lib, "cell").join(drives, "cell", "left").join(a, "cell", "left").join(c, "cell", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = j.agg(
        F.count("*").alias("resolved_masters"), F.count_if(F.coalesce("_drives", F.lit(False)) & F.col("_arcs").isNull()).alias("driving_without_arcs"),
        F.count_if(F.coalesce("_seq", F.lit(False)) & F.col("_con").isNull()).alias("sequential_without_constraints"), total("_d").alias("ccs_declared"), total("_u").alias("ccs_usable"),
    )
    return lib.agg(F.count("*").alias("cells_in_lib")).crossJoin(F.broadcast(one))  # one row each


def parasitics(design_nets: DataFrame, file_nets: DataFrame, aggressors: DataFrame) -> DataFrame:
    """One row: nets of the design and of the file, matched both ways, coupling references and those whose aggressor is no net of the
    design, percent and verdicts. Each: (net)."""
    d, f = design_nets.select("net").distinct(), file_nets.select("net").distinct()
    j = d.withColumn("_d", F.lit(True)).join(f.withColumn("_f", F.lit(True)), "net", "full")
    refs = aggressors.groupBy("net").agg(F.count("*").alias("_n")).join(d.withColumn("_d", F.lit(True)), "net", "left")
    a = refs.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("coupling_refs"), F.coalesce(F.sum(F.when(F.col("_d").isNull(), F.col("_n"))), F.lit(0)).alias("coupling_unresolved"))
    out = j.agg(F.count("_d").alias("design_nets"), F.count("_f").alias("file_nets"), F.count_if(F.col("_d") & F.col("_f")).alias("matched"), F.count_if(F.col("_d") & F.col("_f").isNull()).alias("design_nets_unmatched"), F.count_if(F.col("_f") & F.col("_d").isNull()).alias("file_nets_unmatched"))
    out = out.crossJoin(F.broadcast(a))  # one row each
    pct = F.coalesce(F.try_divide(F.col("matched") * 100.0, F.col("design_nets").cast("double")), F.lit(0.0))
    return out.withColumn("percent", pct).withColumn("read_but_unmatched", (F.col("file_nets") > 0) & (F.col("matched") == 0)).withColumn("names_all_correspond", (F.col("file_nets_unmatched") == 0) & (F.col("coupling_unresolved") == 0))


def composition(design: dict[str, DataFrame]) -> DataFrame:
    """Six checks that files of one design agree: check, subject, detail, a row for each disagreement.

    design, each with names as they are compared: nets (net), insts (inst, cell), conns (inst, pin, net), ports (port), lib_pins (cell, pin),
    spef_nets (net), spef_pins (inst, pin), sdc_clocks (clock, source), sdc_io (port, is_default), dump_nets (net). A part that is not given
    is not checked."""
    out: list[DataFrame] = []

    def add(check: str, rows: DataFrame, subject, detail) -> None:
        out.append(rows.select(F.lit(check).alias("check"), F.col(subject).cast("string").alias("subject"), (F.col(detail).cast("string") if isinstance(detail, str) else detail).alias("detail")).distinct())

    has = lambda *names: all(n in design for n in names)
    if has("spef_nets", "nets"):
        add("net of the parasitics", unmatched(design["spef_nets"], design["nets"], ["net"]), "net", F.lit(None).cast("string"))
    if has("spef_pins", "conns"):
        add("pin of the parasitics", unmatched(design["spef_pins"].select("inst", "pin"), design["conns"], ["inst", "pin"]), "inst", "pin")
    if has("insts", "lib_pins"):
        add("cell of the netlist", unmatched(design["insts"].select("cell").distinct(), design["lib_pins"], ["cell"]), "cell", F.lit(None).cast("string"))
        if has("conns"):
            cells = design["lib_pins"].select("cell").distinct()
            used = design["conns"].join(design["insts"].select("inst", "cell"), "inst").groupBy("cell", "pin").agg(F.count("*").alias("n")).join(cells, "cell", "left_semi")
            add("pin of the netlist", unmatched(used, design["lib_pins"], ["cell", "pin"]), "cell", "pin")
    if has("ports") and (has("sdc_clocks") or has("sdc_io")):
        named = []
        if has("sdc_clocks"):
            named.append(design["sdc_clocks"].filter("source <> '' and not contains(source, '/')").select(F.col("source").alias("port"), F.concat(F.lit("clock "), "clock").alias("by")))
        if has("sdc_io"):
            named.append(design["sdc_io"].filter("not is_default and not contains(port, '/')").select("port", F.lit("io delay").alias("by")))
        rows = named[0] if len(named) == 1 else named[0].unionByName(named[1])
        add("port of the constraints", unmatched(rows, design["ports"], ["port"]), "port", "by")
    if has("nets", "dump_nets"):
        add("net of the dump", unmatched(design["nets"].select("net"), design["dump_nets"], ["net"]), "net", F.lit(None).cast("string"))
    if not out:
        raise ValueError("no two parts of a design that could be compared")
    got = out[0]
    for o in out[1:]:
        got = got.unionByName(o)
    return got


def unmatched(rows: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """Composition checks: the rows whose key no other row has, such as parasitic pins that the netlist lacks."""
    return rows.join(others.select(*on).distinct(), on, "left_anti")


def top_module(modules: DataFrame, insts: DataFrame) -> DataFrame:
    """src_id, top: the first module (by ord) that no other instantiates, else the last. modules (src_id, ord, module), insts (src_id, cell)."""
    used = insts.select("src_id", F.col("cell").alias("module")).distinct().withColumn("_used", F.lit(True))
    m = modules.join(used, ["src_id", "module"], "left")
    return m.groupBy("src_id").agg(F.coalesce(F.min_by("module", F.when(F.col("_used").isNull(), F.col("ord"))), F.max_by("module", "ord")).alias("top"))
