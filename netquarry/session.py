"""One design: files loaded by kind into named tables, with what was loaded, checks and summaries."""

from __future__ import annotations

import hashlib
import inspect
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.core import shared_dir
from netquarry.sources import layout, lef, liberty, sdc, spef, units_of_text, vcd, verilog, yosys

KINDS = {"v": "netlist", "sv": "netlist", "vg": "netlist", "json": "netlist_json", "lib": "liberty", "sdc": "sdc", "spef": "spef", "lef": "lef", "tlef": "lef", "def": "def"}
PARSERS = {"netlist": (verilog.parse, verilog.SCHEMA, verilog), "liberty": (liberty.parse, liberty.SCHEMA, liberty), "sdc": (sdc.parse, sdc.SCHEMA, sdc), "lef": (lef.parse, lef.SCHEMA, lef), "def": (layout.parse, layout.SCHEMA, layout)}
#: The record arrays of each kind that become tables, and the count that its step reports.
TABLES = {
    "netlist": (["ports", "insts", "conns", "aliases"], "insts"), "liberty": (["cells", "pins", "arcs", "constraints", "receivers", "ccs"], "cells"), "sdc": (["clocks", "io_delays", "exceptions", "groups", "ignored"], "clocks"),
    "lef": (["layers", "macros", "pins", "vias", "units"], "macros"), "def": (["nets", "net_pins", "segs", "via_points", "pnets", "psegs", "comps", "pins", "pin_rects", "via_defs", "rules"], "nets"),
}


class DesignSession:
    """load(path) picks the reader by the extension; tables[name] holds lazy DataFrames. Loading a kind again replaces it, but
    libraries add up, in the order of loading (lib_id)."""

    def __init__(self, spark: SparkSession, cache: bool = True, skip_ccs: bool = False):
        self.spark, self.cache, self.skip_ccs = spark, cache, skip_ccs
        self.tables: dict[str, DataFrame] = {}
        self.steps: list[dict] = []

    def load(self, path: str) -> str:
        ext = path.rsplit(".", 1)[-1].lower() if "." in os.path.basename(path) else ""
        if ext not in KINDS:
            raise ValueError(f"{path}: unknown extension {ext!r}; known are {', '.join(sorted(KINDS))}")
        kind = KINDS[ext]
        getattr(self, f"load_{kind}")(path)
        return kind

    def _files(self, path: str) -> DataFrame:
        t = self.spark.read.text(path, wholetext=True)
        return t.select(F.xxhash64(F.col("_metadata.file_path")).alias("src_id"), F.col("value").alias("text"))

    def _parsed(self, path: str, kind: str) -> DataFrame:
        """The parsed records, written once per content, reader and options, so a file that has not changed is not read again."""
        parser, schema, module = PARSERS[kind]
        if kind == "liberty" and self.skip_ccs:
            parser = lambda t: liberty.parse(t, skip_ccs=True)
        got = units_of_text.scan(self._files(path), parser, schema)
        if self.cache:
            sums = self._files(path).select(F.sha2("text", 256).alias("h")).orderBy("h").collect()  # a hash a file
            stamp = hashlib.sha256("".join([inspect.getsource(module), str(self.skip_ccs), *(r.h for r in sums)]).encode()).hexdigest()
            at = f"{shared_dir(self.spark).rstrip('/')}/netquarry-cache/{kind}-{stamp}"
            fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at + "/_SUCCESS")
            if not fs.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
                got.write.mode("overwrite").parquet(at)
            got = self.spark.read.schema(got.schema).parquet(at)
        units_of_text.check(got)
        return got

    def _register(self, path: str, kind: str, parsed: DataFrame) -> None:
        names, counted = TABLES[kind]
        for n in names:
            t = units_of_text.table(parsed, n)
            key = f"{kind}_{n}"
            if kind == "liberty":
                lib_id = sum(s["kind"] == "liberty" for s in self.steps)
                t = t.withColumn("lib_id", F.lit(lib_id))
                t = self.tables[key].unionByName(t) if lib_id else t
            self.tables[key] = t
        self.tables[kind] = parsed if kind != "liberty" or "liberty" not in self.tables else self.tables["liberty"].unionByName(parsed)
        self._step(path, kind, parsed.select(F.sum(F.size(counted)).alias("n")).first()["n"], counted)

    def _step(self, path: str, kind: str, n: int | None, what: str) -> None:
        self.steps.append({"ord": len(self.steps), "kind": kind, "path": path, "summary": f"{n or 0} {what}"})

    def load_netlist(self, path: str) -> None:
        self._register(path, "netlist", self._parsed(path, "netlist"))

    def load_netlist_json(self, path: str) -> None:
        t = yosys.scan(self._files(path))
        bad = yosys.errors(self._files(path)).agg(F.count("*").alias("n"), F.min(F.struct("src_id", "line", "col", "message")).alias("first")).first()
        if bad["n"]:
            raise ValueError(f"{path}: no JSON at line {bad['first']['line']}, column {bad['first']['col']}: {bad['first']['message']}")
        if t["module"].limit(1).count() == 0:
            raise ValueError(f"{path}: no top module")
        self.tables |= {"netlist_ports": t["port"].select("src_id", F.col("direction").alias("dir"), F.col("port").alias("name")), "netlist_insts": t["inst"].select("src_id", "ord", "cell", F.col("inst").alias("name")), "netlist_conns": t["conn"], "netlist": t["module"].withColumnRenamed("module", "top")}
        self._step(path, "netlist_json", t["inst"].count(), "insts")

    def load_liberty(self, path: str) -> None:
        self._register(path, "liberty", self._parsed(path, "liberty"))

    def load_sdc(self, path: str) -> None:
        self._register(path, "sdc", self._parsed(path, "sdc"))

    def load_lef(self, path: str) -> None:
        self._register(path, "lef", self._parsed(path, "lef"))

    def load_def(self, path: str) -> None:
        self._register(path, "def", self._parsed(path, "def"))

    def load_spef(self, path: str) -> None:
        t = spef.scan(vcd.read_lines(self.spark, path))
        self.tables |= {f"spef_{k}": v for k, v in t.items()}
        self._step(path, "spef", t["net"].count(), "nets")

    def steps_table(self) -> DataFrame:
        return self.spark.createDataFrame(self.steps, "ord int, kind string, path string, summary string")

    def lib_cell_count(self) -> int:
        return self.tables["liberty_cells"].count() if "liberty_cells" in self.tables else 0

    def merged_cells(self) -> DataFrame:
        from netquarry.operators.library import merge

        return merge(self.tables["liberty_cells"])

    def counts(self) -> dict[str, int]:
        """Rows of every table, in one job a kind."""
        return {k: v.count() for k, v in sorted(self.tables.items()) if "_" in k}

    def health(self) -> dict[str, str | None]:
        """One line on what was skipped or needs care, by kind; None where nothing does."""
        out: dict[str, str | None] = {}
        if "netlist_conns" in self.tables and "behavioural" in self.tables["netlist"].columns:
            size = lambda c: F.coalesce(F.size(c), F.lit(0))
            r = self.tables["netlist"].agg(F.sum("behavioural").alias("b"), F.sum("positional").alias("p"), F.sum(size("aliases")).alias("a"), F.max(F.struct(size("modules").alias("m"), "top")).alias("most")).first()
            notes = [f"{r.most.m} modules in a file; {r.most.top}, which none instantiates, is the top"] if r.most and r.most.m > 1 else []
            notes += [f"{r.p} positional connections carry no pin name"] if r.p else []
            notes += [f"{r.a} aliases: two names of one net"] if r.a else []
            notes += [f"{r.b} behavioural constructs: not a gate-level netlist"] if r.b else []
            out["netlist"] = "; ".join(notes) or None
        if "spef_health" in self.tables:
            r = self.tables["spef_health"].agg(*[F.sum(c).alias(c) for c in ("skipped", "reduced", "pnets")], F.bool_or("triplets").alias("triplets")).first()
            parts = [f"{r[c]} {t}" for c, t in (("skipped", "entries could not be read"), ("reduced", "reduced nets skipped"), ("pnets", "physical nets skipped")) if r[c]]
            out["spef"] = "; ".join(parts + (["triplets: the first value is used"] if r.triplets else [])) or None
        if "lef_units" in self.tables:
            r = self.tables["lef_units"].filter("factor <> 1").agg(F.count_distinct("quantity", "factor").alias("n"), F.min(F.struct("quantity", "factor")).alias("first")).first()
            out["lef"] = f"{r.n} unit factors not applied, the first: {r.first['quantity']} in {r.first['factor']:g}" if r.n else None
        if "sdc_ignored" in self.tables:
            ignored = self.tables["sdc_ignored"]
            n = ignored.agg(F.count_distinct("command").alias("n")).first()["n"]
            hard = sorted(r.command for r in ignored.filter(F.col("command").isin(sdc.TIMING_AFFECTING)).select("command").distinct().collect())  # no more than that list
            notes = [f"{n} commands ignored" + (f", of which these can move a slack: {', '.join(hard)}" if hard else "")] if n else []
            usable = F.coalesce((F.col("period") > 0) & (F.col("period") < float("inf")), F.lit(False))
            r = self.tables["sdc_clocks"].filter(~usable).agg(F.count("*").alias("n"), F.min("name").alias("first")).first()
            out["sdc"] = "; ".join(([f"{r.n} clocks without a usable period, the first: {r.first}"] if r.n else []) + notes) or None
        return out

    def summary(self) -> str:
        return "\n".join([*(f"{s['kind']}: {s['summary']} ({s['path']})" for s in self.steps), *(f"{k}: {v}" for k, v in self.health().items() if v)])

    def to_json(self) -> str:
        return json.dumps({"steps": self.steps, "counts": self.counts(), "health": self.health()}, indent=1, allow_nan=False)


def library_json(cells: DataFrame, pins: DataFrame, arcs: DataFrame) -> DataFrame:
    """One JSON text a cell: its properties and pins, of tables only the sizes."""
    dims = lambda c: F.array(F.coalesce(F.size(F.col(c)["values"]), F.lit(0)), F.coalesce(F.size(F.get(F.col(c)["values"], F.lit(0))), F.lit(0)))
    a = arcs.groupBy("cell", "pin").agg(F.array_sort(F.collect_list(F.struct("ord", "related_pin", "sense", dims("cell_rise").alias("cell_rise"), dims("cell_fall").alias("cell_fall")))).alias("arcs"))
    p = pins.join(a, ["cell", "pin"], "left").groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("pin", "direction", "capacitance", "function", "arcs"))).alias("pins"))
    return cells.join(p, "cell", "left").select("cell", F.to_json(F.struct("cell", "area", "leakage_w", "is_seq", "cell_footprint", "pins")).alias("json"))


HELP = """netquarry inspect [--json] FILE...   what the files hold
netquarry check FILE...              whether they can be read
netquarry version | help
  -v, --verbose   name each file that is loaded     -q, --quiet   no errors
  --describe      what this tool offers, as JSON    -V, --version"""
DESCRIBE = {"name": "netquarry", "kind": "multi-command", "summary": "reads netlists, libraries, constraints, parasitics and layout into DataFrames", "commands": ["inspect", "check"], "limits": ["tells what the named files hold, not whether they describe one design"]}


def main(argv: list[str]) -> int:
    """inspect, check, version, help: 0 if all files load, 1 if one fails, 2 for a wrong call."""
    from netquarry import __version__
    from netquarry.core import local_session

    known = {"--json", "-h", "--help", "-v", "--verbose", "-q", "--quiet", "-V", "--version", "--describe", "-vv", "-qq"}
    flags, words = {a for a in argv if a.startswith("-")}, [a for a in argv if not a.startswith("-")]
    if "--describe" in flags:
        print(json.dumps(DESCRIBE))
        return 0
    if flags & {"-V", "--version"} or words[:1] == ["version"]:
        print(__version__)
        return 0
    if flags - known:
        print(f"unknown option {sorted(flags - known)[0]}; try --help")
        return 2
    if flags & {"-h", "--help"} or not words or words[0] == "help":
        print(HELP)
        return 0
    if words[0] not in ("inspect", "check") or len(words) == 1:
        print(f"unknown command {words[0]}; try --help" if words[0] not in ("inspect", "check") else f"{words[0]}: no files")
        return 2
    loud, d, failed = len(flags & {"-v", "--verbose", "-vv"}) - len(flags & {"-q", "--quiet", "-qq"}), DesignSession(local_session(), cache=False), []
    for f in words[1:]:
        try:
            kind = d.load(f)
            if loud > 0:
                print(f"{kind}: {f}")
        except Exception as e:  # noqa: BLE001  every file is tried
            failed.append(f"{f}: {str(e).splitlines()[0]}")
    if loud >= 0 and failed:
        print("\n".join(failed))
    if words[0] == "inspect":
        print(d.to_json() if "--json" in flags else d.summary())
    else:
        print(f"FAIL: {len(failed)} of {len(words) - 1} files failed" if failed else f"PASS: {len(words) - 1} files read")
    return 1 if failed else 0


if __name__ == "__main__":
    import sys

    sys.exit(main(sys.argv[1:]))
