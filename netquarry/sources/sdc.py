"""Timing constraints: the commands of a file in order, with variables, units, object queries and exceptions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.operators.rejects import sdc_words

# Commands that are not modelled though ignoring them can move a slack.
TIMING_AFFECTING = [
    "set_driving_cell", "set_drive", "set_operating_conditions", "set_voltage", "set_resistance", "set_wire_load_model", "set_wire_load_mode", "set_wire_load_selection_group", "set_wire_load_min_block_size",
    "set_fanout_load", "set_port_fanout_number", "set_case_analysis", "set_logic_zero", "set_logic_one", "set_logic_dc", "set_disable_timing", "set_max_delay", "set_min_delay", "set_max_time_borrow", "set_data_check",
    "set_min_pulse_width", "group_path", "set_clock_transition", "set_propagated_clock", "set_clock_sense", "set_sense", "set_clock_gating_check", "set_ideal_network", "set_ideal_latency", "set_ideal_transition",
    "derive_clock_uncertainty", "derive_pll_clocks", "set_max_transition", "set_max_fanout", "set_max_capacitance", "set_min_capacitance", "set_disable_clock_gating_check", "unset_propagated_clock", "set_max_trans",
]
# Commands that are not modelled either, and that no timer consults.
BENIGN = [
    "set_max_area", "set_max_dynamic_power", "set_max_leakage_power", "create_voltage_area", "set_level_shifter_strategy", "set_level_shifter_threshold", "set_dont_touch", "set_dont_use", "set_size_only",
    "set_clock_gating_enable", "set_clock_gating_style", "set_clock_gating_verification", "set_timing_enable_verification", "set_dont_touch_network", "set_optimize_design", "set_scan_configuration",
    "set_min_porosity", "set_critical_range",
]
TIMES = {"fs": 1e-6, "ps": 1e-3, "ns": 1.0, "us": 1e3, "ms": 1e6, "s": 1e9}
FREQS = {"hz": 1.0, "khz": 1e3, "mhz": 1e6, "ghz": 1e9}
CAPS = {"ff": 1e-3, "pf": 1.0, "nf": 1e3, "uf": 1e6, "mf": 1e9, "f": 1e12}
SCHEMA = (
    "clocks:array<struct<name:string,source:string,period:double>>,io_delays:array<struct<dir:string,value:double,is_default:boolean,ports:array<string>>>,"
    "exceptions:array<struct<kind:string,mult:int,from_set:array<string>,to_set:array<string>>>,groups:array<struct<clocks:array<string>>>,ignored:array<struct<command:string>>,"
    "setup_uncertainty:double,hold_uncertainty:double,clock_latency:double,input_transition:double,load:double,late_derate:double,early_derate:double,notes:array<string>"
)
_QUERY = {"all_inputs": "*INPUTS*", "all_outputs": "*OUTPUTS*", "all_registers": "*REGISTERS*"}


def number(t: str | None) -> float | None:
    try:
        return float(t) if t and not t[-1].isspace() and "_" not in t else None
    except ValueError:
        return None


def commands(text: str) -> list[str]:
    """Logical lines: continued lines joined, comments and empty ones left out, ended by ; outside groups."""
    out, depth, cur = [], 0, []
    for raw in text.replace("\\\r\n", " ").replace("\\\n", " ").splitlines():
        if not depth and raw.lstrip().startswith("#"):
            continue
        quoted = False
        for c in raw:
            if c == '"':
                quoted = not quoted
            elif not quoted:
                depth += c in "[{"
                depth -= c in "]}"
            if c == ";" and depth <= 0 and not quoted:
                out.append("".join(cur))
                cur = []
            elif c == "#" and depth <= 0 and not quoted and not "".join(cur).strip():
                break
            else:
                cur.append(c)
        if depth <= 0:
            out.append("".join(cur))
            cur, depth = [], 0
        else:
            cur.append(" ")
    out.append("".join(cur))
    return [x.strip() for x in out if x.strip()]


def _strip(w: str) -> str:
    return w[1:-1] if len(w) > 1 and w[0] + w[-1] in ('""', "{}") else w


def objects(w: str) -> list[str]:
    """Names that a word stands for: queries by kind, collections as marks, nested lists in order."""
    w = w.strip()
    if w.startswith("[") and w.endswith("]"):
        parts = sdc_words(w[1:-1]) or []
        if not parts:
            return []
        if parts[0] in _QUERY:
            return [_QUERY[parts[0]]]
        keep, skip = [], False
        for p in parts[1:]:
            if skip:
                skip = False
            elif p in ("-of_objects", "-filter"):
                skip = True
            elif not p.startswith("-"):
                keep.append(p)
        return [o for p in keep for o in objects(p)]
    if w[:1] in "{\"" and len(w) > 1:
        return [o for p in (sdc_words(_strip(w)) or []) for o in objects(p)]
    return [w.replace("\\", "")] if w else []


def period(t: str) -> float | None:
    t = _strip(t).strip()
    x = number(t)
    if x is not None:
        return x
    m = re.fullmatch(r"([0-9.eE+-]+)\s*([a-zA-Z]+)", t)
    if not m or number(m[1]) is None:
        return None
    if m[2] in TIMES:
        return float(m[1]) * TIMES[m[2]]
    hz = FREQS.get(m[2].lower())
    return 1e9 / (float(m[1]) * hz) if hz and float(m[1]) > 0 else None


def parse(text: str) -> dict:
    """Everything modelled, and the names of the other commands. A clock without a readable period is an error."""
    var: dict[str, str] = {}
    scale = {"time": 1.0, "cap": 1.0}
    d: dict = {k: [] for k in ("clocks", "io_delays", "exceptions", "groups", "ignored", "notes")}
    d |= {"setup_uncertainty": 0.0, "hold_uncertainty": 0.0, "clock_latency": 0.0, "input_transition": None, "load": None, "late_derate": None, "early_derate": None}
    generated: list[tuple[str, str, float]] = []

    def put(m: re.Match) -> str:
        return var.get(m[1] or m[2] or m[3], m[0])

    for line in commands(text):
        line = re.sub(r"\$(?:::env|env)\(([^)]*)\)|\$\{([^}]*)\}|\$([A-Za-z_][A-Za-z0-9_]*)", put, line)
        w = sdc_words(line)
        if w is None:
            w = line.split()
        if not w:
            continue
        cmd, args = w[0], w[1:]

        def flag(name: str, words: list[str] = args) -> str | None:
            return next((words[k + 1] for k in range(len(words) - 1) if words[k] == name), None)

        def trailing(valued: set[str], words: list[str] = args) -> str | None:
            """The last word that is neither a flag nor a flag's value."""
            left = [x for k, x in enumerate(words) if not x.startswith("-") and not (k and words[k - 1] in valued)]
            return left[-1] if left else None

        def ends(*names: str) -> list[str]:
            got = {o.rpartition("/")[0] or o for n in names for o in objects(flag(n) or "") if not o.startswith("*")}
            return sorted(got) or ["*"]

        numbers = [x for x in (number(a) for a in args if a[:1] not in "-[") if x is not None]
        if cmd == "set" and len(args) > 1:
            var[args[0]] = _strip(args[1])
        elif cmd in ("set_units", "set_unit"):
            for name, key, table in (("-time", "time", TIMES), ("-capacitance", "cap", CAPS)):
                m = re.fullmatch(r"([0-9.eE+-]*?)\s*([a-zA-Z]+)", _strip(flag(name) or ""))
                if m and m[2].lower() in table:
                    scale[key] = (number(m[1]) or 1.0) * table[m[2].lower()]
        elif cmd == "create_clock":
            p = period(flag("-period") or "")
            if p is None:
                raise ValueError(f"a clock without a readable period: {line}")
            src = next(iter(objects(trailing({"-name", "-period", "-waveform", "-comment"}) or "")), "")
            d["clocks"].append({"name": _strip(flag("-name") or "") or src or "clk", "source": src, "period": p * scale["time"]})
        elif cmd == "create_generated_clock":
            at = next(iter(objects(trailing({"-name", "-source", "-divide_by", "-multiply_by", "-edges", "-comment", "-master_clock"}) or "")), "")
            name = _strip(flag("-name") or "") or at
            ratio = max(1.0, number(flag("-divide_by")) or 1.0) / max(1.0, number(flag("-multiply_by")) or 1.0)
            generated.append((name, at or name, ratio))
        elif cmd in ("set_input_delay", "set_output_delay"):
            v = number(args[0]) if args and not args[0].startswith("-") else number(flag("-max"))
            if v is None:
                d["notes"].append(f"{cmd} without a value in front counts as 0")
            o = trailing({"-clock", "-max", "-min", "-reference_pin", "-comment"}, args[1:] if args and number(args[0]) is not None else args)
            names = objects(o or "") if number(o) is None else []  # a bare value is no object
            every = not names or any(x in ("*INPUTS*", "*OUTPUTS*") for x in names)
            d["io_delays"].append({"dir": cmd[4:-6], "value": (v or 0.0) * scale["time"], "is_default": every, "ports": [x for x in names if not x.startswith("*")]})
        elif cmd == "set_clock_uncertainty":
            v = (numbers or [0.0])[0] * scale["time"]
            for key in ("setup", "hold"):
                if f"-{key}" in args or not {"-setup", "-hold"} & set(args):
                    d[f"{key}_uncertainty"] = max(d[f"{key}_uncertainty"], v)
        elif cmd == "set_clock_latency":
            d["clock_latency"] = max([d["clock_latency"], *(x * scale["time"] for x in numbers[:1])])
        elif cmd == "set_input_transition":
            v = number(args[0]) if args else None
            d["input_transition"] = d["input_transition"] if v is None else v * scale["time"]
        elif cmd == "set_load":
            d["load"] = numbers[0] * scale["cap"] if numbers else d["load"]
        elif cmd == "set_timing_derate":
            for key in ("late", "early"):
                v = number(flag(f"-{key}"))
                d[f"{key}_derate"] = d[f"{key}_derate"] if v is None else v
        elif cmd in ("set_clock_groups", "set_clock_group"):
            for k in range(len(args) - 1):
                if args[k] == "-group":
                    names = [x for x in objects(args[k + 1]) if not x.startswith("*")]
                    d["groups"] += [{"clocks": names}] if names else []
        elif cmd in ("set_false_path", "set_multicycle_path"):
            mult = None
            if cmd == "set_multicycle_path":
                plain = args[0] if args and re.fullmatch(r"\+?\d+", args[0]) else None
                mult = int(plain) if plain else 1
                if not plain:
                    d["notes"].append("set_multicycle_path without a number in front counts as 1")
            d["exceptions"].append({"kind": cmd[4:-5], "mult": mult, "from_set": ends("-from", "-rise_from", "-fall_from"), "to_set": ends("-to", "-rise_to", "-fall_to")})
        else:
            d["ignored"].append({"command": cmd})
    master = d["clocks"][0]["period"] if d["clocks"] else 0.0
    d["clocks"] += [{"name": n, "source": s, "period": master * r} for n, s, r in generated]
    return d


def ignored_affecting_timing(ignored: list[str]) -> list[str]:
    return sorted(set(ignored) & set(TIMING_AFFECTING))


def effect(command: Column | str) -> Column:
    """Of a command that is ignored: timing (it can move a slack), benign (it can't) or unknown."""
    c = F.col(command) if isinstance(command, str) else command
    return F.when(c.isin(TIMING_AFFECTING), "timing").when(c.isin(BENIGN), "benign").otherwise("unknown")


def named_endpoints(exceptions: DataFrame) -> DataFrame:
    """src_id, ord, side (-from or -to) and name of each end that is spelt out: what can be checked for existence."""
    ends = lambda c, side: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.struct(F.lit(side).alias("side"), x.alias("name")))
    e = exceptions.select("src_id", "ord", F.inline(F.concat(ends("from_set", "-from"), ends("to_set", "-to"))))
    return e.filter("name <> '' and name <> '*'")


def covers(from_set: list[str], to_set: list[str], a: str, b: str) -> bool:
    """Whether an exception applies to a path: an empty set or * matches everything."""
    hit = lambda s, x: not s or "*" in s or x in s
    return hit(from_set, a) and hit(to_set, b)


def covered(from_set: Column, to_set: Column, a: Column, b: Column) -> Column:
    """covers() as an expression over exception rows and paths."""
    hit = lambda s, x: (F.coalesce(F.size(s), F.lit(0)) <= 0) | F.array_contains(s, "*") | F.array_contains(s, x)
    return hit(from_set, a) & hit(to_set, b)


def is_virtual(source: Column) -> Column:
    return F.coalesce(source, F.lit("")) == ""
