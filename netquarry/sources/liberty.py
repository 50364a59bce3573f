"""Cell libraries: groups and attributes to cells, pins, arcs, constraints and tables."""

from __future__ import annotations

import re

_T = "struct<index_1:array<double>,index_2:array<double>,`values`:array<array<double>>>"
SCHEMA = (
    "name:string,voltage:double,thresholds:map<string,double>,cells:array<struct<cell:string,area:double,leakage_w:double,int_energy_j:double,is_seq:boolean,clock_pin:string,cell_footprint:string,async_reset_pins:array<string>>>,"
    "pins:array<struct<cell:string,pin:string,direction:string,capacitance:double,cap_f:double,is_clock:boolean,function:string>>,"
    f"arcs:array<struct<cell:string,pin:string,related_pin:string,sense:string,ccs_declared:boolean,cell_rise:{_T},cell_fall:{_T},rise_transition:{_T},fall_transition:{_T},sigma_rise:{_T},sigma_fall:{_T}>>,"
    f"receivers:array<struct<cell:string,pin:string,c1_rise:{_T},c2_rise:{_T},c1_fall:{_T},c2_fall:{_T}>>,"
    "ccs:array<struct<cell:string,pin:string,arc:bigint,edge:string,in_slew:double,out_cap:double,ref_time:double,time:array<double>,current:array<double>>>,"
    f"constraints:array<struct<cell:string,pin:string,kind:string,related_pin:string,rise:{_T},fall:{_T}>>"
)
_TOKEN = re.compile(r'/\*.*?\*/|//[^\n]*|\\\r?\n|"(?:[^"\\]|\\.|\\\n)*"|[{}();:,]|[^\s{}();:,"]+|\n', re.S)
_PREFIX = {"f": 1e-15, "p": 1e-12, "n": 1e-9, "u": 1e-6, "m": 1e-3, "": 1.0, "k": 1e3}


class Group:
    """A group with its arguments, attributes (the last one counts) and groups within."""

    def __init__(self, kind: str, args: list[str]):
        self.kind, self.args, self.attrs, self.groups, self.lists = kind, args, {}, [], {}

    def of(self, kind: str) -> list[Group]:
        return [g for g in self.groups if g.kind == kind]

    def num(self, key: str, default: float | None = None) -> float | None:
        try:
            return float(self.attrs[key])
        except (KeyError, ValueError):
            return default


def tree(text: str) -> list[Group]:
    """The groups of a text. An attribute ends at ; or at the line's end; comments are left out."""
    w = [t for t in _TOKEN.findall(text) if not t.startswith(("/*", "//")) and not re.fullmatch(r"\\\r?\n", t)]
    root = Group("", [])
    stack, at = [root], 0
    clean = lambda t: re.sub(r"\\\r?\n", "", t)[1:-1].strip() if t.startswith('"') else t
    while at < len(w):
        t = w[at]
        if t == "}":
            if len(stack) > 1:
                stack.pop()
            at += 1
        elif t in "{;:,()\n":
            at += 1
        elif at + 1 < len(w) and w[at + 1] == ":":
            at += 2
            while at < len(w) and w[at] == "\n":
                at += 1
            value = []
            while at < len(w) and w[at] not in (";", "\n", "}"):
                value.append(clean(w[at]))
                at += 1
            stack[-1].attrs[t] = " ".join(value)
        elif at + 1 < len(w) and w[at + 1] == "(":
            at += 2
            args = []
            while at < len(w) and w[at] != ")":
                if w[at] not in (",", "\n"):
                    args.append(clean(w[at]))
                at += 1
            at += 1
            k = at
            while k < len(w) and w[k] == "\n":
                k += 1
            if k < len(w) and w[k] == "{":
                g = Group(t, args)
                stack[-1].groups.append(g)
                stack.append(g)
                at = k + 1
            else:
                stack[-1].lists[t] = args
        else:
            at += 1
    return root.groups


def _floats(parts: list[str]) -> list[float]:
    out = []
    for p in parts:
        for x in p.split(","):
            try:
                out.append(float(x))
            except ValueError:
                pass
    return out


def _table(g: Group | None) -> dict | None:
    if g is None:
        return None
    return {"index_1": _floats(g.lists.get("index_1", [])), "index_2": _floats(g.lists.get("index_2", [])), "values": [_floats([r]) for r in g.lists.get("values", [])]}


def _si(text: str | None, base: str) -> float | None:
    m = re.fullmatch(rf"\s*([0-9.eE+-]*)\s*([fpnumk]?){base}\s*", text or "", re.I)
    return float(m[1] or 1) * _PREFIX[m[2].lower()] if m else None


def parse(text: str, skip_ccs: bool = False) -> dict:
    """One library. Of repeated cells the last counts; clear, preset and pulse-width groups are no arcs."""
    libs = [g for g in tree(text) if g.kind == "library"]
    if not libs:
        raise ValueError("no library")
    lib = libs[0]
    cap = lib.lists.get("capacitive_load_unit", ["1", "pf"])
    cap_f = (_floats(cap[:1]) or [1.0])[0] * (_si("1" + cap[1], "f") or 1e-12 if len(cap) > 1 else 1e-12)
    leak_w = _si(lib.attrs.get("leakage_power_unit"), "w") or 1e-9
    volt, amp, sec = _si(lib.attrs.get("voltage_unit"), "v") or 1.0, _si(lib.attrs.get("current_unit"), "a") or 1e-3, _si(lib.attrs.get("time_unit"), "s") or 1e-9
    energy_j = volt * amp * sec
    cells: dict[str, Group] = {g.args[0]: g for g in lib.of("cell") if g.args}
    if not cells:
        raise ValueError("no cells")
    d: dict = {"name": (lib.args or [""])[0], "voltage": lib.num("nom_voltage", 1.8), "thresholds": {k: float(v) for k, v in lib.attrs.items() if ("threshold" in k or k == "slew_derate_from_library") and _floats([v])}, "cells": [], "pins": [], "arcs": [], "constraints": [], "receivers": [], "ccs": []}
    for name, c in sorted(cells.items()):
        pins = {p: g for g in c.of("pin") for p in g.args}
        ff = (c.of("ff") + c.of("latch") or [None])[0]
        state: dict[str, float] = {}
        for k, g in enumerate(c.of("leakage_power")):
            key = g.attrs.get("when") or f"#{k}"
            state[key] = state.get(key, 0.0) + (g.num("value", 0.0) or 0.0)
        leak = c.num("cell_leakage_power")
        leak = leak if leak is not None else (sum(state.values()) / len(state) if state else 0.0)
        power: list[float] = []
        work = list(c.groups)
        while work:
            g = work.pop()
            if g.kind == "internal_power":
                power += [abs(x) for t in g.groups for r in t.lists.get("values", []) for x in _floats([r])]
            else:
                work += g.groups
        resets = sorted({i for k in ("clear", "preset") for i in re.findall(r"[A-Za-z0-9_]+", ff.attrs.get(k, "")) if i in pins}) if ff else []
        clocks = sorted(p for p, g in pins.items() if g.attrs.get("clock") == "true")
        d["cells"].append({"cell": name, "area": c.num("area", 0.0), "leakage_w": leak * leak_w, "int_energy_j": sum(power) / len(power) * energy_j if power else 0.0, "is_seq": ff is not None, "clock_pin": clocks[0] if clocks else None, "cell_footprint": c.attrs.get("cell_footprint") or None, "async_reset_pins": resets})
        for p, g in sorted(pins.items()):
            direction = g.attrs.get("direction", "")
            d["pins"].append({"cell": name, "pin": p, "direction": direction if direction in ("input", "output", "inout") else "other", "capacitance": g.num("capacitance", 0.0), "cap_f": (g.num("capacitance", 0.0) or 0.0) * cap_f, "is_clock": g.attrs.get("clock") == "true", "function": g.attrs.get("function") or None})
            for r in [] if skip_ccs else g.of("receiver_capacitance")[:1]:
                seg = {f"c{k}_{e}": _table((r.of(f"receiver_capacitance{k}_{e}") or [None])[0]) for k in (1, 2) for e in ("rise", "fall")}
                d["receivers"].append({"cell": name, "pin": p, **seg})
            for t in g.of("timing"):
                kind = t.attrs.get("timing_type", "")
                tab = lambda n, t=t: _table((t.of(n) or [None])[0])
                check = next((k for k in ("setup", "hold", "recovery", "removal") if kind.startswith(k)), None)
                if check:
                    d["constraints"].append({"cell": name, "pin": p, "kind": check, "related_pin": t.attrs.get("related_pin", ""), "rise": tab("rise_constraint"), "fall": tab("fall_constraint")})
                elif not kind.startswith(("clear", "preset")) and "pulse_width" not in kind:
                    d["arcs"].append({"cell": name, "pin": p, "related_pin": t.attrs.get("related_pin", ""), "sense": t.attrs.get("timing_sense", "non_unate"), "ccs_declared": bool(t.of("output_current_rise") or t.of("output_current_fall")), **{n: tab(n) for n in ("cell_rise", "cell_fall", "rise_transition", "fall_transition")}, "sigma_rise": tab("ocv_sigma_cell_rise"), "sigma_fall": tab("ocv_sigma_cell_fall")})
                    for edge in () if skip_ccs else ("rise", "fall"):
                        for v in (x for c2 in t.of(f"output_current_{edge}") for x in c2.of("vector")):
                            at, one = _floats(v.lists.get("index_3", [])), lambda key, v=v: (_floats(v.lists.get(key, [])) or [0.0])[0]
                            d["ccs"].append({"cell": name, "pin": p, "arc": len(d["arcs"]) - 1, "edge": edge, "in_slew": one("index_1"), "out_cap": one("index_2"), "ref_time": v.num("reference_time", 0.0), "time": at, "current": _floats(v.lists.get("values", []))})
    return d
