"""Technology and cell abstracts: layers, vias, macros and their pins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r'#[^\n]*|"[^"]*"|;|\n|[^\s;"]+')
SCHEMA = (
    "layers:array<struct<layer:string,routing:boolean,width_um:double,thickness_um:double,rpersq:double,cpersqdist:double,edge_cap:double,cut_res:double,dc_jmax:double,ac_rms:double,ac_peak:double,routing_ord:bigint>>,"
    "macros:array<struct<macro:string,width:double,height:double>>,pins:array<struct<macro:string,pin:string,direction:string>>,vias:array<struct<via:string,layers:array<string>>>,"
    "units:array<struct<quantity:string,factor:double>>,unknown:array<string>"
)
#: Units that the values are already in; any other factor is reported as not applied.
APPLIED = {"DATABASE"}


def statements(text: str) -> list[list[str]]:
    """Statements up to ; . Words that open or close a block need none: LAYER x, MACRO x, PIN x, PORT, END x and the like."""
    out: list[list[str]] = []
    cur: list[str] = []
    opener = {"LAYER", "MACRO", "PIN", "VIA", "VIARULE", "END", "SITE", "NONDEFAULTRULE", "ARRAY"}
    alone = {"PORT", "OBS", "UNITS", "PROPERTYDEFINITIONS", "SPACING", "DENSITY"}
    words = [t for t in _TOKEN.findall(text) if t[0] != "#"]
    for k, t in enumerate(words):
        if t == "\n":
            if cur and cur[0].upper() == "END" and len(cur) == 1:
                out.append(cur)
                cur = []
            continue
        if t == ";":
            if cur:
                out.append(cur)
            cur = []
            continue
        up = t.upper()
        if not cur and up in alone:
            out.append([t])
            continue
        cur.append(t)
        if len(cur) == 2 and cur[0].upper() in opener and (k + 1 >= len(words) or words[k + 1] not in (";",) or cur[0].upper() == "END"):
            if cur[0].upper() in ("LAYER", "VIA", "SITE") and k + 1 < len(words) and words[k + 1] == ";":
                continue
            out.append(cur)
            cur = []
    if cur:
        out.append(cur)
    return out


def _num(words: list[str], k: int = 1) -> float:
    try:
        return float(words[k])
    except (IndexError, ValueError):
        return 0.0


def parse(text: str) -> dict:
    """Layers in the order of declaration, macros and vias. A file with neither layers nor macros is an error."""
    layers: dict[str, dict] = {}
    macros: dict[str, dict] = {}
    pins: dict[tuple[str, str], str] = {}
    vias: dict[str, list[str]] = {}
    units: list[dict] = []
    stack: list[tuple[str, str]] = []
    known = {"WIDTH", "THICKNESS", "RESISTANCE", "CAPACITANCE", "EDGECAPACITANCE", "TYPE", "DCCURRENTDENSITY", "ACCURRENTDENSITY", "SIZE", "DIRECTION", "LAYER", "RECT", "POLYGON", "VIA", "VERSION", "END"}
    unknown: set[str] = set()
    field = {"WIDTH": "width_um", "THICKNESS": "thickness_um", "EDGECAPACITANCE": "edge_cap"}
    for s in statements(text):
        kw = s[0].upper()
        top = stack[-1] if stack else ("", "")
        if kw == "END":
            # END names the block it closes, or nothing for PORT and OBS
            while len(s) > 1 and stack and stack[-1][1] != s[1] and stack[-1][0] in ("PORT", "OBS"):
                stack.pop()
            if stack:
                stack.pop()
            continue
        if kw in ("UNITS", "PROPERTYDEFINITIONS", "PORT", "OBS") and len(s) == 1:
            stack.append((kw, kw))
            continue
        if kw in ("LAYER", "MACRO", "VIA", "VIARULE", "SITE", "NONDEFAULTRULE", "PIN", "ARRAY") and len(s) == 2 and top[0] not in ("PORT", "OBS", "VIA", "VIARULE") and not (kw == "LAYER" and top[0] in ("VIA", "NONDEFAULTRULE")):
            name = s[1]
            stack.append((kw, name))
            if kw == "LAYER":
                layers.setdefault(name, {"layer": name, "routing": False, "width_um": 0.0, "thickness_um": 0.0, "rpersq": 0.0, "cpersqdist": 0.0, "edge_cap": 0.0, "cut_res": 0.0, "dc_jmax": 0.0, "ac_rms": 0.0, "ac_peak": 0.0, "routing_ord": None})
            elif kw == "MACRO":
                macros.setdefault(name, {"macro": name, "width": 0.0, "height": 0.0})
            elif kw == "VIA":
                vias.setdefault(name, [])
            elif kw == "PIN":
                owner = next((n for k, n in reversed(stack) if k == "MACRO"), "")
                pins.setdefault((owner, name), "unknown")
            continue
        if top[0] == "LAYER":
            d = layers[top[1]]
            second = s[1].upper() if len(s) > 1 else ""
            if kw == "TYPE" and second == "ROUTING" and not d["routing"]:
                d["routing"], d["routing_ord"] = True, sum(x["routing"] for x in layers.values())
            elif kw in field:
                d[field[kw]] = _num(s)
            elif kw == "RESISTANCE":
                if second == "RPERSQ":
                    d["rpersq"] = _num(s, 2)
                else:
                    d["cut_res"] = _num(s)
            elif kw == "CAPACITANCE" and second == "CPERSQDIST":
                d["cpersqdist"] = _num(s, 2)
            elif kw == "DCCURRENTDENSITY" and second == "AVERAGE":
                d["dc_jmax"] = _num(s, 2)
            elif kw == "ACCURRENTDENSITY" and second in ("RMS", "PEAK"):
                d["ac_" + second.lower()] = _num(s, 2)
        elif top[0] == "MACRO" and kw == "SIZE":
            macros[top[1]] |= {"width": _num(s, 1), "height": _num(s, 3)}
        elif top[0] == "PIN" and kw == "DIRECTION":
            owner = next((n for k, n in reversed(stack) if k == "MACRO"), "")
            pins[owner, top[1]] = s[1].lower()
        elif top[0] == "VIA" and kw == "LAYER" and s[1] not in vias[top[1]]:
            vias[top[1]].append(s[1])
        elif top[0] == "UNITS" and kw not in APPLIED and len(s) > 2:
            units.append({"quantity": kw.lower(), "factor": _num(s, 2)})
        elif not stack and kw not in known:
            unknown.add(kw)
    if not layers and not macros:
        raise ValueError("neither layers nor macros")
    return {"layers": list(layers.values()), "macros": list(macros.values()), "pins": [{"macro": m, "pin": p, "direction": d} for (m, p), d in pins.items()], "vias": [{"via": v, "layers": x} for v, x in vias.items()], "units": units, "unknown": sorted(unknown)}


def with_layer(rows: DataFrame, layers: DataFrame) -> DataFrame:
    """rows (layer) with the layer's width_um and thickness_um, 0 where the layer is not known."""
    known = layers.groupBy("layer").agg(F.max("width_um").alias("width_um"), F.max("thickness_um").alias("thickness_um"))
    j = rows.join(known, "layer", "left")
    return j.withColumn("width_um", F.coalesce("width_um", F.lit(0.0))).withColumn("thickness_um", F.coalesce("thickness_um", F.lit(0.0)))


def with_direction(rows: DataFrame, pins: DataFrame) -> DataFrame:
    """rows (macro, pin) with the pin's direction, 'unknown' where it has none."""
    j = rows.join(pins.select("macro", "pin", "direction"), ["macro", "pin"], "left")
    return j.withColumn("direction", F.coalesce("direction", F.lit("unknown")))
