"""Placement and routing files: nets with segments and vias, power nets, components, pins with placed shapes, via definitions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r'#[^\n]*|"[^"]*"|[()]|;|[^\s();"]+')
# Names of power nets, looked for in this order where no net is marked as one.
POWER_NETS = ["VPWR", "VDD", "VCCD", "VCC", "VDDP"]
SCHEMA = (
    "design:string,dbu:double,nets:array<struct<name:string,raw_name:string,rule:string,vias:bigint,vias_raw:bigint>>,net_pins:array<struct<net:string,inst:string,pin:string>>,"
    "segs:array<struct<net:string,layer:string,x0:double,y0:double,x1:double,y1:double,rule:string>>,via_points:array<struct<net:string,layer:string,x:double,y:double,via:string>>,"
    "pnets:array<struct<net:string,use_power:boolean>>,psegs:array<struct<net:string,layer:string,width_dbu:bigint,x1:bigint,y1:bigint,x2:bigint,y2:bigint>>,"
    "comps:array<struct<name:string,cell:string,x:bigint,y:bigint,orient:string>>,pins:array<struct<pin:string,net:string,use_power:boolean,use_ground:boolean,x:bigint,y:bigint,orient:string>>,"
    "pin_rects:array<struct<pin:string,layer:string,x1:bigint,y1:bigint,x2:bigint,y2:bigint>>,via_defs:array<struct<via:string,cut_layer:string,below:string,above:string,cuts:bigint>>,rules:array<struct<rule:string,layer:string,width_um:double>>"
)
ORIENTS = {"R0": "N", "R90": "W", "R180": "S", "R270": "E", "MY": "FN", "MX": "FS", "MX90": "FW", "MY90": "FE"}


def orient(x: Column, y: Column, o: Column) -> tuple[Column, Column]:
    """A point turned and mirrored by one of the eight orientations, or their other names."""
    flat = [F.lit(v) for kv in ORIENTS.items() for v in kv]
    o = F.coalesce(F.try_element_at(F.create_map(*flat), F.upper(o)), F.upper(o))
    px = F.when(o == "S", -x).when(o == "W", -y).when(o == "E", y).when(o == "FN", -x).when(o == "FW", y).when(o == "FE", -y).otherwise(x)
    py = F.when(o == "S", -y).when(o == "W", x).when(o == "E", -x).when(o == "FS", -y).when(o == "FW", x).when(o == "FE", -x).otherwise(y)
    return px, py


def placed(pins: DataFrame, rects: DataFrame) -> DataFrame:
    """Pin shapes at their absolute places: turned, moved and with ordered corners."""
    r = rects.join(pins.select("src_id", "pin", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("orient").alias("_o")), ["src_id", "pin"])
    ax, ay = orient(F.col("x1"), F.col("y1"), F.col("_o"))
    bx, by = orient(F.col("x2"), F.col("y2"), F.col("_o"))
    return r.select("src_id", "pin", "layer", (F.least(ax, bx) + F.col("_x")).alias("x1"), (F.least(ay, by) + F.col("_y")).alias("y1"), (F.greatest(ax, bx) + F.col("_x")).alias("x2"), (F.greatest(ay, by) + F.col("_y")).alias("y2"))


def widths(segs: DataFrame, rules: DataFrame) -> DataFrame:
    """Segments with the width their rule gives their layer, 0 without one."""
    w = rules.groupBy("src_id", "rule", "layer").agg(F.max("width_um").alias("width_um"))
    return segs.join(w, ["src_id", "rule", "layer"], "left").withColumn("width_um", F.coalesce("width_um", F.lit(0.0)))


def segment_facts(segs: DataFrame) -> DataFrame:
    """Length, direction and footprint of segments."""
    dx, dy, h = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")), F.col("width_um") / 2
    s = segs.withColumn("len_um", dx + dy).withColumn("is_horizontal", dy < 1e-9).withColumn("is_vertical", dx < 1e-9)
    return s.withColumn("fx0", F.least("x0", "x1") - h).withColumn("fy0", F.least("y0", "y1") - h).withColumn("fx1", F.greatest("x0", "x1") + h).withColumn("fy1", F.greatest("y0", "y1") + h)


def power_net(pnets: DataFrame) -> DataFrame:
    """The power net of each source: marked as one, else by a known name, else the first."""
    known = F.array_position(F.array(*[F.lit(n) for n in POWER_NETS]), F.col("net"))
    rank = F.when(F.col("use_power"), 0).when(known > 0, 1).otherwise(2)
    return pnets.groupBy("src_id").agg(F.min_by("net", F.struct(rank, F.col("ord"))).alias("net"))


def write_name(raw: Column | str, name: Column | str) -> Column:
    r, n = (F.col(c) if isinstance(c, str) else c for c in (raw, name))
    return F.when(F.coalesce(r, F.lit("")) == "", n).otherwise(r)


def _items(words: list[str], at: int, section: str) -> tuple[list[list[str]], int]:
    """The `- ... ;` statements of a section, and the place after its END."""
    out, cur = [], []
    while at < len(words):
        t = words[at]
        if t == "END" and at + 1 < len(words) and words[at + 1] == section:
            return out, at + 2
        if t == ";":
            if cur and cur[0] == "-":
                out.append(cur[1:])
            cur = []
        else:
            cur.append(t)
        at += 1
    return out, at


def _int(t: str) -> int | None:
    try:
        return int(float(t))
    except ValueError:
        return None


def _plain(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def _route(words: list[str], scale: float, special: bool) -> tuple[list[tuple], list[tuple], int, set[str]]:
    """Segments (layer, width, x0, y0, x1, y1, rule), vias (layer, x, y, name), the count of all other words, and the rule of each wire."""
    segs, vias, other, k = [], [], 0, 0
    layer = rule = ""
    width, last = 0, None
    while k < len(words):
        t = words[k]
        if t in ("ROUTED", "COVER", "FIXED", "NOSHIELD", "NEW") and k + 1 < len(words):
            layer, last, rule, width, k = words[k + 1], None, "", 0, k + 2
            if special and k < len(words) and _int(words[k]) is not None:
                width, k = _int(words[k]), k + 1
            continue
        if t == "TAPERRULE" and k + 1 < len(words):
            rule, k = words[k + 1], k + 2
            continue
        if t == "TAPER":
            k += 1
            continue
        if t in ("RECT", "VIRTUAL", "MASK") or (t == "+" and k + 1 < len(words)):
            if t == "+" and words[k + 1] in ("SHAPE", "STYLE", "MASK"):
                k += 3
                continue
            if t == "RECT":  # a patch in parentheses, no point
                while k < len(words) and words[k] != ")":
                    k += 1
            last = None if t == "+" else last  # what follows are properties, not vias
            k += 1 + (t == "MASK")
            continue
        if t == "(":
            p = []
            k += 1
            while k < len(words) and words[k] != ")":
                p.append(words[k])
                k += 1
            k += 1
            if len(p) < 2:
                continue
            x = last[0] if p[0] == "*" and last else _int(p[0])
            y = last[1] if p[1] == "*" and last else _int(p[1])
            if x is None or y is None:
                continue
            if last and (x, y) != last:
                segs.append((layer, width, last[0] / scale, last[1] / scale, x / scale, y / scale, rule))
            last = (x, y)
            continue
        if last is not None and t not in ("+", "USE") and _int(t) is None:
            vias.append((layer, last[0] / scale, last[1] / scale, t))
        other += t != "+"
        k += 1
    return segs, vias, other, {rule}


def parse(text: str) -> dict:
    """One file. Nets are in micrometres, power nets, components and pins in database units; components without a place are left out."""
    w = [t for t in _TOKEN.findall(text) if t[0] != "#"]
    d: dict = {k: [] for k in ("nets", "net_pins", "segs", "via_points", "pnets", "psegs", "comps", "pins", "pin_rects", "via_defs", "rules")}
    d |= {"design": "", "dbu": 1000.0}
    at = 0
    while at < len(w):
        t = w[at]
        nxt = w[at + 1] if at + 1 < len(w) else ""
        if t == "DESIGN" and not d["design"]:
            d["design"], at = nxt, at + 2
        elif t == "UNITS" and nxt == "DISTANCE" and at + 3 < len(w):
            d["dbu"], at = float(_int(w[at + 3]) or 1000), at + 4
        elif t in ("NETS", "SPECIALNETS", "COMPONENTS", "PINS", "VIAS", "NONDEFAULTRULES") and _int(nxt) is not None:
            items, at = _items(w, at + 2, t)
            for s in items:
                _SECTIONS[t](d, s)
        else:
            at += 1
    return d


def _after(s: list[str], key: str, n: int = 1) -> list[str] | None:
    """The n words behind a `+ key`."""
    for k in range(len(s) - 1):
        if s[k] == "+" and s[k + 1] == key:
            return s[k + 2 : k + 2 + n]
    return None


def _net(d: dict, s: list[str]) -> None:
    name, k = s[0], 1
    while k < len(s) and s[k] == "(":
        end = s.index(")", k) if ")" in s[k:] else len(s)
        if end - k >= 3:
            d["net_pins"].append({"net": _plain(name), "inst": "" if s[k + 1] == "PIN" else _plain(s[k + 1]), "pin": _plain(s[k + 2])})
        k = end + 1
    rule = (_after(s, "NONDEFAULTRULE") or [""])[0]
    start = next((j for j in range(k, len(s)) if s[j] in ("ROUTED", "COVER", "FIXED", "NOSHIELD")), None)
    segs, vias, other, _ = _route(s[start:], d["dbu"], False) if start is not None else ([], [], 0, set())
    d["segs"] += [{"net": _plain(name), "layer": a, "x0": b, "y0": c, "x1": e, "y1": f, "rule": r or rule} for a, _, b, c, e, f, r in segs]
    d["via_points"] += [{"net": _plain(name), "layer": a, "x": x, "y": y, "via": v} for a, x, y, v in vias]
    d["nets"].append({"name": _plain(name), "raw_name": name, "rule": rule, "vias": len(vias), "vias_raw": other})


def _special(d: dict, s: list[str]) -> None:
    d["pnets"].append({"net": _plain(s[0]), "use_power": _after(s, "USE") == ["POWER"]})
    start = next((j for j in range(len(s)) if s[j] in ("ROUTED", "COVER", "FIXED")), None)
    if start is not None:
        for a, width, b, c, e, f, _ in _route(s[start:], 1.0, True)[0]:
            d["psegs"].append({"net": _plain(s[0]), "layer": a, "width_dbu": width, "x1": int(b), "y1": int(c), "x2": int(e), "y2": int(f)})


def _place(s: list[str]) -> tuple[int, int, str] | None:
    for k in range(len(s) - 5):
        if s[k] == "+" and s[k + 1] in ("PLACED", "FIXED", "COVER") and s[k + 2] == "(":
            x, y = _int(s[k + 3]), _int(s[k + 4])
            if x is not None and y is not None:
                return x, y, s[k + 6] if k + 6 < len(s) else "N"
    return None


def _comp(d: dict, s: list[str]) -> None:
    at = _place(s)
    if at and len(s) > 1:
        d["comps"].append({"name": _plain(s[0]), "cell": s[1], "x": at[0], "y": at[1], "orient": at[2]})


def _pin(d: dict, s: list[str]) -> None:
    at = _place(s) or (0, 0, "N")
    use = _after(s, "USE") or [""]
    d["pins"].append({"pin": _plain(s[0]), "net": _plain((_after(s, "NET") or [""])[0]), "use_power": use == ["POWER"], "use_ground": use == ["GROUND"], "x": at[0], "y": at[1], "orient": at[2]})
    for k in range(len(s) - 11):
        if s[k] == "+" and s[k + 1] == "LAYER":
            j = s.index("(", k)
            c = [_int(x) for x in (s[j + 1], s[j + 2], s[j + 5], s[j + 6])] if j + 6 < len(s) else [None]
            if None not in c:
                d["pin_rects"].append(dict(zip(("pin", "layer", "x1", "y1", "x2", "y2"), (_plain(s[0]), s[k + 2], *c), strict=True)))


def _via(d: dict, s: list[str]) -> None:
    layers = _after(s, "LAYERS", 3)
    rects = [s[k + 2] for k in range(len(s) - 2) if s[k] == "+" and s[k + 1] == "RECT"]
    if layers and len(layers) == 3:
        size = _after(s, "ROWCOL", 2)
        cuts = (_int(size[0]) or 1) * (_int(size[1]) or 1) if size and len(size) == 2 else 1
        below, cut, above = layers
    else:
        names = list(dict.fromkeys(rects)) + ["", "", ""]
        below, cut, above = names[:3]
        cuts = rects.count(cut)
    d["via_defs"].append({"via": s[0], "cut_layer": cut, "below": below, "above": above, "cuts": cuts})


def _rule(d: dict, s: list[str]) -> None:
    for k in range(len(s) - 4):
        if s[k] == "+" and s[k + 1] == "LAYER" and s[k + 3] == "WIDTH":
            d["rules"].append({"rule": s[0], "layer": s[k + 2], "width_um": (_int(s[k + 4]) or 0) / d["dbu"]})


_SECTIONS = {"NETS": _net, "SPECIALNETS": _special, "COMPONENTS": _comp, "PINS": _pin, "VIAS": _via, "NONDEFAULTRULES": _rule}
