"""Transistor netlists: lines joined, subcircuits and devices read, hierarchies flattened level by level with joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.core import materialise

SUFFIX = {"t": 1e12, "g": 1e9, "meg": 1e6, "k": 1e3, "m": 1e-3, "u": 1e-6, "µ": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15, "a": 1e-18}
_NUM = re.compile(r"([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)(meg|[tgkmuµnpfa])?[a-z]*", re.I)
SCHEMA = "subckts:array<struct<subckt:string,ports:array<string>>>,devices:array<struct<subckt:string,kind:string,name:string,nodes:array<string>,model:string,params:map<string,double>>>,globals:array<string>"
MOST_LEVELS = 100


def spice_number(text: str) -> float | None:
    m = _NUM.fullmatch(text.strip())
    return float(m[1]) * SUFFIX.get((m[2] or "").lower(), 1.0) if m else None


def number(c: Column | str) -> Column:
    """spice_number as an expression."""
    c = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    form = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)(meg|[tgkmuµnpfa])?[a-z]*$"
    scale = F.create_map(*[F.lit(x) for kv in SUFFIX.items() for x in kv])
    return F.when(c.rlike(form), F.regexp_extract(c, form, 1).try_cast("double") * F.coalesce(F.try_element_at(scale, F.regexp_extract(c, form, 2)), F.lit(1.0)))


def device_kind(model: Column | str, n_nodes: Column | str) -> Column:
    """The device that a subcircuit call stands for by its model's name and node count; null if none."""
    m, n = F.lower(F.col(model) if isinstance(model, str) else model), (F.col(n_nodes) if isinstance(n_nodes, str) else n_nodes)
    return F.when((n == 4) & m.rlike("nfet|pfet|mosfet|nmos|pmos"), "M").when((n == 3) & m.rlike("_npn|_pnp|bjt"), "Q").when((n == 2) & F.contains(m, F.lit("diode")), "D")


def parse(text: str) -> dict:
    lines: list[str] = []
    for raw in text.splitlines():
        s = re.split(r"[;$]", raw, maxsplit=1)[0].rstrip() if not raw.startswith("*") else ""
        if s.startswith("+") and lines:
            lines[-1] += " " + s[1:]
        elif s.strip():
            lines.append(s.strip())
    d: dict = {"subckts": [], "devices": [], "globals": []}
    inside, control = "", False
    for line in lines:
        line = re.sub(r"\s*=\s*", "=", line)
        w = line.split()
        k = w[0].lower()
        if k == ".control":
            control = True
        elif k == ".endc":
            control = False
        elif control:
            continue
        elif k == ".subckt" and len(w) > 1:
            inside = w[1].lower()
            d["subckts"].append({"subckt": inside, "ports": [x for x in w[2:] if "=" not in x and x.lower() != "params:"]})
        elif k == ".ends":
            inside = ""
        elif k == ".global":
            d["globals"] += w[1:]
        elif k[0] in "mqrcldx":
            params = {a.lower(): v for a, _, b in (x.partition("=") for x in w if "=" in x) if (v := spice_number(b)) is not None}
            plain = [x for x in w[1:] if "=" not in x]
            kind = k[0].upper()
            nodes, model = plain, ""
            if kind in "RCL":
                nodes, rest = plain[:2], plain[2:]
                for x in rest:
                    v = spice_number(x)
                    if v is not None and "value" not in params:
                        params["value"] = v
                    else:
                        model = model or x.lower()
            elif plain:
                keep = {"M": 4, "D": 2}.get(kind, len(plain) - 1)
                nodes, model = plain[:keep], (plain[keep] if len(plain) > keep else "").lower()
            d["devices"].append({"subckt": inside, "kind": kind, "name": w[0], "nodes": nodes, "model": model, "params": params})
    return d


def flatten(subckts: DataFrame, devices: DataFrame, top: str, globals_: list[str] | None = None) -> DataFrame:
    """Devices of a subcircuit with all calls replaced by what they call: path, kind, name, nodes, model, params.

    One join a level: calls of the frontier meet the subcircuits they name; ports become the caller's nodes, other nodes get the
    path in front, global ones stay. A call of an unknown subcircuit, or with other than its number of ports, stays as it is."""
    known = F.array(*[F.lit(g) for g in ["0", *(globals_ or [])]])
    body = devices.select("subckt", F.struct("kind", "name", "nodes", "model", "params").alias("d"))
    table = subckts.select(F.col("subckt").alias("called"), "ports")
    front = devices.filter(F.col("subckt") == top.lower()).select(F.lit("").alias("path"), "kind", "name", "nodes", "model", "params")
    out = None
    for _ in range(MOST_LEVELS):
        j = front.join(table, (F.lower("model") == F.col("called")) & (F.col("kind") == "X"), "left")
        recognised = F.when(F.col("kind") == "X", device_kind("model", F.size("nodes")))
        opens = (F.col("kind") == "X") & recognised.isNull() & F.col("called").isNotNull() & (F.size("ports") == F.size("nodes"))
        j = materialise(j.withColumn("_opens", opens).withColumn("kind", F.coalesce(recognised, "kind")), "level")
        done = j.filter(~F.col("_opens")).select("path", "kind", "name", "nodes", "model", "params")
        out = done if out is None else out.unionByName(done)
        calls = j.filter("_opens").select(F.concat("path", "name", F.lit("/")).alias("path"), "called", F.map_from_arrays("ports", "nodes").alias("at"))
        if calls.limit(1).count() == 0:
            return out
        inner = calls.join(body, calls["called"] == body["subckt"])
        place = lambda n: F.coalesce(F.try_element_at("at", n), F.when(F.array_contains(known, n), n), F.concat("path", n))
        front = inner.select("path", "d.kind", "d.name", F.transform("d.nodes", place).alias("nodes"), "d.model", "d.params")
    raise ValueError(f"more than {MOST_LEVELS} levels of calls: a subcircuit may call itself")
