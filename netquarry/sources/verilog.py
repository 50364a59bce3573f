"""Structural Verilog: modules, ports, instances with their connections, aliases."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\\(\S+)|//[^\n]*|/\*.*?(?:\*/|\Z)|([()\[\];,.={}#])|([^\s()\[\];,.={}#\\]+)", re.S)
_RANGE = re.compile(r"\s*(-?\d+)\s*:\s*(-?\d+)\s*")
BEHAVIOUR = {"always", "always_ff", "always_comb", "always_latch", "initial", "function", "task", "generate"}
DECLARED = {"input", "output", "inout", "wire", "reg", "logic", "parameter", "localparam", "supply0", "supply1"}
SCHEMA = (
    "top:string,modules:array<string>,behavioural:bigint,positional:bigint,ports:array<struct<dir:string,name:string>>,insts:array<struct<cell:string,name:string>>,"
    "conns:array<struct<inst:bigint,pin:string,net:string>>,aliases:array<struct<lhs:string,rhs:string>>"
)


def words(text: str) -> list[str]:
    """Tokens without comments; an escaped name is one token and loses its backslash."""
    return [a or b or c for a, b, c in _TOKEN.findall(text) if a or b or c]


def _name(w: str) -> bool:
    return w[0].isalpha() or w[0] == "_"


def bus(base: str, hi: int, lo: int) -> list[str]:
    return [f"{base}[{k}]" for k in range(max(hi, lo), min(hi, lo) - 1, -1)]


class _Module:
    def __init__(self, w: list[str]):
        self.w, self.at = w, 0
        self.name, self.ports, self.insts, self.conns, self.aliases = "", [], [], [], []
        self.range: dict[str, tuple[int, int]] = {}
        self.behavioural = self.positional = 0

    def peek(self, k: int = 0) -> str:
        return self.w[self.at + k] if self.at + k < len(self.w) else ""

    def next(self) -> str:
        self.at += 1
        return self.peek(-1)

    def skip_to(self, stop: str) -> None:
        while self.at < len(self.w) and self.next() != stop:
            pass

    def select(self) -> str:
        """What stands in the brackets that open here."""
        self.next()
        inner = []
        while self.peek() not in ("]", ""):
            inner.append(self.next())
        self.next()
        return "".join(inner)

    def group(self) -> list[str]:
        """The tokens of the parentheses that open here."""
        w, start, depth = self.w, self.at + 1, 1
        for k in range(start, len(w)):
            t = w[k]
            if t == ")":
                depth -= 1
                if not depth:
                    self.at = k + 1
                    return w[start:k]
            elif t == "(":
                depth += 1
        self.at = len(w)
        return w[start:]

    def declare(self, kind: str, names: list[str], span: tuple[int, int] | None) -> None:
        for n in names:
            if span:
                self.range[n] = span
            if kind in ("input", "output"):
                self.ports += [(kind, b) for b in (bus(n, *span) if span else [n])]

    def header(self) -> None:
        self.name = self.next()
        if self.peek() == "#":
            self.next()
            self.group()
        if self.peek() == "(":
            sub, kind, span = _Module(self.group()), "", None
            while sub.peek():
                if sub.peek() in ("input", "output", "inout"):
                    kind, span = sub.next(), None
                elif sub.peek() == "[":
                    m = _RANGE.fullmatch(sub.select())
                    span = (int(m[1]), int(m[2])) if m else None
                elif kind and _name(sub.peek()) and sub.peek() not in DECLARED | {"signed"}:
                    self.declare(kind, [sub.next()], span)
                else:
                    sub.next()
        if self.peek() == ";":
            self.next()

    def declaration(self, kind: str) -> None:
        span = None
        while self.peek() not in (";", ""):
            if self.peek() == "[":
                m = _RANGE.fullmatch(self.select())
                span = (int(m[1]), int(m[2])) if m else None
            elif self.peek() == "=":
                while self.peek() not in (",", ";", ""):
                    self.next()
            else:
                t = self.next()
                if _name(t) and t not in DECLARED | {"signed"}:
                    self.declare(kind, [t], span)
        self.next()

    def bits(self, expr: list[str]) -> list[str]:
        """The nets of a connection, most significant first. Replications are not expanded: their braces are taken off."""
        if len(expr) == 1:  # most connections
            t = expr[0]
            span = self.range.get(t)
            return [] if t in "{}," else bus(t, *span) if span and span[0] != span[1] else [t]
        sub, out = _Module(expr), []
        while sub.peek():
            t = sub.next()
            if t in "{},":
                continue
            if sub.peek() == "[":
                inner = sub.select()
                m = _RANGE.fullmatch(inner)
                out += bus(t, int(m[1]), int(m[2])) if m else [f"{t}[{inner}]"]
            elif t in self.range and self.range[t][0] != self.range[t][1]:
                out += bus(t, *self.range[t])
            else:
                out.append(t)
        return out

    def instance(self, cell: str) -> None:
        if self.peek() == "#":
            self.next()
            if self.peek() == "(":
                self.group()
            else:
                self.next()
        if not (self.peek() and (_name(self.peek()) or self.peek()[0].isdigit() is False) and self.peek(1) == "("):
            return
        name, no = self.next(), len(self.insts)
        self.insts.append((cell, name))
        args = _Module(self.group())
        if "." in args.w:
            while args.peek():
                if args.next() != "." or args.peek(1) != "(":
                    continue
                pin = args.next()
                nets = self.bits(args.group())
                for k, net in enumerate(nets):
                    if "'" not in net:
                        self.conns.append((no, pin if len(nets) == 1 else f"{pin}[{len(nets) - 1 - k}]", net))
        else:
            part: list[str] = []
            depth = 0
            for t in [*args.w, ","]:
                depth += (t == "{") - (t == "}")
                if t == "," and not depth:
                    # positional connections keep a bus as it is written
                    held, self.range = self.range, {}
                    for net in self.bits(part):
                        if "'" not in net and _name(net):
                            self.conns.append((no, "", net))
                            self.positional += 1
                    self.range, part = held, []
                else:
                    part.append(t)

    def body(self) -> None:
        while self.at < len(self.w):
            t = self.next()
            if t in DECLARED:
                self.declaration(t)
            elif t == "assign":
                side: list[list[str]] = [[], []]
                k = 0
                while self.peek() not in (";", ""):
                    x = self.next()
                    if x == "=":
                        k = 1
                    else:
                        side[k].append(x)
                held, self.range = self.range, {}
                a, b = (self.bits(s) for s in side)
                self.range = held
                if a and b:
                    self.aliases.append((a[0], b[0]))
            elif t in BEHAVIOUR:
                self.behavioural += 1
            elif _name(t) and (self.peek(1) == "(" or self.peek() == "#"):
                self.instance(t)

    def canonical(self) -> None:
        """A one-bit vector's bit is the vector; of two aliases a port's name wins, between inner nets the right one."""
        ports = {n for _, n in self.ports}
        other: dict[str, str] = {}
        for a, b in self.aliases:
            if a in ports and b in ports:
                continue
            if a in ports:
                other[b] = a
            else:
                other[a] = b
        for k, (i, pin, net) in enumerate(self.conns):
            if net in other:
                net = other[net]
            else:
                m = re.fullmatch(r"(.+)\[(-?\d+)\]", net)
                if m and self.range.get(m[1]) == (int(m[2]), int(m[2])) and net not in ports:
                    net = m[1]
            self.conns[k] = (i, pin, net)


def modules(text: str) -> list[_Module]:
    w, out, at = words(text), [], 0
    while at < len(w):
        if w[at] != "module":
            try:
                at = w.index("module", at)
            except ValueError:
                break
            continue
        try:
            end = w.index("endmodule", at + 1)
        except ValueError:
            end = len(w)
        m = _Module(w[at + 1 : end])
        m.header()
        m.body()
        m.canonical()
        out.append(m)
        at = end + 1
    return out


def parse(text: str) -> dict:
    """The records of a file's top module: the first that none instantiates, else the last."""
    ms = modules(text)
    if not ms:
        raise ValueError("no module")
    used = {c for m in ms for c, _ in m.insts}
    m = next((x for x in ms if x.name not in used), ms[-1])
    return {
        "top": m.name, "modules": [x.name for x in ms], "behavioural": m.behavioural, "positional": m.positional, "ports": [{"dir": d, "name": n} for d, n in m.ports], "insts": [{"cell": c, "name": n} for c, n in m.insts],
        "conns": [{"inst": i, "pin": p, "net": n} for i, p, n in m.conns], "aliases": [{"lhs": a, "rhs": b} for a, b in m.aliases],
    }
