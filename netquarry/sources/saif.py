"""Cumulative activity files: s-expressions of instances and nets with their counts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.sources.vcd import timescale

_TOKEN = re.compile(r'"[^"]*"|[()]|[^\s()"]+')


def tree(text: str) -> list:
    """Nested lists of a file; parentheses that do not pair are an error."""
    stack: list[list] = [[]]
    text = re.sub(r"/\*.*?\*/", " ", text, flags=re.S)
    for t in _TOKEN.findall(text):
        if t == "(":
            stack.append([])
        elif t == ")":
            if len(stack) == 1:
                raise ValueError("a parenthesis too many")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(t.strip('"'))
    if len(stack) > 1:
        raise ValueError("a parenthesis is not closed")
    return stack[0]


def parse(text: str) -> tuple[list[tuple], float, float]:
    """(path, tc, t0 + t1, tx) of each net, the duration in ticks and the seconds of a tick."""
    rows: list[tuple] = []
    span, tick, longest = 0.0, 1e-9, 0.0

    def number(x) -> float:
        try:
            return float(x)
        except (TypeError, ValueError):
            return 0.0

    work: list[tuple[list, tuple[str, ...]]] = [(tree(text), ())]
    while work:
        node, at = work.pop()
        kids = [x for x in node if isinstance(x, list)]
        if node and node[0] == "INSTANCE":
            label = [x for x in node[1:] if isinstance(x, str)]
            if not label:
                raise ValueError("an instance without a name")
            at = (*at, re.sub(r"\\(.)", r"\1", label[-1]))
        elif node and node[0] == "DURATION":
            span = number(node[1] if len(node) > 1 else 0)
        elif node and node[0] == "TIMESCALE":
            tick = timescale("".join(map(str, node[1:]))) or tick
        elif node and node[0] == "NET":
            for net in kids:
                got = {x[0]: number(x[1]) for x in net if isinstance(x, list) and len(x) > 1}
                known, x = got.get("T0", 0.0) + got.get("T1", 0.0), got.get("TX", 0.0)
                longest = max(longest, known + x)
                rows.append((".".join([*at, re.sub(r"\\(.)", r"\1", str(net[0]))]), got.get("TC", 0.0), known, x))
            continue
        work += [(k, at) for k in reversed(kids)]
    return rows, span if span > 0 else longest, tick


def scan(files: DataFrame) -> DataFrame:
    """files (src_id, text), one row a file -> src_id, path, tc, t_known, t_x, seconds and rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for src, text in zip(b.column("src_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                rows, span, tick = parse(text or "")
                out += [(src, *r, span * tick) for r in rows]
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.string(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["src_id", "path", "tc", "t_known", "t_x", "seconds"])

    got = files.select(F.col("src_id").cast("long").alias("src_id"), "text").mapInArrow(run, "src_id long, path string, tc double, t_known double, t_x double, seconds double")
    return got.withColumn("rate", F.coalesce(F.try_divide(F.col("tc"), F.nullif(F.col("seconds"), F.lit(0.0))), F.lit(0.0)))
