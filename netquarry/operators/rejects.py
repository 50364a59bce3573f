"""Rows that fail to parse: the loadable lines and the others with the reason.

A tokenizer (Arrow batches) finds what concerns a whole line: quotes and brackets that do not pair, an unknown command, a wrong
number of columns. It names, for a line whose structure holds, the fields that must have a certain type. Each distinct value of
such a column is then cast once; the values that cannot be cast form a dictionary with reasons, and lines with such a value are
found by joining the dictionary back.

Defined results: null text is a blank line (loadable); null or unknown fmt or block: the reason is 'command'; a repeated row gives
its reason once per distinct line; texts may have any length; extra columns are kept by `split` and never clash with its own,
which start with an underscore until the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.core import materialise, salted_join

NUMBER = r"\+?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
# The SDC commands with their number of words and the place and kind of the value word.
COMMANDS = {
    "create_clock": (6, 4, "positive"),
    "set_input_delay": (5, 1, "number"),
    "set_output_delay": (5, 1, "number"),
    "set_load": (3, 1, "number"),
    "set_clock_uncertainty": (3, 1, "number"),
    "set_false_path": (5, None, None),
    "set_multicycle_path": (6, 1, "count"),
}
#: The kinds of typed columns and the pattern that each value must fit; `positive` and `count` must also be above 0.
KINDS = {
    "number": NUMBER,
    "triplet": rf"{NUMBER}(:{NUMBER}:{NUMBER})?",
    "positive": NUMBER,
    "count": r"[0-9]+",
    "digits": r"[0-9]+",
    "index": r"\*[0-9]+",
    "direction": r"[IOBiob]",
    "string": r'"[^"]*"',
}

_SPEF_PART = re.compile(r'"[^"]*"|"|//|[^\s"/]+|/|\s+')
_SPEF_WORD = re.compile(r'"[^"]*"|[^\s"]+')


def spef_words(line: str) -> list[str] | None:
    """The words of a SPEF line without its comment; None if its quotes are broken."""
    end = len(line)
    if '"' not in line:
        at = line.find("//")
        return (line if at < 0 else line[:at]).split()
    for m in _SPEF_PART.finditer(line):
        if m.group() == '"':
            return None
        if m.group() == "//":
            end = m.start()
            break
    words, last = [], -1
    for m in _SPEF_WORD.finditer(line, 0, end):
        if m.start() == last and (m.group()[0] == '"' or words[-1][0] == '"'):
            return None
        words.append(m.group())
        last = m.end()
    return words


def sdc_words(line: str) -> list[str] | None:
    """The words of an SDC command, a group being one word; None if quotes, brackets or braces are broken."""
    words, word, stack, quoted, i, n = [], [], [], False, 0, len(line)
    while i < n:
        c = line[i]
        if c == "\\":
            word.append(line[i : i + 2])
            i += 2
            continue
        if quoted:
            quoted = c != '"'
            word.append(c)
        elif c == '"':
            quoted = True
            word.append(c)
        elif c in "[{":
            stack.append("]" if c == "[" else "}")
            word.append(c)
        elif c in "]}":
            if not stack or stack.pop() != c:
                return None
            word.append(c)
        elif stack:
            word.append(c)
        elif c == ";":
            break
        elif c.isspace():
            if word:
                words.append("".join(word))
                word = []
        else:
            word.append(c)
        i += 1
    if quoted or stack:
        return None
    if word:
        words.append("".join(word))
    return words


def inspect(fmt: str | None, block: str | None, text: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """The structural reason, if any, and the (kind, value) pairs to be cast."""
    text = text or ""
    if fmt == "spef":
        w = spef_words(text)
        if w is None:
            return "quoting", []
        if not w:
            return None, []
        if block == "HEAD":
            return (None, [("string", w[1])]) if len(w) == 2 and w[0].startswith("*") else ("columns", [])
        if block == "MAP":
            return (None, [("index", w[0])]) if len(w) == 2 else ("columns", [])
        if block == "CONN":
            key = w[0].upper()
            if key == "*I":
                return (None, [("direction", w[2]), ("triplet", w[4])]) if len(w) == 5 and w[3].upper() == "*L" else ("columns", [])
            return (None, [("direction", w[2])]) if key == "*P" and len(w) == 3 else ("columns", [])
        if block == "CAP":
            return (None, [("digits", w[0]), ("triplet", w[-1])]) if len(w) in (3, 4) else ("columns", [])
        if block == "RES":
            return (None, [("digits", w[0]), ("triplet", w[3])]) if len(w) == 4 else ("columns", [])
        return "command", []
    if fmt == "sdc":
        if text.lstrip().startswith("#"):
            return None, []
        w = sdc_words(text)
        if w is None:
            return "quoting", []
        if not w:
            return None, []
        if w[0] not in COMMANDS:
            return "command", []
        n, at, kind = COMMANDS[w[0]]
        if len(w) != n:
            return "columns", []
        return None, [] if at is None else [(kind, w[at])]
    return "command", []


def _scan(ids: list[str]):
    typed = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [inspect(*x) for x in zip(b.column("_fmt").to_pylist(), b.column("_block").to_pylist(), b.column("_text").to_pylist(), strict=True)]
            cols = [b.column(c) for c in ids]
            cols.append(pa.array([x[0] for x in found], pa.string()))
            cols.append(pa.array([[{"kind": k, "value": v} for k, v in x[1]] for x in found], typed))
            yield pa.RecordBatch.from_arrays(cols, names=[*ids, "_structure", "_typed"])

    return run


def dictionary(values: DataFrame) -> DataFrame:
    """Of the rows (kind, value), each distinct value that cannot be cast, with the reason."""
    distinct = values.select("kind", "value").distinct()
    ok = F.lit(False)
    for kind, pattern in KINDS.items():
        fits = F.col("value").rlike(f"^(?:{pattern})$") & ~F.col("value").contains("\n")
        if kind in ("positive", "count"):
            # above 0: a digit other than 0 before the exponent
            fits = fits & F.regexp_replace("value", "[eE].*$", "").rlike("[1-9]")
        ok = ok | ((F.col("kind") == kind) & fits)
    return distinct.filter(~F.coalesce(ok, F.lit(False))).select("kind", "value", F.lit("value").alias("why"))


def reasons(lines: DataFrame, id_col: str = "line_id", fmt: str = "fmt", block: str = "line_block", text: str = "raw_text") -> DataFrame:
    """(id_col, reason) of each line that is not loadable."""
    given = lines.select(id_col, F.lower(F.col(fmt)).alias("_fmt"), F.upper(F.col(block)).alias("_block"), F.col(text).alias("_text")).distinct()
    kind = dict(given.dtypes)[id_col]
    parsed = given.mapInArrow(_scan([id_col]), f"`{id_col}` {kind}, _structure string, _typed array<struct<kind:string,value:string>>")
    parsed = materialise(parsed, "lines")
    structural = parsed.filter(F.col("_structure").isNotNull()).select(id_col, F.col("_structure").alias("reason"))
    values = parsed.filter(F.col("_structure").isNull()).select(id_col, F.inline("_typed"))
    bad = salted_join(values, dictionary(values), ["kind", "value"], by=F.col(id_col)).select(id_col, F.col("why").alias("reason")).distinct()
    return structural.unionByName(bad)


def split(lines: DataFrame, id_col: str = "line_id", fmt: str = "fmt", block: str = "line_block", text: str = "raw_text") -> tuple[DataFrame, DataFrame]:
    """The loadable lines, and the others with _reason. A line without an id is known by its content."""
    content = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in (fmt, block, text)]).cast("string")
    keyed = lines.withColumn("_line", F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.concat(F.lit("t"), content, F.coalesce(F.length(text).cast("string"), F.lit("")))))
    why = reasons(keyed, "_line", fmt, block, text).withColumnRenamed("reason", "_reason")
    return keyed.join(why, "_line", "left_anti").drop("_line"), keyed.join(why, "_line").drop("_line")
