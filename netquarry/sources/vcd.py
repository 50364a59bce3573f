"""Waveform text dumps: lines to declarations and value changes, and signals added to a copy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.core import BLANKS, broadcast_if_small, materialise, numbered, salted_join
from netquarry.operators.activity import carried, running

UNITS = {"s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9, "ps": 1e-12, "fs": 1e-15}
DECLS = "src_id long, sym string, type string, width long, name string, path string, timescale_s double"


def timescale(text: str) -> float | None:
    """Seconds of one tick."""
    m = re.fullmatch(r"\s*(\d*\.?\d+)?\s*([munpf]?s)\s*", text.lower())
    return float(m[1] or 1) * UNITS[m[2]] if m else None


def header(lines: list[str]) -> tuple[list[dict], float]:
    """Declarations of a header and the seconds of a tick (1 ns where none is given)."""
    words = " ".join(lines).split()
    scope, out, tick, at = [], [], 1e-9, 0
    while at < len(words):
        w = words[at]
        if not w.startswith("$"):
            at += 1
            continue
        stop = at + 1
        while stop < len(words) and words[stop] != "$end":
            stop += 1
        body = words[at + 1 : stop]
        if w == "$timescale":
            tick = timescale("".join(body)) or tick
        elif w == "$scope":
            scope.append(body[1] if len(body) > 1 else "")
        elif w == "$upscope" and scope:
            scope.pop()
        elif w == "$var" and len(body) >= 4 and body[1].isdigit():
            name = body[3]
            select = "".join(body[4:])
            width = int(body[1])
            one = re.fullmatch(r"\[(\d+)\]", select)
            if one and width == 1:
                name += select
            out.append({"sym": body[2], "type": body[0], "width": width, "name": name, "path": ".".join([*(s for s in scope if s), name])})
        elif w == "$enddefinitions":
            break
        at = stop + 1
    return out, tick


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """src_id, seq, line of text files; seq (start of the split, line) is the order within a file of any size, whichever tasks read its
    parts."""
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_i"))
    # rows of a split keep their order in the id
    return t.select(F.xxhash64("_f").alias("src_id"), F.struct(F.col("_s").alias("start"), F.col("_i").alias("line")).alias("seq"), F.col("value").alias("line"))


LEVELS = "01xXzZuUwWlLhH-"
_SIMPLE = rf"^\s*(?:#\S+|[{LEVELS}]\S+|[bBrRsS]\S*\s+\S+)\s*$"
_SECTION = r"^\s*\$(?:dumpvars|dumpall|dumpon|dumpoff|end)\s*$|^\s*$"


def _read_words(line: str, comment: bool, pending: str | None) -> list[str]:
    """The time marks and changes of a line's words, each as it would stand alone in a line; `comment`: the line begins inside a comment,
    `pending`: a value that the line before left without its symbol."""
    out = []
    for w in line.split():
        if comment:
            comment = w != "$end"
        elif pending is not None:
            out.append(f"{pending} {w}")
            pending = None
        elif w == "$comment":
            comment = True
        elif w[0] in "bBrRsS":
            pending = w
        elif w[0] == "#" or w[0] in LEVELS and len(w) > 1:
            out.append(w)
    return out


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, places, words = [], [], []
        for k, (line, comment, pending) in enumerate(zip(b.column("line").to_pylist(), b.column("comment").to_pylist(), b.column("pending").to_pylist(), strict=True)):
            found = _read_words(line, comment, pending)
            rows += [k] * len(found)
            places += range(len(found))
            words += found
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("src_id").take(take), b.column("start").take(take), b.column("row").take(take), pa.array(places, pa.int32()), pa.array(words, pa.string())], names=["src_id", "start", "row", "word", "t"])


def _split_lines(body: DataFrame) -> DataFrame:
    """body (src_id, at, line, simple) of files with comments, or with lines that hold more or less than one change -> src_id, at, t.

    What a line begins with (inside a comment, or with the symbol of a value that the line before ends in) is carried over lines: words
    that may be values pair off from the last word that is none, so only their number since then matters."""
    key, words = ["src_id"], F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    body = body.filter(F.trim("line", F.lit(BLANKS)) != "").withColumn("_mark", F.when(F.contains("line", F.lit("$comment")) | F.contains("line", F.lit("$end")), F.try_element_at(F.filter(words, lambda w: w.isin("$comment", "$end")), F.lit(-1))))
    body = carried(body, key, "at", F.col("_mark"), "was")
    body = body.withColumn("comment", F.coalesce(F.col("was") == "$comment", F.lit(False)))
    body = materialise(body.filter(~F.col("comment") | F.col("_mark").isNotNull()), "lines")  # lines wholly inside a comment say nothing
    # words after the last keyword or other word that is no value
    last = F.size(words) - F.coalesce(F.array_max(F.transform(words, lambda w, i: F.when(~w.rlike("^[bBrRsS]"), i + 1))), F.lit(0))
    body = body.withColumn("_k", F.when(F.coalesce(F.col("_mark") == "$comment", F.lit(False)), F.lit(0)).otherwise(last)).withColumn("_all", F.col("_k") == F.size(words))
    body = running(body, key, "at", (F.col("_all") & (F.col("_k") % 2 == 1)).cast("long"), "_odd")
    # the count at the last line with another word, made odd if that line itself left a value over
    body = carried(body, key, "at", F.when(~F.col("_all"), F.col("_odd") + F.col("_k") % 2), "_base")
    body = carried(body, key, "at", F.element_at(words, -1), "_tail")
    before = F.col("_odd") - (F.col("_all") & (F.col("_k") % 2 == 1)).cast("long")
    body = body.withColumn("pending", F.when((before - F.coalesce("_base", F.lit(0))) % 2 != 0, F.col("_tail")))
    plain = F.col("simple") & ~F.col("comment") & F.col("pending").isNull()
    body = materialise(body.select("src_id", "at", "line", "comment", "pending", plain.alias("plain")), "states")
    odd = body.filter("not plain").select("src_id", F.col("at.start").alias("start"), F.col("at.row").alias("row"), "line", "comment", "pending")
    odd = odd.mapInArrow(_words, "src_id long, start long, row long, word int, t string").select("src_id", F.struct("start", "row", "word").alias("at"), "t")
    return body.filter("plain").select("src_id", "at", F.trim("line", F.lit(BLANKS)).alias("t")).unionByName(odd)


def scan(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines (src_id, seq, line) -> declarations, and changes (src_id, seq, tick, sym, kind, value).

    Lines of one time mark or change are read JVM-side. The lines of the headers go to Python file by file, and so do body lines of any
    other shape: several changes in a line, a value and its symbol in two, comments, dump commands before changes."""
    end = lines.filter(F.contains("line", F.lit("$enddefinitions"))).groupBy("src_id").agg(F.min("seq").alias("_end"))
    side, small = broadcast_if_small(end)
    body = lines.join(side, "src_id", "left") if small else salted_join(lines, end, ["src_id"], "left", by=F.col("seq"))

    def decl(pdf: pd.DataFrame) -> pd.DataFrame:
        out, tick = header(pdf.sort_values(["_a", "_b"])["line"].tolist())
        df = pd.DataFrame(out, columns=["sym", "type", "width", "name", "path"])
        df["src_id"], df["timescale_s"] = pdf["src_id"].iloc[0], tick
        return df[["src_id", "sym", "type", "width", "name", "path", "timescale_s"]]

    parts = hasattr(lines.schema["seq"].dataType, "fields")
    start, row = (F.col("seq.start"), F.col("seq.line")) if parts else (F.floor(F.col("seq") / (1 << 16)), F.col("seq"))
    heads = body.filter(F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
    decls = heads.select("src_id", start.alias("_a"), row.alias("_b"), "line").groupBy("src_id").applyInPandas(decl, DECLS)
    at = F.struct(start.cast("long").alias("start"), row.cast("long").alias("row"), F.lit(0).alias("word")).alias("at")
    rest = F.when(F.col("seq") == F.col("_end"), F.regexp_extract("line", r"\$enddefinitions(.*)$", 1)).otherwise(F.col("line"))
    b = body.filter(F.col("seq") >= F.col("_end")).select("src_id", at, rest.alias("line"))
    b = b.withColumn("simple", F.col("line").rlike(_SIMPLE))
    free = b.filter(~F.col("simple") & ~F.col("line").rlike(_SECTION)).limit(1).count()  # else no line carries a state into another
    t = _split_lines(b) if free else b.filter("simple").select("src_id", "at", F.trim("line", F.lit(BLANKS)).alias("t"))
    # read several times below, so the words are written once
    t = materialise(t.withColumn("_now", F.when(F.startswith("t", F.lit("#")), F.substring("t", 2, 40).try_cast("double"))), "words")
    t = carried(t, ["src_id"], "at", F.when(F.abs("_now") < float("inf"), F.col("_now")), "tick")
    first = F.lower(F.substring("t", 1, 1))
    kind = F.when(first == "b", "vector").when(first == "r", "real").when(first == "s", "string").otherwise("scalar")
    c = t.filter("not startswith(t, '#')").withColumn("kind", kind)
    scalar = F.col("kind") == "scalar"
    value = F.when(scalar, F.substring("t", 1, 1)).otherwise(F.regexp_extract("t", r"^.(\S*)\s", 1))
    sym = F.when(scalar, F.expr("substring(t, 2)")).otherwise(F.regexp_extract("t", r"\s(\S+)$", 1))
    return decls, c.select("src_id", F.col("at").alias("seq"), F.coalesce("tick", F.lit(0.0)).alias("tick"), sym.alias("sym"), "kind", value.alias("value"))


def annotate(lines: DataFrame, scope: str, series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A copy of each dump with the points of series (name, t_s, value; one set for all dumps) as real signals in a new scope: lines
    (src_id, at, line), to be written in the order of `at`, and per src_id declared, records, injected and tick_s.

    Points come at the tick nearest to their time: inside the block of initial values or behind the time mark of that tick, else at a time
    mark of their own before the next one. Points behind the last time mark are not written. Names are few; their codes are one character
    longer than any of the dump's. Nothing is read into the driver."""
    parts = hasattr(lines.schema["seq"].dataType, "fields")
    start, row = (F.col("seq.start"), F.col("seq.line")) if parts else (F.floor(F.col("seq") / (1 << 16)), F.col("seq"))
    t = lines.select("src_id", "seq", start.cast("long").alias("start"), row.cast("long").alias("row"), "line")
    end = t.filter(F.contains("line", F.lit("$enddefinitions"))).groupBy("src_id").agg(F.min("seq").alias("_end"))
    t = materialise(t.join(end, "src_id"), "lines")
    decls, _ = scan(lines)
    heads = decls.groupBy("src_id").agg(F.max(F.length("sym")).alias("longest"), F.max("timescale_s").alias("tick_s"))
    heads = materialise(end.select("src_id").join(heads, "src_id", "left").select("src_id", F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce("tick_s", F.lit(1e-9)).alias("tick_s")), "heads")
    names = series.groupBy("name").agg(F.count("*").alias("_n"))
    names = numbered(names, ["name"], "no").drop("_n")
    code = F.concat(F.repeat(F.lit("~"), F.col("longest").cast("int")), F.lit("!"), F.lower(F.hex("no")))
    signals = names.crossJoin(F.broadcast(heads))  # few names, a row a dump
    signals = signals.select("src_id", "name", "no", code.alias("code"), "tick_s")
    points = series.join(signals, "name").select("src_id", "no", "code", F.col("t_s"), "value", F.floor(F.col("t_s") / F.col("tick_s") + 0.5).cast("double").alias("tick"))
    body = t.filter(F.col("seq") > F.col("_end"))
    word = F.regexp_extract("line", r"^\s*(\S*)", 1)
    marks = body.filter(F.startswith(word, F.lit("#"))).select("src_id", "start", "row", F.substring(word, 2, 40).try_cast("double").alias("tick"), F.lit(False).alias("initial")).filter("tick is not null")
    opened = body.filter(word.isin("$dumpvars", "$end", "$dumpall", "$dumpon", "$dumpoff", "$comment")).select("src_id", F.struct("start", "row").alias("seq"), word.alias("w"))
    opened = carried(opened, ["src_id"], "seq", F.col("w"), "before").filter("w = '$end' and before = '$dumpvars'")
    marks = marks.unionByName(opened.select("src_id", "seq.start", "seq.row", F.lit(0.0).alias("tick"), F.lit(True).alias("initial")))
    # the first mark at or behind each point: both in one falling order of ticks, cut into blocks by value
    span = marks.agg(F.max("tick").alias("hi")).first()["hi"] or 0.0
    cut = max(1.0, span / 256)
    both = points.select("src_id", "tick", "no", "code", "t_s", "value", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("boolean").alias("initial"))
    both = both.unionByName(marks.select("src_id", "tick", F.lit(None).cast("long").alias("no"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("double").alias("t_s"), F.lit(None).cast("double").alias("value"), "start", "row", "initial"))
    falling = F.struct((-F.floor(F.col("tick") / cut)).cast("long").alias("block"), (-F.col("tick")).alias("tick"), F.col("code").isNotNull().alias("is_point"), (-F.coalesce("start", F.lit(0))).alias("start"), (-F.coalesce("row", F.lit(0))).alias("row"))
    both = carried(both.withColumn("order", falling), ["src_id"], "order", F.when(F.col("code").isNull(), F.struct("tick", "start", "row", "initial")), "mark")
    placed = materialise(both.filter("code is not null and mark is not null"), "placed")
    # where a line goes: at its own place 0, before it -1, behind it 1; then by tick, time mark first, then by signal
    spot = lambda side, tick, mark, no, t_s: F.struct(F.col("mark.start").alias("start"), F.col("mark.row").alias("row"), side.alias("side"), tick.alias("tick"), mark.alias("kind"), no.alias("no"), t_s.alias("t"))
    exact = F.col("tick") == F.col("mark.tick")
    side = F.when(exact & ~F.col("mark.initial"), F.lit(1)).otherwise(F.lit(-1))
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.6e", "value"), r"e\+0*(\d)", "e$1"), r"e-0*(\d)", "e-$1")
    zero = F.lit(0).cast("long")
    records = placed.select("src_id", spot(side, F.col("tick"), F.lit(1), F.col("no"), F.col("t_s")).alias("at"), F.concat(F.lit("r"), text, F.lit(" "), F.col("code")).alias("line"))
    own = placed.filter(~exact).select("src_id", spot(F.lit(-1), F.col("tick"), F.lit(0), zero, F.lit(0.0)).alias("at"), F.concat(F.lit("#"), F.col("tick").cast("long").cast("string")).alias("line")).distinct()
    still = lambda d, line, kind, no: d.select("src_id", F.struct("start", "row", F.lit(0 if kind is None else -1).alias("side"), F.lit(0.0).alias("tick"), F.lit(kind or 0).alias("kind"), no.alias("no"), F.lit(0.0).alias("t")).alias("at"), line.alias("line"))
    plain = still(t, F.col("line"), None, zero)
    last = t.filter(F.col("seq") == F.col("_end")).select("src_id", "start", "row")
    around = still(last, F.lit(f"$scope module {scope} $end"), -1, zero).unionByName(still(last, F.lit("$upscope $end"), 2, zero))
    declared = still(last.join(signals, "src_id"), F.concat(F.lit("$var real 64 "), "code", F.lit(" "), "name", F.lit(" $end")), 1, F.col("no"))
    out = plain.unionByName(around).unionByName(declared).unionByName(own).unionByName(records)
    stats = heads.join(signals.groupBy("src_id").agg(F.count("*").alias("declared")), "src_id", "left").join(placed.groupBy("src_id").agg(F.count("*").alias("records")), "src_id", "left").join(own.groupBy("src_id").agg(F.count("*").alias("injected")), "src_id", "left")
    return out, stats.select("src_id", *[F.coalesce(c, zero).alias(c) for c in ("declared", "records", "injected")], "tick_s")
