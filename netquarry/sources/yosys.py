"""Netlists written as JSON by synthesis: bits become nets through one dictionary, JVM-side."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = "array<string>"
NET = r"^([2-9]|[0-9]{2,})$"  # numbers below 2 are the constants
MODULE = f"struct<attributes:map<string,string>,ports:map<string,struct<direction:string,bits:{BITS}>>,cells:map<string,struct<type:string,connections:map<string,{BITS}>>>,netnames:map<string,struct<bits:{BITS}>>>"


def _plain(c: str):
    return F.regexp_replace(F.col(c), r"^\\", "")


def _bits(d: DataFrame, name: str) -> DataFrame:
    """One row a bit: the name itself where there is one bit, else name[i]."""
    p = d.select("*", F.posexplode("bits").alias("_i", "bit"))
    return p.withColumn("label", F.when(F.size("bits") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("["), F.col("_i").cast("string"), F.lit("]"))))


def scan(files: DataFrame) -> dict[str, DataFrame]:
    """files (src_id, text) -> modules, ports, insts and conns of each file's top: marked as such, or the only module.

    A bit with a port's name takes it, else the first net name, else $n and its number; constants are no nets."""
    m = files.select("src_id", F.from_json("text", f"struct<modules:map<string,{MODULE}>>").alias("j"))
    m = m.select("src_id", F.posexplode("j.modules").alias("ord", "module", "m"))
    top = F.coalesce(F.try_element_at("m.attributes", F.lit("top")), F.lit("0")).rlike("[1-9]")
    m = m.withColumn("_top", top)
    pick = m.groupBy("src_id").agg(F.min_by("ord", F.when(F.col("_top"), F.col("ord"))).alias("_t"), F.count("*").alias("_n"), F.min("ord").alias("_o"))
    t = m.join(pick, "src_id").filter(F.col("ord") == F.coalesce("_t", F.when(F.col("_n") == 1, F.col("_o"))))
    ports = t.select("src_id", F.posexplode("m.ports").alias("ord", "port", "p")).select("src_id", "ord", _plain("port").alias("port"), "p.direction", "p.bits")
    port_bits = _bits(ports, "port")
    names = _bits(t.select("src_id", F.posexplode("m.netnames").alias("ord", "net", "n")).select("src_id", "ord", _plain("net").alias("net"), "n.bits"), "net")
    by = port_bits.select("src_id", "bit", F.struct(F.lit(0).alias("k"), "ord").alias("o"), "label").unionByName(names.select("src_id", "bit", F.struct(F.lit(1).alias("k"), "ord").alias("o"), "label"))
    label = by.filter(F.col("bit").rlike(NET)).groupBy("src_id", "bit").agg(F.min_by("label", "o").alias("net"))
    cells = t.select("src_id", F.posexplode("m.cells").alias("ord", "inst", "c")).select("src_id", "ord", _plain("inst").alias("inst"), F.regexp_replace("c.type", r"^\\", "").alias("cell"), "c.connections")
    conns = _bits(cells.select("src_id", "ord", "inst", F.explode("connections").alias("pin", "bits")), "pin").filter(F.col("bit").rlike(NET))
    conns = conns.join(label, ["src_id", "bit"], "left").select("src_id", "inst", F.col("label").alias("pin"), F.coalesce("net", F.concat(F.lit("$n"), "bit")).alias("net"))
    return {"module": t.select("src_id", "module"), "port": port_bits.select("src_id", F.col("label").alias("port"), "direction"), "inst": cells.select("src_id", "ord", "inst", "cell"), "conn": conns}


def errors(files: DataFrame) -> DataFrame:
    """src_id, line, column and message of the files whose text is no JSON; scan() gives nothing for them.

    Only texts that the JVM's reader refuses go to Python, which tells the place."""
    bad = files.filter(F.col("text").isNotNull() & F.try_parse_json("text").isNull()).select("src_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for src, text in zip(b.column("src_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                try:
                    json.loads(text)
                    rows.append((src, 0, 0, "numbers or names beyond what is read"))
                except json.JSONDecodeError as e:
                    rows.append((src, e.lineno, e.colno, e.msg))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["src_id", "line", "col", "message"])

    return bad.mapInArrow(run, "src_id long, line int, col int, message string")
