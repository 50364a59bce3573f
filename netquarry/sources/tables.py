"""Line formats that are read by splitting: extraction dumps and electromigration geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.operators.activity import carried
from netquarry.sources.spef import number


def _words(lines: DataFrame) -> DataFrame:
    return lines.select("src_id", "seq", F.split(F.trim(F.regexp_replace("line", r"#.*$|\r", "")), r"\s+").alias("w")).filter(F.col("w")[0] != "")


def net_dump(lines: DataFrame) -> dict[str, DataFrame]:
    """DESIGN, NET name, PIN, SEG, GCAP and CCAP lines: pins, resistors with their geometry, grounded and one-sided coupling capacitors."""
    w = _words(lines)
    g = lambda k: F.get("w", F.lit(k))
    d = lambda k: g(k).try_cast("double")
    w = w.withColumn("kw", F.upper(g(0)))
    w = carried(w, ["src_id"], "seq", F.when(F.col("kw") == "NET", g(1)), "net")
    of = lambda k, n: w.filter((F.col("kw") == k) & (F.size("w") >= n) & F.col("net").isNotNull())
    return {
        "net": w.filter("kw = 'NET'").select("src_id", g(1).alias("net")).distinct(),
        "pin": of("PIN", 3).select("src_id", "net", "seq", g(1).alias("pin"), g(2).alias("node")),
        "seg": of("SEG", 4).select("src_id", "net", "seq", g(1).alias("a"), g(2).alias("b"), d(3).alias("r"), g(4).alias("layer"), d(5).alias("width_um"), d(6).alias("length_um")),
        "gcap": of("GCAP", 3).select("src_id", "net", "seq", g(1).alias("node"), d(2).alias("c")),
        "ccap": of("CCAP", 4).select("src_id", "net", "seq", g(1).alias("other"), g(2).alias("node"), d(3).alias("cc")),
    }


EM_COLUMNS = ["net", "a", "b", "layer", "width_um", "length_um", "res_ohm"]


def em_geometry(lines: DataFrame) -> DataFrame:
    """SEG lines of a geometry sidecar; lines too short to be one are dropped."""
    w = _words(lines).filter((F.upper(F.col("w")[0]) == "SEG") & (F.size("w") >= 8))
    g = lambda k: F.get("w", F.lit(k))
    return w.select("src_id", "seq", *[g(k + 1).alias(c) if k < 4 else F.coalesce(g(k + 1).try_cast("double"), F.lit(0.0)).alias(c) for k, c in enumerate(EM_COLUMNS)])


def em_text(segments: DataFrame) -> DataFrame:
    """Segments as lines again, numbers with up to six decimals."""
    six = lambda c: number(F.round(F.col(c), 6))
    return segments.select("src_id", "seq", F.concat_ws(" ", F.lit("SEG"), *[F.col(c) if k < 4 else six(c) for k, c in enumerate(EM_COLUMNS)]).alias("line"))


def by_net(segments: DataFrame) -> DataFrame:
    return segments.groupBy("net").agg(F.count("*").alias("n_segments"), F.sum("length_um").alias("length_um"), F.sum("res_ohm").alias("res_ohm"), F.min("width_um").alias("min_width_um"))
