"""Queries of the problems on training text, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.core import read
from netquarry.llm import components, leakage, mixing, redact


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.net_groups(read(spark, sf_dir, "nl_alias"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(read(spark, sf_dir, "eval_item"), read(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignments that hold a passage of 12 equal words in a row."""
    return _leaks(spark, sf_dir).filter("run >= 12").select("item_id", "doc_id")


def p7_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by alignment score: copies that were edited or paraphrased are found even without a run of 12 words."""
    return _leaks(spark, sf_dir).filter("score >= 16").select("item_id", "doc_id", F.round("score", 3).alias("score"), "run")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_target"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_target"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.find(read(spark, sf_dir, "documents")).select("doc_id", "pii_kind", "found_text").distinct()


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.redact(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"p3_found": p3_found, "p7_found": p7_found, "p7_edited": p7_edited, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_redacted": p9_redacted}
_GRAMS = "SELECT DISTINCT {key}, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {key}, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM {table}) WHERE len(w) >= 12)"
ORACLE_SQL: dict[str, str] = {
    # every name reaches the smaller names of its group along the pairs
    "p3_found": r"""WITH RECURSIVE a AS (SELECT src_id, rtrim(replace(lhs, '\', ''), chr(32)||chr(9)||chr(13)||chr(10)) AS a, rtrim(replace(rhs, '\', ''), chr(32)||chr(9)||chr(13)||chr(10)) AS b FROM nl_alias),
p AS (SELECT DISTINCT * FROM a WHERE a <> '' AND b <> '' AND NOT contains(a, '''') AND NOT contains(b, '''') AND src_id IS NOT NULL), e AS (SELECT src_id, a, b FROM p UNION SELECT src_id, b, a FROM p),
r(src_id, net, g) AS (SELECT src_id, a, a FROM e UNION SELECT e.src_id, e.b, r.g FROM r JOIN e ON e.src_id = r.src_id AND e.a = r.net WHERE r.g < e.b)
SELECT src_id, min(g) AS group_net, net FROM r GROUP BY src_id, net""",
    "p7_found": f"WITH d AS ({_GRAMS.format(key='doc_id', table='documents')}), i AS ({_GRAMS.format(key='item_id', table='eval_item')}) SELECT DISTINCT item_id, doc_id FROM d JOIN i USING (g)",
}
