"""Names as Column expressions: leaves, bits, pins, escapes, scopes, and the resolution of nets to paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def leaf_of(path: Column | str) -> Column:
    """The part after the last dot."""
    return F.substring_index(_c(path), ".", -1)


def unescape(name: Column | str) -> Column:
    """A backslash gives way to the character it stands before; a last lone one is dropped."""
    return F.regexp_replace(F.regexp_replace(_c(name), r"\\(.)", "$1"), r"\\$", "")


def split_inst_pin(name: Column | str) -> Column:
    """struct(inst, pin) at the last slash; null if there is none."""
    c = _c(name)
    return F.when(F.contains(c, F.lit("/")), F.struct(F.regexp_extract(c, "^(.*)/([^/]*)$", 1).alias("inst"), F.regexp_extract(c, "^(.*)/([^/]*)$", 2).alias("pin")))


def split_bit_select(name: Column | str) -> Column:
    """struct(base, bit) of base[bit]; null for a range, an empty base or no select."""
    c, form = _c(name), r"^(.+)\[([+-]?[0-9]+)\]$"
    return F.when(c.rlike(form), F.struct(F.regexp_extract(c, form, 1).alias("base"), F.regexp_extract(c, form, 2).try_cast("long").alias("bit")))


def declared_ranges(names: DataFrame, key: list[str], name: str = "name") -> DataFrame:
    """key, base, msb, lsb: the range that the names base[bit] of each key span, as if it were declared."""
    d = names.filter(F.col(name).isNotNull()).select(*key, F.regexp_extract(name, r"^([^\[]*)\[([+-]?[0-9]+)\]$", 1).alias("base"), F.regexp_extract(name, r"^([^\[]*)\[([+-]?[0-9]+)\]$", 2).try_cast("long").alias("bit"))
    return d.filter("bit is not null").groupBy(*key, "base").agg(F.max("bit").alias("msb"), F.min("bit").alias("lsb"))


def expand_bits(base: Column | str, msb: Column | str, lsb: Column | str) -> Column:
    """The bits of a bus, greatest index first; the bare name where there is no range."""
    base, msb, lsb = _c(base), _c(msb), _c(lsb)
    hi, lo = F.greatest(msb, lsb), F.least(msb, lsb)
    bits = F.transform(F.sequence(hi, lo, F.lit(-1).cast("long")), lambda k: F.concat(base, F.lit("["), k.cast("string"), F.lit("]")))
    single = F.when(hi == lo, F.array(F.concat(base, F.lit("["), hi.cast("string"), F.lit("]"))))
    return F.when(msb.isNull() | lsb.isNull(), F.array(base)).otherwise(F.coalesce(single, bits))


def idents_in(expr: Column | str) -> Column:
    """Identifiers of a boolean expression, without those made of digits only."""
    return F.filter(F.regexp_extract_all(_c(expr), F.lit(r"([A-Za-z0-9_]+)"), 1), lambda w: ~w.rlike("^[0-9]+$"))


def join_scope(*parts: Column) -> Column:
    """Scope parts joined by dots, without empty ones."""
    return F.array_join(F.filter(F.array(*parts), lambda p: (p != "") & (p != "$end")), ".")


def resolve(nets: DataFrame, paths: DataFrame, scope: str = "") -> DataFrame:
    """nets (net) and declared paths (path) -> net, path, candidates: the one path that is the scope's net or ends in it.

    The leaf is the join key, so only paths of one leaf meet; more than one candidate leaves the net unresolved (path null)."""
    target = F.col("net") if not scope else F.concat(F.lit(scope + "."), F.col("net"))
    n = nets.select("net").distinct().withColumn("target", target).withColumn("leaf", leaf_of("target"))
    p = paths.select("path").distinct().withColumn("leaf", leaf_of("path"))
    hit = (F.col("path") == F.col("target")) | F.endswith(F.col("path"), F.concat(F.lit("."), F.col("target")))
    found = n.join(p, "leaf").filter(hit).groupBy("net").agg(F.count("*").alias("candidates"), F.min("path").alias("path"))
    one = n.select("net").join(found, "net", "left")
    return one.select("net", F.when(F.col("candidates") == 1, F.col("path")).alias("path"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def collisions(paths: DataFrame) -> DataFrame:
    """Leaves that more than one path has: leaf, n_paths."""
    return paths.select("path").distinct().groupBy(leaf_of("path").alias("leaf")).agg(F.count("*").alias("n_paths")).filter("n_paths > 1")
