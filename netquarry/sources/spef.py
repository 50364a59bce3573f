"""Parasitic files: lines to nets, grounded and coupling capacitors, resistors and connections, and back to text.

All of it runs JVM-side: the block and the net a line belongs to are carried along the lines in blocks, names are resolved through
one dictionary of the distinct tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.core import materialise, numbered, release, salted_join
from netquarry.functions.names import unescape
from netquarry.operators.activity import carried

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SECTIONS = {"*NAME_MAP": "map", "*CONN": "conn", "*CAP": "cap", "*RES": "res", "*END": "", "*D_NET": "net", "*R_NET": "r_net", "*D_PNET": "pnet", "*R_PNET": "pnet", "*PORTS": "", "*POWER_NETS": "", "*GROUND_NETS": "", "*DEFINE": ""}


def value(tok: Column) -> Column:
    """A number, of a triplet the first."""
    first = F.split(tok, ":")[0]
    return F.when(first.rlike(NUMBER), first.try_cast("double"))


def is_triplet(tok: Column) -> Column:
    p = F.split(tok, ":")
    return (F.size(p) == 3) & F.forall(p, lambda x: x.rlike(NUMBER))


def scan(lines: DataFrame) -> dict[str, DataFrame]:
    """lines (src_id, seq, line) -> nets (cap_ff, net_node), gcap, cc, res, conn and health, values in fF and ohm.

    Keywords are read in any case, // starts a comment; reduced and physical nets are counted and skipped, entries that cannot be read
    are counted. A mapped name without an entry is its own number."""
    t = F.split(F.trim(F.regexp_replace("line", r"//.*$|\r", "")), r"\s+")
    w = lines.select("src_id", "seq", t.alias("w")).filter(F.col("w")[0] != "")
    w = w.withColumn("kw", F.upper(F.col("w")[0]))
    names = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    # what is carried is read several times, so each stage is written once
    words = materialise(w.withColumn("_s", F.try_element_at(names, F.col("kw"))), "words")
    opens = F.col("_s").isin("net", "r_net", "pnet") | (F.col("kw") == "*END")
    sections = materialise(carried(words, ["src_id"], "seq", F.col("_s"), "sect"), "sections")
    release(words)
    w = carried(sections, ["src_id"], "seq", F.when(opens, F.when(F.col("_s") == "net", F.concat(F.lit("="), F.get("w", F.lit(1)), F.lit(" "), F.col("seq").cast("string"))).otherwise("")), "block")
    w = materialise(w, "spef")
    release(sections)
    unit = F.when(F.col("kw") == "*C_UNIT", "c").when(F.col("kw") == "*R_UNIT", "r")
    scale = F.create_map(*[F.lit(x) for x in ("FF", 1.0, "PF", 1e3, "NF", 1e6, "OHM", 1.0, "KOHM", 1e3, "MOHM", 1e6)])
    u = w.filter(unit.isNotNull()).select("src_id", "seq", unit.alias("u"), (F.coalesce(value(F.get("w", F.lit(1))), F.lit(1.0)) * F.coalesce(F.try_element_at(scale, F.upper(F.get("w", F.lit(2)))), F.lit(1.0))).alias("f"))
    u = u.groupBy("src_id").agg(F.max_by(F.when(F.col("u") == "c", F.col("f")), F.when(F.col("u") == "c", F.col("seq"))).alias("fc"), F.max_by(F.when(F.col("u") == "r", F.col("f")), F.when(F.col("u") == "r", F.col("seq"))).alias("fr"))
    g = lambda k: F.get("w", F.lit(k))
    mapped = w.filter((F.col("sect") == "map") & F.col("_s").isNull() & g(0).rlike(r"^\*[0-9]+$") & (F.size("w") > 1))
    mapped = mapped.groupBy("src_id", F.expr("substring(w[0], 2)").alias("num")).agg(F.max_by(unescape(g(1)), "seq").alias("name"))
    body = w.filter(F.col("_s").isNull() & (F.substring("block", 1, 1) == "="))
    n = F.size("w")
    net = w.filter("_s = 'net'").select("src_id", "seq", g(1).alias("net"), F.coalesce(value(g(2)), F.lit(0.0)).alias("v"), F.coalesce(is_triplet(g(2)), F.lit(False)).alias("tri"))
    owner = F.regexp_extract("block", r"^=(\S*)", 1)
    res = body.filter((F.col("sect") == "res")).select("src_id", "seq", owner.alias("net"), g(1).alias("a"), g(2).alias("b"), F.when(n >= 4, value(g(3))).alias("v"), (n >= 4) & is_triplet(g(3)))
    res = res.toDF("src_id", "seq", "net", "a", "b", "v", "tri")
    cap = body.filter((F.col("sect") == "cap")).select("src_id", "seq", owner.alias("net"), g(1).alias("a"), F.when(n >= 4, g(2)).alias("b"), F.when(n >= 4, value(g(3))).when(n == 3, value(g(2))).alias("v"), F.coalesce(is_triplet(F.when(n >= 4, g(3)).otherwise(g(2))), F.lit(False)).alias("tri"))
    at = F.array_position(F.transform("w", lambda x: F.upper(x)), "*L").cast("int")
    conn = body.filter((F.col("sect") == "conn") & F.col("kw").isin("*I", "*P") & (n > 1)).select("src_id", "seq", owner.alias("net"), g(1).alias("a"), F.upper(g(2)).alias("dir"), (F.col("kw") == "*P").alias("is_port"), F.coalesce(F.when(at > 0, value(F.get("w", at))), F.lit(0.0)).alias("v"))
    # each distinct token is resolved once
    tok = None
    for d, cols in ((net, ["net"]), (res, ["a", "b"]), (cap, ["a", "b"]), (conn, ["a"])):
        for c in cols:
            x = d.filter(F.col(c).isNotNull()).select("src_id", F.col(c).alias("tok"))
            tok = x if tok is None else tok.unionByName(x)
    tok = tok.distinct().withColumn("num", F.regexp_extract("tok", r"^\*([^:]*)", 1)).withColumn("tail", F.regexp_extract("tok", "(:.*)$", 1))
    tok = tok.join(mapped, ["src_id", "num"], "left")
    tok = materialise(tok.select("src_id", "tok", F.when(F.startswith("tok", F.lit("*")), F.concat(F.coalesce("name", "num"), "tail")).otherwise(unescape("tok")).alias("full")), "tokens")

    def named(d: DataFrame, cols: list[str]) -> DataFrame:
        for c in cols:
            d = salted_join(d, tok.select("src_id", F.col("tok").alias(c), F.col("full").alias("_f")), ["src_id", c], "left", by=F.col("seq")).withColumn(c, F.col("_f")).drop("_f")
        return d

    scaled = lambda d, f: d.join(u.select("src_id", f), "src_id", "left").withColumn("v", F.col("v") * F.coalesce(f, F.lit(1.0))).drop(f)
    nets = scaled(named(net, ["net"]), "fc").filter("net <> ''")
    dirs = F.when(F.col("dir").isin("I", "O", "B"), F.col("dir")).otherwise("U")
    c = scaled(named(conn, ["net", "a"]), "fc")
    c = c.select("src_id", "seq", "net", F.when(F.col("is_port"), "").otherwise(F.regexp_extract("a", "^(.*?):", 1)).alias("inst"), F.when(F.col("is_port"), F.col("a")).otherwise(F.regexp_extract("a", "^.*?:(.*)$", 1)).alias("pin"), F.col("a").alias("node"), dirs.alias("dir"), F.col("v").alias("cap_ff"), "is_port")
    caps = scaled(named(cap, ["net", "a", "b"]), "fc")
    r = scaled(named(res, ["net", "a", "b"]), "fr")
    counts = w.groupBy("src_id").agg(F.count_if(F.col("_s") == "r_net").alias("reduced"), F.count_if(F.col("_s") == "pnet").alias("pnets"))
    bad = cap.select("src_id", "v", "tri").unionByName(res.select("src_id", "v", "tri")).groupBy("src_id").agg(F.count_if(F.col("v").isNull()).alias("skipped"), F.coalesce(F.bool_or("tri"), F.lit(False)).alias("triplets"))
    health = counts.join(bad, "src_id", "left").select("src_id", F.coalesce("skipped", F.lit(0)).alias("skipped"), F.coalesce("triplets", F.lit(False)).alias("triplets"), "reduced", "pnets")
    return {
        "net": nets.select("src_id", "net", F.col("v").alias("cap_ff"), "seq"),
        "gcap": caps.filter("b is null and v is not null").select("src_id", "net", F.col("seq").alias("ord"), F.col("a").alias("node"), F.col("v").alias("c")),
        "cc": caps.filter("b is not null and v is not null").select("src_id", F.col("seq").alias("ord"), "a", "b", F.col("v").alias("cc")),
        "res": r.filter("v is not null").select("src_id", "net", F.col("seq").alias("ord"), "a", "b", F.col("v").alias("r")),
        "conn": c.filter("is_port or pin <> ''"),
        "health": health,
    }


def pin_nodes(conn: DataFrame, pins: DataFrame) -> DataFrame:
    """pins (src_id, inst, pin) with node, where the parasitics hook the pin up: the first of its connections; null where there is none."""
    first = conn.filter("not is_port").groupBy("src_id", "inst", "pin").agg(F.min_by("node", "seq").alias("node"))
    return pins.join(first, ["src_id", "inst", "pin"], "left")


def owners(tables: dict[str, DataFrame]) -> DataFrame:
    """node -> net by connections, resistors and grounded capacitors, and the net's own node."""
    o = tables["net"].select("src_id", F.col("net").alias("node"), "net")
    for t, cols in (("conn", ["node"]), ("gcap", ["node"]), ("res", ["a", "b"])):
        for c in cols:
            o = o.unionByName(tables[t].select("src_id", F.col(c).alias("node"), "net"))
    return o.groupBy("src_id", "node").agg(F.min("net").alias("net"))


def escape(name: Column | str) -> Column:
    return F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"([^A-Za-z0-9_/:*.])", r"\\$1")


def number(x: Column | str) -> Column:
    """Shortest decimal form that reads back as the same double, without an exponent while that takes no more than 24 characters."""

    @F.udf("string", useArrow=True)
    def run(v):
        if v is None:
            return None
        from decimal import Decimal

        s = format(Decimal(repr(v)), "f")
        s = s.rstrip("0").rstrip(".") if "." in s else s
        return s if len(s) <= 24 else repr(v)

    return run(F.col(x) if isinstance(x, str) else x)


def write(tables: dict[str, DataFrame], design: str = "top") -> DataFrame:
    """One source's tables as lines (part, net_no, k, line) whose order is part, net_no, k. Coupling stands in the blocks of both nets."""
    tables = {k: materialise(v, k) for k, v in tables.items() if k != "health"}
    nets = materialise(numbered(tables["net"].select("net", "cap_ff"), ["net"], "no"), "named")
    head = ['*SPEF "IEEE 1481-1998"', f'*DESIGN "{design}"', '*DATE "00:00:00 Thu January 1, 1970"', '*VENDOR "none"', '*PROGRAM "netquarry"', '*VERSION "1"', '*DESIGN_FLOW "NETLIST_TYPE_VERILOG"', "*DIVIDER /", "*DELIMITER :", "*BUS_DELIMITER []", "*T_UNIT 1 NS", "*C_UNIT 1 FF", "*R_UNIT 1 OHM", "*L_UNIT 1 HENRY", "*NAME_MAP"]
    spark = nets.sparkSession
    z = F.lit(0).cast("long")
    out = spark.createDataFrame([(k, x) for k, x in enumerate(head)], "k long, line string").select(F.lit(0).alias("part"), z.alias("no"), "k", "line")
    out = out.unionByName(nets.select(F.lit(1).alias("part"), "no", z.alias("k"), F.concat(F.lit("*"), F.col("no").cast("string"), F.lit(" "), escape("net")).alias("line")))
    tx = escape
    k = nets.select("net", "no")
    conn = tables["conn"].join(k, "net").select("no", F.col("seq").alias("o"), F.concat(F.when(F.col("is_port"), "*P ").otherwise("*I "), tx("node"), F.lit(" "), F.col("dir"), F.when(F.col("cap_ff") > 0, F.concat(F.lit(" *L "), number("cap_ff"))).otherwise("")).alias("line"))
    g = tables["gcap"].join(k, "net").select("no", F.col("ord").alias("o"), F.concat(tx("node"), F.lit(" "), number("c")).alias("line"))
    # a pair is one capacitor however often and whichever way round it is listed: the first listing counts
    cc = tables["cc"].groupBy(F.least("a", "b").alias("_lo"), F.greatest("a", "b").alias("_hi")).agg(F.min_by("cc", "ord").alias("cc")).toDF("a", "b", "cc")
    own = owners(tables).select("node", "net")
    both = cc.join(own.select(F.col("node").alias("a"), F.col("net").alias("_a")), "a", "left").join(own.select(F.col("node").alias("b"), F.col("net").alias("_b")), "b", "left")
    both = both.withColumn("net", F.explode(F.array_distinct(F.array(F.coalesce("_a", F.substring_index("a", ":", 1)), F.coalesce("_b", F.substring_index("b", ":", 1))))))
    c = both.join(k, "net").select("no", F.lit(0).cast("long").alias("o"), F.concat(tx("a"), F.lit(" "), tx("b"), F.lit(" "), number("cc")).alias("line"))
    r = tables["res"].join(k, "net").select("no", F.col("ord").alias("o"), F.concat(tx("a"), F.lit(" "), tx("b"), F.lit(" "), number("r")).alias("line"))
    big = 1 << 40
    body = nets.select("no", F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), x.alias("line")) for k, x in ((0, F.concat(F.lit("*D_NET *"), F.col("no").cast("string"), F.lit(" "), number("cap_ff"))), (big, F.lit("*CONN")), (2 * big, F.lit("*CAP")), (3 * big, F.lit("*RES")), (4 * big, F.lit("*END")))])))
    for sect, d in ((1, conn), (2, g.withColumn("o", F.struct(F.lit(0), "o")).unionByName(c.withColumn("o", F.struct(F.lit(1), "o")))), (3, r)):
        i = F.row_number().over(Window.partitionBy("no").orderBy("o", "line"))
        d = d.withColumn("i", i).select("no", (F.lit(sect * big) + F.col("i")).alias("k"), (F.col("line") if sect == 1 else F.concat(F.col("i").cast("string"), F.lit(" "), F.col("line"))).alias("line"))
        body = body.unionByName(d)
    return out.unionByName(body.select(F.lit(2).alias("part"), "no", "k", "line"))


def placed(written: DataFrame, src_id: int) -> DataFrame:
    """What write() gives as scan() reads it: src_id, seq, line. The lines are numbered in their order, so there may be any number of nets
    and of lines a net, and blocks of seq are full."""
    return numbered(written, ["part", "no", "k"], "seq").select(F.lit(src_id).cast("long").alias("src_id"), "seq", "line")
