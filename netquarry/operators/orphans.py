"""References to records that do not exist, directly and by inheritance.

A direct orphan is a reference whose target is missing, deleted or not yet loaded when the referring record is. Records that refer
to an orphaned record are orphans too: the cascade goes down the foreign-key graph (module, the instances in it, the modules these
bring in, the nets that only orphaned instances connect, the parasitic records of those nets) by joins until no record is added. Module
below module the reach of each round doubles, for chains are over a hundred levels deep; records with several parents keep them all.

Defined results: a null reference is none; referring rows without a time of loading are compared with no time, so any target that
exists serves them; repeated rows count once; an empty referred table makes every reference an orphan; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.core import broadcast_if_small, canon, materialise, release, salted_join

POWER = r"^(VDD|VSS|VPWR|VGND)|^(VPB|VNB)$"


def physical(conns: str = "conns"):
    """No connections, or power pins only."""
    return F.coalesce(F.forall(conns, lambda c: F.coalesce(F.upper(c["pin"]).rlike(POWER), F.lit(False))), F.lit(True))


def cell_refs(nl_inst: DataFrame, nl_module: DataFrame, lib_cell: DataFrame) -> DataFrame:
    """nl_inst.cell: inst_id, src_id, parent, key, t, nets, cause and in_module of the instances whose cell no library serves at the time
    of loading, one row for each of nl_inst. cause is null where a module of the source does; in_module tells whether the source has the
    module at any time, bare whether the instance has no connections but power: it is no reference that can fail, but still brings its
    module in."""
    lib = lib_cell.filter("cell_name is not null").groupBy(canon("cell_name").alias("key")).agg(F.collect_list(F.struct("added_at", "deleted_at")).alias("terms"))
    lib, small = broadcast_if_small(lib)
    i = nl_inst.filter(F.col("cell").isNotNull()).select("inst_id", physical().alias("bare"), "src_id", canon("cell").alias("key"), canon("parent_name").alias("parent"), F.col("loaded_at").alias("t"), F.col("conns.net").alias("nets"))
    i = i.join(lib, "key", "left") if small else salted_join(i, lib, ["key"], "left", by=F.col("inst_id"))
    begun = lambda a: F.col("t").isNull() | (a <= F.col("t"))
    force = F.exists("terms", lambda x: begun(x["added_at"]) & (x["deleted_at"].isNull() | (x["deleted_at"] > F.col("t"))))
    i = i.filter(~F.coalesce(force, F.lit(False)))
    i = i.select("inst_id", "src_id", "key", "parent", "t", "bare", "nets", F.coalesce(F.exists("terms", lambda x: x["deleted_at"] <= F.col("t")), F.lit(False)).alias("deleted"), F.col("terms").isNotNull().alias("listed"))
    spice = F.coalesce(F.lower("fmt") == "sp", F.lit(False))
    name = canon("module_name")
    m = nl_module.filter("module_name is not null").groupBy("src_id", spice.alias("ci"), F.when(spice, F.lower(name)).otherwise(name).alias("m")).agg(F.min("loaded_at").alias("at"))
    exact = m.filter("not ci").select("src_id", F.col("m").alias("key"), F.col("at").alias("at_v"), F.lit(True).alias("in_v"))
    folded = m.filter("ci").select("src_id", F.col("m").alias("low"), F.col("at").alias("at_s"), F.lit(True).alias("in_s"))
    # what the library serves is gone here: left are instances of modules, whose names repeat little, and orphans
    i = i.join(exact, ["src_id", "key"], "left").withColumn("low", F.lower("key")).join(folded, ["src_id", "low"], "left")
    in_module = F.col("in_v").isNotNull() | F.col("in_s").isNotNull()
    served = F.coalesce(F.col("in_v") & begun(F.col("at_v")), F.lit(False)) | F.coalesce(F.col("in_s") & begun(F.col("at_s")), F.lit(False))
    cause = F.when(served, F.lit(None).cast("string")).when(F.col("deleted"), "deleted").when(F.col("listed") | in_module, "late").otherwise("missing")
    return i.select("inst_id", "src_id", "parent", "key", cause.alias("cause"), in_module.alias("in_module"), "t", "bare", "nets")


def net_ends(rows: DataFrame, *more: str) -> DataFrame:
    """src_id, key and the columns `more` of each net in the array `nets`."""
    return rows.select("src_id", *more, F.explode("nets").alias("net")).filter("net is not null").select("src_id", canon("net").alias("key"), *more)


def net_refs(spef_net: DataFrame) -> DataFrame:
    """ref_field, net_id, src_id, key, t of each net that a parasitic record refers to."""
    one = F.array(F.struct(F.lit("net").alias("ref_field"), F.col("net").alias("n")))
    more = F.transform(F.coalesce(F.col("coupling.other_net"), F.array().cast("array<string>")), lambda n: F.struct(F.lit("coupling").alias("ref_field"), n.alias("n")))
    refs = spef_net.select("net_id", "src_id", F.col("loaded_at").alias("t"), F.inline(F.concat(one, more)))
    return refs.filter("n is not null").select("ref_field", "net_id", "src_id", canon("n").alias("key"), "t")


def net_orphans(refs: DataFrame, targets: DataFrame, hung: DataFrame) -> DataFrame:
    """The references of refs to nets that no instance connects at the time of loading (level 0), or only orphaned instances (below).

    targets: src_id, key, at, n, the number of instance rows that connect the net; hung: src_id, key, k, level of orphaned ones.
    References are reduced to one row a net before the join; only nets that fail some reference are joined back."""
    wanted = refs.groupBy("src_id", "key").agg(F.min("t").alias("first_t"))
    nets = wanted.join(targets, ["src_id", "key"], "left").join(hung, ["src_id", "key"], "left")
    below = F.when(F.col("k") == F.col("n"), F.col("level") + 1)
    failed = nets.select("src_id", "key", "at", "first_t", below.alias("below")).filter("at is null or at > first_t or below is not null").drop("first_t")
    back = salted_join(refs, failed, ["src_id", "key"], salts=4, by=F.col("net_id"))
    direct = F.col("at").isNull() | F.coalesce(F.col("at") > F.col("t"), F.lit(False))
    cause = F.when(F.col("at").isNull(), "missing").when(direct, "late").otherwise("inherited")
    back = back.withColumn("cause", cause).withColumn("level", F.when(direct, F.lit(0)).otherwise(F.col("below")).cast("int")).filter("level is not null")
    return back.select("ref_field", "net_id", "src_id", "key", "cause", "t", "level").distinct()


def _reach(links: DataFrame, start: DataFrame) -> DataFrame:
    """inherited() for links of one parent each: every round doubles the reach of every link."""
    state = materialise(links.join(start, "k", "full").select("k", "up", F.col("level").cast("long").alias("level")), "reach")
    reach, n = 1, state.count()
    while reach <= n and state.filter("up is not null").limit(1).count():
        far = state.select(F.col("k").alias("up"), F.col("up").alias("_up"), F.col("level").alias("_level"))
        new = state.join(far, "up", "left").select("k", F.col("_up").alias("up"), F.least("level", F.col("_level") + reach).alias("level"))
        new = materialise(new, "reach")
        release(state)
        state, reach = new, reach * 2
    return state.filter("level is not null").select("k", "level")


def inherited(start: DataFrame, links: DataFrame) -> DataFrame:
    """The records at or below those of `start` (key columns k) along links (k, up): k, level, the steps from the nearest one.

    Level by level would take as many joins as the chain is long; along the first link of each record every round doubles its reach.
    The further links of records with several are then followed once each round, until no level falls."""
    links = links.filter("k is not null and up is not null and k <> up").distinct()
    one = links.groupBy("k").agg(F.min("up").alias("up"))
    more = materialise(links.join(one, ["k", "up"], "left_anti"), "more")
    got = _reach(one, start.select("k", F.lit(0).alias("level")).distinct())
    if not more.limit(1).count():
        release(more)
        return got
    one = materialise(one, "first")
    while True:
        got = materialise(got, "levels")
        side = more.join(got.select(F.col("k").alias("up"), "level"), "up").groupBy("k").agg((F.min("level") + 1).alias("new"))
        better = materialise(side.join(got, "k", "left").filter("level is null or new < level").select("k", F.col("new").alias("level")), "better")
        if not better.limit(1).count():
            release(better)
            return got
        got = _reach(one, got.unionByName(better).groupBy("k").agg(F.min("level").alias("level")))


def cascade(nl_inst: DataFrame, nl_module: DataFrame, lib_cell: DataFrame, spef_net: DataFrame) -> DataFrame:
    """Every orphan: tbl, ref_field, rec_id, missing_key, cause, seen_month and level (0 direct, else inherited).

    An instance whose module comes too late is an orphan, so all that lies in the module hangs below an orphan, and so does all in the
    modules that are brought in there. A net that only orphaned instances connect hangs below them, one step from the nearest, and so do
    the references to it that are no direct orphans. The rows of an instance are compared by number, so repeated ones need no merging."""
    refs = materialise(cell_refs(nl_inst, nl_module, lib_cell), "cells")
    cells = refs.filter("cause is not null and not bare")
    module = lambda c: F.struct("src_id", F.lower(c).alias("low"))
    late = cells.filter("in_module").select(module("key").alias("k")).distinct()
    below = inherited(late, refs.filter("in_module and parent is not null").select(module("key").alias("k"), module("parent").alias("up")))
    below = materialise(below.select("k.src_id", "k.low", (F.col("level") + 1).cast("int").alias("level")), "below")
    side, small = broadcast_if_small(below)
    hang = lambda d, how: d.join(side, ["src_id", "low"], how) if small else salted_join(d, below, ["src_id", "low"], how, by=F.col("inst_id"))
    inside = nl_inst.select("inst_id", "src_id", F.lower(canon("parent_name")).alias("low"), F.col("loaded_at").alias("t"), F.col("conns.net").alias("nets"))
    inside = materialise(hang(inside, "inner"), "inside")
    # an orphan inside a late module is counted once, but is as near as a direct one
    direct = hang(cells.select("inst_id", "src_id", F.lower("parent").alias("low"), "nets"), "left").select("src_id", "nets", F.lit(0).alias("level"), F.col("level").isNull().cast("int").alias("c"))
    ends = net_ends(inside.select("src_id", "nets", "level", F.lit(1).alias("c")).unionByName(direct), "level", "c")
    hung = ends.groupBy("src_id", "key").agg(F.sum("c").alias("k"), F.min("level").alias("level"))
    targets = net_ends(nl_inst.select("src_id", F.col("loaded_at").alias("t"), F.col("conns.net").alias("nets")), "t").groupBy("src_id", "key").agg(F.min("t").alias("at"), F.count("*").alias("n"))
    nets = net_orphans(net_refs(spef_net), targets, hung)
    month = F.date_format("t", "yyyy-MM").alias("seen_month")
    out = cells.select("inst_id", "key", "cause", "t").distinct().select(F.lit("nl_inst").alias("tbl"), F.lit("cell").alias("ref_field"), F.col("inst_id").alias("rec_id"), F.col("key").alias("missing_key"), "cause", month, F.lit(0).alias("level"))
    out = out.unionByName(nets.select(F.lit("spef_net").alias("tbl"), "ref_field", F.col("net_id").alias("rec_id"), F.col("key").alias("missing_key"), "cause", month, "level"))
    return out.unionByName(inside.select("inst_id", "low", "t", "level").distinct().select(F.lit("nl_inst").alias("tbl"), F.lit("parent_name").alias("ref_field"), F.col("inst_id").alias("rec_id"), F.col("low").alias("missing_key"), F.lit("inherited").alias("cause"), month, "level"))
