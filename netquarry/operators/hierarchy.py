"""Parent-child links to full hierarchies: depth, root, descendants, full path, and cycles.

Leaves are peeled until only cycles remain; a cycle is cut at each of its nodes, which become roots. The forest's Euler tours (one
element on entering a node, one on leaving it) are ranked as linked lists in parallel: every block of the list is first contracted
where it lies, then the pointers that leave a block are doubled through joins until all reach the end of their tour. Entry and exit
ranks are intervals that nest as the nodes do: they give depth and descendants directly, and the path of a node by one scan in entry
order, each block of which starts with the intervals that hold its first entry.

Defined results: a node with several parents keeps the smallest; links to or from unknown nodes and null ends are no links; repeated
links count once; a link to itself is a cycle; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.core import canon, materialise, release, salted_join, whole_blocks

BLOCK = 1 << 19  # nodes of one group that may lie in one block
SPAN = 1 << 16  # tour positions scanned for paths at once
BUCKETS = 16  # children of one parent are put in order in so many parts


def _located(nodes: DataFrame, block: int) -> DataFrame:
    """nodes with part, the block of its group: groups of more than `block` nodes are cut by a hash of the id."""
    size = nodes.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    return nodes.join(size, "grp").withColumn("part", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")).drop("_n")


def _np(t: pa.Table, c: str) -> np.ndarray:
    return t.column(c).to_numpy()


def _find(ids: np.ndarray, order: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted in ids (sorted by order); -1 where absent."""
    if not len(ids):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(ids, wanted, sorter=order), len(ids) - 1)
    at = order[at]
    return np.where(ids[at] == wanted, at, -1)


def _peel_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Peels what can be peeled within each block. Gives the nodes left, and how many children nodes elsewhere lost."""
    for t in whole_blocks(batches, ["grp", "part"]):
        yield _peeled(t)


def _peeled(t: pa.Table) -> pa.RecordBatch:
    ids, parent, left, grp, part = (_np(t, c) for c in ("id", "parent", "left", "grp", "part"))
    left = left.copy()
    at = _find(ids, np.argsort(ids, kind="stable"), parent)
    gone = np.zeros(len(ids), bool)
    now = np.flatnonzero(left == 0)
    sent = []
    while len(now):
        gone[now] = True
        up, known = at[now], parent[now] >= 0
        sent.append(parent[now][known & (up < 0)])
        up = up[known & (up >= 0)]
        np.subtract.at(left, up, 1)
        up = np.unique(up)
        now = up[(left[up] == 0) & ~gone[up]]
    keep = ~gone
    told, times = np.unique(np.concatenate(sent) if sent else np.zeros(0, np.int64), return_counts=True)
    n, m = int(keep.sum()), len(told)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([ids[keep], told])), pa.array(np.concatenate([parent[keep], np.full(m, -1)])), pa.array(np.concatenate([left[keep], -times]).astype(np.int64)), pa.array(np.concatenate([grp[keep], np.zeros(m, np.int64)]).astype(np.int64)), pa.array(np.concatenate([part[keep], np.zeros(m, np.int64)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(n, bool), np.ones(m, bool)]))],
        names=["id", "parent", "left", "grp", "part", "message"],
    )


def on_cycles(nodes: DataFrame, rounds: int = 6) -> DataFrame:
    """The ids of nodes on a cycle, of nodes (id, parent or -1, grp, part)."""
    counts = nodes.filter("parent >= 0").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    state = nodes.select("id", "parent", "grp", "part").join(counts, "id", "left").select("id", "parent", "grp", "part", F.coalesce("n", F.lit(0)).cast("long").alias("left"))
    held = None
    for _ in range(rounds):
        out = materialise(state.repartition("grp", "part").sortWithinPartitions("grp", "part").mapInArrow(_peel_here, "id long, parent long, left long, grp long, part int, message boolean"), "peel")
        release(held)
        held = out
        messages = out.filter("message").groupBy("id").agg(F.sum("left").alias("lost"))
        kept = out.filter("not message").drop("message")
        if out.filter("message").limit(1).count() == 0:
            return kept.select("id")  # every node left has a child that is left: with one parent each, these are cycles
        state = kept.join(messages, "id", "left").select("id", "parent", "grp", "part", (F.col("left") + F.coalesce("lost", F.lit(0))).alias("left"))
    # what is still to be peeled has long chains across blocks: double the parent pointers of the nodes left
    kept = materialise(state.select("id", "parent"), "left")
    n = max(2, kept.count())
    jump = kept.select("id", F.col("parent").alias("to"))
    for _ in range(int(n).bit_length()):
        far = jump.select(F.col("id").alias("to"), F.col("to").alias("_to2"))
        nxt = materialise(jump.join(far, "to").select("id", F.col("_to2").alias("to")).filter("to >= 0"), "jump")
        release(jump)
        jump = nxt
    return jump.select(F.col("to").alias("id")).distinct()


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follows the list as far as it stays in the block: (e, to, n, w) with n elements and weight w from e up to before `to`."""
    for t in whole_blocks(batches, ["grp", "part"]):
        yield _followed(t)


def _followed(t: pa.Table) -> pa.RecordBatch:
    e, to, n, w = _np(t, "e"), _np(t, "to").copy(), np.ones(t.num_rows, np.int64), _np(t, "w").astype(np.int64).copy()
    at = _find(e, np.argsort(e, kind="stable"), to)
    # a pointer is followed while its target lies here; each pass doubles what is followed
    for _ in range(64):
        go = np.flatnonzero(at >= 0)
        if not len(go):
            break
        nx = at[go]
        n2, w2, to2, at2 = n[go] + n[nx], w[go] + w[nx], to[nx], at[nx]
        n[go], w[go], to[go], at[go] = n2, w2, to2, at2
    return pa.RecordBatch.from_arrays([pa.array(e), pa.array(to), pa.array(n), pa.array(w)], names=["e", "to", "n", "w"])


def rank(elements: DataFrame) -> DataFrame:
    """List ranking of elements (e, to, w, grp, part); `to` < 0 ends a list. Gives e, last (the end reached), n elements and weight
    w from e to the end."""
    spec = "e long, to long, n long, w long"
    run = materialise(elements.select("grp", "part", "e", "to", "w").repartition("grp", "part").sortWithinPartitions("grp", "part").mapInArrow(_contract, spec), "rank")
    # the elements that some pointer of another block leads to
    entry = run.filter("to >= 0").select(F.col("to").alias("e")).distinct()
    hop = run.join(entry, "e", "left_semi")
    first = True
    while True:
        hop = materialise(hop, "hop") if first else hop
        first = False
        if hop.filter("to >= 0").limit(1).count() == 0:
            break
        far = hop.select(F.col("e").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"), F.col("w").alias("_w"))
        nxt = materialise(hop.join(far, "to", "left").select("e", F.coalesce("_to", "to").alias("to"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w")), "hop")
        release(hop)
        hop = nxt
    far = hop.select(F.col("e").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"), F.col("w").alias("_w"))
    return run.join(far, "to", "left").select("e", F.coalesce("_to", "to").alias("last"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"))


def _tour(nodes: DataFrame) -> DataFrame:
    """The Euler tour of the forest nodes (id, parent or -1, grp, part): entering id is element 2 id, leaving it 2 id + 1."""
    c = nodes.filter("parent >= 0").select("id", "parent").withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)))
    nxt = c.withColumn("next", F.lead("id").over(Window.partitionBy("parent", "bucket").orderBy("id")))
    firsts = c.groupBy("parent", "bucket").agg(F.min("id").alias("first"))
    # at most BUCKETS rows a parent
    firsts = firsts.withColumn("after", F.lead("first").over(Window.partitionBy("parent").orderBy("bucket")))
    sibling = nxt.join(firsts.select("parent", "bucket", "after"), ["parent", "bucket"]).select("id", F.coalesce("next", "after").alias("sibling"))
    child = firsts.groupBy(F.col("parent").alias("id")).agg(F.min_by("first", "bucket").alias("child"))
    n = nodes.join(sibling, "id", "left").join(child, "id", "left")
    down = F.struct((F.col("id") * 2).alias("e"), F.coalesce(F.col("child") * 2, F.col("id") * 2 + 1).alias("to"), F.lit(1).alias("w"))
    up = F.struct((F.col("id") * 2 + 1).alias("e"), F.coalesce(F.col("sibling") * 2, F.when(F.col("parent") >= 0, F.col("parent") * 2 + 1).otherwise(-1 - F.col("id"))).alias("to"), F.lit(-1).alias("w"))
    return n.select("grp", "part", F.inline(F.array(down, up)))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (root, block, entry): each node's path is its predecessor on the stack of open intervals plus its name."""
    at: tuple | None = None
    stack: list[tuple[int, str]] = []
    for b in batches:
        ids, paths = [], []
        for i, root, block, entry, leave, name, given in zip(*(b.column(c).to_pylist() for c in ("id", "root", "block", "entry", "leave", "name", "given")), strict=True):
            if at != (root, block):
                at, stack = (root, block), []
            while stack and stack[-1][0] < entry:
                stack.pop()
            path = f"{stack[-1][1]}/{name}" if stack else name
            stack.append((leave, path))
            if not given:
                ids.append(i)
                paths.append(path)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.string())], names=["id", "path"])


def hierarchy(nodes: DataFrame, links: DataFrame, block: int = BLOCK) -> DataFrame:
    """nodes (id >= 0, grp, name), links (child, parent) -> id, name, parent, root, depth, n_below, path, entry, leave, cyclic.

    cyclic: on a cycle or below one; then root is the cycle's node above, and depth and path count from there."""
    known = nodes.select("id")
    up = links.filter("child is not null and parent is not null").groupBy("child").agg(F.min("parent").alias("parent"))
    up = up.join(known.select(F.col("id").alias("parent")), "parent", "left_semi")
    n = nodes.select("id", F.col("grp").cast("long").alias("grp"), "name").join(up.select(F.col("child").alias("id"), "parent"), "id", "left")
    n = materialise(_located(n.select("id", "grp", "name", F.coalesce("parent", F.lit(-1)).cast("long").alias("parent")), block), "nodes")
    core = materialise(on_cycles(n).withColumn("core", F.lit(True)), "core")  # a row for each node on a cycle
    cut = n.join(core, "id", "left").withColumn("tree_parent", F.when(F.col("core"), F.lit(-1)).otherwise(F.col("parent")))
    forest = materialise(cut.select("id", "grp", "part", F.col("tree_parent").alias("parent"), "name", F.coalesce("core", F.lit(False)).alias("core")), "forest")
    r = rank(_tour(forest.select("id", "parent", "grp", "part")))
    r = r.withColumn("id", F.shiftright("e", 1)).withColumn("_out", F.col("e") % 2 == 1)
    r = r.groupBy("id").agg(F.max("last").alias("last"), F.max(F.when(~F.col("_out"), F.col("n"))).alias("n_in"), F.max(F.when(F.col("_out"), F.col("n"))).alias("n_out"), F.max(F.when(~F.col("_out"), F.col("w"))).alias("w"))
    r = r.select("id", (-1 - F.col("last")).alias("root"), (-F.col("w")).alias("depth"), ((F.col("n_in") - F.col("n_out") - 1) / 2).cast("long").alias("n_below"), "n_in", "n_out")
    heads = r.filter("id = root").select("root", F.col("n_in").alias("_all")).join(forest.select(F.col("id").alias("root"), F.col("core").alias("cyclic"), F.col("name").alias("root_name")), "root")
    # roots are at most as many as nodes, one row each; a hot root is salted

    t = salted_join(r, heads, ["root"], by=F.col("id")).join(forest.select("id", "name", "parent"), "id")
    t = materialise(t.select("id", "name", "parent", "root", "root_name", "depth", "n_below", "cyclic", (F.col("_all") - F.col("n_in")).alias("entry"), (F.col("_all") - F.col("n_out")).alias("leave")), "tree")
    b = t.withColumn("block", F.floor(F.col("entry") / SPAN))
    over = b.filter(F.floor(F.col("leave") / SPAN) > F.col("block")).withColumn("block", F.explode(F.sequence(F.col("block") + 1, F.floor(F.col("leave") / SPAN)))).withColumn("given", F.lit(True))
    cols = ["id", "root", "block", "entry", "leave", "name", "given"]
    rows = b.withColumn("given", F.lit(False)).select(*cols).unionByName(over.select(*cols))
    paths = rows.repartition("root", "block").sortWithinPartitions("root", "block", "entry").mapInArrow(_paths, "id long, path string")
    return t.join(paths, "id")


def several_parents(links: DataFrame) -> DataFrame:
    """child, n_parents of the nodes that more than one parent holds: hierarchy() keeps the smallest of them."""
    return links.filter("child is not null and parent is not null").distinct().groupBy("child").agg(F.count("*").alias("n_parents")).filter("n_parents > 1")


def module_links(nl_module: DataFrame, nl_inst: DataFrame, sp_device: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The modules of the sources as nodes (id, grp, name), and their links by instances and X devices.

    A Verilog module is named exactly, a SPICE subckt without regard to case."""
    spice = F.lower("fmt") == "sp"
    m = nl_module.filter("module_name is not null and src_id is not null").select("module_id", "src_id", canon("module_name").alias("name"), F.coalesce(spice, F.lit(False)).alias("ci"))
    m = m.groupBy("src_id", "ci", F.when(F.col("ci"), F.lower("name")).otherwise(F.col("name")).alias("key")).agg(F.min("module_id").alias("id"), F.min("name").alias("name"))
    m = materialise(m, "modules")
    refs = nl_inst.select("src_id", canon("cell").alias("child"), canon("parent_name").alias("parent"), F.lit(False).alias("dev"))
    x = sp_device.filter(F.upper("kind") == "X").select("src_id", canon("model").alias("child"), canon("subckt").alias("parent"), F.lit(True).alias("dev"))
    # one row per (source, parent, child) leaves each map task: a cell with a tenth of all rows is no hot key
    refs = refs.unionByName(x).filter("child is not null and parent is not null").groupBy("src_id", "child", "parent", "dev").agg(F.count("*").alias("n")).drop("n")
    fits = lambda side: F.when(F.col("ci") | F.col("dev"), F.lower("key") == F.lower(side)).otherwise(F.col("key") == F.col(side))
    k = m.select("src_id", F.lower("key").alias("_low"), "key", "ci", "id")
    child = refs.withColumn("_low", F.lower("child")).join(k, ["src_id", "_low"]).filter(fits("child")).select("src_id", "parent", "dev", F.col("id").alias("_c"))
    both = child.withColumn("_low", F.lower("parent")).join(k, ["src_id", "_low"]).filter(fits("parent"))
    return m.select("id", F.col("src_id").alias("grp"), "name"), both.select(F.col("_c").alias("child"), F.col("id").alias("parent"))
