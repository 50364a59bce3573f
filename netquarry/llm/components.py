"""Pairwise matches consolidated into groups: connected components by alternating large-star and small-star.

The steps are first run inside each task, on the pairs it reads: every record it saw is linked to the smallest one it can reach
there. Records that several tasks saw tie the roots found for them together, and what is shuffled in rounds is only that graph of
roots; if the pairs of a group lie near each other it is small, if not it is no larger than the pairs. Before each round of joins the
edges that are left are contracted in the same way, by as many tasks as hold CHUNK edges each.

Edges are kept as (child, parent) with child > parent. A large-star step links every child to the smallest parent of its parent, a
small-star step links a child and all its parents to its smallest parent; both are joins with one minimum per node. The steps
alternate until no edge changes; then every record is linked to the smallest identifier of its component.

Defined results: pairs with a null end are none; a pair with itself makes a group of one; repeated and turned pairs count once; an
empty table gives no rows; identifiers are compared in byte order; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.core import canon, materialise, release, salted_join

CHUNK = 1_000_000  # pairs that a task links at once


def _link(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each distinct record of the pairs with the smallest record it is linked to by them."""
    both = pa.chunked_array([a, b]).combine_chunks().dictionary_encode()
    names = both.dictionary
    order = pc.sort_indices(names).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ends = rank[both.indices.to_numpy()]
    u, v = ends[: len(a)], ends[len(a) :]
    parent = np.arange(len(order))
    while True:
        pu, pv = parent[u], parent[v]
        least = np.minimum(pu, pv)
        new = parent.copy()
        np.minimum.at(new, pu, least)  # large-star: roots to the smallest root beside them
        np.minimum.at(new, pv, least)
        while True:  # small-star: everything to the parent of its parent
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == parent).all():
            break
        parent = new
    ranked = names.take(pa.array(order))
    return ranked, ranked.take(pa.array(parent))


def _here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        node, root = _link(*(t.column(c).combine_chunks() for c in ("a", "b")))
        return pa.RecordBatch.from_arrays([node, root], names=["node", "root"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= CHUNK:
            yield out()
            held = []
    if sum(x.num_rows for x in held):
        yield out()


def _edges(df: DataFrame) -> DataFrame:
    """Distinct (child, parent) of pairs a, b, without self pairs."""
    return df.filter("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct()


def _minima(edges: DataFrame, name: str) -> DataFrame:
    # written, so that both sides of the next join are plain shuffles, which AQE splits where a node is hot
    return materialise(edges.groupBy("child").agg(F.min("parent").alias("m"), F.count("*").alias("n")), name)


def _state(edges: DataFrame, minima: DataFrame) -> tuple:
    """Tells whether every child has one parent and no parent is a child."""
    many = minima.filter("n > 1").limit(1).count()
    if many:
        return False
    chained = minima.select(F.col("m").alias("child")).join(minima.select("child"), "child", "left_semi").limit(1).count()
    return not chained


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges after the steps were run inside tasks of about CHUNK edges, those of one parent together."""
    tasks = max(1, -(-edges.count() // CHUNK))
    here = edges.select(F.col("child").alias("a"), F.col("parent").alias("b")).repartition(tasks, "b").mapInArrow(_here, "node string, root string")
    out = materialise(_edges(here.select(F.col("node").alias("a"), F.col("root").alias("b"))), "edges")
    release(edges)
    return out


def components(pairs: DataFrame, most_rounds: int = 100) -> DataFrame:
    """pairs (a, b) -> (node, component), component being the smallest node of the group."""
    stars = pairs.filter("a is not null and b is not null").select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).mapInArrow(_here, "node string, root string")
    stars = materialise(stars, "stars")
    own = materialise(stars.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("last")), "own")
    # a record with several roots ties them to the smallest
    split = own.filter("root <> last").select("node", F.col("root").alias("b"))
    tied = salted_join(stars, split, ["node"], salts=4, by=F.col("root")).select(F.col("root").alias("a"), "b")
    edges = materialise(_edges(tied), "edges")
    release(stars)
    for _ in range(most_rounds):
        edges = _contracted(edges)
        m = _minima(edges, "large")
        if _state(edges, m):
            break
        up = m.select(F.col("child").alias("parent"), F.col("m").alias("_m"))
        large = materialise(edges.join(up, "parent", "left").select("child", F.coalesce("_m", "parent").alias("parent")).distinct(), "large")
        release(m)
        release(edges)
        m = _minima(large, "small")
        joined = large.join(m, "child").select("child", "parent", "m")
        # the child goes to its smallest parent, and so do its other parents
        both = joined.select(F.inline(F.array(F.struct(F.col("child").alias("child"), F.col("m").alias("parent")), F.struct(F.col("parent").alias("child"), F.col("m").alias("parent")))))
        edges = materialise(both.filter("child <> parent").distinct(), "edges")
        release(m)
        release(large)
    else:
        raise RuntimeError(f"not settled after {most_rounds} rounds")
    top = m.select(F.col("child").alias("root"), "m")
    return salted_join(own.select("node", "root"), top, ["root"], "left", salts=4, by=F.col("node")).select("node", F.coalesce("m", "root").alias("component"))


def net_groups(nl_alias: DataFrame) -> DataFrame:
    """Nets of each source that are one by their aliases: src_id, net, group_net."""
    a = nl_alias.select("src_id", canon("lhs").alias("lhs"), canon("rhs").alias("rhs"))
    says = F.lit(True)
    for c in ("lhs", "rhs"):
        says = says & F.col(c).isNotNull() & (F.col(c) != "") & ~F.contains(F.col(c), F.lit("'"))
    # within a source the order of these keys is that of the names
    key = lambda c: F.concat(F.col("src_id").cast("string"), F.lit("\t"), F.col(c))
    got = components(a.filter(says & F.col("src_id").isNotNull()).select(key("lhs").alias("a"), key("rhs").alias("b")))
    name = lambda c: F.expr(f"substring({c}, locate('\t', {c}) + 1)")
    return got.select(F.substring_index("node", "\t", 1).cast("long").alias("src_id"), name("component").alias("group_net"), name("node").alias("net"))
