"""Parasitics: coupling between nets, and delays on the resistor trees of nets.

Tree algorithms get one row a net with its elements as arrays and run in an Arrow-batched UDF: nets are independent, and a group per
net in pandas would cost far more than the work. An element array is as long as its net has elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KILO_FEMTO = 1e-6  # ohm x fF in ns


def coupling(listed: DataFrame, owner: DataFrame) -> DataFrame:
    """(net, other, cc) by aggressor from listings (ord, a, b, cc) of node pairs and owner (node, net).

    A pair counts once, the first listing wins, whichever node is named first. A node without an owner belongs to what stands
    before its colon if that is a net, a bare name is its own net; pairs within a net are no coupling."""
    pair = listed.withColumn("_lo", F.least("a", "b")).withColumn("_hi", F.greatest("a", "b"))
    first = pair.groupBy("_lo", "_hi").agg(F.min_by(F.struct("a", "b", "cc"), "ord").alias("x")).select("x.*")
    nets = owner.select("net").distinct()

    def owned(d: DataFrame, node: str, name: str) -> DataFrame:
        d = d.join(owner.select(F.col("node").alias(node), F.col("net").alias("_own")), node, "left")
        d = d.withColumn("_head", F.substring_index(node, ":", 1))
        d = d.join(nets.select(F.col("net").alias("_head"), F.lit(True).alias("_is")), "_head", "left")
        bare = F.when(~F.contains(node, F.lit(":")), F.col(node))
        return d.withColumn(name, F.coalesce("_own", F.when(F.col("_is"), F.col("_head")), bare)).drop("_own", "_head", "_is")

    e = owned(owned(first, "a", "_na"), "b", "_nb").filter(F.col("_na") != F.col("_nb"))
    both = e.select(F.inline(F.array(F.struct(F.col("_na").alias("net"), F.col("_nb").alias("other"), "cc"), F.struct(F.col("_nb").alias("net"), F.col("_na").alias("other"), "cc"))))
    return both.groupBy("net", "other").agg(F.sum("cc").alias("cc"))


def spread_crosstalk(caps: DataFrame, extra: Column, key: str = "net") -> DataFrame:
    """Grounded capacitors (net, node, c) with a net's crosstalk spread over them in proportion."""
    total = F.sum("c").over(Window.partitionBy(key))
    return caps.withColumn("c", F.when(total > 0, F.col("c") + extra * F.col("c") / total).otherwise(F.col("c")))


def net_rows(res: DataFrame, caps: DataFrame) -> DataFrame:
    """net, res (array of a, b, r in order) and caps (array of node, c)."""
    r = res.groupBy("net").agg(F.array_sort(F.collect_list(F.struct("ord", "a", "b", "r"))).alias("res"))
    c = caps.groupBy("net").agg(F.array_sort(F.collect_list(F.struct("ord", "node", "c"))).alias("caps"))
    return r.join(c, "net", "left")


def _walk(res, driver):
    """Order of nodes from the driver with parent and resistance; None if it is no tree or the driver is not on it."""
    near: dict = {}
    for e in res:
        near.setdefault(e["a"], []).append((e["b"], e["r"]))
        near.setdefault(e["b"], []).append((e["a"], e["r"]))
    if driver not in near:
        return None
    order, up = [driver], {driver: (None, 0.0)}
    for node in order:
        skipped = False
        for other, r in near[node]:
            if other == up[node][0] and not skipped:
                skipped = True  # the edge it came by; a second such edge closes a loop
            elif other in up:
                return None
            else:
                up[other] = (node, r)
                order.append(other)
    return order, up


def _node_caps(caps, driver, extra):
    at: dict = {}
    for c in caps or []:
        at[c["node"]] = at.get(c["node"], 0.0) + c["c"]
    total = sum(at.values())
    if extra:
        if total > 0:
            at = {k: v + extra * v / total for k, v in at.items()}
        else:
            at[driver] = at.get(driver, 0.0) + extra
    return at


def elmore(res: Column | str, caps: Column | str, driver: Column | str, extra: Column | float = 0.0) -> Column:
    """array(node, delay ns) of each node from the driver; null where the net has no resistors, no such driver, or a loop."""

    @F.udf("array<struct<node:string,delay:double>>", useArrow=True)
    def run(r, c, d, x):
        tree = _walk(r, d) if r is not None and len(r) else None
        if tree is None:
            return None
        order, up = tree
        below = _node_caps(c, d, x)
        load = {n: below.get(n, 0.0) for n in order}
        for n in reversed(order[1:]):
            load[up[n][0]] += load[n]
        delay = {d: 0.0}
        for n in order[1:]:
            delay[n] = delay[up[n][0]] + up[n][1] * load[n] * KILO_FEMTO
        return [{"node": n, "delay": delay[n]} for n in order]

    return run(res, caps, driver, extra if isinstance(extra, Column) else F.lit(float(extra)))


def pi_reduce(res: Column | str, caps: Column | str, driver: Column | str) -> Column:
    """struct(c1, tau): capacitance at the driver in fF, and the sum of capacitance times path resistance in ns; null without
    resistors or without the driver. Loops are no hindrance: the path that reaches a node first counts."""

    @F.udf("struct<c1:double,tau:double>", useArrow=True)
    def run(r, c, d):
        near: dict = {}
        for e in r if r is not None else []:
            near.setdefault(e["a"], []).append((e["b"], e["r"]))
            near.setdefault(e["b"], []).append((e["a"], e["r"]))
        if d not in near:
            return None
        path, order = {d: 0.0}, [d]
        for n in order:
            for other, x in near[n]:
                if other not in path:
                    path[other] = path[n] + x
                    order.append(other)
        at = _node_caps(c, d, 0.0)
        return {"c1": at.get(d, 0.0), "tau": sum(v * path.get(k, 0.0) for k, v in at.items()) * KILO_FEMTO}

    return run(res, caps, driver)


def transient(res: Column | str, caps: Column | str, driver: Column | str, slew: Column | float, extra: Column | float = 0.0, lo: float = 0.2, mid: float = 0.5, hi: float = 0.8, span: float = 0.6, steps: int = 800) -> Column:
    """array(node, delay, slew) in ns for a saturated ramp at the driver: backward Euler over the tree, thresholds found between steps.

    The ramp lasts slew / span; the run covers it and six lumped time constants. A threshold never reached gives 0. Null as in elmore."""

    @F.udf("array<struct<node:string,delay:double,slew:double>>", useArrow=True)
    def run(r, c, d, s, x):
        import numpy as np

        tree = _walk(r, d) if r is not None and len(r) else None
        if tree is None:
            return None
        order, up = tree
        at = _node_caps(c, d, x)
        n = len(order)
        place = {node: k for k, node in enumerate(order)}
        cap = np.array([at.get(node, 0.0) for node in order])
        parent = np.array([0] + [place[up[node][0]] for node in order[1:]])
        g = np.array([0.0] + [1.0 / up[node][1] for node in order[1:]])
        lump = max(1e-6, sum(e["r"] for e in r) * cap.sum() * KILO_FEMTO)
        ramp = max(1e-4, s / span)
        dt = max(1e-7, (ramp + 6.0 * lump) / steps)
        hold = cap * KILO_FEMTO / dt
        # the matrix is the same in each step: eliminate leaves into parents once
        diag = hold + g
        for k in range(n - 1, 0, -1):
            if parent[k]:
                diag[parent[k]] += g[k] - g[k] * g[k] / diag[k]
        pull = g / np.where(diag > 0, diag, 1.0)
        marks = np.array([lo, mid, hi])
        v, cross = np.zeros(n), np.full((n, 3), np.inf)
        for step in range(1, steps + 1):
            t = step * dt
            rhs = hold * v
            for k in range(n - 1, 0, -1):
                if parent[k]:
                    rhs[parent[k]] += pull[k] * rhs[k]
            new = np.empty(n)
            new[0] = min(1.0, t / ramp)
            for k in range(1, n):
                new[k] = rhs[k] / diag[k] + pull[k] * new[parent[k]]
            over = np.isinf(cross) & (new[:, None] >= marks) & (v[:, None] < marks)
            if over.any():
                when = (t - dt) + (marks - v[:, None]) / np.maximum(new - v, 1e-12)[:, None] * dt
                cross = np.where(over, when, cross)
            v = new
        delay = np.where(np.isfinite(cross[:, 1]), np.maximum(0.0, cross[:, 1] - ramp * mid), 0.0)
        ok = np.isfinite(cross[:, 0]) & np.isfinite(cross[:, 2])
        rise = np.maximum(0.0, np.where(ok, cross[:, 2], 0.0) - np.where(ok, cross[:, 0], 0.0))
        return [{"node": node, "delay": float(delay[k]), "slew": float(rise[k])} for k, node in enumerate(order)]

    lit = lambda z: z if isinstance(z, Column) else F.lit(float(z))
    return run(res, caps, driver, lit(slew), lit(extra))


def wire_load_pf(cap_ff: Column | str) -> Column:
    return F.coalesce(F.col(cap_ff) if isinstance(cap_ff, str) else cap_ff, F.lit(0.0)) / 1000.0


def lumped_delay_ns(res_ohm: Column | str, cap_ff: Column | str) -> Column:
    r, c = (F.col(x) if isinstance(x, str) else x for x in (res_ohm, cap_ff))
    return F.coalesce(r * c * KILO_FEMTO, F.lit(0.0))


def coupling_order(listed: DataFrame) -> DataFrame:
    """coupling (src_id, net, node, other, other_node, cc) with place: the order in which a net's couplings are written, by node, other net
    and other node, so that writing what was read gives the same file."""
    by = Window.partitionBy("src_id", "net").orderBy("node", "other", "other_node", "cc")
    return listed.withColumn("place", F.row_number().over(by).cast("long"))
