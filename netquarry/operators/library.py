"""Cell libraries: table lookup, pin and cell properties, equivalence and drive ladders, current-source waveforms, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.core import materialise, n_partitions, numbered, salted_join, sorted_side


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _place(grid: Column, v: Column) -> tuple[Column, Column]:
    """Lower grid index and fraction of v on an ascending axis, held to the ends; a value on a grid point lies in the cell below it."""
    n = F.size(grid)
    k = F.greatest(F.lit(0), F.least(n - 2, F.size(F.filter(grid, lambda x: x < v)) - 1))
    a, b = F.get(grid, k), F.get(grid, k + 1)
    f = F.when(n < 2, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(v - a, b - a), F.lit(0.0)))
    return k, F.greatest(F.lit(0.0), F.least(F.lit(1.0), f))


def lookup(index_1: Column | str, index_2: Column | str, values: Column | str, slew: Column | str, load: Column | str) -> Column:
    """Bilinear lookup, held at the edges. No values give 0, an axis that is missing the first value, an axis of one point that point;
    ragged rows null."""
    i1, i2, v, s, c = map(_c, (index_1, index_2, values, slew, load))
    r, fr = _place(i1, s)
    k, fk = _place(i2, c)
    at = lambda i, j: F.get(F.get(v, i), j)
    none = lambda x: F.coalesce(F.size(x), F.lit(0)) <= 0
    one1, one2 = F.size(i1) < 2, F.size(i2) < 2
    r2, k2 = F.when(one1, r).otherwise(r + 1), F.when(one2, k).otherwise(k + 1)
    low = at(r, k) + (at(r, k2) - at(r, k)) * fk
    high = at(r2, k) + (at(r2, k2) - at(r2, k)) * fk
    return F.when(none(v), F.lit(0.0)).when(none(i1) | none(i2), at(F.lit(0), F.lit(0))).otherwise(low + (high - low) * fr)


def constraint(rise: Column, fall: Column) -> Column:
    """A constraint is the worse of its two edges."""
    return F.greatest(rise, fall)


def slew_span(rise_lo: Column, rise_hi: Column, fall_lo: Column, fall_hi: Column) -> Column:
    """Mean part of the swing between slew thresholds (percent); 0.6 unless it lies in (0, 1]."""
    s = ((_c(rise_hi) - _c(rise_lo)) + (_c(fall_hi) - _c(fall_lo))) / 200.0
    return F.when((s > 0) & (s <= 1), s).otherwise(F.lit(0.6))


def constant_output(direction: Column | str, function: Column | str) -> Column:
    d, f = _c(direction), F.trim(F.trim(F.trim(_c(function)), F.lit('"')))
    return F.coalesce(d.isin("output", "inout") & f.isin("0", "1"), F.lit(False))


def mean_of(grid: Column | str) -> Column:
    """Mean of a grid of values; null for an empty one."""
    flat = F.flatten(_c(grid))
    return F.when(F.size(flat) > 0, F.aggregate(flat, F.lit(0.0), lambda a, x: a + x) / F.size(flat))


def mean_known(*values: Column) -> Column:
    a = F.filter(F.array(*values), lambda x: x.isNotNull())
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def receiver_load(c1_rise: Column, c1_fall: Column, c2_rise: Column, c2_fall: Column) -> Column:
    """Mean over edges of the mean over segments of each table's mean, empty tables left out; 0 if all are."""
    edge = lambda a, b: mean_known(mean_of(a), mean_of(b))
    return F.coalesce(mean_known(edge(c1_rise, c2_rise), edge(c1_fall, c2_fall)), F.lit(0.0))


def load_cap(receiver: Column, static: Column) -> Column:
    return F.when(_c(receiver) > 0, _c(receiver)).otherwise(_c(static))


def state_leakage(groups: DataFrame, key: list[str]) -> DataFrame:
    """Leakage of a cell: what belongs to one state adds up, and states are averaged; each value without a condition is a state of its own."""
    states = groups.filter("value is not null").groupBy(*key, "state").agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    own = F.when(F.col("state").isNull(), F.col("n")).otherwise(F.lit(1))
    return states.groupBy(*key).agg((F.sum("v") / F.sum(own)).alias("leakage"))


def internal_energy(tables: DataFrame, key: list[str], values: str, unit: float = 1.0) -> DataFrame:
    """Mean magnitude of every number of a cell's energy tables."""
    return tables.select(*key, F.explode(F.flatten(values)).alias("x")).groupBy(*key).agg((F.avg(F.abs("x")) * unit).alias("energy"))


def signatures(pins: DataFrame) -> DataFrame:
    """cell -> signature of pin names, directions and functions; has_function tells if any is known."""
    p = F.struct("pin", "direction", F.regexp_replace(F.coalesce("function", F.lit("")), r"\s", "").alias("function"))
    return pins.groupBy("cell").agg(F.array_sort(F.collect_set(p)).alias("signature"), F.max(F.col("function").isNotNull()).alias("has_function"))


def classes(cells: DataFrame) -> DataFrame:
    """cells (cell, footprint, is_seq, area, signature, has_function) -> cell, area, rule, class_id, has_footprint: one row for each class a
    cell belongs to, at most two.

    Two cells can stand for each other if they share a footprint class, or share a function class and not both have a footprint: where
    both have one it decides. A sequential cell or one without functions is in no function class; a cell in no class stands for itself.
    The classes hold the whole relation; its pairs are written out only for candidates, which need them."""
    foot, plain = F.col("footprint").isNotNull(), ~F.col("is_seq") & F.col("has_function")
    sig = F.md5(F.to_json("signature"))
    rows = F.array(F.when(foot, F.struct(F.lit("footprint").alias("rule"), F.concat(F.lit("f:"), "footprint").alias("k"))), F.when(plain, F.struct(F.lit("function").alias("rule"), F.concat(F.lit("s:"), sig).alias("k"))), F.when(~foot & ~plain, F.struct(F.lit("self").alias("rule"), F.concat(F.lit("c:"), F.col("cell").cast("string")).alias("k"))))
    each = cells.select("cell", F.coalesce("area", F.lit(0.0)).alias("area"), foot.alias("has_footprint"), F.inline(F.filter(rows, lambda x: x.isNotNull())))
    first = each.groupBy("k").agg(F.min("cell").alias("class_id"))
    return salted_join(each, sorted_side(first), ["k"], by=F.col("cell"))


#: Numbers in a block of the ladder.
BLOCK = 4096


def _block(n: str) -> Column:
    return F.floor(F.col(n) / BLOCK)


def _in_blocks(spans: DataFrame, lo: str, hi: str) -> DataFrame:
    """Spans of numbers, each once for each block it touches: no more rows than there are spans and blocks, and no join key with more than BLOCK numbers."""
    return sorted_side(spans.withColumn("_block", F.explode(F.sequence(_block(lo), _block(hi)))))


def ladder(classes: DataFrame) -> DataFrame:
    """classes with place (by area, then name), n_cells, n_smaller, n_larger, and the nearest of both, next_smaller and next_larger.

    Cells are numbered over all tasks in the order of their classes, so a class with a third of them is no group of one task. What a cell
    learns is found once for each step, the cells of a class with one area, and joined to the cells by blocks of their numbers."""
    n = materialise(numbered(classes, ["k", "area", "cell"]), "ladder")
    step = materialise(n.groupBy("k", "area").agg(F.min("n").alias("_lo"), F.max("n").alias("_hi"), F.min_by("cell", "n").alias("_head")), "steps")
    whole = step.groupBy("k").agg(F.min("_lo").alias("_first"), F.max("_hi").alias("_last"))
    larger = step.select("k", (F.col("_lo") - 1).alias("_hi"), F.col("_head").alias("next_larger"))  # of the nearest area the first name
    smaller = step.select("k", (F.col("_hi") + 1).alias("_lo"), F.col("_head").alias("next_smaller"))
    steps = step.drop("_head").join(sorted_side(larger), ["k", "_hi"], "left").join(sorted_side(smaller), ["k", "_lo"], "left")
    steps = steps.withColumn("_block", _block("_lo")).join(_in_blocks(whole, "_first", "_last"), ["k", "_block"]).drop("_block")
    out = n.withColumn("_block", _block("n")).join(_in_blocks(steps, "_lo", "_hi"), ["k", "area", "_block"])
    return out.select(
        "cell", "rule", "class_id", "has_footprint", (F.col("n") - F.col("_first") + 1).alias("place"), (F.col("_last") - F.col("_first") + 1).alias("n_cells"),
        (F.col("_lo") - F.col("_first")).alias("n_smaller"), (F.col("_last") - F.col("_hi")).alias("n_larger"), "next_smaller", "next_larger",
    )


def upsizes(ladder: DataFrame) -> DataFrame:
    """Of each cell and class how many larger cells there are, and the nearest; the candidates themselves are in upsize_candidates."""
    return ladder.filter("n_larger > 0").select("cell", "rule", "class_id", "n_larger", "next_larger")


def downsizes(ladder: DataFrame) -> DataFrame:
    """Of each cell and class how many smaller cells there are, and the nearest; the candidates themselves are in downsize_candidates."""
    return ladder.filter("n_smaller > 0").select("cell", "rule", "class_id", "n_smaller", "next_smaller")


#: Pairs that a task compares, about; no join key has more than BLOCK * BLOCK.
PAIRS = 8_000_000


def _pairs(classes: DataFrame) -> DataFrame:
    """All pairs of cells that can stand for each other and differ in area: rule, class_id, cell and area of the small and of the large one.

    In a function class two cells with footprints are no pair, as their footprints decide. An area that is no number is neither larger nor
    smaller. Cells are numbered in the order of their classes, and a block of numbers meets each block of its class behind it under a key
    of its own, so a class with a third of the cells is the work of many tasks, whose number follows that of the pairs."""
    n = materialise(numbered(classes.filter(~F.isnan("area")), ["k", "area", "cell"]), "ladder")
    whole = materialise(n.groupBy("k").agg(F.min("n").alias("_first"), F.max("n").alias("_last")), "whole")
    cells = F.col("_last") - F.col("_first") + 1.0
    tasks = int((whole.agg(F.sum(cells * cells / 2)).first()[0] or 0) // PAIRS) + n_partitions(classes.sparkSession)  # one row
    each = n.withColumn("_block", _block("n")).join(_in_blocks(whole, "_first", "_last"), ["k", "_block"])
    key, of = ["k", "_of", "_to"], ["cell", "area", "has_footprint"]
    small = each.select("k", "rule", "class_id", *[F.col(c).alias(f"small_{c}") for c in of], F.col("_block").alias("_of"), F.explode(F.sequence("_block", _block("_last"))).alias("_to"))
    large = each.select("k", *[F.col(c).alias(f"large_{c}") for c in of], F.explode(F.sequence(_block("_first"), "_block")).alias("_of"), F.col("_block").alias("_to"))
    both = small.repartition(tasks, *key).join(sorted_side(large.repartition(tasks, *key)), key)
    decided = (F.col("rule") == "footprint") | ~(F.col("small_has_footprint") & F.col("large_has_footprint"))
    return both.filter((F.col("small_area") < F.col("large_area")) & decided)


def upsize_candidates(classes: DataFrame) -> DataFrame:
    """Every larger cell that can stand for a cell, one row each with its area; their order is that of area, then candidate."""
    return _pairs(classes).select(F.col("small_cell").alias("cell"), "rule", "class_id", F.col("large_cell").alias("candidate"), F.col("large_area").alias("area"))


def downsize_candidates(classes: DataFrame) -> DataFrame:
    """Every smaller cell that can stand for a cell, one row each with its area; their order is that of area, then candidate."""
    return _pairs(classes).select(F.col("large_cell").alias("cell"), "rule", "class_id", F.col("small_cell").alias("candidate"), F.col("small_area").alias("area"))


def merge(cells: DataFrame, key: str = "cell", order: str = "lib_id") -> DataFrame:
    """Libraries merged: of each cell the first library's."""
    rest = [c for c in cells.columns if c != key]
    return cells.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*").select(*cells.columns)


def merged_voltage(libs: DataFrame, order: str = "lib_id") -> DataFrame:
    """One row, voltage: the first library's that is not 0, in the order of loading; 0 if all are."""
    return libs.agg(F.coalesce(F.min_by("voltage", F.when(F.col("voltage") != 0, F.col(order))), F.lit(0.0)).alias("voltage"))


# Names of a library's thresholds as they are declared, in percent, and what holds where one is not or lies outside 0 to 100.
THRESHOLDS = {
    "slew_lower_threshold_pct_rise": 20.0, "slew_upper_threshold_pct_rise": 80.0, "slew_lower_threshold_pct_fall": 20.0, "slew_upper_threshold_pct_fall": 80.0,
    "input_threshold_pct_rise": 50.0, "input_threshold_pct_fall": 50.0, "output_threshold_pct_rise": 50.0, "output_threshold_pct_fall": 50.0,
}


def thresholds(declared: Column | str) -> Column:
    """map(name, percent) as declared -> struct of fractions, with slew_derate (1 unless it is above 0) and slew_span."""
    d = _c(declared)

    def part(name: str, otherwise: float) -> Column:
        v = F.try_element_at(d, F.lit(name))
        return (F.when((v >= 0) & (v <= 100), v).otherwise(F.lit(otherwise)) / 100.0).alias(name.replace("_threshold_pct", ""))

    parts = [part(n, v) for n, v in THRESHOLDS.items()]
    derate = F.try_element_at(d, F.lit("slew_derate_from_library"))
    one = lambda n: part(n, THRESHOLDS[n]) * 100.0
    span = slew_span(*[one(f"slew_{e}_threshold_pct_{s}") for s in ("rise", "fall") for e in ("lower", "upper")])
    return F.struct(*parts, F.when(derate > 0, derate).otherwise(F.lit(1.0)).alias("slew_derate"), span.alias("slew_span"))


def ceff(c1: Column, c2: Column, tau: Column, t: Column) -> Column:
    """Effective capacitance of a pi load over a time t: the far part counts as far as it charges; all of it without a resistance."""
    c1, c2, tau, t = map(_c, (c1, c2, tau, t))
    c2 = F.greatest(c2, F.lit(0.0))
    x = t / F.nullif(tau, F.lit(0.0))
    part = 1.0 - (1.0 - F.exp(-x)) / x
    return F.when((c2 <= 0) | (tau <= 0) | (t <= 0), c1 + c2).otherwise(c1 + c2 * part)


def ceff_fixpoint(c1: Column, c2: Column, tau: Column, slew_of, rounds: int = 8, tol: float = 1e-5) -> Column:
    """ceff for the slew at ceff itself: at most `rounds` steps, ended once two differ by less than tol (pF)."""
    total = _c(c1) + F.greatest(_c(c2), F.lit(0.0))
    start = F.struct(total.alias("c"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        new = ceff(c1, c2, tau, slew_of(s["c"]))
        return F.when(s["done"], s).otherwise(F.struct(new.alias("c"), (F.abs(new - s["c"]) < tol).alias("done")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)["c"]


def waveform_delay(time: Column | str, current: Column | str, c_load: Column | str, ref_time: Column | str, lo: float = 0.2, hi: float = 0.8) -> Column:
    """struct(delay, slew) of a current waveform into a load: charge by trapezoids gives the voltage, whose shares of its final value
    are timed: half of it less the reference time, and from lo to hi. Neither is below 0; no waveform or load gives 0."""

    @F.udf("struct<delay:double,slew:double>", useArrow=True)
    def run(t, i, c, ref):
        import numpy as np

        none = {"delay": 0.0, "slew": 0.0}
        if t is None or i is None or len(t) < 2 or len(t) != len(i) or not c or c <= 0:
            return none
        t, i = np.asarray(t, float), np.asarray(i, float)
        v = np.concatenate([[0.0], np.cumsum(0.5 * (i[1:] + i[:-1]) * np.diff(t) / c)])
        if v[-1] <= 0:
            return none

        def at(share: float) -> float:
            k = 1 + int(np.argmax(v[1:] >= share * v[-1]))
            rise = v[k] - v[k - 1]
            return t[k - 1] + (t[k] - t[k - 1]) * ((share * v[-1] - v[k - 1]) / rise if rise > 0 else 0.0)

        return {"delay": max(0.0, float(at(0.5) - (ref or 0.0))), "slew": max(0.0, float(at(hi) - at(lo)))}

    return run(_c(time), _c(current), _c(c_load), _c(ref_time))


def nearest(points: DataFrame, waveforms: DataFrame, arc: list[str]) -> DataFrame:
    """points (arc, id, slew, load) with the waveform of their arc nearest in slew and load, each difference relative to the point's
    own value; the first of equals. waveforms: arc, ord, in_slew, out_cap, one for each grid point of an arc's tables."""
    off = lambda have, want: F.pow((F.col(have) - F.col(want)) / F.greatest(F.abs(want), F.lit(1e-9)), F.lit(2))
    d = off("in_slew", "slew") + off("out_cap", "load")
    return points.join(waveforms, arc).groupBy(*arc, "id").agg(F.min_by("ord", F.struct(d.alias("d"), F.col("ord"))).alias("ord"))
