"""Switching activity: state carried along ordered value changes, toggles, windows and rates.

A value change is a row (net, seq, tick, value). Toggles are changes between consecutive known levels in file order (seq), several
at one tick included; unknown values neither count nor become the level compared with. State is carried over blocks of rows with one
summary row per net and block, so a clock with most of the rows is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions.names import resolve

BLOCK = 1 << 16
MOST_WINDOWS = 100_000
FEMTO = 1e-15


def level(value: Column | str) -> Column:
    """0 or 1 of a nine-state character, null for the others."""
    c = F.lower(F.col(value) if isinstance(value, str) else value)
    return F.when(c.isin("0", "l"), 0).when(c.isin("1", "h"), 1)


def _order(rows: DataFrame, seq: str, block: int | None) -> tuple[Column, list[Column]]:
    """The block of a row and what it is sorted by: seq is a number, or a struct whose first field, such as the start of a file's split,
    is the block."""
    kind = rows.schema[seq].dataType
    if hasattr(kind, "fields"):
        return F.col(f"{seq}.{kind.fields[0].name}"), [F.col(f"{seq}.{f.name}") for f in kind.fields]
    return F.floor(F.col(seq) / (block or BLOCK)), [F.col(seq)]


def carried(rows: DataFrame, key: list[str], seq: str, value: Column, name: str, block: int | None = None) -> DataFrame:
    """rows with `name`: the last known `value` before the row, within its key, in the order of seq."""
    at, order = _order(rows, seq, block)
    r = rows.withColumn("_v", value).withColumn("_b", at)
    inside = Window.partitionBy(*key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = r.filter("_v is not null").groupBy(*key, "_b").agg(F.max_by("_v", seq).alias("_last"))
    # a row per key and block, with the last value it knows
    every = r.select(*key, "_b").distinct().join(ends, [*key, "_b"], "left")
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).select(*key, "_b", "_carry")
    out = r.withColumn("_in", F.last("_v", ignorenulls=True).over(inside)).join(every, [*key, "_b"])
    return out.withColumn(name, F.coalesce("_in", "_carry")).drop("_v", "_b", "_in", "_carry")


def running(rows: DataFrame, key: list[str], seq: str, value: Column, name: str, block: int | None = None) -> DataFrame:
    """rows with `name`: the sum of `value` up to and with the row, within its key, in the order of seq; by blocks as carried()."""
    at, order = _order(rows, seq, block)
    r = rows.withColumn("_v", value).withColumn("_b", at)
    inside = Window.partitionBy(*key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    every = r.groupBy(*key, "_b").agg(F.sum("_v").alias("_sum")).withColumn("_front", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    return r.withColumn("_in", F.sum("_v").over(inside)).join(every, [*key, "_b"]).withColumn(name, F.col("_in") + F.col("_front")).drop("_v", "_b", "_in", "_front")


def toggles(changes: DataFrame, key: list[str] | None = None, block: int | None = None) -> DataFrame:
    """changes with toggle: 1 where the known level differs from the last known one."""
    key = key or ["net"]
    out = carried(changes.withColumn("level", level("value")), key, "seq", F.col("level"), "prev", block)
    return out.withColumn("toggle", F.coalesce((F.col("level") != F.col("prev")).cast("long"), F.lit(0).cast("long"))).drop("prev")


def toggle_count(changes: DataFrame, key: list[str] | None = None, block: int | None = None) -> DataFrame:
    key = key or ["net"]
    return toggles(changes, key, block).groupBy(*key).agg(F.sum("toggle").alias("n_toggles"))


def pad_bits(bits: Column, width: Column) -> Column:
    """A vector value at its full width: x and z are repeated to the left, others get 0."""
    fill = F.when(F.lower(F.substring(bits, 1, 1)).isin("x", "z"), F.substring(bits, 1, 1)).otherwise("0")
    long = F.concat(F.repeat(fill, F.greatest(width - F.length(bits), F.lit(0))), bits)
    return F.substring(long, F.greatest(F.length(long) - width + 1, F.lit(1)), width)


def vector_bits(changes: DataFrame) -> DataFrame:
    """Vector changes (net, seq, tick, value, width) as changes of single bits, bit 0 being the last character."""
    w = F.col("width").cast("int")
    chars = F.split(pad_bits(F.col("value"), w), "")
    b = changes.select(*[c for c in changes.columns if c not in ("value", "width")], w.alias("_w"), F.posexplode(chars).alias("_p", "value"))
    return b.withColumn("bit", (F.col("_w") - 1 - F.col("_p")).cast("long")).drop("_w", "_p")


def real_changes(changes: DataFrame, key: list[str] | None = None, block: int | None = None) -> DataFrame:
    """Number of textual changes of real values: the first is where it starts from."""
    key = key or ["net"]
    c = carried(changes, key, "seq", F.col("value"), "prev", block)
    return c.groupBy(*key).agg(F.sum(F.coalesce((F.col("value") != F.col("prev")).cast("long"), F.lit(0).cast("long"))).alias("n_changes"))


def snap(x: Column) -> Column:
    """x, or the whole number within 1e-9 of it."""
    r = F.round(x)
    return F.when(F.abs(x - r) <= 1e-9 * F.greatest(F.abs(r), F.lit(1.0)), r).otherwise(x)


def n_windows(start: float, end: float, window: float, step: float) -> int:
    """Windows of a bounded sweep; bad or too many windows are refused."""
    if not all(map(math.isfinite, (start, end, window, step))) or window <= 0 or step <= 0 or end <= start:
        raise ValueError("a sweep needs finite bounds, end after start, and window and step above 0")
    x = (end - start) / step
    r = round(x)
    n = max(1, math.ceil(r if abs(x - r) <= 1e-9 * max(abs(r), 1) else x))
    if n > MOST_WINDOWS:
        raise ValueError(f"{n} windows; at most {MOST_WINDOWS}")
    return n


def in_windows(rows: DataFrame, start: float, window: float, step: float, n: int | None = None, end: float | None = None) -> DataFrame:
    """rows once for each window [start + i step, + window) that holds their tick: index arithmetic, no range join."""
    rel = F.col("tick").cast("double") - start
    hi = F.floor(snap(rel / step))
    lo = F.greatest(F.lit(0), F.floor(snap((rel - window) / step)) + 1)
    if n is not None:
        hi = F.least(hi, F.lit(n - 1))
    r = rows.filter(rel >= 0)
    if end is not None:
        r = r.filter(F.col("tick") < end)
    r = r.withColumn("_lo", lo.cast("long")).withColumn("_hi", hi.cast("long")).filter("_lo <= _hi")
    return r.withColumn("win", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def window_toggles(changes: DataFrame, start: float, end: float | None = None, key: list[str] | None = None) -> DataFrame:
    """Toggles of [start, end), the last tick included where no end is given; state is taken from all rows before."""
    key = key or ["net"]
    t = toggles(changes, key).filter(F.col("tick") >= start)
    if end is not None:
        t = t.filter(F.col("tick") < end)
    return t.groupBy(*key).agg(F.sum("toggle").alias("n_toggles"), F.count("*").alias("n_events"))


def sweep(changes: DataFrame, start: float, end: float, window: float, step: float, key: list[str] | None = None) -> DataFrame:
    """win, key, n_toggles, n_events for tumbling (step = window), hopping (step < window) and gapped (step > window) sweeps."""
    key = key or ["net"]
    n = n_windows(start, end, window, step)
    return in_windows(toggles(changes, key), start, window, step, n, end).groupBy("win", *key).agg(F.sum("toggle").alias("n_toggles"), F.count("*").alias("n_events"))


def sweep_bounds(spark, start: float, end: float, window: float, step: float, dump_end: float, tick_s: float) -> DataFrame:
    """Every window with its bounds, clamped to the dump, and its duration in seconds; under 1 fs counts as 0."""
    n = n_windows(start, end, window, step)
    w = spark.range(n).select(F.col("id").alias("win"), (F.lit(start) + F.col("id") * step).alias("lo"))
    w = w.withColumn("hi", F.least(F.col("lo") + window, F.lit(float(end)), F.lit(float(dump_end)))).withColumn("lo", F.least("lo", F.lit(float(dump_end))))
    span = F.greatest(F.lit(0.0), F.col("hi") - F.col("lo")) * tick_s
    return w.withColumn("seconds", F.when(span < FEMTO, F.lit(0.0)).otherwise(span))


def fold_tail(counts: DataFrame, bounds: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Counts of windows without duration at the end go to the last one that has some, so windows share out all toggles."""
    key = key or ["net"]
    last = bounds.agg(F.coalesce(F.max(F.when(F.col("seconds") > 0, F.col("win"))), F.lit(0)).alias("_last"))
    c = counts.crossJoin(F.broadcast(last))  # one row
    return c.withColumn("win", F.least("win", "_last")).groupBy("win", *key).agg(F.sum("n_toggles").alias("n_toggles"), F.sum("n_events").alias("n_events"))


def every_window(counts: DataFrame, bounds: DataFrame, nets: DataFrame, key: list[str] | None = None) -> DataFrame:
    """counts with a row for every window of the sweep and every net, 0 where nothing happened. nets holds the key once a net; windows are
    at most MOST_WINDOWS."""
    key = key or ["net"]
    grid = nets.select(*key).crossJoin(F.broadcast(bounds.select("win")))  # the result has a row for each of these pairs
    return grid.join(counts, ["win", *key], "left").fillna(0, ["n_toggles", "n_events"])


def window_rates(nets: DataFrame, counts: DataFrame, bounds: DataFrame, scope: str = "", key: str = "path") -> DataFrame:
    """nets (net) with the rate of the path each resolves to in every window: toggles a second, 0 where nothing happened, the window has no
    duration or the net is unresolved. counts: win, path, n_toggles."""
    r = resolve(nets, counts.select(F.col(key).alias("path")).distinct(), scope).crossJoin(F.broadcast(bounds.select("win", "seconds")))
    c = r.join(counts.withColumnRenamed(key, "path").select("win", "path", "n_toggles"), ["win", "path"], "left")
    return c.select("win", "net", "path", F.coalesce(F.try_divide(F.col("n_toggles").cast("double"), F.nullif("seconds", F.lit(0.0))), F.lit(0.0)).alias("rate"))


def rates(nets: DataFrame, counts: DataFrame, seconds: Column, scope: str = "") -> DataFrame:
    """nets (net) with the rate of the path each resolves to: toggles a second, 0 where unresolved or without duration."""
    r = resolve(nets, counts.select("path"), scope)
    c = r.join(counts, "path", "left")
    return c.select("net", "path", F.coalesce(F.try_divide(F.col("n_toggles").cast("double"), F.nullif(seconds, F.lit(0.0))), F.lit(0.0)).alias("rate"))
