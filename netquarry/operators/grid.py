"""Irregular readings onto a regular grid.

Each reading measures a span [from, to) of one series; the grid of a series has one slot per period of its step. A slot is
covered if its middle lies in the span of a usable reading. Gaps between covered slots are filled by a harmonic seasonal
regression with trend plus the residuals of the two observed endpoints, bridged linearly.

The normal equations are summed where the rows are, by series and block of slots, with the trend counted from the block's start; the
blocks are then moved to a common start and the system of each series is solved about its own mean, so large slot numbers cost no
precision. A reading weighs as many slots as it covers, and its features are their means over those slots. The ridge is relative to
each column. Of several periods each series takes the one with the least squared error.

Defined results: a reading is used if from, to and value are not null, to > from and value >= 0 (NaN is senseless); exact
duplicate readings count once; readings without a key or without a positive step for their key give nothing; an empty input gives an
empty grid; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.core import materialise, salted_join

BLOCK = 65_536  # slots; a series is worked on in blocks of so many


def _waves(slot: Column, period: float, harmonics: int, n: Column | None = None) -> list[Column]:
    """Cosine and sine of each harmonic at a slot, or their means over the n slots around it."""
    out = []
    for h in range(1, harmonics + 1):
        angle = F.pmod(slot, F.lit(period)) * (2 * math.pi * h / period)
        half = math.pi * h / period
        if n is None or abs(math.sin(half)) < 1e-9:
            damp = F.lit(1.0)
        else:
            damp = F.sin(F.pmod(n, F.lit(2.0 * period)) * half) / (n * math.sin(half))
        out += [F.cos(angle) * damp, F.sin(angle) * damp]
    return out


def slots(windows: DataFrame, steps: DataFrame, key: list[str], step_key: list[str], start: str, end: str, value: str, step: str) -> DataFrame:
    """The usable windows with lo and hi, the first and last slot whose middle they hold, and y, the value per period."""
    num = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    w = windows.filter(num(start) & num(end) & num(value) & (F.col(end) > F.col(start)) & (F.col(value) >= 0))
    for k in key:
        w = w.filter(F.col(k).isNotNull())
    w = w.select(*key, F.col(start).cast("double").alias("_f"), F.col(end).cast("double").alias("_t"), F.col(value).cast("double").alias("_v")).distinct()
    s = steps.filter(num(step) & (F.col(step) > 0)).groupBy(*step_key).agg(F.max(F.col(step).cast("double")).alias("_s"))
    w = salted_join(w, s, step_key, by=F.col("_f"))
    mid = lambda k: (k + 0.5) * F.col("_s")
    big = 1e15  # a slot beyond this can't be told from its neighbour in double precision
    lo0 = F.ceil(F.greatest(F.lit(-1.0), F.least(F.lit(big), F.col("_f") / F.col("_s") - 0.5))).cast("long")
    w = w.withColumn("_k", lo0)
    w = w.withColumn("lo", F.greatest(F.lit(0).cast("long"), F.when(mid(F.col("_k") - 1) >= F.col("_f"), F.col("_k") - 1).when(mid(F.col("_k")) < F.col("_f"), F.col("_k") + 1).otherwise(F.col("_k"))))
    hi0 = F.floor(F.greatest(F.lit(-2.0), F.least(F.lit(big), F.col("_t") / F.col("_s") - 0.5))).cast("long")
    w = w.withColumn("_k", hi0)
    # the middle must lie before the end: the last slot strictly below it
    w = w.withColumn("hi", F.when(mid(F.col("_k") + 1) < F.col("_t"), F.col("_k") + 1).when(mid(F.col("_k")) < F.col("_t"), F.col("_k")).otherwise(F.col("_k") - 1))
    w = w.filter(F.col("hi") >= F.col("lo"))
    return w.select(*key, "lo", "hi", (F.col("_v") * F.col("_s") / (F.col("_t") - F.col("_f"))).alias("y"))


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _solve(n: np.ndarray, p: int, periods: int, ridge: float) -> np.ndarray:
    """Per series [mean of the trend, number of the best period, coefficients of 1, trend and waves]; NaN if nothing can be solved."""
    out = np.full((len(n), 2 + p), np.nan)
    least = np.full(len(n), np.inf)
    per = len(_pairs(p)) + p
    for k in range(periods):
        own = n[:, k * per : (k + 1) * per]
        a = np.zeros((len(n), p, p))
        for x, (i, j) in enumerate(_pairs(p)):
            a[:, i, j] = a[:, j, i] = own[:, x]
        b = own[:, len(_pairs(p)) :]
        ok = np.isfinite(own).all(1) & (a[:, 0, 0] > 0)
        a[~ok], b = np.eye(p), np.where(ok[:, None], b, 0.0)
        mean = a[:, 0, 1] / a[:, 0, 0]
        move = np.broadcast_to(np.eye(p), a.shape).copy()  # the trend about its mean
        move[:, 1, 0] = -mean
        a, b = move @ a @ move.transpose(0, 2, 1), (move @ b[:, :, None])[..., 0]
        d = np.sqrt(np.maximum(np.einsum("nii->ni", a), 0.0))
        d = np.where(d > 1e-9 * d.max(1, keepdims=True), d, np.inf)  # a column that never varies takes no part
        scaled = a / d[:, :, None] / d[:, None, :] + ridge * np.eye(p)
        c = np.linalg.solve(scaled, (b / d)[:, :, None])[..., 0] / d
        error = n[:, -1] - 2 * (c * b).sum(1) + np.einsum("ni,nij,nj->n", c, a, c)
        better = ok & np.isfinite(c).all(1) & (error < least - 1e-9 * np.abs(least) if k else np.ones(len(n), bool))
        least = np.where(better, error, least)
        out[better] = np.column_stack([mean, np.full(len(n), float(k)), c])[better]
    return out


def fit(blocks: DataFrame, key: list[str], p: int, periods: int, ridge: float = 1e-9) -> DataFrame:
    """blocks (key, block, sums) -> one row per series: first block, coef = [mean of the trend, number of the period, coefficients]."""
    per = len(_pairs(p)) + p
    moved = blocks.withColumn("_d", ((F.col("block") - F.col("first")) * BLOCK).cast("double"))
    at = lambda i: F.get("sums", F.lit(i))
    sums, d = [], F.col("_d")
    for k in range(periods):
        place = {ij: k * per + x for x, ij in enumerate(_pairs(p))}
        for i, j in _pairs(p):
            if (i, j) == (1, 1):
                sums.append(at(place[1, 1]) + 2 * d * at(place[0, 1]) + d * d * at(place[0, 0]))
            elif 1 in (i, j):  # trend times another feature
                other = i if j == 1 else j
                sums.append(at(place[i, j]) + d * at(place[0, other]))
            else:
                sums.append(at(place[i, j]))
        rhs = k * per + len(_pairs(p))
        sums += [at(rhs + i) + (d * at(rhs) if i == 1 else F.lit(0.0)) for i in range(p)]
    sums.append(at(periods * per))
    normal = moved.groupBy(*key).agg(F.min("first").alias("first"), F.array(*[F.sum(x) for x in sums]).alias("normal"))

    @F.pandas_udf("array<double>")
    def solve(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            got = _solve(np.stack([np.asarray(v, dtype=float) for v in s]), p, periods, ridge) if len(s) else []
            yield pd.Series([None if np.isnan(x[0]) else x for x in got], dtype=object)

    return normal.select(*key, "first", solve("normal").alias("coef"))


def _predict(slot: Column, periods: tuple[float, ...], harmonics: int) -> Column:
    at = lambda i: F.get("coef", F.lit(i))
    out = None
    for k, period in enumerate(periods):
        x = [F.lit(1.0), slot - F.col("first") * BLOCK - at(0), *_waves(slot, period, harmonics)]
        one = sum((at(2 + i) * f for i, f in enumerate(x)), F.lit(0.0))
        out = F.when(at(1) == k, one) if out is None else out.when(at(1) == k, one)
    return out


def blocks_of(spans: DataFrame, key: list[str], periods: tuple[float, ...], harmonics: int) -> DataFrame:
    """One row per series and block of slots: best, the reading that reaches farthest, the sums of the normal equations with the trend
    counted from the block's start, first, the series' first block, and carry, the best of the blocks before."""
    n = (F.col("hi") - F.col("lo") + 1).cast("double")
    mid = (F.col("lo") + F.col("hi")) / 2.0
    sums = []
    for period in periods:
        x = [F.lit(1.0), mid - F.floor(F.col("lo") / BLOCK) * BLOCK, *_waves(mid, period, harmonics, n)]
        sums += [F.sum(n * x[i] * x[j]) for i, j in _pairs(len(x))] + [F.sum(n * x[i] * F.col("y")) for i in range(len(x))]
    sums.append(F.sum(n * F.col("y") * F.col("y")))
    block = spans.groupBy(*key, F.floor(F.col("lo") / BLOCK).alias("block")).agg(F.max(F.struct("hi", "y")).alias("best"), F.array(*sums).alias("sums"))
    series = Window.partitionBy(*key)
    before = series.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return block.withColumn("first", F.min("block").over(series)).withColumn("carry", F.max("best").over(before))


def gaps(spans: DataFrame, blocks: DataFrame, key: list[str]) -> DataFrame:
    """The runs of uncovered slots [gap_lo, gap_hi] between covered ones, with the values at both ends.

    The running maximum of hi is taken within blocks of slots and carried from block to block, so no task holds a series."""
    s = spans.withColumn("block", F.floor(F.col("lo") / BLOCK))
    best = F.struct("hi", "y")
    inside = Window.partitionBy(*key, "block").orderBy("lo", "hi", "y").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_in", F.max(best).over(inside)).join(blocks.select(*key, "block", "carry"), [*key, "block"])
    s = s.withColumn("prev", F.greatest("_in", "carry"))
    return s.filter(F.col("lo") > F.col("prev.hi") + 1).select(*key, (F.col("prev.hi") + 1).alias("gap_lo"), (F.col("lo") - 1).alias("gap_hi"), F.col("prev.y").alias("y_left"), F.col("y").alias("y_right"))


def _each(lo: Column, hi: Column, chunk: int = 8192) -> tuple[Column, Column]:
    """Two explodes in a row, so that no array is longer than chunk or (hi - lo) / chunk."""
    return F.explode(F.sequence(lo, hi, F.lit(chunk).cast("long"))), F.explode(F.sequence(F.col("_c"), F.least(hi, F.col("_c") + (chunk - 1))))


#: Slots of a season, of which each series takes the one that fits best.
PERIODS = (24.0, 60.0)


def _fill(spans: DataFrame, key: list[str], periods: tuple[float, ...], harmonics: int) -> DataFrame:
    blocks = materialise(blocks_of(spans, key, periods, harmonics), "blocks")
    g = gaps(spans, blocks, key).join(fit(blocks, key, 2 + 2 * harmonics, len(periods)), key)
    outer, inner = _each(F.col("gap_lo"), F.col("gap_hi"))
    g = g.withColumn("_left", F.col("y_left") - _predict(F.col("gap_lo") - 1.0, periods, harmonics)).withColumn("_right", F.col("y_right") - _predict(F.col("gap_hi") + 1.0, periods, harmonics))
    g = g.withColumn("_c", outer).withColumn("slot", inner).withColumn("predicted", _predict(F.col("slot").cast("double"), periods, harmonics))
    share = (F.col("slot") - F.col("gap_lo") + 1.0) / (F.col("gap_hi") - F.col("gap_lo") + 2.0)
    g = g.withColumn("_value", F.col("predicted") + F.col("_left") + (F.col("_right") - F.col("_left")) * share)
    return g.filter("_value is not null").select(*key, "slot", "predicted", F.greatest(F.lit(0.0), "_value").alias("filled"))


def fill(windows: DataFrame, steps: DataFrame, key: list[str], step_key: list[str], start: str, end: str, value: str, step: str, periods: tuple[float, ...] = PERIODS, harmonics: int = 2) -> DataFrame:
    """The missing slots of each series that the regression gives a value: key, slot, predicted (the regression alone) and filled (with
    the bridged residuals, never below 0). One reading is enough for a fit, so no gap between readings goes without."""
    return _fill(materialise(slots(windows, steps, key, step_key, start, end, value, step), "spans"), key, periods, harmonics)


def covered(spans: DataFrame, key: list[str]) -> DataFrame:
    """key, slot, value: the mean over the readings that hold its middle."""
    outer, inner = _each(F.col("lo"), F.col("hi"))
    return spans.withColumn("_c", outer).withColumn("slot", inner).groupBy(*key, "slot").agg(F.avg("y").alias("value"))


def regular(windows: DataFrame, steps: DataFrame, key: list[str], step_key: list[str], start: str, end: str, value: str, step: str, periods: tuple[float, ...] = PERIODS, harmonics: int = 2) -> DataFrame:
    """One row per series and slot from the first to the last covered one: value, and missing where no usable reading measured it.

    A covered slot has the mean over the readings that hold its middle; a missing one has the filled value."""
    spans = materialise(slots(windows, steps, key, step_key, start, end, value, step), "spans")
    lost = _fill(spans, key, periods, harmonics).select(*key, "slot", F.col("filled").alias("value"), F.lit(True).alias("missing"))
    return covered(spans, key).withColumn("missing", F.lit(False)).unionByName(lost)
