"""Aggregates and windows over per-chunk series and event schedules."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_fraction_mean(df: DataFrame, key: str, value: str, fraction: float) -> DataFrame:
    """Mean of the largest max(1, round(n * fraction)) values of each key; nulls are left out."""
    kept = F.sort_array(F.collect_list(value), asc=False)
    n = F.greatest(F.lit(1), F.bround(F.size("_v") * F.lit(fraction)).cast("int"))
    rows = df.groupBy(key).agg(kept.alias("_v")).where(F.size("_v") > 0)
    return rows.select(key, F.aggregate(F.slice("_v", F.lit(1), n), F.lit(0.0), lambda a, x: a + x, lambda s: s / n).alias("top_mean"))


def quartile_block(i: str, n: Column) -> Column:
    """Quarter 0 to 3 of position i of n; the remainder belongs to the last."""
    return F.least(F.floor(F.col(i) / F.greatest(F.floor(n / 4), F.lit(1))), F.lit(3)).cast("long")


def trapezoid(values: Column) -> Column:
    """Area under values at unit spacing; below two values 0."""
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(n < 2, F.lit(0.0)).otherwise(total - (values[0] + F.element_at(values, -1)) / 2)


def _slopes_up_to(y: np.ndarray, t: float) -> int:
    """How many pairwise slopes of the series ``y`` are at most ``t``: the pairs that y - t*i puts in falling order or ties."""
    n = len(y)
    order = np.argsort(-(y - t * np.arange(n)), kind="stable")  # falling values; of equal ones the earlier is first
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    # pairs i < j with rank i < rank j, digit by digit of the rank: within those of equal higher digits a 0 comes before a 1
    total = 0
    for bit in reversed(range(max(1, int(n - 1).bit_length()))):
        one = rank >> bit & 1
        group = rank >> (bit + 1)
        at = np.argsort(group, kind="stable")
        g, o = group[at], one[at]
        zeros = np.cumsum(1 - o)
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        before = np.repeat((zeros - (1 - o))[start], np.diff(np.r_[start, n]))
        total += int(((zeros - before) * o).sum())
    return total


def _slopes_between(y: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """The slopes above ``lo`` and up to ``hi``: the pairs whose order the two lines change."""
    i = np.arange(len(y))
    order = np.argsort(-(y - lo * i), kind="stable")
    place = np.empty(len(y), np.int64)
    place[np.argsort(-(y - hi * i), kind="stable")] = i
    held: list[int] = []
    index: list[np.ndarray] = []
    who = np.empty(len(y), np.int64)
    who[place] = i  # by place at hi
    out = []
    for k in order:  # by place at lo; those held that lie behind at hi have changed with k
        at = bisect.bisect(held, place[k])
        if at < len(held):
            j = who[held[at:]]
            out.append((y[j] - y[k]) / (j - k))
        held.insert(at, int(place[k]))
    return np.concatenate(out) if out else np.empty(0)


def kth_slope(y: np.ndarray, k: int, seed: int = 0) -> float:
    """The ``k``-th smallest (from 0) of all pairwise slopes, without holding them all.

    An interval with the wanted slope is narrowed by slopes of drawn pairs,
    counting by inversions, until it holds few enough to be listed: n log n
    time a count and n memory.
    """
    n, rng = len(y), np.random.default_rng(seed)
    spread = float(np.abs(np.diff(y)).max()) * (n - 1) + 1.0
    lo, hi, below, up_to = -spread, spread, 0, n * (n - 1) // 2
    while up_to - below > 16 * n and hi - lo > 1e-12 * max(1.0, abs(lo), abs(hi)):
        a, b = rng.integers(0, n, 4 * n), rng.integers(0, n, 4 * n)
        s = (y[b] - y[a])[a != b] / (b - a)[a != b]
        s = np.sort(s[(s > lo) & (s < hi)])
        share = (k - below + 0.5) / (up_to - below)
        if len(s) >= 32:
            near = 2 * (share * (1 - share) / len(s)) ** 0.5 + 1 / len(s)
            cuts = [float(s[min(len(s) - 1, max(0, int((share + d) * len(s))))]) for d in (-near, near)]
        else:
            cuts = [lo + (hi - lo) / 2]
        for t in cuts:
            if lo < t < hi:
                c = _slopes_up_to(y, t)
                if c <= k:
                    lo, below = t, c
                else:
                    hi, up_to = t, c
    if up_to - below > 16 * n:  # so many slopes are equal
        return hi
    inside = np.sort(_slopes_between(y, lo, hi))
    return float(inside[min(max(k - below, 0), len(inside) - 1)]) if len(inside) else hi


def theil_sen(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, slope): median of all pairwise slopes of each key's series at unit spacing; null below two values.

    A key's series is held in one task, its pairs never are.
    """
    rows = df.select(key, F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"))

    def one(t: pa.Table) -> pa.Table:
        y = t.sort_by("_o")["_v"].to_numpy()
        pairs = len(y) * (len(y) - 1) // 2
        slope = (kth_slope(y, (pairs - 1) // 2) + kth_slope(y, pairs // 2)) / 2 if pairs else None
        return pa.table({key: t[key].slice(0, 1), "slope": pa.array([slope], pa.float64())})

    return rows.groupBy(key).applyInArrow(one, f"{key} {dict(df.dtypes)[key]}, slope double")


def ordered_values(df: DataFrame, key: str, order: str, value: str, name: str = "series") -> DataFrame:
    """One array a key, in order. Series are bounded by the length of a clip."""
    got = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(key).agg(got.alias(name)).withColumn(name, F.transform(name, lambda x: x["v"]))


def moments(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and population deviation from sum, sum of squares and count."""
    v = F.col(value)
    s = df.groupBy(key).agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.count(v).alias("n"))
    mean = F.col("s") / F.col("n")
    return s.select(key, "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def full_chunks(df: DataFrame, key: str, index: str, size: int = 33) -> DataFrame:
    """Rows of complete tumbling chunks by index; the incomplete tail is dropped."""
    chunk = F.floor(F.col(index) / size).cast("long")
    n = F.count(F.lit(1)).over(Window.partitionBy(key, "chunk"))
    return df.withColumn("chunk", chunk).withColumn("_n", n).where(F.col("_n") == size).drop("_n")


def even_offsets(length: Column, k: int) -> Column:
    """k offsets spread over a chunk; the middle one for k = 1."""
    if k == 1:
        return F.array(F.floor(length / 2).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (length - 1) / (k - 1)).cast("int"))


def rolling_mean(key: str, order: str, value: str, width: int) -> Column:
    """Trailing mean; null until the window is full."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - width, 0)
    return F.when(F.count(value).over(w) == width, F.avg(value).over(w))


def sustained_onset(df: DataFrame, key: str, order: str, value: str, width: int, sigmas: float = 2.0) -> DataFrame:
    """First index from which the rolling mean stays above the baseline for ``width`` steps.

    The baseline is the mean and population deviation of the first ``width``
    values. ``order`` counts from 0; keys without onset get null.
    """
    w = Window.partitionBy(key).orderBy(order)
    base = F.when(F.col(order) < width, F.col(value))
    all_ = Window.partitionBy(key)
    rows = df.withColumn("_r", rolling_mean(key, order, value, width))
    rows = rows.withColumn("_limit", F.avg(base).over(all_) + sigmas * F.stddev_pop(base).over(all_))
    rows = rows.withColumn("_up", F.coalesce((F.col("_r") > F.col("_limit")).cast("int"), F.lit(0)))
    ahead = w.rowsBetween(0, width - 1)
    hit = (F.min("_up").over(ahead) == 1) & (F.count(F.lit(1)).over(ahead) == width)
    return rows.withColumn("_hit", F.when(hit, F.col(order))).groupBy(key).agg(F.min("_hit").alias("onset"))


def expanding_slope_onset(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """First index from 2 on from which all expanding regression slopes are positive."""
    w = Window.partitionBy(key).orderBy(order)
    slope = F.regr_slope(value, order).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("_s", slope).where(F.col(order) >= 2).withColumn("_up", (F.col("_s") > 0).cast("int"))
    rest = w.rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn("_all", F.min("_up").over(rest)).groupBy(key).agg(F.min(F.when(F.col("_all") == 1, F.col(order))).alias("onset"))


def recovery_ratio(values: Column, last: int = 10) -> Column:
    """Mean of the last values over the maximum; null if too short or the maximum is 0."""
    tail = F.slice(values, F.greatest(F.size(values) - last + 1, F.lit(1)), F.lit(last))
    mean = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / last
    top = F.array_max(values)
    return F.when((F.size(values) >= last) & (top != 0), mean / top)


def islands(df: DataFrame, key: str, order: str, low: Column, least: int) -> DataFrame:
    """Half-open runs [start, stop) of at least ``least`` consecutive rows where ``low`` holds."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.withColumn("_low", low).where("_low").withColumn("_g", F.col(order) - F.row_number().over(w))
    runs = rows.groupBy(key, "_g").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("stop"))
    return runs.where(F.col("stop") - F.col("start") >= least).drop("_g")


def phase_profile(df: DataFrame, key: str, order: str, value: str, period: int) -> DataFrame:
    """Mean absolute step by phase; step i goes from i to i + 1."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.withColumn("_d", F.abs(F.lead(value).over(w) - F.col(value))).where("_d is not null")
    return rows.groupBy(key, F.pmod(order, F.lit(period)).cast("long").alias("phase")).agg(F.avg("_d").alias("step"))


def segment_bounds(df: DataFrame, key: str, start: str, stop: str, fps: float, frames: str) -> DataFrame:
    """Segments in order: each begins where the one before ended, the last ends with the clip; empty ones go."""
    w = Window.partitionBy(key).orderBy(start, stop)
    end = F.bround(F.col(stop) * fps).cast("long")
    rows = df.withColumn("_e", end).withColumn("lo", F.coalesce(F.lag("_e").over(w), F.lit(0)))
    rows = rows.withColumn("hi", F.when(F.lead(F.lit(1)).over(w).isNull(), F.col(frames)).otherwise(F.col("_e")))
    return rows.where("hi > lo").drop("_e")


def rollout_window(k: int | Column, frames: Column, window: int = 9, history: int = 19) -> tuple[Column, Column]:
    """(history, target) of section k on the timeline padded with ``history`` zeros before it."""
    padded = F.concat(F.array_repeat(F.lit(0).cast("long"), history), frames)
    k = F.lit(k) if isinstance(k, int) else k
    return F.slice(padded, k * window + 1, F.lit(history)), F.slice(padded, k * window + history + 1, F.lit(window))


def evicted(k: Column, frames: Column, window: int = 9, history: int = 19) -> tuple[Column, Column]:
    """(number of real frames, frames) that leave the history when the rollout moves on to section k."""
    valid = F.least(F.lit(window), F.greatest(F.lit(0), k * window - history))
    stop = k * window - history
    return valid, F.slice(frames, F.greatest(stop - valid, F.lit(0)) + 1, valid)


def edge_share(total: Column, ratio: float = 0.15, least: int = 1) -> Column:
    """Number of rows of a leading or trailing share, between ``least`` and the total."""
    return F.least(F.greatest(F.lit(least), F.floor(total * ratio)), total).cast("long")


def amplitude(values: Column, k: Column) -> Column:
    """Height of ``k`` whole waves over the array ``values``, by Goertzel's recursion: one pass with two numbers of state."""
    turn = 2 * F.cos(2 * math.pi * k / F.size(values))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    last = F.aggregate(values, zero, lambda s, x: F.struct((x + turn * s["a"] - s["b"]).alias("a"), s["a"].alias("b")))
    return F.sqrt(F.greatest(F.lit(0.0), last["a"] * last["a"] + last["b"] * last["b"] - turn * last["a"] * last["b"]))


#: The band that a peak is compared with lies between 1/100 and 1/5 of a wave a step.
BAND = ((1, 100), (1, 5))


def spectrum_ratio(df: DataFrame, key: str, order: str, value: str, period: int) -> DataFrame:
    """(key, ratio): how high the wave of ``period`` stands in each key's absolute steps, over the median height in ``BAND``.

    Null for fewer than three periods of steps, and where the band is empty or
    flat. Of two waves equally near the period the longer is taken. Each height
    is a row of its own, so the waves of one long series are worked out by many tasks.
    """
    (a, b), (c, d) = BAND
    rows = ordered_values(df, key, order, value, "_y")
    steps = F.zip_with(F.slice("_y", 2, F.size("_y")), F.slice("_y", 1, F.greatest(F.size("_y") - 1, F.lit(0))), lambda x, y: F.abs(x - y))
    rows = rows.select(key, steps.alias("_s")).withColumn("_n", F.size("_s"))
    long = rows.where(F.col("_n") >= 3 * period)
    mean = F.aggregate("_s", F.lit(0.0), lambda s, x: s + x) / F.col("_n")
    n = F.col("_n")
    floor = F.floor(n / period)
    # whole waves nearest n / period, the fewer of two equally near
    peak = F.least(F.when((floor + 1) * period - n < n - floor * period, floor + 1).otherwise(floor), F.floor(n / 2)).cast("int")
    long = long.select(key, "_n", F.transform("_s", lambda x: x - mean).alias("_s"), peak.alias("_peak"))
    waves = long.withColumn("_k", F.explode(F.sequence(F.lit(1), F.floor(n / 2).cast("int")))).where(F.col("_k").eqNullSafe(F.col("_peak")) | ((F.col("_k") * b > n * a) & (F.col("_k") * d < n * c)))
    high = waves.select(key, (F.col("_k") == F.col("_peak")).alias("_top"), ((F.col("_k") * b > n * a) & (F.col("_k") * d < n * c)).alias("_in"), amplitude(F.col("_s"), F.col("_k")).alias("_h"))
    out = high.groupBy(key).agg(F.max(F.when(F.col("_top"), F.col("_h"))).alias("_p"), F.median(F.when(F.col("_in"), F.col("_h"))).alias("_m"))
    return rows.select(key).join(out, key, "left").select(key, F.when(F.col("_m") > 0, F.col("_p") / F.col("_m")).alias("ratio"))


def boundary_stats(df: DataFrame, key: str, order: str, value: str, period: int) -> DataFrame:
    """How the steps across chunk borders, the last phase, compare with the other phases of their period.

    (key, boundary_ratio, phase_rank, top_phase, top_ratio): border over the mean of the others, number of phases at
    least as high, the highest phase (the first of equals) and its ratio. Keys with fewer than three periods have no row.
    """
    w = Window.partitionBy(key).orderBy(order)
    steps = df.select(key, (F.row_number().over(w) - 2).alias("_j"), F.abs(F.col(value) - F.lag(value).over(w)).alias("_d")).where("_j >= 0")
    phases = steps.groupBy(key, (F.col("_j") % period).alias("_p")).agg(F.avg("_d").alias("_m"), F.count(F.lit(1)).alias("_n"))
    every = phases.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_p", "_m"))).alias("_all"), F.sum("_n").alias("_steps"), F.sum("_m").alias("_sum")).where(F.col("_steps") >= 3 * period)
    means = F.transform("_all", lambda x: x["_m"])
    border, top = F.element_at(means, -1), F.array_max(means)
    over = lambda x: x / ((F.col("_sum") - x) / (period - 1))
    return every.select(
        key, over(border).alias("boundary_ratio"), F.size(F.filter(means, lambda m: m >= border)).cast("long").alias("phase_rank"),
        (F.array_position(means, top) - 1).alias("top_phase"), over(top).alias("top_ratio"),
    )


def moment_drift(moments: Column, rho_mean: float = 0.9, rho_var: float = 0.9, mean_limit: float = 0.15, var_limit: float = 0.15) -> Column:
    """Running means and variances of an ordered array of structs (mean, var), arrays both; a struct (mean, var, drifts).

    An entry drifts if its mean and its variance both lie farther from the running ones before it than their limits;
    the first starts them.
    """
    far = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    blend = lambda a, b, rho: F.zip_with(a, b, lambda x, y: x * rho + y * (1 - rho))

    def step(s: Column, x: Column) -> Column:
        drift = (far(x["mean"], s["mean"]) > mean_limit) & (far(x["var"], s["var"]) > var_limit)
        return F.struct(blend(s["mean"], x["mean"], rho_mean).alias("mean"), blend(s["var"], x["var"], rho_var).alias("var"), (s["drifts"] + F.when(drift, 1).otherwise(0)).alias("drifts"))

    first = F.get(moments, F.lit(0))
    start = F.struct(first["mean"].alias("mean"), first["var"].alias("var"), F.lit(0).alias("drifts"))
    return F.aggregate(F.slice(moments, F.lit(2), F.greatest(F.size(moments) - 1, F.lit(0))), start, step)


def sampled_theil_sen(df: DataFrame, key: str, order: str, value: str, cap: int = 4000, seed: int = 0) -> DataFrame:
    """theil_sen() of series of up to ``cap`` pairs; of longer ones the median slope of ``cap`` seeded pairs, self-pairs left out."""
    rows = ordered_values(df, key, order, value)
    n = F.size("series")
    at = lambda k, side: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), k.cast("string"), F.lit(side))), 1, 8), 16, 10).cast("long") % n).cast("int")
    slope = lambda a, b: F.when(a != b, (F.get("series", b) - F.get("series", a)) / (b - a))
    drawn = F.array_sort(F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda k: slope(at(k, "a"), at(k, "b")))))
    middle = lambda up: F.get("_s", F.floor((F.size("_s") - 1 + up) / 2).cast("int"))
    many = n * (n - 1) / 2 > cap
    sampled = rows.where(many).withColumn("_s", drawn).select(key, ((middle(0) + middle(1)) / 2).alias("slope"))
    few = rows.where(~many).select(key, F.posexplode("series").alias("_i", "_v"))
    return sampled.unionByName(theil_sen(few, key, "_i", "_v"))


def runaway(first: Column, third: Column, last: Column, n: Column) -> Column:
    """Does the last quarter exceed twice the first without falling below the third? No below four values or on a first of zero."""
    grew = (last / F.nullif(first, F.lit(0.0)) > 2) & (last >= third)
    return F.when((n < 4) | (first == 0), F.lit(False)).otherwise(F.coalesce(grew, F.lit(False)))


def section_slice(start: Column, sections: int, window: int = 9, history: int = 19) -> tuple[Column, Column]:
    """First position and length of contiguous frames for ``sections`` windows and their history."""
    return (start * window).cast("long"), F.lit(history + window * sections).cast("long")


def middle_frames(n: Column, k: int) -> Column:
    """Middle of each of k intervals of 0..n-1; with fewer frames than k all of them, the last repeated."""
    cut = lambda i: F.floor(n * i / k)
    middle = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor((cut(i) + cut(i + 1) - 1) / 2))
    padded = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.least(i.cast("long"), n.cast("long") - 1))
    return F.when(n >= k, middle).otherwise(padded)


def window_mean(values: Column, start: int, stop: int) -> Column:
    """Mean of values[start:stop]; null where it is empty."""
    part = F.slice(values, start + 1, max(0, stop - start))
    return F.when(F.size(part) > 0, F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part))
