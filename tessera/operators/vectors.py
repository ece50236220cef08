"""Vectors: distances, centroids, quantisation and state updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))))


def nearest_centroid(df: DataFrame, vector: str, centroids: list[list[float]] | list[float]) -> DataFrame:
    """Add ``centroid`` (the first of ties) and ``distance``; centroids are few and travel as literals, a number for one of equal components."""
    same = lambda value: F.transform(F.col(vector), lambda _: F.lit(float(value)))
    c = F.array(*[F.array(*[F.lit(float(x)) for x in row]) if isinstance(row, list) else same(row) for row in centroids])
    d = F.transform(c, lambda m: l2(F.col(vector), m))
    rows = df.withColumn("_d", d).withColumn("distance", F.array_min("_d"))
    return rows.withColumn("centroid", F.array_position("_d", F.col("distance")).cast("long") - 1).drop("_d")


def kmeans(df: DataFrame, vector: str, k: int, rounds: int = 20, changed: float = 1e-4, seed: int = 0) -> list[list[float]]:
    """Lloyd's algorithm; empty clusters restart at the rows farthest from their centroid.

    It ends when no cluster is empty and less than a share ``changed`` of the
    rows went to another centroid than in the round before. Only k centroids
    and k sums come to the driver in a round.
    """
    first = df.select(F.col(vector).alias("v")).orderBy(F.xxhash64(vector, F.lit(seed)), vector).limit(k).collect()
    centers, before = [[float(x) for x in r["v"]] for r in first], None
    for _ in range(rounds if centers else 0):
        near = nearest_centroid(df.select(vector), vector, centers)
        moved = 1.0
        if before is not None:
            was = nearest_centroid(near.select(vector, F.col("centroid").alias("now")), vector, before)
            moved = was.agg(F.avg((F.col("centroid") != F.col("now")).cast("double"))).first()[0]
        long = near.select("centroid", F.posexplode(vector).alias("i", "x"))
        means = {}
        for r in long.groupBy("centroid", "i").agg(F.avg("x").alias("m")).collect():
            means.setdefault(r["centroid"], {})[r["i"]] = r["m"]
        fresh = [[means[j][i] for i in sorted(means[j])] if j in means else None for j in range(len(centers))]
        empty = [j for j, c in enumerate(fresh) if c is None]
        if empty:
            far = near.orderBy(F.desc("distance")).limit(len(empty)).collect()
            for j, r in zip(empty, far):
                fresh[j] = [float(x) for x in r[vector]]
        before, centers = centers, fresh
        if moved < changed and not empty:
            break
    return centers


def held_out_metrics(df: DataFrame, vector: str, centroids: list[list[float]] | list[float]) -> DataFrame:
    """(mean_l2, variance_retained, used): mean distance to the nearest centroid, 1 minus residual over total variance, centroids in use."""
    near = nearest_centroid(df.select(vector), vector, centroids)
    spread = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg((F.var_pop("x") * F.count("x")).alias("v")).agg(F.sum("v").alias("total"))
    one = near.agg(F.avg("distance").alias("mean_l2"), F.sum(F.col("distance") * F.col("distance")).alias("rest"), F.countDistinct("centroid").alias("used"))
    return one.crossJoin(spread).select("mean_l2", F.when(F.col("total") > 0, 1 - F.col("rest") / F.col("total")).alias("variance_retained"), "used")  # one row each


def saturated(v: Column, by: float) -> Column:
    """Values moved away from their mean by a factor."""
    mean = total(v) / F.size(v)
    return F.transform(v, lambda x: (x - mean) * by + mean)


def agrees(a: Column, b: Column, least: float = 0.995) -> Column:
    """Is the least cosine over the rows of a group high enough? An aggregate."""
    return F.min(cosine(a, b)) >= least


def grid_index(t: Column, grid: list[float], low: float = 0, high: float = 999) -> Column:
    """Position (from 0) of the grid value nearest to t, clamped first; the first of equals."""
    x = F.least(F.greatest(t, F.lit(low)), F.lit(high))
    gaps = F.array(*[F.abs(x - g) for g in grid])
    return F.array_position(gaps, F.array_min(gaps)) - 1


def quantize(v: Column, step: float, alpha: float = 1.0, tolerance: float = 0.0) -> Column:
    """Blend with the nearest multiples of step; an all-padding vector stays as it is."""
    got = F.transform(v, lambda x: x + alpha * (F.bround(x / step) * step - x))
    return F.when(F.forall(v, lambda x: F.abs(x) <= tolerance), v).otherwise(got)


def renormalize(v: Column, mean: Column, std: Column, ref_mean: Column, ref_std: Column) -> Column:
    """Map values from (mean, std) to the reference's."""
    scale = ref_std / F.greatest(std, F.lit(1e-4))
    return F.transform(v, lambda x: x * scale + (ref_mean - mean * scale))


def interpolate(a: Column, b: Column, steps: int) -> Column:
    """steps vectors from a to b inclusive."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.zip_with(a, b, lambda x, y: x + (y - x) * (i / max(1, steps - 1))))


def gated_update(old: Column, new: Column, gate: float) -> Column:
    return F.zip_with(old, new, lambda a, b: a * gate + b * (1 - gate))


def entropy(p: Column, floor: float = 1e-12) -> Column:
    return -total(F.transform(p, lambda x: x * F.ln(F.greatest(x, F.lit(floor)))))


def component_stats(df: DataFrame, vector: str) -> DataFrame:
    """Mean and population deviation of each component."""
    return df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
