"""Projections of history windows that leave padding alone.

A window is an array of frames, each an array of channels. Frames whose values
all lie within ``tol`` of zero are padding: no projection changes them, and
they take no part in a window's statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the least deviation that a window is divided by.
LEAST_STD = 1e-4


def real(frame: Column, tol: float = 0.0) -> Column:
    """Is a frame more than padding?"""
    return F.exists(frame, lambda x: F.abs(x) > tol)


def blended(frames: Column, project, alpha: float = 1.0, tol: float = 0.0) -> Column:
    """``project`` of each real frame, blended with the frame by ``alpha``; exactly its value for 1."""
    def one(frame: Column) -> Column:
        new = project(frame)
        mixed = new if alpha == 1 else F.zip_with(frame, new, lambda x, y: x + alpha * (y - x))
        return F.when(real(frame, tol), mixed).otherwise(frame)

    return F.transform(frames, one)


def channel_stats(frames: Column, tol: float = 0.0) -> Column:
    """(full, n, mean, std) of a window: whether it has no padding, its real frames, and by channel their mean and unbiased deviation."""
    kept = F.filter(frames, lambda f: real(f, tol))
    n = F.size(kept)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    column = lambda c: F.transform(kept, lambda f: F.get(f, c))
    channels = F.sequence(F.lit(0), F.size(F.get(frames, F.lit(0))) - 1)
    mean = F.transform(channels, lambda c: total(column(c)) / n)
    std = F.transform(channels, lambda c: F.sqrt(total(F.transform(column(c), lambda x: (x - F.get(mean, c)) * (x - F.get(mean, c)))) / F.nullif(n - 1, F.lit(0))))
    return F.struct((n == F.size(frames)).alias("full"), n.alias("n"), mean.alias("mean"), std.alias("std"))


def renormed(df: DataFrame, key: str, order: str, frames: str, smooth: float = 0.0, alpha: float = 1.0, tol: float = 0.0) -> DataFrame:
    """``df`` with ``frames`` mapped to the statistics of its key's first full window, and ``applied``.

    Windows up to that one, which is the reference, stay as they are, and so
    do windows of padding only. A later one is scaled and shifted by channel so
    that its mean and deviation become the reference's; ``smooth`` carries a
    part of the transform before into each. Keys without a full window never
    change. A key's statistics are folded in one row, its windows are not;
    key and order name a row.
    """
    stats = df.where(F.size(frames) > 0).select(key, order, channel_stats(F.col(frames), tol).alias("_s")).where("_s.n > 0")
    each = stats.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), F.col("_s").alias("s")))).alias("_all"))
    numbers = "array<double>"
    transform = f"struct<scale:{numbers},shift:{numbers}>"
    start = F.struct(
        F.lit(None).cast(f"struct<mean:{numbers},std:{numbers}>").alias("ref"), F.lit(None).cast(transform).alias("prev"),
        F.array().cast(f"array<struct<k:{dict(df.dtypes)[order]},t:{transform}>>").alias("out"),
    )

    def step(z: Column, x: Column) -> Column:
        s = x["s"]
        scale = F.zip_with(z["ref"]["std"], s["std"], lambda a, b: a / F.greatest(b, F.lit(LEAST_STD)))
        shift = F.zip_with(z["ref"]["mean"], F.zip_with(s["mean"], scale, lambda m, c: m * c), lambda a, b: a - b)
        if smooth:
            carry = lambda old, new: F.zip_with(old, new, lambda a, b: smooth * a + (1 - smooth) * b)
            scale, shift = (F.when(z["prev"].isNull(), new).otherwise(carry(z["prev"][n], new)) for n, new in (("scale", scale), ("shift", shift)))
        found = F.struct(scale.alias("scale"), shift.alias("shift"))
        first = F.struct(F.when(s["full"], F.struct(s["mean"].alias("mean"), s["std"].alias("std"))).alias("ref"), z["prev"].alias("prev"), z["out"].alias("out"))
        later = F.struct(z["ref"].alias("ref"), found.alias("prev"), F.concat(z["out"], F.array(F.struct(x["k"].alias("k"), found.alias("t")))).alias("out"))
        return F.when(z["ref"].isNull(), first).otherwise(later)

    found = each.select(key, F.explode(F.aggregate("_all", start, step)["out"]).alias("_o")).select(key, F.col("_o.k").alias(order), F.col("_o.t").alias("_t"))
    rows = df.join(found, [key, order], "left")
    move = lambda f: F.zip_with(F.zip_with(f, F.col("_t.scale"), lambda x, a: x * a), F.col("_t.shift"), lambda x, b: x + b)
    new = F.when(F.col("_t").isNull(), F.col(frames)).otherwise(blended(F.col(frames), move, alpha, tol))
    return rows.withColumn(frames, new).withColumn("applied", F.col("_t").isNotNull()).drop("_t").select(*df.columns, "applied")
