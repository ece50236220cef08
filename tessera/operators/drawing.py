"""Seeded draws: aligned counts, interleaved batches, annealed counts and steps, hold-outs, jitter and its counters.

A draw is a number from the MD5 of a seed and the row's own key, so it does not
depend on partitions and comes out the same after a lost executor.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from tessera.operators.rows import numbered

#: Hexadecimal digits of the hash that deal a group's rows to tasks.
DEAL = 3


def draw(seed: int, *key: Column) -> Column:
    """A whole number from 0 to 2^32 - 1."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def unit(seed: int, *key: Column) -> Column:
    """From 0 to below 1."""
    return draw(seed, *key) / F.lit(4294967296.0)


def dealt(df: DataFrame, group: str, key: str, number: str, size: str) -> DataFrame:
    """Number the rows of each group from 0 by the MD5 of their key, with the group's size.

    A group's rows are numbered in 4,096 parts, so none of them needs one task.
    Rows with a null group or key are left out; rows that share a key are
    numbered in any order.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(key).isNotNull()).withColumn("_h", F.md5(F.col(key).cast("string")))
    rows = rows.withColumn("_b", F.substring("_h", 1, DEAL))
    parts = rows.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    own = Window.partitionBy(group)
    parts = parts.select(group, "_b", (F.sum("_c").over(own.orderBy("_b")) - F.col("_c")).alias("_first"), F.sum("_c").over(own).alias(size))
    rows = rows.withColumn(number, F.row_number().over(Window.partitionBy(group, "_b").orderBy("_h", key)) - 1)
    return rows.join(parts, [group, "_b"]).withColumn(number, (F.col(number) + F.col("_first")).cast("long")).drop("_h", "_b", "_first")


def aligned(df: DataFrame, role: str, key: str, seed: int = 0) -> DataFrame:
    """(role, key, slot): every role filled up to the longest one by repeats of its own rows, drawn at random.

    Slots below a role's size are its rows; row i draws for the slots i + n,
    i + 2n and so on, so the repeats of a short role are made by all of its rows.
    """
    rows = dealt(df.select(role, key), role, key, "_i", "_n")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("_n").alias("_m"))))  # one row
    more = rows.where("_i + _n < _m").select(role, "_n", F.explode(F.sequence(F.col("_i") + F.col("_n"), F.col("_m") - 1, F.col("_n"))).alias("slot"))
    more = more.select(role, "slot", F.pmod(draw(seed, F.col(role), F.col("slot")), F.col("_n")).alias("_i"))
    whole = rows.select(role, key, F.col("_i").alias("slot"))
    return whole.unionByName(more.join(rows.select(role, key, "_i"), [role, "_i"]).select(role, key, "slot"))


def interleaved(batches: DataFrame, bucket: str, batch: str, seed: int = 0) -> DataFrame:
    """Add ``position`` from 1: buckets take turns at random, each one's batches in their order.

    Batches arrive by a Poisson process of the same rate for each bucket; the
    next arrival is then equally likely from every bucket with batches left,
    which is what drawing a bucket at each step does, without a loop.
    """
    gap = -F.log(1 - unit(seed, F.col(bucket), F.col(batch)))
    rows = batches.withColumn("_at", F.sum(gap).over(Window.partitionBy(bucket).orderBy(batch)))
    return numbered(rows, "_at", "position").drop("_at")


def annealed(value: float, step: int, steps: int) -> float:
    """A parameter that falls by a cosine from ``value`` at step 0 to 1 at ``steps``; unchanged if ``steps`` is 0."""
    return 1 + (value - 1) * 0.5 * (1 + math.cos(math.pi * min(step / steps, 1.0))) if steps > 0 else value


def beta_quantile(u: Column, a: float, b: float, points: int = 512) -> Column:
    """The value below which a Beta(a, b) variable lies with probability u, between ``points`` tabled quantiles.

    For a, b of 1 or more. The table is the distribution's integral over a fine grid.
    """
    x = (np.arange(1 << 16) + 0.5) / (1 << 16)
    mass = np.cumsum(np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x)))
    table = np.interp(np.linspace(0, 1, points), np.concatenate([[0.0], mass / mass[-1]]), np.arange((1 << 16) + 1) / (1 << 16))
    t = F.array(*[F.lit(float(v)) for v in table])
    at = F.least(F.floor(u * (points - 1)), F.lit(points - 2)).cast("int")
    low, high = F.get(t, at), F.get(t, at + 1)
    return low + (high - low) * (u * (points - 1) - at)


def drawn_count(t: Column, least: int, most: int) -> Column:
    """The whole number, ties to even, that t from 0 to 1 names between least and most."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.bround(least + t * (most - least)))).cast("long")


def drawn_step(t: Column, low: float, high: float, steps: float, shift: float, least: float, most: float) -> Column:
    """The step that t from 0 to 1 names between low and high, warped towards late ones by a shift over 1, clamped and rounded."""
    s = low + t * (high - low)
    if shift > 1:
        s = shift * (s / steps) / (1 + (shift - 1) * (s / steps)) * steps
    return F.bround(F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), s))).cast("long")


def hold_out(df: DataFrame, file: str, key: str, k: int, share: float = 0.1, seed: int = 0) -> DataFrame:
    """``k`` rows drawn from each file, of which a share, one at least, has ``held_out``; a file of fewer rows raises."""
    sizes = df.groupBy(file).agg(F.count(F.lit(1)).alias("_n"))
    few = F.raise_error(F.concat(F.lit("too few rows in "), F.col(file).cast("string"))).cast("boolean")
    checked = sizes.where(F.when(F.col("_n") < k, few).otherwise(F.lit(True))).select(file)
    order = Window.partitionBy(file).orderBy(draw(seed, F.col(key)), key)
    drawn = df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return drawn.withColumn("held_out", F.col("_r") <= max(1, round(share * k))).join(checked, file).drop("_r")


def spread_guard(df: DataFrame, vector: str, low: float, high: float) -> DataFrame:
    """(n, std) of all components; a population deviation outside low to high raises."""
    all_values = df.select(F.explode(vector).alias("x")).agg(F.count("x").alias("n"), F.stddev_pop("x").alias("std"))
    refuse = F.raise_error(F.concat(F.lit("deviation out of range: "), F.col("std").cast("string"))).cast("double")
    return all_values.select("n", F.when(F.col("std").between(low, high), F.col("std")).otherwise(refuse).alias("std"))


def normal(seed: int, *key: Column) -> Column:
    """A standard normal draw."""
    return F.sqrt(-2 * F.log(1 - unit(seed, F.lit("r"), *key))) * F.cos(2 * math.pi * unit(seed, F.lit("a"), *key))


def jittered(v: Column, window: Column, channels: int, strength: float, seed: int = 0) -> Column:
    """Every channel scaled and shifted at random, alike for all rows of a window."""
    draws = F.array(*[F.struct(F.exp(normal(seed, window, F.lit(f"s{i}")) * strength).alias("a"), (normal(seed, window, F.lit(f"t{i}")) * strength).alias("b")) for i in range(channels)])
    return F.zip_with(v, draws, lambda x, d: x * d["a"] + d["b"])


def effect(df: DataFrame, group: str, before: str, after: str, padding: float = 1e-6) -> DataFrame:
    """Per group: rows, padding rows (no component over ``padding``), components changed and the largest change."""
    delta = F.zip_with(before, after, lambda x, y: F.abs(y - x))
    rows = df.select(
        group, F.coalesce(F.array_max(F.transform(before, F.abs)) <= padding, F.lit(True)).alias("pad"),
        F.size(F.filter(delta, lambda d: d > 0)).alias("changed"), F.array_max(delta).alias("delta"),
    )
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("pad").alias("n_padding"), F.sum(F.greatest("changed", F.lit(0))).alias("n_changed"), F.max("delta").alias("max_delta")
    )


def require_effect(effects: DataFrame) -> DataFrame:
    """The counters of effect(); a group whose rows are not all padding, yet none changed, raises."""
    idle = (F.col("n_rows") > F.col("n_padding")) & (F.col("n_changed") == 0)
    return effects.withColumn("n_changed", F.when(idle, F.raise_error(F.lit("nothing was changed")).cast("long")).otherwise(F.col("n_changed")))


def as_text(c: Column, kind: DataType, top: bool = True) -> Column:
    """One text of a value of lists, maps and structs, nulls left out, joined by blanks and stripped; a null itself is the text None."""
    if isinstance(kind, ArrayType):
        parts = F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: as_text(x, kind.elementType, False))
    elif isinstance(kind, MapType):
        parts = F.transform(F.filter(F.map_values(c), lambda x: x.isNotNull()), lambda x: as_text(x, kind.valueType, False))
    elif isinstance(kind, StructType):
        parts = F.array(*[as_text(c[f.name], f.dataType, False) for f in kind])
    else:
        parts = None
    text = F.regexp_replace(c.cast("string") if parts is None else F.concat_ws(" ", parts), r"^\s+|\s+$", "")
    text = F.when(c.isNotNull(), text)
    return F.coalesce(text, F.lit("None")) if top else text


#: Tags of a caption and where each one's text is kept.
CAPTION = (("header", "header"), ("event", "event"), ("role", "role"), ("Background", "background"), ("style", "style"), ("scene", "scene"))


def caption(texts: dict[str, Column]) -> Column:
    """A chunk's caption: a line of tagged text for each field."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"<{tag}>"), texts[name], F.lit(f"</{tag}>")) for tag, name in CAPTION])
