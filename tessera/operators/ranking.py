"""Scoring, ranking, sampling and sharding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.rows import numbered_in, seeded


def threshold_rating(score: Column, thresholds: list[float], higher: bool = True, best: int = 10, target: float | None = None) -> Column:
    """Rating of the first threshold that the score reaches, counting down from ``best``; 1 if none, null for null.

    With a ``target`` the distance from it is rated, and lower is better.
    """
    if target is not None:
        score, higher = F.abs(score - target), False
    out = F.lit(1)
    for i, t in reversed(list(enumerate(thresholds))):
        out = F.when(score >= t if higher else score <= t, F.lit(best - i)).otherwise(out)
    return F.when(score.isNotNull(), out)


def unit_range(score: Column, low: float, high: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score - low) / (high - low)))


def weighted_total(df: DataFrame, key: str, rating: str, weight: str) -> DataFrame:
    """Weighted sum over present ratings, the weight present, and their quotient (null without weight)."""
    present = F.when(F.col(rating).isNotNull(), F.col(weight))
    s = df.groupBy(key).agg(F.coalesce(F.sum(F.col(rating) * F.col(weight)), F.lit(0.0)).alias("total"), F.coalesce(F.sum(present), F.lit(0.0)).alias("weight"))
    return s.withColumn("normalized", F.when(F.col("weight") != 0, F.col("total") / F.col("weight")))


def to_wide(df: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """One column a name, in the given order."""
    return df.groupBy(key).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def to_long(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    return df.unpivot(key, names, "name", "value")


def nearest_bucket(h: Column, w: Column, buckets: list[tuple[int, int]]) -> Column:
    """Index of the bucket of most similar aspect ratio; the last of ties."""
    miss = F.array(*[F.abs(h * bw - w * bh) for bh, bw in buckets])
    return (F.lit(len(buckets)) - F.array_position(F.reverse(miss), F.array_min(miss))).cast("long")


def length_bucket(n: Column, buckets: list[int]) -> Column:
    """The largest bucket that is not longer; the length itself below all."""
    return F.coalesce(F.array_max(F.filter(F.array(*map(F.lit, buckets)), lambda b: b <= n)), n)


def nearest_each(values: Column, targets: Column) -> Column:
    """For each target the position of the first nearest value, then the last position."""
    at = F.transform(targets, lambda t: F.transform(F.array(F.transform(values, lambda v: F.abs(v - t))), lambda d: F.array_position(d, F.array_min(d)).cast("int") - 1)[0])
    return F.concat(at, F.array(F.size(values) - 1))


def best_with_delta(df: DataFrame, key: str, step: str, value: str, higher: bool = True) -> DataFrame:
    """Best value and its earliest step, and last minus first value (null below two)."""
    better = F.col(value) if higher else -F.col(value)
    best = F.max(F.struct(better.alias("b"), (-F.col(step)).alias("s"), F.col(value).alias("v")))
    ends = [f(F.struct(F.col(step).alias("s"), F.col(value).alias("v"))) for f in (F.min, F.max)]
    out = df.groupBy(key).agg(best.alias("b"), ends[0].alias("f"), ends[1].alias("l"), F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("b.v").alias("best"), (-F.col("b.s")).alias("best_step"), F.when(F.col("n") > 1, F.col("l.v") - F.col("f.v")).alias("delta"))


def numeric_suffix(name: Column) -> Column:
    return F.coalesce(F.regexp_extract(name, r"(\d+)$", 1).try_cast("int"), F.lit(0))


def resample_to_ratios(df: DataFrame, group: str, key: str, ratios: dict[str, float], total: int, seed: int = 0) -> DataFrame:
    """Bring groups to target sizes max(1, floor(total * r / sum)): fewer rows, or repeats in whole rounds.

    Groups without ratio stay whole. Adds ``round``: how often the row came before.
    """
    every = sum(ratios.values())
    targets = F.create_map(*[x for g, r in ratios.items() for x in (F.lit(g), F.lit(max(1, int(total * r / every))))])
    sizes = df.groupBy(F.col(group).alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    rows = df.join(sizes, F.col(group).eqNullSafe(F.col("_of"))).drop("_of").withColumn("_t", F.coalesce(targets[F.col(group)], F.col("_n")))
    rows = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_t") / F.col("_n")).cast("int") - 1)))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("round").cast("string"), F.col(key).cast("string")))
    rows = numbered_in(rows, [group, "round"], order, [key], "_r")
    return rows.where(F.col("round") * F.col("_n") + F.col("_r") <= F.col("_t")).drop("_n", "_t", "_r")


def replicate(df: DataFrame, times: Column, name: Column) -> DataFrame:
    """Whole copies; copy k from 1 on gets the suffix _rep{k}."""
    rows = df.withColumn("replica", F.explode(F.sequence(F.lit(0), times - 1)))
    return rows.withColumn("replica_name", F.when(F.col("replica") == 0, name).otherwise(F.concat(name, F.lit("_rep"), F.col("replica").cast("string"))))


def sample_per_group(df: DataFrame, group: str, key: str, k: int, seed: int = 0) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(group).orderBy(seeded(seed, key), key))
    return df.withColumn("_r", r).where(F.col("_r") <= k).drop("_r")


def equal_sizes(df: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
    """Every group cut to the size of the smallest, in seeded order."""
    least = df.groupBy(group).count().agg(F.min("count").alias("_least"))
    rows = numbered_in(df, [group], seeded(seed, key), [key], "_r")
    return rows.crossJoin(F.broadcast(least)).where("_r <= _least").drop("_r", "_least")  # one row


def bucket_batches(df: DataFrame, bucket: str, key: str, size: int, drop_last: bool = True, seed: int = 0) -> DataFrame:
    """Number of each row's batch within its bucket, in seeded order."""
    rows = numbered_in(df, [bucket], seeded(seed, key), [key], "_r").withColumn("batch", F.floor((F.col("_r") - 1) / size).cast("long")).drop("_r")
    if not drop_last:
        return rows
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(bucket, "batch"))).where(F.col("_n") == size).drop("_n")


def shard_of(index: Column, shards: int) -> Column:
    return F.pmod(index, F.lit(shards)).cast("long")


def proportional_shards(a: int, b: int, n: int) -> tuple[int, int]:
    """Shards of two sources in proportion; a source with rows gets one at least, an empty one none."""
    if a == 0 or b == 0:
        return (n if a else 0), (n if b else 0)
    x = max(1, min(n - 1, round(n * a / (a + b))))
    return x, n - x


def resolve_alias(name: Column, aliases: dict[str, str]) -> Column:
    """Canonical name of a known one, null for others. The aliases are a configuration, not data."""
    return F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])[F.lower(F.trim(name))]


def ordered_columns(df: DataFrame, order: list[str]) -> DataFrame:
    """The named columns that exist, in the given order."""
    return df.select(*[c for c in order if c in df.columns])


def pick_resource(df: DataFrame, mode: str, free: str, least: float, key: str) -> DataFrame:
    """The usable row with most room; ties go to the smallest key."""
    return df.where((F.col("mode") == mode) & (F.col(free) >= least)).orderBy(F.desc(free), key).limit(1)


def pick_version(present: Column, key: Column, seed: int = 0) -> Column:
    """One of the non-null versions, even over seeded hashes of ``key``; null if there is none."""
    have = F.array_compact(present)
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long")
    return F.get(have, (h % F.nullif(F.size(have), F.lit(0))).cast("int"))
