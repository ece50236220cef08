"""Filters, joins and set operations over manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.folders import shared_folder


def first_failing_reason(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first check that holds; null if none does (the row stays). A null check does not hold."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks])


def drop_report(df: DataFrame, checks: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(kept rows, rows lost by reason)."""
    marked = df.withColumn("reason", first_failing_reason(checks))
    lost = marked.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return marked.where("reason is null").drop("reason"), lost


def min_frames(df: DataFrame, frames: str, least: int = 121) -> DataFrame:
    return df.where(F.col(frames) >= least)


def resolution_allowed(h: str, w: str, height: int, width: int) -> Column:
    """Full, half or quarter of the configured size, halves floored."""
    sizes = [(height // d, width // d) for d in (1, 2, 4)]
    return reduce(lambda a, b: a | b, [(F.col(h) == a) & (F.col(w) == b) for a, b in sizes])


def rollout_allowed(frames: str, sections: int, chunk: int = 33) -> Column:
    return F.floor(F.col(frames) / chunk) >= sections


def frame_stride(fps: str, base_fps: float) -> Column:
    """Whole stride to come down to base_fps, one at least."""
    return F.greatest(F.floor(F.col(fps) / base_fps).cast("int"), F.lit(1))


def ceil_div(n: str | Column, s: Column) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return F.floor((n + s - 1) / s).cast("long")


def strip_prefixes(path: str, prefixes: list[str]) -> Column:
    return reduce(lambda c, p: F.when(F.startswith(c, F.lit(p)), F.substring(c, F.lit(len(p) + 1), F.length(c))).otherwise(c), prefixes, F.col(path))


def stem(file: str) -> Column:
    """File name without folders and a trailing .mp4."""
    return F.regexp_replace(F.element_at(F.split(F.col(file), "/"), -1), r"\.mp4$", "")


def first_nonempty(*cols: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols])


def require_finite(value: str) -> Column:
    """The value; a null, NaN or infinite one raises."""
    v = F.col(value)
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v).otherwise(F.raise_error(F.lit(f"{value} is not finite")).cast("double"))


def lookup(df: DataFrame, side: DataFrame, on: str, value: str, fallback: Column, flag: str = "from_side") -> DataFrame:
    """Left join with fallback where the side misses the key or holds an empty value."""
    got = side.select(on, F.nullif(F.col(value), F.lit("")).alias("_v"))
    out = df.join(got, on, "left").withColumn(flag, F.col("_v").isNotNull())
    return out.withColumn(value, F.coalesce("_v", fallback)).drop("_v")


def prioritized(sides: list[DataFrame], key: str) -> DataFrame:
    """Of several side tables the row of the first that has the key."""
    every = reduce(lambda a, b: a.unionByName(b), [s.withColumn("_p", F.lit(i)) for i, s in enumerate(sides)])
    cols = [c for c in sides[0].columns if c != key]
    best = every.groupBy(key).agg(F.min_by(F.struct(*cols), "_p").alias("_b"))
    return best.select(key, *(F.col("_b")[c].alias(c) for c in cols))


def todo(manifest: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of the manifest that have no result yet."""
    return manifest.join(done.select(key), key, "left_anti")


def existing(manifest: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    return manifest.join(listing.select(key), key, "left_semi")


def paired(df: DataFrame, keys: list[str], which: str, first: str, last: str, value: str) -> DataFrame:
    """Values of two segments of the same key in one row, keys with both only; one aggregation, no self-join."""
    pick = lambda s: F.max(F.when(F.col(which) == s, F.col(value)))
    both = df.groupBy(*keys).agg(pick(first).alias("first_value"), pick(last).alias("last_value"))
    return both.where("first_value is not null and last_value is not null").withColumn("delta", F.col("last_value") - F.col("first_value"))


def interval_owner(lo: Column, hi: Column, starts: Column, ends: Column) -> Column:
    """Index of the interval with the largest overlap with [lo, hi); the first of ties, 0 if none overlaps.

    Works within a row, so chunks never cross with the events of other clips.
    """
    over = F.zip_with(starts, ends, lambda s, e: F.greatest(F.lit(0), F.least(hi, e) - F.greatest(lo, s)))
    return F.array_position(over, F.array_max(over)).cast("long") - 1


def positional(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Rows of equal rank side by side, on ranks found by range partitioning."""
    return numbered(left, left_order, "_rn").join(numbered(right, right_order, "_rn"), "_rn").drop("_rn")


def numbered(df: DataFrame, order: str | list[str | Column], name: str, rows_each: int = 1_000_000) -> DataFrame:
    """Row number from 1 by ``order`` without one task seeing all rows.

    Ranges of the order are sorted and written side by side, about ``rows_each``
    rows in each however many there are; the counts of ranges give each its
    first number. Rows of equal order share a range, so it should tell rows apart.
    """
    spark, keys = df.sparkSession, [order] if isinstance(order, (str, Column)) else list(order)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_each))
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    path = shared_folder(spark)
    dealt.write.parquet(path)  # the numbers of partitions hold for this one run
    rows = spark.read.schema(dealt.schema).parquet(path).withColumn("_b", F.shiftright("_at", 33))
    sizes = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    number = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_first") + 1
    return rows.join(F.broadcast(sizes), "_b").withColumn(name, number.cast("long")).select(*df.columns, name)


def numbered_in(df: DataFrame, groups: list[str], by: Column, ties: list[str], name: str) -> DataFrame:
    """Row number from 1 in each group, by a hash written in hexadecimal and then ``ties``; null is a group.

    A group's rows are numbered in 4,096 parts by the hash's first digits, so
    none of them needs one task; a group's counts are at most as many rows.
    """
    rows = df.withColumns({"_g": F.to_json(F.struct(*groups)), "_h": by}).withColumn("_b", F.substring("_h", 1, 3))
    parts = rows.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_c"))
    parts = parts.select("_g", "_b", (F.sum("_c").over(Window.partitionBy("_g").orderBy("_b")) - F.col("_c")).alias("_first"))
    own = F.row_number().over(Window.partitionBy("_g", "_b").orderBy("_h", *ties))
    return rows.withColumn("_r", own).join(parts, ["_g", "_b"]).withColumn(name, (F.col("_r") + F.col("_first")).cast("long")).select(*df.columns, name)


def ok_first(df: DataFrame, key: str, ok: Column, order: list[str]) -> DataFrame:
    """One row a key: the first in order that is ok, else the first."""
    pick = F.struct((~F.coalesce(ok, F.lit(False))).alias("bad"), *order, F.struct(*df.columns).alias("row"))
    return df.groupBy(key).agg(F.min(pick).alias("_p")).select("_p.row.*")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(F.struct(order, F.struct(*df.columns).alias("row"))).alias("_p")).select("_p.row.*")


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """The rows, with an error when a key comes twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return df.withColumn("_n", n).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("key repeats: "), F.col(key).cast("string")))).otherwise(F.lit(None))).where("_n is null").drop("_n")


def key_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of either side: missing in a, missing in b, differing or equal."""
    j = a.select(key, F.col(value).alias("_a"), F.lit(1).alias("_ia")).join(b.select(key, F.col(value).alias("_b"), F.lit(1).alias("_ib")), key, "full")
    state = F.when(F.col("_ia").isNull(), "only_b").when(F.col("_ib").isNull(), "only_a").when(F.col("_a").eqNullSafe(F.col("_b")), "equal").otherwise("differs")
    return j.select(key, state.alias("state"))


def seeded(seed: int | str, *cols: str) -> Column:
    """A reproducible order that other engines can follow."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def train_test(df: DataFrame, key: str, n_test: int, seed: int = 0) -> DataFrame:
    """Add ``split``: the first n_test rows in seeded order are test."""
    test = df.select(key, seeded(seed, key).alias("_o")).orderBy("_o", key).limit(n_test).select(key, F.lit("test").alias("split"))
    return df.join(test, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def where_equal(df: DataFrame, wanted: dict[str, object], anything: object = "avg") -> DataFrame:
    """Rows that agree in every named column; None and ``anything`` leave a column free."""
    for name, value in wanted.items():
        if value is not None and value != anything:
            df = df.where(F.col(name) == F.lit(value))
    return df


def require_version(df: DataFrame, captions: DataFrame, key: str, version: str, wanted: str, text: str) -> DataFrame:
    """``df`` with the text of the wanted version and a reason (``no_cap``) where there is none."""
    side = captions.where((F.col(version) == wanted) & (F.col(text) != "")).select(key, text)
    return df.join(side, key, "left").withColumn("reason", F.when(F.col(text).isNull(), F.lit("no_cap")))


def strict_lookup(df: DataFrame, side: DataFrame, on: str, value: str) -> DataFrame:
    """Left join in which a key without a value is an error."""
    got = df.join(side.select(on, value), on, "left")
    miss = F.raise_error(F.concat(F.lit(f"no {value} for "), F.coalesce(F.col(on).cast("string"), F.lit("null"))))
    return got.withColumn(value, F.when(F.col(value).isNull(), miss.cast(dict(side.dtypes)[value])).otherwise(F.col(value)))
