"""Attention maps, portions of clips and differences of nested configurations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.vectors import total


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once and not for every element of an array that use walks over."""
    return F.transform(F.array(value), use)[0]


def softmax(scores: Column) -> Column:
    """Shares of one query over its keys; null or empty scores stay so."""
    powers = _once(F.array_max(scores), lambda high: F.transform(scores, lambda x: F.exp(x - high)))
    return _once(powers, lambda e: _once(total(e), lambda s: F.transform(e, lambda x: x / s)))


def segment_mass(df: DataFrame, group: str, shares: str, segments: dict[str, tuple[int, int]]) -> DataFrame:
    """Mean over a group's queries of the share that falls on each segment of keys, end not included; empty ones get 0."""
    mass = lambda s, e: F.avg(total(F.slice(F.col(shares), s + 1, e - s)) if e > s else F.lit(0.0))
    return df.groupBy(group).agg(*(mass(s, e).alias(name) for name, (s, e) in segments.items()))


def _edge(n: Column, i: Column, bins: int) -> Column:
    return F.bround(i * n / bins).cast("int")


def pooled_map(df: DataFrame, group: str, row: str, n_rows: str, shares: str, row_bins: int, key_bins: int) -> DataFrame:
    """(group, row_bin, key_bin, mass): sum over a bin's keys, mean over its rows.

    Bins have rounded even edges and hold one row or key at least, so a row of
    a short map may count in several; a bin beyond the last row is left out.
    """
    inside = lambda b: (F.col(row) >= _edge(F.col(n_rows), b, row_bins)) & (F.col(row) < F.greatest(_edge(F.col(n_rows), b + 1, row_bins), _edge(F.col(n_rows), b, row_bins) + 1))
    n = F.size(shares)

    def key_sum(b: Column) -> Column:
        first = _edge(n, b, key_bins)
        return total(F.slice(F.col(shares), first + 1, F.greatest(_edge(n, b + 1, key_bins) - first, F.lit(1))))

    numbers = lambda k: F.sequence(F.lit(0), F.lit(k - 1))
    rows = df.select(group, F.transform(numbers(key_bins), key_sum).alias("_k"), F.filter(numbers(row_bins), inside).alias("_r"))
    rows = rows.select(group, F.explode("_r").alias("row_bin"), "_k").select(group, "row_bin", F.posexplode("_k").alias("key_bin", "m"))
    return rows.groupBy(group, "row_bin", "key_bin").agg(F.avg("m").alias("mass"))


def portion_frames(n: Column, start: float, end: float, k: int) -> Column:
    """k frame numbers from the portion [start, end) of n frames.

    A portion of fewer than k frames grows to both sides, then to where there
    is room, and is sampled with its last frame; others by even steps. An empty
    clip has none.
    """
    s, e = F.floor(n * F.lit(start)), F.floor(n * F.lit(end))
    need = F.lit(k) - (e - s)
    low = F.greatest(F.lit(0).cast("long"), s - F.ceil(need / 2))
    high = F.least(n.cast("long"), e + F.floor(need / 2))
    short = high - low < k
    top = F.when(short & (low == 0), F.least(n.cast("long"), low + k)).otherwise(high)
    bottom = F.when(short & (low > 0) & (high == n), F.greatest(F.lit(0).cast("long"), high - k)).otherwise(low)
    spread = lambda i: F.when((i == k - 1) & (i > 0), top - 1).otherwise(F.floor(i * ((top - 1 - bottom) / max(1, k - 1)) + bottom))
    at = lambda i: F.least(F.when(need > 0, spread(i)).otherwise(F.floor(s + i * ((e - s) / k))), n.cast("long") - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), at)).otherwise(F.array().cast("array<bigint>"))


def config_nodes(config: dict, at: str = "") -> list[tuple[str, str, bool, str | None]]:
    """(path, parent, is_map, value) of every node of a nested configuration."""
    out = []
    for key, value in config.items():
        path = f"{at}.{key}" if at else str(key)
        nested = isinstance(value, dict)
        out.append((path, at, nested, None if nested else repr(value)))
        out += config_nodes(value, path) if nested else []
    return out


def config_diff(first: DataFrame, second: DataFrame) -> DataFrame:
    """(path, status) of nodes that differ: only_first, only_second or different.

    Inputs have the columns of config_nodes(). Of a subtree that one side lacks
    or holds as a plain value only the top is told; null values are equal.
    """
    a = first.select("path", F.col("parent").alias("_pa"), F.col("is_map").alias("_ma"), F.col("value").alias("_va"))
    b = second.select("path", F.col("parent").alias("_pb"), F.col("is_map").alias("_mb"), F.col("value").alias("_vb"))
    both = a.join(b, "path", "full").withColumn("parent", F.coalesce("_pa", "_pb"))
    maps = both.where("_ma and _mb").select(F.col("path").alias("parent"))
    status = F.when(F.col("_mb").isNull(), "only_first").when(F.col("_ma").isNull(), "only_second")
    status = status.when(F.col("_ma") & F.col("_mb"), None).when((F.col("_ma") != F.col("_mb")) | ~F.col("_va").eqNullSafe(F.col("_vb")), "different")
    told = both.select("path", "parent", status.alias("status")).where("status is not null")
    top = told.where("parent = ''")
    return top.unionByName(told.where("parent <> ''").join(maps, "parent", "left_semi").select(*top.columns)).select("path", "status")
