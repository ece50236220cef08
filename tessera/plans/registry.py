"""Where queries and their SQL are kept by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of one folder by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def series(self) -> DataFrame:
        """Values of each user's events in order: user_id, i from 0, value."""
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self.events.select("user_id", "event_type", (F.row_number().over(w) - 1).cast("long").alias("i"), "value")

    @property
    def clips(self) -> DataFrame:
        """Clips: clip, frames, fps, h, w, brand."""
        k = F.col("p_partkey")
        return self.part.select(
            k.alias("clip"), (F.col("p_size") * 10).cast("long").alias("frames"), F.when(k % 3 == 0, 60.0).otherwise(24.0).alias("fps"),
            F.when(k % 4 == 0, 368).when(k % 4 == 1, 184).otherwise(480).cast("long").alias("h"), F.when(k % 4 == 0, 640).when(k % 4 == 1, 320).otherwise(832).cast("long").alias("w"),
            F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"),
        )


#: The same two tables for the SQL side.
SERIES = "series as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value from events)"
CLIPS = """clips as (select p_partkey as clip, (p_size * 10)::bigint as frames, case when p_partkey % 3 = 0 then 60.0 else 24.0 end::double as fps,
  (case p_partkey % 4 when 0 then 368 when 1 then 184 else 480 end)::bigint as h, (case p_partkey % 4 when 0 then 640 when 1 then 320 else 832 end)::bigint as w,
  p_brand as brand, p_name as name, p_retailprice as price from part)"""


def query(name: str, sql: str | None = None):
    """Register a function of Tables as a query."""
    def add(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def r4(c, n: int = 4):
    """Rounded, so that the order of additions does not show."""
    return F.round(F.col(c) if isinstance(c, str) else c, n)
