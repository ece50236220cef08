"""Queries that run as streams: all files there are, then the state or the rows they leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import SERIES, query, r4
from tessera.sources import cache, entities, listing
from tessera.sources.folders import shared_folder
from tessera.streaming import keyed

ORDER = ["ts", "event_id"]


def _events(t):
    return keyed.table_stream(t.spark, f"{t.sf_dir}/events.parquet").select("user_id", F.array("value").alias("v"), "value", *ORDER)


@query("STR4_buffer_stream", f"""with {SERIES}, n as (select user_id, count(*) as n from series group by 1)
  select s.user_id, (i % 5)::int as slot, i as at, value from series s join n on n.user_id = s.user_id where i >= n - 5""")
def _(t):
    work = shared_folder(t.spark)
    keyed.run_to_end(keyed.buffers(_events(t), "user_id", "v", ORDER, 5), "update", f"{work}/checkpoint", f"{work}/rows")
    slots = keyed.stored(t.spark, f"{work}/checkpoint", "slots", "user_id long, slot int, at long, vector array<double>")
    return slots.select("user_id", "slot", "at", F.get("vector", F.lit(0)).alias("value"))


@query("STR13_delayed_stream", f"with {SERIES} select user_id, i as section, lag(value, 2) over (partition by user_id order by i) as written from series")
def _(t):
    work = shared_folder(t.spark)
    return keyed.run_to_end(keyed.delayed(_events(t), "user_id", "value", ORDER), "append", f"{work}/checkpoint", f"{work}/rows").drop("batch")


@query("STR6_drift_stream", f"""with recursive {SERIES},
  p as (select user_id, i // 8 as k, avg(value) as m, var_pop(value) as v from series group by 1, 2 having count(*) = 8),
  w as (select user_id, k, m, v, 0 as drifts from p where k = 0
    union all select p.user_id, p.k, 0.9 * w.m + 0.1 * p.m, 0.9 * w.v + 0.1 * p.v, w.drifts + (abs(p.m - w.m) > 5 and abs(p.v - w.v) > 100)::int from w join p on p.user_id = w.user_id and p.k = w.k + 1)
  select user_id, round(arg_max(m, k), 6) as last_mean, round(arg_max(v, k), 4) as last_var, max(drifts)::bigint as drifts, count(*) as chunks from w group by 1""")
def _(t):
    work = shared_folder(t.spark)
    out = keyed.run_to_end(keyed.drift(_events(t), "user_id", "v", ORDER, 8, mean_limit=5.0, var_limit=100.0), "update", f"{work}/checkpoint", f"{work}/rows")
    # a key has a row for each batch that brought it rows; its last one holds
    last = out.groupBy("user_id").agg(F.max_by(F.struct("mean", "var", "drifts", "chunks"), "batch").alias("s"))
    return last.select("user_id", r4(F.col("s.mean")[0], 6).alias("last_mean"), r4(F.col("s.var")[0], 4).alias("last_var"), "s.drifts", "s.chunks")


# --- files and names


#: A time of day with a date before it, in the two orders that occur.
_STAMP = r"(?P<a>\d{1,4})[-/.](?P<b>\d{1,2})[-/.](?P<c>\d{2,4})[T ](?P<hour>\d{1,2}):(?P<minute>\d{2}).*"
_STAMP_SQL = r"^(?:(\d{1,4})[-/.](\d{1,2})[-/.](\d{2,4})[T ](\d{1,2}):(\d{2}).*)$"
_MARKED = f"""m as (select stamp_id, source, try_cast(nullif(regexp_extract(raw, '{_STAMP_SQL}', 1), '') as bigint) as a, try_cast(nullif(regexp_extract(raw, '{_STAMP_SQL}', 4), '') as bigint) as hour,
  coalesce(regexp_matches(raw, '{_STAMP_SQL}'), false) as fits from stamps),
  r as (select *, case when not fits then 'unparsed_name' when hour >= 24 then 'no_such_hour' when source is null then 'no_source' end as reason from m)"""


def _stamps(t):
    checks = [("no_such_hour", F.col("hour") >= 24), ("no_source", F.col("source").isNull())]
    return t.stamps.select("stamp_id", "source", "raw"), "raw", _STAMP, {"a": "long", "hour": "long"}, checks


@query("SRC9_listing", f"with {_MARKED} select stamp_id, source, a, hour from r where reason is null")
def _(t):
    return listing.scan(*_stamps(t)).drop("raw")


@query("SRC9_skips", f"with {_MARKED} select coalesce(reason, 'kept') as reason, count(*) as n from r group by 1")
def _(t):
    return listing.marked(*_stamps(t)).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SRC14_cached_metadata", "select coalesce(source, 'none') as source, count(*) as n, sum(n_chars)::bigint as chars, max(length(text))::bigint as longest from documents group by 1")
def _(t):
    """Metadata of the files of documents, from a cache made anew for this run: the second scan is served by it."""
    path = f"{t.sf_dir}/documents.parquet"

    def parse(found):
        # each row names its own file; a folder's files are read side by side
        rows = t.documents.select(F.col("_metadata.file_path").alias("_path"), "source", "n_chars", F.length("text").cast("long").alias("length"))
        return rows.join(found, "_path").select(*cache.MARKS, "source", "n_chars", "length")

    at = f"{shared_folder(t.spark)}/cache"
    for _ in range(2):
        rows = cache.cached(t.spark, path, at, parse)
    return rows.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.max("length").alias("longest"))


@query("SNK5_entity_files", """with s as (select coalesce(cast(nation_id as varchar), 'none') as nation, client_id, name from clients)
  select nation, count(*) as n, count(distinct client_id) as clients, count(name) as named from s group by 1""")
def _(t):
    """The clients of each nation in a file of their own, read again."""
    rows = t.clients.select(F.coalesce(F.col("nation_id").cast("string"), F.lit("none")).alias("nation"), "client_id", "name")
    path = f"{shared_folder(t.spark)}/nations"
    entities.write_entities(rows, "nation", path)
    back = entities.read_entities(t.spark, path, "client_id long, name string").withColumn("nation", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1))
    return back.groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("client_id").alias("clients"), F.count("name").alias("named"))
