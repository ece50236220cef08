"""Queries over measures: aggregates, series, ranking, scalars, vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import prompts, scalars
from tessera.operators import ranking, rows, series, vectors
from tessera.plans.registry import CLIPS, SERIES, query, r4


@query("AGG1_mean_min", "select event_type, round(avg(value), 4) as mean, min(value) as least from events group by 1")
def _(t):
    return t.events.groupBy("event_type").agg(r4(F.avg("value")).alias("mean"), F.min("value").alias("least"))


@query("AGG2_top_fraction", """select user_id, round(avg(value), 4) as top_mean from (select user_id, value, row_number() over (partition by user_id order by value desc) as r,
  greatest(1, round_even(count(*) over (partition by user_id) * 0.1, 0)) as k from events where value is not null) where r <= k group by 1""")
def _(t):
    return series.top_fraction_mean(t.events, "user_id", "value", 0.1).select("user_id", r4("top_mean").alias("top_mean"))


@query("AGG4_wide_means", """select event_type, round(avg(value) filter (i < 10), 4) as start_mean, round(avg(value) filter (i >= 10 and i < 20), 4) as end_mean, count(*) as n
  from (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events) group by 1""")
def _(t):
    pick = lambda c: r4(F.avg(F.when(c, F.col("value"))))
    return t.series.groupBy("event_type").agg(pick(F.col("i") < 10).alias("start_mean"), pick((F.col("i") >= 10) & (F.col("i") < 20)).alias("end_mean"), F.count(F.lit(1)).alias("n"))


@query("AGG5_top_counts", "select source, count(*) as n from documents group by 1 order by n desc, source limit 15")
def _(t):
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(15)


@query("AGG6_explode_count", "select flag, count(*) as n from (select unnest(string_split(p_type, ' ')) as flag from part) group by 1")
def _(t):
    return t.part.select(F.explode(F.split("p_type", " ")).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("AGG7_share_ranking", """select event_type, round(avg(value), 4) as mean, round(avg(value) / sum(avg(value)) over (), 6) as share, rank() over (order by avg(value) desc)::int as rank from events group by 1""")
def _(t):
    g = t.events.groupBy("event_type").agg(F.avg("value").alias("m"))
    return g.select("event_type", r4("m").alias("mean"), r4(F.col("m") / F.sum("m").over(Window.partitionBy(F.lit(1))), 6).alias("share"), F.rank().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("m"))).alias("rank"))


@query("AGG8_argmax_group", "select l_shipdate::date as day, round(avg(l_quantity), 4) as m from lineitem group by 1 order by avg(l_quantity) desc, 1 limit 1")
def _(t):
    return t.lineitem.groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.avg("l_quantity").alias("m")).orderBy(F.desc("m"), "day").limit(1).select("day", r4("m").alias("m"))


@query("AGG9_bands", "select case when l_linenumber <= 2 then 'early' when l_linenumber <= 4 then 'mid' else 'late' end as band, round(avg(l_discount), 6) as m from lineitem group by 1")
def _(t):
    n = F.col("l_linenumber")
    return t.lineitem.groupBy(F.when(n <= 2, "early").when(n <= 4, "mid").otherwise("late").alias("band")).agg(r4(F.avg("l_discount"), 6).alias("m"))


@query("AGG10_guarded_ratio", "select l_returnflag as k, round(avg(l_tax) / greatest(avg(l_discount), 1e-9), 6) as ratio from lineitem group by 1")
def _(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("k")).agg(r4(F.avg("l_tax") / F.greatest(F.avg("l_discount"), F.lit(1e-9)), 6).alias("ratio"))


@query("AGG12_moments", """select event_type, count(value) as n, round(sum(value) / count(value), 4) as mean, round(stddev_pop(value), 4) as std from events group by 1""")
def _(t):
    return series.moments(t.events, "event_type", "value").select("event_type", "n", r4("mean").alias("mean"), r4("std").alias("std"))


@query("AGG13_component_stats", """select i::int as i, round(avg(x), 4) as mean, round(stddev_pop(x), 4) as std from (select unnest(range(0, 64)) as i, unnest(embedding)::double as x from embeddings) group by 1""")
def _(t):
    e = t.embeddings.select(F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return vectors.component_stats(e, "v").select("i", r4("mean").alias("mean"), r4("std").alias("std"))


@query("AGG14_unbiased", "select event_type, round(avg(value), 4) as mean, round(var_samp(value), 4) as var from events group by 1")
def _(t):
    return t.events.groupBy("event_type").agg(r4(F.avg("value")).alias("mean"), r4(F.var_samp("value")).alias("var"))


@query("AGG15_summary", "select user_id, round(median(value), 6) as median, min(value) as lo, max(value) as hi, count(value) as n, count(*) as total from events group by 1")
def _(t):
    return t.events.groupBy("user_id").agg(r4(F.median("value"), 6).alias("median"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"), F.count(F.lit(1)).alias("total"))


@query("AGG16_quartile_blocks", f"""with {SERIES}, n as (select *, count(*) over (partition by user_id) as n from series)
  select user_id, least(i // greatest(n // 4, 1), 3) as q, round(avg(value), 6) as m from n group by 1, 2""")
def _(t):
    s = t.series.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    return s.groupBy("user_id", series.quartile_block("i", F.col("n")).alias("q")).agg(r4(F.avg("value"), 6).alias("m"))


@query("AGG17_percentile", "select event_type, round(quantile_cont(value, 0.9), 6) as p90 from events group by 1")
def _(t):
    return t.events.groupBy("event_type").agg(r4(F.percentile("value", 0.9), 6).alias("p90"))


@query("AGG18_area", f"""with {SERIES} select user_id, round(sum((value + nxt) / 2), 3) as area from (select user_id, value, lead(value) over (partition by user_id order by i) as nxt from series) where nxt is not null group by 1""")
def _(t):
    return series.ordered_values(t.series, "user_id", "i", "value").select("user_id", r4(series.trapezoid(F.col("series")), 3).alias("area"))


@query("AGG19_slope", f"with {SERIES} select user_id, round(regr_slope(value, i), 5) as slope from series group by 1")
def _(t):
    return t.series.groupBy("user_id").agg(r4(F.regr_slope("value", "i"), 5).alias("slope"))


_THEIL_SEN = f"""with {SERIES} select s.user_id, round(p.slope, 5) as slope from (select distinct user_id from series) s join
  (select a.user_id, median((b.value - a.value) / (b.i - a.i)) as slope from series a join series b on a.user_id = b.user_id and a.i < b.i group by 1) p on p.user_id = s.user_id"""


@query("AGG20_theil_sen", _THEIL_SEN)
@query("AGG20_theil_sen_whole", _THEIL_SEN)
def _(t):
    return series.theil_sen(t.series, "user_id", "i", "value").where("slope is not null").select("user_id", r4("slope", 5).alias("slope"))


_W = {"click": 0.2, "view": 0.3, "purchase": 0.5}


@query("AGG23_partial_rating", """select user_id, round(sum(m * w), 4) as total, round(sum(w), 4) as weight, round(sum(m * w) / sum(w), 4) as normalized from
  (select user_id, event_type, avg(value) as m, case event_type when 'click' then 0.2 when 'view' then 0.3 else 0.5 end as w from events group by 1, 2) group by 1""")
def _(t):
    g = t.events.groupBy("user_id", "event_type").agg(F.avg("value").alias("m"))
    g = g.withColumn("w", F.when(F.col("event_type") == "click", 0.2).when(F.col("event_type") == "view", 0.3).otherwise(0.5))
    return ranking.weighted_total(g, "user_id", "m", "w").select("user_id", *(r4(c).alias(c) for c in ("total", "weight", "normalized")))


@query("AGG25_word_counts", "select source, round(avg(n), 4) as mean, min(n) as lo, max(n) as hi from (select source, len(string_split(text, ' '))::int as n from documents) group by 1")
def _(t):
    n = F.size(F.split("text", " ", -1))
    return t.documents.groupBy("source").agg(r4(F.avg(n)).alias("mean"), F.min(n).alias("lo"), F.max(n).alias("hi"))


@query("AGG26_vector_stats", """select vec_id, len(embedding)::int as n, round(list_avg(embedding::double[]), 5) as mean, round(list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max'), 5)::double as top from embeddings""")
def _(t):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", F.size("embedding").alias("n"), r4(vectors.total(v) / F.size("embedding"), 5).alias("mean"), F.round(F.array_max(F.transform(v, lambda x: F.abs(x))), 5).alias("top"))


@query("AGG28_modal_shape", "select p_size as shape, count(*) as n from part group by 1 order by n desc, shape limit 1")
def _(t):
    return t.part.groupBy(F.col("p_size").alias("shape")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "shape").limit(1)


@query("AGG31_dataset_counts", "select source, count(*) as n from documents group by 1")
def _(t):
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("AGG32_dense_grid", """select a.x, b.y, coalesce(m, 0) as v from (select unnest(range(1, 9)) as x) a cross join (select unnest(range(0, 12)) as y) b left join
  (select l_linenumber as x, month(l_shipdate) - 1 as y, round(avg(l_quantity), 4) as m from lineitem group by 1, 2) c on a.x = c.x and b.y = c.y""")
def _(t):
    grid = t.spark.range(1, 9).select(F.col("id").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("y"))
    m = t.lineitem.groupBy(F.col("l_linenumber").cast("long").alias("x"), (F.month("l_shipdate") - 1).cast("long").alias("y")).agg(r4(F.avg("l_quantity")).alias("m"))
    return grid.join(m, ["x", "y"], "left").select("x", "y", F.coalesce("m", F.lit(0.0)).alias("v"))


@query("AGG33_cover_check", """select conv_id, min(turn) = 0 and bool_and(prev is null or turn = prev + 1) as covered from
  (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as prev from conversations) group by 1""")
def _(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t.conversations.select("conv_id", "turn", F.lag("turn").over(w).alias("prev"))
    ok = F.col("prev").isNull() | (F.col("turn") == F.col("prev") + 1)
    return c.groupBy("conv_id").agg(((F.min("turn") == 0) & F.bool_and(ok)).alias("covered"))


@query("AGG34_sorted_steps", "select o_custkey as k, array_to_string(list_sort(list(distinct month(o_orderdate)))::varchar[], ',') as steps from orders group by 1")
def _(t):
    return t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.array_join(F.sort_array(F.collect_set(F.month("o_orderdate"))).cast("array<string>"), ",").alias("steps"))


@query("WIN1_full_chunks", f"with {SERIES}, c as (select *, i // 33 as chunk, count(*) over (partition by user_id, i // 33) as n from series) select user_id, chunk, round(avg(value), 4) as m from c where n = 33 group by 1, 2")
def _(t):
    return series.full_chunks(t.series, "user_id", "i").groupBy("user_id", "chunk").agg(r4(F.avg("value")).alias("m"))


@query("WIN2_chunk_offsets", f"with {CLIPS} select clip, j::int as j, round_even(j * (33 - 1) / 3.0, 0)::int as o from (select clip, unnest(range(0, 4)) as j from clips)")
def _(t):
    return t.clips.select("clip", F.posexplode(series.even_offsets(F.lit(33), 4)).alias("j", "o"))


@query("WIN3_chunk_count", f"with {CLIPS} select clip, frames // 33 as n_chunks from clips")
def _(t):
    return t.clips.select("clip", F.floor(F.col("frames") / 33).alias("n_chunks"))


@query("WIN4_boundary_excess", f"with {SERIES} select user_id, i, abs(value - lag(value) over w) - abs(lag(value) over w - lag(value, 2) over w) as excess from series window w as (partition by user_id order by i)")
def _(t):
    w = Window.partitionBy("user_id").orderBy("i")
    p = F.lag("value").over(w)
    return t.series.select("user_id", "i", (F.abs(F.col("value") - p) - F.abs(p - F.lag("value", 2).over(w))).alias("excess"))


@query("WIN5_rolling_mean", f"""with {SERIES} select user_id, i, case when count(value) over w = 5 then round(avg(value) over w, 4) end as m from series
  window w as (partition by user_id order by i rows between 4 preceding and current row)""")
def _(t):
    return t.series.select("user_id", "i", r4(series.rolling_mean("user_id", "i", "value", 5)).alias("m"))


@query("WIN6_sustained_onset", f"""with {SERIES}, r as (select user_id, i, case when count(value) over w = 5 then avg(value) over w end as r,
    avg(value) filter (i < 5) over (partition by user_id) + 0.5 * stddev_pop(value) filter (i < 5) over (partition by user_id) as lim from series
    window w as (partition by user_id order by i rows between 4 preceding and current row)),
  u as (select *, min(coalesce((r > lim)::int, 0)) over f as up, count(*) over f as n from r window f as (partition by user_id order by i rows between current row and 4 following))
  select user_id, min(i) filter (up = 1 and n = 5) as onset from u group by 1""")
def _(t):
    return series.sustained_onset(t.series, "user_id", "i", "value", 5, 0.5)


@query("WIN7_slope_onset", f"""with {SERIES}, s as (select user_id, i, regr_slope(value, i) over (partition by user_id order by i) as s from series),
  u as (select *, min((s > 0)::int) over (partition by user_id order by i rows between current row and unbounded following) as ok from s where i >= 2)
  select user_id, min(i) filter (ok = 1) as onset from u group by 1""")
def _(t):
    return series.expanding_slope_onset(t.series, "user_id", "i", "value")


@query("WIN8_recovery", f"""with {SERIES}, s as (select *, count(*) over (partition by user_id) as n, max(value) over (partition by user_id) as top from series)
  select user_id, round(case when max(n) >= 10 and max(top) <> 0 then avg(value) filter (i >= n - 10) / max(top) end, 5) as ratio from s group by 1""")
def _(t):
    return series.ordered_values(t.series, "user_id", "i", "value").select("user_id", r4(series.recovery_ratio(F.col("series")), 5).alias("ratio"))


@query("WIN10_islands", f"""with {SERIES}, g as (select user_id, i, i - row_number() over (partition by user_id order by i) as g from series where value < 60)
  select user_id, min(i) as start, max(i) + 1 as stop from g group by user_id, g having count(*) >= 5""")
def _(t):
    return series.islands(t.series, "user_id", "i", F.col("value") < 60, 5).select("user_id", "start", "stop")


@query("WIN11_time_bins", f"with {SERIES} select floor(i * 1.375 / 10)::bigint as bin, round(avg(m), 6) as m from (select user_id, i, value as m from series) group by 1")
def _(t):
    return t.series.groupBy(F.floor(F.col("i") * 1.375 / 10).alias("bin")).agg(r4(F.avg("value"), 6).alias("m"))


@query("WIN12_abs_steps", f"with {SERIES} select user_id, i, abs(value - lag(value) over (partition by user_id order by i)) as d from series")
def _(t):
    return t.series.select("user_id", "i", F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("i"))).alias("d"))


@query("WIN13_phase_profile", f"""with {SERIES}, d as (select user_id, i, abs(lead(value) over (partition by user_id order by i) - value) as d from series)
  select user_id, i % 7 as phase, round(avg(d), 6) as step from d where d is not null group by 1, 2""")
def _(t):
    return series.phase_profile(t.series, "user_id", "i", "value", 7).select("user_id", "phase", r4("step", 6).alias("step"))


@query("WIN16_segments", """with s as (select conv_id, turn, turn * 1.3 as a, (turn + 1) * 1.3 as z from conversations),
  e as (select *, round_even(z * 24, 0)::bigint as e, max(turn) over (partition by conv_id) as last from s)
  select conv_id, turn, lo, hi from (select conv_id, turn, coalesce(lag(e) over (partition by conv_id order by a, z), 0) as lo, case when turn = last then 400 else e end as hi from e) where hi > lo""")
def _(t):
    c = t.conversations.select("conv_id", "turn", (F.col("turn") * 1.3).alias("a"), ((F.col("turn") + 1) * 1.3).alias("z"), F.lit(400).cast("long").alias("frames"))
    return series.segment_bounds(c, "conv_id", "a", "z", 24.0, "frames").select("conv_id", "turn", "lo", "hi")


@query("WIN19_rollout", "select k, array_to_string(h::varchar[], ',') as history, array_to_string(x::varchar[], ',') as target from (select k, list_transform(range(k*9, k*9+19), lambda j: case when j < 19 then 0 else j - 18 end) as h, list_transform(range(k*9+19, k*9+28), lambda j: j - 18) as x from (select unnest(range(0, 5)) as k))")
def _(t):
    frames = F.sequence(F.lit(1).cast("long"), F.lit(64).cast("long"))
    h, x = series.rollout_window(F.col("k").cast("int"), frames)
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    return t.spark.range(5).withColumnRenamed("id", "k").select("k", text(h).alias("history"), text(x).alias("target"))


@query("WIN21_eviction", "select k, v as n_real, array_to_string(list_transform(range(greatest(9*k-19-v, 0), greatest(9*k-19-v, 0) + v), lambda j: j + 1)::varchar[], ',') as frames from (select k, least(9, greatest(0, 9*k-19)) as v from (select unnest(range(0, 5)) as k))")
def _(t):
    n, f = series.evicted(F.col("k").cast("int"), F.sequence(F.lit(1), F.lit(32)))
    return t.spark.range(5).withColumnRenamed("id", "k").select("k", n.cast("long").alias("n_real"), F.array_join(f.cast("array<string>"), ",").alias("frames"))


@query("WIN22_edge_share", f"with {CLIPS} select clip, least(greatest(1, floor(frames * 0.15)), frames)::bigint as n, least(greatest(4, floor(frames * 0.15)), frames)::bigint as n4 from clips")
def _(t):
    f = F.col("frames")
    return t.clips.select("clip", series.edge_share(f).alias("n"), series.edge_share(f, least=4).alias("n4"))


@query("WIN28_first_segment", "select conv_id, role from conversations where turn = 0")
def _(t):
    return t.conversations.where("turn = 0").select("conv_id", "role")


@query("WIN30_last_nonnull", "select user_id, arg_max(value, struct_pack(a := ts, b := event_id)) as v from events group by 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))


@query("STR6_ema_drift", f"""with recursive {SERIES},
  p as (select user_id, i // 8 as k, avg(value) as m, var_pop(value) as v from series group by 1, 2),
  w as (select user_id, k, m, v, 0 as drifts from p where k = 0
    union all select p.user_id, p.k, 0.9 * w.m + 0.1 * p.m, 0.9 * w.v + 0.1 * p.v, w.drifts + (abs(p.m - w.m) > 5 and abs(p.v - w.v) > 100)::int from w join p on p.user_id = w.user_id and p.k = w.k + 1)
  select user_id, round(arg_max(m, k), 6) as last_mean, round(arg_max(v, k), 4) as last_var, max(drifts)::bigint as drifts from w group by 1""")
def _(t):
    parts = t.series.groupBy("user_id", F.floor(F.col("i") / 8).alias("k")).agg(F.array(F.avg("value")).alias("mean"), F.array(F.var_pop("value")).alias("var"))
    got = parts.groupBy("user_id").agg(series.moment_drift(F.transform(F.sort_array(F.collect_list(F.struct("k", "mean", "var"))), lambda x: F.struct(x["mean"].alias("mean"), x["var"].alias("var"))), mean_limit=5.0, var_limit=100.0).alias("s"))
    return got.select("user_id", r4(F.col("s.mean")[0], 6).alias("last_mean"), r4(F.col("s.var")[0], 4).alias("last_var"), F.col("s.drifts").cast("long").alias("drifts"))


@query("STR13_delayed_fifo", f"with {SERIES} select user_id, i, lag(value, 2) over (partition by user_id order by i) as written from series")
def _(t):
    return t.series.select("user_id", "i", F.lag("value", 2).over(Window.partitionBy("user_id").orderBy("i")).alias("written"))


@query("RNK1_nulls_last", "select doc_id, row_number() over (order by lang nulls last, doc_id) as r from documents")
def _(t):
    return rows.numbered(t.documents.select("doc_id", "lang"), [F.asc_nulls_last("lang"), "doc_id"], "r").select("doc_id", "r")


@query("RNK2_numeric_suffix", "select p_partkey as k, coalesce(try_cast(regexp_extract(p_brand, '([0-9]+)$', 1) as int), 0) as n from part")
def _(t):
    return t.part.select(F.col("p_partkey").alias("k"), ranking.numeric_suffix(F.col("p_brand")).alias("n"))


@query("RNK3_best_delta", """select l_orderkey as k, max(l_quantity) as best, (select 0) + min(case when l_quantity = m then l_linenumber end) as best_step,
  case when count(*) > 1 then arg_max(l_quantity, struct_pack(s := l_linenumber, v := l_quantity)) - arg_min(l_quantity, struct_pack(s := l_linenumber, v := l_quantity)) end as delta from (select *, max(l_quantity) over (partition by l_orderkey) as m from lineitem) group by 1""")
def _(t):
    return ranking.best_with_delta(t.lineitem.select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_quantity"), "k", "l_linenumber", "l_quantity")


@query("RNK4_ratings", "select p_partkey as k, case when p_retailprice >= 1800 then 10 when p_retailprice >= 1500 then 9 when p_retailprice >= 1200 then 8 when p_retailprice >= 1000 then 7 else 1 end as rating from part")
def _(t):
    return t.part.select(F.col("p_partkey").alias("k"), ranking.threshold_rating(F.col("p_retailprice"), [1800.0, 1500.0, 1200.0, 1000.0]).alias("rating"))


@query("RNK5_unit_range", "select p_partkey as k, round(least(1.0, greatest(0.0, (p_retailprice - 950) / 900.0)), 6) as x from part")
def _(t):
    return t.part.select(F.col("p_partkey").alias("k"), r4(ranking.unit_range(F.col("p_retailprice"), 950.0, 1850.0), 6).alias("x"))


@query("RNK7_falsy_zero", "select event_id, coalesce(nullif(round(value), 0), -1.0) as v from events")
def _(t):
    return t.events.select("event_id", F.coalesce(F.nullif(F.round("value"), F.lit(0.0)), F.lit(-1.0)).alias("v"))


_T = ["click", "view", "purchase"]


@query("RNK8_pivot", "select user_id, max(value) filter (event_type = 'click') as click, max(value) filter (event_type = 'view') as view, max(value) filter (event_type = 'purchase') as purchase from events group by 1")
def _(t):
    return ranking.to_wide(t.events, "user_id", "event_type", "value", _T)


@query("RNK9_unpivot", "select p_partkey as k, name, value from (unpivot (select p_partkey, p_size::double as size, p_retailprice as price from part) on size, price into name name value value)")
def _(t):
    return ranking.to_long(t.part.select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")), "k", ["size", "price"])


@query("RNK11_farthest", "select vec_id from (select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 6) as d from embeddings) order by d desc, vec_id limit 10")
def _(t):
    return t.embeddings.withColumn("d", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 6)).orderBy(F.desc("d"), "vec_id").limit(10).select("vec_id")


@query("RNK12_nearest_bucket", f"""with {CLIPS}, b as (select * from (values (0, 384, 640), (1, 640, 384), (2, 512, 512), (3, 368, 640)) b(i, bh, bw))
  select clip, i::bigint as bucket from (select clip, i, row_number() over (partition by clip order by abs(h * bw - w * bh), i desc) as r from clips, b) where r = 1""")
def _(t):
    return t.clips.select("clip", ranking.nearest_bucket(F.col("h"), F.col("w"), [(384, 640), (640, 384), (512, 512), (368, 640)]).alias("bucket"))


@query("RNK13_length_bucket", f"with {CLIPS} select clip, case when frames >= 401 then 401 when frames >= 201 then 201 when frames >= 121 then 121 else frames end as bucket from clips")
def _(t):
    return t.clips.select("clip", ranking.length_bucket(F.col("frames"), [121, 201, 401]).cast("long").alias("bucket"))


@query("RNK18_nearest_each", f"""with {SERIES},
  s as (select user_id, min_by(i, (abs(value - 0), i)) as a, min_by(i, (abs(value - 50), i)) as b, max(i) as c from series group by 1)
  select user_id, a::varchar || ',' || b::varchar || ',' || c::varchar as at from s""")
def _(t):
    s = series.ordered_values(t.series, "user_id", "i", "value")
    return s.select("user_id", F.array_join(ranking.nearest_each(F.col("series"), F.array(F.lit(0.0), F.lit(50.0))).cast("array<string>"), ",").alias("at"))


@query("SC1_clean_prompt", r"""with a as (select page_id, regexp_replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') as x from pages),
  b as (select page_id, regexp_replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') as x from a)
  select page_id, length(trim(regexp_replace(x, '\s+', ' ', 'g')))::bigint as chars, md5(trim(regexp_replace(x, '\s+', ' ', 'g'))) as digest from b""")
def _(t):
    clean = t.pages.select("page_id", prompts.clean_prompt(F.col("html")).alias("x"))
    return clean.select("page_id", F.length("x").cast("long").alias("chars"), F.md5("x").alias("digest"))


@query("STR9_ema_weights", """with e as (select user_id, event_id, greatest(0, event_id - 11) as s from events)
  select event_id, round(case when s <= 0 then 0 else greatest(0.1, least(0.9999, (1 + s) / (10 + s))) end, 9) as plain,
    round(case when s <= 0 then 0 else greatest(0.1, least(0.9999, 1 - pow(1 + s / 2.0, -0.75))) end, 9) as warm from e""")
def _(t):
    step = F.col("event_id")
    plain, warm = scalars.ema_decay(step, 10, 0.9999, 0.1), scalars.ema_decay(step, 10, 0.9999, 0.1, inv_gamma=2.0, power=0.75)
    return t.events.select("event_id", r4(plain, 9).alias("plain"), r4(warm, 9).alias("warm"))


@query("SC2_one_line", r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as line from documents")
def _(t):
    return t.documents.select("doc_id", scalars.one_line(F.col("text")).alias("line"))


@query("SC3_tagged", "select doc_id, lang || chr(10) || source as tagged from documents")
def _(t):
    return t.documents.select("doc_id", scalars.tagged(F.col("lang"), F.col("source")).alias("tagged"))


@query("SC6_json_object", "select event_id, regexp_extract('said: ' || props || ' end', '(?s)(\\{.*\\})', 1) as j from events")
def _(t):
    return t.events.select("event_id", scalars.json_object(F.concat(F.lit("said: "), F.col("props"), F.lit(" end"))).alias("j"))


@query("SC8_tag_content", "select page_id, coalesce(nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ''), html) as title from pages")
def _(t):
    return t.pages.select("page_id", scalars.tag_content(F.col("html"), "title").alias("title"))


@query("SC9_clip_key", "select l_orderkey || '_' || l_partkey || '-' || l_suppkey as k from lineitem")
def _(t):
    return t.lineitem.select(scalars.clip_key(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")).alias("k"))


@query("SC10_model_name", "select page_id, split_part(url, '/', 3) as host from pages")
def _(t):
    return t.pages.select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))


@query("SC11_list_digest", "select sha256(string_agg(n_name, chr(10) order by n_name) || chr(10)) as digest from nation")
def _(t):
    return t.nation.agg(F.sha2(F.concat(F.array_join(F.sort_array(F.collect_list("n_name")), "\n"), F.lit("\n")), 256).alias("digest"))


@query("SC12_cache_key", "select page_id, substr(sha1(url || length(html)), 1, 16) as k from pages")
def _(t):
    return t.pages.select("page_id", F.substring(F.sha1(F.concat("url", F.length("html").cast("string"))), 1, 16).alias("k"))


@query("SC13_rate", "select p_partkey as k, round(p_size::double / (1 + p_partkey % 7), 6) as r from part")
def _(t):
    text = F.concat(F.col("p_size").cast("string"), F.lit("/"), (F.col("p_partkey") % 7 + 1).cast("string"))
    return t.part.select(F.col("p_partkey").alias("k"), r4(scalars.rate(text), 6).alias("r"))


@query("SC14_to_factor", "select p_partkey as k, (round_even(p_size / 28.0, 0) * 28)::bigint as a, (ceil(p_size / 28.0) * 28)::bigint as b, (floor(p_size / 28.0) * 28)::bigint as c from part")
def _(t):
    s = F.col("p_size")
    return t.part.select(F.col("p_partkey").alias("k"), scalars.to_factor(s, 28).alias("a"), scalars.to_factor(s, 28, "ceil").alias("b"), scalars.to_factor(s, 28, "floor").alias("c"))


@query("SC18_fused_score", "select event_id, round(1 / (1 + exp(-((value / 1000 - 0.1107) / 0.07355 * 0.6104 + (value / 2000 + 0.08285) / 0.03774 * 0.3896))), 6) as s from events")
def _(t):
    return t.events.select("event_id", r4(scalars.fused_score(F.col("value") / 1000, F.col("value") / 2000), 6).alias("s"))


@query("SC19_likert", "select event_id, round((least(greatest(value / 20, 1.0), 5.0) - 1) / 4, 6) as s from events")
def _(t):
    return t.events.select("event_id", r4(scalars.likert(F.col("value") / 20), 6).alias("s"))


@query("SC23_preference", "select event_id, case event_type when 'click' then 1 when 'view' then -1 when 'purchase' then 0 else 22 end as p from events")
def _(t):
    e = F.col("event_type")
    return t.events.select("event_id", scalars.preference(F.when(e == "click", "A").when(e == "view", "B").when(e == "purchase", "same").otherwise("x")).alias("p"))


@query("SC26_seed", "select doc_id, 42 + 3 * 1000000 + doc_id as seed from documents")
def _(t):
    return t.documents.select("doc_id", scalars.paired_seed(42, F.col("doc_id"), 3).alias("seed"))


@query("SC28_run_id", "select doc_id, regexp_full_match(source || '.' || lang, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}') as ok from documents")
def _(t):
    return t.documents.select("doc_id", scalars.valid_run_id(F.concat("source", F.lit("."), "lang")).alias("ok"))


@query("SC30_prefix_ranges", "select o_custkey as k, o_orderkey, (sum(len) over w - len)::bigint as lo, (sum(len) over w)::bigint as hi from (select *, month(o_orderdate) as len from orders) window w as (partition by o_custkey order by o_orderkey)")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    n = F.month("o_orderdate")
    return t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey", (F.sum(n).over(w) - n).alias("lo"), F.sum(n).over(w).alias("hi"))


@query("SC32_suffix_once", f"with {CLIPS} select clip, 'c' || clip || '_' || frames || '_ori' || frames as name from clips")
def _(t):
    return t.clips.select("clip", scalars.with_suffix_once(F.concat(F.lit("c"), F.col("clip").cast("string")), F.col("frames")).alias("name"))


_C = "(select row_number() over (order by vec_id) - 1 as c, embedding as m from embeddings where vec_id < 8)"


@query("VEC2_nearest_centroid", f"""select vec_id, c as centroid, round(d, 5) as distance from (select vec_id, c, d, row_number() over (partition by vec_id order by d, c) as r from
  (select e.vec_id, k.c, sqrt(list_sum(list_transform(range(1, 65), lambda j: (e.embedding[j]::double - k.m[j]::double) ** 2))) as d from embeddings e, {_C} k)) where r = 1""")
def _(t):
    c = [list(r[0]) for r in t.embeddings.where("vec_id < 8").orderBy("vec_id").limit(8).select("embedding").collect()]
    return vectors.nearest_centroid(t.embeddings.select("vec_id", "embedding"), "embedding", c).select("vec_id", "centroid", r4("distance", 5).alias("distance"))


@query("VEC6_quantize", "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double + 0.5 * (round_even(x::double / 0.25, 0) * 0.25 - x::double))), 5) as s from embeddings")
def _(t):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", r4(vectors.total(vectors.quantize(v, 0.25, 0.5)), 5).alias("s"))


@query("VEC12_cosine_to_first", "select e.vec_id, round(list_cosine_similarity(e.embedding::double[], f.embedding::double[]), 5) as s from embeddings e, (select embedding from embeddings order by vec_id limit 1) f")
def _(t):
    first = t.embeddings.orderBy("vec_id").limit(1).select(F.col("embedding").alias("f"))
    return t.embeddings.crossJoin(F.broadcast(first)).select("vec_id", r4(vectors.cosine(F.col("embedding"), F.col("f")), 5).alias("s"))  # one row


@query("VEC11_l2_to_first", "select e.vec_id, round(list_distance(e.embedding::double[], f.embedding::double[]), 5) as d from embeddings e, (select embedding from embeddings order by vec_id limit 1) f")
def _(t):
    first = t.embeddings.orderBy("vec_id").limit(1).select(F.col("embedding").alias("f"))
    return t.embeddings.crossJoin(F.broadcast(first)).select("vec_id", r4(vectors.l2(F.col("embedding"), F.col("f")), 5).alias("d"))  # one row


@query("VEC1_kmeans", None)
def _(t):
    df = t.embeddings.select("vec_id", "embedding")
    return vectors.nearest_centroid(df, "embedding", vectors.kmeans(df, "embedding", 4, 5)).select("vec_id", "centroid")
