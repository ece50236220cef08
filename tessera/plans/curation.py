"""Queries over captions, sizes, attention shares and sampling schedules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import ranking, rows, series, vectors
from tessera.plans.registry import CLIPS, QUERIES, SERIES, SQL, query, r4


@query("FLT14_numeric_metrics", """select k, case v when 'true' then 1.0 when 'false' then 0.0 else try_cast(v as double) end as v from
  (select p_partkey as k, case p_partkey % 4 when 0 then 'true' when 1 then p_size::varchar when 2 then p_brand else 'false' end as v from part) where v in ('true', 'false') or try_cast(v as double) is not null""")
def _(t):
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, "true").when(k % 4 == 1, F.col("p_size").cast("string")).when(k % 4 == 2, F.col("p_brand")).otherwise("false")
    return t.part.select(k.alias("k"), scalars.metric_number(text).alias("v")).where("v is not null")


@query("FLT15_probe_records", "select l_orderkey as k, l_linenumber as step from lineitem where l_returnflag = 'R' and l_linenumber = 2")
def _(t):
    return rows.where_equal(t.lineitem, {"l_returnflag": "R", "l_linenumber": 2, "l_linestatus": "avg", "l_shipmode": None}).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("step"))


@query("JN2_required_version", f"""with {CLIPS} select clip, case when d.doc_id is null then 'no_cap' end as reason from clips left join
  (select * from documents where lang = 'en' and text <> '') d on d.doc_id = clip""")
def _(t):
    caps = t.documents.select(F.col("doc_id").alias("clip"), "lang", "text")
    return rows.require_version(t.clips, caps, "clip", "lang", "en", "text").select("clip", "reason")


@query("JN8_strict_lookup", "select o_orderkey as k, c_mktsegment as segment from orders join customer on o_custkey = c_custkey")
def _(t):
    side = t.customer.select(F.col("c_custkey").alias("c"), F.col("c_mktsegment").alias("segment"))
    return rows.strict_lookup(t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")), side, "c", "segment").select("k", "segment")


@query("AGG3_nonnull_mean", "select toxic, round(avg(quality), 6) as mean, count(quality) as n from labels group by 1")
def _(t):
    return t.labels.groupBy("toxic").agg(r4(F.avg("quality"), 6).alias("mean"), F.count("quality").alias("n"))


_HEADS = "(select label, unnest(range(0, 64)) as head, unnest(embedding)::double as x from embeddings)"


@query("AGG11_top_head", f"""select label, arg_max(head, m)::int as top_head, round(max(m), 5) as top, round(avg(m), 5) as mean from
  (select label, head, avg(x) as m from {_HEADS} group by 1, 2) group by 1""")
def _(t):
    m = t.embeddings.select("label", F.posexplode("embedding").alias("head", "x")).groupBy("label", "head").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return m.groupBy("label").agg(F.max_by("head", "m").alias("top_head"), r4(F.max("m"), 5).alias("top"), r4(F.avg("m"), 5).alias("mean"))


_SAMPLED = f"""with {SERIES}, v as (select user_id, list(value order by i) as v from series group by 1),
  p as (select user_id, v, k, (('0x' || substr(md5('3:' || k || ':a'), 1, 8))::bigint % len(v))::int as a, (('0x' || substr(md5('3:' || k || ':b'), 1, 8))::bigint % len(v))::int as b
    from v, (select unnest(range(0, 4000)) as k) where len(v) * (len(v) - 1) / 2 > 4000),
  e as (select user_id, v, unnest(range(0, len(v))) as a from v where len(v) * (len(v) - 1) / 2 <= 4000),
  s as (select user_id, (v[b + 1] - v[a + 1]) / (b - a) as s from p where a <> b union all
    select user_id, (v[b + 1] - v[a + 1]) / (b - a) from (select user_id, v, a, unnest(range(a + 1, len(v))) as b from e))
  select v.user_id, round(median(s), 5) as slope from v left join s on v.user_id = s.user_id group by 1"""


@query("AGG21_theil_sen_sampled", _SAMPLED)
@query("AGG21_theil_sen_sampled_whole", _SAMPLED)
def _(t):
    return series.sampled_theil_sen(t.series, "user_id", "i", "value", 4000, 3).select("user_id", r4("slope", 5).alias("slope"))


@query("AGG22_total_rating", "select l_returnflag as k, round(sum(case when l_quantity <= 40 then l_quantity * l_linenumber else 0 end), 4) as total from lineitem group by 1")
def _(t):
    g = t.lineitem.select(F.col("l_returnflag").alias("k"), F.when(F.col("l_quantity") <= 40, F.col("l_quantity").cast("double")).alias("m"), F.col("l_linenumber").alias("w"))
    return ranking.weighted_total(g, "k", "m", "w").select("k", r4("total").alias("total"))


@query("AGG24_rate_per_minute", "select event_type, count(*) as n, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) * 60, 6) as per_minute from events group by 1 having max(ts) > min(ts)")
def _(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    g = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), ((F.max(us) - F.min(us)) / 1e6).alias("s"))
    return g.where("s > 0").select("event_type", "n", r4(F.col("n") / F.col("s") * 60, 6).alias("per_minute"))


@query("AGG27_lists", "select o_custkey as k, array_to_string(list(o_orderkey order by o_orderkey)::varchar[], ',') as keys from orders group by 1")
def _(t):
    return t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.array_join(F.sort_array(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("keys"))


@query("AGG29_mean_square_error", "select a.vec_id, round(list_avg(list_transform(range(1, 65), lambda j: (a.embedding[j]::double - b.embedding[j]::double) ** 2)), 7) as mse from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def _(t):
    a = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("b"))
    d = F.zip_with("a", "b", lambda x, y: (x - y) * (x - y))
    return a.join(b, "vec_id").select("vec_id", r4(vectors.total(d) / F.size("a"), 7).alias("mse"))


@query("AGG30_used_centroids", f"select count(distinct centroid) as used from ({SQL['VEC2_nearest_centroid']}) x")
def _(t):
    return QUERIES["VEC2_nearest_centroid"](t.spark, t.sf_dir).agg(F.countDistinct("centroid").alias("used"))


@query("WIN9_runaway", f"""with q as ({SQL['AGG16_quartile_blocks']}), n as (select user_id, count(*) as n from events group by 1),
  w as (select user_id, max(m) filter (q = 0) as a, max(m) filter (q = 2) as c, max(m) filter (q = 3) as d from q group by 1)
  select n.user_id, case when n < 4 or a = 0 then false else coalesce(d / nullif(a, 0) > 2 and d >= c, false) end as runaway from n join w on n.user_id = w.user_id""")
def _(t):
    pick = lambda q: F.max(F.when(F.col("q") == q, F.col("m")))
    w = QUERIES["AGG16_quartile_blocks"](t.spark, t.sf_dir).groupBy("user_id").agg(pick(0).alias("a"), pick(2).alias("c"), pick(3).alias("d"))
    n = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(w, "user_id").select("user_id", series.runaway(F.col("a"), F.col("c"), F.col("d"), F.col("n")).alias("runaway"))


@query("WIN15_spectrum", f"""with {SERIES}, d as (select a.user_id, a.i, abs(b.value - a.value) as s from series a join series b on a.user_id = b.user_id and b.i = a.i + 1),
  m as (select user_id, count(*) as n, avg(s) as mean from d group by 1),
  k as (select user_id, n, mean, unnest(range(1, n // 2 + 1)) as k from m where n >= 21),
  near as (select user_id, arg_min(k, abs(k * 7 - n) * 1000000 + k) as peak from k group by 1),
  h as (select k.user_id, k.k, any_value(k.n) as n, sqrt(sum((s - mean) * cos(2 * pi() * k.k * i / n)) ** 2 + sum((s - mean) * sin(2 * pi() * k.k * i / n)) ** 2) as h
    from k join d on d.user_id = k.user_id group by 1, 2),
  r as (select h.user_id, max(case when k = peak then h end) as p, median(case when k * 100 > n and k * 5 < n then h end) as m from h join near on near.user_id = h.user_id group by 1)
  select u.user_id, round(case when m > 0 then p / m end, 5) as ratio from (select distinct user_id from series) u left join r on r.user_id = u.user_id""")
def _(t):
    return series.spectrum_ratio(t.series, "user_id", "i", "value", 7).select("user_id", r4("ratio", 5).alias("ratio"))


@query("WIN17_switches", f"select clip, array_to_string(list(c order by c)::varchar[], ',') as switches from (select clip, event, min(chunk) as c from ({SQL['JN13_interval_owner']}) x group by 1, 2) where event > 0 group by 1")
def _(t):
    first = QUERIES["JN13_interval_owner"](t.spark, t.sf_dir).where("event > 0").groupBy("clip", "event").agg(F.min("chunk").alias("c"))
    return first.groupBy("clip").agg(F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",").alias("switches"))


@query("WIN18_switch_plan", f"select clip, event, count(*) as chunks, min(chunk) as first_chunk from ({SQL['JN13_interval_owner']}) x group by 1, 2")
def _(t):
    return QUERIES["JN13_interval_owner"](t.spark, t.sf_dir).groupBy("clip", "event").agg(F.count(F.lit(1)).alias("chunks"), F.min("chunk").alias("first_chunk"))


@query("WIN20_section_slice", f"with {CLIPS} select clip, (clip % (frames // 33 - 4)) * 9 as first, 64::bigint as n from clips where frames // 33 >= 5")
def _(t):
    n = F.floor(F.col("frames") / 33)
    first, length = series.section_slice(F.col("clip") % (n - 4), 5)
    return t.clips.where(rows.rollout_allowed("frames", 5)).select("clip", first.alias("first"), length.alias("n"))


@query("WIN25_middle_frames", f"""with {CLIPS} select clip, array_to_string((case when frames >= 16 then list_transform(range(0, 16), lambda i: (frames * i // 16 + frames * (i + 1) // 16 - 1) // 2)
  else list_transform(range(0, 16), lambda i: least(i, frames - 1)) end)::varchar[], ',') as f from clips""")
def _(t):
    return t.clips.select("clip", F.array_join(series.middle_frames(F.col("frames"), 16).cast("array<string>"), ",").alias("f"))


@query("WIN26_every_second", f"with {SERIES} select user_id, i, value from series where i % 2 = 0")
def _(t):
    return t.series.where(ranking.shard_of(F.col("i"), 2) == 0).select("user_id", "i", "value")


@query("WIN27_even_rows", f"""with {SERIES}, n as (select *, count(*) over (partition by user_id) as n from series) select user_id, i, value from n
  where list_contains(list_transform(range(0, 5), lambda j: round_even(j * (n - 1) / 4.0, 0)::bigint), i)""")
def _(t):
    s = t.series.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    return s.where(F.array_contains(scalars.uniform_indices(F.col("n"), 5), F.col("i"))).select("user_id", "i", "value")


@query("WIN29_window_mean", f"with {SERIES} select user_id, round(avg(value) filter (i >= 3 and i < 9), 4) as m from series group by 1")
def _(t):
    return series.ordered_values(t.series, "user_id", "i", "value").select("user_id", r4(series.window_mean(F.col("series"), 3, 9)).alias("m"))


@query("RNK6_aliases", "select event_id, case event_type when 'click' then 'motion' when 'view' then 'aesthetic' end as metric from events where event_type in ('click', 'view')")
def _(t):
    name = ranking.resolve_alias(F.upper("event_type"), {"click": "motion", "view": "aesthetic"})
    return t.events.select("event_id", name.alias("metric")).where("metric is not null")


@query("RNK10_columns", "select n_name, n_nationkey from nation")
def _(t):
    return ranking.ordered_columns(t.nation, ["n_name", "missing", "n_nationkey"])


@query("RNK15_newest_checkpoint", "select max(step) as step from (select try_cast(regexp_extract(p_brand, '([0-9]+)$', 1) as int) as step from part) where step > 10")
def _(t):
    return t.part.select(ranking.numeric_suffix(F.col("p_brand")).alias("step")).where("step > 10").agg(F.max("step").alias("step"))


@query("RNK16_card_order", """select n_nationkey as k, o::bigint as card_order, row_number() over (partition by o order by n_name, n_nationkey) as place from
  (select *, case when n_regionkey < 2 then n_regionkey else 500 end as o from nation)""")
def _(t):
    o = F.coalesce(F.when(F.col("n_regionkey") < 2, F.col("n_regionkey")), F.lit(500)).cast("long")
    place = F.row_number().over(Window.partitionBy("card_order").orderBy("n_name", "k")).cast("long")
    return t.nation.select(F.col("n_nationkey").alias("k"), "n_name", o.alias("card_order")).withColumn("place", place).drop("n_name")


@query("RNK17_resource", "select s_suppkey as k from supplier where s_nationkey < 12 and s_acctbal >= 100 order by s_acctbal desc, s_suppkey limit 1")
def _(t):
    s = t.supplier.select(F.col("s_suppkey").alias("k"), F.when(F.col("s_nationkey") < 12, "Default").otherwise("Exclusive").alias("mode"), F.col("s_acctbal").alias("free"))
    return ranking.pick_resource(s, "Default", "free", 100, "k").select("k")


@query("RSH9_proportional", "select greatest(1, least(7, round_even(8.0 * a / (a + b), 0)))::int as of_first, 8 - greatest(1, least(7, round_even(8.0 * a / (a + b), 0)))::int as of_second from (select (select count(*) from orders) as a, (select count(*) from customer) as b)")
def _(t):
    a, b = ranking.proportional_shards(t.orders.count(), t.customer.count(), 8)
    return t.spark.createDataFrame([(a, b)], "of_first int, of_second int")


@query("RSH17_version_pick", """select doc_id, h[1 + (('0x' || substr(md5('6:' || doc_id), 1, 8))::bigint % nullif(len(h), 0))::int] as v from
  (select doc_id, list_filter([lang, source], lambda x: x is not null) as h from documents)""")
def _(t):
    return t.documents.select("doc_id", ranking.pick_version(F.array("lang", "source"), F.col("doc_id"), 6).alias("v"))


@query("SC16_frame_count", f"with {CLIPS} select clip, (floor(least(greatest(frames / fps * 2.0, 4.0), 768.0, frames::double) / 2) * 2)::bigint as n from clips")
def _(t):
    return t.clips.select("clip", scalars.frame_count(F.col("frames"), F.col("fps"), 2.0, 4, 768).alias("n"))


@query("SC17_even", f"with {CLIPS} select clip, (round_even(frames / 2.0, 0) * 2)::bigint as a, (round_even((frames // 10) / 2.0, 0) * 2)::bigint as b from clips")
def _(t):
    return t.clips.select("clip", scalars.even(F.col("frames")).alias("a"), scalars.even(F.floor(F.col("frames") / 10)).alias("b"))


@query("SC22_entropy", """select vec_id, round(-list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-12)))), 5) as h from
  (select vec_id, list_transform(embedding, lambda x: abs(x::double)) as p from embeddings)""")
def _(t):
    p = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.abs(x))
    return t.embeddings.select("vec_id", r4(vectors.entropy(p), 5).alias("h"))


@query("SC24_interpolated", """select a.vec_id, round(list_sum(list_transform(range(1, 65), lambda j: a.embedding[j]::double + (b.embedding[j]::double - a.embedding[j]::double) / 4)), 5) as s
  from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def _(t):
    a = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("b"))
    return a.join(b, "vec_id").select("vec_id", r4(vectors.total(vectors.interpolate(F.col("a"), F.col("b"), 5)[1]), 5).alias("s"))


@query("SC31_uniform_subset", f"with {CLIPS} select clip, array_to_string(list_transform(range(0, 4), lambda i: round_even(i * (frames - 1) / 3.0, 0)::bigint)::varchar[], ',') as f from clips where frames >= 10")
def _(t):
    return t.clips.where("frames >= 10").select("clip", F.array_join(scalars.uniform_indices(F.col("frames"), 4).cast("array<string>"), ",").alias("f"))


@query("VEC8_renormalized", """select vec_id, round(list_sum(list_transform(e, lambda x: x * (0.5 / greatest(s, 1e-4)) + (0.1 - m * (0.5 / greatest(s, 1e-4))))), 4) as total from
  (select vec_id, e, list_avg(e) as m, list_stddev_pop(e) as s from (select vec_id, embedding::double[] as e from embeddings))""")
def _(t):
    v = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    v = v.withColumn("m", vectors.total(F.col("e")) / F.size("e"))
    v = v.withColumn("s", F.sqrt(vectors.total(F.transform("e", lambda x: (x - F.col("m")) * (x - F.col("m")))) / F.size("e")))
    out = vectors.renormalize(F.col("e"), F.col("m"), F.col("s"), F.lit(0.1), F.lit(0.5))
    return v.select("vec_id", r4(vectors.total(out)).alias("total"))
