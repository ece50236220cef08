"""Queries of histories, memories, buffers, queues and monitors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import memory, projection, vectors
from tessera.plans.drawn import _draw, _unit
from tessera.plans.registry import SERIES, query, r4

#: A file's rows as its loader numbers them: by the MD5 of their key.
_DEALT = "row_number() over (partition by event_type order by md5(event_id::varchar)) - 1"


@query("RSH14_replaced", f"""with g as (select event_type, event_id, {_DEALT} as i, count(*) over (partition by event_type) as n from events where not (event_id % 7 = 0 or event_type = 'click')),
  s as (select event_type, max(n) as n from g group by 1)
  select event_type, event_id, event_id as source from g union all
  select b.event_type, b.event_id, g.event_id from (select * from events where event_id % 7 = 0 or event_type = 'click') b left join s using (event_type)
  left join g on g.event_type = b.event_type and g.i = {_draw("'14:' || b.event_id")} % s.n""")
def _(t):
    return memory.replaced(t.events, "event_type", "event_id", (F.col("event_id") % 7 == 0) | (F.col("event_type") == "click"), 14)


@query("RSH18_work_list", f"select event_type, event_id, i % 5 as worker, i // 5 as turn from (select event_type, event_id, {_DEALT} as i from events)")
def _(t):
    return memory.work_list(t.events, "event_type", "event_id", 5)


_LOG = "case event_id % 3 when 0 then 'done' when 1 then 'claim' else 'failed' end"


@query("STR2_queue_states", f"""with recursive l as (select user_id, event_id % 2 as w, {_LOG} as e, row_number() over (partition by user_id order by ts, event_id) as i from events),
  r as (select user_id, 0::bigint as i, 'queued' as state, null::bigint as worker, 0::bigint as attempts from (select distinct user_id from events) union all
  select r.user_id, l.i, case when e = 'claim' and state in ('queued', 'failed') then 'claimed' when e <> 'claim' and state = 'claimed' and worker = w then e else state end,
  case when e = 'claim' and state in ('queued', 'failed') then w else worker end, attempts + (e = 'claim' and state in ('queued', 'failed'))::bigint from r join l on l.user_id = r.user_id and l.i = r.i + 1)
  select user_id, arg_max(state, i) as state, max(struct_pack(i := i, w := worker)).w as worker, max(attempts) as attempts from r group by 1""")
def _(t):
    k = F.col("event_id") % 3
    log = t.events.select("user_id", "ts", "event_id", F.when(k == 0, "done").when(k == 1, "claim").otherwise("failed").alias("event"), (F.col("event_id") % 2).alias("who"))
    return memory.queue_states(log, "user_id", ["ts", "event_id"], "event", "who")


@query("STR5_buffer_updates", f"""with e as (select event_id, event_id // 100 as step, event_id % 4 as rank, user_id % 2 = 0 as clean from events),
  k as (select * from e where not clean or {_unit("'5:' || step || ':' || rank")} < 0.3)
  select step, rank, event_id, unnest(case when step <= 3 then range(0, 4) else [rank] end) as buffer from k""")
def _(t):
    rows = t.events.select("event_id", F.floor(F.col("event_id") / 100).alias("step"), (F.col("event_id") % 4).alias("rank"), "user_id")
    return memory.buffer_updates(rows, "step", "rank", "event_id", F.col("user_id") % 2 == 0, 3, 0.3, 4, 5)


@query("STR7_memory_reads", f"""with {SERIES}, w as (select *, count(*) filter (i % 3 = 2) over p as k from series window p as (partition by user_id order by i rows between unbounded preceding and 1 preceding))
  select user_id, i, round(coalesce(sum(case when i % 3 = 2 then 0.262627::double * value / pow(0.737373::double, k + 1) end) over (partition by user_id order by i rows between unbounded preceding and 1 preceding) * pow(0.737373::double, k), 0), 4) as memory from w""")
def _(t):
    return memory.memory_reads(t.series, "user_id", "i", "value", F.col("i") % 3 == 2, 0.737373).select("user_id", "i", r4("memory").alias("memory"))


@query("STR8_rollout", f"""with {SERIES}, h as (select user_id, i, value, count(*) over p as held, coalesce(sum(value) over p, 0) as past from series window p as (partition by user_id order by i rows between 19 preceding and 1 preceding))
  select user_id, i // 9 as section, count(*) as n, max(held) filter (i % 9 = 0) as held, round(max(past) filter (i % 9 = 0), 4) as history_sum, round(sum(value), 4) as section_sum from h group by 1, 2 having count(*) = 9""")
def _(t):
    got = memory.rollout(t.series, "user_id", "i", "value")
    return got.withColumns({"history_sum": r4("history_sum"), "section_sum": r4("section_sum")})


@query("STR10_resumed", """select o_orderkey, place from (select o_orderkey, md5('10:3:' || o_orderkey) as place from orders) where place > '4' order by place limit 200""")
def _(t):
    return memory.resumed(t.orders.select("o_orderkey"), "o_orderkey", 200, 3, "4", 10)


_POLLS = "floor(epoch(ts))::bigint as t, (floor(value * 10))::bigint as k, event_id % 4 = 0 as up"


@query("STR12_monitor", f"""with recursive p as (select user_id, {_POLLS}, row_number() over (partition by user_id order by floor(epoch(ts))::bigint, floor(value * 10), event_id % 4 = 0) as i from events),
  r as (select user_id, 0::bigint as i, null::bigint as t, null::varchar as action, 0::bigint as fails, -1::bigint as seen, null::bigint as sent from (select distinct user_id from events) union all
  select user_id, i, t, action, fails, case when action = 'resubmit' then k else seen end, case when action = 'resubmit' then t else sent end from
  (select *, case when k >= 1500 then 'done' when up then 'ok' when fails >= 3 then 'give_up' when t - sent < 86400 then 'wait' else 'resubmit' end as action from
  (select r.user_id, p.i, p.t, p.k, p.up, r.seen, r.sent, case when p.k >= 1500 or p.up then r.fails when p.k > r.seen then 0 else r.fails + 1 end as fails
  from r join p on p.user_id = r.user_id and p.i = r.i + 1 where r.action is null or r.action not in ('done', 'give_up'))))
  select user_id, t, action, fails from r where i > 0""")
def _(t):
    polls = t.events.select("user_id", F.unix_timestamp("ts").alias("t"), F.floor(F.col("value") * 10).alias("k"), (F.col("event_id") % 4 == 0).alias("up"))
    return memory.monitor(polls, "user_id", "t", "k", "up", 1500, 3, 86400)


@query("VEC7_projection", """with e as (select vec_id, embedding::double[] as v from embeddings where vec_id is not null), c as (select vec_id as j, v as m from e where vec_id < 4),
  d as (select e.vec_id, j, m, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as far from e, c)
  select vec_id, round(list_sum(arg_min(m, far)), 4) as total from d group by 1""")
def _(t):
    v = F.col("embedding").cast("array<double>")
    book = [r[0] for r in t.embeddings.where("vec_id < 4").select(v).orderBy("vec_id").collect()]  # a codebook of four rows
    return t.embeddings.select("vec_id", r4(vectors.total(memory.nearest_value(v, book))).alias("total"))


def _z(i: str) -> str:
    return f"(sqrt(-2 * ln(1 - {_unit(f"'17:r:' || vec_id || ':' || {i}")})) * cos(2 * pi() * {_unit(f"'17:a:' || vec_id || ':' || {i}")}))"


@query("VEC17_noise", f"""with s as (select vec_id, case when {_unit("'17:clean:' || vec_id")} < 0.1 then 0::double else {_unit("'17:sigma:' || vec_id")} / 3 end as sigma, embedding from embeddings),
  e as (select vec_id, sigma, unnest(embedding)::double as x, unnest(range(0, 64)) as i from s)
  select vec_id, round(max(sigma), 4) as sigma, round(sum(sigma * {_z("i")} + (1 - sigma) * x), 4) as total from e group by 1""")
def _(t):
    rows = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), memory.corruption(0.1, 1 / 3, 17, F.col("vec_id")).alias("s"))
    # a name of its own: inside a lambda, sigma would be the rounded column beside it
    return rows.select("vec_id", r4("s").alias("sigma"), r4(vectors.total(memory.noise_blend(F.col("v"), F.col("s"), memory.normal_vector(64, 17, F.col("vec_id"))))).alias("total"))


@query("VEC18_history_drop", f"""with d as (select vec_id, embedding, case when {_unit("'18:t:' || vec_id")} <= 0.2 then 't2v' when {_unit("'18:i:' || vec_id")} <= 0.3 then 'i2v' when {_unit("'18:v:' || vec_id")} <= 0.5 then 'v2v' else 'none' end as kind from embeddings),
  n as (select *, case kind when 't2v' then 19 when 'i2v' then 18 when 'v2v' then 1 + {_draw("'18:n:' || vec_id")} % 3 * 9 else 0 end as dropped from d)
  select vec_id, kind, least(dropped, 16) as long_tier, least(greatest(dropped - 16, 0), 2) as mid_tier, least(greatest(dropped - 18, 0), 1) as short_tier,
  round(coalesce(list_sum(embedding[dropped + 1:19]::double[]), 0), 4) as kept from n""")
def _(t):
    sizes = (16, 2, 1)
    v = F.slice(F.col("embedding").cast("array<double>"), 1, 19)
    rows = t.embeddings.select("vec_id", v.alias("v"), memory.history_drop(sizes, 9, 0.2, 0.3, 0.5, 18, F.col("vec_id")).alias("d"))
    tiers = [c.alias(n) for c, n in zip(memory.tiers_dropped(F.col("d.dropped"), sizes), ("long_tier", "mid_tier", "short_tier"))]
    return rows.select("vec_id", "d.kind", *tiers, r4(vectors.total(memory.zero_first(F.col("v"), F.col("d.dropped")))).alias("kept"))


@query("SC27_canonical_digest", """select s_suppkey, sha256('{"key":' || s_suppkey || ',"name":"' || s_name || '","nation":' || s_nationkey || '}') as digest from supplier""")
def _(t):
    return t.supplier.select("s_suppkey", memory.canonical_digest({"nation": F.col("s_nationkey"), "name": F.col("s_name"), "key": F.col("s_suppkey")}).alias("digest"))


@query("SC29_collate", f"""with {SERIES} select user_id, i // 16 as batch, count(*) as n, round(arg_max(value, i), 4) as last, min_by(event_type, i) as kind from series group by 1, 2""")
def _(t):
    rows = t.series.withColumn("batch", F.floor(F.col("i") / 16))
    got = memory.collated(rows, ["user_id", "batch"], "i", ["value"], ["event_type"])
    return got.select("user_id", "batch", F.size("value").cast("long").alias("n"), r4(F.element_at("value", -1)).alias("last"), F.col("event_type").alias("kind"))


#: Of each metric, whether more is better.
DIRECTIONS = (("click", True), ("purchase", True), ("view", False))


@query("UDF4_dispatch", """with d(event_type, higher) as (values ('click', true), ('purchase', true), ('view', false))
  select user_id, event_type, higher, round(case when higher then max(value) else min(value) end, 4) as best from events join d using (event_type) group by 1, 2, 3""")
def _(t):
    table = t.spark.createDataFrame(DIRECTIONS, "event_type string, higher boolean")
    rows = t.events.join(F.broadcast(table), "event_type").groupBy("user_id", "event_type", "higher")  # a row a metric
    return rows.agg(F.max("value").alias("hi"), F.min("value").alias("lo")).select("user_id", "event_type", "higher", r4(F.when(F.col("higher"), F.col("hi")).otherwise(F.col("lo"))).alias("best"))


# --- projections of windows: eight frames of eight channels, the first three of some windows padding

_FRAMES = """w as (select vec_id, label, f, c, case when vec_id % 7 < 2 and f < 3 then 0::double else embedding[f * 8 + c + 1]::double end as x
    from embeddings, range(0, 8) a(f), range(0, 8) b(c)),
  r as (select vec_id, label, f, bool_or(x <> 0) as has from w group by 1, 2, 3)"""
#: A codebook of four rows.
_BOOK = [[0.2] * 8, [-0.2] * 8, [0.2, -0.2] * 4, [-0.2, 0.2] * 4]


def _frames(t):
    e = F.col("embedding").cast("array<double>")
    whole = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda f: F.when((F.col("vec_id") % 7 < 2) & (f < 3), F.array_repeat(F.lit(0.0), 8)).otherwise(F.slice(e, f * 8 + 1, 8)))
    return t.embeddings.select("vec_id", "label", whole.alias("frames"))


@query("VEC7_codebook_padding", f"""with {_FRAMES}, m as (select * from (values {", ".join(f"({j}, {i}, {x}::double)" for j, row in enumerate(_BOOK) for i, x in enumerate(row))}) v(j, c, m)),
  d as (select vec_id, f, j, sum((x - m) * (x - m)) as far from w join m using (c) group by 1, 2, 3), b as (select vec_id, f, min(struct_pack(far := round(far, 9), j := j)).j as j from d group by 1, 2)
  select w.vec_id, round(sum(case when has then x + 0.75 * (m - x) else x end), 4) as total, count(*) filter (where not has)::bigint as padding
  from w join r on r.vec_id = w.vec_id and r.f = w.f join b on b.vec_id = w.vec_id and b.f = w.f join m on m.j = b.j and m.c = w.c group by 1""")
def _(t):
    new = projection.blended(F.col("frames"), lambda f: memory.nearest_value(f, _BOOK), alpha=0.75)
    padding = F.size(F.filter("frames", lambda f: ~projection.real(f))) * 8
    return _frames(t).select("vec_id", r4(vectors.total(F.flatten(new))).alias("total"), padding.cast("long").alias("padding"))


@query("VEC8_frozen_reference", f"""with {_FRAMES}, st as (select w.label, w.vec_id, w.c, avg(x) as m, stddev_samp(x) as s from w join r on r.vec_id = w.vec_id and r.f = w.f where has group by 1, 2, 3),
  u as (select label, vec_id, bool_and(has) as whole, bool_or(has) as filled from r group by 1, 2), ref as (select label, min(vec_id) as v from u where whole group by 1),
  y as (select w.vec_id, w.vec_id > ref.v and filled as applied,
      case when w.vec_id > ref.v and has then x * (rs.s / greatest(st.s, 1e-4)) + (rs.m - st.m * (rs.s / greatest(st.s, 1e-4))) else x end as y
    from w join r on r.vec_id = w.vec_id and r.f = w.f join u on u.vec_id = w.vec_id join ref on ref.label = w.label
    join st on st.vec_id = w.vec_id and st.c = w.c join st rs on rs.vec_id = ref.v and rs.c = w.c)
  select vec_id, round(sum(y), 4) as total, bool_or(applied) as applied from y group by 1""")
def _(t):
    rows = projection.renormed(_frames(t), "label", "vec_id", "frames")
    return rows.select("vec_id", r4(vectors.total(F.flatten("frames"))).alias("total"), "applied")
