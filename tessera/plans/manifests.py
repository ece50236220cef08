"""Queries over manifests: scans, filters, joins, sets, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import intervals, ranking, rows
from tessera.plans.registry import CLIPS, query, r4


@query("FLT1_min_frames", f"with {CLIPS} select clip, frames from clips where frames >= 121")
def _(t):
    return rows.min_frames(t.clips, "frames").select("clip", "frames")


@query("FLT2_resolution_allowed", f"with {CLIPS} select clip, h, w from clips where (h=368 and w=640) or (h=184 and w=320) or (h=92 and w=160)")
def _(t):
    return t.clips.where(rows.resolution_allowed("h", "w", 368, 640)).select("clip", "h", "w")


@query("FLT3_rollout_length", f"with {CLIPS} select clip, frames // 33 as sections from clips where frames // 33 >= 5")
def _(t):
    return t.clips.where(rows.rollout_allowed("frames", 5)).select("clip", F.floor(F.col("frames") / 33).alias("sections"))


@query("FLT4_single_bucket", f"with {CLIPS} select clip from clips where frames = 330 and h = 368 and w = 640")
def _(t):
    return t.clips.where("frames = 330 and h = 368 and w = 640").select("clip")


@query("FLT5_stride_feasible", f"with {CLIPS} select clip, greatest(floor(fps / 24.0)::int, 1) as stride from clips where 81 * greatest(floor(fps / 24.0)::int, 1) < frames")
def _(t):
    c = t.clips.withColumn("stride", rows.frame_stride("fps", 24.0))
    return c.where(F.lit(81) * F.col("stride") < F.col("frames")).select("clip", "stride")


@query("FLT6_effective_length", f"with {CLIPS}, s as (select clip, frames, greatest(floor(fps / 24.0)::int, 1) as s from clips) select clip, (frames + s - 1) // s as n from s")
def _(t):
    return t.clips.select("clip", rows.ceil_div("frames", rows.frame_stride("fps", 24.0)).alias("n"))


@query("FLT7_path_rewrite", "select p_partkey as clip, case when p_brand like 'Brand#%' then substr(p_brand, 7) else p_brand end as path from part")
def _(t):
    return t.part.select(F.col("p_partkey").alias("clip"), rows.strip_prefixes("p_brand", ["Brand#"]).alias("path"))


@query("FLT8_seeded_choice", "select p_partkey as clip, ['368x640','184x320','92x160'][1 + (ascii(substr(md5('7:' || p_partkey), 1, 1)) % 3)] as size from part")
def _(t):
    i = F.ascii(F.substring(rows.seeded(7, "p_partkey"), 1, 1)) % 3
    return t.part.select(F.col("p_partkey").alias("clip"), F.get(F.array(*map(F.lit, ["368x640", "184x320", "92x160"])), i).alias("size"))


_CHECKS = "case when frames < 121 then 'short' when h < 200 then 'small' when price > 1500 then 'price' end"


@query("FLT9_drop_reasons", f"with {CLIPS} select reason, count(*) as n from (select {_CHECKS} as reason from clips) where reason is not null group by reason")
def _(t):
    checks = [("short", F.col("frames") < 121), ("small", F.col("h") < 200), ("price", F.col("price") > 1500)]
    return rows.drop_report(t.clips, checks)[1]


@query("FLT9_kept", f"with {CLIPS} select clip from (select clip, {_CHECKS} as reason from clips) where reason is null")
def _(t):
    checks = [("short", F.col("frames") < 121), ("small", F.col("h") < 200), ("price", F.col("price") > 1500)]
    return rows.drop_report(t.clips, checks)[0].select("clip")


@query("FLT10_name_prefix", "select p_partkey as clip from part where starts_with(p_brand, 'Brand#1') or starts_with(p_brand, 'Brand#3')")
def _(t):
    b = F.col("p_brand")
    return t.part.where(b.startswith("Brand#1") | b.startswith("Brand#3")).select(F.col("p_partkey").alias("clip"))


@query("FLT11_nonempty_captions", "select conv_id, turn from conversations where text is not null and text <> '' and role is not null")
def _(t):
    return t.conversations.where("text is not null and text <> '' and role is not null").select("conv_id", "turn")


@query("FLT12_take_first", f"with {CLIPS} select clip from clips where frames >= 121 order by clip limit 100")
def _(t):
    return rows.min_frames(t.clips, "frames").orderBy("clip").limit(100).select("clip")


@query("FLT13_stem_key", "select page_id, regexp_replace(split_part(url, '/', -1), '\\.mp4$', '') as stem from pages")
def _(t):
    return t.pages.select("page_id", rows.stem("url").alias("stem"))


@query("FLT16_step_lines", "select l_orderkey as k, l_linenumber as step from lineitem where l_quantity >= 10 and l_linenumber <= 5")
def _(t):
    return t.lineitem.where("l_quantity >= 10 and l_linenumber <= 5").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("step"))


@query("FLT17_first_version", "select doc_id, coalesce(nullif(lang, ''), nullif(source, '')) as v from documents")
def _(t):
    return t.documents.select("doc_id", rows.first_nonempty("lang", "source").alias("v"))


@query("FLT18_finite", "select event_id, value from events")
def _(t):
    return t.events.select("event_id", rows.require_finite("value").alias("value"))


@query("FLT19_complete_shards", "select user_id % 8 as shard, bool_and(value is not null and event_type is not null) as complete from events group by 1")
def _(t):
    ok = F.col("value").isNotNull() & F.col("event_type").isNotNull()
    return t.events.groupBy((F.col("user_id") % 8).alias("shard")).agg(F.bool_and(ok).alias("complete"))


@query("JN1_metadata_join", """select case when c_custkey is null then 'no_meta' when c_acctbal < 0 then 'bad_meta' end as reason, count(*) as n
  from orders left join customer on o_custkey = c_custkey group by 1""")
def _(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    reason = rows.first_failing_reason([("no_meta", F.col("c_custkey").isNull()), ("bad_meta", F.col("c_acctbal") < 0)])
    return j.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("JN3_existing", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000)")
def _(t):
    have = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return rows.existing(t.orders, have, "o_custkey").select("o_orderkey")


@query("JN4_caption_fallback", """select d.doc_id, coalesce(case when q.quality = 1 then 'good' end, d.source) as caption, (q.quality = 1) is true as from_side
  from documents d left join labels q on d.doc_id = q.doc_id""")
def _(t):
    side = t.labels.where("quality = 1").select("doc_id", F.lit("good").alias("caption"))
    return rows.lookup(t.documents.select("doc_id", "source"), side, "doc_id", "caption", F.col("source")).select("doc_id", "caption", "from_side")


@query("JN5_resume_todo", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def _(t):
    return rows.todo(t.documents.select("doc_id"), t.labels, "doc_id")


@query("JN6_missing", "select doc_id from documents except select doc_id from labels where quality = 1")
def _(t):
    return t.documents.select("doc_id").exceptAll(t.labels.where("quality = 1").select("doc_id"))


@query("JN7_prioritized_sidecars", """select c_custkey as k, case when c_mktsegment = 'BUILDING' then 'a' when c_nationkey < 10 then 'b' end as v
  from customer where c_mktsegment = 'BUILDING' or c_nationkey < 10""")
def _(t):
    c = t.customer.withColumnRenamed("c_custkey", "k")
    return rows.prioritized([c.where("c_mktsegment = 'BUILDING'").select("k", F.lit("a").alias("v")), c.where("c_nationkey < 10").select("k", F.lit("b").alias("v"))], "k")


@query("JN9_replica_source", "select conv_id, turn, regexp_replace('clip' || conv_id || '_rep' || turn, '_rep[0-9]+$', '') as source from conversations")
def _(t):
    name = F.concat(F.lit("clip"), F.col("conv_id").cast("string"), F.lit("_rep"), F.col("turn").cast("string"))
    return t.conversations.select("conv_id", "turn", F.regexp_replace(name, "_rep[0-9]+$", "").alias("source"))


@query("JN10_results_with_prompts", "select l.doc_id, l.toxic, d.lang from labels l join documents d on l.doc_id = d.doc_id")
def _(t):
    return t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select("doc_id", "toxic", "lang")


@query("JN11_paired_drift", """select l_orderkey as k, a as first_value, b as last_value, b - a as delta from (select l_orderkey, max(l_quantity) filter (l_linenumber = 1) as a,
  max(l_quantity) filter (l_linenumber = 3) as b from lineitem group by 1) where a is not null and b is not null""")
def _(t):
    df = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("string").alias("s"), "l_quantity")
    return rows.paired(df, ["k"], "s", "1", "3", "l_quantity")


@query("JN12_baseline_delta", """select a.l_orderkey as k, a.l_linenumber as i, a.l_quantity - b.l_quantity as delta from lineitem a left join
  (select l_orderkey, l_quantity from lineitem where l_linenumber = 1) b on a.l_orderkey = b.l_orderkey""")
def _(t):
    a = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), "l_quantity")
    b = a.where("i = 1").select("k", F.col("l_quantity").alias("b"))
    return a.join(b, "k", "left").select("k", "i", (F.col("l_quantity") - F.col("b")).alias("delta"))


def _events(t):
    """Three events a clip: from its start, from 0.3 and from 0.55 of its frames."""
    n = F.col("frames")
    # 0.3 and 0.55 of a frame count that is a multiple of ten never lie on the half except for 0.55 of odd tens
    cuts = F.array(F.lit(0).cast("long"), F.round(n * 0.3).cast("long"), F.round(n * 0.55).cast("long"), n)
    rows = t.clips.select("clip", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("event"), cuts.alias("_c"))
    return rows.select("clip", "event", F.get("_c", F.col("event")).alias("start"), F.get("_c", F.col("event") + 1).alias("stop"))


def _chunks(t):
    """Whole chunks of 33 frames."""
    rows = t.clips.where("frames >= 33").select("clip", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("frames") / 33) - 1)).alias("chunk"))
    return rows.select("clip", "chunk", (F.col("chunk") * 33).alias("lo"), (F.col("chunk") * 33 + 33).alias("hi"))


@query("JN13_interval_owner", f"""with {CLIPS}, e as (select clip, unnest([0, 1, 2]) as ev, (frames * 0.3)::bigint as c1, (frames * 0.55)::bigint as c2, frames from clips),
  b as (select clip, ev, [0, c1, c2][1 + ev] as s, [c1, c2, frames][1 + ev] as z, frames from e),
  k as (select clip, unnest(range(0, frames // 33)) as chunk from clips)
  select clip, chunk, ev as event from (select k.clip, k.chunk, b.ev, row_number() over (partition by k.clip, k.chunk
    order by greatest(0, least(k.chunk * 33 + 33, b.z) - greatest(k.chunk * 33, b.s)) desc, b.ev) as r from k join b on k.clip = b.clip) where r = 1""")
def _(t):
    return intervals.owners(_chunks(t), _events(t), ["clip"], "chunk", ("lo", "hi"), "event", ("start", "stop"), 33)


@query("JN13_overlaps", """with s as (select client_id, sale_id, epoch_us(sold_at) as lo, epoch_us(sold_at) + 600000000::bigint * (1 + coalesce(priority, 0)) as hi from sales where sold_at is not null),
  c as (select client_id, click_id, epoch_us(ts) as lo, epoch_us(ts) + 120000000 as hi from clicks where ts is not null)
  select s.client_id, s.sale_id, c.click_id, count(*)::bigint as n, sum(least(s.hi, c.hi) - greatest(s.lo, c.lo))::bigint as overlap
  from s join c on s.client_id = c.client_id and s.lo < c.hi and c.lo < s.hi group by 1, 2, 3""")
def _(t):
    """Clicks on screen (two minutes) while a sale of the same client is open (ten minutes and more by priority)."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    s = t.sales.where("sold_at is not null").select("client_id", "sale_id", us("sold_at").alias("lo"), (us("sold_at") + F.lit(600_000_000).cast("long") * (1 + F.coalesce("priority", F.lit(0)))).alias("hi"))
    c = t.clicks.where("ts is not null").select("client_id", "click_id", us("ts").alias("start"), (us("ts") + 120_000_000).alias("stop"))
    pairs = intervals.overlapping(s, c, ["client_id"], ("lo", "hi"), ("start", "stop"), 600_000_000)
    return pairs.groupBy("client_id", F.col("l.sale_id").alias("sale_id"), F.col("r.click_id").alias("click_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("overlap").alias("overlap"))


@query("JN14_prompt_by_index", "select c_custkey as k, coalesce(n_name, '') as prompt from customer left join nation on c_custkey = n_nationkey")
def _(t):
    n = t.nation.select(F.col("n_nationkey").cast("long").alias("c_custkey"), "n_name")
    return t.customer.select("c_custkey").join(F.broadcast(n), "c_custkey", "left").select(F.col("c_custkey").alias("k"), F.coalesce("n_name", F.lit("")).alias("prompt"))


@query("JN15_missing_cells", """select n_nationkey as model, s as prompt from nation cross join (select distinct c_mktsegment as s from customer)
  where not exists (select 1 from customer where c_nationkey = n_nationkey and c_mktsegment = s and c_acctbal > 9000)""")
def _(t):
    models = t.nation.select(F.col("n_nationkey").alias("model"))
    prompts = t.customer.select(F.col("c_mktsegment").alias("prompt")).distinct()
    have = t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("model"), F.col("c_mktsegment").alias("prompt"))
    # two dimension tables of fixed size, prompts as an array in each model's row
    grid = models.join(F.broadcast(prompts.groupBy().agg(F.collect_set("prompt").alias("p"))), how="cross").select("model", F.explode("p").alias("prompt"))
    return grid.join(have.distinct(), ["model", "prompt"], "left_anti")


@query("JN16_common_keys", "select l_orderkey as k, l_linenumber as i from lineitem where l_returnflag = 'R' intersect select l_orderkey, l_linenumber from lineitem where l_linestatus = 'F'")
def _(t):
    k = [F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i")]
    return t.lineitem.where("l_returnflag = 'R'").select(*k).intersect(t.lineitem.where("l_linestatus = 'F'").select(*k))


@query("JN17_side_table", "select d.doc_id, l.quality from documents d join labels l on d.doc_id = l.doc_id where d.text is not null")
def _(t):
    return t.documents.where("text is not null").select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id")


@query("JN18_base_resolution", f"with {CLIPS} select a.clip, b.clip as base from clips a join clips b on b.clip = a.clip - 1 where a.h = 184 and b.h = 368")
def _(t):
    c = t.clips.select("clip", "h")
    base = c.where("h = 368").select(F.col("clip").alias("base"), (F.col("clip") + 1).alias("clip"))
    return c.where("h = 184").select("clip").join(base, "clip").select("clip", "base")


@query("JN19_positional", """select a.c_custkey as a, b.s_suppkey as b from (select c_custkey, row_number() over (order by c_custkey) as r from customer) a
  join (select s_suppkey, row_number() over (order by s_suppkey) as r from supplier) b on a.r = b.r""")
def _(t):
    return rows.positional(t.customer.select(F.col("c_custkey").alias("a")), t.supplier.select(F.col("s_suppkey").alias("b")), "a", "b")


@query("JN20_missing_indices", """select conv_id, unnest(range(0, m + 1)) as turn from (select conv_id, max(turn) as m from conversations group by 1)
  except select conv_id, turn from conversations""")
def _(t):
    want = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("m")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("turn"))
    return want.join(t.conversations.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")


@query("JN21_queue_counts", "select count(*) as total, count(l.doc_id) as done, count(*) - count(l.doc_id) as queued from documents d left join (select distinct doc_id from labels) l on d.doc_id = l.doc_id")
def _(t):
    j = t.documents.select("doc_id").join(t.labels.select("doc_id", F.lit(1).alias("ok")).distinct(), "doc_id", "left")
    return j.agg(F.count(F.lit(1)).alias("total"), F.count("ok").alias("done")).withColumn("queued", F.col("total") - F.col("done"))


@query("SET1_ok_first", """select o_custkey as k, o_orderkey from (select *, row_number() over (partition by o_custkey order by (o_orderstatus = 'F') desc, o_orderkey) as r from orders) where r = 1""")
def _(t):
    o = t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderstatus")
    return rows.ok_first(o, "k", F.col("o_orderstatus") == "F", ["o_orderkey"]).select("k", "o_orderkey")


@query("SET2_last_wins", "select o_custkey as k, max(o_orderkey) as o_orderkey from orders group by 1")
def _(t):
    return rows.last_wins(t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey"), "k", "o_orderkey")


@query("SET3_unique_keys", "select o_orderkey from orders")
def _(t):
    return rows.assert_unique(t.orders.select("o_orderkey"), "o_orderkey")


@query("SET4_key_diff", """select coalesce(a.n, b.n) as k, case when a.n is null then 'only_b' when b.n is null then 'only_a' when a.v = b.v then 'equal' else 'differs' end as state
  from (select n_nationkey as n, n_regionkey as v from nation where n_nationkey < 15) a full join (select n_nationkey as n, (n_nationkey % 5)::int as v from nation where n_nationkey > 5) b on a.n = b.n""")
def _(t):
    a = t.nation.where("n_nationkey < 15").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("v"))
    b = t.nation.where("n_nationkey > 5").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 5).alias("v"))
    return rows.key_diff(a, b, "k", "v")


@query("SET5_union", "select c_custkey as k, c_name as name from customer union all select s_suppkey, s_name from supplier")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")).unionByName(t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))


@query("SET6_first_seen", "select event_type, min(event_id) as first_seen from events group by 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.min("event_id").alias("first_seen"))


@query("SET7_distinct", "select distinct lang, source from documents")
def _(t):
    return t.documents.select("lang", "source").distinct()


@query("SET8_train_test", """select doc_id, case when row_number() over (order by md5('3:' || doc_id), doc_id) <= 100 then 'test' else 'train' end as split from documents""")
def _(t):
    return rows.train_test(t.documents.select("doc_id"), "doc_id", 100, 3)


@query("SRC8_name_parse", f"with {CLIPS} select 'c' || clip || '_x' as uttid, frames, h, w from clips")
def _(t):
    from tessera.sources.files import parse_feature_name

    name = F.concat(F.lit("c"), F.col("clip").cast("string"), F.lit("_x_"), F.col("frames").cast("string"), F.lit("_"), F.col("h").cast("string"), F.lit("_"), F.col("w").cast("string"), F.lit(".pt"))
    return t.clips.select(parse_feature_name(name).alias("n")).select("n.*")


_RATIO = {"AIR": 2.0}


@query("RSH1_ratio_resample", """select event_type, event_id, rnd as round from (select *, row_number() over (partition by event_type, rnd order by md5('5:' || rnd || ':' || event_id)) as r from
  (select event_type, event_id, n, t, unnest(range(0, ceil(t::double / n)::bigint))::int as rnd from
    (select *, case event_type when 'click' then 3000 when 'view' then 1000 else n end as t from (select *, count(*) over (partition by event_type) as n from events))))
  where rnd * n + r <= t""")
def _(t):
    return ranking.resample_to_ratios(t.events.select("event_type", "event_id"), "event_type", "event_id", {"click": 3.0, "view": 1.0}, 4000, 5)


@query("RSH2_equal_sizes", """select event_type, event_id from (select *, row_number() over (partition by event_type order by md5('1:' || event_id), event_id) as r from events)
  where r <= (select min(n) from (select count(*) as n from events group by event_type))""")
def _(t):
    return ranking.equal_sizes(t.events.select("event_type", "event_id"), "event_type", "event_id", 1)


@query("RSH4_seeded_sample", "select doc_id from documents order by md5('9:' || doc_id), doc_id limit 50")
def _(t):
    return t.documents.orderBy(rows.seeded(9, "doc_id"), "doc_id").limit(50).select("doc_id")


@query("RSH5_replicas", "select s_suppkey as k, r as replica, 's' || s_suppkey || case when r = 0 then '' else '_rep' || r end as replica_name from (select s_suppkey, unnest(range(0, 1 + s_suppkey % 3))::int as r from supplier)")
def _(t):
    s = t.supplier.select(F.col("s_suppkey").alias("k"))
    return ranking.replicate(s, (F.col("k") % 3 + 1).cast("int"), F.concat(F.lit("s"), F.col("k").cast("string")))


@query("RSH6_per_group", "select source, doc_id from (select *, row_number() over (partition by source order by md5('4:' || doc_id), doc_id) as r from documents) where r <= 3")
def _(t):
    return ranking.sample_per_group(t.documents.select("source", "doc_id"), "source", "doc_id", 3, 4)


@query("RSH7_strided_shard", "select doc_id from (select doc_id, row_number() over (order by doc_id) - 1 as i from documents) where i % 8 = 3")
def _(t):
    return rows.numbered(t.documents.select("doc_id"), "doc_id", "i").where(ranking.shard_of(F.col("i") - 1, 8) == 3).select("doc_id")


@query("RSH8_modulo_shards", "select (doc_id % 6)::bigint as shard, count(*) as n from documents group by 1")
def _(t):
    return t.documents.groupBy(ranking.shard_of(F.col("doc_id"), 6).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("RSH10_wrapped_shards", """select (i % 7)::bigint as shard, doc_id from (select doc_id, row_number() over (order by doc_id) - 1 as i, count(*) over () as n from documents)
  union all select ((n + i) % 7)::bigint, doc_id from (select doc_id, row_number() over (order by doc_id) - 1 as i, count(*) over () as n from documents) where i < (7 - n % 7) % 7""")
def _(t):
    d = rows.numbered(t.documents.select("doc_id"), "doc_id", "i")
    n = d.count()
    pad = d.where(F.col("i") <= (7 - n % 7) % 7).withColumn("i", F.col("i") + n)
    return d.unionByName(pad).select(ranking.shard_of(F.col("i") - 1, 7).alias("shard"), "doc_id")


@query("RSH11_bucket_batches", """select event_type, batch, event_id from (select *, count(*) over (partition by event_type, batch) as n from
  (select event_type, event_id, (row_number() over (partition by event_type order by md5('2:' || event_id), event_id) - 1) // 32 as batch from events)) where n = 32""")
def _(t):
    return ranking.bucket_batches(t.events.select("event_type", "event_id"), "event_type", "event_id", 32, True, 2)


@query("RSH13_epoch_length", "select event_type, count(*) // 32 as full_batches, ceil(count(*) / 32.0)::bigint as all_batches from events group by 1")
def _(t):
    n = F.count(F.lit(1))
    return t.events.groupBy("event_type").agg(F.floor(n / 32).alias("full_batches"), F.ceil(n / 32).alias("all_batches"))


@query("RSH19_stem_shards", "select page_id, (page_id % 4)::bigint as shard from pages")
def _(t):
    return t.pages.select("page_id", ranking.shard_of(F.col("page_id"), 4).alias("shard"))


@query("SNK8_summary_table", "select c_mktsegment as segment, count(*) as n, round(avg(c_acctbal), 4) as mean from customer group by 1")
def _(t):
    return t.customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), r4(F.avg("c_acctbal")).alias("mean"))
