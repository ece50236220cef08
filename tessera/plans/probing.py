"""Queries over attention maps, portions of clips and configurations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import probes
from tessera.plans.registry import CLIPS, query, r4

_SHARES = """shares as (select vec_id, label, list_transform(e, lambda x: x / list_sum(e)) as p from
  (select vec_id, label, list_transform(v, lambda x: exp(x - list_max(v))) as e from (select vec_id, label, embedding::double[] as v from embeddings)))"""


def _shares(t):
    return t.embeddings.select("vec_id", "label", probes.softmax(F.col("embedding").cast("array<double>")).alias("p"))


@query("VEC14_attention_mass", f"""with {_SHARES} select label, round(avg(list_sum(p[1:16])), 5) as first, round(avg(list_sum(p[17:48])), 5) as middle,
  round(avg(list_sum(p[49:64])), 5) as last, 0.0::double as none from shares group by 1""")
def _(t):
    m = probes.segment_mass(_shares(t), "label", "p", {"first": (0, 16), "middle": (16, 48), "last": (48, 64), "none": (64, 64)})
    return m.select("label", *(r4(c, 5).alias(c) for c in ("first", "middle", "last", "none")))


@query("VEC15_pooled_map", f"""with {_SHARES}, q as (select *, row_number() over (partition by label order by vec_id) - 1 as r, count(*) over (partition by label) as n from shares),
  b as (select *, unnest(range(0, 5)) as row_bin from q), k as (select *, unnest(range(0, 7)) as key_bin from b
    where r >= round_even(row_bin * n / 5.0, 0) and r < greatest(round_even((row_bin + 1) * n / 5.0, 0), round_even(row_bin * n / 5.0, 0) + 1))
  select label, row_bin, key_bin, round(avg(list_sum(p[round_even(key_bin * 64 / 7.0, 0)::int + 1:round_even((key_bin + 1) * 64 / 7.0, 0)::int])), 5) as mass from k group by 1, 2, 3""")
def _(t):
    w = Window.partitionBy("label")
    rows = _shares(t).withColumn("r", F.row_number().over(w.orderBy("vec_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return probes.pooled_map(rows, "label", "r", "n", "p", 5, 7).select("label", F.col("row_bin").cast("long"), F.col("key_bin").cast("long"), r4("mass", 5).alias("mass"))


@query("WIN24_portion_frames", f"""with {CLIPS}, a as (select clip, frames as n, floor(frames * 0.4)::bigint as s, floor(frames * 0.5)::bigint as e from clips),
  b as (select *, 16 - (e - s) as need, greatest(0, s - ceil((16 - (e - s)) / 2.0)::bigint) as low, least(n, e + floor((16 - (e - s)) / 2.0)::bigint) as high from a),
  c as (select *, case when high - low < 16 and low = 0 then least(n, low + 16) else high end as top, case when high - low < 16 and low > 0 and high = n then greatest(0, high - 16) else low end as bottom from b)
  select clip, array_to_string(list_transform(range(0, 16), lambda i: least(n - 1, case when need <= 0 then floor(s + i * ((e - s) / 16.0::double))::bigint
    when i = 15 then top - 1 else floor(i * ((top - 1 - bottom) / 15.0::double) + bottom)::bigint end))::varchar[], ',') as f from c""")
def _(t):
    return t.clips.select("clip", F.array_join(probes.portion_frames(F.col("frames"), 0.4, 0.5, 16).cast("array<string>"), ",").alias("f"))


@query("RNK14_config_diff", """with leaf as (select n_nationkey as k, n_regionkey as r, 'r' || n_regionkey || '.' || n_name as path from nation),
  a as (select path, 'r' || r as parent, false as m, k as v from leaf where k < 20 union all select distinct 'r' || r, '', true, null from leaf),
  b as (select path, 'r' || r as parent, false as m, case when k % 7 = 0 then k + 1 else k end as v from leaf where k >= 5 and r in (1, 2, 3) union all
    select distinct 'r' || r, '', r <> 4, case when r = 4 then 1 end from leaf where r > 0),
  f as (select path, coalesce(a.parent, b.parent) as parent, a.m as ma, b.m as mb, a.v as va, b.v as vb from a full join b using (path))
  select path, case when mb is null then 'only_first' when ma is null then 'only_second' else 'different' end as status from f
  where (parent = '' or parent in (select path from f where ma and mb)) and (mb is null or ma is null or (not (ma and mb) and (ma <> mb or va is distinct from vb)))""")
def _(t):
    region = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    leaf = t.nation.select(k.alias("k"), r.alias("r"), F.concat(region, F.lit("."), F.col("n_name")).alias("path"), region.alias("parent"), F.lit(False).alias("is_map"))
    top = t.nation.select(r.alias("r"), region.alias("path"), F.lit("").alias("parent")).distinct()
    value = F.col("k").cast("string")
    nodes = ["path", "parent", "is_map", "value"]
    first = leaf.where("k < 20").withColumn("value", value).select(nodes).union(top.select("path", "parent", F.lit(True), F.lit(None).cast("string")))
    second = leaf.where("k >= 5 and r in (1, 2, 3)").withColumn("value", F.when(F.col("k") % 7 == 0, (F.col("k") + 1).cast("string")).otherwise(value)).select(nodes)
    second = second.union(top.where("r > 0").select("path", "parent", F.col("r") != 4, F.when(F.col("r") == 4, "1")))
    return probes.config_diff(first, second)
