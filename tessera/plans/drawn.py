"""Queries of seeded draws, captions and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import drawing, vectors
from tessera.plans.registry import CLIPS, query, r4


def _draw(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::bigint"


def _unit(text: str) -> str:
    return f"({_draw(text)} / 4294967296.0::double)"


_DEALT = "d as (select event_type, event_id, row_number() over (partition by event_type order by md5(event_id::varchar)) - 1 as i, count(*) over (partition by event_type) as n from events)"


@query("RSH3_aligned_counts", f"""with {_DEALT}, x as (select event_type, n, unnest(range(i + n, (select max(n) from d), n)) as slot from d)
  select event_type, event_id, i as slot from d union all
  select x.event_type, d.event_id, x.slot from x join d on d.event_type = x.event_type and d.i = {_draw("'3:' || x.event_type || ':' || x.slot")} % x.n""")
def _(t):
    return drawing.aligned(t.events, "event_type", "event_id", 3)


@query("RSH12_random_interleave", f"""with {_DEALT}, b as (select distinct event_type as bucket, i // 16 as batch from d),
  a as (select *, sum(-ln(1 - {_unit("'12:' || bucket || ':' || batch")})) over (partition by bucket order by batch) as arrival from b)
  select bucket, batch, row_number() over (order by arrival) as position from a""")
def _(t):
    batches = drawing.dealt(t.events.select("event_type", "event_id"), "event_type", "event_id", "i", "n")
    batches = batches.select(F.col("event_type").alias("bucket"), F.floor(F.col("i") / 16).alias("batch")).distinct()
    return drawing.interleaved(batches, "bucket", "batch", 12)


@query("RSH15_dynamic_count", f"select o_orderkey, greatest(2, least(9, round_even(2 + {_unit("'15:' || o_orderkey")} * 7, 0)))::bigint as n from orders")
def _(t):
    return t.orders.select("o_orderkey", drawing.drawn_count(drawing.unit(15, F.col("o_orderkey")), 2, 9).alias("n"))


@query("RSH15_dynamic_count_beta")
def _(t):
    a, b = (drawing.annealed(v, 250, 1000) for v in (1.5, 4.0))
    return t.orders.select("o_orderkey", drawing.drawn_count(drawing.beta_quantile(drawing.unit(15, F.col("o_orderkey")), a, b), 2, 9).alias("n"))


@query("RSH16_dynamic_timestep", f"""select o_orderkey, round_even(greatest(20, least(980, 3 * (s / 1000) / (1 + 2 * (s / 1000)) * 1000)), 0)::bigint as step from
  (select o_orderkey, ({_unit("'16:' || o_orderkey")} * 0.999::double + 0.001::double) * 1000 as s from orders)""")
def _(t):
    u = drawing.unit(16, F.col("o_orderkey")) * 0.999 + 0.001
    return t.orders.select("o_orderkey", drawing.drawn_step(u, 0, 1000, 1000, 3, 20, 980).alias("step"))


@query("VEC4_hold_out", f"""select s_suppkey, s_nationkey % 3 as file, r <= 1 as held_out from
  (select *, row_number() over (partition by s_nationkey % 3 order by {_draw("'4:' || s_suppkey")}, s_suppkey) as r from supplier) where r <= 2""")
def _(t):
    s = t.supplier.select("s_suppkey", (F.col("s_nationkey") % 3).alias("file"))
    return drawing.hold_out(s, "file", "s_suppkey", 2, seed=4)


@query("VEC5_spread_guard", "select count(*) as n, round(stddev_pop(x), 4) as std from (select unnest(embedding)::double * 8 as x from embeddings)")
def _(t):
    v = t.embeddings.select(F.transform("embedding", lambda x: x.cast("double") * 8).alias("v"))
    return drawing.spread_guard(v, "v", 0.6, 1.3).select("n", r4("std").alias("std"))


def _normal(key: str) -> str:
    return f"(sqrt(-2 * ln(1 - {_unit(f"'9:r:' || {key}")})) * cos(2 * pi() * {_unit(f"'9:a:' || {key}")}))"


@query("VEC9_jitter", f"""with c as (select label, i, exp({_normal("label || ':s' || i")} * 0.05) as a, {_normal("label || ':t' || i")} * 0.05 as b from (select distinct label from embeddings), range(0, 64) r(i)),
  e as (select vec_id, label, unnest(embedding)::double as x, unnest(range(0, 64)) as i from embeddings)
  select vec_id, round(sum(x * a + b), 4) as total from e join c using (label, i) group by 1""")
def _(t):
    v = F.col("embedding").cast("array<double>")
    return t.embeddings.where("label is not null").select("vec_id", r4(vectors.total(drawing.jittered(v, F.col("label"), 64, 0.05, 9))).alias("total"))


_EFFECT = """select label, count(distinct vec_id) as n_rows, 0::bigint as n_padding, count(*) filter (abs(round_even(x / 0.05, 0) * 0.05 - x) > 0) as n_changed,
  round(max(abs(round_even(x / 0.05, 0) * 0.05 - x)), 5) as max_delta from (select vec_id, label, unnest(embedding)::double as x from embeddings) group by 1"""


def _effect(t):
    before = F.col("embedding").cast("array<double>")
    after = F.transform(before, lambda x: F.bround(x / 0.05) * F.lit(0.05))
    return drawing.effect(t.embeddings.select("label", before.alias("before"), after.alias("after")), "label", "before", "after")


@query("VEC10_effect", _EFFECT.replace("0.05", "0.05::double"))
def _(t):
    return _effect(t).withColumn("max_delta", r4("max_delta", 5))


@query("VEC20_zero_effect_guard", _EFFECT.replace("0.05", "0.05::double"))
def _(t):
    return drawing.require_effect(_effect(t)).withColumn("max_delta", r4("max_delta", 5))


_CHUNK_SQL = f"""with {CLIPS} select clip, i as chunk, '<header>' || brand || '</header>' || chr(10) || '<event>' || trim(brand || ' ' || name) || ' ' || i || '</event>' || chr(10) || '<role>None</role>' || chr(10)
  || '<Background>' || h || ' ' || w || '</Background>' || chr(10) || '<style>' || coalesce(case when h = 368 then 'wide' end, '') || '</style>' || chr(10) || '<scene>' || name || '</scene>' as caption
  from clips, range(0, 2) r(i)"""


@query("SC4_caption", _CHUNK_SQL)
def _(t):
    nested = t.clips.select(
        "clip", F.explode(F.sequence(F.lit(0), F.lit(1)).cast("array<bigint>")).alias("chunk"), F.concat(F.lit(" "), "brand", F.lit("\n")).alias("header"), F.lit(None).cast("string").alias("role"),
        F.create_map(F.lit("h"), F.col("h"), F.lit("w"), F.col("w")).alias("background"), F.array(F.when(F.col("h") == 368, "wide")).alias("style"),
        F.struct("name").alias("scene"), "brand", "name",
    )
    nested = nested.withColumn("event", F.array(F.array("brand", F.lit(None).cast("string"), "name"), F.array(F.col("chunk").cast("string"))))
    texts = {name: drawing.as_text(F.col(name), nested.schema[name].dataType) for _, name in drawing.CAPTION}
    return nested.select("clip", "chunk", drawing.caption(texts).alias("caption"))


@query("SC7_lint", """select doc_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), lambda w: w in ('und', 'and', 'et', 'y'))) > 3 as connectives, not contains(text, '<id>') as no_tag from documents where text is not null""")
def _(t):
    flags = scalars.lint_flags(F.col("text"), ["und", "and", "et", "y"], 3, "id")
    return t.documents.where("text is not null").select("doc_id", F.array_contains(flags, "connectives").alias("connectives"), F.array_contains(flags, "no_tag").alias("no_tag"))


@query("SC15_smart_size", f"""with {CLIPS}, a as (select clip, h + 3 as h, w * 2 as w, (h + 3) * (w * 2) as n, greatest(28, round_even((h + 3) / 28, 0) * 28) as hb, greatest(28, round_even(w * 2 / 28, 0) * 28) as wb from clips)
  select clip, (case when hb * wb > 400000 then greatest(28, floor(h / sqrt(n / 400000.0::double) / 28) * 28) when hb * wb < 200000 then ceil(h * sqrt(200000.0::double / n) / 28) * 28 else hb end)::bigint as h,
  (case when hb * wb > 400000 then greatest(28, floor(w / sqrt(n / 400000.0::double) / 28) * 28) when hb * wb < 200000 then ceil(w * sqrt(200000.0::double / n) / 28) * 28 else wb end)::bigint as w from a""")
def _(t):
    return t.clips.select("clip", scalars.smart_size(F.col("h") + 3, F.col("w") * 2, 28, 200000, 400000).alias("s")).select("clip", "s.h", "s.w")
