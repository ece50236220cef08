"""Queries of vector checks, grids, borders of chunks and ratings by distance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import ranking, series, vectors
from tessera.plans.registry import CLIPS, SERIES, query, r4

GRID = [999.0, 874.5, 750.0, 625.5, 500.0, 375.5, 250.0, 125.5, 0.0]
#: Two fixed centroids of any length: all of one value.
LOW, HIGH = -0.05, 0.05


@query("WIN14_boundary_stats", f"""with {SERIES},
  d as (select user_id, i - 1 as j, abs(value - lag(value) over (partition by user_id order by i)) as d from series),
  p as (select user_id, j % 7 as phase, avg(d) as m, count(*) as n from d where j >= 0 group by 1, 2),
  b as (select *, max(case when phase = 6 then m end) over (partition by user_id) as border, max(m) over (partition by user_id) as top from p)
  select user_id, round(max(border) / ((sum(m) - max(border)) / 6), 4) as boundary_ratio, count(*) filter (m >= border)::bigint as phase_rank,
    min(phase) filter (m = top)::bigint as top_phase, round(max(top) / ((sum(m) - max(top)) / 6), 4) as top_ratio from b group by 1 having sum(n) >= 21""")
def _(t):
    got = series.boundary_stats(t.series, "user_id", "i", "value", 7)
    return got.select("user_id", r4("boundary_ratio").alias("boundary_ratio"), "phase_rank", F.col("top_phase").cast("long").alias("top_phase"), r4("top_ratio").alias("top_ratio"))


@query("WIN23_smoothness_share", f"with {CLIPS} select clip, least(greatest(4, floor(frames * 0.15)), frames)::bigint as n from clips")
def _(t):
    return t.clips.select("clip", series.edge_share(F.col("frames"), 0.15, 4).alias("n"))


@query("RNK4_target_ratings", "select l_orderkey as k, l_linenumber as n, case when abs(l_discount - 0.05) <= 0.005 then 10 when abs(l_discount - 0.05) <= 0.015 then 9 when abs(l_discount - 0.05) <= 0.035 then 8 else 1 end as rating from lineitem")
def _(t):
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), ranking.threshold_rating(F.col("l_discount").cast("double"), [0.005, 0.015, 0.035], target=0.05).alias("rating"))


@query("SC25_grid_index", "with o as (select o_orderkey as k, (o_orderkey % 1300 - 100)::double as t from orders), g as (select k, list_transform([999.0, 874.5, 750.0, 625.5, 500.0, 375.5, 250.0, 125.5, 0.0], lambda x: abs(x - least(greatest(t, 0), 999))) as d from o) select k, (list_position(d, list_min(d)) - 1)::bigint as at from g")
def _(t):
    x = (F.col("o_orderkey") % 1300 - 100).cast("double")
    return t.orders.select(F.col("o_orderkey").alias("k"), vectors.grid_index(x, GRID).cast("long").alias("at"))


@query("SC20_boost", "with l as (select l_orderkey as k, l_linenumber as n, l_discount::double as a, l_tax::double as b, 0.1::double as noisy from lineitem) select k, n, round(2 * a / (2 * a + 2 * b + noisy), 6) as recent, round(noisy / (2 * a + 2 * b + noisy), 6) as noisy from l")
def _(t):
    mass = F.create_map(F.lit("recent"), F.col("l_discount").cast("double"), F.lit("far"), F.col("l_tax").cast("double"), F.lit("noisy"), F.lit(0.1))
    got = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), scalars.boosted(mass, ["recent", "far"], 2.0).alias("m"))
    return got.select("k", "n", r4(F.col("m")["recent"], 6).alias("recent"), r4(F.col("m")["noisy"], 6).alias("noisy"))


@query("SC21_per_token", "select l_orderkey as k, l_linenumber as n, round(case when l_quantity > 20 then l_tax::double / l_quantity::double else 0 end, 8) as per_token, round(1 - l_tax::double, 6) as history_share from lineitem")
def _(t):
    mass, tokens = F.create_map(F.lit("noisy"), F.col("l_tax").cast("double")), F.create_map(F.lit("noisy"), F.when(F.col("l_quantity") > 20, F.col("l_quantity").cast("double")).otherwise(0.0))
    per = scalars.per_token(mass, tokens)["noisy"]
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), r4(per, 8).alias("per_token"), r4(1 - mass["noisy"], 6).alias("history_share"))


_WIDE = "with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings)"


@query("VEC3_held_out", _WIDE + """, d as (select vec_id, sqrt(list_sum(list_transform(e, lambda x: (x + 0.05) * (x + 0.05)))) as a, sqrt(list_sum(list_transform(e, lambda x: (x - 0.05) * (x - 0.05)))) as b from v where vec_id % 10 = 0),
  x as (select generate_subscripts(e, 1) as i, unnest(e) as x from v where vec_id % 10 = 0), s as (select sum(q) as total from (select var_pop(x) * count(*) as q from x group by i))
  select round(avg(least(a, b)), 5) as mean_l2, round(1 - sum(least(a, b) * least(a, b)) / any_value(total), 5) as variance_retained, count(distinct case when a <= b then 0 else 1 end)::bigint as used from d, s""")
def _(t):
    held = t.embeddings.where("vec_id % 10 = 0").select(F.col("embedding").cast("array<double>").alias("v"))  # the held-out tenth is the operator's input
    got = vectors.held_out_metrics(held, "v", [LOW, HIGH])
    return got.select(r4("mean_l2", 5).alias("mean_l2"), r4("variance_retained", 5).alias("variance_retained"), F.col("used").cast("long").alias("used"))


@query("VEC13_cosine_check", _WIDE + " select label, min(list_cosine_similarity(e, list_transform(e, lambda x: round_even(x * 32, 0) / 32))) >= 0.995 as ok from v group by 1")
def _(t):
    e = F.col("embedding").cast("array<double>")
    return t.embeddings.groupBy("label").agg(vectors.agrees(e, vectors.quantize(e, 1 / 32)).alias("ok"))


@query("VEC16_saturation", _WIDE + ", m as (select vec_id, e, list_sum(e) / len(e) as m from v) select vec_id, round((e[1] - m) * 1.5 + m, 5) as first, round((e[len(e)] - m) * 1.5 + m, 5) as last from m")
def _(t):
    v = vectors.saturated(F.col("embedding").cast("array<double>"), 1.5)
    return t.embeddings.select("vec_id", r4(F.element_at(v, 1), 5).alias("first"), r4(F.element_at(v, -1), 5).alias("last"))


@query("VEC19_gated_update", _WIDE + " select vec_id, round(0.9 * e[1] + 0.1 * e[len(e)], 6) as first from v")
def _(t):
    e = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", r4(F.element_at(vectors.gated_update(e, F.reverse(e), 0.9), 1), 6).alias("first"))
