"""Range joins against plain loops."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import intervals
from tessera.plans import catalogue


def drawn(seed):
    rng = random.Random(seed)
    span = lambda most: (lambda a: (a, a + rng.choice((0, 1, 7, most))))(rng.randrange(-500, 2000))
    left = [("hot" if i % 3 else f"k{i % 7}", i, *span(33)) for i in range(150)] + [("hot", 1000, -(10**7), 10**7), (None, 1001, 0, 50), ("k1", 1002, None, 5), ("k1", 1003, 9, 2)]
    right = [("hot" if i % 2 else f"k{i % 7}", i, *span(900)) for i in range(400)] + [("hot", 1000, -(10**6), 3), ("hot", 1001, 1990, 10**12), (None, 1002, 0, 50)]
    return left, right


@pytest.mark.parametrize(("seed", "width"), [(1, 1), (2, 33), (3, 5000)])
def test_overlaps_match_a_loop(spark, seed, width):
    left, right = drawn(seed)
    a = spark.createDataFrame(left, "k string, i long, lo long, hi long")
    b = spark.createDataFrame(right, "k string, j long, lo long, hi long")
    joined = intervals.overlapping(a, b, ["k"], ("lo", "hi"), ("lo", "hi"), width)
    plan = joined._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = sorted(tuple(r) for r in joined.select("k", "l.i", "r.j", "overlap").collect())
    want = sorted(
        (k, i, j, min(h, t) - max(lo, s)) for k, i, lo, h in left for q, j, s, t in right
        if k is not None and k == q and None not in (lo, h) and lo < h and s < t and max(lo, s) < min(h, t)
    )
    assert got == want


def test_owners_of_a_clip_with_very_many_events(spark):
    rng = random.Random(4)
    cuts = [0, *sorted(rng.sample(range(1, 60_000), 5_000)), 60_000]
    events = [("many", e, s, t) for e, (s, t) in enumerate(zip(cuts, cuts[1:]))] + [("tie", 0, 0, 16), ("tie", 1, 17, 33), ("tie", 2, 33, 66), ("off", 0, 500, 600), ("off", 1, 600, 601)]
    chunks = [("many", c) for c in range(60_000 // 33)] + [("tie", 0), ("tie", 1), ("off", 0), ("none", 0), (None, 3)]
    a = spark.createDataFrame(chunks, "clip string, chunk long").withColumns({"lo": F.col("chunk") * 33, "hi": F.col("chunk") * 33 + 33})
    b = spark.createDataFrame(events, "clip string, event int, start long, stop long")
    got = {(r["clip"], r["chunk"]): r["event"] for r in intervals.owners(a, b, ["clip"], "chunk", ("lo", "hi"), "event", ("start", "stop"), 33).collect()}
    want = {}
    for clip, c in chunks:
        best, most = 0, -1
        for q, e, s, t in events:
            if q == clip and (over := max(0, min(33 * c + 33, t) - max(33 * c, s))) > most:
                best, most = e, over
        want[clip, c] = best
    assert got == want
    assert intervals.owners(a.limit(0), b, ["clip"], "chunk", ("lo", "hi"), "event", ("start", "stop"), 33).count() == 0


@pytest.mark.parametrize(("n", "switches", "frames", "want"), [(2, [39], 66, [0, 1]), (2, [33], 66, [0, 1]), (4, [27, 60], 132, [0, 1, 2, 2]), (2, [1], 66, [1, 1]), (3, [], 99, [0, 0, 0])])
def test_owners_of_known_clips(spark, n, switches, frames, want):
    cuts = [0, *switches, frames]
    b = spark.createDataFrame([(1, e, s, t) for e, (s, t) in enumerate(zip(cuts, cuts[1:]))], "clip int, event int, start long, stop long")
    a = spark.createDataFrame([(1, c, 33 * c, 33 * c + 33) for c in range(n)], "clip int, chunk long, lo long, hi long")
    assert [r["event"] for r in intervals.owners(a, b, ["clip"], "chunk", ("lo", "hi"), "event", ("start", "stop"), 33).orderBy("chunk").collect()] == want


@pytest.fixture(scope="module")
def many_parts(spark, tmp_path_factory):
    """A file of few bytes whose clips have some 150,000 chunks, and more events in bins."""
    d = str(tmp_path_factory.mktemp("parts"))
    k = F.col("id")
    part = spark.range(20_000).select(k.alias("p_partkey"), F.lit("n").alias("p_name"), F.lit("Brand#1").alias("p_brand"), (k % 50 + 1).cast("int").alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    part.coalesce(1).write.parquet(f"{d}/part.parquet")
    return d


@pytest.mark.parametrize("name", ["JN13_interval_owner", "WIN17_switches", "WIN18_switch_plan"])
def test_sides_that_grow_in_their_bins_are_not_broadcast(spark, many_parts, name):
    """Spark's estimate of either side is far below the threshold, its rows are far above what may be broadcast here."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1m")
    try:
        got = catalogue.queries()[name](spark, many_parts).toPandas()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{many_parts}/part.parquet/*.parquet'")
    want = con.execute(catalogue.oracle_sql()[name]).df()
    plain = lambda df: sorted(df[sorted(want.columns)].itertuples(index=False, name=None))
    assert len(got) and plain(got) == plain(want)
