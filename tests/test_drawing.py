"""Cases of seeded draws, captions and guards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import drawing


def test_aligned_roles(spark):
    rows = [("a", i) for i in range(40)] + [("b", 100 + i) for i in range(3)] + [("c", 200), (None, 1), ("a", None)]
    got = [tuple(r) for r in drawing.aligned(spark.createDataFrame(rows, "role string, k int"), "role", "k").collect()]
    for role, own in (("a", set(range(40))), ("b", {100, 101, 102}), ("c", {200})):
        mine = [r for r in got if r[0] == role]
        assert sorted(r[2] for r in mine) == list(range(40)) and {r[1] for r in mine} == own  # nothing of another role, no row lost
    assert len(got) == 120
    empty = spark.createDataFrame([], "role string, k int")
    assert drawing.aligned(empty, "role", "k").count() == 0


def test_interleaved_keeps_the_order_of_a_bucket(spark):
    rows = [(b, i) for b, n in (("a", 300), ("b", 300), ("c", 1)) for i in range(n)]
    got = drawing.interleaved(spark.createDataFrame(rows, "bucket string, batch int"), "bucket", "batch", 5).collect()
    got = sorted(got, key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(1, 602))
    assert [r["batch"] for r in got if r["bucket"] == "a"] == list(range(300))
    early = sum(r["bucket"] == "a" for r in got[:300])
    assert 110 < early < 190  # neither bucket goes first
    assert drawing.interleaved(spark.createDataFrame([], "bucket string, batch int"), "bucket", "batch").count() == 0


@pytest.mark.parametrize("a, b", [(1.5, 4.0), (4.0, 1.5), (1.0, 1.0)])
def test_beta_quantiles(spark, a, b):
    got = np.array([r[0] for r in spark.range(4001).select(drawing.beta_quantile(F.col("id") / 4000, a, b)).collect()])
    assert (np.diff(got) >= 0).all() and got[0] == 0 and abs(got[-1] - 1) < 1e-4
    assert abs(got.mean() - a / (a + b)) < 2e-3 and abs(got.var() - a * b / ((a + b) ** 2 * (a + b + 1))) < 1e-3
    drawn = np.sort(np.random.default_rng(1).beta(a, b, 400_000))
    assert abs(got[100:-100:100] - np.quantile(drawn, np.linspace(0, 1, 4001)[100:-100:100])).max() < 5e-3


def test_annealed():
    assert drawing.annealed(4.0, 0, 1000) == 4 and drawing.annealed(4.0, 5000, 1000) == 1 and drawing.annealed(4.0, 9, 0) == 4
    assert abs(drawing.annealed(4.0, 500, 1000) - 2.5) < 1e-12


def test_counts_and_steps(spark):
    t = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "t double")
    assert [r[0] for r in t.select(drawing.drawn_count(F.col("t"), 1, 4)).collect()][:3] == [1, 2, 4]  # 2.5 goes to the even one
    assert [r[0] for r in t.select(drawing.drawn_step(F.col("t"), 0, 1000, 1000, 3, 20, 980)).collect()][:3] == [20, 750, 980]
    assert [r[0] for r in t.select(drawing.drawn_step(F.col("t"), 0, 1000, 1000, 1, 20, 980)).collect()][:3] == [20, 500, 980]


def test_hold_out(spark):
    df = spark.createDataFrame([(f, i) for f in "xy" for i in range(50)], "file string, k int")
    got = drawing.hold_out(df, "file", "k", 30).collect()
    assert len(got) == 60 and sum(r["held_out"] for r in got) == 6 and len({tuple(r)[:2] for r in got}) == 60
    with pytest.raises(Exception, match="too few rows in y"):
        drawing.hold_out(df.where("file = 'x' or k < 29"), "file", "k", 30).collect()


def test_guards(spark):
    df = spark.createDataFrame([("a", [1.0, -1.0], [1.0, -1.0]), ("a", [0.0, 0.0], [0.0, 0.0]), ("b", [2.0, 0.0], [1.5, 0.25])], "g string, x array<double>, y array<double>")
    assert drawing.spread_guard(df.where("g = 'a'").limit(1), "x", 0.6, 1.3).first()[:] == (2, 1.0)
    with pytest.raises(Exception, match="deviation out of range"):
        drawing.spread_guard(df.where("g = 'a'"), "x", 0.8, 1.3).collect()
    effects = drawing.effect(df, "g", "x", "y")
    assert sorted(map(tuple, effects.collect())) == [("a", 2, 1, 0, 0.0), ("b", 1, 0, 2, 0.5)]
    assert drawing.require_effect(effects.where("g = 'b'")).count() == 1
    with pytest.raises(Exception, match="nothing was changed"):
        drawing.require_effect(effects).collect()


def test_jitter_is_shared_by_a_window(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 2.0]), (2, [1.0, 2.0])], "w int, v array<double>")
    a, b, c = (r[0] for r in df.select(drawing.jittered(F.col("v"), F.col("w"), 2, 0.1)).collect())
    assert a[1] == b[1] and a != c and a[0] != b[0]
    z = np.array([r[0] for r in spark.range(20000).select(drawing.normal(1, F.col("id"))).collect()])
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03


def test_texts_of_nested_values(spark):
    kind = "a array<array<string>>, s struct<x:string,y:array<int>>, t string, n string"
    df = spark.createDataFrame([([["p ", None], None, []], (None, [3, 4]), "\t u v\n", None)], kind).withColumn("m", F.create_map(F.lit("k"), F.lit(1), F.lit("l"), F.lit(2)))
    got = df.select(*[drawing.as_text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).first()
    assert got.asDict() == {"a": "p", "m": "1 2", "s": "3 4", "t": "u v", "n": "None"}
