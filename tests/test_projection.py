"""Projections against plain loops: padding stays, the reference is frozen."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import memory, projection, rows

RNG = np.random.default_rng(3)


def window(zeros=0, scale=1.0, shift=0.0, frames=12, channels=3):
    w = RNG.standard_normal((frames, channels)) * scale + shift
    w[:zeros] = 0
    return w


def plain_renorm(windows, smooth):
    ref = prev = None
    out = []
    for w in windows:
        has = np.abs(w).max(1) > 0
        if not has.any():
            out.append((w, False))
            continue
        m, s = w[has].mean(0), w[has].std(0, ddof=1)
        if ref is None:
            ref = (m, s) if has.all() else None
            out.append((w, False))
            continue
        a = ref[1] / np.maximum(s, 1e-4)
        b = ref[0] - m * a
        if smooth and prev is not None:
            a, b = smooth * prev[0] + (1 - smooth) * a, smooth * prev[1] + (1 - smooth) * b
        prev = (a, b)
        out.append((np.where(has[:, None], w * a + b, w), True))
    return out


@pytest.mark.parametrize("smooth", [0.0, 0.6])
def test_renorm_waits_freezes_and_restores(spark, smooth):
    keys = {
        "drift": [window(10), window(), window(scale=1.4, shift=0.8), window(4, 2.0, -1.0), window(12), window(scale=3)],
        "never": [window(10), window(12), window(1)], "first": [window(), window(shift=5.0)],
    }
    data = [(k, i, w.tolist()) for k, ws in keys.items() for i, w in enumerate(ws)] + [("none", 0, []), ("none", 1, None)]
    df = spark.createDataFrame(data, "k string, i int, w array<array<double>>").repartition(3)
    got = {(r["k"], r["i"]): r for r in projection.renormed(df, "k", "i", "w", smooth).collect()}
    assert len(got) == len(data) and got["none", 0]["w"] == [] and got["none", 1]["w"] is None
    for k, ws in keys.items():
        for i, (w, applied) in enumerate(plain_renorm(ws, smooth)):
            assert got[k, i]["applied"] == applied and np.allclose(got[k, i]["w"], w)
    restored = np.array(got["drift", 2]["w"])
    assert np.allclose(restored.mean(0), keys["drift"][1].mean(0)) and np.allclose(restored.std(0), keys["drift"][1].std(0))
    assert np.abs(np.array(got["drift", 3]["w"])[:4]).max() == 0  # padding


def test_codebook_never_replaces_padding(spark):
    book = (RNG.standard_normal((5, 3)) + 3).tolist()
    w = window(10)
    df = spark.createDataFrame([(w.tolist(),)], "w array<array<double>>")
    take = lambda alpha: np.array(df.select(projection.blended(F.col("w"), lambda f: memory.nearest_value(f, book), alpha).alias("o")).first()["o"])
    out = take(1.0)
    assert np.abs(out[:10]).max() == 0 and all(row.tolist() in book for row in out[10:])
    assert np.allclose(take(0.25)[10:], w[10:] + 0.25 * (out[10:] - w[10:]))
    assert all(np.argmin(((np.array(book) - x) ** 2).sum(1)) == book.index(o.tolist()) for x, o in zip(w[10:], out[10:]))


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(i * 7 % 101, None if i % 5 == 0 else str(i % 3)) for i in range(101)], "k int, s string").repartition(5)
    got = sorted((r["r"], r["k"]) for r in rows.numbered(df, [F.asc_nulls_last("s"), "k"], "r", rows_each=9).collect())
    want = sorted(df.collect(), key=lambda r: (r["s"] is None, r["s"] or "", r["k"]))
    assert got == [(i, r["k"]) for i, r in enumerate(want, 1)]
    assert rows.numbered(df.limit(0), "k", "r").count() == 0
