"""Golden tests of operators that SQL does not cover."""

import numpy as np

from pyspark.sql import functions as F

from tessera.operators import series, vectors
from tessera.plans import catalogue
from tessera.sources import files

SF = "/root/testdata/sf0.001"


def test_spectrum_matches_numpy(spark):
    rng = np.random.default_rng(1)
    clips = {k: rng.standard_normal(n).cumsum() + np.where(np.arange(n) % 7 == 0, 3, 0) for k, n in (("a", 120), ("b", 22), ("c", 20))}
    df = spark.createDataFrame([(k, i, float(x)) for k, v in clips.items() for i, x in enumerate(v)], "k string, i long, v double").repartition(3)
    got = {r["k"]: r["ratio"] for r in series.spectrum_ratio(df, "k", "i", "v", 7).collect()}
    for k, v in clips.items():
        step = [abs(b - a) for a, b in zip(v, v[1:])]
        n = len(step)
        if n < 21:
            assert got[k] is None
            continue
        height = {f: abs(sum((x - np.mean(step)) * np.exp(-2j * np.pi * f * t / n) for t, x in enumerate(step))) for f in range(n // 2 + 1)}
        at = min(height, key=lambda f: abs(f / n - 1 / 7))
        assert np.isclose(got[k], height[at] / np.median([h for f, h in height.items() if 0.01 < f / n < 0.2]))


def test_kmeans_matches_plain_lloyd(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.standard_normal((40, 3)) * 0.2 + c for c in np.eye(3) * 4])
    df = spark.createDataFrame([([float(x) for x in p],) for p in points], "v array<double>")
    got = vectors.kmeans(df, "v", 3, 20)
    start = [r["v"] for r in df.orderBy(F.xxhash64("v", F.lit(0)), "v").limit(3).collect()]
    centers, before = np.array(start), None
    for _ in range(20):
        gap = np.sqrt(((points[:, None] - centers) ** 2).sum(2))
        near = gap.argmin(1)
        fresh = np.array([points[near == j].mean(0) if (near == j).any() else centers[j] for j in range(3)])
        stop = before is not None and (near != before).mean() < 1e-4
        centers, before = fresh, near
        if stop:
            break
    assert np.allclose(got, centers)
    assert vectors.kmeans(df.limit(0), "v", 3) == []


def test_kmeans_query_assigns_the_nearest(spark):
    rows = catalogue.queries()["VEC1_kmeans"](spark, SF).collect()
    vecs = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    centers = np.array(vectors.kmeans(spark.read.parquet(f"{SF}/embeddings.parquet"), "embedding", 4, 5))
    assert len(rows) == len(vecs)
    for r in rows:
        gap = np.sqrt(((centers - vecs[r["vec_id"]]) ** 2).sum(1))
        assert gap[r["centroid"]] <= gap.min() + 1e-9


def test_moment_drift_needs_both(spark):
    both = "array<struct<mean:array<double>,var:array<double>>>"
    df = spark.createDataFrame([(1, [([0.0, 0.0], [1.0]), ([3.0, 4.0], [1.0]), ([3.0, 4.0], [9.0])]), (2, [([1.0], [1.0])]), (3, [])], f"k int, m {both}")
    got = {r["k"]: r["s"] for r in df.select("k", series.moment_drift(F.col("m")).alias("s")).collect()}
    assert got[1]["drifts"] == 1 and np.allclose(got[1]["mean"], [0.57, 0.76]) and np.allclose(got[1]["var"], [1.8])
    assert got[2]["drifts"] == 0 and got[2]["mean"] == [1.0] and (got[3] is None or got[3]["mean"] is None)


def test_reports_keep_all_rows(spark, tmp_path):
    df = spark.range(1500).select(F.col("id").cast("string").alias("t"), F.lit("x").alias("b"))
    assert files.markdown_table(df, ["t"]).count("\n") == 1502 and "1490 more rows" in files.markdown_table(df, ["t"], 10)
    assert files.html_cards(df, "t", "b").count("<article>") == 1500 and "<p>1499 more</p>" in files.html_cards(df, "t", "b", 1)
    files.write_results(df.limit(3), str(tmp_path))
    import json

    assert [r["t"] for r in json.loads("".join(r["value"] + "\n" for r in spark.read.text(f"{tmp_path}/results.json").collect()))] == ["0", "1", "2"]
