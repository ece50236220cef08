"""Top-k by M-trees against a plain sort."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import topk


def plain(rows, k):
    """[(query_id, rank, vec_id, score)] of rows (id, vector)."""
    seen = {(i, tuple(int(np.floor(64 * float(x))) for x in v)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, v in seen:
        if i is not None and i % 20 == 0:
            found = sorted(((-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for j, w in seen if j != i and len(w) == len(v)))
            out += [(i, r, None if null else j, -s) for r, (s, null, j) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def drawn(seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 6))
    rows = [(i, (centres[i % 5] * (1 + i % 3) + 0.1 * rng.normal(size=6)).tolist()) for i in range(160)]
    hot = rng.normal(size=6).tolist()
    rows += [(200 + i, hot) for i in range(90)]  # one vector of a third of all rows
    rows += [(None, hot), (None, rows[3][1]), (20, rows[20][1]), (40, rows[7][1]), (60, rows[60][1]), (60, rows[60][1])]
    rows += [(400, None), (420, [float("nan")] * 6), (440, [None, 1.0]), (460, [float("inf")] * 6), (480, []), (481, []), (500, [1.0, 2.0]), (501, [2.0, 2.0]), (520, [0.0] * 6), (540, [3.0] * 9)]
    return rows


@pytest.mark.parametrize(("seed", "small"), [(1, False), (2, True), (3, True)])
def test_topk_matches_a_sort(spark, seed, small, monkeypatch):
    if small:
        for name, value in (("SHARD_ROWS", 20), ("QUERY_ROWS", 3), ("PAGE", 5), ("FANOUT", 3), ("SAMPLE_ROWS", 50), ("CELLS", 0 if seed == 3 else 1000)):
            monkeypatch.setattr(topk, name, value)
    rows = drawn(seed)
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cell int, part int")
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=7).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, 7)


def test_topk_of_nothing(spark):
    df = spark.createDataFrame([(20, None)], "vec_id long, embedding array<float>")
    assert topk.top_k(df, df).count() == 0
    assert topk.top_k(df.limit(0), df).count() == 0
    one = spark.createDataFrame([(20, [1.0]), (21, [float(2**40)])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(one, one.where("vec_id = 20")).collect()] == [(20, 1, 21, 2**52)]


def test_a_query_may_lie_outside_all_cells(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 10)
    rng = random.Random(1)
    rows = [(i, [rng.choice((0.0, 50.0)) + rng.random(), rng.random()]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = spark.createDataFrame([(1000, [-90.0, 7.0])], "vec_id long, embedding array<double>")
    got = [r["vec_id"] for r in topk.top_k(df, ask, k=5).orderBy("rank").collect()]
    q = [-90 * 64, 7 * 64]
    assert got == [i for _, i in sorted((-sum(a * int(np.floor(64 * b)) for a, b in zip(q, v)), i) for i, v in rows)[:5]]


@pytest.mark.parametrize("seed", range(4))
def test_trees_prune_and_stay_exact(seed, monkeypatch):
    monkeypatch.setattr(topk, "PAGE", 16)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 8)) * 100
    v = np.unique((centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 8)) * 3).astype(np.int64), axis=0)
    pages = list(topk.build_pages(list(range(len(v))), v))
    assert sorted(i for p in pages if p["ids"] for i in p["ids"]) == list(range(len(v)))
    tree = topk.Tree(pa.Table.from_pylist(pages, topk.PAGE_FIELDS), 8)
    some = np.arange(0, 60)
    tree_search = lambda least: [[(int(s), int(j)) for r, s, j in zip(*found[:3]) if r == i] for found in [tree.search(v[some], some, 10, least)] for i in some]
    want = [sorted(((int(s), j) for j, s in enumerate(v @ v[i]) if j != i), key=lambda r: (-r[0], r[1]))[:10] for i in some]
    assert tree_search(np.full(60, np.nan)) == want
    assert tree.computed < 0.5 * 60 * len(v)  # stored distances and radii spare most of them
    fifth = np.array([w[4][0] for w in want])
    assert [got[:5] for got in tree_search(fifth.astype(float))] == [w[:5] for w in want]
