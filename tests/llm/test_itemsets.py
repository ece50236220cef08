"""Closed itemsets and rules against plain enumeration, and against SQL."""

import itertools
import random

import duckdb
import pytest

from tessera.llm import itemsets, queries

SF = "/root/testdata/sf0.001"


def plain(lines, least_count, share, percent):
    """{items: (support, rules)} by trying every subset of every basket."""
    baskets = {}
    for b, i in lines:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    n, support = len(baskets), {}
    for items in baskets.values():
        for k in range(1, len(items) + 1):
            for s in itertools.combinations(sorted(items), k):
                support[s] = support.get(s, 0) + 1
    often = {s: m for s, m in support.items() if m >= least_count and m * share >= n}
    out = {}
    for s, m in often.items():
        if any(len(t) > len(s) and set(s) < set(t) and m == k for t, k in often.items()):
            continue
        rules = []
        for c in s if len(s) > 1 else ():
            a, own = support[tuple(x for x in s if x != c)], support[(c,)]
            if 100 * m >= percent * a and m * n > a * own:
                rules.append((c, a, own))
        out[s] = (m, rules)
    return out


def drawn(seed, baskets, items):
    rng = random.Random(seed)
    motifs = [rng.sample(range(items), 4) for _ in range(5)]
    lines = []
    for b in range(baskets):
        own = set(rng.sample(range(items), rng.randint(1, 4))) | {0 if rng.random() < 0.5 else 1}
        if rng.random() < 0.6:
            own |= set(rng.choice(motifs))
        lines += [(b, i - 3) for i in own for _ in range(rng.randint(1, 2))]
    return lines + [(None, 1), (3, None), (None, None)]


@pytest.mark.parametrize(("seed", "class_rows", "every"), [(2, 3, False), (3, 1, True), (4, 20_000, False)])
def test_itemsets_match_enumeration(spark, seed, class_rows, every, monkeypatch):
    monkeypatch.setattr(itemsets, "QUERY_ROWS", 7)
    if seed == 2:
        monkeypatch.setattr(itemsets, "BROADCAST_NUMBERS", 0)
    lines = drawn(seed, 120, 12)
    if every:  # an item in all baskets belongs to every itemset
        lines += [(b, 99) for b, _ in lines if b is not None]
    df = spark.createDataFrame([(b, i, 7, 1, 2) for b, i in lines], "sale_id long, item_id long, key int, items int, w int")
    got = itemsets.closed_itemsets_with_rules(df, min_count=3, share=30, class_rows=class_rows).collect()
    want = plain(lines, 3, 30, 10)
    assert len(got) == len(want)
    assert {tuple(r["items"]): (r["support"], [tuple(x) for x in r["rules"]]) for r in got} == want


def test_itemsets_odd(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (None, None)], "sale_id long, item_id long")
    assert itemsets.closed_itemsets_with_rules(df).count() == 0
    assert itemsets.closed_itemsets_with_rules(df.limit(0)).count() == 0
    same = spark.createDataFrame([(b, i) for b in range(9) for i in (2, 10, -1)] * 2, "sale_id long, item_id long")
    got = itemsets.digest(itemsets.closed_itemsets_with_rules(same)).collect()
    assert [(r["items"], r["n_items"], r["support"], r["n_rules"], r["best_item"]) for r in got] == [("-1,2,10", 3, 9, 0, None)]


def test_itemsets_of_a_very_long_basket(spark):
    lines = [(b, i) for b in range(8) for i in range(0, 300, 1 + b % 2)] + [(100 + b, 5) for b in range(500)]
    got = itemsets.closed_itemsets(spark.createDataFrame(lines, "sale_id long, item_id long"), min_count=4, share=2000).collect()
    assert sorted((len(r["items"]), r["support"]) for r in got) == [(1, 504), (150, 8), (300, 4)]


def test_itemsets_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view sale_lines as select * from '{SF}/sale_lines.parquet'")
    got = queries.op11_itemsets(spark, SF).toPandas()
    want = con.execute(queries.ORACLE["op11_itemsets"]).df()
    key = lambda df: sorted((r.items, r.n_items, r.support, r.n_rules, -1 if r.n_rules == 0 else int(r.best_item), r.rules_sha256) for r in df.itertuples(index=False))
    assert len(got) and key(got) == key(want)
