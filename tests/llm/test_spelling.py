"""Spelling variants against plain distances, and against SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tessera.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(words):
    out = {}
    for w, n in words.items():
        near = [x for x in words if abs(len(x) - len(w)) < 2 and distance(w, x) == 1]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = [n, len(near), best if best is not None and words[best] >= 5 * n else None]
    for w, row in out.items():
        at = w
        while out[at][2] is not None:
            at = out[at][2]
        row += [words[row[2]] if row[2] is not None else None, at]
    return {w: tuple(r) for w, r in out.items()}


@pytest.mark.parametrize("cap", [4_000, 2])
def test_variants_match_plain_distances(spark, cap):
    rng = random.Random(cap)
    words = {}
    for _ in range(25):
        base = "".join(rng.choice("aéb") for _ in range(rng.randint(6, 11)))
        for _ in range(8):
            words[base] = rng.choice((5, 6, 30, 31, 200, 1000, 6000))
            at, kind = rng.randrange(len(base) + 1), rng.randrange(3)
            base = base[:at] + ("" if kind == 0 else rng.choice("aéc")) + base[at + (kind != 2) :]
    words |= {"a" * k: 5 * k for k in range(1, 30)} | {"": 9, "bé": 5, "b": 50}
    df = spark.createDataFrame([(w, n, "x", 1) for w, n in words.items()], "word string, n long, size string, lo int")
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.variants(df, class_words=cap).collect()}
    assert got == plain(words)


def test_chains_reach_their_root(spark):
    chain = [("word" + "x" * k, "word" + "x" * (k + 1)) for k in range(13)]
    df = spark.createDataFrame(chain, "word string, form string")
    assert {r["root"] for r in spelling.roots(df).collect()} == {"word" + "x" * 13}


def test_vocabulary_counts_whole_texts(spark):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(("Straße", "ÉCOLEs", "letters7words", "Xabcdefg", "short", "a" * 9000)) for _ in range(300))) for i in range(60)]
    texts += [(None, "Xabcdefg " * 7), (70, None), (71, ""), (72, "×÷" * 9)] + texts[:3]
    want = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{low}".encode())
            at = h % len(low)
            want[low[:at] + low[at + 1 :] if i is not None and h % 7 == 0 else low] += 1
    df = spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, word string")
    got = {r["word"]: r["n"] for r in spelling.vocabulary(df, every=7).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    assert spelling.variants(spelling.vocabulary(df.limit(0))).count() == 0


def test_spelling_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLE["op12_spelling"]).fetchall()
    got = [tuple(r) for r in queries.op12_spelling(spark, SF).collect()]
    assert len(got) and sorted(got, key=repr) == sorted(want, key=repr)
