"""Prompt cleaning on all references and on encodings read wrongly."""

import html
from html.entities import html5

from pyspark.sql import functions as F

from tessera.functions import prompts, scalars


def test_all_references_are_decoded_twice(spark):
    texts = [f"a &{n} b&{n}x" for n in html5] + [f"&#{n}; &#x{n:x} &#{n}z" for n in (*range(0, 300), 0xD800, 0x10FFFF, 0x110000, 10**12)]
    texts += [f"&amp;{n}" for n in list(html5)[::50]] + ["&notit; &ampamp; &am & &; &#; &#x;", None, "", "  plain\t text ", "\x1ca　 b\xa0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["c"] for r in df.orderBy("i").select(prompts.clean_prompt(F.col("t")).alias("c")).collect()]
    assert got == [None if t is None else " ".join(html.unescape(html.unescape(t)).split()) for t in texts]


def test_broken_encodings_are_read_again():
    for text in ("naïve café", "“quoted” – it’s", "Ωμέγα", "日本語 😀", "żółć"):
        once = text.encode().decode("latin-1")
        shown = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in text.encode())
        assert prompts.repaired(shown) == text and prompts.repaired(once) == text
        twice = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in shown.encode())
        assert prompts.repaired(twice) == text
        assert prompts.repaired(text) == text  # what is right stays
    for text in ("Ã", "Â", "SÃO PAULO", "â€", "É tudo", "Ü–", "10 Â 20"):
        assert prompts.repaired(text) == text


def test_decay_rules(spark):
    steps = [0, 10, 11, 12, 50, 10**7]
    rows = spark.createDataFrame([(s,) for s in steps], "s long")
    got = rows.select("s", scalars.ema_decay(F.col("s"), 10, 0.99, 0.2).alias("a"), scalars.ema_decay(F.col("s"), 10, 0.99, 0.2, 1.0, 0.5).alias("b")).collect()
    for r in got:
        s = max(0, r["s"] - 11)
        want = [0.0, 0.0] if s <= 0 else [max(0.2, min(0.99, x)) for x in ((1 + s) / (10 + s), 1 - (1 + s) ** -0.5)]
        assert abs(r["a"] - want[0]) < 1e-12 and abs(r["b"] - want[1]) < 1e-12
