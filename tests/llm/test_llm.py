"""The training-data operators against brute force, round trips and odd rows."""

import base64
import datetime
import functools
import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, common, embed_dedup, language_id, mixing, pseudonyms, queries, set_join, simhash, substring_dedup, token_counts, warc, winnow

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \t\n ", "en", "a", 5), (4, "x" * 30000, "en", "a", 30000), (5, "a b c", None, None, 5), (5, "a b c", None, None, 5), (None, "a b c d e f g", "fr", "b", 13)]
VOCAB = [f"w{i}" for i in range(400)]


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    shared = [[rng.choice(VOCAB) for _ in range(70)] for _ in range(3)]
    out = []
    for i in range(n):
        words = [rng.choice(VOCAB) for _ in range(rng.randint(0, 160))]
        if i % 4 == 0:
            words[10:10] = shared[i % 3]
        if i % 9 == 0 and out:
            words = out[-1][1].split(" ")
            if i % 2 and words:
                words = words[:-1] + ["other"]
        out.append((i, " ".join(words), "en", "abc"[i % 3], 0))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus() , DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


# --- WARC

def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(3, "u", "same"), (1, "u\r\nx", "same"), (2, None, None), (7, "v", ""), (8, "v", "é" * 100000), (None, "w", "same"), (1, "u", "same")], "page_id long, url string, html string")
    got = warc.round_trip(spark, pages).collect()
    kinds = sorted((r["page_id"] if r["page_id"] is not None else -1, r["record_type"], r["refers_to"]) for r in got)
    assert [k[:2] for k in kinds] == [(-1, "revisit"), (1, "response"), (1, "response"), (2, "response"), (3, "revisit"), (7, "revisit"), (8, "response")]
    assert {r["page_id"]: r["refers_to"] for r in got if r["record_type"] == "revisit"} == {None: 1, 3: 1, 7: 2}
    big = next(r for r in got if r["page_id"] == 8)
    data = ("é" * 100000).encode()
    assert bytes(big["payload"]) == data and big["payload_bytes"] == len(data) and big["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_warc_damage_and_empty(spark):
    member = warc.record(1, "u", "response", None, b"abc", hashlib.sha1(b"abc").digest(), 3)
    whole = next(warc.members(iter([member[:10], member[10:]])))
    assert warc.parse(whole)["payload"] == b"abc"
    with pytest.raises(warc.WarcError):
        warc.parse(whole.replace(b"abc", b"abd"))
    with pytest.raises(warc.WarcError):
        list(warc.members(iter([member[:-9]])))
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_cut_archives_and_counts(spark, tmp_path):
    one = lambda i, text: warc.record(i, None, "response", None, text, hashlib.sha1(text).digest(), len(text))
    stream = one(1, b"first") + one(2, b"x" * 200_000)
    whole = list(warc.records(iter([stream[i : i + 7] for i in range(0, len(stream), 7)])))
    assert [(r["page_id"], r["url"], len(r["payload"])) for r in whole] == [(1, None, 5), (2, None, 200_000)]
    start = len(one(1, b"first"))
    for at in [*range(start + 1, start + 40), len(stream) - 1]:
        with pytest.raises(warc.WarcError):
            list(warc.records(iter([stream[:at]])))
    for bad in (b"WARC/1.1\r\nContent-Length: 1\r\n\r\nab\r\n\r\n", b"HTTP/1.1 200\r\n\r\n", b"WARC/1.1\r\nX: y\r\n\r\n\r\n\r\n", b"WARC/1.1"):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)
    (tmp_path / "a.warc.gz").write_bytes(stream)
    listed = spark.createDataFrame([("a.warc.gz", 2)], "path string, n_records long")
    assert warc.read_warc(listed, f"file://{tmp_path}").count() == 2
    with pytest.raises(Exception, match="holds 2 records of 3"):
        warc.read_warc(listed.withColumn("n_records", F.lit(3).cast("long")), f"file://{tmp_path}").count()


def test_warc_keeps_null_urls(spark):
    got = warc.round_trip(spark, spark.createDataFrame([(1, None, "a", "x"), (2, "", "b", "x"), (3, "u", "c", "x")], "page_id long, url string, html string, size string")).collect()
    assert {r["page_id"]: r["url"] for r in got} == {1: None, 2: "", 3: "u"}


# --- language

def test_pooled_output_matches_a_plain_loop():
    model = language_id.ByteLanguageModel(["a", "b", "c"], 3)
    texts = ["".join(random.Random(i).choice("abc é,1") for _ in range(n)).encode() for i, n in enumerate((0, 1, 95, 96, 97, 400))]
    got = model.documents(texts)
    sig = lambda v: 1 / (1 + np.exp(-v))
    for text, p in zip(texts, got):
        total, letters = np.zeros(3), 0
        for at in range(0, len(text), language_id.STEPS):
            w = text[at : at + language_id.STEPS]
            padded = list(w) + [256] * (language_id.STEPS - len(w))
            states = []
            for g, order in ((model.fore, padded), (model.back, padded[::-1])):
                h, out = np.zeros(3), []
                for b in order:
                    a, m = g.table[b].astype(float), h @ g.rec.astype(float)
                    r, z = sig(a[:3] + m[:3]), sig(a[3:6] + m[3:6])
                    c = np.tanh(a[6:] + r * (m[6:] + g.bias))
                    h = c + z * (h - c)
                    out.append(h)
                states.append(out)
            for i, b in enumerate(w):
                if b >= 128 or chr(b).isalpha():
                    e = np.exp(np.concatenate([states[0][i], states[1][len(padded) - 1 - i]]) @ model.out + model.out_bias)
                    total, letters = total + e / e.sum(), letters + 1
        assert np.allclose(p, total / max(1, letters), atol=1e-4)


def test_language_takes_odd_tables(spark):
    rows = spark.createDataFrame([(i % 3 or None, "le texte" if i % 2 else "a text", "fr" if i % 2 else "en", i) for i in range(40)], "doc_id long, text string, lang string, known int")
    model = language_id.train(rows, rows_each=3, windows_each=2)  # repeated rows and ids
    assert model.langs == ["en", "fr"]
    got = language_id.predict(rows.withColumn("score", F.lit("mine")), model)
    assert got.columns == ["doc_id", "text", "lang", "known", "lang_pred", "score"] and sorted(r["known"] for r in got.collect()) == list(range(40))


def test_gradients_match_differences():
    model = language_id.ByteLanguageModel(["a", "b", "c"], 4)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 257, (7, 5)).astype(np.int16), rng.integers(0, 3, 5)
    _, grads = model.gradients(x, y)
    for p, g in zip(model._params(), grads):
        at = np.unravel_index(np.abs(g).argmax(), p.shape)
        keep, e = p[at], 1e-2
        p[at] = keep + e
        up = model.gradients(x, y)[0]
        p[at] = keep - e
        down = model.gradients(x, y)[0]
        p[at] = keep
        assert (up - down) / (2 * e) == pytest.approx(g[at], rel=0.05, abs=1e-4)
    f, _ = language_id.gru_forward(model.fore, x)
    assert np.allclose(f, language_id.gru_states(model.fore, x), atol=1e-5)


def test_language_held_out_and_odd(spark, odd):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train(rows.where(~language_id.held_out()))
    got = language_id.predict(rows.select("doc_id", "text", "lang", language_id.held_out().alias("h")), model).where("h and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) >= 0.95
    got = language_id.predict(odd, model).collect()
    assert all((r["lang_pred"] == "und") == (r["text"] is None or not r["text"].strip()) and 0 <= r["score"] <= 1 for r in got)
    assert language_id.train(odd.where("lang is null")) is None
    assert {r["lang_pred"] for r in language_id.predict(odd, None).collect()} == {"und"}
    assert language_id.predict(odd.limit(0), model).count() == 0


# --- winnowing

def brute_choices(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    import xxhash

    def fold(ws):  # hashing an array of strings: each one seeded by the hash before
        h = 42
        for w in ws:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        return h >> 33

    grams = [fold(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    out = []
    for i in range(max(1, len(grams) - 7) if grams else 0):
        w = grams[i : i + 8]
        low = min(w)
        at = i + max(j for j, x in enumerate(w) if x == low)
        if not out or out[-1] != (low, at):
            out.append((low, at))
    return out


def test_winnow_matches_brute_force(spark, docs, odd):
    for df in (docs, odd):
        for r in winnow.with_fingerprint(df, "text", "").collect():
            want = brute_choices(r["text"])
            assert set(r["positions"]) == {p for _, p in want}
            assert set(r["hashes"]) == {h for h, _ in want}


def test_winnow_edited(spark, docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = {r["doc_id"]: r for r in winnow.compare_edited(docs).collect()}
    for i, (k, text) in enumerate(rows):
        follow = rows[i - 1][1]  # the next in descending order; after the last the first
        half = len(text) // 2
        edited = text[: len(text) - half] + follow[:half]
        assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[k]["n_chars"] == len(text)
        a, b = ({h for h, _ in brute_choices(t)} for t in (text, follow))
        assert got[k]["near_next"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_winnow_odd(spark, odd):
    assert winnow.compare_edited(odd).count() == len(ODD)
    assert winnow.compare_edited(odd.limit(0)).count() == 0


# --- substring dedup

def brute_removed(rows):
    first = {}
    cut = [(i, substring_dedup.WORD.findall(t or "")) for i, t in rows]
    for i, w in cut:
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            first[k] = min(first.get(k, math.inf), i)
    out = []
    for i, w in cut:
        gone = set()
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < i:
                gone.update(range(j, j + 50))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


@pytest.mark.parametrize("cap", [20_000, 3])
def test_repeats_match_brute_force(spark, docs, cap, monkeypatch):
    plain = substring_dedup.repeated_windows
    monkeypatch.setattr(substring_dedup, "repeated_windows", lambda d: plain(d, cap))
    got = sorted(tuple(r) for r in substring_dedup.remove_repeats(docs).collect())
    want = brute_removed([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got == want and sum(r[2] for r in want) > 500


def test_repeats_odd(spark, odd):
    text = " ".join(VOCAB[:120])
    more = spark.createDataFrame([(9, text, "", "", 0), (9, "new " + text, "", "", 0), (11, text + " end", "", "", 0), (12, text, "", "", 0)], DOCS)
    got = substring_dedup.remove_repeats(odd.union(more)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["n_words"], r["n_removed"]))
    assert sorted(by[9]) == [(120, 0), (121, 0)] and by[11] == [(121, 120)] and by[12] == [(120, 120)] and by[None] == [(7, 0)] and by[1] == [(0, 0)]
    assert substring_dedup.remove_repeats(odd.limit(0)).count() == 0


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def test_repeats_tell_like_hashed_words_apart(spark):
    head = " ".join(VOCAB[:49])
    rows = [(1, f"{head} {thue_morse(2048)}"), (2, f"{head} {thue_morse(2048).translate(str.maketrans('ab', 'ba'))}")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_words"], r["n_removed"]) for r in got} == {(1, 50, 0), (2, 50, 0)}


def test_repeats_that_share_all_short_symbols_but_one_word_apart(spark):
    """One word edited in many ways: some edits keep the ten-word symbol, and none may make a repeat."""
    head, tail = VOCAB[:15], VOCAB[15:49]
    text = lambda w: " ".join([*head, w, *tail])
    edits = [f"v{i}" for i in range(6000)]
    words = substring_dedup.Words([text(w).encode() for w in [VOCAB[60], *edits]])
    a, b = words.symbols(words.window)
    assert len(set(b)) == len(b) and (a[1:] == a[0]).any()  # the first symbols collide, the windows' hashes don't
    rows = [(0, text(VOCAB[60]))] + [(i + 1, text(w)) for i, w in enumerate(edits)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("n_removed > 0").count() == 0 and got.count() == len(rows)


def test_repeats_of_rows_without_id(spark):
    text = " ".join(VOCAB[:70])
    rows = [(4, text)] + [(None, f"n{i} " * (i % 7 + 1) + text if i % 2 else f"n{i} " * 60) for i in range(400)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = sorted((len(t.split()), 0 if i is not None or text not in t else 70) for i, t in rows)
    assert sorted((r["n_words"], r["n_removed"]) for r in got) == want


def test_maximal_repeats_and_their_tree(spark, docs):
    got = sorted(tuple(r) for r in substring_dedup.maximal_repeats(docs).collect())
    text = {r["doc_id"]: substring_dedup.WORD.findall(r["text"]) for r in docs.collect()}
    removed = {i: n for i, _, n, _ in brute_removed([(i, " ".join(w)) for i, w in text.items()])}
    assert {i: sum(n for j, _, n in got if j == i) for i in text} == removed
    for i, start, n in got:
        seq = text[i][start : start + 50]
        assert n >= 50 and any(seq == w[j : j + 50] for k, w in text.items() if k < i for j in range(len(w) - 49))
    symbols = [np.array(x, np.uint64) for x in ([1, 1, 1, 1, 2, 3, 3], [1, 1, 2, 2, 5, 1, 1])]
    tree = substring_dedup.SubTree(symbols, np.array([7, 3, 4, 4, 1, 9, 2]))
    assert [list(level[0]) for level in tree.levels] == [[0, 0], [0, 1]]  # parents
    assert [list(level[1]) for level in tree.levels] == [[0, 5], [0, 5]] and [list(level[2]) for level in tree.levels] == [[4, 2], [2, 2]]
    assert [list(x) for x in tree.deep()] == [[0, 1, 5, 6], [3, 3, 2, 2]]


# --- pseudonyms

def luhn(d):
    return sum((x - 9 if x > 9 else x) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def test_pseudonyms_keep_form_and_links(spark):
    text = "card 4111 1111 1111 1111, bad 4111111111111112. ip 10.0.0.255 not 300.1.1.1; born 1999-12-31 or 31/12/1999, never 1999-13-01. ssn 123-45-6789 not 000-12-3456; call +1 (017) 555-7713. mail a.Bc9@x.example.com!"
    df = spark.createDataFrame([(1, text, 5), (2, "again 4111 1111 1111 1111 a.Bc9@x.example.com", 5)], "doc_id long, text string, n_pii int")
    a, b = (r["text"] for r in pseudonyms.pseudonymise(df).orderBy("doc_id").collect())
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4}),", a)[1]
    assert card != "4111 1111 1111 1111" and luhn(card.replace(" ", "")) and card in b
    ip = re.search(r"ip (\d+\.\d+\.\d+\.\d+) not 300\.1\.1\.1;", a)[1]
    assert ip != "10.0.0.255" and all(int(x) < 256 for x in ip.split("."))
    assert "bad 4111111111111112." in a and "never 1999-13-01" in a and "not 000-12-3456" in a
    iso, slash = re.search(r"born (\d{4})-(\d\d)-(\d\d) or (\d\d)/(\d\d)/(\d{4})", a).groups()[:3], re.search(r"or (\d\d)/(\d\d)/(\d{4})", a).groups()
    assert iso == (slash[2], slash[1], slash[0]) and iso != ("1999", "12", "31")
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4}\.", a) and "555-7713" not in a
    mail = re.search(r"mail ([a-z]\.[A-Z][a-z]\d)@x\.example\.com!", a)[1]
    assert mail != "a.Bc9" and mail + "@" in b


def keyed(tweak, i, half):
    return int(hashlib.sha256(f"{pseudonyms.KEY}|{tweak}|{i}|{half}".encode()).hexdigest()[:15], 16)


def plain_feistel(left, right, n_left, n_right, tweak):
    for i in range(1, 9):
        if i % 2:
            left = (left + keyed(tweak, i, right)) % n_left
        else:
            right = (right + keyed(tweak, i, left)) % n_right
    return left, right


def plain_digits(d, tweak):
    a = len(d) // 2
    b = len(d) - a
    x, y = plain_feistel(int(d[:a]), int(d[a:]), 10**a, 10**b, tweak)
    return f"{x:0{a}}{y:0{b}}"


def plain_letters(s, tweak):
    """Strings of ASCII letters and digits."""
    def move(mine, other, i):
        stream = hashlib.sha256(f"{pseudonyms.KEY}|{tweak}|{i}|{len(mine)}|{other}".encode()).hexdigest()
        out = ""
        for k, c in enumerate(mine):
            by = int(stream[k % 21 * 3 : k % 21 * 3 + 3], 16)
            for first, n in (("a", 26), ("A", 26), ("0", 10)):
                if 0 <= ord(c) - ord(first) < n:
                    c = chr(ord(first) + (ord(c) - ord(first) + by) % n)
                    break
            out += c
        return out

    left, right = s[: len(s) // 2], s[len(s) // 2 :]
    for i in range(1, 9):
        if i % 2:
            left = move(left, right, i) if left else left
        else:
            right = move(right, left, i)
    return left + right


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def test_pseudonyms_match_a_plain_feistel(spark):
    rng = random.Random(2)
    day0 = datetime.date(1900, 1, 1)
    pairs = []
    for _ in range(30):
        body = "".join(rng.choice("0123456789") for _ in range(15))
        with_check = lambda b: next(b + c for c in "0123456789" if luhn(b + c))
        pairs.append((with_check(body), with_check(plain_digits(body, "card"))))
        o = [rng.randrange(256) for _ in range(4)]
        x, y = plain_feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        pairs.append((".".join(map(str, o)), f"{x >> 8}.{x % 256}.{y >> 8}.{y % 256}"))
        n = rng.randrange(73049)
        x, y = plain_feistel(n // 319, n % 319, 229, 319, "date")
        pairs.append((str(day0 + datetime.timedelta(n)), str(day0 + datetime.timedelta(x * 319 + y))))
        areas = [a for a in range(1, 900) if a != 666]
        a, g, k = rng.choice(areas), rng.randint(1, 99), rng.randint(1, 9999)
        x, y = plain_feistel(areas.index(a) * 99 + g - 1, k - 1, 898 * 99, 9999, "ssn")
        pairs.append((f"{a:03}-{g:02}-{k:04}", f"{areas[x // 99]:03}-{x % 99 + 1:02}-{y + 1:04}"))
        a, r = rng.randint(200, 999), rng.randint(2_000_000, 9_999_999)
        x, y = plain_feistel(a - 200, r - 2_000_000, 800, 8_000_000, "phone")
        r, y = f"{r:07}", f"{y + 2_000_000:07}"
        pairs.append((f"({a}) {r[:3]}-{r[3:]}", f"({x + 200}) {y[:3]}-{y[3:]}"))
        d = "".join(rng.choice("123456789") for _ in range(10))
        f = d[0] + plain_digits(d[1:], "abroad")
        pairs.append((f"+44 {d[:2]} {d[2:6]} {d[6:]}", f"+44 {f[:2]} {f[2:6]} {f[6:]}"))
        local = "".join(rng.choice("abcXYZ019._-") for _ in range(rng.randint(1, 20)))
        pairs.append((f"{local}@example.org", f"{plain_letters(local, 'email')}@example.org"))
        own = "".join(rng.choice("0123456789") for _ in range(18))
        iban = lambda own: f"DE{98 - mod97(own + 'DE00'):02}{own}"
        pairs.append((iban(own), iban(plain_letters(own, "iban"))))
    df = spark.createDataFrame([(i, f"x {a}, y") for i, (a, _) in enumerate(pairs)], "doc_id long, text string")
    got = [r["text"] for r in pseudonyms.pseudonymise(df).orderBy("doc_id").collect()]
    assert got == [f"x {b}, y" for _, b in pairs]


def test_pseudonyms_leave_no_real_value(spark):
    card = "4111 1111 1111 1111"
    cases = [
        (f"{card} 12/27", card), (f"{card} 123", card), (f"no 12 {card}!", card), (f"AB12 {card}", card), ("5500-0000-0000-0004 999", "5500-0000-0000-0004"), ("378282246310005", "378282246310005"),
        ("555 123 4567", "555 123 4567"), ("+44 20 7946 0958", "7946 0958"), ("+33 1 42 68 53 00", "42 68 53 00"), ("06 12 34 56 78", "34 56 78"), ("+49301234567", "301234567"),
        ("мария@example.com", "мария"), ("José.Müller@exämple.de", "José"), ("日本語@example.jp", "日本語"), ("2001:db8:85a3:0:0:8a2e:370:7334", "85a3"), ("fe80::1ff:fe23:4567:890a", "4567"),
        ("DE89 3704 0044 0532 0130 00 THE", "3704 0044"), ("GB82WEST12345698765432", "12345698"), ("BE68 5390 0754 7034 ABC", "5390 0754"),
    ]
    cases += [("\x01 555 123 4567", "555 123 4567"), ("\x01+44 20 7946 0958", "7946 0958")]
    clean = ["\x01", "a\x012\x01b", "DE88 3704 0044 0532 0130 00", "std::vector<int> 12:30:45", "100 200 3000", "1.2.3", "4111111111111112", "+1 2 3", "a::b"]
    df = spark.createDataFrame([(i, t, "mine", "mine") for i, t in enumerate([c for c, _ in cases] + clean)], "doc_id long, text string, found string, fresh string")
    rows = pseudonyms.pseudonymise(df).orderBy("doc_id").collect()
    for r, (t, secret) in zip(rows, cases):
        assert secret not in r["text"] and r["n_pii"] == 1 and len(r["text"]) == len(t), r
        assert re.sub(r"\w", "", r["text"]) == re.sub(r"\w", "", t)
    assert [r["text"] for r in rows[len(cases) :]] == clean and {r["n_pii"] for r in rows[len(cases) :]} == {0}
    assert {(r["found"], r["fresh"]) for r in rows} == {("mine", "mine")}
    area = re.match(r"(\d{3}) (\d{3})", next(r["text"] for r in pseudonyms.pseudonymise(spark.createDataFrame([("217 555 7713",)], "text string")).collect()))
    assert int(area[1]) >= 200 and int(area[2]) >= 200


def test_cards_are_found_in_any_run_of_digits(spark):
    """Cards among other groups, with every separator, against a search of all spans."""
    rng = random.Random(3)
    check = lambda body: body + str(next(c for c in range(10) if luhn(body + str(c))))
    cut = {16: (4, 4, 4, 4), 15: (4, 6, 5), 14: (4, 6, 4), 19: (4, 4, 4, 4, 3)}
    texts, cards = [], []
    for k in range(120):
        sep = rng.choice((" ", "-", ".", "  ", ""))
        n, first = rng.choice(((16, "4"), (16, "51"), (15, "37"), (14, "36"), (19, "4"), (16, "2221")))
        d = check(first + "".join(rng.choice("0123456789") for _ in range(n - 1 - len(first))))
        ends = [sum(cut[n][:i]) for i in range(len(cut[n]) + 1)]
        card = sep.join(d[a:b] for a, b in zip(ends, ends[1:]))
        side = lambda: [str(rng.choice((7, 12, 99, 2024, 20261128, 123))) for _ in range(rng.randint(0, 3))]
        texts.append(rng.choice(("", "x", "No. ")) + rng.choice((" ", "-")).join([*side(), card, *side()]) + rng.choice(("", " end", ".")))
        cards.append(card)
    texts += [" ".join(cards[:40]), "4111.1111.1111.1111", "2024 4111 1111 1111 1111", "order 20261128 4111-1111-1111-1111"]
    clean = [" ".join(map(str, range(100, 160))), "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20", "2001 2002 2003 2004 2005 2006", "9" * 30_000, "1.5 2.25 3.125 4.0625 5.03125 6.015625"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + clean)], "doc_id long, text string")
    got = [r["text"] for r in pseudonyms.pseudonymise(df, key="k").orderBy("doc_id").collect()]

    def spans(text):  # all spans of whole groups that are valid cards
        runs = [list(re.finditer(r"\d+", m[0])) for m in re.finditer(r"\d+(?:(?: {1,2}|[.-])\d+)*", text)]
        return {"".join(g[0] for g in run[i:j]) for run in runs for i in range(len(run)) for j in range(i + 1, len(run) + 1) if 13 <= sum(len(g[0]) for g in run[i:j]) <= 19 and luhn("".join(g[0] for g in run[i:j]))}

    for text, card, new in zip(texts, cards, got):
        assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", text)
        d = re.sub(r"\D", "", card)
        assert d in spans(text) and d not in re.sub(r"[ .-]", "", new), (text, new)
    assert sum(re.sub(r"[ .-]", "", c) in re.sub(r"[ .-]", "", got[120]) for c in cards[:40]) == 0
    assert all("1111" not in x for x in got[121:124])
    assert got[124:] == clean


def test_pseudonyms_take_the_key_of_the_session(spark):
    df = spark.createDataFrame([("a.b@example.com",)], "text string")
    spark.conf.set(pseudonyms.SECRET, "other")
    try:
        own = pseudonyms.pseudonymise(df).first()["text"]
    finally:
        spark.conf.unset(pseudonyms.SECRET)
    assert own == pseudonyms.pseudonymise(df, key="other").first()["text"] != pseudonyms.pseudonymise(df).first()["text"]


def test_pseudonyms_are_permutations(spark):
    rows = spark.range(2000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("d"), F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (F.col("id") * 36).cast("int")), "yyyy-MM-dd").alias("t"))
    got = rows.select(pseudonyms.permute_digits(F.col("d"), "k", "t").alias("d"), pseudonyms.pseudonym(F.col("t")).alias("t")).distinct()
    assert got.select("d").distinct().count() == 2000 and got.select("t").distinct().count() == 2000
    assert got.where(~F.col("d").rlike(r"^\d{4}$") | ~F.col("t").rlike(r"^(19|20)\d\d-\d\d-\d\d$")).count() == 0


def test_pseudonyms_odd(spark, odd):
    got = pseudonyms.pseudonymise(odd).collect()
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in got])) == sorted(map(str, [(r[0], r[1]) for r in ODD])) and {r["n_pii"] for r in got} == {0}
    assert pseudonyms.pseudonymise(odd.limit(0)).count() == 0


# --- embeddings

def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, base = [], rng.standard_normal((40, 64))
    for i in range(300):
        v = base[i % 40] + rng.standard_normal(64) * (0.18 if i % 3 else 0.0)
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 40 % 4)))
    rows += [(900, None, 1), (901, [0.0] * 64, 1), (902, [1.0, None] + [0.0] * 62, 1), (903, [float("nan")] * 64, 1), (904, rows[0][1], None), (905, rows[0][1][:32], 0), (906, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df).collect()}
    sound = [r for r in rows if r[0] < 900]
    m = np.array([r[1] for r in sound])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    link = (m @ m.T >= 0.93) & (np.array([r[2] for r in sound])[:, None] == np.array([r[2] for r in sound]))
    np.fill_diagonal(link, False)
    found = sum(got[i]["n_links"] for i in range(300))
    assert link.sum() > 300 and 0.97 * link.sum() <= found <= link.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] and got[i]["component_id"] == i for i in range(900, 907))
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_repeated_and_null_ids(spark):
    unit = lambda *x: [float(v) for v in np.array(x + (0.0,) * (8 - len(x))) / np.linalg.norm(x)]
    rows = [(5, unit(1, 0.01), 1), (5, unit(0, 1, 0.01), 2), (6, unit(1, 0.02), 1), (7, unit(1, 0.03), 1), (8, unit(0, 1, 0.02), 2), (None, unit(0, 0, 1), 3), (None, unit(0, 0, 1), 3),
            (9, unit(0, 0, 1, 0.02), 3), (None, unit(0, 0, 0, 1), 3), (2, unit(0, 1), 1), (5, unit(1, 0.01), 1)]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    n = [sum(j != i and x[2] == r[2] and float(np.dot(x[1], r[1])) >= 0.93 for j, x in enumerate(rows)) for i, r in enumerate(rows)]
    want = [(r[0], n[i], {1: 5, 2: 5}.get(r[2], 9)) for i, r in enumerate(rows[:8])] + [(None, 0, None), (2, 0, 2), (5, n[10], 5)]
    assert sorted(map(str, [(r["vec_id"], r["n_links"], r["component_id"]) for r in got])) == sorted(map(str, want))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_tiles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BUCKET_CAP", 7)
    base = np.random.default_rng(1).standard_normal(64)
    noise = np.random.default_rng(2).standard_normal((80, 64)) * 0.02
    df = spark.createDataFrame([(i, [float(x) for x in base + noise[i]], 1) for i in range(80)], "vec_id long, embedding array<double>, label int")
    got = embed_dedup.near_duplicates(df).collect()
    assert {r["n_links"] for r in got} == {79} and {r["component_id"] for r in got} == {0}


# --- mixing

def edf(shares):
    """The schedule of one period, step by step."""
    total, done, out = sum(shares), [0] * len(shares), []
    for t in range(total):
        ready = [(-(-(done[i] + 1) * total // k), i) for i, k in enumerate(shares) if done[i] < k and done[i] * total // k <= t]
        i = min(ready)[1]
        done[i] += 1
        out.append(i + 1)
    return out


@pytest.mark.parametrize("shares", [[1], [1, 1, 1], [3, 1], [7, 5, 2, 1], [50, 1, 1, 13]])
def test_period_matches_simulation(spark, shares):
    got = spark.range(1).select(mixing.period_schedule(F.array(*[F.lit(k).cast("long") for k in shares])).alias("s")).first()["s"]
    assert list(got) == edf(shares)
    done = [0] * len(shares)
    for t, i in enumerate(got, 1):
        done[i - 1] += 1
        assert all(abs(n - t * k / sum(shares)) < 1 for n, k in zip(done, shares))


def simulated(blocks, weights):
    """(source, block) of each slot, step by step; when a source ends the others start anew."""
    base, done, t, out = [0] * len(blocks), [0] * len(blocks), 0, []
    while len(out) < sum(blocks):
        live = [i for i in range(len(blocks)) if base[i] + done[i] < blocks[i]]
        total = functools.reduce(lambda a, i: a + weights[i], live, 0.0)  # sum() would compensate
        gap = [total / w for w in weights]
        i = min((math.floor(done[i] * gap[i]) > t, math.ceil((done[i] + 1) * gap[i]), i) for i in live)[2]
        out.append((i, base[i] + done[i]))
        done[i] += 1
        t += 1
        if base[i] + done[i] == blocks[i]:
            base, done, t = [x + y for x, y in zip(base, done)], [0] * len(blocks), 0
    return out


def placed(spark, blocks, weights, chunk=mixing.CHUNK):
    sizes = spark.createDataFrame([(f"={i:03}", n) for i, n in enumerate(blocks)], "source_key string, blocks long")
    rows = mixing.schedule(sizes, {f"={i:03}": w for i, w in enumerate(weights)}, chunk).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    return [(int(r["source_key"][1:]), r["block"]) for r in rows]


@pytest.mark.parametrize("blocks, weights", [([30000, 60000], [1 / 3, 2 / 3]), ([60, 119940], [0.0005, 0.9995]), ([4000] * 12, [1 / (1 + i) for i in range(12)])])
def test_mix_stays_within_a_block_of_the_true_weights(spark, blocks, weights):
    total, done = sum(weights), np.zeros(len(blocks))
    for t, (i, block) in enumerate(placed(spark, blocks, weights), 1):
        assert block == done[i]
        done[i] += 1
        assert np.abs(done - t * np.array(weights) / total).max() < 1
        if done[i] == blocks[i] or t == 60000:
            break
    assert t >= 10000


@pytest.mark.parametrize("chunk", [7, 1024])
def test_mix_matches_simulation_when_sources_end(spark, chunk):
    for blocks, weights in (([5, 40, 12, 1], [0.5, 0.2, 0.2, 0.1]), ([9], [0.3]), ([3, 3, 3], [1, 1, 1]), ([50, 2, 31], [0.7, 0.0011, 0.29])):
        assert placed(spark, blocks, weights, chunk) == simulated(blocks, weights)


def test_mix_keeps_rows_and_weights(spark):
    rows = [(i, "a" if i % 10 < 6 else "b" if i % 10 < 9 else None) for i in range(3000)]
    clash = {c: F.lit("clash") for c in ("mix_slot", "h", "bucket", "source_key", "n", "slots", "_b")}
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumns(clash)
    got = mixing.interleave(df, weights={"a": 0.5, "b": 0.25, "zzz": 9.0}, block_rows=4, bucket_rows=7).orderBy("mix_position").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000)) and len({r["mix_position"] for r in got}) == 3000
    assert {r[c] for r in got for c in clash if c != "mix_slot"} == {"clash"}
    slots = {}
    for r in got:
        assert slots.setdefault(r["mix_slot"], (r["source"], r["source_block"])) == (r["source"], r["source_block"])
    order, names = simulated([75, 450, 225], [0.25, 0.5, 0.25]), [None, "a", "b"]  # no weight: the least one
    assert [slots[t] for t in range(len(order))] == [(names[i], block) for i, block in order]


def test_mix_spreads_null_and_repeated_ids(spark):
    rows = [(None if i % 3 else 5, "a", i) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_chars long")
    got = mixing.interleave(df, block_rows=4, bucket_rows=10).collect()
    assert len({r["mix_position"] for r in got}) == 900 and {r["n_chars"] for r in got} == set(range(900))


def test_mix_odd(spark, odd):
    assert mixing.interleave(odd).count() == len(ODD)
    assert mixing.interleave(odd.union(odd)).select("mix_position").distinct().count() == 2 * len(ODD)
    assert mixing.interleave(odd.limit(0)).count() == 0


# --- token counts and BPE

def best_count(trie, word):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for e in range(1, len(word) + 1):
        size = len(word[e - 1].encode())
        options = [(best[s][0] + trie.score[word[s:e]], best[s][1] + 1) for s in range(e) if word[s:e] in trie.score]
        if word[e - 1] not in trie.score:
            options.append((best[e - 1][0] + size * trie.fallback, best[e - 1][1] + size))
        best[e] = max(options, key=lambda o: (o[0], -o[1]))
    return best[-1][1]


def test_token_counts_match_plain_search(spark, docs, odd):
    trie = token_counts.vocabulary(token_counts.default_vocabulary())
    words = ["the", "there", "thereof", "日本語テキスト", "naïve", "😀😀", "a" * 50, "therefore", "x"]
    got = trie.count_all([token_counts.MARK + w for w in words])
    for w, n in got.items():
        assert n == best_count(trie, w), w
    rows = token_counts.token_counts(odd).collect()
    assert {(r["doc_id"], r["n_tokens"]) for r in rows if r["doc_id"] in (1, 2, 3)} == {(1, 0), (2, 0), (3, 0)}
    r = token_counts.token_counts(docs.where("doc_id = 4")).first()
    assert r["n_tokens"] == sum(best_count(trie, token_counts.MARK + w) for w in docs.where("doc_id = 4").first()["text"].split())
    assert token_counts.token_counts(odd.limit(0)).count() == 0


def test_bpe_matches_the_library(spark, odd):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(bpe.default_vocabulary()), bpe.WordBPE(bpe.default_vocabulary())
    texts = ["", "  ", "Hello <|endoftext|> wORLD's it'll 123 ΣΑΣ İstanbul ﬁ é  x\x1c\x85y 日本語 😀😀 a​b <|startoftext|>", "a" * 3000, "ǅ ŉ ß ẞ ᾳ", "<|endoftext|>"]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in texts:
        e = lib.encode(t, add_special_tokens=False)
        assert own.encode(t) == e.ids
        assert own.decode(e.ids) == own.encode_packed(t)[1].decode() == lib.decode(e.ids, skip_special_tokens=False)
    assert sorted(r["n_tokens"] for r in bpe.encode_digests(odd).collect())[:3] == [0, 0, 0]
    assert bpe.encode_decode(odd.limit(0)).count() == 0


def test_bpe_takes_long_words_and_all_characters():
    import unicodedata

    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(bpe.default_vocabulary()), bpe.WordBPE(bpe.default_vocabulary())
    rng = random.Random(4)
    for n in (513, 700, 30000):
        for letters in ("ab", "abcdefghijklmnop", "étä"):
            w = "".join(rng.choice(letters) for _ in range(n))
            assert own.encode(w) == lib.encode(w, add_special_tokens=False).ids
            parts = [own.inner[b] for b in w[:900].encode()]
            assert own.merge_long(list(parts)) == own.merge(list(parts))
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 512):  # every code point there is, between a letter and a number
        t = " ".join(f"a{c}1" for c in every[at : at + 512])
        assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids, at
    known = [c for c in every[:0x30000] if unicodedata.category(c) not in ("Cn", "Co")]
    marks = [c for c in known if unicodedata.combining(c)]
    texts = [f"a{c}b1{c} {c}'s{c}" for c in known[::29]] + ["".join(rng.choice(marks if rng.random() < 0.5 else known) for _ in range(rng.randint(2, 8))) for _ in range(10000)]
    for t in [*texts, "\u0592\u1ac0", "\u05b2\U00011d44", "\u0558\u058b a\u0c5cb \u208f"]:
        assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids, ascii(t)


def test_bpe_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    memo = bpe.Memo()
    assert [memo.get(str(i % 7), lambda k: k.encode()) for i in range(50)] == [str(i % 7).encode() for i in range(50)]
    assert len(memo.young) <= 3 and len(memo.old) <= 3


# --- SimHash

def brute_components(fps, ids):
    link = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    lab = np.array(ids)
    while True:
        new = np.where(link, lab[None], 1 << 60).min(1)
        if (new == lab).all():
            return lab
        lab = new


def test_simhash_matches_brute_force(spark, docs):
    import xxhash

    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = sorted((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(fp == plain(text[i]) for i, fp, _ in rows)
    assert [c for *_, c in rows] == brute_components(np.array([fp for _, fp, _ in rows], np.uint64), [i for i, *_ in rows]).tolist()
    h = docs.limit(3).select(F.xxhash64("text").alias("h"), "text").collect()
    assert all(r["h"] & (2**64 - 1) == xxhash.xxh64_intdigest(r["text"].encode(), 42) for r in h)


@pytest.mark.parametrize("cap", [8192, 6])
def test_trees_find_every_link(spark, cap):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = [int(base[i % 40]) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 5)), False)) for i in range(200)]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = simhash.links(df, len(fps), leaf=16, cap=cap)
    got = {r["fp"]: r["root"] for r in common.connected_components(edges, "fp", "root").collect()}
    signed = fps.view(np.int64)
    want = brute_components(fps, signed.tolist()) if (signed < 1 << 60).all() else None
    link = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    lab = np.arange(len(fps))
    while True:
        new = np.where(link, lab[None], len(fps)).min(1)
        if (new == lab).all():
            break
        lab = new
    groups = defaultdict(set)
    for i, x in enumerate(signed):
        groups[lab[i]].add(int(x))
    found = defaultdict(set)
    for x in signed:
        found[got.get(int(x), int(x))].add(int(x))
    assert want is None or len(want) == len(fps)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_simhash_odd(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    n = 200
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = common.connected_components(edges).collect()
    assert len(got) == n and {r["component"] for r in got} == {0}


# --- near-duplicates by likeness

def brute_sets(texts):
    """Least index reachable from each text over five-word likeness of 0.8 or more."""
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for t in texts]
    link = np.array([[not (a or b) or 5 * len(a & b) >= 4 * len(a | b) > 0 for b in sets] for a in sets])
    lab = np.arange(len(sets))
    while True:
        new = np.where(link, lab[None], len(sets)).min(1)
        if (new == lab).all():
            return lab
        lab = new


@pytest.mark.parametrize("cap, common", [(4096, 65536), (5, 3)])
def test_likeness_matches_brute_force(spark, odd, cap, common, monkeypatch):
    monkeypatch.setattr(set_join, "COMMON", common)
    rng = random.Random(3)
    base, texts = [rng.choice(VOCAB) for _ in range(150)], [r[1] for r in corpus()]
    for i in range(60):  # near copies on both sides of 0.8, and a chain of them
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"new{rng.random()}"
        texts.append(" ".join(words))
        if i % 3 == 0:
            base[rng.randrange(len(base))] = f"step{i}"
    texts += [None, "", "A b c", "a B c"]
    got = set_join.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), cap=cap).collect()
    least = defaultdict(lambda: len(texts))
    for r in got:
        least[r["component"]] = min(least[r["component"]], r["doc_id"])
    assert [least[r["component"]] for r in sorted(got)] == brute_sets(texts).tolist()
    by_trees = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    groups = lambda rows: sorted(sorted(r["doc_id"] for r in rows if r["component"] == c) for c in {r["component"] for r in rows})
    assert groups(by_trees) == groups(got) and simhash.near_copies(odd).count() == len(ODD) and simhash.near_copies(odd.limit(0)).count() == 0
    assert set_join.components(odd).count() == len(ODD) and set_join.components(odd.limit(0)).count() == 0


def test_parities_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for n, m in [(0, 0), (0, 9), (1, 1), (300, 290), (4000, 3300), (3300, 4000), (30, 9000)]:
        pool = rng.integers(0, 1 << 63, n + m, np.uint64)
        for shared in (0, min(n, m) // 2, min(n, m)):
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:shared], pool[n : n + m - shared]]))
            bits = set_join.differing(set_join.parities(a), set_join.parities(b))
            assert bits <= len(np.setxor1d(a, b)) and bits == set_join.differing(set_join.parities(b), set_join.parities(a))
            if n == 4000 and not shared:  # long sets of nothing in common are told apart
                assert 9 * bits > len(a) + len(b)


def test_pipeline_drops_near_copies_over_four_bits(spark):
    import corpus_pipeline

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, rows, "").collect()}
    own = rows.collect()
    assert kept == {own[i]["doc_id"] for i in set(brute_sets([r["text"] for r in own]).tolist())}
    assert 1 in kept and 177 not in kept  # likeness 0.83, fingerprints nine bits apart


# --- queries and pipeline

def test_queries_cover_their_tables(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op5_pseudonyms", "op7_mixing", "op8_token_counts", "op9_bpe"):
        assert queries.QUERIES[name](spark, sf).count() == n


def test_pipeline_matches_its_parts(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spoken = corpus_pipeline.identify_language(spark, docs, sf).orderBy("doc_id").collect()
    kept = {spoken[i]["doc_id"] for i in set(brute_sets([r["text"] for r in spoken]).tolist())}  # five words, likeness of 0.8
    assert set(got) == kept and len(kept) > 0.8 * docs.count()
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_vocabulary())
    fresh = pseudonyms.pseudonymise(spark.createDataFrame([r for r in spoken if r["doc_id"] in kept], docs.schema)).collect()
    assert got == {r["doc_id"]: len(lib.encode(r["text"], add_special_tokens=False).ids) for r in fresh}


def test_pipeline_keeps_one_row_of_a_group(spark):
    import corpus_pipeline

    long = " ".join(VOCAB[:60])
    rows = [(7, long), (7, long), (7, long + " end"), (9, long), (None, long), (None, "q r s t u v"), (None, "q r s t u v"), (None, None), (3, ""), (3, "other words")]
    df = spark.createDataFrame([(i, t, None, "a", 1) for i, t in rows], DOCS).repartition(5)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()), key=repr)
    assert len(got) == 4 and (None, "q r s t u v") in got and (3, "other words") in got and (3, "") in got
    assert sum(i == 7 for i, _ in got) == 1


def test_pipeline_keeps_the_order_of_the_mix(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several files at each stage
    try:
        got = [(r["mix_position"], r["doc_id"]) for r in corpus_pipeline.run(spark, sf).select("mix_position", "doc_id").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    kept = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id").isin([i for _, i in got]))
    mixed = corpus_pipeline.mix_sources(spark, kept, sf).select("mix_position", "doc_id").orderBy("mix_position")
    assert got == [(r["mix_position"], r["doc_id"]) for r in mixed.collect()]


def test_pipeline_stages_take_an_empty_table(spark, odd):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), "/root/testdata/sf0.001").count() == 0, name
