"""BPE encoding and decoding with a word-end vocabulary, by contiguous rank arrays.

A text is normalised (NFC, runs of white space to one blank, lower case), cut
into words by the vocabulary's pattern, and each word's UTF-8 bytes are mapped
to the byte alphabet. A word is then encoded with two plain arrays: the
boundaries of its parts and the rank of each adjacent pair. The smallest rank
is found by a scan, its boundary deleted, and the ranks of the two neighbours
refreshed, until no pair has a rank. Distinct words are encoded once per task;
the memo has two generations of bounded size. In words of over ``LONG`` parts
the same merges are taken from a heap of ranked pairs over linked parts, since
scans would cost the square of the length. Texts beyond ASCII are composed and
lower-cased by the library's own normalisers, and words are cut by the pattern
with the library's own letters, numbers and blanks, asked of it once for all
code points: its Unicode tables are not those of Python.

Cases: a null text is encoded like an empty one (no ids, empty decoded text).
Special tokens of the vocabulary that stand in a text are one id each. A long
word takes time by its length times the logarithm of it.
Repeated rows get equal results, other columns are ignored, and an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from tessera.llm.common import tune

#: Words remembered in each of two generations; when the young one is full it becomes the old one.
MEMO_ENTRIES = 150_000
MEMO_CHARS = 64
#: Parts of a word up to which ranks are scanned.
LONG = 512
NO_RANK = 1 << 60
#: Characters that str.split() takes for white space and the pattern does not.
SEPARATORS = regex.compile("[\x1c-\x1f]")
NORMAL = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
RUNS = regex.compile(r"\S+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=8)
def members(kind: str) -> str:
    """The code points that the library takes for ``kind``, a class like ``\\p{L}``, as ranges within brackets."""
    every = [*range(0xD800), *range(0xE000, 0x110000)]
    matched = pre_tokenizers.Split(Regex(f"(?:{kind})+"), "removed", invert=True).pre_tokenize_str("".join(map(chr, every)))
    return "".join(f"\\U{every[a]:08x}-\\U{every[b - 1]:08x}" for _, (a, b) in matched)


def spelt_out(pattern: str) -> str:
    """The pattern with the library's own members in the place of its classes."""
    out, inside = [], False
    for token in re.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, re.S):
        if re.fullmatch(r"\\p\{\w+\}|\\s", token):
            token = members(token) if inside else f"[{members(token)}]"
        elif token in "[]":
            inside = token == "["
        out.append(token)
    return "".join(out)


@lru_cache(maxsize=2)
def word_pattern(path: str) -> str:
    """The vocabulary's pattern of words, spelt out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return spelt_out(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it prints, else the next from U+0100."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


class Memo:
    """Results by text in two generations of bounded size."""

    def __init__(self):
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    def get(self, key: str, make: Callable[[str], tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
        if (got := self.young.get(key)) is None:
            got = self.old.get(key) or make(key)
            if len(self.young) >= MEMO_ENTRIES:
                self.old = dict(self.young)
                self.young.clear()
            if len(key) <= MEMO_CHARS:
                self.young[key] = got
        return got


class WordBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, pattern: str | None = None):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.ranks = {self.ids[a] << 20 | self.ids[b]: i for i, (a, b) in enumerate(model["merges"])}
        self.made = [self.ids[a + b] for a, b in model["merges"]]
        self.inner = [self.ids[c] for c in byte_alphabet()]
        self.final = [self.ids[c + self.end] for c in byte_alphabet()]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) or "(?!)")
        self.words = re.compile(pattern or word_pattern(path))
        self.said = {i: b" " + t.encode() for i, t in self.tokens.items()}
        self.by_word, self.by_run = Memo(), Memo()

    def merge_long(self, parts: list[int]) -> list[int]:
        """The merges of ``merge`` for many parts: of the least rank the leftmost pair, from a heap."""
        rank_of, n = self.ranks.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank_of(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if j >= n or parts[i] < 0 or rank_of(parts[i] << 20 | parts[j]) != rank:
                continue  # one of the two has been merged since
            parts[i], parts[j] = self.made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(parts[i] << 20 | parts[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank_of(parts[h] << 20 | parts[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [p for p in parts if p >= 0]

    def merge(self, parts: list[int]) -> list[int]:
        """Ids of one word after all merges; ``parts`` holds an id per part and shrinks as boundaries go."""
        rank_of, made = self.ranks.get, self.made
        ranks = [rank_of(a << 20 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            parts[i] = made[low]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] << 20 | parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << 20 | parts[i], NO_RANK)
        return parts

    def word_ids(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.final[raw[-1]]
        return self.merge(parts) if len(parts) <= LONG else self.merge_long(parts)

    def encode_word(self, word: str) -> tuple[bytes, bytes]:
        """Ids of a word as little-endian 32-bit integers, and its tokens, each with a blank before it."""
        ids = self.word_ids(word)
        return pack(f"<{len(ids)}I", *ids), b"".join([self.said[i] for i in ids])

    def encode_run(self, run: str) -> tuple[bytes, bytes]:
        """The same of a run without blanks, whose words the pattern finds."""
        words = self.words.findall(run)
        if len(words) == 1:
            return self.by_word.get(words[0], self.encode_word)
        got = [self.by_word.get(w, self.encode_word) for w in words]
        return b"".join([g[0] for g in got]), b"".join([g[1] for g in got])

    @staticmethod
    def normalise(text: str) -> str:
        """NFC and lower case; runs of white space part words alike whether they are replaced or not."""
        return text.lower() if text.isascii() else NORMAL.normalize_str(text)

    def encode_packed(self, text: str) -> tuple[bytes, bytes]:
        """Packed ids and the decoded text of a whole text."""
        ids: list[bytes] = []
        said: list[bytes] = []

        def plain(part: str) -> None:
            known, young, make = self.by_run.get, self.by_run.young, self.encode_run
            part = self.normalise(part)
            runs = RUNS.findall(part) if SEPARATORS.search(part) else part.split()
            got = [young.get(r) or known(r, make) for r in runs]
            if got:
                of_runs, words = zip(*got)
                ids.extend(of_runs)
                said.extend(words)

        at = 0
        for m in self.cut.finditer(text):
            plain(text[at : m.start()])
            ids.append(np.array([self.special[m[0]]], "<u4").tobytes())
            said.append(b" " + m[0].encode())
            at = m.end()
        plain(text[at:])
        return b"".join(ids), b"".join(said)[1:]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text)[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> WordBPE:
    return WordBPE(path, pattern)


def encode_decode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, carry: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded) per row, in the order of the rows; a column of longs to ``carry`` comes last."""
    return _run(docs, doc_id, text, path, False, carry)


def encode_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row, for callers that compare."""
    return _run(docs, doc_id, text, path, True)


def _run(docs: DataFrame, doc_id: str, text: str, path: str | None, digests: bool, carry: str | None = None) -> DataFrame:
    tune(docs.sparkSession)
    path = path or default_vocabulary()
    pattern = word_pattern(path)  # some ten thousand characters, worked out once
    more = [carry] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for b in batches:
            got = [bpe.encode_packed(t or "") for t in b.column(1).to_pylist()]
            n = pa.array([len(i) // 4 for i, _ in got], pa.int64())
            if digests:
                sha = lambda k: pa.array([hashlib.sha256(g[k]).hexdigest() for g in got], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), n, sha(0), sha(1)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                ids = pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in got], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), n, ids, pa.array([d.decode() for _, d in got], pa.string()), *b.columns[2:]], ["doc_id", "n_tokens", "ids", "decoded", *more])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *(F.col(c).cast("long") for c in more))
    last = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return rows.mapInArrow(run, ", ".join([f"doc_id long, n_tokens long, {last}", *(f"{c} long" for c in more)]))
