"""Token counts under a unigram vocabulary, by dynamic programming over a trie.

A text's words, each with the vocabulary's word-begin mark, are pre-tokens. The
distinct ones of a batch that are not yet known are taken in sorted order,
which is a depth-first walk of their trie: the forward scores (best score and
its number of tokens at each depth) of the path are kept, and a word only
computes those beyond the prefix it shares with the word before. Where a word
ends, the count of its best segmentation is stored at the terminal. Texts then
add up terminal counts.

A piece's score is minus the logarithm of its rank in the vocabulary, counted
from two. A character without a piece falls back to one token per UTF-8 byte,
at a score below any piece. Ties prefer fewer tokens.

Cases: a null text has no words, like an empty one. A word of any length costs
time in proportion; only words of up to ``MEMO_CHARS`` are remembered. Rows
that repeat get equal counts; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tune

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARK = "▁"
MEMO_ENTRIES = 400_000
MEMO_CHARS = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class UnigramTrie:
    def __init__(self, pieces: Iterable[tuple[str, float]]):
        self.score = dict(pieces)
        self.longest = max(map(len, self.score), default=1)
        self.fallback = min(self.score.values(), default=0.0) - 10.0
        self.terminal: dict[str, int] = {}

    def count_all(self, words: Iterable[str]) -> dict[str, int]:
        """Tokens of each distinct word; one walk over the trie of all."""
        score, longest, fallback = self.score.get, self.longest, self.fallback
        best: list[float] = [0.0]
        n: list[int] = [0]
        before, out = "", {}
        for word in sorted(words):
            shared = min(len(before), len(word))
            if before[:shared] != word[:shared]:
                shared = len(os.path.commonprefix((before, word)))
            del best[shared + 1 :], n[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                size = len(word[end - 1].encode())
                top, tokens = (best[end - 1] + size * fallback, n[end - 1] + size) if score(word[end - 1]) is None else (-math.inf, 0)
                for start in range(max(0, end - longest), end):
                    if (s := score(word[start:end])) is not None:
                        s += best[start]
                        if s > top or (s == top and n[start] + 1 < tokens):
                            top, tokens = s, n[start] + 1
                best.append(top)
                n.append(tokens)
            out[word] = n[len(word)]
            before = word
        return out

    def counts(self, texts: list[list[str]]) -> list[int]:
        """Tokens of texts given as their words."""
        known = self.terminal
        fresh = {w for words in texts for w in words}.difference(known)
        new = self.count_all(MARK + w for w in fresh)
        new = {w[1:]: c for w, c in new.items()}
        if len(known) + len(new) > MEMO_ENTRIES:
            keep = {w: known[w] for words in texts for w in words if w in known}
            known.clear()
            known.update(keep)
        known.update(new)
        out = [sum(map(known.__getitem__, words)) for words in texts]
        for w in new:
            if len(w) > MEMO_CHARS:
                del known[w]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> UnigramTrie:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return UnigramTrie((sp.id_to_piece(i), -math.log(rank)) for rank, i in enumerate(plain, 2))


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) per row."""
    tune(docs.sparkSession)
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = vocabulary(path)
        for b in batches:
            words = [WORD.findall(t or "") for t in b.column(1).to_pylist()]
            n = pa.array(map(len, words), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(trie.counts(words), pa.int64())], ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
