"""Spelling variants of a vocabulary: words one edit apart, by a trie joined with itself.

Words one inserted, deleted or replaced character apart agree on all letters
before the edit and on all behind it. So the vocabulary is dealt to classes by
the letters outside a window that may hold the edit: of words of ``size`` or
``size + 1`` letters, those with the same first half, whose window is the
second, and those with the same second half, whose window is the first. A
class of more than ``CLASS_WORDS`` words is dealt again by half its window,
until it is small or its window is one letter wide, which some thousand words
at most can share. So prefixes grow with what shares them, and no class is too
large for a task.

In its task a class becomes a trie of its windows, and the trie is joined with
itself: going down from the root, each node keeps the nodes within one edit of
it, worked out from those of its parent. Where node and kept node both end a
word at distance one, the two words are a pair. An edit within a run of equal
letters can be placed in either half; such a pair is taken in the class of the
longer shared prefix only.

Cases: null texts hold no word and a null id deletes no letter; words of any
length take part; rows repeated in the table count as often as they are there;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lookup, map_groups, spool, tune

#: Words of a class that a task takes.
CLASS_WORDS = 4_000
#: Distinct words that a task counts before it passes the counts on.
COUNTED = 200_000

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _misspelt(low: str, doc_id: int | None, every: int) -> str:
    """The run, without one letter if ``every`` divides the checksum of id and run."""
    if doc_id is None or (h := zlib.crc32(f"{doc_id}:{low}".encode())) % every:
        return low
    at = h % len(low)
    return low[:at] + low[at + 1 :]


def vocabulary(docs: DataFrame, least_letters: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """``word`` and ``n`` of the words of whole texts; one in ``every`` runs of letters a document loses a letter."""
    tune(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                runs: Counter[str] = Counter()
                for run, n in Counter(RUN.findall(text)).items():
                    if len(run) >= least_letters:
                        runs[run.translate(LOWER)] += n
                for low, n in runs.items():
                    if len(word := _misspelt(low, doc_id, every)) >= least_letters:
                        total[word] += n
            if len(total) >= COUNTED:
                yield out()
                total.clear()
        yield out()

    rows = docs.select("doc_id", "text").where("text is not null").mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Trie:
    """Strings as paths of letters; ``ends`` has the words at each node."""

    def __init__(self):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]

    def add(self, text: str, word: int) -> None:
        at = 0
        for c in text:
            if (to := self.children[at].get(c)) is None:
                to = self.children[at][c] = len(self.children)
                self.children.append({})
                self.ends.append([])
            at = to
        self.ends[at].append(word)

    def step(self, active: dict[int, int], letter: str) -> dict[int, int]:
        """Nodes within one edit of a node's child, from those of the node."""
        out: dict[int, int] = {}
        for v, d in active.items():
            if d == 0:
                out.setdefault(v, 1)  # the letter is one too many
                for c, w in self.children[v].items():
                    if c == letter:
                        out[w] = 0
                        for x in self.children[w].values():
                            out.setdefault(x, 1)  # a letter is missing
                    else:
                        out.setdefault(w, 1)  # another letter
            elif (w := self.children[v].get(letter)) is not None:
                out.setdefault(w, 1)
        return out

    def pairs(self) -> Iterator[tuple[int, int]]:
        """Words that end at nodes at distance one, the first at the smaller node."""
        todo = [(0, {0: 0, **dict.fromkeys(self.children[0].values(), 1)})]
        while todo:
            node, active = todo.pop()
            if self.ends[node]:
                for other, d in active.items():
                    if d == 1 and node < other:
                        for a in self.ends[node]:
                            for b in self.ends[other]:
                                yield a, b
            for c, child in self.children[node].items():
                todo.append((child, self.step(active, c)))


def _class_pairs(t: pa.Table) -> pa.Table | None:
    """Both directions of each pair of the classes in ``t``, which share a hash and nearly always are one."""
    size, lo, hi = (t[c].to_pylist() for c in ("size", "lo", "hi"))
    words, counts, keys = t["word"].to_pylist(), t["n"].to_pylist(), t["key"].to_pylist()
    tries: dict[str, Trie] = {}
    for k, word in enumerate(words):
        tries.setdefault(keys[k], Trie()).add(word[lo[k] : len(word) - (size[k] - hi[k])], k)
    out = []
    for trie in tries.values():
        for a, b in trie.pairs():
            short, end = size[a], hi[a]
            if len(words[a]) > short < len(words[b]):
                continue  # both are the longer ones: their own class has them
            if end < short and words[a][:end] == words[b][:end]:
                continue  # a class of a longer shared prefix has them
            out += [(words[a], words[b], counts[b]), (words[b], words[a], counts[a])]
    if not out:
        return None
    a, b, n = zip(*out)
    return pa.table({"word": pa.array(a, pa.string()), "near": pa.array(b, pa.string()), "near_n": pa.array(n, pa.int64())})


def near_words(words: DataFrame, class_words: int | None = None) -> DataFrame:
    """Each pair of distinct words at distance one, in both directions: word, near, near_n."""
    tune(words.sparkSession)
    cap = class_words or CLASS_WORDS
    long = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(long - 1, long)).alias("size")).where("size >= 0")
    rows = rows.select("word", "n", "size", F.lit(0).alias("lo"), F.col("size").alias("hi"))
    out = None
    while True:
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct(mid.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), mid.alias("hi")))
        # a window of one letter is not dealt again; its class takes part as it is
        dealt = rows.withColumn("half", F.explode(F.when(F.col("hi") - F.col("lo") > 1, halves).otherwise(F.array(F.struct("lo", "hi")))))
        dealt = dealt.select("word", "n", "size", F.col("half.lo").alias("lo"), F.col("half.hi").alias("hi"))
        key = F.concat_ws(":", "size", "lo", "hi", F.expr("substring(word, 1, lo)"), F.expr("right(word, size - hi)"))
        dealt, _ = spool(dealt.withColumn("key", key))
        sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("words"), F.min(F.char_length("word") - F.col("size")).alias("over"), F.first(F.col("hi") - F.col("lo")).alias("wide"))
        sizes, _ = spool(sizes.where("words > 1 and over = 0").withColumn("again", (F.col("words") > cap) & (F.col("wide") > 1)).drop("over", "wide"))
        known = lookup(dealt, sizes, ["key"], "words", cap)
        ready = map_groups(known.where("not again").drop("again").withColumn("hash", F.xxhash64("key")), ["hash"], _class_pairs, "word string, near string, near_n long")
        out = ready if out is None else out.unionByName(ready)
        if sizes.where("again").isEmpty():
            return out
        rows = known.where("again").select("word", "n", "size", "lo", "hi")


def roots(forms: DataFrame) -> DataFrame:
    """The last word of each word's chain of forms; ``forms`` (word, form) has no cycle."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        at, _ = spool(at)
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if at.join(step, "root", "left_semi").isEmpty():
            return at
        at = at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"))


def variants(words: DataFrame, times: int = 5, class_words: int | None = None) -> DataFrame:
    """Every word with its near words and the form that it is a variant of.

    ``words`` has distinct ``word`` and counts ``n``. ``form`` is the near word
    of largest count (ties: smallest in code-point order), if that is at least
    ``times`` the word's own; ``root`` is where the chain of forms ends, the
    word itself if it has none. A form's count is larger, so chains end.
    """
    words, _ = spool(words.select("word", "n"))
    best = near_words(words, class_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    rows = words.join(best, "word", "left").withColumn("_n", -F.col("best.less"))
    takes = F.col("_n") >= F.lit(times) * F.col("n")
    rows, _ = spool(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.form")).alias("form"), F.when(takes, F.col("_n")).alias("form_n")))
    last = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


__all__ = ["near_words", "roots", "variants", "vocabulary"]
