"""Substring dedup: repeated word sequences by prefix-partitioned suffix trees.

0. *Copies.* Of texts that are equal throughout, only one of the smallest
   doc_id goes on; the others lose all words that a window covers.
1. *Anchors.* Each window of 50 words has an anchor, the least hash of its
   13-word sequences. Equal windows have equal anchors, so a window can repeat
   in another document only if its anchor does; one aggregation by anchor
   finds those. About one word in twenty is an anchor. Anchors of very many
   windows are looked up by broadcast, so none gathers its rows in one task.
2. *Suffixes.* The words from a candidate window's start are a suffix cut at
   50 words, written as six symbols in two longs: short hashes of ten words
   each, by which the tree branches, and last the 64-bit hash of all fifty. A
   word's hash is XXH3 of its bytes.
3. *Prefixes.* Suffixes are grouped by their first symbol. Where a group would
   exceed ``GROUP_CAP`` rows, the prefix grows by a symbol, up to the whole
   suffix; what is then still too large are suffixes that are equal throughout,
   and those are dealt to salts. Groups thus fit in memory whatever repeats.
4. *Subtrees.* A group's sorted suffixes become a tree from the root down: the
   children of a node are its leaves by their next symbol. Nodes whose leaves
   are all of one document are not gone into, so only branches that may repeat
   grow. Deep internal nodes, those of 50 words, are what repeats: a leaf under
   a node that holds a smaller doc_id starts a repeated window. Of a salted
   node the leaves with the least doc_id of each salt are settled by one more
   aggregation.
5. Neighbouring leaves of a document under deep nodes join to its maximal
   repeats, spans that no repeated window exceeds; the document loses them.

The last symbol decides what repeats: a sum of all 64 bits of each word's hash
times an odd number for its place. Windows that differ in one word never have
equal sums, unless the two words have equal hashes; others need a chance of one
in 2^64, wherever they differ and whatever parts they share.

Cases: a null text has no words, as an empty one. A null doc_id is larger than
any other: its row loses what others hold and takes nothing from them. Rows
that share a doc_id, or have none, never take words from one another; 64 bits
of their texts tell them apart. Texts under 50 words stay whole. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, drop_table, lookup, maybe_broadcast, release, spool, tune

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WINDOW, BLOCK, GRAM = 50, 10, 13
BLOCKS = WINDOW // BLOCK
SYMBOLS = BLOCKS + 1
#: Bits of the symbols of ten words, and how often the first long is shifted to leave the first ones.
BITS = (24, 10, 10, 10, 10)
SHIFTS = tuple(sum(BITS[d:]) for d in range(1, BLOCKS + 1))
GROUP_CAP = 20_000
#: Bytes of text hashed at a time.
CHUNK = 1 << 21
NO_ID = (1 << 63) - 1

_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64; base is odd."""
    if base not in _POW or len(_POW[base][0]) <= n:
        size = 1 << max(16, n.bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        _POW[base] = (both[0], both[1])
    return _POW[base]


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a polynomial hash over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans(v: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of each v[start:end], alike wherever it stands."""
    up, down = _powers(base, len(v) + 1)
    total = np.zeros(len(v) + 1, np.uint64)
    np.cumsum(v * up[: len(v)], dtype=np.uint64, out=total[1:])
    return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _word_hashes(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH3 of words that stand one after another; each distinct one is hashed once."""
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(letters))]).dictionary_encode()
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)
    return own[words.indices.to_numpy()] if len(own) else own


class Words:
    """Word hashes of several texts and where each text's words begin."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        self.hash = _word_hashes(data[~blank], ends - starts)
        offset = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(starts, offset)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        n = len(starts)
        sizes = np.diff(self.first)
        room = np.concatenate([np.arange(s, 0, -1) for s in sizes]) if n else np.zeros(0, int)
        self.window = np.flatnonzero(room >= WINDOW)  # where a window starts

    def anchors(self) -> np.ndarray:
        """Anchor of each window in ``window``."""
        if not len(self.window):
            return np.zeros(0, np.int64)
        s = np.arange(len(self.hash) - GRAM + 1)
        low = _spans(self.hash, s, s + GRAM, 0x9E3779B97F4A7C15)
        width, have = WINDOW - GRAM + 1, 1
        while have * 2 <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
        return low[self.window].view(np.int64)

    def symbols(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of the suffixes that start at words ``at``, in two longs."""
        s = np.arange(max(0, len(self.hash) - BLOCK + 1))
        ten = _spans(self.hash, s, s + BLOCK, 0xD1B54A32D192ED03)
        x = np.zeros(len(at), np.uint64)
        for i, bits in enumerate(BITS):
            x = (x << np.uint64(bits)) | (ten[at + i * BLOCK] >> np.uint64(64 - bits))
        return x.view(np.int64), _spans(self.hash, at, at + WINDOW, 0xA24BAED4963EE407).view(np.int64)


def symbols_of(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """The symbols again."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    return [(a >> np.uint64(shift)) & np.uint64((1 << bits) - 1) for shift, bits in zip(SHIFTS, BITS)] + [b]


def _chunks(ids: pa.Array, texts: pa.Array, *more: pa.Array) -> Iterator[tuple]:
    """Rows of a batch in runs of about CHUNK bytes."""
    raw = [t.encode() if t else b"" for t in texts.to_pylist()]
    at = size = 0
    for i, t in enumerate(raw):
        size += len(t)
        if size >= CHUNK or i == len(raw) - 1:
            yield (ids[at : i + 1].to_numpy(zero_copy_only=False), raw[at : i + 1], *(m[at : i + 1].to_pylist() for m in more))
            at, size = i + 1, 0


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, texts, row in _chunks(b.column(0), b.column(1), b.column(2)):
            w = Words(texts)
            anchor, doc = w.anchors(), w.doc[w.window]
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            if new.any():
                yield pa.RecordBatch.from_arrays([pa.array(anchor[new]), pa.array(ids[doc[new]]), pa.array(np.array(row, np.int64)[doc[new]])], ["anchor", "doc", "row"])


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, texts, found, row in _chunks(b.column(0), b.column(1), b.column(2), b.column(3)):
            w = Words(texts)
            anchor, doc = w.anchors(), w.doc[w.window]
            keep = np.zeros(len(anchor), bool)
            edge = np.searchsorted(doc, np.arange(len(texts) + 1))
            for i, own in enumerate(found):
                if own:
                    keep[edge[i] : edge[i + 1]] = np.isin(anchor[edge[i] : edge[i + 1]], np.array(own, np.int64))
            at = w.window[keep]
            pos = (at - w.first[w.doc[at]]).astype(np.int32)
            cols = [ids[w.doc[at]], np.array(row, np.int64)[w.doc[at]], pos, *w.symbols(at)]
            for i in range(0, len(at), 16384):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 16384]) for c in cols], ["doc", "row", "pos", "a", "b"])


class SubTree:
    """Suffix tree over one group's sorted suffixes, grown from the root where leaves of two documents meet.

    ``levels`` lists the internal nodes of each depth, in symbols, as
    (parent, first leaf, leaves, least doc); ``leaf`` are the leaves that hang
    under deep nodes, those as deep as the window, and ``node`` their nodes
    there. Leaves in ``keep`` are followed even where no other document is.
    """

    def __init__(self, symbols: list[np.ndarray], doc: np.ndarray, keep: np.ndarray | None = None):
        keep = np.zeros(len(doc), bool) if keep is None else keep
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.leaf, self.node = np.arange(len(doc)), np.zeros(len(doc), np.int64)
        for symbol in symbols:
            if not len(self.leaf):
                break
            own, parent = symbol[self.leaf], self.node
            edge = np.ones(len(own), bool)
            edge[1:] = (own[1:] != own[:-1]) | (parent[1:] != parent[:-1])
            at = np.flatnonzero(edge)
            low, high = np.minimum.reduceat(doc[self.leaf], at), np.maximum.reduceat(doc[self.leaf], at)
            live = (low < high) | np.logical_or.reduceat(keep[self.leaf], at)
            sizes = np.diff(np.append(at, len(own)))
            self.levels.append((parent[at][live], self.leaf[at][live], sizes[live], low[live]))
            under = np.repeat(live, sizes)
            self.leaf, self.node = self.leaf[under], np.repeat(np.cumsum(live) - 1, sizes)[under]

    def deep(self) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, least doc of its deep node)."""
        return self.leaf, self.levels[-1][3][self.node] if len(self.leaf) else self.leaf


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves of each group's subtree that share their deep node; rows come sorted by symbols within a group."""
    keys = ["a", "b"]

    def tree(t: pa.Table) -> pa.RecordBatch | None:
        a, b = (t[k].to_numpy() for k in keys)
        doc, row, pos = (t[k].to_numpy() for k in ("doc", "row", "pos"))
        leaf, least = SubTree(symbols_of(a, b), doc, pos < 0).deep()
        head = (least == doc[leaf]) & (pos[leaf] < 0)
        hit = (least < doc[leaf]) | head
        if not hit.any():
            return None
        leaf, head = leaf[hit], head[hit]
        out = [doc[leaf], row[leaf], pos[leaf] & np.int32(0x7FFFFFFF), head]
        only = [pa.array(x[leaf], mask=~head) for x in (a, b)]
        return pa.RecordBatch.from_arrays([*map(pa.array, out), *only], ["doc", "row", "pos", "head", "a", "b"])

    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        change = np.zeros(t.num_rows, bool)
        for k in keys:
            v = t[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        at = np.flatnonzero(change)
        if not len(at):
            held = t
            continue
        held = t.slice(at[-1])
        if (out := tree(t.slice(0, at[-1]))) is not None:
            yield out
    if held is not None and (out := tree(held)) is not None:
        yield out


def _prefix(d: int):
    """The first d symbols as columns."""
    return [F.shiftrightunsigned("a", SHIFTS[d - 1])] if d <= BLOCKS else [F.col("a"), F.col("b")]


def repeated_windows(docs: DataFrame, cap: int = GROUP_CAP) -> DataFrame:
    """(doc, row, found): of each text the starts of windows of 50 words whose sequence also starts in a
    document of smaller id; -1 stands for all of them.

    ``docs`` has columns doc (no nulls), row (a long that tells texts of one id apart) and text.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # copies
    names = cut(docs.select("doc", "row", F.md5("text").alias("name")))
    first = names.groupBy("name").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = cut(lookup(names, first, ["name"], "n").where("first < doc").select("doc", "row").distinct())
    # anchors
    anchors = docs.select("doc", "text", "row").mapInArrow(_anchor_rows, "anchor long, doc long, row long")
    anchors, anchors_at = spool(anchors.join(copies, ["doc", "row"], "left_anti"))
    twice = anchors.groupBy("anchor").agg(F.min("doc").alias("x"), F.max("doc").alias("y"), F.count(F.lit(1)).alias("n")).where("x < y").select("anchor", "n")
    per_doc = lookup(anchors, twice, ["anchor"], "n").groupBy("doc", "row").agg(F.collect_set("anchor").alias("found"))
    raw, raw_at = spool(docs.join(per_doc, ["doc", "row"]).select("doc", "text", "found", "row").mapInArrow(_suffix_rows, "doc long, row long, pos int, a long, b long"))
    drop_table(spark, anchors_at)
    del anchors, twice, per_doc, names, first
    release(spark)
    # the prefix grows by a symbol where too many suffixes share it; groups over the cap are rows / cap at most
    suffixes, inside, depth, salts = raw, raw, F.lit(1), F.lit(0).cast("long")
    for d in range(1, SYMBOLS + 1):
        keys = [f"_k{d}_{i}" for i in range(len(_prefix(d)))]
        with_keys = lambda t: t.withColumns(dict(zip(keys, _prefix(d))))  # noqa: B023, E731
        big = cut(with_keys(inside).groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_n{d}")).where(F.col(f"_n{d}") > cap))
        n_big = big.count()
        if not n_big:
            break
        big = maybe_broadcast(big, n_big)
        suffixes = with_keys(suffixes).join(big, keys, "left").drop(*keys)
        inside = with_keys(raw).join(big.select(*keys), keys, "left_semi").drop(*keys)
        if d < SYMBOLS:
            depth = F.when(F.col(f"_n{d}").isNotNull(), d + 1).otherwise(depth)
        else:
            salts = F.coalesce(F.ceil(F.col(f"_n{d}") / cap), F.lit(0)).cast("long")
    salted = f"_n{SYMBOLS}" in suffixes.columns
    prefix = F.lit(0).cast("long")
    for d in range(1, SYMBOLS + 1):
        prefix = F.when(depth == d, F.xxhash64(*_prefix(d))).otherwise(prefix)
    salt = F.when(salts > 0, F.pmod(F.xxhash64("doc", "row", "pos"), salts)).otherwise(F.lit(0))
    grouped = suffixes.repartition(n, prefix, salt)
    # the sign of pos marks the suffixes of a salted group
    pos = F.when(salts > 0, F.col("pos").bitwiseOR(F.lit(-1 << 31))).otherwise(F.col("pos")) if salted else F.col("pos")
    grouped = grouped.select("doc", "row", pos.alias("pos"), "a", "b").sortWithinPartitions("a", "b")
    leaves = grouped.mapInArrow(_tree_rows, "doc long, row long, pos int, head boolean, a long, b long")
    found = leaves
    if salted:  # of a node that was dealt to salts, the least document of each salt may still repeat that of another
        leaves = cut(leaves)
        heads = leaves.where("head")
        least = heads.groupBy("a", "b").agg(F.min("doc").alias("least"))
        found = leaves.where("not head").select("doc", "row", "pos").union(heads.join(least, ["a", "b"]).where("least < doc").select("doc", "row", "pos"))
    found = found.groupBy("doc", "row").agg(F.collect_set("pos").alias("found"))
    out = cut(found.union(copies.select("doc", "row", F.array(F.lit(-1)))))
    drop_table(spark, raw_at)
    del raw, inside, suffixes, grouped, leaves, found
    release(spark)
    return out


def _spans_of(n: int, found: list[int] | None) -> list[tuple[int, int]]:
    """Maximal repeats (start, words) of a text of ``n`` words, given where repeated windows start."""
    if not found or n < WINDOW:
        return []
    if found == [-1]:
        return [(0, n)]
    at = np.sort(np.array(found))
    new = np.flatnonzero(np.diff(at, prepend=-WINDOW - 1) > WINDOW)  # else windows meet or overlap
    last = np.append(new[1:] - 1, len(at) - 1)
    return [(int(at[i]), int(at[j] - at[i]) + WINDOW) for i, j in zip(new, last)]


def _keep(text: str | None, found: list[int] | None) -> tuple[int, list[str]]:
    words = WORD.findall(text or "")
    kept, at = [], 0
    for start, size in _spans_of(len(words), found):
        kept += words[at:start]
        at = start + size
    return len(words), kept + words[at:] if at else words


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) per row."""

    def finish(got: list[tuple], spans: list) -> list[pa.Array]:
        return [*_numbers(got), pa.array([" ".join(k) for _, k in got], pa.string())]

    return _removed(docs, doc_id, text, finish, "n_words long, n_removed long, kept_text string")


def remove_repeats_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row, for callers that compare."""

    def finish(got: list[tuple], spans: list) -> list[pa.Array]:
        return [*_numbers(got), pa.array([hashlib.sha256(" ".join(k).encode()).hexdigest() for _, k in got], pa.string())]

    return _removed(docs, doc_id, text, finish, "n_words long, n_removed long, kept_sha256 string")


def maximal_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, n_words): the spans of words that each row loses, counted from 0; other rows give none."""

    def finish(got: list[tuple], spans: list) -> list[pa.Array]:
        return [pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64())])))]

    rows = _removed(docs, doc_id, text, finish, "spans array<struct<start:long,n_words:long>>")
    return rows.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.n_words")


def _numbers(got: list[tuple]) -> list[pa.Array]:
    return [pa.array([n for n, _ in got], pa.int64()), pa.array([n - len(k) for n, k in got], pa.int64())]


def _removed(docs: DataFrame, doc_id: str, text: str, finish, schema: str) -> DataFrame:
    tune(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("row"))
    both = rows.join(repeated_windows(rows), ["doc", "row"], "left")
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            found = b.column(2).to_pylist()
            got = [_keep(t, f) for t, f in zip(b.column(1).to_pylist(), found)]
            spans = [[{"start": x, "n_words": y} for x, y in _spans_of(n, f)] for (n, _), f in zip(got, found)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NO_ID), *finish(got, spans)], names)

    return both.select("doc", "text", "found").mapInArrow(run, "doc_id long, " + schema)
