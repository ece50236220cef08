"""SimHash near-duplicates, found exactly with vantage-point trees.

A fingerprint is one bit per position of 64: whether more than half of the
text's shingle hashes set it. Two fingerprints link at Hamming distance 4 or
less. The 64 bits are cut into three blocks; two linked fingerprints differ
by at most one bit in at least one block (three blocks with two or more
differences each would make six). Hamming distance on a block is a metric, so
each block gets a vantage-point tree: a node sends a fingerprint left if its
distance to the vantage point is at most the node's median radius, else right,
and by the triangle inequality a fingerprint within one bit beyond the radius
is also queried against the left shard. Every linked pair thus meets in a leaf
of some tree. Trees are built on a sample, which steers only the balance of
the shards, never which pairs are found; it grows with the fingerprints, one of
``SHARE``, from ``SAMPLE`` to ``SAMPLE_MOST`` (8 MB). Leaves over ``LEAF_CAP``
rows are split into tiles of sub-blocks that hold all their pairs. The deal is
written down once.

Only links of a spanning forest leave a leaf, so groups of near copies never
expand into all their pairs. Distinct fingerprints are compared once; copies
are joined back by fingerprint.

Cases: a null text has no words, like an empty one: fingerprint zero, which
links like any other. Fewer words than a shingle: the whole sequence is the
one shingle. Repeated rows get equal results; a null id takes part but never
names a component unless no other id is there. An empty table gives an empty
result. Other columns are ignored.

``near_copies`` links texts by five-word Jaccard likeness instead, which no
radius of 64 bits stands for: what the trees find is verified on whole shingle
sets, and the links beyond their four bits come from ``set_join``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, cut, drop_table, lookup, map_groups, spool, tiled, tune
from tessera.llm.set_join import components
from tessera.llm.shingles import fold, hashes

MAX_BITS = 4
#: Bit blocks; MAX_BITS // 3 differences at most in the best block.
BLOCKS = (0x00000000001FFFFF, 0x000003FFFFE00000, 0xFFFFFC0000000000)
RADIUS = MAX_BITS // len(BLOCKS)
SAMPLE = 16384
SAMPLE_MOST = 1 << 20
SHARE = 16
LEAF = 1024
LEAF_CAP = 8192


def fingerprint(text: str | None, k: int = 4) -> int:
    """SimHash of one text."""
    return int(fold(hashes(text, k)))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of every whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([fold(hashes(t, k)) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


class VPTree:
    """Vantage-point tree on one bit block; leaves are numbered in order."""

    def __init__(self, sample: np.ndarray, mask: int, depth: int, seed: int = 1):
        self.mask, self.nodes, self.leaves = np.uint64(mask), [], 0
        rng = np.random.default_rng(seed)
        todo = [(sample, depth, None)]
        while todo:
            own, d, into = todo.pop()
            at = len(self.nodes)
            if into is not None:
                self.nodes[into[0]][into[1]] = at
            near = vantage = None
            if d > 0 and len(own) > 8:
                best = -1.0
                for v in own[rng.integers(0, len(own), 4)]:  # the vantage point that splits best
                    dist = np.bitwise_count((own ^ v) & self.mask)
                    for r in np.unique(dist)[:-1]:
                        left, edge = (dist <= r).mean(), ((dist > r) & (dist <= r + RADIUS)).mean()
                        gain = min(left, 1 - left) - 0.5 * edge
                        if gain > best:
                            best, vantage, near, radius = gain, v, dist <= r, r
            if near is None or best <= 0:
                self.nodes.append([self.leaves])
                self.leaves += 1
            else:
                self.nodes.append([None, None, vantage, int(radius)])
                todo += [(own[near], d - 1, (at, 0)), (own[~near], d - 1, (at, 1))]

    def assign(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf a fingerprint is stored in or queried against."""
        rows, leaves = [], []
        todo = [(0, np.arange(len(fps)))]
        while todo:
            at, own = todo.pop()
            node = self.nodes[at]
            if not len(own):
                continue
            if len(node) == 1:
                rows.append(own)
                leaves.append(np.full(len(own), node[0], np.int64))
                continue
            dist = np.bitwise_count((fps[own] ^ node[2]) & self.mask)
            todo += [(node[0], own[dist <= node[3] + RADIUS]), (node[1], own[dist > node[3]])]
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, int), np.zeros(0, np.int64))


def leaf_links(fps: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one leaf: (member, root) indices."""
    n = len(fps)
    busy = np.zeros(n, bool)
    for at in range(0, n, 128):
        near = np.bitwise_count(fps[at : at + 128, None] ^ fps[None, at:]) <= bits
        near[np.arange(near.shape[0]), np.arange(near.shape[0])] = False
        busy[at : at + 128] |= near.any(1)
        busy[at:] |= near.any(0)
    left = np.flatnonzero(busy)
    member, root = [], []
    while len(left):
        seed, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for at in range(0, len(front), 128):
                hit |= (np.bitwise_count(fps[front[at : at + 128], None] ^ fps[None, left]) <= bits).any(0)
            front, left = left[hit], left[~hit]
            member.append(front)
            root.append(np.full(len(front), seed))
    return (np.concatenate(member), np.concatenate(root)) if member else (np.zeros(0, int), np.zeros(0, int))


def links(distinct: DataFrame, n_distinct: int, sample_rows: int | None = None, leaf: int = LEAF, cap: int = LEAF_CAP) -> DataFrame:
    """Links (src, dst) that connect exactly what all pairs within MAX_BITS connect."""
    sample_rows = sample_rows or min(SAMPLE_MOST, max(SAMPLE, n_distinct // SHARE))
    picked = [r[0] for r in distinct.orderBy(F.xxhash64("fp", F.lit(11)), "fp").limit(sample_rows).collect()]
    sample = np.array(picked, np.int64).view(np.uint64)
    depth = int(np.ceil(np.log(max(1, n_distinct / leaf)) / np.log(1.7)))
    trees = [VPTree(sample, m, depth, i) for i, m in enumerate(BLOCKS)]
    shared = distinct.sparkSession.sparkContext.broadcast(trees)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy().view(np.uint64)
            for i, tree in enumerate(shared.value):
                rows, leaves = tree.assign(own)
                for at in range(0, len(rows), 65536):
                    r, x = rows[at : at + 65536], leaves[at : at + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array(x * 4 + i), pa.array(own[r].view(np.int64))], ["leaf", "fp"])

    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves, leaves_at = spool(distinct.select("fp").repartition(parts, "fp").mapInArrow(deal, "leaf long, fp long"))
    dealt = tiled(leaves, ["leaf"], "fp", cap)

    def link(group: pa.Table) -> pa.Table | None:
        own = group["fp"].to_numpy()
        member, root = leaf_links(own.view(np.uint64))
        return pa.table({"src": own[member], "dst": own[root]}) if len(member) else None

    found = cut(map_groups(dealt.select("leaf", "tile", "fp"), ["leaf", "tile"], link, "src long, dst long"))
    drop_table(distinct.sparkSession, leaves_at)
    return found


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``; component_id is the smallest doc_id reachable."""
    tune(docs.sparkSession)
    fps = cut(fingerprints(docs, doc_id, text, k))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    found = connected_components(links(distinct, distinct.count()), "fp", "root")
    own = cut(distinct.join(found, "fp", "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root")))
    least = own.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("size"))
    by_fp = lookup(own, least, ["root"], "size").select("fp", "n", "component_id")
    return lookup(fps, by_fp, ["fp"], "n").select("doc_id", "fp", "component_id")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, component) per row of ``docs``: whole texts of five-word likeness of 0.8 or more link."""
    return components(docs, doc_id, text, candidates=links)
