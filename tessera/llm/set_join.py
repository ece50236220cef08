"""Near-duplicates by likeness of shingle sets, found exactly with prefix filtering.

A text is the set of its five-word sequences (ASCII case folded), as 64-bit
hashes; two texts link at a Jaccard likeness of ``LIKENESS`` or more, and a
text's component is what links reach.

1. *Sets.* Equal sets collapse into one, named by the hash of the set.
2. *Prefixes.* All sets are ordered by one order of the hashes, rare ones
   first. Two sets of the wanted likeness share a hash within their first
   n - ceil(0.8 n) + 1, so only those are dealt by hash. Frequencies come from
   a bounded sample; they steer only the size of the groups, since any one
   order finds every pair.
3. *Stars.* Each group's sets are paired with one of it, and the caller may
   give pairs of close fingerprints to go first with them. What lengths,
   positions and parities allow is verified on the whole sets, and the links
   contracted, so a large group of near copies never expands into all its
   pairs. Parities: of the hashes that fall on each bit, odd or even; each bit
   in which two sets differ takes a hash that only one of them has. Bits grow
   with the set, since few of them say nothing of a long text; the wider of two
   is folded. Grams of one of ``HUBS`` kinds choose the same hub, so that alike
   sets meet the same few hubs, not another one for each gram.
4. *The rest.* Pairs of a group in different components so far are verified the
   same way, groups over ``GROUP_CAP`` in tiles that hold all their pairs. Sets
   bring their parities, folded, into these groups, so that texts that share a
   passage and little else are told apart there and give no pair.

Cases: a null text is an empty set, as is one without words; empty sets equal
each other. Fewer words than a shingle: the whole sequence is the one shingle.
A null id takes part. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, cut, drop_table, lookup, map_groups, release, spool, tiled, tune
from tessera.llm.shingles import fold, hashes

WORDS = 5
#: Jaccard likeness of at least 4/5: nine times the overlap is four times both sizes or more.
LIKENESS = 0.8
SAMPLE = 16384
COMMON = 65536
GROUP_CAP = 4096
#: Bits of the parities of a set, at least; longer sets have two to four for each hash.
PARITY_BITS = 512
#: Bytes of parities that go with a set into the groups of its hashes, at most; wider ones are folded.
CARRIED = 512
HUBS = 4
#: How many of a set's hashes before one tell whether a pair has met already.
BEFORE = 4
#: Bytes of each hash that verification compares; within two sets of 20,000 hashes a false match has a chance of 1 in 2,700.
VERIFIED = 5
#: Bits of the filter that spares texts whose sets are not needed again.
FILTER_BITS = 1 << 22


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word sequences of one text."""
    return np.unique(hashes(text, k))


def _name(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), 43)


def prefix(own: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 hashes of a set, those not in ``common`` (sorted) first."""
    n = len(own)
    if not n:
        return own
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        rank = np.where(common[at] == own, ranks[at], 0)
    return own[np.lexsort((own, rank))][: n - (4 * n + 4) // 5 + 1]


def parities(own: np.ndarray) -> bytes:
    """Whether an odd number of a set's hashes falls on each bit; a power of two of them."""
    width = max(PARITY_BITS, 1 << (2 * len(own)).bit_length())
    odd = np.bincount((own % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two parities differ; no more than hashes that only one of the sets has."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def folded(bits: bytes, width: int) -> np.ndarray:
    """Parities on fewer bits: those of the hashes modulo ``width`` bytes of them."""
    x = np.frombuffer(bits, np.uint64)
    while len(x) * 8 > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


class Folded:
    """The parities of a group's sets, to rule out many of its pairs at once."""

    def __init__(self, bits: list[bytes], sizes: np.ndarray):
        self.sizes, self.width = sizes, np.array([min(CARRIED, len(b)) for b in bits])
        self.row, self.of = np.zeros((len(bits), 4), np.int64), []
        for k in range(4):
            wide = CARRIED >> k
            have = np.flatnonzero(self.width >= wide)
            self.row[have, k] = np.arange(len(have))
            self.of.append(np.stack([folded(bits[i], wide) for i in have]) if len(have) else np.zeros((0, wide // 8), np.uint64))

    def may_link(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of pairs of rows those that differ in no more bits than alike sets can."""
        both, keep = np.minimum(self.width[i], self.width[j]), np.zeros(len(i), bool)
        for k in range(4):
            mine = np.flatnonzero(both == CARRIED >> k)
            for at in range(0, len(mine), 16384):
                s = mine[at : at + 16384]
                bits = np.bitwise_count(self.of[k][self.row[i[s], k]] ^ self.of[k][self.row[j[s], k]]).sum(axis=1, dtype=np.int64)
                keep[s] = 9 * bits <= self.sizes[i[s]] + self.sizes[j[s]]
        return keep


def pack(own: np.ndarray) -> bytes:
    """The low bytes of a set's hashes."""
    return own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :VERIFIED].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // VERIFIED, 8), np.uint8)
    out[:, :VERIFIED] = np.frombuffer(data, np.uint8).reshape(-1, VERIFIED)
    return np.unique(out.reshape(-1).view("<u8"))


def _longs(x: list[int] | np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _may_link(n: Column, pos: Column, m: Column, at: Column) -> Column:
    """Can sets of n and m hashes that share the one at pos and at overlap enough?"""
    return 9 * (F.least(pos, at) + F.least(n - pos, m - at)) >= 4 * (n + m)


def _common(rows: DataFrame, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent hashes of a sample and how many of its texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([_longs(shingles(t))], ["gram"])

    part = F.pmod(F.xxhash64("text_hash", F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * SAMPLE / max(n_rows, 1)) + 1
    seen = rows.where(part).select("text").mapInArrow(run, "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    top = seen.where("n > 3").orderBy(F.desc("n"), "gram").limit(COMMON).collect()
    gram, n = np.array([r["gram"] for r in top], np.int64).view(np.uint64), np.array([r["n"] for r in top], np.int64)
    order = np.argsort(gram)
    return gram[order], n[order]


def _possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (src, dst) whose parities differ in no more bits than alike sets can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [differing(x.as_buffer(), y.as_buffer()) for x, y in zip(b.column(3), b.column(4))]
            keep = pa.array(9 * np.array(bits, np.int64) <= b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["src", "dst"])

    own = sets.groupBy("rep").agg(F.min("n").alias("n"), F.min("bits").alias("bits"))
    a = own.select(F.col("rep").alias("src"), F.col("n").alias("n"), F.col("bits").alias("x"))
    b = own.select(F.col("rep").alias("dst"), F.col("n").alias("m"), F.col("bits").alias("y"))
    both = pairs.join(a, "src").join(b, "dst").select("src", "dst", (F.col("n") + F.col("m")).alias("n"), "x", "y")
    return cut(both.mapInArrow(run, "src long, dst long"))


def _needed(sets: DataFrame, pairs: DataFrame) -> np.ndarray:
    """A filter by text hash: one text of every set that has a pair."""
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("rep")).distinct()
    texts = sets.join(ends, "rep").groupBy("rep").agg(F.min("text_hash").alias("h"))
    bits = texts.select(F.col("h").bitwiseAND(FILTER_BITS - 1).alias("b"))
    maps = bits.groupBy(F.shiftright("b", 15).alias("at")).agg(F.bitmap_construct_agg(F.col("b").bitwiseAND(32767)).alias("map"))
    out = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for r in maps.collect():
        out[r["at"]] = np.frombuffer(r["map"], np.uint8)
    return np.unpackbits(out.reshape(-1), bitorder="little").astype(bool)


def _verify(pairs: DataFrame, sets: DataFrame, rows: DataFrame) -> DataFrame:
    """Those pairs (src, dst) whose whole sets are alike enough."""
    pairs = _possible(pairs, sets)
    release(rows.sparkSession)
    needed = rows.sparkSession.sparkContext.broadcast(_needed(sets, pairs))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            h = b.column(0).to_numpy()
            for i in np.flatnonzero(needed.value[h & (FILTER_BITS - 1)]):
                if h[i] not in done:
                    done.add(h[i])
                    own = shingles(b.column(1)[i].as_py())
                    yield pa.RecordBatch.from_arrays([_longs([_name(own)]), pa.array([pack(own)], pa.binary())], ["rep", "grams"])

    grams, grams_at = spool(rows.select("text_hash", "text").mapInArrow(again, "rep long, grams binary").dropDuplicates(["rep"]))
    release(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = unpack(x.as_buffer()), unpack(y.as_buffer())
                ok.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["src", "dst"])

    a = grams.select(F.col("rep").alias("src"), F.col("grams").alias("x"))
    b = grams.select(F.col("rep").alias("dst"), F.col("grams").alias("y"))
    out = cut(pairs.join(a, "src").join(b, "dst").select("src", "dst", "x", "y").mapInArrow(run, "src long, dst long"))
    drop_table(rows.sparkSession, grams_at)
    release(rows.sparkSession)
    return out


def _close(sets: DataFrame, candidates: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Pairs (src, dst) of sets whose fingerprints are candidates, or equal; one set stands for each fingerprint."""
    fps = cut(sets.groupBy("fp").agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("n_rows")))
    found = candidates(fps.select("fp"), fps.count())
    release(sets.sparkSession)
    a, b = fps.select(F.col("fp").alias("src"), F.col("rep").alias("a")), fps.select(F.col("fp").alias("dst"), F.col("rep").alias("b"))
    same = lookup(sets.select("fp", F.col("rep").alias("a")), fps.select("fp", F.col("rep").alias("b"), "n_rows"), ["fp"], "n_rows")
    return found.join(a, "src").join(b, "dst").select(*_ordered("a", "b")).union(same.where("a <> b").select(*_ordered("a", "b")))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")]


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cap: int = GROUP_CAP, candidates: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """(doc_id, text_hash, component) per row of ``docs``; rows of a component reach each other over links.

    ``candidates`` may name pairs (src, dst) of the sets' SimHashes, given them
    (fp) and their number; such pairs are verified like any other.
    """
    tune(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [hashes(t, WORDS) for t in b.column(2).to_pylist()]
            own = [np.unique(x) for x in whole]
            bits = [parities(x) for x in own]
            short = [folded(x, CARRIED).tobytes() if len(x) > CARRIED else None for x in bits]
            rest = [_longs([fold(x) for x in whole]), _longs([_name(x) for x in own]), pa.array([len(x) for x in own], pa.int64()), pa.array(bits, pa.binary()), pa.array(short, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *rest], ["doc_id", "text_hash", "fp", "rep", "n", "bits", "short"])

    sets = cut(rows.mapInArrow(sign, "doc_id long, text_hash long, fp long, rep long, n long, bits binary, short binary"))
    common = context.broadcast(_common(rows, sets.count()))
    release(docs.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                own = shingles(t)
                first = prefix(own, *common.value)
                m = len(first)
                yield pa.RecordBatch.from_arrays(
                    [_longs(first), _longs(np.full(m, _name(own), np.uint64)), pa.array((np.int64(len(own)) << 32) + np.arange(m))], ["gram", "rep", "place"]
                )

    def several(group: pa.Table) -> pa.Table | None:
        _, at = np.unique(group["rep"].to_numpy(), return_index=True)
        if len(at) > 1:  # only those that lengths and positions let link to another
            place = group["place"].to_numpy()[at]
            n, pos = place >> 32, place & 0xFFFFFFFF
            may = np.zeros(len(at), bool)
            for i in range(0, len(at), 32):
                to = slice(i, i + 32)
                own = np.minimum(pos[to, None], pos) + np.minimum((n - pos)[to, None], n - pos)
                may[to] = (9 * own >= 4 * (n[to, None] + n)).sum(1) > 1
            at = at[may]
        return group.take(pa.array(at)) if len(at) > 1 else None

    schema = "gram long, rep long, place long"
    packed, members_at = spool(map_groups(rows.select("text").mapInArrow(deal, schema), ["gram"], several, schema))
    members = packed.select("gram", "rep", F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND(0xFFFFFFFF).alias("pos"))
    release(docs.sparkSession)

    hubs = members.groupBy("gram").agg(F.min(F.struct(F.xxhash64("rep", F.pmod("gram", F.lit(HUBS))).alias("x"), "rep", "n", "pos")).alias("hub"))
    star = members.join(hubs, "gram").where(F.col("rep") != F.col("hub.rep"))
    star = star.where(_may_link(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos")))
    pairs = star.select(*_ordered("rep", "hub.rep"))
    if candidates:
        pairs = pairs.union(_close(sets, candidates))
    first = _verify(pairs.distinct(), sets, rows)

    reached = connected_components(first, "rep", "root")
    left = members.join(reached, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    split = left.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gram")
    carried = sets.groupBy("rep").agg(F.min(F.coalesce("short", "bits")).alias("bits"))
    left = left.join(split, "gram").select("gram", "rep", "n", "pos", "root")
    before = F.collect_list("gram").over(Window.partitionBy("rep").orderBy("gram").rowsBetween(-BEFORE, -1))
    left, left_at = spool(left.withColumn("before", before).join(carried, "rep").select("gram", "rep", "n", "pos", "root", "bits", "before"))
    drop_table(docs.sparkSession, members_at)
    del members, hubs, star, pairs, split
    release(docs.sparkSession)

    def cross(group: pa.Table) -> pa.Table | None:
        rep, n, pos, root = (group[c].to_numpy() for c in ("rep", "n", "pos", "root"))
        parity = Folded(group["bits"].to_pylist(), n)
        earlier = np.zeros((len(rep), BEFORE), np.int64)
        known = np.zeros((len(rep), BEFORE), bool)
        for k, own in enumerate(group["before"].to_pylist()):
            earlier[k, : len(own)], known[k, : len(own)] = own, True
        src, dst = [], []
        for at in range(0, len(rep), 128):
            to = slice(at, at + 128)
            own = np.minimum(pos[to, None], pos) + np.minimum((n - pos)[to, None], n - pos)
            i, j = np.nonzero((root[to, None] != root) & (9 * own >= 4 * (n[to, None] + n)) & (rep[to, None] < rep))
            i = at + i
            met = np.zeros(len(i), bool)  # these share a hash just before this one, and were a pair there
            for a in range(BEFORE):
                for b in range(BEFORE):
                    met |= (earlier[i, a] == earlier[j, b]) & known[i, a] & known[j, b]
            i, j = i[~met], j[~met]
            keep = parity.may_link(i, j)
            src.append(rep[i[keep]])
            dst.append(rep[j[keep]])
        return pa.table({"src": np.concatenate(src), "dst": np.concatenate(dst)}) if sum(map(len, src)) else None

    dealt = tiled(left, ["gram"], "rep", cap).select("gram", "tile", "rep", "n", "pos", "root", "bits", "before")
    rest = map_groups(dealt, ["gram", "tile"], cross, "src long, dst long").distinct()
    links = first.union(_verify(rest, sets, rows))
    drop_table(docs.sparkSession, left_at)
    found = connected_components(links, "rep", "component")
    return sets.join(found, "rep", "left").select("doc_id", "text_hash", F.coalesce("component", "rep").alias("component"))
