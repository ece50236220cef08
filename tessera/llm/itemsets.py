"""Closed frequent itemsets of baskets, and the rules within them.

Items in enough baskets get a rank, rare ones first. The class of an item
holds the baskets with it, cut to the items that share enough baskets with it,
equal ones merged with a weight. Class by class, items are tried as
generators: those after the class's item (its post-set) extend it, those
before it (its pre-set) tell duplicates. A generator whose baskets all hold an
earlier item has a closure that another class finds, so it is dropped by that
inclusion test alone and no found itemset is kept for comparison; later items
that hold all its baskets join its closure. The first level is one aggregation
over all baskets. A class of at most ``CLASS_ROWS`` merged baskets is finished
in a task on packed bitmaps, one bit a merged basket; a larger one is split by
one more item, by the same aggregation, until its parts are small. So no task
holds more than ``CLASS_ROWS`` rows of a class, whatever the table's size.

At most ``share`` times the mean basket length items are frequent, and the
frequent pairs are bounded alike, so ranks and cut lists do not grow with the
number of baskets; they are broadcast only after a count.

The rules need supports of itemsets that are not closed. Those are counted in
blocks of ``CLASS_ROWS`` merged baskets of the class of their first item, and
the blocks' counts are added.

Cases: rows with a null basket or item are left out and make no basket;
repeated rows count once; an empty table, or one without frequent items, gives
an empty result; items in every basket are part of every itemset; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import spool

#: Merged baskets of one class that a task takes.
CLASS_ROWS = 20_000
#: Itemsets to be counted that a task takes.
QUERY_ROWS = 20_000
#: Numbers in a table that is broadcast.
BROADCAST_NUMBERS = 1_000_000
#: Parts of a class when it is joined by shuffle.
SALTS = 64


@dataclass
class Baskets:
    """What mining reads: ``items`` (rank, item, support) and ``rows`` (items, w) without the ranks in ``always``."""

    n: int
    least: int
    items: DataFrame
    rows: DataFrame
    always: list[int]

    @property
    def spark(self) -> SparkSession:
        return self.items.sparkSession


def baskets(lines: DataFrame, basket: str, item: str, min_count: int, share: int) -> Baskets:
    """Merged baskets over the items in at least ``min_count`` baskets and one ``share``-th of all."""
    pairs, _ = spool(lines.select(F.col(basket).alias("b"), F.col(item).alias("item")).where("b is not null and item is not null").distinct())
    n = pairs.select("b").distinct().count()
    least = max(min_count, -(-n // share))
    often = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= least)
    often = often.withColumn("rank", F.row_number().over(Window.orderBy("support", "item")).cast("int"))
    items, _ = spool(often.select("rank", "item", "support"))
    always = [r["rank"] for r in items.where(F.col("support") == n).collect()]
    ranks = items.where(F.col("support") < n).select("item", "rank")
    few = items.count() <= BROADCAST_NUMBERS // 2
    ranked = pairs.join(F.broadcast(ranks) if few else ranks, "item")
    sets = ranked.groupBy("b").agg(F.sort_array(F.collect_list("rank")).alias("items"))
    rows, _ = spool(sets.groupBy("items").agg(F.count(F.lit(1)).alias("w")))
    return Baskets(n, least, items, rows, always)


def _cut(parts: DataFrame, lists: DataFrame, keys: list[str], values: str) -> DataFrame:
    """``parts`` with the list of its keys; a hot key's rows are dealt over many tasks."""
    numbers = lists.agg(F.sum(F.size(values) + F.lit(len(keys) + 1))).first()[0] or 0
    if numbers <= BROADCAST_NUMBERS:
        return parts.join(F.broadcast(lists), keys)
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("items"), F.lit(SALTS)).cast("int"))
    spread = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, [*keys, "_salt"]).drop("_salt")


def _generators(rows: DataFrame) -> DataFrame:
    """A row for each merged basket and item after its class's generator ``g``."""
    return rows.select("key", "g", "items", "w", F.explode("items").alias("i")).where("i > g")


def _expand(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(generators: key, i, n, within, shared; merged baskets of those that can grow: key, g, items, w)."""
    tried = _generators(rows)
    both = tried.select("key", "i", "w", F.explode("items").alias("j")).groupBy("key", "i", "j").agg(F.sum("w").alias("m")).where(F.col("m") >= least)
    near = both.groupBy("key", "i").agg(F.max(F.when(F.col("i") == F.col("j"), F.col("m"))).alias("n"), F.collect_list(F.when(F.col("i") != F.col("j"), F.struct("j", "m"))).alias("near"))
    found = near.select(
        "key", "i", "n", F.expr("transform(filter(near, x -> x.m = n), x -> x.j)").alias("within"), F.expr("transform(filter(near, x -> x.m < n), x -> x.j)").alias("shared"),
    ).where("not exists(within, j -> j < i)")
    found, _ = spool(found)
    grow = found.where("exists(shared, j -> j > i)").select("key", "i", "shared")
    kept = _cut(tried.drop("g"), grow, ["key", "i"], "shared").withColumn("items", F.array_intersect("items", "shared")).where("exists(items, j -> j > i)")
    merged = kept.groupBy(F.concat_ws(",", "key", F.col("i").cast("string")).alias("key"), F.col("i").alias("g"), "items").agg(F.sum("w").alias("w"))
    return found, spool(merged)[0]


class Bitmaps:
    """Merged baskets as one packed bitmap an item, and one a binary digit of their weights."""

    def __init__(self, offsets: np.ndarray, values: np.ndarray, weights: np.ndarray):
        n = len(weights)
        self.names, at = np.unique(values, return_inverse=True)
        wide = -(-n // 64) * 64
        flags = np.zeros((len(self.names), wide), bool)
        flags[at, np.repeat(np.arange(n), np.diff(offsets))] = True
        self.bits = np.packbits(flags, axis=1).view(np.uint64)
        digits = np.zeros((int(weights.max()).bit_length(), wide), bool)
        for k in range(len(digits)):
            digits[k, :n] = weights >> k & 1
        self.digits = np.packbits(digits, axis=1).view(np.uint64)

    @classmethod
    def of(cls, t: pa.Table) -> Bitmaps:
        lists = t["items"].combine_chunks()
        return cls(lists.offsets.to_numpy(), lists.values.to_numpy(), t["w"].to_numpy())

    def support(self, bits: np.ndarray) -> np.ndarray:
        """Weight of the baskets in each row of ``bits``."""
        total = np.zeros(len(bits), np.int64)
        for k, digit in enumerate(self.digits):
            total += np.bitwise_count(bits & digit).sum(axis=1, dtype=np.int64) << k
        return total

    def closed(self, g: int, least: int):
        """Closed itemsets of the class with generator ``g``, beyond its own closure: (ranks, support)."""
        first = int(np.searchsorted(self.names, g))
        every = np.arange(len(self.names))
        todo = [((), np.full(self.bits.shape[1], ~np.uint64(0)), every[:first], every[first:])]
        while todo:
            closure, baskets, pre, post = todo.pop()
            narrowed = self.bits[post] & baskets
            support = self.support(narrowed)
            enough = support >= least
            post, narrowed, support = post[enough], narrowed[enough], support[enough]
            for k, i in enumerate(post):
                inside = lambda others, own=narrowed[k]: ~(own & ~self.bits[others]).any(axis=1)
                before, after = np.concatenate([pre, post[:k]]), post[k + 1 :]
                if inside(before).any():
                    continue  # an earlier item is in all its baskets: another generator has this closure
                joins = inside(after)
                grown = (*closure, i, *after[joins])
                yield self.names[list(grown)], int(support[k])
                todo.append((grown, narrowed[k], before, after[~joins]))


def _finish(least: int):
    def run(t: pa.Table) -> pa.Table:
        out = list(Bitmaps.of(t).closed(t["g"][0].as_py(), least))
        return pa.table({"key": pa.array([t["key"][0].as_py()] * len(out), pa.string()), "more": pa.array([x.tolist() for x, _ in out], pa.list_(pa.int32())), "support": pa.array([n for _, n in out], pa.int64())})

    return run


def _closed_ranks(b: Baskets, class_rows: int) -> DataFrame:
    """Every closed itemset as ranks, in their order, and its support."""
    none = F.array().cast("array<int>")
    always = F.array(*map(F.lit, b.always)).cast("array<int>")
    out = b.spark.range(1 if b.always else 0).select(always.alias("ranks"), F.lit(b.n).cast("long").alias("support"))
    rows = b.rows.select(F.lit("").alias("key"), F.lit(0).alias("g"), "items", "w")
    closures = b.spark.range(1).select(F.lit("").alias("key"), always.alias("closure"))
    while not rows.isEmpty():
        found, merged = _expand(rows, b.least)
        own = found.join(closures.select("key", "closure"), "key").select(F.concat_ws(",", "key", F.col("i").cast("string")).alias("key"), F.concat("closure", F.array("i"), "within").alias("closure"), "n")
        closures, _ = spool(own)
        out = out.unionByName(closures.select(F.col("closure").alias("ranks"), F.col("n").alias("support")))
        sizes, _ = spool(merged.groupBy("key").agg(F.count(F.lit(1)).alias("rows")))
        small = sizes.where(F.col("rows") <= class_rows).select("key")
        more = merged.join(small, "key", "left_semi").groupBy("key").applyInArrow(_finish(b.least), "key string, more array<int>, support long")
        out = out.unionByName(more.join(closures.select("key", "closure"), "key").select(F.concat("closure", "more").alias("ranks"), "support"))
        rows = merged.join(sizes.where(F.col("rows") > class_rows).select("key"), "key", "left_semi")
    return out.select(F.sort_array(F.coalesce("ranks", none)).alias("ranks"), "support")


def _count(left: pa.Table, right: pa.Table) -> pa.Table:
    """Support of each itemset (``rest``) of a class among one block of its baskets."""
    rests = left["rest"].to_pylist()
    n = np.zeros(len(rests), np.int64)
    if right.num_rows:
        maps = Bitmaps.of(right)
        at = {int(v): k for k, v in enumerate(maps.names)}
        known = [k for k, r in enumerate(rests) if all(x in at for x in r)]
        for lo in range(0, len(known), 256):
            some = known[lo : lo + 256]
            n[some] = maps.support(np.stack([np.bitwise_and.reduce(maps.bits[[at[x] for x in rests[k]]]) for k in some]))
    return pa.table({"i": left["i"], "rest": left["rest"], "n": pa.array(n)})


def supports(b: Baskets, wanted: DataFrame, class_rows: int = CLASS_ROWS) -> DataFrame:
    """``ranks`` (ascending, without those in every basket) of ``wanted`` with their support ``a``.

    Itemsets are counted in the class of their first item, on bitmaps, block by block.
    """
    wanted = wanted.select("ranks").distinct()
    none, one = wanted.where(F.size("ranks") == 0), wanted.where(F.size("ranks") == 1)
    asked, _ = spool(wanted.where(F.size("ranks") > 1).select(F.col("ranks")[0].alias("i"), F.expr("slice(ranks, 2, size(ranks) - 1)").alias("rest")))
    lists = asked.select("i", F.explode("rest").alias("j")).groupBy("i").agg(F.collect_set("j").alias("asked"))
    rows = b.rows.select("items", "w", F.explode("items").alias("i"))
    rows = _cut(rows, spool(lists)[0], ["i"], "asked").withColumn("items", F.array_intersect("items", "asked")).where(F.size("items") > 0)
    rows, _ = spool(rows.groupBy("i", "items").agg(F.sum("w").alias("w")))
    blocks = lambda df, cap, name: df.groupBy("i").agg(F.ceil(F.count(F.lit(1)) / F.lit(cap)).cast("int").alias(name))
    sizes, _ = spool(blocks(rows, class_rows, "parts").join(blocks(asked, QUERY_ROWS, "lots"), "i"))
    spread = lambda own, other, mine, theirs, by: own.join(sizes, "i").withColumns({mine: F.pmod(F.xxhash64(by), F.col(f"{mine}s")).cast("int"), theirs: F.explode(F.expr(f"sequence(0, {theirs}s - 1)"))}).drop("parts", "lots")
    keys = ["i", "part", "lot"]
    counted = spread(asked, rows, "lot", "part", "rest").groupBy(*keys).cogroup(spread(rows, asked, "part", "lot", "items").groupBy(*keys)).applyInArrow(_count, "i int, rest array<int>, n long")
    many = counted.groupBy("i", "rest").agg(F.sum("n").alias("a")).select(F.concat(F.array("i"), "rest").alias("ranks"), "a")
    single = one.withColumn("rank", F.col("ranks")[0]).join(b.items.select("rank", F.col("support").alias("a")), "rank").select("ranks", "a")
    return many.unionByName(single).unionByName(none.select("ranks", F.lit(b.n).cast("long").alias("a")))


def _named(b: Baskets, found: DataFrame) -> DataFrame:
    """Ranks as items, numerically ascending."""
    one = found.select("ranks", "support", F.explode("ranks").alias("rank")).join(b.items.select("rank", "item"), "rank")
    return one.groupBy("ranks", "support").agg(F.sort_array(F.collect_list("item")).alias("items"))


def closed_itemsets(lines: DataFrame, basket: str = "sale_id", item: str = "item_id", min_count: int = 8, share: int = 2000, class_rows: int = CLASS_ROWS) -> DataFrame:
    """``items`` and ``support`` of every closed itemset in at least ``min_count`` baskets and a ``share``-th of all."""
    b = baskets(lines, basket, item, min_count, share)
    return _named(b, _closed_ranks(b, class_rows)).select("items", "support")


def closed_itemsets_with_rules(
    lines: DataFrame, basket: str = "sale_id", item: str = "item_id", min_count: int = 8, share: int = 2000, percent: int = 10, class_rows: int = CLASS_ROWS
) -> DataFrame:
    """``items``, ``support`` and ``rules`` of every closed itemset.

    A rule takes one item ``c`` from an itemset of two or more: it holds in at
    least ``percent`` of the ``a`` baskets with the others, and more often than
    the ``s`` baskets with ``c`` would make it if it were independent of them.
    ``rules`` is an array of (c, a, s), ascending by c.
    """
    b = baskets(lines, basket, item, min_count, share)
    found, _ = spool(_closed_ranks(b, class_rows))
    always = F.array(*map(F.lit, b.always)).cast("array<int>")
    taken, _ = spool(
        found.where(F.size("ranks") > 1).select("ranks", "support", F.explode("ranks").alias("rank"))
        .withColumn("others", F.array_except(F.array_except("ranks", F.array("rank")), always))
    )
    known = supports(b, taken.select(F.col("others").alias("ranks")), class_rows).withColumnRenamed("ranks", "others")
    priced = taken.join(known, "others").join(b.items.select("rank", F.col("item").alias("c"), F.col("support").alias("s")), "rank")
    holds = priced.where((F.lit(100) * F.col("support") >= F.lit(percent) * F.col("a")) & (F.col("support") * F.lit(b.n) > F.col("a") * F.col("s")))
    rules = holds.groupBy("ranks").agg(F.sort_array(F.collect_list(F.struct("c", "a", "s"))).alias("rules"))
    none = F.array().cast("array<struct<c:bigint,a:bigint,s:bigint>>")
    return _named(b, found).join(rules, "ranks", "left").select("items", "support", F.coalesce("rules", none).alias("rules"))


def digest(found: DataFrame) -> DataFrame:
    """The rows of ``closed_itemsets_with_rules`` as texts and numbers."""
    best = F.expr("array_min(transform(rules, r -> struct(r.a as a, r.c as c)))")["c"]
    return found.select(
        F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), F.size("items").cast("long").alias("n_items"), "support",
        F.size("rules").cast("long").alias("n_rules"), best.alias("best_item"), F.sha2(F.expr("array_join(transform(rules, r -> concat_ws(':', r.c, r.a, r.s)), ';')"), 256).alias("rules_sha256"),
    )
