"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's rows, in an order given by a hash, form blocks of ``BLOCK_ROWS``.
Of the blocks a source gives from slot 0 on, block j (from 0) is released at
slot floor(j / w) and due before slot ceil((j + 1) / w), where w is the
source's weight as a share of the sources still there; earliest deadline first
among released blocks then keeps each source within less than one block of w
times the slots, after every slot. Weights are never rounded. When a source's
last block is placed, the others start again at slot 0 with their shares of
what is left; every row is scheduled exactly once.

The schedule is a chain, so one task walks over the slots, of which there is
one for ``BLOCK_ROWS`` rows. It keeps only the state before every
``CHUNK``-th slot; the slots themselves are worked out from those states in
parallel. The state holds a few numbers for each source, and a step looks at
each source once, so cost is slots times sources.

Rows are numbered within their source by hash buckets of about
``BUCKET_ROWS`` rows: counts of buckets give each bucket's first number, so a
source with most of the rows is spread over many tasks. Rows are shuffled
once, by bucket; a bucket's slots come to it as one array.

Cases: a null source is a source of its own. Weights of unknown sources, and
weights that are not positive, are ignored; a source without a weight gets the
least of the weights given; without any weights all sources weigh the same.
Null and repeated ids are spread by the other numbers of their rows; rows that
agree in all of them are told apart by no order in particular. Texts are not
looked at. An empty table gives an empty result. Added columns replace columns
of their names; other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, unused

BLOCK_ROWS = 16
CHUNK = 1024
BUCKET_ROWS = 10_000
#: Blocks and buckets up to which their table is broadcast; its rows hold a few numbers each.
SMALL = 200_000
#: Target weights of the registered jobs, a falling series over the numbered sources; no two are alike.
TARGET_WEIGHTS = {f"src{i}": 1 / (1 + i) for i in range(20)}
NUMBERS = ("tinyint", "smallint", "int", "bigint", "date", "timestamp", "boolean")


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def _count(n: Column) -> Column:
    """1 to n as an array."""
    return F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>"))


def _choice(s: Column, weights: Column, blocks: Column) -> Column:
    """The source (from 0) of the next slot: of released blocks the one due first, of equals the first source."""
    n = F.size(weights).cast("long")

    def key(done: Column, i: Column) -> Column:
        gap = s["total"] / weights[i]
        late = F.when(F.floor(done * gap) > s["t"], F.lit(1 << 61)).otherwise(F.lit(0).cast("long"))
        return F.when(s["base"][i] + done < blocks[i], late + F.ceil((done + 1) * gap) * n + i)

    return F.array_min(F.transform(s["done"], key)) % n


def _place(s: Column, i: Column, weights: Column, blocks: Column) -> Column:
    """The state after the next block of source i."""
    done = F.transform(s["done"], lambda x, k: x + F.when(k == i, 1).otherwise(0))

    def after(done: Column) -> Column:
        base = F.zip_with(s["base"], done, lambda a, b: a + b)
        left = F.aggregate(F.zip_with(weights, F.zip_with(base, blocks, lambda a, b: a < b), lambda w, more: F.when(more, w).otherwise(0.0)), F.lit(0.0), lambda a, w: a + w)
        fresh = F.struct(F.transform(done, lambda _: F.lit(0).cast("long")).alias("done"), base.alias("base"), F.lit(0).cast("long").alias("t"), left.alias("total"))
        same = F.struct(done.alias("done"), s["base"].alias("base"), (s["t"] + 1).alias("t"), s["total"].alias("total"))
        return F.when(s["base"][i] + done[i] < blocks[i], same).otherwise(fresh)

    return _let(done, after)


def _start(weights: Column) -> Column:
    zero = F.transform(weights, lambda _: F.lit(0).cast("long"))
    return F.struct(zero.alias("done"), zero.alias("base"), F.lit(0).cast("long").alias("t"), F.aggregate(weights, F.lit(0.0), lambda a, w: a + w).alias("total"))


def _walk(s: Column, slots: Column, weights: Column, blocks: Column) -> Column:
    """The state ``slots`` slots later."""
    return F.aggregate(_count(slots), s, lambda a, _: _let(_choice(a, weights, blocks), lambda i: _place(a, i, weights, blocks)))


def _slots(s: Column, slots: Column, weights: Column, blocks: Column) -> Column:
    """Source and block of each of the next slots."""
    def step(a: Column, _: Column) -> Column:
        def then(i: Column) -> Column:
            got = F.struct(i.cast("int").alias("who"), (a["s"]["base"][i] + a["s"]["done"][i]).alias("block"))
            return F.struct(_place(a["s"], i, weights, blocks).alias("s"), F.concat(a["out"], F.array(got)).alias("out"))

        return _let(_choice(a["s"], weights, blocks), then)

    start = F.struct(s.alias("s"), F.array().cast("array<struct<who:int,block:bigint>>").alias("out"))
    return F.aggregate(_count(slots), start, step, lambda a: a["out"])


def period_schedule(weights: Column) -> Column:
    """One period for an array of whole shares: the source (from 1) of each slot."""
    total = F.aggregate(weights, F.lit(0).cast("long"), lambda a, x: a + x)
    real = F.transform(weights, lambda w: w.cast("double"))
    endless = F.transform(weights, lambda _: F.lit(1 << 60))
    return F.transform(_slots(_start(real), total, real, endless), lambda x: x["who"] + 1)


def schedule(sizes: DataFrame, weights: dict[str, float] | None, chunk: int = CHUNK) -> DataFrame:
    """(source_key, block, slot) for all blocks; ``sizes`` has source_key and blocks, one row a source."""
    spark = sizes.sparkSession
    named = sorted((str(s), float(w)) for s, w in (weights or {}).items() if w > 0)
    rows = sizes.select("source_key", "blocks", F.lit(1.0).alias("w"))
    if named:
        given = spark.createDataFrame(named, "source_key string, w double")
        rows = sizes.join(given, "source_key", "left").select("source_key", "blocks", F.coalesce("w", F.lit(min(w for _, w in named))).alias("w"))
    one = rows.groupBy().agg(F.sort_array(F.collect_list(F.struct("source_key", "blocks", "w"))).alias("all"), F.coalesce(F.sum("blocks"), F.lit(0).cast("long")).alias("n_slots"))
    one = one.select(
        F.transform("all", lambda x: x["source_key"]).alias("keys"), F.transform("all", lambda x: x["blocks"]).alias("blocks"), F.transform("all", lambda x: x["w"]).alias("weights"),
        "n_slots", F.ceil(F.col("n_slots") / chunk).cast("long").alias("n_chunks"),
    )
    w, b = F.col("weights"), F.col("blocks")
    # the walk over all slots, of which only the state before each chunk stays
    seen = F.aggregate(
        _count(F.col("n_chunks")),
        F.struct(_start(w).alias("s"), F.array().cast("array<struct<done:array<bigint>,base:array<bigint>,t:bigint,total:double>>").alias("before")),
        lambda a, c: F.struct(_walk(a["s"], F.when(c < F.col("n_chunks"), F.lit(chunk).cast("long")).otherwise(F.lit(0).cast("long")), w, b).alias("s"), F.concat(a["before"], F.array(a["s"])).alias("before")),
        lambda a: a["before"],
    )
    chunks = cut(one.select("keys", "blocks", "weights", "n_slots", F.posexplode(seen).alias("chunk", "s")))
    long = F.least(F.lit(chunk).cast("long"), F.col("n_slots") - F.col("chunk") * chunk)
    n = max(1, min(chunks.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    slots = chunks.repartition(n, "chunk").select("keys", "chunk", F.posexplode(_slots(F.col("s"), long, w, b)).alias("at", "x"))
    return slots.select(F.col("keys")[F.col("x.who")].alias("source_key"), F.col("x.block").alias("block"), (F.col("chunk").cast("long") * chunk + F.col("at")).alias("slot"))


def interleave(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` with source_block (from 0), mix_slot and mix_position; ordering by the last is the mix.

    ``mix_slot`` is the block's slot of the schedule, ``mix_position`` orders
    rows within it too; positions are not dense where a source's last block is
    short.
    """
    docs = docs.drop("source_block", "mix_slot", "mix_position")
    key, h, b, n, first, r, slots = unused(docs, "source_key", "h", "bucket", "n", "first", "r", "slots")
    n_rows = docs.select(source).count()
    buckets = max(64, -(-n_rows // bucket_rows))
    rows = docs.withColumn(key, F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))).withColumn(h, F.xxhash64(F.lit(13), F.col(doc_id)))
    rows = rows.withColumn(b, F.pmod(F.col(h), F.lit(buckets)))
    counts = cut(rows.groupBy(key, b).agg(F.count(F.lit(1)).alias(n)))
    hot = counts.where(F.col(n) > 4 * bucket_rows).withColumn(n, F.ceil(F.col(n) / bucket_rows))
    if not hot.isEmpty():  # many rows of one id, or of none; such buckets are rows / bucket_rows at most
        others = [F.col(f"`{c}`") for c, t in docs.dtypes if t in NUMBERS and c not in (doc_id, source)]
        rows = rows.join(F.broadcast(hot), [key, b], "left")
        rows = rows.withColumn(b, F.col(b) + F.coalesce(F.pmod(F.xxhash64(F.lit(17), *others), F.col(n)) * buckets, F.lit(0))).drop(n)
        counts = cut(rows.groupBy(key, b).agg(F.count(F.lit(1)).alias(n)))
    before = Window.partitionBy(key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    heads = counts.withColumn(first, F.coalesce(F.sum(n).over(before), F.lit(0).cast("long")))
    sizes = counts.groupBy(F.col(key).alias("source_key")).agg(F.ceil(F.sum(n) / block_rows).cast("long").alias("blocks"))
    placed = schedule(sizes, {f"={s}": w for s, w in (weights or {}).items()})
    # the slots of a bucket's blocks, in their order, as one array
    span = F.sequence(F.floor(F.col(first) / block_rows), F.floor((F.col(first) + F.col(n) - 1) / block_rows))
    wanted = heads.select(F.col(key).alias("source_key"), F.col(b), F.col(first), F.explode(span).alias("block"))
    of = wanted.join(placed, ["source_key", "block"]).groupBy(F.col("source_key").alias(key), b, first)
    of = of.agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "slot"))), lambda x: x["slot"]).alias(slots))
    if n_rows // block_rows + counts.count() <= SMALL:
        of = F.broadcast(of)
    rows = rows.withColumn(r, F.row_number().over(Window.partitionBy(key, b).orderBy(h, doc_id)) - 1).join(of, [key, b])
    rank = F.col(first) + F.col(r)
    block = F.floor(rank / block_rows).cast("long")
    slot = F.col(slots)[(block - F.floor(F.col(first) / block_rows)).cast("int")]
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), block.alias("source_block"), slot.alias("mix_slot"), (slot * block_rows + rank % block_rows).cast("long").alias("mix_position"))
