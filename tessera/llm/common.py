"""Shared pieces of the training-data operators.

Nothing here collects documents, links or components to the driver. Lineage
is cut with ``checkpoint()`` into the folder the cluster names in
``spark.checkpoint.dir``; a folder of our own is used only if that is unset.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python; long texts make larger ones heavy.
ARROW_ROWS = 512
ARROW_BYTES = 8 << 20


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small, since single texts may be very long.

    Both settings are read when a plan runs, so they stay set in the session;
    tighter ones of the caller are left alone.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is set."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget how it was made."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spool(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder, smaller than a checkpoint; (table, path)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that spool() wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """A hint to broadcast ``df`` if its counted ``rows`` of a few numbers each are few."""
    return F.broadcast(df) if rows <= limit else df


def lookup(df: DataFrame, values: DataFrame, keys: list[str], size: str, cap: int = 100_000, how: str = "inner") -> DataFrame:
    """``df`` joined with ``values``, which has one row for each of its ``keys``, however often a key occurs in ``df``.

    The column ``size`` of ``values`` counts the rows of ``df`` with the key.
    Keys of over ``cap`` rows, of which there are at most rows / cap, are
    joined by broadcast if there are at most 100,000 of them, the others by
    shuffle, so no task gets all rows of a frequent key.
    """
    hot = cut(values.where(F.col(size) > cap))
    n = hot.count()
    if not 0 < n <= 100_000:
        return df.join(values.drop(size), keys, how)
    rest = df.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return df.join(F.broadcast(hot.drop(size)), keys).unionByName(rest.join(values.where(F.col(size) <= cap).drop(size), keys, how))


def release(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files and checkpoints of tables no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, node: str = "node", component: str = "component") -> DataFrame:
    """Component of every node that has an edge, by repeated contraction.

    ``edges`` has two long columns ``src`` and ``dst``. In each round a node
    joins its neighbour of least hashed priority; contracted edges that became
    loops or repeats vanish, so the edge table shrinks geometrically even for
    long chains. ``component`` is the smallest node reachable. Null ends and
    loops are ignored; an empty table gives an empty result.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("id"))
    live = edges.where("src is not null and dst is not null and src <> dst").select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    ).distinct()
    live = cut(live)
    steps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.union(live.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        best = both.groupBy("src").agg(F.min(rank(F.col("dst"))).alias("b"))
        step = cut(best.select("src", F.least(F.col("b"), rank(F.col("src")))["id"].alias("to")))
        steps.append(step)
        a = step.select("src", F.col("to").alias("a"))
        b = step.select(F.col("src").alias("dst"), F.col("to").alias("b"))
        live = cut(
            live.join(a, "src").join(b, "dst").where("a <> b")
            .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        )
    if not steps:
        return live.select(F.col("src").alias(node), F.col("dst").alias(component))
    label = steps[0].select(F.col("src").alias(node), F.col("to").alias("at"))
    for step in steps[1:]:
        nxt = step.select(F.col("src").alias("at"), "to")
        label = cut(label)
        nxt = label.groupBy("at").agg(F.count(F.lit(1)).alias("n")).join(nxt, "at")
        label = lookup(label, nxt, ["at"], "n", how="left").select(node, F.coalesce("to", "at").alias("at"))
    label = cut(label)
    least = label.groupBy("at").agg(F.min(node).alias(component), F.count(F.lit(1)).alias("n"))
    return lookup(label, least, ["at"], "n").select(node, component)


def tiled(df: DataFrame, keys: list[str], member: str, cap: int) -> DataFrame:
    """Split groups of over ``cap`` rows into pairs of sub-blocks.

    Adds ``tile`` (part of the group's key from now on) and ``side``: 0 and 1
    for the two sub-blocks of a tile, 2 where the whole sub-block is compared
    with itself. Every pair of a group's rows meets in exactly one tile, no
    task holds more than about ``2 * cap`` rows of a group, and no row drops.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cap)
    sizes = sizes.select(*keys, F.ceil(F.col("_n") / F.lit(cap)).cast("int").alias("_t"))
    own = df.join(sizes, keys, "left").withColumn("_t", F.coalesce("_t", F.lit(1)))
    own = own.withColumn("_i", F.pmod(F.xxhash64(member, F.lit(7)), F.col("_t")).cast("int"))
    own = own.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_t") - 1)))
    return own.select(
        *df.columns,
        (F.least("_i", "_j") * 65536 + F.greatest("_i", "_j")).cast("long").alias("tile"),
        F.when(F.col("_i") == F.col("_j"), 2).when(F.col("_i") < F.col("_j"), 0).otherwise(1).alias("side"),
    )


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table | None], schema: str, parts: int | None = None) -> DataFrame:
    """Run ``fn`` on each group of integer ``keys``, streaming over sorted rows.

    One shuffle by key and a sort; Python keeps one group at a time, so memory
    is that of the largest group. Groups of one row are passed over, because
    they hold no pair.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, *keys).sortWithinPartitions(*keys)

    def split(t: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table | None]:
        change = np.zeros(t.num_rows, bool)
        for k in keys:
            v = t[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        at = np.concatenate([[0], np.flatnonzero(change), [t.num_rows]])
        sizes = np.diff(at)
        done = np.flatnonzero(sizes[: None if last else -1] > 1)
        return [t.slice(at[i], sizes[i]) for i in done], None if last else t.slice(at[-2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            if all(held[0][k][0] == held[-1][k][-1] for k in keys):
                continue  # one group so far
            ready, rest = split(pa.concat_tables(held).combine_chunks(), False)
            held = [rest]
            for g in ready:
                if (out := fn(g)) is not None:
                    yield from out.to_batches()
        if held:
            for g in split(pa.concat_tables(held).combine_chunks(), True)[0]:
                if (out := fn(g)) is not None:
                    yield from out.to_batches()

    return dealt.mapInArrow(run, schema)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` points over links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
