"""Histories, memories, buffers and monitors as relations: each state follows from the ordered rows of its key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.drawing import dealt, draw, unit


def history_drop(sizes: tuple[int, ...], window: int, t2v: float, i2v: float, v2v: float, seed: int, *key: Column) -> Column:
    """(kind, dropped): how many of a history's oldest entries a row loses.

    ``t2v`` is the share of rows that lose all and ``i2v``, of the others,
    those that keep the newest entry only; of what is left, ``v2v`` lose the
    part that fills no window and a drawn number of whole windows.
    """
    n = sum(sizes)
    below = lambda share, name: F.lit(share > 0) & (unit(seed, F.lit(name), *key) <= share)
    windows = F.pmod(draw(seed, F.lit("n"), *key), F.lit(n // window + 1))
    kind = F.when(below(t2v, "t"), "t2v").when(below(i2v, "i"), "i2v").when(below(v2v, "v"), "v2v").otherwise("none")
    count = F.when(kind == "t2v", n).when(kind == "i2v", max(0, n - 1)).when(kind == "v2v", n % window + windows * window).otherwise(0)
    return F.struct(kind.alias("kind"), count.cast("long").alias("dropped"))


def tiers_dropped(dropped: Column, sizes: tuple[int, ...]) -> list[Column]:
    """How many entries each tier loses; tiers are given oldest first and lose theirs in that order."""
    before = [sum(sizes[:i]) for i in range(len(sizes))]
    return [F.least(F.greatest(dropped - b, F.lit(0)), F.lit(n)).cast("long") for b, n in zip(before, sizes)]


def zero_first(v: Column, n: Column) -> Column:
    """The first n entries set to zero."""
    return F.transform(v, lambda x, i: F.when(i < n, F.lit(0.0)).otherwise(x))


def noise_blend(v: Column, sigma: Column, noise: Column) -> Column:
    """sigma of the noise and 1 - sigma of the values."""
    return F.zip_with(v, noise, lambda x, z: sigma * z + (1 - sigma) * x)


def corruption(clean: float, most: float, seed: int, *key: Column) -> Column:
    """The noise share a row gets: none for a share ``clean`` of the rows, else anything up to ``most``."""
    return F.when(unit(seed, F.lit("clean"), *key) < clean, F.lit(0.0)).otherwise(unit(seed, F.lit("sigma"), *key) * most)


def _tent(n: int, m: int) -> list[list[float]]:
    """Weights that resample n samples to m with a tent as wide as the coarser grid; each row sums to 1."""
    wide = max(n / m, 1.0)
    rows = [[max(0.0, 1 - abs(j + 0.5 - (i + 0.5) * n / m) / wide) for j in range(n)] for i in range(m)]
    return [[w / sum(r) for w in r] for r in rows]


def blurred(v: Column, h: int, w: int, ratio: float) -> Column:
    """A grid of h rows of w values made smaller by ``ratio`` and then as large as before, bilinear with antialiasing.

    Both ways are linear, so each axis is one small matrix.
    """

    def through(n: int) -> list[list[float]]:
        m = max(1, round(n * ratio))
        down, up = _tent(n, m), _tent(m, n)
        return [[sum(up[i][k] * down[k][j] for k in range(m)) for j in range(n)] for i in range(n)]

    table = lambda rows: F.array(*[F.array(*[F.lit(x) for x in r]) for r in rows])
    whole = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    lines = F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda i: F.slice(v, i * w + 1, w))
    across = F.transform(lines, lambda line: F.transform(table(through(w)), lambda k: whole(line, k)))
    columns = F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda j: F.transform(across, lambda line: F.get(line, j)))
    down = F.transform(table(through(h)), lambda k: F.transform(columns, lambda c: whole(c, k)))
    return F.flatten(down)


def replaced(df: DataFrame, bucket: str, key: str, bad: Column, seed: int = 0) -> DataFrame:
    """(bucket, key, source): bad rows stand for a drawn good row of their own bucket, or for null if it has none; good ones for themselves."""
    rows = df.select(bucket, key, F.coalesce(bad, F.lit(False)).alias("_bad"))
    good = dealt(rows.where("not _bad").select(bucket, key), bucket, key, "_i", "_n")
    sizes = good.groupBy(bucket).agg(F.max("_n").alias("_n"))
    lost = rows.where("_bad").select(bucket, key).join(sizes, bucket, "left").withColumn("_i", F.pmod(draw(seed, F.col(key)), F.col("_n")))
    found = lost.join(good.select(bucket, "_i", F.col(key).alias("source")), [bucket, "_i"], "left").select(bucket, key, "source")
    return found.unionByName(rows.where("not _bad").select(bucket, key, F.col(key).alias("source")))


def queue_states(log: DataFrame, job: str, order: list[str], event: str, worker: str) -> DataFrame:
    """(job, state, worker, attempts) of a work queue from its log of claim, done and failed entries.

    A claim holds only if the job is not claimed at that time, so at most one
    worker has it: claims between a holding one and the next end are refused.
    Ends other than the holder's do not count.
    """
    entries = log.select(job, F.struct(*order, F.col(event).alias("_e"), F.col(worker).alias("_w")).alias("_x"))
    start = F.struct(F.lit("queued").alias("state"), F.lit(None).cast(log.schema[worker].dataType).alias("worker"), F.lit(0).cast("long").alias("attempts"))

    def step(s: Column, x: Column) -> Column:
        takes = (x["_e"] == "claim") & s["state"].isin("queued", "failed")
        ends = x["_e"].isin("done", "failed") & (s["state"] == "claimed") & (s["worker"] == x["_w"])
        took = F.struct(F.lit("claimed").alias("state"), x["_w"].alias("worker"), (s["attempts"] + 1).alias("attempts"))
        end = F.struct(x["_e"].alias("state"), s["worker"].alias("worker"), s["attempts"].alias("attempts"))
        return F.when(takes, took).when(ends, end).otherwise(s)

    each = entries.groupBy(job).agg(F.sort_array(F.collect_list("_x")).alias("_all"))
    return each.select(job, F.aggregate("_all", start, step).alias("s")).select(job, "s.state", "s.worker", "s.attempts")


def work_list(df: DataFrame, group: str, key: str, workers: int) -> DataFrame:
    """(group, key, worker, turn): the rows of each list dealt in turns to its workers."""
    rows = dealt(df.select(group, key), group, key, "_i", "_n")
    return rows.select(group, key, (F.col("_i") % workers).alias("worker"), F.floor(F.col("_i") / workers).alias("turn"))


def buffer_updates(df: DataFrame, step: str, rank: str, key: str, clean: Column, warmup: int, share: float, ranks: int, seed: int = 0) -> DataFrame:
    """(step, rank, key, buffer): which rows enter which rank's buffer.

    Rows that are not clean always do, clean ones if the one draw of their step
    and rank is below ``share``. Up to step ``warmup`` a row enters the buffers
    of all ranks, later that of its own only.
    """
    rows = df.select(step, rank, key, F.coalesce(clean, F.lit(False)).alias("_clean"))
    rows = rows.where(~F.col("_clean") | (unit(seed, F.col(step), F.col(rank)) < share))
    every = F.sequence(F.lit(0), F.lit(ranks - 1)).cast("array<bigint>")
    return rows.select(step, rank, key, F.explode(F.when(F.col(step) <= warmup, every).otherwise(F.array(F.col(rank).cast("long")))).alias("buffer"))


def memory_reads(df: DataFrame, key: str, order: str, value: str, written: Column, gate: float, start: float = 0.0) -> DataFrame:
    """(key, order, memory): what a rollout's memory holds when each entry is read.

    Memory begins anew with each key. A written entry changes it, after its own
    read, to ``gate`` of the old and the rest of the entry.
    """
    entries = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("x"), written.alias("w")))).alias("_all"))
    first = F.struct(F.lit(start).alias("m"), F.array().cast("array<double>").alias("seen"))

    def step(s: Column, e: Column) -> Column:
        new = F.when(e["w"] & e["x"].isNotNull(), s["m"] * gate + e["x"] * (1 - gate)).otherwise(s["m"])
        return F.struct(new.alias("m"), F.concat(s["seen"], F.array(s["m"])).alias("seen"))

    states = entries.select(key, "_all", F.aggregate("_all", first, step)["seen"].alias("_seen"))
    pairs = states.select(key, F.explode(F.arrays_zip(F.col("_all").alias("e"), F.col("_seen").alias("m"))).alias("p"))
    return pairs.select(key, F.col("p.e.o").alias(order), F.col("p.m").alias("memory"))


def rollout(df: DataFrame, key: str, order: str, value: str, section: int = 9, history: int = 19) -> DataFrame:
    """(key, section, n, held, history_sum, section_sum) of a loop that makes whole sections, each from the ``history`` entries before it.

    ``held`` counts the real entries of the history; before them it is padded with zeros.
    """
    past = Window.partitionBy(key).orderBy(order).rowsBetween(-history, -1)
    rows = df.withColumns({"_s": F.floor(F.col(order) / section), "_held": F.count(F.lit(1)).over(past), "_sum": F.coalesce(F.sum(value).over(past), F.lit(0.0))})
    first = F.col(order) % section == 0
    out = rows.groupBy(key, F.col("_s").alias("section")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(first, F.col("_held"))).alias("held"), F.max(F.when(first, F.col("_sum"))).alias("history_sum"), F.sum(value).alias("section_sum")
    )
    return out.where(F.col("n") == section)


def epoch_order(key: Column, epoch: int, seed: int = 0) -> Column:
    """The place of a row in an epoch's order; a loader's position is the last place it handed out."""
    return F.md5(F.concat_ws(":", F.lit(f"{seed}:{epoch}"), key.cast("string")))


def resumed(df: DataFrame, key: str, n: int, epoch: int, after: str | None = None, seed: int = 0) -> DataFrame:
    """The next ``n`` rows of an epoch after a saved place, with their ``place``; no row is counted or skipped over to find them."""
    rows = df.withColumn("place", epoch_order(F.col(key), epoch, seed))
    return (rows if after is None else rows.where(F.col("place") > after)).orderBy("place").limit(n)


def monitor(polls: DataFrame, job: str, time: str, step: str, running: str, last: int, cap: int = 3, gap: int = 1500) -> DataFrame:
    """(job, time, action, fails) of a monitor that resubmits crashed jobs.

    At each poll: done at step ``last``; ok while it runs; give_up after
    ``cap`` resubmissions without progress; wait within ``gap`` seconds of the
    last one; else resubmit. Polls after done or give_up are not answered.
    """
    entries = polls.groupBy(job).agg(F.sort_array(F.collect_list(F.struct(F.col(time).cast("long").alias("t"), F.coalesce(F.col(step), F.lit(0)).cast("long").alias("k"), F.col(running).alias("up")))).alias("_all"))
    made = "array<struct<t:bigint,action:string,fails:bigint>>"
    first = F.struct(F.lit(0).cast("long").alias("fails"), F.lit(-1).cast("long").alias("seen"), F.lit(None).cast("long").alias("sent"), F.lit(False).alias("over"), F.array().cast(made).alias("made"))

    def step_(s: Column, e: Column) -> Column:
        down = (e["k"] < last) & ~e["up"]
        fails = F.when(down, F.when(e["k"] > s["seen"], F.lit(0).cast("long")).otherwise(s["fails"] + 1)).otherwise(s["fails"])
        soon = s["sent"].isNotNull() & (e["t"] - s["sent"] < gap)
        action = F.when(e["k"] >= last, "done").when(e["up"], "ok").when(fails >= cap, "give_up").when(soon, "wait").otherwise("resubmit")
        sends = action == "resubmit"
        entry = F.array(F.struct(e["t"].alias("t"), action.alias("action"), fails.alias("fails")))
        return F.when(s["over"], s).otherwise(
            F.struct(fails.alias("fails"), F.when(sends, e["k"]).otherwise(s["seen"]).alias("seen"), F.when(sends, e["t"]).otherwise(s["sent"]).alias("sent"), action.isin("done", "give_up").alias("over"), F.concat(s["made"], entry).alias("made"))
        )

    answers = entries.select(job, F.explode(F.aggregate("_all", first, step_)["made"]).alias("a"))
    return answers.select(job, F.col("a.t").alias(time), "a.action", "a.fails")


def collated(df: DataFrame, group: list[str], order: str, stacked: list[str], first: list[str] = ()) -> DataFrame:
    """One row a batch: ``stacked`` columns as arrays in the rows' order, the others as the first row has them. A batch is bounded by its size."""
    rows = df.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(order, *stacked, *first))).alias("_all"))
    return rows.select(*group, *[F.col(f"_all.{c}").alias(c) for c in stacked], *[F.get(F.col(f"_all.{c}"), 0).alias(c) for c in first])


def nearest_value(v: Column, centroids: list[list[float]]) -> Column:
    """The centroid nearest to a vector, the first of ties; centroids are few and travel as literals."""
    book = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])
    far = F.transform(book, lambda m: F.aggregate(F.zip_with(v, m, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, d: a + d))
    return F.get(book, (F.array_position(far, F.array_min(far)) - 1).cast("int"))


def canonical_digest(cols: dict[str, Column]) -> Column:
    """SHA-256 of the compact JSON of named columns with sorted keys; nulls are written."""
    return F.sha2(F.to_json(F.struct(*[cols[n].alias(n) for n in sorted(cols)]), {"ignoreNullFields": "false"}), 256)


def normal_vector(n: int, seed: int, *key: Column) -> Column:
    """n standard normal draws."""
    at = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(at, lambda i: F.sqrt(-2 * F.log(1 - unit(seed, F.lit("r"), *key, i))) * F.cos(2 * math.pi * unit(seed, F.lit("a"), *key, i)))
