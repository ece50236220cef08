"""Keyed state of streams, kept by element: buffers, delayed queues, drift.

Each operator is a StatefulProcessor of ``transformWithState``. State is typed
and touched by element: a buffer's slot or a queue's entry is written alone,
not the whole buffer. ``stored`` reads any state variable of a checkpoint as a
table, and an operator started with that table as its ``initial`` state goes on
where the other stopped.

A micro-batch's rows of one key are put in order in the task that has the key;
``maxFilesPerTrigger`` and ``maxBytesPerTrigger`` of the source bound them.
Rows of later batches come after those of earlier ones, whatever their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(order, kind="stable")


class _Buffers(StatefulProcessor):
    def __init__(self, name: str, value: str, order: list[str], capacity: int, policy: str, seed: int, ttl_ms: int | None):
        self.name, self.value, self.order, self.capacity, self.policy, self.seed, self.ttl_ms = name, value, order, capacity, policy, seed, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot int", "at long, vector array<double>", self.ttl_ms)
        self.seen = handle.getValueState("seen", "n long", self.ttl_ms)

    def _slot(self, key, n: int, x: list[float], held: dict[int, list[float]]) -> int:
        if n < self.capacity:
            return n
        if self.policy == "fifo":
            return n % self.capacity
        if self.policy == "random":
            return int(hashlib.md5(f"{self.seed}:{key}:{n}".encode()).hexdigest()[:8], 16) % self.capacity
        return int(np.argmin([sum((a - b) ** 2 for a, b in zip(held[s], x)) for s in range(self.capacity)]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.seen.get()[0] if self.seen.exists() else 0
        # only the nearest vector has to know those held
        held = {k[0]: list(v[1]) for k, v in self.slots.iterator()} if self.policy == "l2" else {}
        changed: dict[int, tuple[int, list[float]]] = {}
        for x in _in_order(rows, self.order)[self.value]:
            x = [float(a) for a in x]
            slot = self._slot(key[0], n, x, held)
            held[slot], changed[slot], n = x, (n, x), n + 1
        for slot, v in changed.items():
            self.slots.updateValue((slot,), v)
        self.seen.update((n,))
        yield pd.DataFrame({self.name: [key[0]], "seen": [n], "size": [min(n, self.capacity)], "written": [len(changed)]})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for slot, at, vector in zip(initialState["slot"], initialState["at"], initialState["vector"]):
            self.slots.updateValue((int(slot),), (int(at), [float(a) for a in vector]))
        self.seen.update((int(initialState["at"].max()) + 1,))


def buffers(stream: DataFrame, key: str, value: str, order: list[str], capacity: int, policy: str = "fifo", seed: int = 0, ttl_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """(key, seen, size, written) after each batch; the vectors themselves are in the state ``slots`` (slot, at, vector).

    A vector that finds ``capacity`` others takes the place of the oldest
    (fifo), of a drawn one (random) or of the nearest, the first of ties (l2).
    ``at`` says how many came before it. Buffers that get nothing for
    ``ttl_ms`` are forgotten. ``initial`` has the key, slot, at and vector.
    """
    if policy not in ("fifo", "random", "l2"):
        raise ValueError(f"no such policy: {policy}")
    kind = dict(stream.dtypes)[key]
    rows = stream.select(key, F.col(value).cast("array<double>").alias(value), *order)
    return rows.groupBy(key).transformWithStateInPandas(
        _Buffers(key, value, order, capacity, policy, seed, ttl_ms), f"{key} {kind}, seen long, size int, written int", "update",
        "None" if ttl_ms is None else "ProcessingTime", None if initial is None else initial.groupBy(key),
    )


class _Delayed(StatefulProcessor):
    def __init__(self, name: str, value: str, order: list[str], delay: int, idle_ms: int | None):
        self.name, self.value, self.order, self.delay, self.idle_ms = name, value, order, delay, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getMapState("queue", "section long", "capture double")
        self.next = handle.getValueState("next", "section long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        k = self.next.get()[0] if self.next.exists() else 0
        fresh: dict[int, float | None] = {}
        out: list[tuple[int, float | None]] = []
        for x in _in_order(rows, self.order)[self.value]:
            fresh[k] = None if pd.isna(x) else float(x)
            due, written = k - self.delay, None
            if due in fresh:  # it came with this batch and never reaches the store
                written = fresh.pop(due)
            elif due >= 0 and self.queue.containsKey((due,)):
                written = self.queue.getValue((due,))[0]
                self.queue.removeKey((due,))
            out.append((k, written))
            k += 1
        for section, x in fresh.items():
            self.queue.updateValue((section,), (x,))
        self.next.update((k,))
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame({self.name: [key[0]] * len(out), "section": [a for a, _ in out], "written": pd.array([b for _, b in out], "Float64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The rollout is over: its queue is forgotten, and the next row of the key is section 0 again."""
        self.queue.clear()
        self.next.clear()
        yield pd.DataFrame({self.name: [key[0]], "section": [-1], "written": pd.array([None], "Float64")})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for section, x in zip(initialState["section"], initialState["capture"]):
            self.queue.updateValue((int(section),), (None if pd.isna(x) else float(x),))
        self.next.update((int(initialState["section"].max()) + 1,))


def delayed(stream: DataFrame, key: str, value: str, order: list[str], delay: int = 2, idle_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """(key, section, written): each key's rows numbered from 0, and the value that leaves the queue at each.

    A section's value is queued and leaves ``delay`` sections later, so the
    first ones write nothing. The queue is the state ``queue`` (section,
    capture). A key without rows for ``idle_ms`` of processing time ends: a
    timer drops its queue and gives a row of section -1. ``initial`` has the key, section and capture.
    """
    kind = dict(stream.dtypes)[key]
    rows = stream.select(key, F.col(value).cast("double").alias(value), *order)
    return rows.groupBy(key).transformWithStateInPandas(
        _Delayed(key, value, order, delay, idle_ms), f"{key} {kind}, section long, written double", "append",
        "None" if idle_ms is None else "ProcessingTime", None if initial is None else initial.groupBy(key),
    )


class _Drift(StatefulProcessor):
    def __init__(self, name: str, value: str, order: list[str], chunk: int, rho: float, mean_limit: float, var_limit: float):
        self.name, self.value, self.order, self.chunk, self.rho, self.mean_limit, self.var_limit = name, value, order, chunk, rho, mean_limit, var_limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.running = handle.getValueState("running", "mean array<double>, var array<double>, drifts long, chunks long")
        self.pending = handle.getListState("pending", "vector array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mean, var, drifts, chunks = self.running.get() if self.running.exists() else (None, None, 0, 0)
        held = [list(v[0]) for v in self.pending.get()] if self.pending.exists() else []
        held += [[float(a) for a in x] for x in _in_order(rows, self.order)[self.value]]
        for at in range(0, len(held) - self.chunk + 1, self.chunk):
            part = np.array(held[at : at + self.chunk])
            m, v = part.mean(axis=0), part.var(axis=0)
            if chunks:
                far = lambda a, b: float(np.sqrt(((a - np.asarray(b)) ** 2).sum()))
                drifts += int(far(m, mean) > self.mean_limit and far(v, var) > self.var_limit)
                m, v = (self.rho * np.asarray(a) + (1 - self.rho) * b for a, b in ((mean, m), (var, v)))
            mean, var, chunks = m.tolist(), v.tolist(), chunks + 1
        rest = held[len(held) // self.chunk * self.chunk :]
        if rest:
            self.pending.put([(x,) for x in rest])
        else:
            self.pending.clear()
        if chunks:
            self.running.update((list(mean), list(var), int(drifts), int(chunks)))
            yield pd.DataFrame({self.name: [key[0]], "mean": [list(mean)], "var": [list(var)], "drifts": [drifts], "chunks": [chunks]})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.running.update(([float(a) for a in r["mean"]], [float(a) for a in r["var"]], int(r["drifts"]), int(r["chunks"])))


def drift(stream: DataFrame, key: str, value: str, order: list[str], chunk: int, rho: float = 0.9, mean_limit: float = 0.15, var_limit: float = 0.15, initial: DataFrame | None = None) -> DataFrame:
    """(key, mean, var, drifts, chunks) after each batch: running mean and variance of each key's chunks of ``chunk`` vectors, and how many chunks drifted.

    A chunk drifts if its mean and its variance both lie farther than their
    limits from the running ones before it; the first chunk starts them. State:
    ``running`` has these columns, ``pending`` the vectors of a chunk that is
    not full yet. ``initial`` is a table of ``running``.
    """
    kind = dict(stream.dtypes)[key]
    rows = stream.select(key, F.col(value).cast("array<double>").alias(value), *order)
    return rows.groupBy(key).transformWithStateInPandas(
        _Drift(key, value, order, chunk, rho, mean_limit, var_limit), f"{key} {kind}, mean array<double>, var array<double>, drifts long, chunks long",
        "update", "None", None if initial is None else initial.groupBy(key),
    )


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet table at ``path``, a folder or one file, as a stream of its files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def run_to_end(out: DataFrame, mode: str, checkpoint: str, path: str) -> DataFrame:
    """Take all input there is, batch by batch, append the rows to the table at ``path`` with their ``batch``, and give that table.

    A batch that is run again after a failure replaces its own part of the table.
    """
    spark = out.sparkSession
    columns = out.columns

    def write(df: DataFrame, batch: int) -> None:
        df.select(*columns).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    # other stores have no state by element, and timers of processing time would ask for empty batches without end
    wanted = {PROVIDER: ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        query = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    schema = out.schema.add("batch", "long")
    return spark.read.schema(schema).option("basePath", path).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def stored(spark: SparkSession, checkpoint: str, variable: str, schema: str | None = None) -> DataFrame:
    """The state variable of a checkpoint as a table: the key, and the variable's own columns.

    ``schema`` is that of the empty table given where no batch has run yet.
    """
    if schema and not _exists(spark, f"{checkpoint}/state/0"):
        return spark.createDataFrame([], schema)
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()
    flat = [F.col("key.*")]
    flat += [F.col(f"{c}.*") for c in ("user_map_key", "user_map_value", "value", "list_element") if c in rows.columns]
    return rows.select(*flat)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
