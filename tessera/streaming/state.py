"""Structured Streaming: bounded buffers, averages over streams, watchers, time windows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fifo_buffers(stream: DataFrame, key: str, value: str, capacity: int) -> DataFrame:
    """(key, size, buffer): the last ``capacity`` values of each key after each batch, oldest first.

    State of a key is bounded by the capacity.
    """
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for f in frames:
            held = (held + [float(x) for x in f[value]])[-capacity:]
        state.update((held,))
        yield pd.DataFrame({key: [k[0]], "size": [len(held)], "buffer": [held]})

    rows = stream.select(key, F.col(value).cast("double").alias(value))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, size int, buffer array<double>", "held array<double>", "update", GroupStateTimeout.NoTimeout)


def bounded_buffers(stream: DataFrame, key: str, value: str, order: str, capacity: int, policy: str = "fifo", seed: int = 0) -> DataFrame:
    """(key, size, seen, buffer): each key's vectors after each batch, ``capacity`` at most.

    A vector that finds the buffer full takes the place of the oldest (fifo),
    of a drawn one (random) or of the nearest, the first of ties (l2). Draws
    come from the seed, the key and how many vectors came before, and a batch
    is taken in the order of ``order``, so a batch run again gives the same.
    """
    if policy not in ("fifo", "random", "l2"):
        raise ValueError(f"no such policy: {policy}")
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, seen = (list(map(list, state.get[0])), state.get[1]) if state.exists else ([], 0)
        for x in pd.concat(list(frames)).sort_values(order)[value]:
            x = [float(a) for a in x]
            if len(held) < capacity:
                held.append(x)
            elif policy == "fifo":
                held = held[1:] + [x]
            elif policy == "random":
                held[int(hashlib.md5(f"{seed}:{k[0]}:{seen}".encode()).hexdigest()[:8], 16) % capacity] = x
            else:
                held[int(np.argmin(((np.array(held) - x) ** 2).sum(1)))] = x
            seen += 1
        state.update((held, seen))
        yield pd.DataFrame({key: [k[0]], "size": [len(held)], "seen": [seen], "buffer": [held]})

    rows = stream.select(key, F.col(value).cast("array<double>").alias(value), order)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, size int, seen long, buffer array<array<double>>", "held array<array<double>>, seen long", "update", GroupStateTimeout.NoTimeout)


def moment_drift(stream: DataFrame, key: str, mean: str, var: str, rho: float = 0.9, mean_limit: float = 0.15, var_limit: float = 0.15) -> DataFrame:
    """(key, mean, var, drifts): running means and variances (arrays) after each batch and how many entries drifted so far.

    The rule is that of operators.series.moment_drift: both distances from the running values before the entry exceed
    their limits, and the first entry starts them.
    """
    kind = dict(stream.dtypes)[key]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5
    blend = lambda a, b: [rho * x + (1 - rho) * float(y) for x, y in zip(a, b)]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m, v, drifts = state.get if state.exists else (None, None, 0)
        for f in frames:
            for x, y in zip(f[mean], f[var]):
                if m is None:
                    m, v = [float(a) for a in x], [float(a) for a in y]
                    continue
                drifts += int(far(x, m) > mean_limit and far(y, v) > var_limit)
                m, v = blend(m, x), blend(v, y)
        state.update((list(m), list(v), drifts))
        yield pd.DataFrame({key: [k[0]], "mean": [m], "var": [v], "drifts": [drifts]})

    rows = stream.select(key, F.col(mean).cast("array<double>").alias(mean), F.col(var).cast("array<double>").alias(var))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, mean array<double>, var array<double>, drifts int", "mean array<double>, var array<double>, drifts int", "update", GroupStateTimeout.NoTimeout)


def ema_drift(stream: DataFrame, key: str, value: str, rho: float = 0.9, threshold: float = 0.15) -> DataFrame:
    """(key, ema, drifted): the average after each batch; a value farther from the one before it than the threshold drifts."""
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ema = state.get[0] if state.exists else None
        drifted = False
        for f in frames:
            for x in f[value]:
                drifted = drifted or (ema is not None and abs(x - ema) > threshold)
                ema = float(x) if ema is None else rho * ema + (1 - rho) * float(x)
        state.update((ema,))
        yield pd.DataFrame({key: [k[0]], "ema": [ema], "drifted": [drifted]})

    rows = stream.select(key, F.col(value).cast("double").alias(value))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ema double, drifted boolean", "ema double", "update", GroupStateTimeout.NoTimeout)


def newest_only(process: Callable[[DataFrame, int], None], step: str, path: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: hand on only the rows of the largest step of a batch that is above all before.

    A step counts as done only once ``process`` returned. Done steps are
    appended to the table at ``path``, on shared storage, so that a restart
    goes on from there; without it they are forgotten then.
    """
    done: list[int] = []

    def each(batch: DataFrame, _: int) -> None:
        if not done:
            done.append(_last_step(batch.sparkSession, path) if path else -1)
        top = batch.agg(F.max(step)).first()[0]
        if top is not None and top > done[0]:
            process(batch.where(F.col(step) == top), top)
            if path:
                batch.sparkSession.createDataFrame([(int(top),)], "step long").coalesce(1).write.mode("append").parquet(path)
            done[0] = top

    return each


def _last_step(spark: SparkSession, path: str) -> int:
    spark.createDataFrame([], "step long").write.mode("append").parquet(path)  # there is a table from now on
    top = spark.read.schema("step long").parquet(path).agg(F.max("step")).first()[0]
    return -1 if top is None else top


def tumbling(events: DataFrame, time: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums of tumbling time windows; rows later than ``late`` are dropped. An addition to the inventory."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width), *keys)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    """Session windows of each key. An addition to the inventory."""
    w = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key)
    return w.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def score(rows: DataFrame, scorer: Callable[[pd.DataFrame], dict[str, list[float]]], key: str, name: str) -> DataFrame:
    """Adapter of an external scorer: (key, metrics, errors). A row that fails fills errors and never raises.

    The scorer gets whole batches and gives a value a row for each metric; only
    if a batch fails, or has another number of values, is it scored row by row.
    """
    kind = dict(rows.dtypes)[key]

    def whole(f: pd.DataFrame) -> list[dict[str, float]]:
        got = {k: [float(x) for x in v] for k, v in scorer(f).items()}
        if any(len(v) != len(f) for v in got.values()):
            raise ValueError("a scorer gives one value a row")
        return [{k: v[i] for k, v in got.items()} for i in range(len(f))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            errors: list[dict[str, str]] = [{} for _ in range(len(f))]
            try:
                metrics = whole(f)
            except Exception:  # some row of the batch; which one shows below
                metrics = []
                for i in range(len(f)):
                    try:
                        metrics += whole(f.iloc[i : i + 1])
                    except Exception as e:  # the contract: errors are data
                        metrics.append({})
                        errors[i] = {name: str(e)}
            yield pd.DataFrame({key: f[key], "metrics": metrics, "errors": errors})

    return rows.mapInPandas(run, f"{key} {kind}, metrics map<string,double>, errors map<string,string>")
