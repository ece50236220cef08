"""Keyed state against plain loops: batches, restarts, export and resumption."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.streaming import keyed

KEYS = ("a", "b", "c")


def batches(spark, path, seed, n=3):
    """``n`` files in order of time; [(key, value, t)] of each."""
    rng = random.Random(seed)
    out, t = [], 0
    for i in range(n):
        rows = []
        for _ in range(25):
            t += 1
            rows.append((rng.choice(KEYS[: 2 + (i > 0)]), round(rng.random() * 9, 3), t))
        spark.createDataFrame(rng.sample(rows, len(rows)), "k string, x double, t long").coalesce(1).write.mode("append").parquet(str(path))
        out.append(rows)
    return out


def stream(spark, path):
    s = spark.readStream.schema("k string, x double, t long").option("maxFilesPerTrigger", 1).parquet(str(path))
    return s.withColumn("v", F.array("x", (10 - F.col("x"))))


def plain_buffers(rows, capacity, policy, seed):
    held, seen = {}, {}
    for k, x, _ in rows:
        slots, n, v = held.setdefault(k, {}), seen.get(k, 0), [x, 10 - x]
        if n < capacity:
            slot = n
        elif policy == "fifo":
            slot = n % capacity
        elif policy == "random":
            slot = int(hashlib.md5(f"{seed}:{k}:{n}".encode()).hexdigest()[:8], 16) % capacity
        else:
            slot = min(range(capacity), key=lambda s: (sum((a - b) ** 2 for a, b in zip(slots[s][1], v)), s))
        slots[slot], seen[k] = (n, v), n + 1
    return sorted((k, s, n, v) for k, slots in held.items() for s, (n, v) in slots.items())


@pytest.mark.parametrize("policy", ["fifo", "random", "l2"])
def test_buffers_over_batches_and_resumed(spark, tmp_path, policy):
    first, second = batches(spark, tmp_path / "in", 1), batches(spark, tmp_path / "more", 2, 2)
    slots = lambda cp: sorted(tuple(r) for r in keyed.stored(spark, str(cp), "slots").select("k", "slot", "at", "vector").collect())
    out = keyed.run_to_end(keyed.buffers(stream(spark, tmp_path / "in"), "k", "v", ["t"], 4, policy, 7), "update", str(tmp_path / "cp"), str(tmp_path / "out"))
    assert {r["batch"] for r in out.collect()} == {0, 1, 2} and max(r["written"] for r in out.collect()) <= 4
    rows = [r for b in first for r in b]
    assert slots(tmp_path / "cp") == plain_buffers(rows, 4, policy, 7)
    # another stream goes on from the exported state
    initial = keyed.stored(spark, str(tmp_path / "cp"), "slots")
    keyed.run_to_end(keyed.buffers(stream(spark, tmp_path / "more"), "k", "v", ["t"], 4, policy, 7, initial=initial), "update", str(tmp_path / "cp2"), str(tmp_path / "out2"))
    later = [(k, x, 1000 + t) for b in second for k, x, t in b]
    if policy != "fifo":  # at counts from the newest row held, which fifo always has
        assert {r[0] for r in slots(tmp_path / "cp2")} == set(KEYS)
    else:
        assert slots(tmp_path / "cp2") == plain_buffers(rows + later, 4, policy, 7)


def test_delayed_queue_survives_a_restart_and_resumes(spark, tmp_path):
    first, second = batches(spark, tmp_path / "in", 3, 2), None
    q = lambda src, **more: keyed.delayed(stream(spark, src), "k", "x", ["t"], 2, **more)
    keyed.run_to_end(q(tmp_path / "in"), "append", str(tmp_path / "cp"), str(tmp_path / "out"))
    second = batches(spark, tmp_path / "in", 4, 1)  # a restart on the same checkpoint takes what is new
    got = keyed.run_to_end(q(tmp_path / "in"), "append", str(tmp_path / "cp"), str(tmp_path / "out")).collect()
    rows = [r for b in first + second for r in b]
    of = {k: [x for key, x, _ in rows if key == k] for k in KEYS}
    assert sorted((r["k"], r["section"], r["written"]) for r in got) == sorted((k, i, v[i - 2] if i > 1 else None) for k, v in of.items() for i in range(len(v)))
    held = keyed.stored(spark, str(tmp_path / "cp"), "queue")
    assert sorted(tuple(r) for r in held.collect()) == sorted((k, i, v[i]) for k, v in of.items() for i in range(len(v) - 2, len(v)))
    third = batches(spark, tmp_path / "more", 5, 1)[0]
    more = keyed.run_to_end(q(tmp_path / "more", initial=held), "append", str(tmp_path / "cp2"), str(tmp_path / "out2")).collect()
    want = []
    for k, v in of.items():
        every = v + [x for key, x, _ in third if key == k]
        want += [(k, i, every[i - 2]) for i in range(len(v), len(every))]
    assert sorted((r["k"], r["section"], r["written"]) for r in more) == sorted(want)


def test_an_idle_rollout_ends_by_its_timer(spark, tmp_path):
    for rows in ([("a", 1.0, 1), ("a", 2.0, 2), ("b", 3.0, 3)], [("c", 4.0, 4)], [("a", 5.0, 5)]):
        spark.createDataFrame(rows, "k string, x double, t long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    out = keyed.run_to_end(keyed.delayed(stream(spark, tmp_path / "in"), "k", "x", ["t"], 2, idle_ms=1), "append", str(tmp_path / "cp"), str(tmp_path / "out"))
    got = sorted((r["k"], r["batch"], r["section"]) for r in out.collect())
    # a and b end while only c has rows, c while only a has; a begins anew
    assert got == [("a", 0, 0), ("a", 0, 1), ("a", 1, -1), ("a", 2, 0), ("b", 0, 0), ("b", 1, -1), ("c", 1, 0), ("c", 2, -1)]


def test_drift_over_batches(spark, tmp_path):
    rows = [r for b in batches(spark, tmp_path / "in", 8) for r in b]
    out = keyed.run_to_end(keyed.drift(stream(spark, tmp_path / "in"), "k", "v", ["t"], 3, mean_limit=0.5, var_limit=0.5), "update", str(tmp_path / "cp"), str(tmp_path / "out"))
    got = {r["k"]: r for r in keyed.stored(spark, str(tmp_path / "cp"), "running").collect()}
    for k in KEYS:
        v = np.array([[x, 10 - x] for key, x, _ in rows if key == k])
        mean, var, drifts = None, None, 0
        for at in range(0, len(v) - 2, 3):
            m, s = v[at : at + 3].mean(0), v[at : at + 3].var(0)
            if mean is not None:
                drifts += np.linalg.norm(m - mean) > 0.5 and np.linalg.norm(s - var) > 0.5
                m, s = 0.9 * mean + 0.1 * m, 0.9 * var + 0.1 * s
            mean, var = m, s
        assert np.allclose(got[k]["mean"], mean) and np.allclose(got[k]["var"], var) and got[k]["drifts"] == drifts and got[k]["chunks"] == len(v) // 3
    assert out.count() >= 3
    assert keyed.stored(spark, str(tmp_path / "none"), "running", "k string").count() == 0
