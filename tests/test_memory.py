"""Cases of histories, memories, buffers, queues, monitors, suites and the sinks beside them."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import memory
from tessera.plans import suite
from tessera.sources import files
from tessera.streaming import state


def test_history_drop(spark):
    rows = spark.range(4000)
    got = rows.select(memory.history_drop((16, 2, 1), 9, 0.25, 0.2, 0.5, 1, F.col("id")).alias("d")).select("d.*").collect()
    kinds = {k: [r["dropped"] for r in got if r["kind"] == k] for k in ("t2v", "i2v", "v2v", "none")}
    assert set(kinds["t2v"]) == {19} and set(kinds["i2v"]) == {18} and set(kinds["v2v"]) == {1, 10, 19} and set(kinds["none"]) == {0}
    assert abs(len(kinds["t2v"]) - 1000) < 120 and abs(len(kinds["i2v"]) - 600) < 100 and abs(len(kinds["v2v"]) - 1200) < 130
    off = rows.select(memory.history_drop((16, 2, 1), 9, 0, 0, 0, 1, F.col("id")).alias("d")).where("d.dropped > 0")
    assert off.count() == 0
    for n, want in ((0, [0, 0, 0]), (10, [10, 0, 0]), (17, [16, 1, 0]), (19, [16, 2, 1])):
        assert list(spark.range(1).select(*memory.tiers_dropped(F.lit(n), (16, 2, 1))).first()) == want


def _resample(x: np.ndarray, m: int) -> np.ndarray:
    """Bilinear with antialiasing along the first axis, from its definition."""
    n = len(x)
    scale = max(n / m, 1.0)
    out = []
    for i in range(m):
        center = (i + 0.5) * n / m
        lo, hi = max(int(center - scale + 0.5), 0), min(int(center + scale + 0.5), n)
        w = np.array([max(0.0, 1 - abs((j - center + 0.5) / scale)) for j in range(lo, hi)])
        out.append((w / w.sum()) @ x[lo:hi])
    return np.array(out)


@pytest.mark.parametrize("h, w, ratio", [(8, 8, 0.9), (6, 10, 0.5), (3, 4, 0.1), (5, 5, 1.0)])
def test_blurred(spark, h, w, ratio):
    x = np.random.default_rng(h * w).normal(size=(h, w))
    small = _resample(_resample(x, max(1, round(h * ratio))).T, max(1, round(w * ratio))).T
    want = _resample(_resample(small, h).T, w).T
    df = spark.createDataFrame([(x.reshape(-1).tolist(),)], "v array<double>")
    got = df.select(memory.blurred(F.col("v"), h, w, ratio)).first()[0]
    assert np.allclose(got, want.reshape(-1))
    if ratio == 1:
        assert np.allclose(got, x.reshape(-1))


def test_replaced_stays_in_its_bucket(spark):
    rows = [("a", i, i % 3 == 0) for i in range(60)] + [("b", 100, True), ("c", 200, None)]
    got = memory.replaced(spark.createDataFrame(rows, "b string, k int, bad boolean"), "b", "k", F.col("bad")).collect()
    assert len(got) == 62 and {r["k"]: r["source"] for r in got if r["b"] != "a"} == {100: None, 200: 200}
    assert all(r["source"] % 3 and r["source"] < 60 and (r["source"] == r["k"] or r["k"] % 3 == 0) for r in got if r["b"] == "a")


def test_one_worker_holds_a_job(spark):
    log = [("a", 1, "claim", 1), ("a", 2, "claim", 2), ("a", 3, "done", 2), ("a", 4, "failed", 1), ("a", 5, "claim", 2), ("a", 6, "done", 2), ("a", 7, "claim", 1), ("b", 1, "done", 1)]
    got = memory.queue_states(spark.createDataFrame(log, "j string, t int, e string, w int"), "j", ["t"], "e", "w").collect()
    assert sorted(map(tuple, got)) == [("a", "done", 2, 2), ("b", "queued", None, 0)]


def test_buffer_updates(spark):
    df = spark.createDataFrame([(s, r, 10 * s + r, r == 1) for s in range(40) for r in range(2)], "s int, r int, k int, clean boolean")
    got = memory.buffer_updates(df, "s", "r", "k", F.col("clean"), 9, 0.5, 2).collect()
    plain = [x for x in got if x["r"] == 0]
    assert len(plain) == 10 * 2 + 30 and all(x["buffer"] == 0 for x in plain if x["s"] > 9)
    clean = {x["s"] for x in got if x["r"] == 1}
    assert 10 < len(clean) < 30 and all(sum(x["s"] == s and x["r"] == 1 for x in got) == (2 if s <= 9 else 1) for s in clean)


def test_memory_is_read_before_it_is_written(spark):
    df = spark.createDataFrame([("a", i, float(i), i in (1, 3)) for i in range(5)] + [("b", 0, 8.0, True), ("b", 1, None, True), ("b", 2, 1.0, None)], "k string, i int, x double, w boolean")
    got = memory.memory_reads(df, "k", "i", "x", F.col("w"), 0.5).orderBy("k", "i").collect()
    assert [r["memory"] for r in got] == [0, 0, 0.5, 0.5, 1.75, 0, 4, 4]


def test_monitor(spark):
    polls = [(0, 5, False), (300, 5, True), (2000, 5, False), (2300, 5, False), (4000, 9, False), (6000, 9, False), (8000, 9, False), (10000, 9, False), (12000, 99, True)]
    df = spark.createDataFrame([("a", *p) for p in polls] + [("b", 1, 100, False), ("b", 2, 0, False), ("c", 1, None, False)], "j string, t long, k long, up boolean")
    got = memory.monitor(df, "j", "t", "k", "up", 100).orderBy("j", "t").collect()
    assert [r["action"] for r in got if r["j"] == "a"] == ["resubmit", "ok", "resubmit", "wait", "resubmit", "resubmit", "resubmit", "give_up"]
    assert [r["action"] for r in got if r["j"] == "b"] == ["done"] and [r["action"] for r in got if r["j"] == "c"] == ["resubmit"]


def test_epochs_resume(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    whole = [r["k"] for r in memory.resumed(df, "k", 500, 2).collect()]
    seen, place = [], None
    for n in (7, 100, 393, 5):
        part = memory.resumed(df, "k", n, 2, place).collect()
        seen += [r["k"] for r in part]
        place = part[-1]["place"] if part else place
    assert seen == whole and sorted(seen) == list(range(500)) and whole != [r["k"] for r in memory.resumed(df, "k", 500, 3).collect()]


def test_digest_does_not_depend_on_order(spark):
    cols = {"b": F.lit(None).cast("string"), "a": F.lit("é\""), "c": F.lit(2)}
    got = spark.range(1).select(memory.canonical_digest(cols), memory.canonical_digest(dict(sorted(cols.items())))).first()
    text = json.dumps({"a": "é\"", "b": None, "c": 2}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got[0] == got[1] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("policy", ["fifo", "random", "l2"])
def test_buffers_by_policy(spark, tmp_path, policy):
    x = np.random.default_rng(3).normal(size=(3, 10, 2))
    for b in range(3):
        spark.createDataFrame([("a", 10 * b + i, x[b, i].tolist()) for i in range(10)], "k string, o int, v array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, o int, v array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = state.bounded_buffers(stream, "k", "v", "o", 4, policy).writeStream.outputMode("update").format("memory").queryName(f"b_{policy}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = max(spark.table(f"b_{policy}").collect(), key=lambda r: r["seen"])
    held = []
    for seen, v in enumerate(x.reshape(-1, 2)):
        if len(held) < 4:
            held.append(v)
        elif policy == "fifo":
            held = held[1:] + [v]
        elif policy == "random":
            held[int(hashlib.md5(f"0:a:{seen}".encode()).hexdigest()[:8], 16) % 4] = v
        else:
            held[min(range(4), key=lambda i: np.linalg.norm(held[i] - v))] = v
    assert got["seen"] == 30 and got["size"] == 4 and np.allclose(got["buffer"], held)
    with pytest.raises(ValueError, match="no such policy"):
        state.bounded_buffers(stream, "k", "v", "o", 4, "newest")


def test_results_are_appended_until_good(spark, tmp_path):
    records, path, tried = spark.range(6).withColumnRenamed("id", "k"), str(tmp_path / "out"), []

    def work(todo):
        tried.append(sorted(r["k"] for r in todo.collect()))
        bad = F.when(F.col("k") % 2 == 0, F.lit("failed")) if len(tried) == 1 else F.lit("")
        return todo.select("k", bad.alias("error"))

    for want in (3, 6, 6):
        assert files.append_results(records, path, "k", work, "k long, error string").count() == want
    assert tried == [list(range(6)), [0, 2, 4], []]


def test_sinks(spark, tmp_path):
    points = spark.createDataFrame([(2, "loss", 0.5), (1, "loss", 1.0), (1, "lr", None)], "step int, metric string, value double")
    for _ in range(2):
        files.write_scalars(points, str(tmp_path / "s"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "s")).select("step", "metric", "value").collect())) == [(1, "loss", 1.0), (2, "loss", 0.5)]
    files.write_sheets(spark.createDataFrame([(0.12345, "m"), (None, "n")], "score double, model string"), ["model"], ["score"], str(tmp_path / "x"))
    read = lambda name: sorted((tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "x" / name)).collect()), key=repr)
    assert read("raw") == [("m", "0.12345"), ("n", None)] and read("shown") == [("m", "12.35%"), ("n", None)]
    view = files.replicated_view(spark.createDataFrame([("a", "/d/a"), ("b", "/d/b"), ("c", "/d/c")], "n string, p string"), "n", "p", {"a": 3, "c": 0}, "/v/")
    assert sorted(r["view_path"] for r in view.collect()) == ["/v/a", "/v/a__rep1", "/v/a__rep2", "/v/b"]


def test_suite_and_preflight(tmp_path):
    ran = []
    steps = [{"name": "one", "kind": "job", "args": {"to": "{root}/x", "rest": "{other}"}}, {"kind": "job", "enabled": False}, {"name": "off", "kind": "absent", "enabled": False}]
    jobs = {"job": lambda **k: ran.append(k)}
    assert suite.run_steps(steps, {"root": "/r"}, jobs, dry_run=True) == [("one", "planned"), ("job", "disabled"), ("off", "disabled")] and not ran
    assert suite.run_steps(steps, {"root": "/r"}, jobs)[0] == ("one", "done") and ran == [{"to": "/r/x", "rest": "{other}"}]
    with pytest.raises(ValueError, match="absent"):
        suite.run_steps([steps[0], {"kind": "absent"}], {}, jobs)
    assert len(ran) == 1
    f = tmp_path / "f"
    f.write_bytes(b"abc")
    good = hashlib.sha256(b"abc").hexdigest()
    assert suite.preflight(["json"], {str(f): good.upper()}) == []
    assert len(suite.preflight(["no_such_package"], {str(f): "0" * 64, str(tmp_path / "g"): None})) == 3


def test_newest_steps_outlive_a_restart(spark, tmp_path):
    seen, path = [], str(tmp_path / "done")
    batch = lambda *steps: spark.createDataFrame([(s,) for s in steps], "s long")
    take = lambda rows, top: seen.append((top, rows.count()))

    def fail(rows, top):
        raise RuntimeError("lost")

    first = state.newest_only(take, "s", path)
    first(batch(1, 3, 3, 2), 0)
    first(batch(3, 2), 1)
    with pytest.raises(RuntimeError):
        state.newest_only(fail, "s", path)(batch(7), 2)
    again = state.newest_only(take, "s", path)
    again(batch(3), 2)
    again(batch(7), 3)
    again(batch(), 4)
    assert seen == [(3, 2), (7, 1)]


def test_scorer_gets_batches(spark):
    def scorer(f):
        if (f["x"] < 0).any():
            raise ValueError("below zero")
        return {"twice": f["x"] * 2, "rows": [len(f)] * len(f)}

    df = spark.createDataFrame([(i, float(i)) for i in range(6)], "k long, x double").coalesce(1)
    good = state.score(df, scorer, "k", "m").collect()
    assert all(r["metrics"] == {"twice": 2.0 * r["k"], "rows": 6.0} and not r["errors"] for r in good)
    mixed = {r["k"]: r for r in state.score(df.withColumn("x", F.when(F.col("k") == 2, -1.0).otherwise(F.col("x"))), scorer, "k", "m").collect()}
    assert mixed[2]["metrics"] == {} and mixed[2]["errors"] == {"m": "below zero"} and mixed[3]["metrics"]["twice"] == 6 and not mixed[3]["errors"]
    short = state.score(df, lambda f: {"m": [1.0] if len(f) > 1 else []}, "k", "m").collect()
    assert all(r["errors"] == {"m": "a scorer gives one value a row"} for r in short)
