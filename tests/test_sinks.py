"""Sinks and sources that are whole or absent, under failing and repeated tasks."""

import json
import os
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessera.sources import cache, entities, files, listing
from tessera.streaming import newest


def names(path):
    return sorted(os.listdir(path)) if os.path.isdir(path) else None


def test_a_file_for_each_entity(spark, tmp_path):
    df = spark.createDataFrame([("a/b", 2, "é"), ("a/b", 1, None), ("c", 3, "x,y"), (None, 4, "n")], "k string, n int, s string").repartition(3)
    path = str(tmp_path / "out")
    assert entities.write_entities(df, "k", path)
    assert names(path) == ["a%2Fb.jsonl", "c.jsonl", "null.jsonl"] and names(tmp_path) == ["out"]
    assert [json.loads(x) for x in open(f"{path}/a%2Fb.jsonl")] == [{"n": 1, "s": None}, {"n": 2, "s": "é"}]
    assert not entities.write_entities(df.limit(1), "k", path)  # it is there already
    assert entities.write_entities(df.where("k = 'c'"), "k", path, mode="overwrite") and names(path) == ["c.jsonl"] and names(tmp_path) == ["out"]
    assert entities.write_entities(df, "k", str(tmp_path / "csv"), kind="csv")
    assert open(tmp_path / "csv" / "c.csv").read() == 'n,s\n3,"x,y"\n'
    assert entities.write_entities(df.select("k", "s"), "k", str(tmp_path / "txt"), kind="text") and open(tmp_path / "txt" / "a%2Fb.txt").read() == "\né\n"
    assert entities.write_entities(df.limit(0), "k", str(tmp_path / "none")) and names(tmp_path / "none") == []
    for _ in range(2):
        entities.write_entities(df, "k", str(tmp_path / "more"), mode="append")
    assert entities.read_entities(spark, str(tmp_path / "more"), "n int, s string").count() == 8


def test_a_failing_job_leaves_nothing(spark, tmp_path):
    def broken(frames):
        for f in frames:
            if (f["n"] == 77).any():
                time.sleep(1)  # others have written by then
                raise ValueError("no row 77")
            yield f

    df = spark.range(100).select((F.col("id") % 9).alias("k"), F.col("id").cast("int").alias("n"))
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="no row 77"):
        entities.write_entities(df.repartition(4).mapInPandas(broken, "k long, n int"), "k", path)
    assert names(tmp_path) == []
    # a folder that was there stays as it was
    entities.write_entities(df.where("k = 1"), "k", path)
    with pytest.raises(Exception, match="no row 77"):
        entities.write_entities(df.repartition(4).mapInPandas(broken, "k long, n int"), "k", path, mode="overwrite")
    assert names(path) == ["1.jsonl"] and names(tmp_path) == ["out"]


def test_a_broken_attempt_is_done_again(tmp_path):
    """An attempt that ends midway leaves no file of its last entity; the next one writes all."""
    from types import SimpleNamespace
    from unittest import mock

    from pyspark.sql import Row

    writer = entities._Writer({"path": str(tmp_path / "out"), "key": "k"}, ["k", "n"])
    rows = [Row(k=k, n=n) for k in "abc" for n in range(3)]

    def cut():
        yield from rows[:7]
        raise OSError("lost executor")

    with mock.patch.object(entities.TaskContext, "get", return_value=SimpleNamespace(taskAttemptId=lambda: 5)):
        with pytest.raises(OSError):
            writer.write(cut())
        assert names(f"{writer.staging}/ready") == ["a.jsonl", "b.jsonl"]
        assert writer.write(iter(rows)).files == 3
    assert names(tmp_path) == [os.path.basename(writer.staging)]
    writer.commit([])
    assert names(tmp_path) == ["out"] and [len(list(open(tmp_path / "out" / f))) for f in names(tmp_path / "out")] == [3, 3, 3]


# --- the cache of a folder's metadata

FILES = ("full_121_368_640.pt", "half_132_184_320.pt", "quarter_165_92_160.pt", "other_200_400_400.pt", "note.txt")


def folder_with_files(path):
    path.mkdir()
    for f in FILES:
        (path / f).write_bytes(b"x")
    return str(path)


def parse(found):
    name = files.parse_feature_name(F.element_at(F.split("_path", "/"), -1)).alias("n")
    return found.select(*cache.MARKS, name).where("n is not null").select(*cache.MARKS, "n.*")


def utts(df):
    return sorted(r["uttid"] for r in df.select("uttid").collect())


ALL = ["full", "half", "other", "quarter"]


def test_cache_is_loaded_without_reading_or_writing(spark, tmp_path):
    folder, at = folder_with_files(tmp_path / "f"), str(tmp_path / "cache")
    assert utts(cache.cached(spark, folder, at, parse, "*.pt")) == ALL
    before = {f: os.stat(f"{at}/{f}").st_mtime_ns for f in names(at)}
    parsed = []

    def counted(found):
        parsed.append(found.count())
        return parse(found)

    assert utts(cache.cached(spark, folder, at, counted, "*.pt")) == ALL
    assert sum(parsed) == 0 and {f: os.stat(f"{at}/{f}").st_mtime_ns for f in names(at)} == before
    # what is new or changed is parsed, and nothing else; what is gone goes
    os.remove(f"{folder}/half_132_184_320.pt")
    open(f"{folder}/fresh_99_8_8.pt", "wb").write(b"new")
    open(f"{folder}/full_121_368_640.pt", "wb").write(b"longer than before")
    parsed.clear()
    got = cache.cached(spark, folder, at, counted, "*.pt")
    assert utts(got) == ["fresh", "full", "other", "quarter"] and parsed == [0, 2, 2][: len(parsed)] or parsed == [0, 2]
    assert utts(cache.cached(spark, folder, at, counted, "*.pt", rebuild=True)) == ["fresh", "full", "other", "quarter"]
    assert len([f for f in names(at) if f.startswith("snapshot-")]) == 2  # the last one may still be read


@pytest.mark.parametrize("damage", ["version", "torn pointer", "not a mapping", "binary", "other columns", "cut file", "lost file", "missing snapshot", "row count"])
def test_damaged_caches_are_rebuilt(spark, tmp_path, damage):
    folder, at = folder_with_files(tmp_path / "f"), str(tmp_path / "cache")
    cache.cached(spark, folder, at, parse, "*.pt")
    pointer = f"{at}/{cache.POINTER}"
    said = json.load(open(pointer))
    data = [f"{at}/{said['snapshot']}/{f}" for f in said["files"]]
    spoilt = {
        "version": lambda: said | {"version": 1}, "not a mapping": lambda: ["not", "a", "mapping"], "other columns": lambda: said | {"columns": {"type": "struct", "fields": []}},
        "missing snapshot": lambda: said | {"snapshot": "snapshot-none"}, "row count": lambda: said | {"rows": 7},
    }
    if damage in spoilt:
        json.dump(spoilt[damage](), open(pointer, "w"))
    elif damage == "torn pointer":
        open(pointer, "w").write(open(pointer).read()[:20])
    elif damage == "binary":
        open(pointer, "wb").write(b"(V\xff\xfe\x00.")
    elif damage == "lost file":
        os.remove(data[0])
    else:
        whole = open(data[0], "rb").read()
        open(data[0], "wb").write(whole[: len(whole) // 2])
    assert utts(cache.cached(spark, folder, at, parse, "*.pt")) == ALL
    healed = json.load(open(pointer))
    assert healed["version"] == cache.VERSION and healed["rows"] == 4 and healed["snapshot"] != said["snapshot"]


def test_a_cache_that_cannot_be_written_stays_in_memory(spark, tmp_path):
    folder = folder_with_files(tmp_path / "f")
    (tmp_path / "cache").write_text("a file is in the way")
    assert utts(cache.cached(spark, folder, str(tmp_path / "cache"), parse, "*.pt")) == ALL
    assert names(tmp_path) == ["cache", "f"] and (tmp_path / "cache").read_text() == "a file is in the way"


def test_the_pointer_appears_by_a_rename(spark, tmp_path, monkeypatch):
    folder, at = folder_with_files(tmp_path / "f"), str(tmp_path / "cache")
    seen = []
    real = cache.replace
    monkeypatch.setattr(cache, "replace", lambda *a: (seen.append(names(at)), real(*a)))
    cache.cached(spark, folder, at, parse, "*.pt")
    assert cache.POINTER not in seen[0] and cache.POINTER in names(at) and not [f for f in names(at) if ".tmp-" in f]

    def dies(*a):
        raise KeyboardInterrupt

    monkeypatch.setattr(cache, "replace", dies)
    open(f"{folder}/more_1_1_1.pt", "wb").write(b"x")
    with pytest.raises(KeyboardInterrupt):
        cache.cached(spark, folder, at, parse, "*.pt")
    monkeypatch.setattr(cache, "replace", real)
    assert utts(cache.snapshot(spark, at, cache.cached(spark, folder, str(tmp_path / "c2"), parse, "*.pt").schema)) == ALL  # the old one holds


# --- listings and watchers


def test_skips_are_counted_in_the_same_pass(spark):
    lines = ["v1_0-66_66_368_640.pt", "v1_66-70_4_368_640.pt", "bad", None, "", "v2_0-99999999999999999999_1_1_1.pt", "v3_5-500_495_1_1.pt", "v4_0-99_99_1_1.pt "]
    df = spark.createDataFrame([(x, "n") for x in lines], "line string, reason0 string")
    pattern = r"(?P<clip>\w+?)_(?P<start>\d+)-(?P<stop>\d+)_(?P<n>\d+)_\d+_\d+\.pt"
    counts = Observation()
    kept = listing.scan(df, "line", pattern, {"clip": "string", "start": "long", "stop": "long"}, [("too_short", F.col("stop") - F.col("start") < 33), ("unknown", F.col("clip") == "v3")], counts)
    assert [tuple(r)[2:] for r in kept.collect()] == [("v1", 0, 66)]
    assert counts.get == {"rows": 8, "kept": 1, "unparsed_name": 5, "too_short": 1, "unknown": 1}
    with pytest.raises(ValueError, match="no group x"):
        listing.named_groups(F.col("line"), pattern, {"x": "long"})


def test_each_newest_step_takes_effect_once(spark, tmp_path):
    folder, out, done = tmp_path / "runs", str(tmp_path / "out"), []
    step = lambda *n: [(folder / f"checkpoint-{i}").mkdir(parents=True) for i in n]

    def work(batch):
        done.extend(r["step"] for r in batch.collect())
        return batch.withColumn("score", F.col("step") * 2)

    def run(sink):
        q = newest.newest(spark, str(folder)).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    def killed(batch, number):
        newest.once(work, out)(batch, number)
        raise RuntimeError("killed between work and commit")

    step(10, 20, 30)
    (folder / "checkpoint-x").mkdir()
    run(newest.once(work, out))
    run(newest.once(work, out))  # nothing new
    step(40)
    with pytest.raises(Exception, match="killed between work and commit"):
        run(killed)
    step(50, 60)
    run(newest.once(work, out))  # a restart first ends what it was at
    run(newest.once(work, out))
    assert done == [30, 40, 40, 60]  # 40 was done twice
    assert sorted((r["step"], r["score"], r["path"]) for r in spark.read.parquet(out).collect()) == [(n, 2 * n, f"{folder}/checkpoint-{n}") for n in (30, 40, 60)]


def test_scalars_of_one_metric_leave_the_others_alone(spark, tmp_path):
    path = str(tmp_path / "s")
    points = lambda m, n, v: spark.createDataFrame([(s, m, v * s) for s in range(n)] + [(99, m, None)], "step long, metric string, value double")
    files.write_scalars(points("loss", 5, 1.0).union(points("acc", 4, 2.0)), path)
    before = {f: os.stat(f"{path}/metric=acc/{f}").st_mtime_ns for f in names(f"{path}/metric=acc")}
    for _ in range(2):
        files.write_scalars(points("loss", 3, 7.0).union(points("new", 1, 1.0)), path)
    assert {f: os.stat(f"{path}/metric=acc/{f}").st_mtime_ns for f in names(f"{path}/metric=acc")} == before
    got = sorted((r["metric"], r["step"], r["value"]) for r in spark.read.parquet(path).collect())
    assert got == [("acc", s, 2.0 * s) for s in range(4)] + [("loss", s, 7.0 * s) for s in range(3)] + [("new", 0, 0.0)]
