"""Golden cases of the operators, and sources and sinks in a folder."""

import json

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions import prompts, scalars
from tessera.operators import ranking, rows, series
from tessera.sources import files
from tessera.streaming import state


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("n,fpc,switches,total,want", [(2, 33, [39], 66, [0, 1]), (2, 33, [33], 66, [0, 1]), (4, 33, [27, 60], 132, [0, 1, 2, 2]), (2, 33, [1], 66, [1, 1]), (3, 33, [], 99, [0, 0, 0]), (1, 6, [3], 6, [0])])
def test_interval_owner(spark, n, fpc, switches, total, want):
    starts, ends = F.array(*map(F.lit, [0, *switches])), F.array(*map(F.lit, [*switches, total]))
    got = spark.range(n).select("id", rows.interval_owner(F.col("id") * fpc, F.col("id") * fpc + fpc, starts, ends).alias("e")).orderBy("id").collect()
    assert [r["e"] for r in got] == want


def test_eviction(spark):
    frames = F.sequence(F.lit(1), F.lit(32))
    got = [one(spark, *(c.alias(n) for n, c in zip("nf", series.evicted(F.lit(k), frames)))) for k in range(5)]
    assert [r["n"] for r in got] == [0, 0, 0, 8, 9]
    assert got[3]["f"] == list(range(1, 9)) and got[4]["f"] == list(range(9, 18))


def test_rollout_history(spark):
    h, _ = series.rollout_window(4, F.sequence(F.lit(1).cast("long"), F.lit(64).cast("long")))
    assert len(one(spark, h.alias("h"))["h"]) == 19


def test_frozen_runs_of_14_and_15(spark):
    df = spark.createDataFrame([("a", i, 0.0 if i < 14 else 1.0) for i in range(30)] + [("b", i, 0.0 if 5 <= i < 20 else 1.0) for i in range(30)], "k string, i long, v double")
    got = series.islands(df, "k", "i", F.col("v") < 0.5, 15).collect()
    assert [(r["k"], r["start"], r["stop"]) for r in got] == [("b", 5, 20)]


def test_ok_first_prefers_late_ok(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, True), ("b", 1, False), ("b", 2, None)], "k string, o int, ok boolean")
    got = {r["k"]: r["o"] for r in rows.ok_first(df, "k", F.col("ok"), ["o"]).collect()}
    assert got == {"a": 2, "b": 1}


def test_falsy_zero_ties_and_buckets(spark):
    assert one(spark, ranking.nearest_bucket(F.lit(512), F.lit(512), [(512, 512), (256, 256)]).alias("x"))["x"] == 1
    assert one(spark, ranking.length_bucket(F.lit(100), [121, 201]).alias("x"))["x"] == 100
    assert ranking.proportional_shards(0, 5, 4) == (0, 4) and ranking.proportional_shards(1, 999, 4) == (1, 3)


def test_ratings(spark):
    r = lambda v: one(spark, ranking.threshold_rating(F.lit(v).cast("double"), [0.9, 0.5]).alias("x"))["x"]
    assert (r(0.95), r(0.5), r(0.1), r(None)) == (10, 9, 1, None)


def test_duplicate_keys_raise(spark):
    with pytest.raises(Exception, match="key repeats"):
        rows.assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), "k").collect()


def test_numbered_matches_plain(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k long")
    assert all(r["n"] == r["k"] + 1 for r in rows.numbered(df, "k", "n", 8).collect())


def test_text_functions(spark):
    r = one(spark, prompts.clean_prompt(F.lit(" a &amp;lt; b \n c ")).alias("a"), scalars.tag_content(F.lit("x <event>y\nz</event>"), "event").alias("b"), scalars.json_object(F.lit('so {"a": {"b": 1}} end')).alias("c"), scalars.rate(F.lit("30/0")).alias("d"), F.to_json(scalars.smart_size(F.lit(1000), F.lit(500), 28, 3136, 200704)).alias("e"))
    assert (r["a"], r["b"], r["c"], r["d"]) == ("a < b c", "y\nz", '{"a": {"b": 1}}', None)
    size = json.loads(r["e"])
    assert size["h"] % 28 == 0 and size["w"] % 28 == 0 and size["h"] * size["w"] <= 200704


def test_manifest_round_trip(spark, tmp_path):
    rec = {"cut": [0, 66], "crop": [0, 640, 0, 368], "fps": 24.0, "num_frames": 66, "resolution": {"height": 368, "width": 640}, "cap": ["x"], "path": "a.mp4"}
    (tmp_path / "m.json").write_text(json.dumps([rec, rec | {"path": "b.mp4"}]))
    assert [r["path"] for r in files.read_manifest(spark, str(tmp_path / "m.json")).collect()] == ["a.mp4", "b.mp4"]


def test_tolerant_jsonl_and_csv(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\nnot json\n{"k": 2}\n')
    assert sorted(r["k"] for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "k int", True).collect() if r["k"]) == [1, 2]
    (tmp_path / "a.csv").write_text("id,duration\n1,2.5\n")
    assert files.read_csv(spark, str(tmp_path / "a.csv"), "id int, duration double").first()["duration"] == 2.5
    with pytest.raises(ValueError, match="prompt"):
        files.read_csv(spark, str(tmp_path / "a.csv"), "id int", required=["prompt"])


def test_prompt_lines(spark, tmp_path):
    (tmp_path / "p.txt").write_text("a\n\nb\n")
    got = lambda raw: [(r["idx"], r["value"]) for r in files.read_lines(spark, str(tmp_path / "p.txt"), raw).collect()]
    assert got(False) == [(0, "a"), (1, "b")] and got(True) == [(0, "a"), (2, "b")]


def test_names_and_logs(spark):
    name = files.parse_clip_name(F.lit("v_1_0-66_66_368_640.pt")).alias("n")
    assert one(spark, name)["n"] == Row(clip="v_1", start=0, stop=66, frames=66)
    log = spark.createDataFrame([("1/200 grad_norm=1.0, loss=0.5\r2/200 grad_norm=0.5, loss=0.4\n9/50 grad_norm=1.0, loss=1.0",), ("2/200 grad_norm=0.7",)], "value string")
    got = {(r["step"], r["metric"]): r["value"] for r in files.log_points(log.coalesce(1)).collect()}
    assert got == {(1, "grad_norm"): 1.0, (1, "loss"): 0.5, (2, "grad_norm"): 0.7, (2, "loss"): 0.4}


def test_templates_and_reports(spark):
    assert files.fill_templates({"a": ["{x}/{y}"]}, {"x": "1"}) == {"a": ["1/{y}"]}
    config = {"{x}": '"{x}": {{q}} \\ {n:03d}', "l": [1, None, True, 0.5, {"k": "{x}{x}{ x }é"}], "{": "}"}
    assert files.fill_templates(config, {"x": 'a"b', "n": 7}) == {"{x}": '"a"b": {q} \\ 007', "l": [1, None, True, 0.5, {"k": 'a"ba"b{ x }é'}], "{": "}"}
    df = spark.createDataFrame([("m", None, 0.5)], "model string, a double, b double")
    assert "| m | — | 0.5000 |" in files.markdown_table(df, ["model", "a", "b"])
    assert "&lt;b&gt;" in files.html_cards(spark.createDataFrame([("t", "<event><b></event>")], "t string, b string"), "t", "b")


def test_dimension_results(spark):
    text = spark.createDataFrame([('{"d": [0.5, [{"video_path": "a", "video_results": 0.25}, {"video_path": "b", "video_results": "x"}]]}',)], "value string")
    assert [tuple(r) for r in files.parse_dimension_results(text).collect()] == [("d", "a", 0.25)]


def test_score_adapter_keeps_errors(spark):
    def scorer(f):
        return {"m": [1.0 / f["x"].iloc[0].item()]} if f["x"].iloc[0] else 1 / 0

    got = {r["k"]: (r["metrics"], r["errors"]) for r in state.score(spark.createDataFrame([(1, 2.0), (2, 0.0)], "k int, x double"), scorer, "k", "m").collect()}
    assert got[1] == ({"m": 0.5}, {}) and "division" in got[2][1]["m"]


def test_fifo_stream(spark, tmp_path):
    for n in range(2):
        spark.createDataFrame([("a", float(10 * n + i)) for i in range(3)], "k string, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = state.fifo_buffers(stream, "k", "v", 4).writeStream.outputMode("update").format("memory").queryName("fifo").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert max(r["size"] for r in spark.sql("select * from fifo").collect()) == 4


def test_curation_operators(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    vals = lambda *v: F.array(*map(F.lit, v)).cast("array<double>")
    assert one(series.window_mean(vals(1, 2, 3, 4), 1, 3)) == 2.5 and one(series.window_mean(vals(1, 2), 2, 5)) is None
    assert one(series.middle_frames(F.lit(10), 2)) == [2, 7] and one(series.middle_frames(F.lit(2), 4)) == [0, 1, 1, 1]
    line = spark.createDataFrame([("a", i, 3.0 * i) for i in range(50)] + [("b", 0, 1.0)], "k string, i long, v double")
    assert {r["k"]: r["slope"] for r in series.sampled_theil_sen(line, "k", "i", "v", 20).collect()} == {"a": 3.0, "b": None}
    assert [one(series.runaway(*map(F.lit, q))) for q in [(1.0, 2.0, 3.0, 8), (1.0, 4.0, 3.0, 8), (0.0, 1.0, 3.0, 8), (1.0, 2.0, 3.0, 3)]] == [True, False, False, False]
    assert [one(scalars.metric_number(F.lit(x))) for x in ("true", "false", "1.5", "x")] == [1.0, 0.0, 1.5, None]
    none = F.lit(None).cast("string")
    assert one(ranking.pick_version(F.array(none, F.lit("a")), F.lit(1))) == "a" and one(ranking.pick_version(F.array(none, none), F.lit(1))) is None
    assert one(ranking.resolve_alias(F.lit(" View "), {"view": "aesthetic"})) == "aesthetic"
    left, side = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "a")], "k long, v string")
    with pytest.raises(Exception, match="no v for 2"):
        rows.strict_lookup(left, side, "k", "v").collect()
    got = rows.require_version(left, side.withColumn("ver", F.lit("long")), "k", "ver", "long", "v")
    assert {(r.k, r.reason) for r in got.collect()} == {(1, None), (2, "no_cap")}
    assert rows.where_equal(left, {"k": 2}).count() == 1 and rows.where_equal(left, {"k": "avg"}).count() == 2


@pytest.mark.parametrize(("n", "digits"), [(2, 3), (3, 0), (60, 0), (300, 1), (700, 6), (700, 0)])
def test_slopes_are_selected_by_rank(n, digits):
    rng = np.random.default_rng(n + digits)
    y = np.round(rng.standard_normal(n).cumsum() * 3, digits)
    every = np.sort([(y[j] - y[i]) / (j - i) for i in range(n) for j in range(i + 1, n)])
    for k in {0, len(every) // 3, (len(every) - 1) // 2, len(every) // 2, len(every) - 1}:
        assert series.kth_slope(y, k) == pytest.approx(every[k], abs=1e-9)
    for t in (-1.37, 0.013, 2.5001):
        assert series._slopes_up_to(y, t) == (every <= t).sum()
    assert sorted(series._slopes_between(y, -0.713, 0.291)) == pytest.approx(sorted(x for x in every if -0.713 < x <= 0.291))


def test_a_long_series_needs_no_pairs():
    y = np.concatenate([np.zeros(30_000), np.arange(30_000) * 2.0])  # 1.8 billion pairs
    assert 0 < series.kth_slope(y, 30_000 * 59_999 // 2) < 2
    assert series.kth_slope(np.ones(20_000), 12_345) == pytest.approx(0, abs=1e-9)


def test_theil_sen_of_whole_series(spark, tmp_path):
    from statistics import median

    from tessera.plans import catalogue

    steep = {1: 40, 2: 89, 3: 99}  # values of each user; the slope turns after the first 20
    rows = [(u * 1000 + i, u, i, "click", 1.0 * i if i < 20 else 20.0 - 3 * (i - 20) - 0.01 * i * i) for u, n in steep.items() for i in range(n)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    series = {u: [r[4] for r in rows if r[1] == u] for u in steep}
    exact = {u: median((b - a) / (j - i) for i, a in enumerate(v) for j, b in enumerate(v) if i < j) for u, v in series.items()}
    got = {r["user_id"]: r["slope"] for r in catalogue.queries()["AGG20_theil_sen_whole"](spark, str(tmp_path)).collect()}
    assert got == {u: pytest.approx(x, abs=1e-5) for u, x in exact.items()}
    sampled = {r["user_id"]: r["slope"] for r in catalogue.queries()["AGG21_theil_sen_sampled_whole"](spark, str(tmp_path)).collect()}
    assert all(sampled[u] == pytest.approx(exact[u], abs=1e-5) for u in (1, 2))  # up to 4,000 pairs
    assert sampled[3] == pytest.approx(exact[3], rel=0.1)
