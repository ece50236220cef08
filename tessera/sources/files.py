"""Sources and sinks of manifests, captions, logs and results."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "cut array<int>, crop array<int>, fps double, num_frames int, resolution struct<height:int,width:int>, cap array<string>, path string, meta struct<switch_frame_index:array<int>,video_id:string,n_events:int>"


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """A JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """One object a line; blank lines are skipped, broken ones skipped if tolerant and fatal if not."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str] = (), sep: str = ",") -> DataFrame:
    """CSV with a header whose columns are matched by name; missing required columns raise."""
    head = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    missing = [c for c in required if c not in head.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    want = T._parse_datatype_string(schema)
    return head.select(*[(F.col(f"`{f.name}`") if f.name in head.columns else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in want])


def read_lines(spark: SparkSession, path: str, number_blank: bool = False) -> DataFrame:
    """(idx, value) of the non-blank lines of prompt files, numbered after or before dropping blanks.

    A file is read whole, since lines of one file have an order; prompt files are small.
    """
    whole = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("lines"))
    rows = whole.select(F.posexplode("lines").alias("idx", "value")) if number_blank else whole.select(F.posexplode(F.filter("lines", lambda x: F.trim(x) != "")).alias("idx", "value"))
    return rows.where(F.trim("value") != "")


def list_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, name, length) of files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def parse_feature_name(name: Column) -> Column:
    """uttid, frames, h, w of names like {uttid}_{frames}_{h}_{w}.pt; null if it does not fit."""
    pattern = r"^(.+)_(\d+)_(\d+)_(\d+)\.pt$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    return F.when(name.rlike(pattern), F.struct(part(1).alias("uttid"), *(part(k).cast("long").alias(n) for k, n in ((2, "frames"), (3, "h"), (4, "w")))))


def parse_clip_name(name: Column) -> Column:
    """clip, cut start and end, frames of names like {clip}_{start}-{end}_{frames}_{h}_{w}.pt."""
    pattern = r"^(.+)_(\d+)-(\d+)_(\d+)_\d+_\d+\.pt$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    return F.when(name.rlike(pattern), F.struct(part(1).alias("clip"), *(part(k).cast("long").alias(n) for k, n in ((2, "start"), (3, "stop"), (4, "frames")))))


def parse_checkpoint_name(name: Column) -> Column:
    """step and idx of names like checkpoint-{step}_{idx}.mp4."""
    pattern = r"^checkpoint-(\d+)_(\d+)\.mp4$"
    part = lambda k: F.regexp_extract(name, pattern, k).cast("long")
    return F.when(name.rlike(pattern), F.struct(part(1).alias("step"), part(2).alias("idx")))


def log_points(lines: DataFrame, line: str = "value", order: str | None = None) -> DataFrame:
    """(step, total, metric, value) of progress lines, parted by carriage returns; later lines win for a key.

    Lines need ``grad_norm=``, a total of at least 100 and a step within it.
    """
    rows = lines.select(F.col(order).alias("o") if order else F.monotonically_increasing_id().alias("o"), F.posexplode(F.split(line, r"[\r\n]")).alias("p", "l"))
    rows = rows.where(F.col("l").contains("grad_norm="))
    n = lambda k: F.regexp_extract("l", r"(\d+)/(\d+)", k).try_cast("long")
    rows = rows.withColumns({"step": n(1), "total": n(2)}).where("total >= 100 and step <= total")
    pairs = F.regexp_extract_all("l", F.lit(r"([A-Za-z_]+=[-+0-9.eE]+)"), F.lit(1))
    rows = rows.select("o", "p", "step", "total", F.explode(pairs).alias("kv"))
    rows = rows.select("o", "p", "step", "total", F.substring_index("kv", "=", 1).alias("metric"), F.substring_index("kv", "=", -1).try_cast("double").alias("value"))
    last = rows.where("value is not null").groupBy("step", "metric").agg(F.max(F.struct("o", "p", "total", "value")).alias("m"))
    return last.select("step", F.col("m.total").alias("total"), "metric", F.col("m.value").alias("value"))


def read_metric_results(spark: SparkSession, path: str, scores: list[str]) -> DataFrame:
    """(metric, id, video_name, scores...) of result files with a list of per-video results."""
    schema = "metric string, average_score double, average_drift_score double, num_videos int, per_video_results array<struct<id:int,video_name:string," + ",".join(f"{s}:double" for s in scores) + ">>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select("metric", F.explode("per_video_results").alias("r")).select("metric", "r.*")


def parse_dimension_results(text: DataFrame, column: str = "value") -> DataFrame:
    """(dimension, video_path, score) of ragged {dimension: [aggregate, [{video_path, video_results}]]} texts."""
    dims = text.select(F.explode(F.json_object_keys(column)).alias("dimension"), F.col(column).alias("t"))
    inner = F.call_function("get_json_object", F.col("t"), F.concat(F.lit("$['"), F.col("dimension"), F.lit("'][1]")))
    items = dims.select("dimension", F.explode(F.from_json(inner, "array<struct<video_path:string,video_results:string>>")).alias("r"))
    return items.select("dimension", "r.video_path", F.col("r.video_results").try_cast("double").alias("score")).where("score is not null")


def fill_templates(value, names: Mapping[str, str]):
    """Fill the known {placeholders} in all strings of a nested configuration, keys left out; unknown ones stay, formats apply, and doubled braces become single.

    The serialised configuration is rewritten once: JSON marks a key by the
    colon behind its string, so every other string is a value.
    """

    def one(m: re.Match) -> str:
        return m[0][0] if m[1] is None else format(names[m[1]], (m[2] or "")[1:]) if m[1] in names else m[0]

    def fill(found: re.Match) -> str:
        return found[0] if found[2] else json.dumps(re.sub(r"\{\{|\}\}|\{(\w+)(:[^{}]*)?\}", one, json.loads(found[1])))

    return json.loads(re.sub(r'("(?:[^"\\]|\\.)*")(\s*:)?', fill, json.dumps(value)))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_results(df: DataFrame, path: str) -> None:
    """The same rows as JSON lines, results.jsonl, and as one indented JSON array for readers, results.json."""
    df.write.mode("overwrite").json(f"{path}/results.jsonl")
    # the array is one file by nature: its rows come from the lines, in their order, one partition at a time
    lines = df.sparkSession.read.text(f"{path}/results.jsonl").coalesce(1)
    doc = lines.agg(F.concat(F.lit("[\n  "), F.array_join(F.collect_list("value"), ",\n  "), F.lit("\n]")).alias("value"))
    doc.write.mode("overwrite").text(f"{path}/results.json")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_csv_union(frames: list[DataFrame], path: str) -> None:
    """CSV of several tables under the union of their columns, in first-seen order."""
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f, allowMissingColumns=True)
    every.write.mode("overwrite").option("header", True).csv(path)


def write_per_entity(df: DataFrame, key: str, path: str) -> None:
    """A folder for each key; sources.entities writes a file for each."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def append_results(records: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Work on the records that have no good result at ``path`` yet, append the new results there, and give the good ones, one a key.

    ``work`` gives rows of ``schema``, which has ``key`` and ``error``; a result
    is good if its error is null or empty. Results are only ever appended, so
    work that was cut short goes on where it stopped; records whose last try
    failed are tried again. Broken lines count as not done.
    """
    spark = records.sparkSession
    # the first write makes the folder, so that there is something to read
    spark.createDataFrame([], schema).write.mode("append").json(path)
    good = lambda: read_jsonl(spark, path, schema, tolerant=True).where("coalesce(error, '') = ''")
    done = good().select(key).distinct()
    work(records.join(done, key, "left_anti")).write.mode("append").json(path)
    return good().dropDuplicates([key])


def write_scalars(points: DataFrame, path: str) -> None:
    """(step, metric, value) as a table with a part for each metric, in the order of steps.

    The metrics of ``points`` replace their own parts, in one commit; those of
    others stay as they are, files and all.
    """
    rows = points.select("step", "metric", F.col("value").cast("double").alias("value")).where("value is not null")
    rows.repartition("metric").sortWithinPartitions("metric", "step").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric").parquet(path)


def write_sheets(df: DataFrame, first: list[str], percent: list[str], path: str) -> None:
    """Two tables of the same rows, raw and shown: ``first`` columns lead, and ``percent`` ones are shown as percentages of two digits.

    They are CSV, since no writer of spreadsheets is at hand.
    """
    names = [c for c in first if c in df.columns] + [c for c in df.columns if c not in first]
    shown = [F.when(F.col(c).isNotNull(), F.format_string("%.2f%%", F.col(c).cast("double") * 100)).alias(c) if c in percent else F.col(c) for c in names]
    df.select(*names).write.mode("overwrite").option("header", True).csv(f"{path}/raw")
    df.select(*shown).write.mode("overwrite").option("header", True).csv(f"{path}/shown")


def replicated_view(df: DataFrame, name: str, path: str, times: Mapping[str, int], root: str) -> DataFrame:
    """(view_path, path, replica): the files of a tree in which each name stands as often as ``times`` says, once if it says nothing; no file is copied."""
    counts = F.coalesce(F.try_element_at(F.from_json(F.lit(json.dumps(dict(times))), "map<string,int>"), F.col(name)), F.lit(1))
    rows = df.where(counts > 0).select(F.col(name).alias("_name"), F.col(path).alias("path"), F.explode(F.sequence(F.lit(0), counts - 1)).alias("replica"))
    shown = F.when(F.col("replica") == 0, F.col("_name")).otherwise(F.concat_ws("__rep", "_name", F.col("replica").cast("string")))
    return rows.select(F.concat(F.lit(root.rstrip("/") + "/"), shown).alias("view_path"), "path", "replica")


def write_new(df: DataFrame, path: str) -> bool:
    """Write unless a finished table is there; Spark's commit makes it whole or absent."""
    try:
        df.write.mode("errorifexists").parquet(path)
        return True
    except Exception as e:
        if "PATH_ALREADY_EXISTS" in str(e):
            return False
        raise


def _some(df: DataFrame, limit: int | None) -> tuple[list, int]:
    """Rows for a report, and how many others there are."""
    rows = df.collect() if limit is None else df.limit(limit).collect()
    return rows, 0 if limit is None or len(rows) < limit else df.count() - len(rows)


def markdown_table(df: DataFrame, names: list[str], limit: int | None = None) -> str:
    """A report table of all rows, or of the first ``limit`` and a line that says how many are left out; missing values are em dashes."""
    rows, rest = _some(df.select(*names), limit)
    say = lambda v: "—" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(map(say, r)) + " |" for r in rows)]) + "\n" + (f"\n{rest} more rows\n" if rest else "")


def html_cards(df: DataFrame, title: str, body: str, limit: int | None = None) -> str:
    """Preview cards of all rows, or of the first ``limit`` and a line that says how many are left out; the body is its <event> part if it has one, escaped."""
    event = F.regexp_extract(body, r"(?s)<event>(.*?)</event>", 1)
    rows, rest = _some(df.select(F.col(title).cast("string"), F.coalesce(F.nullif(event, F.lit("")), F.col(body), F.lit(""))), limit)
    cards = [f"<article><h3>{html.escape(a or '')}</h3><p>{html.escape(b)}</p></article>" for a, b in rows]
    return "\n".join(cards + ([f"<p>{rest} more</p>"] if rest else []))


def provenance(spark: SparkSession, inputs: DataFrame, path: str, key: str, note: Mapping[str, str]) -> DataFrame:
    """One row: number of inputs, SHA-256 of their sorted list, and notes as canonical JSON."""
    digest = F.sha2(F.concat(F.array_join(F.sort_array(F.collect_list(F.sha2(F.col(path), 256))), "\n"), F.lit("\n")), 256)
    return inputs.agg(F.count(key).alias("n_inputs"), digest.alias("inputs_sha256")).withColumn("note", F.lit(json.dumps(dict(note), sort_keys=True, separators=(",", ":"))))
