"""A cache of what is parsed from a folder's files, kept by their fingerprints.

A snapshot is a Parquet table of the parsed rows with each row's file, its
length and its time of change. A small pointer file names the snapshot that
holds, with its version and columns, and is replaced by a rename: readers see
the old snapshot or the new one, and a writer that dies leaves the old. Files
that are new or changed since the snapshot are parsed, those gone are left out,
and if nothing changed nothing is read or written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.stores import drop, exists, replace, store

VERSION = 2
POINTER = "CURRENT.json"
MARKS = ["_path", "_length", "_changed"]


def files_of(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(_path, _length, _changed) of the files in a folder; their contents are not read, and files of no bytes are left out."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return rows.select(F.col("path").alias("_path"), F.col("length").alias("_length"), F.col("modificationTime").alias("_changed"))


def snapshot(spark: SparkSession, cache: str, schema: StructType) -> DataFrame | None:
    """The snapshot that the pointer names, or None if there is none that can be trusted: another version, other columns, damaged or missing files."""
    at, root = store(cache)
    try:
        with at.open_input_stream(f"{root}/{POINTER}") as f:
            said = json.loads(f.read())
        if said["version"] != VERSION or said["columns"] != schema.jsonValue():
            return None
        found = at.get_file_info(fs.FileSelector(f"{root}/{said['snapshot']}"))
        if {f.base_name: f.size for f in found if f.base_name.endswith(".parquet")} != said["files"]:
            return None
        got = spark.read.parquet(f"{cache.rstrip('/')}/{said['snapshot']}")
        # the footers are read, and they must hold what the pointer says
        if [(f.name, f.dataType) for f in got.schema] != [(f.name, f.dataType) for f in schema] or got.count() != said["rows"]:
            return None
        return got
    except Exception:  # whatever a torn or strange pointer or file raises: it is built anew
        return None


def _publish(rows: DataFrame, cache: str) -> DataFrame | None:
    """Write a snapshot and let the pointer name it; None, and nothing left behind, if the folder can't be written."""
    spark, tag = rows.sparkSession, uuid.uuid4().hex
    at, root = store(cache)
    name = f"snapshot-{tag}"
    try:
        at.create_dir(root)
        with at.open_output_stream(f"{root}/{POINTER}.tmp-{tag}"):
            pass
        at.delete_file(f"{root}/{POINTER}.tmp-{tag}")
    except OSError:
        return None
    old = None
    if exists(at, f"{root}/{POINTER}"):
        with at.open_input_stream(f"{root}/{POINTER}") as f:
            try:
                old = json.loads(f.read())["snapshot"]
            except Exception:  # a damaged pointer names none
                old = None
    rows.write.parquet(f"{cache.rstrip('/')}/{name}")
    got = spark.read.schema(rows.schema).parquet(f"{cache.rstrip('/')}/{name}")
    files = {f.base_name: f.size for f in at.get_file_info(fs.FileSelector(f"{root}/{name}")) if f.base_name.endswith(".parquet")}
    said = {"version": VERSION, "snapshot": name, "columns": rows.schema.jsonValue(), "files": files, "rows": got.count()}
    replace(at, f"{root}/{POINTER}", json.dumps(said).encode(), tag)
    # snapshots before the last may still be read; they go when the next one is published
    for f in at.get_file_info(fs.FileSelector(root)):
        if f.base_name.startswith("snapshot-") and f.base_name not in (name, old):
            drop(at, f.path)
    return got


def cached(spark: SparkSession, folder: str, cache: str, parse: Callable[[DataFrame], DataFrame], glob: str = "*", rebuild: bool = False) -> DataFrame:
    """The rows that ``parse`` makes of the folder's files, from the cache where that holds.

    ``parse`` gets files (``_path``, ``_length``, ``_changed``) and returns rows
    that keep these columns. ``rebuild`` parses all files and leaves the cache
    alone. If the cache can't be written, the rows are kept in memory.
    """
    files = files_of(spark, folder, glob)
    if rebuild:
        return parse(files)
    schema = parse(files.limit(0)).schema
    schema = StructType([type(f)(f.name, f.dataType, True) for f in schema])
    held = snapshot(spark, cache, schema)
    if held is None:
        fresh = parse(files)
    else:
        known = held.select(*MARKS).distinct()
        changed = files.join(known, MARKS, "left_anti")
        gone = known.join(files, MARKS, "left_anti")
        # files without rows are not in the snapshot: they are looked at again, and change nothing
        if gone.isEmpty() and (changed.isEmpty() or parse(changed).isEmpty()):
            return held
        fresh = held.join(files, MARKS, "left_semi").select(*schema.names).unionByName(parse(changed))
    fresh = fresh.select(*schema.names)
    return _publish(fresh, cache) or fresh.cache()
