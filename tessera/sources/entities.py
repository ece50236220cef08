"""A sink of one file for each entity, whole or absent.

Tasks write into a staging folder beside the target: an entity's file is made
under a name of its attempt and renamed once it is complete, so a broken or
repeated attempt leaves nothing half done. When all tasks have ended the
driver's commit renames the staging folder to the target, at once; an abort
removes it. So the target never shows a part of a result.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.sources.stores import drop, exists, store


@dataclass
class _Written(WriterCommitMessage):
    files: int


class EntityFiles(DataSource):
    """Format ``entity_files``; options path, key, kind (jsonl, csv or text) and mode (new, overwrite or append)."""

    @classmethod
    def name(cls) -> str:
        return "entity_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), [f.name for f in schema.fields])


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.key, self.kind, self.mode = options["path"].rstrip("/"), options["key"], options.get("kind", "jsonl"), options.get("mode", "new")
        if self.kind not in ("jsonl", "csv", "text") or self.mode not in ("new", "overwrite", "append"):
            raise ValueError(f"no such kind or mode: {self.kind}, {self.mode}")
        self.columns = [c for c in columns if c != self.key]
        if self.kind == "text" and len(self.columns) != 1:
            raise ValueError("text files have one column beside the key")
        self.job = uuid.uuid4().hex
        self.staging = f"{self.path}.staging-{self.job}"

    def _line(self, row: Row) -> str:
        values = [row[c] for c in self.columns]
        if self.kind == "text":
            return f"{'' if values[0] is None else values[0]}\n"
        if self.kind == "jsonl":
            said = {c: v.asDict(True) if isinstance(v, Row) else v for c, v in zip(self.columns, values)}
            return json.dumps(said, ensure_ascii=False, default=str) + "\n"
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerow(["" if v is None else v for v in values])
        return out.getvalue()

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        """One attempt of a task; its rows come entity by entity."""
        at, staging = store(self.staging)
        at.create_dir(f"{staging}/ready")
        own = f"{staging}/attempt-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        at.create_dir(own)
        name, out, n = None, None, 0

        def close() -> int:
            if out is None:
                return 0
            out.close()
            at.move(f"{own}/{name}", f"{staging}/ready/{name}")
            return 1

        try:
            for row in iterator:
                entity = f"{'null' if row[self.key] is None else quote(str(row[self.key]), safe=' ')}.{'txt' if self.kind == 'text' else self.kind}"
                if entity != name:
                    n += close()
                    name, out = entity, at.open_output_stream(f"{own}/{entity}")
                    if self.kind == "csv":
                        out.write((",".join(self.columns) + "\n").encode())
                out.write(self._line(row).encode())
            n += close()
        finally:
            at.delete_dir(own)
        return _Written(n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        at, staging = store(self.staging)
        _, path = store(self.path)
        if not exists(at, f"{staging}/ready"):
            at.create_dir(f"{staging}/ready")
        if self.mode == "append":
            at.create_dir(path)
            at.move(f"{staging}/ready", f"{path}/job-{self.job}")
        else:
            if exists(at, path):
                if self.mode == "new":
                    drop(at, staging)
                    raise FileExistsError(path)
                at.move(path, f"{staging}/old")
            at.move(f"{staging}/ready", path)
        drop(at, staging)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        at, staging = store(self.staging)
        drop(at, staging)


def write_entities(df: DataFrame, key: str, path: str, kind: str = "jsonl", mode: str = "new") -> bool:
    """A file for each ``key`` at ``path``, all or none; in mode ``new`` nothing is done, and False given, if the folder is there.

    Mode ``append`` adds a folder for this job. One shuffle brings an entity's
    rows together; a task holds one row at a time.
    """
    spark = df.sparkSession
    at, folder = store(path)
    if mode == "new" and exists(at, folder):
        return False
    spark.dataSource.register(EntityFiles)
    rows = df.repartition(key).sortWithinPartitions(*[key, *[c for c in df.columns if c != key and df.schema[c].dataType.typeName() not in ("map", "variant")]])
    rows.write.format("entity_files").option("key", key).option("kind", kind).option("mode", mode).mode("append").save(path)
    return True


def read_entities(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of JSON line files written with ``write_entities``, all jobs' ones if appended."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(path)
