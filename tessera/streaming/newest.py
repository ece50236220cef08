"""Watching a folder for its newest checkpoint: a stream whose offset is the newest step.

Polling finds the largest step of names like ``checkpoint-120``; a batch is the
newest step beyond the last batch's, and those between are never read. Spark
notes a batch's offsets before it runs and that it is done after, so a watcher
that is killed takes the same step again under the same batch number, however
new the folder has become. ``once`` keeps a batch's result under that number, so a
repeated one replaces its own: each step has its effect once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tessera.sources.stores import store

PATTERN = r"checkpoint-(\d+)"


@dataclass
class _Step(InputPartition):
    step: int
    path: str


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, pattern: str, after: int):
        self.path, self.pattern, self.after = path.rstrip("/"), re.compile(pattern), after
        self.seen = after

    def _names(self) -> dict[int, str]:
        at, folder = store(self.path)
        found = at.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return {int(m[1]): f.base_name for f in found if (m := self.pattern.fullmatch(f.base_name))}

    def initialOffset(self) -> dict:
        return {"step": self.after}

    def latestOffset(self) -> dict:
        # the folder may lose old checkpoints, the offset does not go back
        self.seen = max([self.seen, *self._names()])
        return {"step": self.seen}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = max(self.seen, end["step"])
        return [_Step(end["step"], self.path)] if end["step"] > start["step"] else []

    def read(self, partition: _Step) -> Iterator[tuple[int, str]]:
        name = self._names().get(partition.step)
        yield partition.step, f"{partition.path}/{name}" if name else None

    def commit(self, end: dict) -> None:
        pass


class NewestCheckpoint(DataSource):
    """Format ``newest_checkpoint``: (step, path), the path null if the checkpoint has gone; options path, pattern and after (-1)."""

    @classmethod
    def name(cls) -> str:
        return "newest_checkpoint"

    def schema(self) -> str:
        return "step long, path string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(self.options["path"], self.options.get("pattern", PATTERN), int(self.options.get("after", "-1")))


def newest(spark: SparkSession, path: str, pattern: str = PATTERN, after: int = -1) -> DataFrame:
    """The stream of the newest steps of the folder ``path``, beyond ``after``."""
    spark.dataSource.register(NewestCheckpoint)
    return spark.readStream.format("newest_checkpoint").option("pattern", pattern).option("after", str(after)).load(path)


def once(work: Callable[[DataFrame], DataFrame], out: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: put what ``work`` makes of a batch into the table ``out``, in the place of what the same batch made before."""

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return each
