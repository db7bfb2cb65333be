"""Policy files as a data source: ``df.write.format("policy_files").mode("append").save(root)`` for rows of output_path and content.

Tasks write files into a hidden folder below root, each attempt into one of its own with a list of what it holds, and check that each path
lies below root and leads through no link. When all tasks are done, the lists of the attempts that count are checked once more and their files
moved into place, one atomic rename each. So a task that fails, is repeated or runs twice leaves nothing behind, and a job that fails or is
refused a path writes no file at all. root is a folder that the driver and all workers share; a worker that doesn't see it fails."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "policy_files"
SCHEMA = "output_path string, content string"


class SinkError(ValueError):
    pass


def inside(root: Path, path: str) -> Path:
    """path, relative to root or below it, as a path below root that no link leads out of."""
    top = root.resolve()
    full = Path(os.path.normpath(top / Path(path).relative_to(root) if Path(path).is_relative_to(root) else top / path))
    if full == top or not full.is_relative_to(top):
        raise SinkError(f"{path} is outside of {root}")
    parent = full.parent
    while not parent.exists():
        parent = parent.parent
    if not parent.resolve().is_relative_to(top):
        raise SinkError(f"{path} is outside of {root}")
    if full.is_symlink():
        raise SinkError(f"{path} is a link")
    return full


@dataclass
class Written(WriterCommitMessage):
    attempt: str


class Writer(DataSourceArrowWriter):
    def __init__(self, root: str) -> None:
        self.root = Path(root)
        self.staging = self.root / f".policies-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task = TaskContext.get()
        folder = self.staging / f"{task.partitionId()}-{task.taskAttemptId()}"
        if not self.staging.is_dir():
            raise FileNotFoundError(f"No such file or directory on this machine: {self.root}")
        folder.mkdir()
        n = 0
        try:
            with (folder / "list").open("w", encoding="utf-8") as held:
                for b in iterator:
                    for path, content in zip(b.column("output_path").to_pylist(), b.column("content").to_pylist(), strict=True):
                        inside(self.root, path)
                        (folder / str(n)).write_text(content or "", encoding="utf-8", newline="")
                        held.write(json.dumps(path) + "\n")
                        n += 1
        except BaseException:
            shutil.rmtree(folder, ignore_errors=True)
            raise
        return Written(folder.name)

    def _files(self, messages: list[WriterCommitMessage | None]) -> Iterator[tuple[Path, str]]:
        for m in messages:
            if m is not None:
                with (self.staging / m.attempt / "list").open(encoding="utf-8") as held:
                    for n, line in enumerate(held):
                        yield self.staging / m.attempt / str(n), json.loads(line)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        try:
            for _, path in self._files(messages):  # all of them before the first is moved
                inside(self.root, path)
            for staged, path in self._files(messages):
                to = inside(self.root, path)
                to.parent.mkdir(parents=True, exist_ok=True)
                os.replace(staged, to)
        finally:
            shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class PolicyFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        root = self.options.get("path") or ""
        if not root or overwrite or not {"output_path", "content"} <= set(schema.names):
            raise SinkError("policy files need a path, output_path and content, and are added to what is there")
        w = Writer(root)
        w.staging.mkdir(parents=True)
        return w


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PolicyFiles)
