"""A sink that inserts rows in small batches into a store, all of a job or none: format("insert_batches")."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of one insert (fixed value).
BATCH = 50


class FolderStore:
    """A store in a folder that all tasks reach: a file for each insert, and a list of the inserts that count for each job."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")

    def _write(self, path: str, lines: list[str]) -> None:
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        with self.fs.open_output_stream(path) as out:
            out.write("".join(line + "\n" for line in lines).encode())

    def insert(self, job: str, attempt: str, number: int, rows: list[dict]) -> None:
        self._write(f"{self.root}/rows/{job}/{attempt}/{number:08d}.json", [json.dumps(r, ensure_ascii=False) for r in rows])

    def commit(self, job: str, attempts: list[str]) -> None:
        """Let the inserts of these attempts count: by one rename. A job that is committed stays as it is."""
        done = f"{self.root}/commits/{job}.json"
        if not self.exists(done):
            self._write(f"{self.root}/staged/{job}.json", [json.dumps({"job": job, "attempt": a}) for a in attempts])
            self.fs.create_dir(f"{self.root}/commits", recursive=True)
            self.fs.move(f"{self.root}/staged/{job}.json", done)

    def abort(self, job: str) -> None:
        if not self.exists(f"{self.root}/commits/{job}.json") and self.exists(f"{self.root}/rows/{job}"):
            self.fs.delete_dir(f"{self.root}/rows/{job}")

    def sweep(self) -> None:
        """Delete the inserts of jobs that were never committed, as tasks may go on inserting after their job was given up; only while no job runs."""
        from pyarrow import fs

        if self.exists(f"{self.root}/rows"):
            for found in self.fs.get_file_info(fs.FileSelector(f"{self.root}/rows")):
                if not self.exists(f"{self.root}/commits/{found.base_name}.json"):
                    self.fs.delete_dir(found.path)

    def exists(self, path: str) -> bool:
        return bool(self.fs.get_file_info(path).type.value)


@dataclass
class Inserted(WriterCommitMessage):
    """What a task has inserted: its attempt, and how many rows and batches."""

    attempt: str
    rows: int
    batches: int


def plain(value):
    """A value of a row as JSON can hold it."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


class BatchWriter(DataSourceWriter):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size, self.job = path, size, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Inserted:
        store, attempt, rows, number = FolderStore(self.path), uuid.uuid4().hex, 0, 0
        while batch := list(islice(iterator, self.size)):
            store.insert(self.job, attempt, number, [plain(r) for r in batch])
            rows, number = rows + len(batch), number + 1
        return Inserted(attempt, rows, number)

    def commit(self, messages: list[Inserted | None]) -> None:
        FolderStore(self.path).commit(self.job, [m.attempt for m in messages if m is not None and m.batches])

    def abort(self, messages: list[Inserted | None]) -> None:
        FolderStore(self.path).abort(self.job)


class BatchSink(DataSource):
    """Options: path, batch (rows of an insert, 50). Only appends."""

    @classmethod
    def name(cls) -> str:
        return "insert_batches"

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("this sink appends")
        return BatchWriter(self.options["path"], int(self.options.get("batch", BATCH)))


def insert(rows: DataFrame, path: str, batch: int = BATCH) -> None:
    """Insert rows in batches. A failed job leaves nothing that counts, a task that is run again no doubles."""
    rows.sparkSession.dataSource.register(BatchSink)
    rows.write.format("insert_batches").option("path", path).option("batch", str(batch)).mode("append").save()


def inserted(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All rows of committed jobs."""
    root = path.rstrip("/")
    store = FolderStore(root)
    if not store.exists(f"{store.root}/commits"):
        return spark.createDataFrame([], schema)
    counted = spark.read.schema("job string, attempt string").json(f"{root}/commits").where("attempt IS NOT NULL")
    folders = [f"{root}/rows/{r['job']}/{r['attempt']}" for r in counted.distinct().collect()]  # one for each task that wrote
    return spark.read.schema(schema).json(folders) if folders else spark.createDataFrame([], schema)
