"""The `ridgeline-log` format: an append-only text log whose rows appear when their write commits, and only then.

Every task writes its rows, in the text log's form, to one file in a staging folder of its own attempt; its commit
message names the file. The driver moves the named files into the log when all tasks have committed, and removes the
staging folder. So a failed task, a task that ran twice or a failed write leaves no rows; at most a file in the staging
folder, which no reader of the log looks into. LogWriter adds batches of rows
and is closed as often as one likes.

    spark.dataSource.register(LogSource)
    df.write.format("ridgeline-log").mode("append").save(path)

Paths are those that the tasks' file system shows: a folder that driver and executors share.
"""

from __future__ import annotations

import contextlib
import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ridgeline.sources.samples import DELIMITER, NUMBER

STAGING = "_staging"


@dataclass
class Committed(WriterCommitMessage):
    file: str | None
    rows: int


def line(row: tuple) -> str:
    """A row in the text log's form; null and NaN are nan."""
    cells = []
    for x in row:
        v = math.nan if x is None else float(x)
        cells.append(NUMBER % v if math.isfinite(v) else "nan" if v != v else "inf" if v > 0 else "-inf")
    return DELIMITER.join(cells)


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.staging = path, f"{path}/{STAGING}/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Committed:
        n, name = 0, f"part-{uuid.uuid4().hex}.csv"
        os.makedirs(self.staging, exist_ok=True)
        with open(f"{self.staging}/{name}.open", "w", encoding="utf-8") as f:
            for row in iterator:
                f.write(line(tuple(row)) + "\n")
                n += 1
        os.replace(f"{self.staging}/{name}.open", f"{self.staging}/{name}")
        return Committed(name if n else None, n)

    def commit(self, messages: list[Committed | None]) -> None:
        for m in messages:
            if m is not None and m.file:
                os.replace(f"{self.staging}/{m.file}", f"{self.path}/{m.file}")
        self._clean()

    def abort(self, messages: list[Committed | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        with contextlib.suppress(OSError):  # a task may outlive its failed write
            for name in os.listdir(self.staging):
                os.remove(f"{self.staging}/{name}")
            os.rmdir(self.staging)


class LogSource(DataSource):
    """Write side of the log; `read_log` reads it."""

    @classmethod
    def name(cls) -> str:
        return "ridgeline-log"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        path = self.options.get("path")
        if not path:
            raise ValueError("the log needs a path")
        if overwrite:
            raise ValueError("a log is only appended to")
        return _Writer(path.removeprefix("file:"))


class LogWriter:
    """Batches of evaluations of one width into one log. Closing twice, or without a batch, is harmless."""

    def __init__(self, spark: SparkSession, path: str):
        spark.dataSource.register(LogSource)
        self.path, self.width, self.closed = path, None, False

    def write_batch(self, rows: DataFrame) -> None:
        if self.closed:
            raise ValueError("the log is closed")
        if self.width not in (None, len(rows.columns)):
            raise ValueError(f"a batch of {len(rows.columns)} columns, the log has {self.width}")
        self.width = len(rows.columns)
        rows.write.format("ridgeline-log").mode("append").save(self.path)

    def flush(self) -> None:
        """Nothing waits: a batch is in the log when write_batch returns."""

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> LogWriter:
        return self

    def __exit__(self, *_) -> None:
        self.close()
