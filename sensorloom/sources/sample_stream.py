"""Sliding windows of an array as a stream: offsets count samples, so a restart yields none twice."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from sensorloom.sources.ndarray import block_paths, layout_of, open_file, read_rows


@dataclass
class Samples(InputPartition):
    first: int
    last: int


class SampleStreamSource(DataSource):
    """Format `sample_windows`. Options: path (an array [T, N], or a folder of its blocks with a slash at its end), history, horizon, samples_a_task.

    Sample s is the window that begins at step s. The offset is the number of samples that the
    files hold when a micro-batch is planned; blocks added later give more. Blocks are whole:
    only the last may be shorter than the others, and files do not change.
    """

    @classmethod
    def name(cls) -> str:
        return "sample_windows"

    def schema(self) -> str:
        return "sample long, node long, past array<double>, future array<double>"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SampleStreamReader(dict(self.options))


class SampleStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.history, self.horizon = options["path"], int(options["history"]), int(options["horizon"])
        self.step = int(options.get("samples_a_task", 4096))

    def _layouts(self):
        return [layout_of(p, ["t", "node"]) for p in (block_paths(self.path) if self.path.endswith("/") else [self.path])]

    def initialOffset(self) -> dict:
        return {"samples": 0}

    def latestOffset(self) -> dict:
        steps = sum(x.shape[0] for x in self._layouts())
        return {"samples": max(0, steps - self.history - self.horizon + 1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Samples(a, min(a + self.step, end["samples"])) for a in range(start["samples"], end["samples"], self.step)]

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition: Samples) -> Iterator[pa.RecordBatch]:
        import numpy as np

        first, last, parts, base = partition.first, partition.last + self.history + self.horizon - 1, [], 0
        for lay in self._layouts():
            a, z = max(first - base, 0), min(last - base, lay.shape[0])
            if a < z:
                with open_file(lay.path) as f:
                    parts.append(read_rows(f, lay, a, z, np.arange(lay.row_items), 0)[0])
            base += lay.shape[0]
        rows = np.concatenate(parts).astype(float)
        width = rows.shape[1]
        for s in range(partition.first, partition.last):
            at = s - first
            past, future = rows[at : at + self.history].T, rows[at + self.history : at + self.history + self.horizon].T
            lists = [pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.reshape(-1), mask=~np.isfinite(x.reshape(-1)))) for x in (past, future)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width, s)), pa.array(np.arange(width)), *lists], names=["sample", "node", "past", "future"])


def stream_samples(spark: SparkSession, path: str, history: int, horizon: int, samples_a_task: int = 4096) -> DataFrame:
    """A stream of (sample, node, past, future); NaN and infinities are null."""
    spark.dataSource.register(SampleStreamSource)
    return spark.readStream.format("sample_windows").options(path=path, history=str(history), horizon=str(horizon), samples_a_task=str(samples_a_task)).load()
