"""Hashes of files by their paths, dealt to tasks by bytes."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import running_sums

#: Bytes that a task reads, about; a larger file is a task of its own.
TASK_BYTES = 256 << 20


def read_blocks(path: str, block: int | None) -> tuple[str, int]:
    """(digest, bytes read) of a file's first and last block, or of all of it for None or where two blocks cover it; ('', bytes) if it can't be read."""
    digest, read = hashlib.md5(), 0
    try:
        with open(path, "rb") as f:
            size = os.fstat(f.fileno()).st_size
            parts = [(0, size)] if block is None or size <= 2 * block else [(0, block), (size - block, block)]
            for start, left in parts:
                f.seek(start)
                while left and (piece := f.read(min(left, 1 << 20))):
                    digest.update(piece)
                    read += len(piece)
                    left -= len(piece)
    except OSError:
        return "", read
    return digest.hexdigest(), read


class FileBlocks:
    """Hasher of files on disks that all executors see; the key is the path."""

    def __init__(self, task_bytes: int = TASK_BYTES):
        self.task_bytes = task_bytes

    def _hash(self, rows: DataFrame, block: int | None, cost) -> DataFrame:
        """A task's share ends where the running sum of bytes passes a multiple of ``task_bytes``."""
        ran = running_sums(rows.select("key", "size"), [], ["size", "key"], {"_sum": cost})
        dealt = ran.withColumn("_task", F.call_function("div", F.col("_sum"), F.lit(self.task_bytes)))
        tasks = (dealt.agg(F.max("_task")).first()[0] or 0) + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [read_blocks(p, block) for p in b["key"].to_pylist()]
                yield pa.RecordBatch.from_arrays([b["key"], pa.array([d for d, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["key", "digest", "bytes_read"])

        return dealt.repartitionByRange(tasks, "_task").select("key").mapInArrow(run, "key string, digest string, bytes_read bigint")

    def edges(self, rows: DataFrame, block: int) -> DataFrame:
        return self._hash(rows, block, F.least("size", F.lit(2 * block)))

    def whole(self, rows: DataFrame) -> DataFrame:
        return self._hash(rows, None, F.col("size"))
