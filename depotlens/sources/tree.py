"""A batch data source over a directory tree.

The tree is opened from the root until there are enough subtrees, which are dealt
to input partitions, so that many tasks walk it also where one top directory
holds nearly all. Rows are raw entries; totals of directories come from
``operators.rollup``, not from the walk.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "name string, path string, size bigint, file_mod_time timestamp_ntz, md5hash string, is_dir boolean"


#: Input partitions of a tree, at most.
PARTITIONS = 256


class _Entries(InputPartition):
    """Subtrees to walk, and directories that were opened and only give their own row."""

    def __init__(self, subtrees: list[str], opened: list[str]):
        super().__init__(None)
        self.subtrees, self.opened = subtrees, opened


def file_md5(path: str) -> str:
    """Hex digest of a file's bytes, read in blocks; empty if it can't be read."""
    digest = hashlib.md5()
    try:
        with open(path, "rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
    except OSError:
        return ""
    return digest.hexdigest()


def _describe(path: str, is_dir: bool, hashed: bool):
    info = os.lstat(path)
    changed = datetime.fromtimestamp(info.st_mtime, timezone.utc).replace(tzinfo=None)
    size = 0 if is_dir else info.st_size
    return os.path.basename(path), path, size, changed, file_md5(path) if hashed and not is_dir else "", is_dir


def _is_dir(path: str) -> bool:
    return os.path.isdir(path) and not os.path.islink(path)


def walk(path: str, hashed: bool, deep: bool = True) -> Iterator[tuple]:
    """Visible entries at and, if ``deep``, below ``path``. Hidden names give no row, but hidden directories are entered."""
    stack = [path]
    while stack:
        here = stack.pop()
        is_dir = _is_dir(here)
        try:
            if not os.path.basename(here).startswith("."):
                yield _describe(here, is_dir, hashed)
            if is_dir and deep:
                stack.extend(sorted((e.path for e in os.scandir(here)), reverse=True))
        except OSError:
            continue  # unreadable entries are skipped, the scan goes on


def subtrees(root: str, enough: int) -> tuple[list[str], list[str]]:
    """At least so many subtrees below the root, if it has them, and the directories above them."""
    found, opened = deque([root]), []
    leaves: list[str] = []
    while found and len(found) + len(leaves) < enough:
        here = found.popleft()
        if not _is_dir(here):
            leaves.append(here)
            continue
        try:
            found.extend(sorted(e.path for e in os.scandir(here)))
            opened.append(here)
        except OSError:
            leaves.append(here)
    return [*leaves, *found], opened[1:]


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options.get("path", "")
        self.hashed = options.get("md5", "true").lower() == "true"

    def partitions(self):
        if not os.path.isdir(self.root):
            return [_Entries([], [])]
        found, opened = subtrees(self.root, PARTITIONS)
        found = [] if found == [self.root] else found  # the root itself is no entry
        n = max(1, min(PARTITIONS, len(found)))
        return [_Entries(found[k::n], opened[k::n]) for k in range(n)]

    def read(self, partition):
        for path in partition.opened:
            yield from walk(path, self.hashed, deep=False)
        for path in partition.subtrees:
            yield from walk(path, self.hashed)


class FileTreeSource(DataSource):
    """``spark.read.format("filetree").option("md5", "true").load(root)``"""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, md5: bool = True) -> DataFrame:
    """Entries below ``root``, which itself is none; a missing root has no rows."""
    spark.dataSource.register(FileTreeSource)
    return spark.read.format("filetree").option("md5", str(md5).lower()).load(root)
