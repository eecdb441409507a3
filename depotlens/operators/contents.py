"""Content hashes by stages: only what can still be a duplicate is read.

Files of a size that no other file has are never read. Of the others the first and the last
block are hashed, and whole files only where size and both blocks agree. A file that
two blocks cover is read once. How rows are hashed is up to a Hasher:
``StoredContents`` for contents in a table, ``sources.blocks.FileBlocks`` for files on disk.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

BLOCK = 65_536
#: Keys that may be broadcast to stored contents.
FEW = 10_000
#: Content of no bytes, which nobody has to read.
EMPTY = "d41d8cd98f00b204e9800998ecf8427e"


class Hasher(Protocol):
    """(key, digest, bytes_read) of rows (key, size): of the first and the last block, or of all. The digest is '' where content can't be read."""

    def edges(self, rows: DataFrame, block: int) -> DataFrame: ...

    def whole(self, rows: DataFrame) -> DataFrame: ...


class StoredContents:
    """Contents in a table (key, content binary). All is native: blocks are cut out before they are hashed.

    Contents are never shuffled. Up to FEW wanted keys, which a count checks, are sent to them; of more, all contents
    are hashed where they lie and their digests meet the keys, as hashing costs less than moving (``bytes_read`` still counts the wanted ones alone).
    """

    def __init__(self, contents: DataFrame, key: str = "id", content: str = "content"):
        self.contents = contents.select(F.col(key).alias("key"), F.col(content).alias("_content"))

    def _hash(self, rows: DataFrame, part) -> DataFrame:
        hashed = lambda df: df.withColumn("_part", part).select("key", F.coalesce(F.md5("_part"), F.lit("")).alias("digest"), F.coalesce(F.octet_length("_part"), F.lit(0)).cast("bigint").alias("bytes_read"))
        keys = rows.select("key")
        if keys.limit(FEW + 1).count() <= FEW:
            return hashed(self.contents.join(F.broadcast(keys), "key"))
        return hashed(self.contents).join(keys, "key")

    def edges(self, rows: DataFrame, block: int) -> DataFrame:
        c = F.col("_content")
        both = F.concat(F.substring(c, 1, block), F.substring(c, -block, block))
        return self._hash(rows, F.when(F.octet_length(c) <= 2 * block, c).otherwise(both))

    def whole(self, rows: DataFrame) -> DataFrame:
        return self._hash(rows, F.col("_content"))


def _shared(rows: DataFrame, *by: str) -> DataFrame:
    """Rows whose values another row shares; counts are summed in the tasks before they are shuffled."""
    groups = rows.groupBy(*by).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return rows.join(groups, list(by), "left_semi")


def staged_hashes(files: DataFrame, hasher: Hasher, key: str = "id", block: int = BLOCK) -> DataFrame:
    """(key, size, md5hash, stage, bytes_read) of every file: the hash of its content where another file may have the same, else ''.

    ``stage`` is how far it was looked at: size, edges or whole. Files of no bytes have a known
    hash. Files without a size, and files that can't be read, are never duplicates.
    """
    rows = files.select(F.col(key).alias("key"), F.col("size").cast("bigint").alias("size"))
    read = staged(_shared(rows.filter("size > 0"), "size"))
    edges = staged(read.join(hasher.edges(read, block), "key"))
    small = F.col("size") <= 2 * block
    whole = staged(hasher.whole(_shared(edges.filter(~small & (F.col("digest") != "")), "size", "digest")))
    seen = edges.select("key", F.col("digest").alias("_edge"), F.col("bytes_read").alias("_read")).join(whole.select("key", F.col("digest").alias("_whole"), F.col("bytes_read").alias("_more")), "key", "left")
    stage = F.when(F.col("_edge").isNull(), "size").when(F.col("_whole").isNull(), "edges").otherwise("whole")
    known = F.when(F.col("size") == 0, EMPTY).when(F.col("_whole").isNotNull(), F.col("_whole")).when(small, F.col("_edge"))
    return rows.join(seen, "key", "left").select("key", "size", F.coalesce(known, F.lit("")).alias("md5hash"), stage.alias("stage"), (F.coalesce("_read", F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("bytes_read"))
