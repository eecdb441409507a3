"""Totals of directory trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """Every proper ancestor directory of a slash path: ``/a/b/c`` gives ``/a`` and ``/a/b``."""
    parts = F.split(path, "/")
    depth = F.size(parts)
    cut = lambda n: F.array_join(F.slice(parts, 1, n), "/")
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(depth - 1, F.lit(1))), cut), lambda d: (d != "") & (d != path))


def directory_totals(files: DataFrame, key: str = "scan_id") -> DataFrame:
    """Size and number of the files below every directory that holds any.

    The partial sums are taken before the shuffle, so that a top directory
    costs one row for each task however many files lie below it.
    """
    return (
        files.select(key, "size", F.explode(ancestors(F.col("path"))).alias("dir"))
        .groupBy(key, "dir")
        .agg(F.sum("size").alias("size"), F.count("*").alias("file_count"))
    )


def scan_entries(entries: DataFrame, root: str, key: str | None = None) -> DataFrame:
    """Raw entries of a walk with the totals of their directories filled in.

    The root has no row. Empty directories keep a row of (0, 0); files have no
    file_count. A file under a hidden directory counts for every visible one
    above it.
    """
    key_cols = [key] if key else []
    files = entries.filter(~F.col("is_dir"))
    totals = directory_totals(files if key else files.withColumn("_k", F.lit(0)), key or "_k")
    totals = totals.select(*key_cols, F.col("dir").alias("path"), F.col("size").alias("_s"), F.col("file_count").alias("_n"))
    joined = entries.join(totals, [*key_cols, "path"], "left").filter(F.col("path") != root.rstrip("/"))
    return joined.select(
        *[
            F.when(F.col("is_dir"), F.coalesce("_s", F.lit(0))).otherwise(F.col("size")).cast("bigint").alias("size") if c == "size" else F.col(c)
            for c in entries.columns
        ],
        F.when(F.col("is_dir"), F.coalesce("_n", F.lit(0))).cast("int").alias("file_count"),
    )
