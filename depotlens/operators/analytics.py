"""Duplicates, comparisons and space reports over inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .running import running_sums

CONTENT = ("md5hash", "size")


def known_contents(files: DataFrame) -> DataFrame:
    """Files whose content was read. Directories have none, and an empty or missing hash says that it is not known; neither is ever a duplicate."""
    return files.filter(~F.coalesce("is_dir", F.lit(False)) & (F.coalesce("md5hash", F.lit("")) != ""))


def duplicates_within(files: DataFrame) -> DataFrame:
    """Contents that a scan holds more than once, with the space their copies take."""
    return (
        known_contents(files)
        .groupBy("scan_id", *CONTENT)
        .agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
        .filter("copies > 1")
        .withColumn("wasted", (F.col("copies") - 1) * F.col("size"))
    )


def duplicates_across(files: DataFrame) -> DataFrame:
    """Contents that several scans hold. Scans are reduced first, so one content's copies stay small."""
    by_scan = known_contents(files).groupBy(*CONTENT, "scan_id").agg(F.count("*").alias("n"))
    return by_scan.groupBy(*CONTENT).agg(F.count("*").alias("scans"), F.sum("n").alias("copies")).filter("scans > 1")


def size_collisions(files: DataFrame) -> DataFrame:
    """Files whose size another file shares: the only ones whose bytes need hashing."""
    sizes = files.groupBy("size").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return files.join(sizes, "size", "left_semi")


def below_root(files: DataFrame, root: str) -> DataFrame:
    """Files with ``path`` counted from a scan's root, so that two scans of different places compare."""
    top = root.rstrip("/") + "/"
    return files.withColumn("path", F.when(F.startswith("path", F.lit(top)), F.substr("path", F.lit(len(top) + 1))).otherwise(F.col("path")))


def _key(left: DataFrame, key: str | None) -> str:
    """What two scans are compared by: the path, or the name for inventories without paths."""
    return key or ("path" if "path" in left.columns else "name")


def only_left(left: DataFrame, right: DataFrame, key: str | None = None) -> DataFrame:
    key = _key(left, key)
    return left.join(right.select(key).distinct(), key, "left_anti")


def _side(files: DataFrame, side: str, key: str) -> DataFrame:
    """One row for each key of a side: its file of the smallest id. Directories are not compared; a key that repeats never multiplies."""
    first = F.min_by(F.struct("size", "md5hash"), F.struct("id" if "id" in files.columns else F.lit(0), "size", "md5hash"))
    kept = files.filter(~F.coalesce("is_dir", F.lit(False))) if "is_dir" in files.columns else files
    return kept.groupBy(key).agg(first.alias("_f")).select(key, F.col("_f.size").alias(f"size_{side}"), F.col("_f.md5hash").alias(f"md5_{side}"), F.lit(True).alias(f"_{side}"))


def changed(left: DataFrame, right: DataFrame, key: str | None = None) -> DataFrame:
    """Same key on both sides, another size or hash (nulls compare as values)."""
    key = _key(left, key)
    differs = ~F.col("size_left").eqNullSafe(F.col("size_right")) | ~F.col("md5_left").eqNullSafe(F.col("md5_right"))
    return _side(left, "left", key).join(_side(right, "right", key), key).filter(differs).drop("_left", "_right")


def full_diff(left: DataFrame, right: DataFrame, key: str | None = None) -> DataFrame:
    """Every key of either side as ONLY_LEFT, ONLY_RIGHT, CHANGED or SAME."""
    key = _key(left, key)
    same = F.col("size_left").eqNullSafe(F.col("size_right")) & F.col("md5_left").eqNullSafe(F.col("md5_right"))
    state = F.when(F.col("_right").isNull(), "ONLY_LEFT").when(F.col("_left").isNull(), "ONLY_RIGHT").when(same, "SAME").otherwise("CHANGED")
    return _side(left, "left", key).join(_side(right, "right", key), key, "full").withColumn("state", state).drop("_left", "_right")


def sync_plan(left: DataFrame, right: DataFrame, key: str | None = None) -> DataFrame:
    """What would make the right side hold what the left side does; nothing is carried out.

    Of each known content the k-th file that only the left side has, in order of key, takes over the k-th
    that only the right side has: MOVE from ``other`` there, whose own row is MOVED to ``other``. The rest is COPY,
    UPDATE where a key's content changed, and NOOP. Places among the copies of a content are counted in
    two levels, so a content with very many copies is spread over the tasks.
    """
    key = _key(left, key)
    diff = staged(full_diff(left, right, key))

    def ranked(side: str, state: str) -> DataFrame:
        known = diff.filter((F.col("state") == state) & (F.coalesce(f"md5_{side}", F.lit("")) != "") & F.col(f"size_{side}").isNotNull())
        rows = known.select(F.col(key).alias(f"_{side}"), F.col(f"md5_{side}").alias("_md5"), F.col(f"size_{side}").alias("_size"))
        return running_sums(rows, ["_md5", "_size"], [f"_{side}"], {"_k": F.lit(1)})

    pairs = staged(ranked("left", "ONLY_LEFT").join(ranked("right", "ONLY_RIGHT"), ["_md5", "_size", "_k"]).select("_left", "_right"))
    there = pairs.select(F.col("_left").alias("_key"), F.col("_right").alias("other")).union(pairs.select("_right", "_left"))
    action = F.when(F.col("state") == "CHANGED", "UPDATE").when(F.col("state") == "SAME", "NOOP")
    action = action.when(F.col("state") == "ONLY_LEFT", F.when(F.col("other").isNull(), "COPY").otherwise("MOVE")).otherwise(F.when(F.col("other").isNull(), "NOOP").otherwise("MOVED"))
    return diff.join(there, F.col(key) == F.col("_key"), "left").drop("_key").withColumn("action", action)


def keeper_plan(files: DataFrame) -> DataFrame:
    """For each duplicate file KEEP (the smallest id of its content) or DELETE. A plan only.

    Directories and files whose content was never read are in no plan. The keeper comes
    from an aggregate and a join, which Spark can split where one content has very many
    copies; a window could not be split.
    """
    known = known_contents(files)
    groups = known.groupBy(*CONTENT).agg(F.min("id").alias("keep_id"), F.count("*").alias("copies")).filter("copies > 1")
    return (
        known.join(groups, [*CONTENT])
        .withColumn("action", F.when(F.col("id") == F.col("keep_id"), "KEEP").otherwise("DELETE"))
        .select("id", "scan_id", *CONTENT, "keep_id", "copies", "action")
    )


def folder_name_plan(folders: DataFrame) -> DataFrame:
    """For folders equal but for case and outer blanks: the most frequent spelling (ties: the smallest) as the new name."""
    norm = F.lower(F.trim("name"))
    spelled = folders.groupBy(norm.alias("norm"), "name").agg(F.count("*").alias("n"))
    best = spelled.groupBy("norm").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("new_name"), F.count("*").alias("spellings")).filter("spellings > 1")
    return folders.withColumn("norm", norm).join(best, "norm").filter(F.col("name") != F.col("new_name")).select("id", "scan_id", F.col("name").alias("old_name"), "new_name")


def space_by(messages: DataFrame, column: str) -> DataFrame:
    """Messages and bytes by sender, thread or another column."""
    return messages.groupBy(column).agg(F.count("*").alias("messages"), F.sum("size_estimate").alias("bytes"))


def largest_groups(space: DataFrame, column: str, k: int) -> DataFrame:
    """The k senders, labels or threads that take most space; ties go to more messages, then to the smaller value, nulls last. One top-k, no full sort."""
    return space.orderBy(F.desc("bytes"), F.desc("messages"), F.col(column).asc_nulls_last()).limit(k)


def space_by_label(messages: DataFrame) -> DataFrame:
    each = messages.select("size_estimate", F.explode(F.split("labels", ",")).alias("label")).filter(F.col("label") != "")
    return space_by(each, "label")


def largest(df: DataFrame, k: int, size: str = "size") -> DataFrame:
    """The k largest items; sizes that were never fetched (-1) don't count."""
    return df.filter(F.col(size) >= 0).orderBy(F.desc(size), F.asc("id")).limit(k)


def largest_per_scan(df: DataFrame, k: int, size: str = "size") -> DataFrame:
    """The k largest files of each scan, directories left out. Rank limits are pushed below the shuffle, so a scan moves k rows a task."""
    w = Window.partitionBy("scan_id").orderBy(F.desc(size), F.asc("id"))
    files = df.filter(~F.coalesce("is_dir", F.lit(False))) if "is_dir" in df.columns else df
    return files.filter(F.col(size) >= 0).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def album_sizes(media: DataFrame, members: DataFrame) -> DataFrame:
    """Items and fetched bytes of each album (album, id); an item counts in every album it is in."""
    there = members.join(media.select(F.col("media_item_id").alias("id"), "size"), "id")
    return there.groupBy("album").agg(F.count("*").alias("items"), F.sum(F.when(F.col("size") >= 0, F.col("size"))).alias("bytes"))


def scan_stats(files: DataFrame) -> DataFrame:
    is_dir = F.col("is_dir")
    return files.groupBy("scan_id").agg(
        F.count_if(~is_dir).alias("num_files"), F.count_if(is_dir).alias("num_folders"), F.coalesce(F.sum(F.when(~is_dir, F.col("size"))), F.lit(0)).alias("total_size")
    )


def survivors(tables: dict[str, DataFrame], scan_id: int) -> dict[str, DataFrame]:
    """What every table keeps when a scan is deleted, children of its media items included."""
    keep = lambda df, c="scan_id": df.filter(~F.col(c).eqNullSafe(F.lit(scan_id)))
    gone = tables["photosmediaitem"].filter(F.col("scan_id") == scan_id).select(F.col("id").alias("photos_media_item_id"))
    out = {t: keep(tables[t]) for t in ("photosmediaitem", "messagemetadata", "scandata", "scanmetadata") if t in tables}
    out |= {t: tables[t].join(gone, "photos_media_item_id", "left_anti").select(*tables[t].columns) for t in ("photometadata", "videometadata") if t in tables}
    if "scans" in tables:
        out["scans"] = keep(tables["scans"], "id")
    return out
