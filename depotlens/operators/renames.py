"""Making folder names consistent, down to the paths of everything below.

Folders equal but for case and outer blanks get one spelling (see
``analytics.folder_name_plan``). A renamed folder changes the path of all that lies below it, and
renames may nest, so paths are rewritten component by component: the distinct folders are
taken apart once, each name meets its new spelling by an equi-join, and the folders are put
together again. Files follow their folder by one more join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parent(path: Column | str) -> Column:
    """What lies before the last slash; '' for a path at the top."""
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(p, "^(.*)/[^/]*$", 1)


def folders_above(paths: DataFrame) -> DataFrame:
    """(scan_id, folder) of every folder on the way to a path, once each."""
    parts = F.split(parent("path"), "/")
    up_to = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return paths.select("scan_id", F.explode(up_to).alias("folder")).filter("folder <> ''").distinct()


def spellings(folders: DataFrame) -> DataFrame:
    """(scan_id, name, new_name) of folder names that change: the most frequent spelling wins, ties go to the smallest."""
    named = folders.select("scan_id", F.element_at(F.split("folder", "/"), -1).alias("name"))
    counted = named.groupBy("scan_id", F.lower(F.trim("name")).alias("norm"), "name").agg(F.count("*").alias("n"))
    best = counted.groupBy("scan_id", "norm").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("new_name"), F.count("*").alias("spelled")).filter("spelled > 1")
    there = best.select(F.col("scan_id").alias("_s"), F.col("norm").alias("_n"), "new_name")
    return counted.join(there, F.col("scan_id").eqNullSafe(F.col("_s")) & (F.col("norm") == F.col("_n"))).filter(F.col("name") != F.col("new_name")).select("scan_id", "name", "new_name")


def _renamed(folders: DataFrame, names: DataFrame) -> DataFrame:
    """(scan_id, folder, new_folder, depth, new_name): every folder with its final path, and its own new name if that changes."""
    there = names.select(F.col("scan_id").alias("_s"), F.col("name").alias("_old"), "new_name")
    each = folders.select("scan_id", "folder", F.posexplode(F.split("folder", "/")).alias("_at", "_name"))
    met = each.join(there, F.col("scan_id").eqNullSafe(F.col("_s")) & (F.col("_name") == F.col("_old")), "left")
    parts = F.array_sort(F.collect_list(F.struct("_at", F.coalesce("new_name", "_name").alias("name"), "new_name")))  # the depth of one folder
    whole = met.groupBy("scan_id", "folder").agg(parts.alias("_parts"))
    return whole.select("scan_id", "folder", F.array_join(F.col("_parts")["name"], "/").alias("new_folder"), (F.size("_parts") - 1).alias("depth"), F.element_at("_parts", -1)["new_name"].alias("new_name"))


def rename_steps(paths: DataFrame) -> DataFrame:
    """(scan_id, depth, folder, path_then, new_path, merges): renames to carry out by depth, the least first.

    ``path_then`` is where the folder lies when the folders above have been renamed. ``merges`` tells that
    another folder ends at the same path, so that the two become one.
    """
    folders = folders_above(paths)
    done = _renamed(folders, spellings(folders))
    ends = done.groupBy("scan_id", "new_folder").agg(F.count("*").alias("_n"))
    there = ends.select(F.col("scan_id").alias("_s"), F.col("new_folder").alias("_f"), "_n")
    steps = done.filter("new_name IS NOT NULL").join(there, F.col("scan_id").eqNullSafe(F.col("_s")) & (F.col("new_folder") == F.col("_f")))
    then = F.concat(parent("new_folder"), F.lit("/"), F.element_at(F.split("folder", "/"), -1))
    return steps.select("scan_id", "depth", "folder", F.when(F.col("folder").contains("/"), then).otherwise(F.col("folder")).alias("path_then"), F.col("new_folder").alias("new_path"), (F.col("_n") > 1).alias("merges"))


def renamed_paths(paths: DataFrame) -> DataFrame:
    """(scan_id, path, new_path, conflict) of every distinct path (scan_id, path); a conflict is a path that another one ends at too.

    Names of files never change. Null paths are left out.
    """
    files = paths.select("scan_id", "path").filter("path IS NOT NULL").distinct().withColumn("_folder", parent("path"))
    folders = folders_above(files)
    done = _renamed(folders, spellings(folders)).select(F.col("scan_id").alias("_s"), F.col("folder").alias("_f"), "new_folder")
    moved = files.join(done, F.col("scan_id").eqNullSafe(F.col("_s")) & (F.col("_folder") == F.col("_f")), "left")
    name = F.element_at(F.split("path", "/"), -1)
    new = F.when(F.col("new_folder").isNull(), F.col("path")).otherwise(F.concat("new_folder", F.lit("/"), name))
    moved = moved.select("scan_id", "path", new.alias("new_path"))
    meets = moved.groupBy("scan_id", "new_path").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("scan_id").alias("_s"), F.col("new_path").alias("_p"), "_n")
    out = moved.join(meets, F.col("scan_id").eqNullSafe(F.col("_s")) & (F.col("new_path") == F.col("_p")), "left")
    return out.select("scan_id", "path", "new_path", F.col("_n").isNotNull().alias("conflict"))
