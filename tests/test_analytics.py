"""Duplicates, diffs, moves, renames and staged hashes on small inventories."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from depotlens.operators import analytics, contents, renames
from depotlens.plans import Inventory
from depotlens.sources import blocks

NOW = datetime(2024, 1, 1)
FILE = "id bigint, scan_id bigint, path string, size bigint, md5hash string, is_dir boolean"


def files(spark, *rows):
    return spark.createDataFrame([(i, s, p, n, h, d) for i, s, p, n, h, d in rows], FILE)


def test_folders_and_unread_files_are_no_duplicates(spark):
    df = files(spark, (1, 1, "/a", 5, "h", False), (2, 1, "/b", 5, "h", False), (3, 1, "/c", 5, "", False), (4, 1, "/d", 5, "", False), (5, 2, "/e", 5, None, False), (6, 2, "/f", 5, None, False), (7, 1, "/g", 5, "", True), (8, 2, "/h", 5, "h", True), (9, 2, "/i", 5, "h", None))
    assert {r.id: r.action for r in analytics.keeper_plan(df).collect()} == {1: "KEEP", 2: "DELETE", 9: "DELETE"}
    assert [(r.scan_id, r.md5hash, r.copies) for r in analytics.duplicates_within(df).collect()] == [(1, "h", 2)]
    assert [(r.md5hash, r.scans, r.copies) for r in analytics.duplicates_across(df).collect()] == [("h", 2, 3)]
    assert {r.id for r in analytics.largest_per_scan(df, 10).collect()} == {1, 2, 3, 4, 5, 6, 9}


def test_no_folder_of_a_scanned_tree_is_deleted(spark, tmp_path):
    """Stored rows end to end: folders of one size, empty folders, and files that were not read."""
    for p, text in (("x/a.txt", "hello"), ("y/b.txt", "world"), ("y/c.txt", "hello")):
        (tmp_path / "tree" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / p).write_text(text)
    for p in ("x/e1", "y/e2"):
        (tmp_path / "tree" / p).mkdir()
    inventory = Inventory(spark, str(tmp_path / "store"))
    inventory.scan_local(str(tmp_path / "tree"), NOW)
    plan = analytics.keeper_plan(inventory.store.read("scandata")).join(inventory.store.read("scandata").select("id", "path"), "id")
    assert sorted((r.path.rsplit("/", 1)[1], r.action) for r in plan.collect()) == [("a.txt", "KEEP"), ("c.txt", "DELETE")]
    inventory.scan_local(str(tmp_path / "tree"), NOW, md5=False)
    assert analytics.keeper_plan(inventory.store.read("scandata").filter("scan_id = 2")).count() == 0


def test_diffs_go_by_path_and_never_multiply(spark):
    left = files(spark, *[(i, 1, f"/l/{i}/README.md", i % 7, f"h{i % 7}", False) for i in range(50)], (90, 1, "/l/d", 9, "", True), (91, 1, "/l/0/README.md", 99, "late", False))
    right = files(spark, *[(i, 2, f"/r/{i}/README.md", i % 7, f"h{i % 7}", False) for i in range(49)])
    a, b = analytics.below_root(left, "/l"), analytics.below_root(right, "/r/")
    assert {(r.state): r["count"] for r in analytics.full_diff(a, b).groupBy("state").count().collect()} == {"SAME": 49, "ONLY_LEFT": 1}
    assert analytics.changed(a, b).count() == 0
    named = lambda df: df.withColumn("name", F.lit("README.md"))
    assert analytics.full_diff(named(a), named(b), "name").count() == 1
    assert [r.path for r in analytics.only_left(a.filter("NOT is_dir"), b).collect()] == ["49/README.md"]


def test_moves_take_the_copies_that_are_there(spark):
    left = files(spark, *[(i, 1, p, 5, "x", False) for i, p in enumerate(["/a", "/b", "/c"])], (7, 1, "/same", 1, "s", False), (8, 1, "/new", 5, "", False), (9, 1, "/upd", 2, "u2", False), (10, 1, "/z", 6, "x", False))
    right = files(spark, *[(i, 2, p, 5, "x", False) for i, p in enumerate(["/q", "/p"])], (7, 2, "/same", 1, "s", False), (8, 2, "/old", 5, "", False), (9, 2, "/upd", 2, "u", False), (11, 2, "/none", 5, None, False))
    got = {r.path: (r.action, r.other) for r in analytics.sync_plan(left, right).collect()}
    assert got == {"/a": ("MOVE", "/p"), "/b": ("MOVE", "/q"), "/c": ("COPY", None), "/p": ("MOVED", "/a"), "/q": ("MOVED", "/b"), "/same": ("NOOP", None), "/new": ("COPY", None), "/old": ("NOOP", None), "/upd": ("UPDATE", None), "/z": ("COPY", None), "/none": ("NOOP", None)}
    assert analytics.sync_plan(left.limit(0), right.limit(0)).count() == 0


def test_a_hot_content_moves_each_copy_once(spark):
    side = lambda p, n: spark.range(n).select("id", F.lit(1).cast("bigint").alias("scan_id"), F.format_string(f"/{p}/%06d", "id").alias("path"), F.lit(5).cast("bigint").alias("size"), F.lit("x").alias("md5hash"), F.lit(False).alias("is_dir"))
    plan = analytics.sync_plan(side("l", 3000), side("r", 2000))
    assert {r.action: (r["count"], r.n) for r in plan.groupBy("action").agg(F.count("*").alias("count"), F.count_distinct("other").alias("n")).collect()} == {"MOVE": (2000, 2000), "COPY": (1000, 0), "MOVED": (2000, 2000)}
    assert plan.filter("action = 'MOVE' AND substr(path, 3) <> substr(other, 3)").count() == 0


def paths(spark, *rows):
    return spark.createDataFrame([(1, p) for p in rows], "scan_id bigint, path string")


def test_nested_renames_reach_the_files_below(spark):
    """Three renames on one way, each decided by the most frequent spelling."""
    df = paths(spark, "/Docs/Photos/Trip/a.txt", "/docs/photos /trip/b.txt", "/x/docs/c", "/y/docs/c", "/x/Photos/c", "/y/Photos/c", "/x/trip/c", "/y/trip/c", "/top.txt", "noslash", None)
    got = {r.path: (r.new_path, r.conflict) for r in renames.renamed_paths(df).collect()}
    assert got["/Docs/Photos/Trip/a.txt"] == ("/docs/Photos/trip/a.txt", False)
    assert got["/docs/photos /trip/b.txt"] == ("/docs/Photos/trip/b.txt", False)
    assert got["/top.txt"] == ("/top.txt", False) and got["noslash"] == ("noslash", False) and len(got) == 10
    steps = [(r.depth, r.folder, r.path_then, r.new_path, r.merges) for r in renames.rename_steps(df).orderBy("depth", "folder").collect()]
    assert steps == [
        (1, "/Docs", "/Docs", "/docs", True),
        (2, "/docs/photos ", "/docs/photos ", "/docs/Photos", True),
        (3, "/Docs/Photos/Trip", "/docs/Photos/Trip", "/docs/Photos/trip", True),
    ]
    at = {"/Docs/Photos/Trip/a.txt": "/Docs/Photos/Trip/a.txt", "/docs/photos /trip/b.txt": "/docs/photos /trip/b.txt"}
    for _, _, old, new, _ in steps:  # carried out one after the other
        at = {k: new + p[len(old) :] if p.startswith(old + "/") else p for k, p in at.items()}
    assert all(got[k][0] == p for k, p in at.items())


def test_siblings_that_meet_are_reported(spark):
    got = {r.path: (r.new_path, r.conflict) for r in renames.renamed_paths(paths(spark, "/A/f", "/a/f", "/a/g", "/x/a/f")).collect()}
    assert got == {"/A/f": ("/a/f", True), "/a/f": ("/a/f", True), "/a/g": ("/a/g", False), "/x/a/f": ("/x/a/f", False)}
    assert renames.renamed_paths(paths(spark)).count() == renames.rename_steps(paths(spark)).count() == 0


def planted(tmp_path, seed=1):
    """Files with duplicates, equal sizes, equal ends with different middles, and empty ones."""
    rng = random.Random(seed)
    big = rng.randbytes(1000)
    middle = bytearray(big)
    middle[500] ^= 1
    small = b"0123456789"
    made = {"big1": big, "d/big2": big, "big3": bytes(middle), "other": rng.randbytes(1000), "lone": rng.randbytes(777), "s1": small, "s2": small, "s3": small[::-1], "e1": b"", "e2": b"", "edge1": big[:200], "edge2": big[:200], "d/edge3": big[:199] + b"!"}
    for name, content in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return {str(tmp_path / n): c for n, c in made.items()}


@pytest.mark.parametrize("task_bytes", [1, 1500, 1 << 28])
def test_staged_hashes_find_the_duplicates_of_full_hashes(spark, tmp_path, monkeypatch, task_bytes):
    made = planted(tmp_path)
    df = spark.createDataFrame([(p, len(c)) for p, c in made.items()] + [(str(tmp_path / "gone"), 1000), (str(tmp_path / "unknown"), None)], "path string, size bigint")
    got = {r.key: r for r in contents.staged_hashes(df, blocks.FileBlocks(task_bytes), "path", block=100).collect()}
    groups = {}
    for p, r in got.items():
        if r.md5hash:
            groups.setdefault((r.size, r.md5hash), set()).add(p)
    want = {}
    for p, c in made.items():
        want.setdefault(c, set()).add(p)
    assert sorted(map(sorted, (g for g in groups.values() if len(g) > 1))) == sorted(map(sorted, (g for g in want.values() if len(g) > 1)))
    read = {p.rsplit("/", 1)[1]: r.bytes_read for p, r in got.items()}
    assert read == {"big1": 1200, "big2": 1200, "big3": 1200, "other": 200, "lone": 0, "s1": 10, "s2": 10, "s3": 10, "e1": 0, "e2": 0, "edge1": 200, "edge2": 200, "edge3": 200, "gone": 0, "unknown": 0}
    stages = {p.rsplit("/", 1)[1]: r.stage for p, r in got.items()}
    assert stages["big1"] == "whole" and stages["other"] == "edges" and stages["lone"] == "size"
    table = spark.createDataFrame(list(made.items()), "id string, content binary")
    for few in (contents.FEW, 3):  # keys sent to the contents, or digests to the keys
        monkeypatch.setattr(contents, "FEW", few)
        native = {r.key: (r.md5hash, r.bytes_read) for r in contents.staged_hashes(table.select("id", F.octet_length("content").alias("size")), contents.StoredContents(table), block=100).collect()}
        assert native == {p: (got[p].md5hash, got[p].bytes_read) for p in made}


def test_file_tasks_are_balanced_by_bytes(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") < 10, 5000).otherwise(10).cast("bigint").alias("size"))
    dealt = blocks.FileBlocks(6000)._hash(rows, None, F.col("size"))
    n = dealt.rdd.getNumPartitions()
    assert 10 <= n <= 11


def test_largest_groups_order_ties(spark):
    m = spark.createDataFrame([("b", 5), ("a", 5), ("c", 2), ("c", 3), (None, 5), ("d", None)], "mail_from string, size_estimate bigint")
    got = analytics.largest_groups(analytics.space_by(m, "mail_from"), "mail_from", 4)
    assert [(r.mail_from, r.bytes) for r in got.collect()] == [("c", 5), ("a", 5), ("b", 5), (None, 5)]
