import json
import pathlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from depotlens import schemas
from depotlens.operators import analytics, ingest, queries, rollup
from depotlens.plans import Inventory
from depotlens.plans.store import Conflict, Store
from depotlens.sources import read_tree, remote
from depotlens.sources import tree as tree_source

NOW = datetime(2024, 1, 1)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "test"
    for path, size in (("folder1/test_file.txt", 5), ("folder2/file2.txt", 1), ("folder2/folder3/another_file.txt", 3), ("folder2/folder3/test_file.txt", 4), ("a/.h.txt", 9), ("a/.hid/cfg", 2), ("a/.hid/vis/deep", 7)):
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * size)
    (root / "a/empty").mkdir()
    return root


def test_tree_totals(spark, tree):
    rows = {r.path.removeprefix(f"{tree}/"): r for r in rollup.scan_entries(read_tree(spark, str(tree)), str(tree)).collect()}
    assert (rows["folder1"].size, rows["folder2"].size, rows["folder2/folder3"].size) == (5, 8, 7)
    assert (rows["folder2"].file_count, rows["folder2/file2.txt"].file_count) == (3, None)
    assert (rows["a/empty"].size, rows["a/empty"].file_count) == (0, 0)
    assert (rows["a"].size, rows["a"].file_count) == (9, 2)
    assert "a/.h.txt" not in rows and "a/.hid" not in rows and "" not in rows
    assert {"a/.hid/cfg", "a/.hid/vis", "a/.hid/vis/deep"} <= set(rows)
    assert rows["folder1/test_file.txt"].md5hash == "fb0e22c79ac75679e9881e6ba183b354"


def test_missing_root_has_no_rows(spark, tmp_path):
    assert read_tree(spark, str(tmp_path / "none")).count() == 0


@pytest.fixture
def inventory(spark, tmp_path):
    return Inventory(spark, str(tmp_path / "store"))


def _mail(spark, tmp_path, ids):
    path = tmp_path / f"mail{len(ids)}.json"
    path.write_text("\n".join(json.dumps({"id": i, "threadId": t, "labelIds": ["INBOX"], "internalDate": 1704067200000, "sizeEstimate": n, "payload": {"headers": [{"name": "Subject", "value": "s" * 2001}]}}) for i, t, n in ids))
    return remote.read_pages(spark, str(path), schemas.MESSAGE)


def test_mail_scan_and_rescan(inventory, spark, tmp_path):
    one, bad = inventory.scan_mail(_mail(spark, tmp_path, [("m1", "t1", 1024), ("m2", "t2", 2048)]), "u", NOW)
    rows, total = inventory.list_messages(one)
    assert total == 2 and [len(r.subject) for r in rows.collect()] == [2000, 2000]
    assert inventory.scan(one).status == "Completed"
    two, _ = inventory.scan_mail(_mail(spark, tmp_path, [("m1", "t1", 1024), ("m2", "t2", 2048), ("m3", "t3", 1)]), "u", NOW)
    assert [r.message_id for r in inventory.list_messages(two)[0].collect()] == ["m3"]
    other, _ = inventory.scan_mail(_mail(spark, tmp_path, [("m1", "t1", 1024), ("m2", "t2", 2048)]), "v", NOW)
    assert inventory.list_messages(other)[1] == 2
    assert [r.name for r in inventory.scanned_accounts().collect()] == ["u", "v"]
    assert inventory.scan_requests("u").count() == 2 and inventory.scan_requests(" ").count() == 0


def test_lifecycle_and_delete(inventory, spark, tree):
    scan, bad = inventory.scan_local(str(tree), NOW)
    rows, total = inventory.list_files(scan)
    assert rows.count() == 10 and total == 12
    failed = inventory.start_scan("GDrive", NOW)
    inventory.fail(failed, NOW, "why")
    inventory.complete(failed, NOW)
    assert inventory.scan(failed).status == "Failed" and inventory.scan(failed).error_msg == "why"
    with pytest.raises(ValueError):
        inventory.start_scan("GStorage", NOW)
    inventory.delete_scan(99)
    assert inventory.list_files(scan)[1] == 12
    inventory.delete_scan(scan)
    assert inventory.list_files(scan)[1] == 0
    with pytest.raises(KeyError):
        inventory.scan(scan)
    assert inventory.list_scans(1, NOW)[1] == 1


def test_photos_publish_parents_with_children(inventory, spark):
    rows = [json.dumps({"id": f"p{i}", "productUrl": "u", "baseUrl": "b", "mimeType": m, "filename": "f", "mediaMetadata": {"creationTime": "2024-01-01T00:00:00Z", "photo": {"cameraMake": "c", "isoEquivalent": 100}}}) for i, m in enumerate(["image/jpeg", "video/mp4", "text/plain", "im"])]
    raw = remote.decode(spark.createDataFrame([(r,) for r in rows], "j string"), "j", schemas.MEDIA_ITEM)
    scan, bad = inventory.scan_photos(raw, NOW)
    assert inventory.list_photos(scan)[1] == 4 and bad.count() == 0
    store = inventory.store
    assert store.read("photometadata").count() == 1 and store.read("videometadata").count() == 1
    assert {r.size for r in store.read("photosmediaitem").collect()} == {-1}
    inventory.delete_scan(scan)
    assert store.read("photometadata").count() == 0


def test_a_second_publisher_fails(inventory):
    base = inventory.store.version()
    inventory.start_scan("Local", NOW)
    with pytest.raises(Conflict):
        inventory.store.publish({}, base)


def test_two_writers_get_different_ids_and_lose_nothing(inventory, spark, monkeypatch):
    """A second writer publishes between any two steps of the first."""
    other, publish, turns = Inventory(spark, inventory.store.root), Store.publish, []

    def slow(store, manifest, base):
        if store is inventory.store:
            turns.append(1)
            if len(turns) % 2:
                other.start_scan("GMail", NOW, name="other")
        return publish(store, manifest, base)

    monkeypatch.setattr(Store, "publish", slow)
    ids = [inventory.start_scan("Local", NOW, name="mine") for _ in range(2)]
    monkeypatch.setattr(Store, "publish", publish)
    scans = [r.id for r in inventory.store.read("scans").collect()]
    meta = [(r.id, r.scan_id, r.name) for r in inventory.store.read("scanmetadata").collect()]
    assert len(set(scans)) == len(scans) and set(ids) < set(scans) and len(scans) > 4
    assert len({i for i, _, _ in meta}) == len(meta) == len(scans) and {s for _, s, n in meta if n == "mine"} == set(ids)
    inventory.fail(ids[0], NOW, "why")
    assert [inventory.scan(i).status for i in ids] == ["Failed", "Completed"]


def test_a_client_key_is_stored_once_also_by_two_writers(inventory, spark, monkeypatch):
    other, publish = Inventory(spark, inventory.store.root), Store.publish
    inventory.save_token(client_key="a", created_on=NOW)
    with pytest.raises(ValueError, match="exists"):
        inventory.save_token(client_key="a", created_on=NOW)

    def slow(store, manifest, base):
        if store is inventory.store and manifest["privatetokens"] != inventory.store.manifest(base)["privatetokens"]:
            other.save_token(client_key="b", created_on=NOW)
        return publish(store, manifest, base)

    monkeypatch.setattr(Store, "publish", slow)
    with pytest.raises(ValueError, match="exists"):
        inventory.save_token(client_key="b", created_on=NOW, access_token="late")
    assert sorted(r.client_key for r in inventory.store.read("privatetokens").collect()) == ["a", "b"] and inventory.token("b").access_token is None


def test_deleting_and_completing_touch_no_other_scan(inventory, spark, tree):
    first, _ = inventory.scan_local(str(tree), NOW)
    second, _ = inventory.scan_local(str(tree), NOW)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in pathlib.Path(inventory.store.root).rglob("*.parquet")}
    before, kept = files(), inventory.store.manifest()
    inventory.delete_scan(first)
    assert files() == before  # no file written
    assert [d for d in inventory.store.manifest()["scandata"]] == [d for d in kept["scandata"] if f"scan_id={second}/" in d]
    inventory.fail(second, NOW, "late")
    new = set(files()) - set(before)
    assert new and all(f"/scans/scan_id={second}/" in p for p in new)
    plan = inventory.list_files(second)[0]._jdf.queryExecution().toString()
    assert f"scan_id={first}/" not in plan
    assert inventory.store.vacuum() >= 3 and not [p for p in files() if f"scan_id={first}/" in p]
    assert inventory.list_files(second)[1] == 12 and inventory.scan(second).status == "Failed"


def test_an_older_store_is_brought_up_step_by_step(spark, tmp_path):
    """Files from before the status columns are read with their defaults, and ids go on behind theirs."""
    store = Store(spark, str(tmp_path / "old"))
    old = spark.createDataFrame([(7, "local", NOW, NOW, None)], "id bigint, scan_type string, created_on timestamp_ntz, scan_start_time timestamp_ntz, scan_end_time timestamp_ntz")
    old.write.parquet(f"{store.root}/scans/first")
    store.publish({"scans": [f"{store.root}/scans/first"]}, 0)
    inventory = Inventory(spark, store.root)
    assert inventory.scan(7).status == "Completed" and inventory.scan(7).error_msg is None
    assert inventory.start_scan("Local", NOW) == 8
    inventory.fail(7, NOW, "late")
    assert (inventory.scan(7).status, inventory.scan(7).error_msg, inventory.scan(8).status) == ("Failed", "late", "Completed")
    inventory.delete_scan(7)
    assert [r.id for r in store.read("scans").collect()] == [8]
    version = store.version()
    Inventory(spark, store.root)
    assert store.version() == version  # a current store is left alone
    store.edit(lambda m, base: {**m, "_version": 99})
    with pytest.raises(ValueError, match="99"):
        Inventory(spark, store.root)


def test_quarantine_keeps_the_scan_going(spark):
    df = spark.createDataFrame([("ok", 1), ("x" * 201, 1), ("n", None)], "name string, scan_id bigint")
    good, bad = ingest.quarantine(df, "scandata")
    assert [r.name for r in good.collect()] == ["ok"]
    assert sorted(r.errors[0] for r in bad.collect()) == ["name: over 200 characters", "scan_id: missing"]


def test_requests_are_refused_with_codes(spark):
    columns = ("scan_type", "path", "query_string", "filter", "refresh_token", "client_key", "username", "album_id")
    rows = {
        ("Local", "/a") + (None,) * 6: [],
        ("Local", None) + (None,) * 6: ["path:REQUIRED"],
        ("Local", " \t\n") + (None,) * 6: ["path:EMPTY"],
        ("Local", "é" * 1000) + (None,) * 6: [],
        ("Local", "x" * 1001 + "\0") + (None,) * 6: ["path:TOO_LONG", "path:INVALID_CHARS"],
        ("local", "/a") + (None,) * 6: ["scan_type:INVALID_VALUE"],
        (None,) * 8: ["scan_type:REQUIRED"],
        ("",) + (None,) * 7: ["scan_type:EMPTY"],
        ("GDrive", None, "q" * 501, None, "t", None, None, None): ["query_string:TOO_LONG"],
        ("GMail", None, None, None, "t", "", "u" * 101, None): ["client_key:EMPTY", "username:TOO_LONG"],
        ("GPhotos", None, None, "f" * 900, "t" * 801, None, None, "a" * 101): ["album_id:TOO_LONG", "refresh_token:TOO_LONG"],
    }
    good, bad = ingest.check_requests(spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in columns)))
    assert {tuple(r)[:8]: [f"{e.field}:{e.code}" for e in r.errors] for r in bad.collect()} == {k: v for k, v in rows.items() if v}
    assert {tuple(r) for r in good.collect()} == {k for k, v in rows.items() if not v}


def test_pages(spark):
    df = spark.range(1, 26).select("id", F.lit(1).alias("scan_id"))
    assert [queries.list_of_scan(df, 1, p).count() for p in (1, 3, 4)] == [10, 5, 0]
    with pytest.raises(ValueError):
        queries.list_of_scan(df, 1, 0)


def test_drive_incomplete_search_fails(spark):
    pages = remote.decode(spark.createDataFrame([('{"files":[{"id":"a","name":"n","mimeType":"x"}],"incompleteSearch":true}',)], "j string"), "j", schemas.DRIVE_PAGE)
    with pytest.raises(Exception, match="incomplete search"):
        remote.drive_files(pages).collect()


def test_a_failed_collection_fails_its_scan(inventory, spark):
    pages = remote.decode(spark.createDataFrame([('{"files":[{"id":"a","name":"n","mimeType":"x"}],"incompleteSearch":true}',)], "j string"), "j", schemas.DRIVE_PAGE)
    with pytest.raises(Exception, match="incomplete search"):
        inventory.scan_drive(pages, NOW)
    scan = inventory.list_scans(1, NOW)[0].first()
    found = inventory.scan(scan.id)
    assert found.status == "Failed" and found.error_msg and inventory.list_files(scan.id)[1] == 0


def test_a_deep_tree_is_dealt_to_many_partitions(tmp_path):
    paths = {f"top/d{i}/e{k}/f" for i in range(20) for k in range(3)} | {"top/.hid/x", "one"}
    for p in paths:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    for enough in (1, 2, 5, 30, 1000):
        found, opened = tree_source.subtrees(str(tmp_path), enough)
        rows = [r for x in opened for r in tree_source.walk(x, False, deep=False)] + [r for x in found for r in tree_source.walk(x, False)]
        names = sorted(r[1].removeprefix(f"{tmp_path}/") for r in rows if r[1] != str(tmp_path))
        dirs = {"top", *(f"top/d{i}" for i in range(20)), *(f"top/d{i}/e{k}" for i in range(20) for k in range(3))}
        assert names == sorted(paths | dirs) and len(found) >= min(enough, 20)


def test_diff_with_itself_is_same(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "h")], "name string, size bigint, md5hash string")
    assert {r.state for r in analytics.full_diff(df, df).collect()} == {"SAME"}


def test_dedupe_twice_is_once(spark):
    m = spark.createDataFrame([(2, 1, "u", "m", "t"), (1, 1, "u", "m", "t"), (3, 1, "u", "m", None)], "id bigint, scan_id bigint, username string, message_id string, thread_id string")
    once = ingest.dedupe_messages(m)
    assert sorted(r.id for r in once.collect()) == [1, 3]
    assert ingest.dedupe_messages(m, once).count() == 0


def test_empty_inputs(spark):
    f = spark.createDataFrame([], schemas.ddl("scandata"))
    for df in (analytics.duplicates_within(f), analytics.duplicates_across(f), analytics.keeper_plan(f), rollup.directory_totals(f), analytics.largest_per_scan(f, 3), ingest.with_ids(f.drop("id"), 1, ["path"])):
        assert df.count() == 0
