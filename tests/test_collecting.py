"""Scans over recorded pages: chains, albums and retries through the facade."""

import json
from datetime import datetime

import pytest

from depotlens import schemas
from depotlens.operators import paging
from depotlens.plans import Inventory
from depotlens.sources import remote

NOW = datetime(2024, 1, 1)


@pytest.fixture
def inventory(spark, tmp_path):
    return Inventory(spark, str(tmp_path / "store"))


def decode(spark, rows, schema):
    return remote.decode(spark.createDataFrame([(json.dumps(r),) for r in rows], "j string"), "j", schema)


def drive(spark, *pages):
    file = lambda i: {"id": i, "name": i, "mimeType": "text/plain", "size": 1, "modifiedTime": "2024-01-01T00:00:00Z"}
    return decode(spark, [{"files": [file(i) for i in ids], "pageToken": token, "nextPageToken": after, "incompleteSearch": bad} for token, after, ids, bad in pages], schemas.DRIVE_PAGE)


def state(inventory, scan_id=None):
    scan = inventory.scan(scan_id or inventory.list_scans(1, NOW)[0].first().id)
    return scan.id, scan.status, scan.error_msg


def test_drive_pages_in_any_order(inventory, spark):
    scan, _ = inventory.scan_drive(drive(spark, ("b", None, ["f4"], False), (None, "a", ["f1", "f2"], False), ("x", "b", ["off"], False), ("a", "b", ["f3"], False), ("a", "b", ["f3"], False)), NOW)
    assert [r.name for r in inventory.list_files(scan)[0].collect()] == ["f1", "f2", "f3", "f4"]


@pytest.mark.parametrize("pages,why", [([(None, "a", ["f1"], False)], "missing page"), ([(None, "a", ["f1"], False), ("a", "a", ["f2"], False)], "loop"), ([(None, "a", ["f1"], False), ("a", None, ["f2"], True)], "incomplete search"), ([("a", None, ["f2"], False)], "no first page")])
def test_faults_fail_a_drive_scan(inventory, spark, pages, why):
    with pytest.raises(paging.ListingError, match=why):
        inventory.scan_drive(drive(spark, *pages), NOW)
    scan, status, error = state(inventory)
    assert status == "Failed" and why in error and inventory.list_files(scan)[1] == 0


def media(spark, *ids):
    return decode(spark, [{"id": i, "productUrl": "u", "baseUrl": "b", "mimeType": "image/png", "filename": i, "mediaMetadata": {"creationTime": "2024-01-01T00:00:00Z"}} for i in ids], schemas.MEDIA_ITEM)


def search(spark, *pages):
    return decode(spark, [{"albumId": album, "mediaItems": [{"id": i} for i in ids], "pageToken": token, "nextPageToken": after} for album, token, after, ids in pages], schemas.SEARCH_PAGE)


def test_photos_of_an_album(inventory, spark):
    raw = media(spark, "p1", "p2", "p3", "p4")
    pages = search(spark, ("one", "x", None, ["p3", "p1"]), ("one", None, "x", ["p1"]), ("two", None, None, ["p1", "p2"]), ("none", None, None, []), (None, None, None, ["p1", "p2", "p4"]))
    contents = spark.createDataFrame([(f"p{i}", b"x" * i) for i in range(1, 5)], "id string, content binary")
    stored = lambda scan: sorted((r.media_item_id, r.size) for r in inventory.list_photos(scan)[0].collect())
    assert stored(inventory.scan_photos(raw, NOW, contents, True, album="one", search=pages)[0]) == [("p1", 1), ("p3", 3)]
    assert stored(inventory.scan_photos(raw, NOW, album="two", search=pages)[0]) == [("p1", -1), ("p2", -1)]
    assert stored(inventory.scan_photos(raw, NOW, album="none", search=pages)[0]) == []
    assert [i for i, _ in stored(inventory.scan_photos(raw, NOW, search=pages)[0])] == ["p1", "p2", "p4"]
    assert len(stored(inventory.scan_photos(raw, NOW)[0])) == 4
    with pytest.raises(paging.ListingError, match="no first page"):
        inventory.scan_photos(raw, NOW, album="unknown", search=pages)
    assert state(inventory, 6)[1] == "Failed"


def test_albums_before_an_error_are_listed(inventory, spark):
    page = lambda token, after, *ids: {"albums": [{"id": i, "title": i.upper()} for i in ids], "pageToken": token, "nextPageToken": after}
    albums, fault = inventory.list_albums(decode(spark, [page("t", "gone", "b", "c"), page(None, "t", "a")], schemas.ALBUM_PAGE))
    assert sorted(r.title for r in albums.collect()) == ["A", "B", "C"] and fault == paging.MISSING
    albums, fault = inventory.list_albums(decode(spark, [page(None, None, "a")], schemas.ALBUM_PAGE))
    assert albums.count() == 1 and fault is None


def mail(spark, *ids):
    return decode(spark, [{"id": i, "threadId": "t", "labelIds": ["INBOX"], "internalDate": 1704067200000, "sizeEstimate": 1} for i in ids], schemas.MESSAGE)


def test_mail_follows_its_listing_and_skips_what_failed(inventory, spark):
    pages = decode(spark, [{"messages": [{"id": "m2", "threadId": "t"}, {"id": "m3", "threadId": "t"}], "pageToken": "x", "nextPageToken": None}, {"messages": [{"id": "m1", "threadId": "t"}], "nextPageToken": "x"}], schemas.MESSAGE_PAGE)
    log = [(None, 1, 429), (None, 2, 429), (None, 3, 200), ("m1", 4, 200), ("m2", 5, 404), ("m3", 6, 429), ("m3", 7, 429), ("m3", 8, 200)]
    attempts = spark.createDataFrame([("l", item, at, code, None) for item, at, code in log], schemas.ATTEMPT)
    scan, _ = inventory.scan_mail(mail(spark, "m1", "m2", "m3", "m4"), "u", NOW, listing=pages, attempts=attempts)
    assert sorted(r.message_id for r in inventory.list_messages(scan)[0].collect()) == ["m1", "m3"]
    assert state(inventory, scan)[1] == "Completed"


def test_a_listing_that_used_up_its_tries_fails_the_scan(inventory, spark):
    attempts = spark.createDataFrame([("l", None, k, 429, None) for k in range(3)], schemas.ATTEMPT)
    with pytest.raises(paging.ListingError, match="gave up at attempt 2 after 3 failures"):
        inventory.scan_mail(mail(spark, "m1"), "u", NOW, attempts=attempts)
    assert state(inventory)[1] == "Failed"
    many = lambda n: spark.createDataFrame([("l", None, k, 500, None) for k in range(n)], schemas.ATTEMPT)
    assert inventory.list_photos(inventory.scan_photos(media(spark, "p1"), NOW, attempts=many(25))[0])[1] == 1
    with pytest.raises(paging.ListingError, match="after 26 failures"):
        inventory.scan_photos(media(spark, "p1"), NOW, attempts=many(26))
