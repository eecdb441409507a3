"""The facade: scans from request to listing, over a Store."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import SCAN_TYPES
from ..operators import ingest, paging, queries, retries, rollup
from ..schemas import CASCADE, TABLES, ddl
from ..sources import read_tree, remote
from .store import Store


def _listing_went_through(report: DataFrame) -> None:
    """Raise for the first listing that failed; a scan has a few listings at most."""
    failed = report.filter("failed_at IS NOT NULL").orderBy("listing").first()
    if failed:
        raise paging.ListingError(f"listing gave up at attempt {failed.failed_at} after {failed.failures} failures")


class Inventory:
    """Scan lifecycle and listings. ``now`` is passed in, so that runs repeat."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self.store.ensure()

    # lifecycle

    def start_scan(self, kind: str, now: datetime, name: str = "", path: str = "", search_filter: str = "") -> int:
        """Log a scan and its metadata; a scan is born Completed without an end, as its table's default says."""
        if kind not in SCAN_TYPES:
            raise ValueError(f"unknown scan type: {kind}")
        scan_id = self.store.reserve("scans")
        scan = self.spark.createDataFrame([(scan_id, SCAN_TYPES[kind], now, now, None, "Completed", None, None)], ddl("scans"))
        meta = self.spark.createDataFrame([(self.store.reserve("scanmetadata"), name, path, search_filter, scan_id)], ddl("scanmetadata"))
        self.store.append({"scans": scan, "scanmetadata": meta}, scan_id)
        return scan_id

    def _set(self, scan_id: int, **values) -> None:
        hit = F.lit(True)
        if "status" in values and values["status"] != "Failed":
            hit = ~F.col("status").eqNullSafe(F.lit("Failed"))  # failed stays failed
        change = {k: F.when(hit, F.lit(v).cast(TABLES["scans"][k])).otherwise(F.col(k)) for k, v in values.items()}
        self.store.rewrite("scans", scan_id, lambda scans: scans.withColumns(change))

    def complete(self, scan_id: int, now: datetime) -> None:
        self._set(scan_id, scan_end_time=now, status="Completed")

    def fail(self, scan_id: int, now: datetime, why: str) -> None:
        self._set(scan_id, scan_end_time=now, status="Failed", error_msg=why)

    def delete_scan(self, scan_id: int) -> None:
        """Delete a scan and all that hangs on it, in one published change that writes no rows; an unknown id changes nothing."""
        self.store.drop_scan(CASCADE, scan_id)

    # sinks

    def _carry_out(self, scan_id: int, now: datetime, work: Callable[[], DataFrame]) -> tuple[int, DataFrame]:
        """Do a scan's work and complete the scan, or mark it failed and pass the error on."""
        try:
            bad = work()
        except Exception as e:
            self.fail(scan_id, now, str(e).split("\n", 1)[0])
            raise
        self.complete(scan_id, now)
        return scan_id, bad

    def _numbered(self, table: str, rows: DataFrame, order: list[str]) -> DataFrame:
        """Rows with ids that no other writer gets."""
        placed, n = ingest.placed(rows, order)
        return ingest.numbered(placed, self.store.reserve(table, n))

    def _save(self, table: str, rows: DataFrame, order: list[str], scan_id: int) -> DataFrame:
        good, bad = ingest.quarantine(rows, table)
        self.store.append({table: self._numbered(table, good, order)}, scan_id)
        return bad

    def scan_local(self, root: str, now: datetime, md5: bool = True) -> tuple[int, DataFrame]:
        """Scan a file tree; returns the scan's id and the rejected rows."""
        scan_id = self.start_scan("Local", now, path=root)
        rows = rollup.scan_entries(read_tree(self.spark, root, md5), root).withColumn("scan_id", F.lit(scan_id))
        return self._carry_out(scan_id, now, lambda: self._save("scandata", rows, ["path"], scan_id))

    def scan_drive(self, pages: DataFrame, now: datetime, query: str = "") -> tuple[int, DataFrame]:
        """Files of recorded listing pages in any order; a missing page, a loop or an incomplete search fails the scan."""
        scan_id = self.start_scan("GDrive", now, search_filter=query)

        def work() -> DataFrame:
            whole = remote.in_order(pages, "incompleteSearch")
            return self._save("scandata", remote.drive_files(whole).withColumn("scan_id", F.lit(scan_id)), ["path"], scan_id)

        return self._carry_out(scan_id, now, work)

    def scan_mail(self, raw: DataFrame, username: str, now: datetime, search_filter: str = "", listing: DataFrame | None = None, attempts: DataFrame | None = None) -> tuple[int, DataFrame]:
        """Messages that no scan of the account has stored before.

        With the pages of a ``listing`` only messages on its chain are stored. With an
        ``attempts`` log (rows without an item are those of the listing) a listing that used up its
        tries fails the scan, and messages that did not get through are skipped.
        """
        from ..functions import mail_filter

        scan_id = self.start_scan("GMail", now, name=username, search_filter=search_filter)

        def work() -> DataFrame:
            wanted = raw
            if attempts is not None:
                _listing_went_through(retries.listings_in_a_row(attempts.filter("item IS NULL")))
                lost = retries.item_outcomes(attempts.filter("item IS NOT NULL"), ("item",)).filter("outcome <> 'stored'")
                wanted = wanted.join(lost.select(F.col("item").alias("id")), "id", "left_anti")
            if listing is not None:
                wanted = wanted.join(remote.listed_messages(listing).select("id"), "id", "left_semi")
            rows = remote.messages(wanted, username).filter(mail_filter(search_filter)).withColumn("scan_id", F.lit(scan_id))
            rows = ingest.dedupe_messages(ingest.normalize_messages(rows), self.store.read("messagemetadata"), ("date", "message_id"))
            return self._save("messagemetadata", rows, ["date", "message_id"], scan_id)

        return self._carry_out(scan_id, now, work)

    def stream_mail(self, raw: DataFrame, username: str, now: datetime, checkpoint: str, search_filter: str = "", scan_id: int | None = None) -> int:
        """A stream of raw messages, stored batch by batch until all that is there is read; with the ``scan_id`` of a scan that was cut short it goes on from the checkpoint."""
        from ..functions import mail_filter
        from ..streaming import sinks

        scan_id = self.start_scan("GMail", now, name=username, search_filter=search_filter) if scan_id is None else scan_id

        def work() -> None:
            rows = ingest.normalize_messages(remote.messages(raw, username).filter(mail_filter(search_filter)))
            sinks.mail_sink(rows, self.store, scan_id, checkpoint, f"mail-{scan_id}").awaitTermination()

        return self._carry_out(scan_id, now, work)[0]

    def progress_stream(self, events: DataFrame, path: str, checkpoint: str, every: int = 5, late: str = "10 minutes", **trigger):
        """Snapshots of running scans (client_key, scan_id, ts, listed, done, ended) to files at ``path``, every so many seconds and at each scan's end."""
        from ..streaming import sinks, ticker

        with sinks.state_store(self.spark, sinks.state_store.ROCKSDB):
            return sinks.append_files(ticker.ticks(events, every, late), path, checkpoint, **trigger)

    def scan_photos(
        self, raw: DataFrame, now: datetime, contents: DataFrame | None = None, fetch_size: bool = False, fetch_md5: bool = False, album: str = "", search: DataFrame | None = None, attempts: DataFrame | None = None
    ) -> tuple[int, DataFrame]:
        """Media items with their children, published together.

        With an ``album`` only the items that its ``search`` pages name are stored, each
        once; without one all are (or those on the full listing's pages, which have no album).
        A listing whose ``attempts`` used up the budget that its pages share fails the scan.
        """
        scan_id = self.start_scan("GPhotos", now)

        def work() -> DataFrame:
            if attempts is not None:
                _listing_went_through(retries.listings_by_budget(attempts))
            if album and search is None:
                raise ValueError("an album needs the pages of its search")
            wanted = raw if search is None else remote.album_items(raw, search, album)
            items = remote.media_items(wanted, contents, fetch_size, fetch_md5).withColumn("scan_id", F.lit(scan_id))
            good, bad = ingest.quarantine(items, "photosmediaitem")
            parents, photos, videos = ingest.split_media(self._numbered("photosmediaitem", good, ["media_item_id"]))
            child = lambda df, t: self._numbered(t, df, ["photos_media_item_id"])
            self.store.append({"photosmediaitem": parents, "photometadata": child(photos, "photometadata"), "videometadata": child(videos, "videometadata")}, scan_id)
            return bad

        return self._carry_out(scan_id, now, work)

    def list_albums(self, pages: DataFrame) -> tuple[DataFrame, str | None]:
        """Albums on recorded listing pages, and what ended the listing early; albums before that are returned all the same."""
        whole, fault = paging.chain_until_fault(pages)
        return remote.albums(whole), fault

    def save_token(self, **token) -> None:
        """Store an account's token; its client_key must be new at the moment of publishing, also when two writers store it."""
        row = {c: token.get(c) for c in TABLES["privatetokens"]} | {"id": self.store.reserve("privatetokens")}
        path = self.store.write("privatetokens", self.spark.createDataFrame([tuple(row.values())], ddl("privatetokens")))

        def change(m, base):
            if self.store.read("privatetokens", base).filter(F.col("client_key") == token["client_key"]).take(1):
                raise ValueError("client_key exists")
            return {**m, "privatetokens": [*m.get("privatetokens", []), path]}

        self.store.edit(change)

    def token(self, client_key: str) -> Row:
        found = queries.token_for(self.store.read("privatetokens"), client_key).take(1)
        if not found:
            raise KeyError("no token for this client key")
        return found[0]

    # listings: rows and total are read from one pinned version

    def list_scans(self, page: int, as_of: datetime) -> tuple[DataFrame, int]:
        v = self.store.version()
        scans = self.store.read("scans", v)
        return queries.list_scans(scans, self.store.read("scanmetadata", v), page, as_of), scans.count()

    def _list(self, table: str, scan_id: int, page: int) -> tuple[DataFrame, int]:
        df = self.store.read(table, self.store.version(), scan_id)
        return queries.list_of_scan(df, scan_id, page), queries.count_of_scan(df, scan_id)

    def list_files(self, scan_id: int, page: int = 1) -> tuple[DataFrame, int]:
        return self._list("scandata", scan_id, page)

    def list_messages(self, scan_id: int, page: int = 1) -> tuple[DataFrame, int]:
        return self._list("messagemetadata", scan_id, page)

    def list_photos(self, scan_id: int, page: int = 1) -> tuple[DataFrame, int]:
        return self._list("photosmediaitem", scan_id, page)

    def scan_requests(self, account: str) -> DataFrame:
        return queries.scan_requests(self.store.read("scans"), self.store.read("scanmetadata"), account)

    def scanned_accounts(self) -> DataFrame:
        return queries.scanned_accounts(self.store.read("scanmetadata"))

    def linked_accounts(self) -> DataFrame:
        return queries.linked_accounts(self.store.read("privatetokens"))

    def scan(self, scan_id: int) -> Row:
        found = queries.scan_by_id(self.store.read("scans", scan_id=scan_id), scan_id).take(1)
        if not found:
            raise KeyError(f"no scan {scan_id}")
        return found[0]
