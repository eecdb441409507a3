"""The read surface: listings, counts and lookups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

PAGE_SIZE = 10


def page_of(df: DataFrame, order: str, page: int) -> DataFrame:
    """A page of 10 rows from page 1 on; plans as one top-k, never as a full sort."""
    if page < 1:
        raise ValueError(f"pages start at 1, not {page}")
    return df.orderBy(F.col(order).asc_nulls_last()).offset((page - 1) * PAGE_SIZE).limit(PAGE_SIZE)


def list_scans(scans: DataFrame, meta: DataFrame, page: int, as_of: datetime) -> DataFrame:
    """Scans with their metadata; a scan of several metadata rows is listed once for each.

    Every scan has at least one line, so a page lies within as many first scans as
    it and the pages before it have lines: only these meet their metadata, and only
    the page's own lines are put into form.
    """
    if page < 1:
        raise ValueError(f"pages start at 1, not {page}")
    first = scans.orderBy(F.col("id").asc_nulls_last()).limit(page * PAGE_SIZE)
    m = meta.select(F.col("scan_id").alias("_scan"), "name", "search_path", "search_filter")
    m = m.join(first.select(F.col("id").alias("_id")), F.col("_scan") == F.col("_id"), "left_semi")
    end = F.coalesce("scan_end_time", F.lit(as_of).cast("timestamp_ntz"))
    lines = first.join(m, F.col("id") == F.col("_scan"), "left")
    order = [F.col(c).asc_nulls_last() for c in ("id", "search_path", "search_filter", "name")]  # lines of one scan have an order too
    return lines.orderBy(*order).offset((page - 1) * PAGE_SIZE).limit(PAGE_SIZE).select(
        "id",
        "scan_type",
        C.utc_to_local("created_on").alias("created_on"),
        C.utc_to_local("scan_start_time").alias("scan_start_time"),
        "scan_end_time",
        C.concat_skip_null("search_path", "search_filter").alias("metadata"),
        C.duration_millis(F.col("scan_start_time"), end).alias("duration_ms"),
    )


def scan_requests(scans: DataFrame, meta: DataFrame, account: str | None) -> DataFrame:
    """An account's requests, the newest first; a blank account has none."""
    if not (account or "").strip():
        meta = meta.limit(0)
    m = meta.filter(F.col("name") == F.lit(account)).select(F.col("scan_id").alias("_scan"), "name", "search_path", "search_filter")
    return (
        scans.join(m, F.col("id") == F.col("_scan"))
        .select(
            "id",
            F.coalesce("name", F.lit("")).alias("name"),
            "scan_type",
            "search_filter",
            C.utc_to_local("scan_start_time").alias("scan_start_time"),
            C.duration_seconds("scan_start_time", "scan_end_time").alias("scan_duration_in_sec"),
        )
        .distinct()
        .orderBy(F.desc("id"))
    )


def list_of_scan(table: DataFrame, scan_id, page: int) -> DataFrame:
    """A page of the files, messages or media items of a scan."""
    return page_of(table.filter(F.col("scan_id") == scan_id), "id", page)


def count_of_scan(table: DataFrame, scan_id=None) -> int:
    return (table if scan_id is None else table.filter(F.col("scan_id") == scan_id)).count()


def counts_by_scan(table: DataFrame) -> DataFrame:
    return table.groupBy("scan_id").agg(F.count("*").alias("n"))


def linked_accounts(tokens: DataFrame) -> DataFrame:
    """Accounts by masked name; the tokens themselves are never selected."""
    return tokens.select(C.mask_account("display_name", "client_key").alias("display_name"), "client_key").distinct()


def scanned_accounts(meta: DataFrame) -> DataFrame:
    return meta.filter(F.col("name").isNotNull()).select("name").distinct().orderBy("name")


def scan_by_id(scans: DataFrame, scan_id: int) -> DataFrame:
    """No row for an unknown id; the facade raises there."""
    return scans.filter(F.col("id") == scan_id).select("id", "scan_type", "created_on", "scan_start_time", "scan_end_time", F.coalesce("status", F.lit("Completed")).alias("status"), "error_msg", "completed_at")


def token_for(tokens: DataFrame, client_key: str) -> DataFrame:
    return tokens.filter(F.col("client_key") == client_key)


def existing_messages(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """How often each incoming key is stored already."""
    key = ["username", "message_id", "thread_id"]
    n = stored.groupBy(*key).agg(F.count("*").alias("n"))
    return incoming.select(*key).distinct().join(n, key, "left").select(*key, F.coalesce("n", F.lit(0)).alias("n"))
