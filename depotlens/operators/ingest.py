"""Writing items: validation, quarantine, first-wins dedupe and the media split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schemas import LIMITS, REQUEST_FIELDS, REQUIRED, SCAN_TYPES
from ..session import staged

MESSAGE_KEY = ("username", "message_id", "thread_id")


def violations(table: str, columns: list[str]) -> Column:
    """An array of what is wrong with a row; empty for a good one."""
    tests = [F.when(F.length(c) > n, F.lit(f"{c}: over {n} characters")) for c, n in LIMITS.get(table, {}).items() if c in columns]
    tests += [F.when(F.col(c).isNull(), F.lit(f"{c}: missing")) for c in REQUIRED.get(table, ()) if c in columns]
    tests += [F.when(F.instr(F.col(c), "\0") > 0, F.lit(f"{c}: has NUL")) for c in LIMITS.get(table, {}) if c in columns]
    return F.filter(F.array(*tests), lambda x: x.isNotNull()) if tests else F.array().cast("array<string>")


def quarantine(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with their ``errors``. A bad row never stops a scan."""
    marked = df.withColumn("errors", violations(table, df.columns))
    return marked.filter(F.size("errors") == 0).drop("errors"), marked.filter(F.size("errors") > 0)


def request_violations() -> Column:
    """What is wrong with a scan request, as an array of (field, code) in the order of the fields; empty for a good one.

    A request has ``scan_type`` and the columns of REQUEST_FIELDS, and is held to the fields of its own kind. Codes are
    REQUIRED (null), EMPTY (white space only), TOO_LONG (code points), INVALID_CHARS (a NUL in a path) and INVALID_VALUE
    (an unknown kind, which has no other errors).
    """

    def error(field: str, code: str, wrong: Column) -> Column:
        return F.when(wrong, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code")))

    kind = F.col("scan_type")
    blank = lambda c: ~F.col(c).rlike(r"[^ \t\n\r\f\x0B]")
    tests = [
        error("scan_type", "REQUIRED", kind.isNull()),
        error("scan_type", "EMPTY", blank("scan_type")),
        error("scan_type", "INVALID_VALUE", ~kind.isin(*SCAN_TYPES) & ~blank("scan_type")),
    ]
    for name, fields in REQUEST_FIELDS.items():
        mine = kind == name
        for field, (width, needed) in fields.items():
            if needed:
                tests += [error(field, "REQUIRED", mine & F.col(field).isNull()), error(field, "EMPTY", mine & blank(field))]
            tests.append(error(field, "TOO_LONG", mine & (F.length(field) > width)))
            if field == "path":
                tests.append(error(field, "INVALID_CHARS", mine & (F.instr(F.col(field), "\0") > 0)))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def check_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that may start a scan, and those refused with their ``errors``."""
    marked = df.withColumn("errors", request_violations())
    return marked.filter(F.size("errors") == 0).drop("errors"), marked.filter(F.size("errors") > 0)


def normalize_messages(df: DataFrame) -> DataFrame:
    """Cut the long text columns and flatten labels, as the table stores them."""
    return df.withColumns(
        {
            "mail_from": C.first_chars("mail_from", 500),
            "mail_to": C.first_chars("mail_to", 500),
            "subject": C.first_chars("subject", 2000),
            "labels": C.first_chars(C.join_labels("labels"), 500),
        }
    )


def dedupe_messages(incoming: DataFrame, stored: DataFrame | None = None, order: tuple[str, ...] = ("scan_id", "id")) -> DataFrame:
    """The first row of each (username, message_id, thread_id) not stored yet.

    First is by ``order``. ``min_by`` keeps one row for a key and task before the
    shuffle, where a window would move every copy.
    """
    rest = [c for c in incoming.columns if c not in MESSAGE_KEY]
    first = incoming.groupBy(*MESSAGE_KEY).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    out = first.select(*[F.col(c) if c in MESSAGE_KEY else F.col(f"_r.{c}") for c in incoming.columns])
    if stored is not None:
        same = [out[c].eqNullSafe(stored[c]) for c in MESSAGE_KEY]
        out = out.join(stored.select(*MESSAGE_KEY), same, "left_anti")
    return out


def split_media(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Media items into parents, photo children and video children (neither for other kinds)."""
    kind = F.substring("mime_type", 1, 5)
    parents = items.select("id", "media_item_id", "product_url", "mime_type", "filename", "size", "file_mod_time", "md5hash", "scan_id", "contributor_display_name")
    parent = F.col("id").alias("photos_media_item_id")
    photos = items.filter(kind == "image").select(parent, "camera_make", "camera_model", F.col("focal_length").cast("decimal(18,6)").alias("focal_length"), F.col("f_number").cast("decimal(18,6)").alias("f_number"), F.col("iso").cast("int").alias("iso"), "exposure_time")
    videos = items.filter(kind == "video").select(parent, "camera_make", "camera_model", F.col("fps").cast("decimal(18,6)").alias("fps"))
    return parents, photos, videos


def placed(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """The rows with ``_offset``, their place in this order from 0, and how many there are; no task gets them all.

    Rows are dealt by ranges and written once, so that each keeps its place; only the row count of
    each range is gathered, and its running sum is the range's offset.
    """
    by = [F.col(c).asc_nulls_last() for c in order]
    ranged = staged(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.col("_i") - F.shiftleft(F.col("_p").cast("bigint"), 33)
    joined = ranged.join(F.broadcast(offsets.select("_p", "_o")), "_p")  # one row for each range
    return joined.withColumn("_offset", F.col("_o") + local).drop("_p", "_i", "_o"), sizes.agg(F.sum("_n")).first()[0] or 0


def numbered(rows: DataFrame, start: int, column: str = "id") -> DataFrame:
    return rows.withColumn(column, F.lit(start) + F.col("_offset")).drop("_offset")


def with_ids(df: DataFrame, start: int, order: list[str], column: str = "id") -> DataFrame:
    """Dense ids from ``start`` in the given order."""
    return numbered(placed(df, order)[0], start, column)
