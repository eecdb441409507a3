"""Recorded connector pages to the columns of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import columns as C
from ..operators import paging

FOLDER = "application/vnd.google-apps.folder"


def read_pages(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines with a fixed schema: only the named fields are decoded."""
    return spark.read.schema(schema).json(path)


def decode(df: DataFrame, column: str, schema) -> DataFrame:
    """Typed decode of a JSON text column into the columns of ``schema``."""
    return df.select(F.from_json(F.col(column), schema).alias("_j")).select("_j.*")


def paged(pages: DataFrame) -> bool:
    """Whether recorded pages know the token they were asked by."""
    return {"pageToken", "nextPageToken"} <= set(pages.columns)


def in_order(pages: DataFrame, incomplete: str | None = None) -> DataFrame:
    """The pages of one listing along their tokens, a fault raising ListingError; pages without tokens are taken as they are."""
    return paging.whole_chain(pages, incomplete=incomplete) if paged(pages) else pages


def listed_messages(pages: DataFrame) -> DataFrame:
    """Ids (id, threadId) on the pages of a mail listing."""
    return in_order(pages).select(F.explode("messages").alias("m")).select("m.id", "m.threadId").distinct()


def album_members(pages: DataFrame) -> DataFrame:
    """(album, id) once each, from all pages of album searches; an item may be in several albums."""
    return pages.select(F.coalesce("albumId", F.lit("")).alias("album"), F.explode("mediaItems").alias("i")).select("album", "i.id").distinct()


def album_items(raw: DataFrame, pages: DataFrame, album: str = "") -> DataFrame:
    """The media items of one album's search, or, with no album, of the full listing (pages without an album).

    Items are chosen by a semi-join before anything of them is probed, so one that is on several pages comes once.
    An album that no page answers is unknown: ListingError. One with empty pages has no items.
    """
    own = pages.filter(F.coalesce("albumId", F.lit("")) == (album or ""))
    return raw.join(album_members(in_order(own)).select("id"), "id", "left_semi")


def drive_files(pages: DataFrame) -> DataFrame:
    """Files of listing pages; folders are left out and the path is the file's id.

    A page of an incomplete search stops the job when it is read.
    """
    whole = pages.withColumn("files", F.when(F.coalesce("incompleteSearch", F.lit(False)), F.raise_error(F.lit("incomplete search"))).otherwise(F.col("files")))
    f = whole.select(F.explode("files").alias("f")).select("f.*")
    return f.filter(~F.coalesce(F.col("mimeType") == FOLDER, F.lit(False))).select(
        "name",
        F.col("id").alias("path"),
        "size",
        C.parse_rfc3339("modifiedTime").alias("file_mod_time"),
        F.coalesce("md5Checksum", F.lit("")).alias("md5hash"),
        F.lit(False).alias("is_dir"),
    )


def messages(raw: DataFrame, username: str | None = None) -> DataFrame:
    """Messages with the three headers that are kept."""
    headers = F.col("payload.headers")
    return raw.select(
        F.col("id").alias("message_id"),
        F.col("threadId").alias("thread_id"),
        F.lit(username).cast("string").alias("username"),
        C.millis_to_timestamp("internalDate").alias("date"),
        C.header_value(headers, "From").alias("mail_from"),
        C.header_value(headers, "To").alias("mail_to"),
        C.header_value(headers, "Subject").alias("subject"),
        F.col("sizeEstimate").alias("size_estimate"),
        F.col("labelIds").alias("labels"),
    )


def media_items(raw: DataFrame, contents: DataFrame | None = None, fetch_size: bool = False, fetch_md5: bool = False) -> DataFrame:
    """Media items with EXIF by kind.

    ``contents`` (id, content binary) stands for the downloads. Size is -1 where
    it was not asked for and 0 where the content is missing.
    """
    kind = F.substring("mimeType", 1, 5)
    photo, video = F.col("mediaMetadata.photo"), F.col("mediaMetadata.video")
    if contents is not None and (fetch_size or fetch_md5):
        probe = contents.join(raw.select("id"), "id", "left_semi")  # only what is wanted is hashed
        probe = probe.select(F.col("id"), F.length("content").cast("bigint").alias("_size"), F.md5("content").alias("_md5"))
        raw = raw.join(probe, "id", "left")
    else:
        raw = raw.withColumns({"_size": F.lit(None).cast("bigint"), "_md5": F.lit(None).cast("string")})
    size = F.coalesce("_size", F.lit(0).cast("bigint")) if fetch_size or fetch_md5 else F.lit(-1).cast("bigint")
    pick = lambda a, b: F.when(kind == "image", a).when(kind == "video", b)
    return raw.select(
        F.col("id").alias("media_item_id"),
        F.col("productUrl").alias("product_url"),
        F.col("mimeType").alias("mime_type"),
        "filename",
        size.alias("size"),
        C.parse_utc_seconds("mediaMetadata.creationTime").alias("file_mod_time"),
        (F.coalesce("_md5", F.lit("")) if fetch_md5 else F.lit("")).alias("md5hash"),
        F.col("contributorInfo.displayName").alias("contributor_display_name"),
        C.content_url("baseUrl", "mimeType").alias("content_url"),
        pick(photo["cameraMake"], video["cameraMake"]).alias("camera_make"),
        pick(photo["cameraModel"], video["cameraModel"]).alias("camera_model"),
        F.when(kind == "image", photo["focalLength"]).alias("focal_length"),
        F.when(kind == "image", photo["apertureFNumber"]).alias("f_number"),
        F.when(kind == "image", photo["isoEquivalent"]).alias("iso"),
        F.when(kind == "image", photo["exposureTime"]).alias("exposure_time"),
        F.when(kind == "video", video["fps"]).alias("fps"),
    )


def albums(pages: DataFrame) -> DataFrame:
    """Albums on listing pages, one row for each."""
    return pages.select(F.explode("albums").alias("a")).select("a.*")
