"""The driver's tables seen as inventories, so that every operator has input to run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.contents import StoredContents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: a scan for each source."""
    name = F.format_string("doc_%d.txt", "doc_id")
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"),
        name.alias("name"),
        F.concat(F.lit("/"), "lang", F.lit("/"), "source", F.lit("/"), name).alias("path"),
        F.octet_length(text).cast("bigint").alias("size"),
        F.md5(text.cast("binary")).alias("md5hash"),
        F.lit(False).alias("is_dir"),
        F.lit(None).cast("int").alias("file_count"),
        F.substring("source", 4, 10).cast("bigint").alias("scan_id"),
    )


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Files as a scan stores them: those over 20,000 bytes were not read, of those under 60 the hash is missing, and every language is a folder."""
    f = files(spark, d).withColumn("md5hash", F.when(F.col("size") > 20_000, F.lit("")).when(F.col("size") >= 60, F.col("md5hash")))
    place = F.regexp_extract("path", "^/([^/]*)/", 1)
    dirs = f.groupBy("scan_id", place.alias("name")).agg((F.min("id") + 10**9).alias("id"), F.count("*").cast("int").alias("file_count"))
    rows = dirs.select("id", "name", F.concat(F.lit("/"), "name").alias("path"), F.lit(4096).cast("bigint").alias("size"), F.lit("").alias("md5hash"), F.lit(True).alias("is_dir"), "file_count", "scan_id")
    return f.unionByName(rows)


def spelled_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of pages whose folders are spelled in several ways: hosts of plain http and languages of pages with parameters in capitals."""
    part = lambda k: F.regexp_extract("url", "^[a-z]+://([^/]*)/([^/]*)/([^?#]*)", k)
    host = F.when(F.startswith("url", F.lit("http:")), F.upper(part(1))).otherwise(part(1))
    lang = F.when(F.contains("url", F.lit("?")), F.upper(part(2))).otherwise(part(2))
    return table(spark, d, "pages").select(F.lit(1).cast("bigint").alias("scan_id"), F.concat_ws("/", F.lit(""), host, lang, F.regexp_replace(part(3), "/", "")).alias("path"))


def page_paths(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files of one scan, by the path of their address."""
    bare = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+:/", "")
    return table(spark, d, "pages").select(F.lit(1).cast("bigint").alias("scan_id"), bare.alias("path"), F.octet_length("html").cast("bigint").alias("size"))


def raw_messages(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns in the shape that the mail connector returns."""
    h = lambda k, v: F.struct(F.lit(k).alias("name"), v.alias("value"))
    headers = F.array(h("From", F.lit("first")), h("From", F.col("role")), h("to", F.col("role")), h("Subject", F.col("text")))
    return table(spark, d, "conversations").select(
        F.col("turn").cast("string").alias("id"),
        F.col("conv_id").cast("string").alias("threadId"),
        F.array(F.lit("INBOX"), F.upper("role")).alias("labelIds"),
        (F.lit(1704067200123) + F.col("conv_id") * 1000 + F.col("turn")).alias("internalDate"),
        F.octet_length("text").cast("bigint").alias("sizeEstimate"),
        F.struct(headers.alias("headers")).alias("payload"),
    )


def messages(spark: SparkSession, d: str, turns: DataFrame | None = None) -> DataFrame:
    """Stored messages: a scan for each tenth of the conversations."""
    rows = table(spark, d, "conversations") if turns is None else turns
    return rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("turn").cast("string").alias("message_id"),
        F.col("conv_id").cast("string").alias("thread_id"),
        F.lit("u").alias("username"),
        F.col("role").alias("mail_from"),
        F.left("text", F.lit(2000)).alias("subject"),  # as wide as the store's column
        F.octet_length("text").cast("bigint").alias("size_estimate"),
        F.concat(F.lit("INBOX,"), F.upper("role")).alias("labels"),
        F.call_function("mod", F.col("conv_id"), F.lit(10)).alias("scan_id"),
    )


def repeated_messages(spark: SparkSession, d: str, turns: DataFrame | None = None) -> DataFrame:
    """The messages twice: as they are, and seen again by a later scan."""
    m = messages(spark, d, turns)
    return m.unionByName(m.withColumns({"scan_id": F.col("scan_id") + 100, "id": F.col("id") + 10**9}))


def scans(spark: SparkSession, d: str) -> DataFrame:
    """Orders as scans; every tenth still runs."""
    kinds = {"1-URGENT": "local", "2-HIGH": "google_drive", "3-MEDIUM": "gmail"}
    kind = F.lit("photos")
    for k, v in kinds.items():
        kind = F.when(F.col("o_orderpriority") == k, v).otherwise(kind)
    end = F.timestamp_add("SECOND", F.call_function("mod", F.col("o_orderkey"), F.lit(3600)), F.col("o_orderdate"))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        kind.alias("scan_type"),
        F.col("o_orderdate").alias("created_on"),
        F.col("o_orderdate").alias("scan_start_time"),
        F.when(F.col("o_orderkey") % 10 != 0, end).alias("scan_end_time"),
        F.when(F.col("o_orderstatus") == "F", F.lit("Failed")).when(F.col("o_orderstatus") == "O", F.lit("Completed")).alias("status"),
        F.lit(None).cast("string").alias("error_msg"),
        F.lit(None).cast("timestamp_ntz").alias("completed_at"),
        F.col("o_custkey").alias("_cust"),
    )


def scan_metadata(spark: SparkSession, d: str) -> DataFrame:
    """A scan's account is its customer; scans that found nothing have no metadata and failed ones have two rows."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    found = table(spark, d, "lineitem").select("l_orderkey").distinct()
    m = o.join(c, o.o_custkey == c.c_custkey).join(found, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    paths = F.when(F.col("o_orderstatus") == "F", F.array("c_mktsegment", F.lit("second"))).otherwise(F.array("c_mktsegment"))
    return m.select("o_orderkey", F.col("c_name").alias("name"), F.explode(paths).alias("search_path"), F.lit(None).cast("string").alias("search_filter"), F.col("o_orderkey").alias("scan_id"))


def media(spark: SparkSession, d: str) -> DataFrame:
    """Parts as media items: photos, videos and neither."""
    mime = F.when(F.col("p_type").like("PROMO%"), "image/jpeg").when(F.col("p_type").like("STANDARD%"), "video/mp4").otherwise("text/plain")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("m"), F.col("p_partkey")).alias("media_item_id"),
        F.concat(F.lit("https://example.org/"), F.col("p_partkey")).alias("product_url"),
        mime.alias("mime_type"),
        F.col("p_name").alias("filename"),
        F.when(F.col("p_partkey") % 5 == 0, F.lit(-1)).otherwise(F.col("p_size") * 1000).cast("bigint").alias("size"),
        F.lit(None).cast("timestamp_ntz").alias("file_mod_time"),
        F.lit("").alias("md5hash"),
        (F.col("p_partkey") % 4).alias("scan_id"),
        F.lit(None).cast("string").alias("contributor_display_name"),
        F.col("p_brand").alias("camera_make"),
        F.col("p_type").alias("camera_model"),
        F.col("p_retailprice").alias("focal_length"),
        F.lit(2.8).alias("f_number"),
        F.col("p_size").alias("iso"),
        F.lit("1/60").alias("exposure_time"),
        F.lit(29.97).alias("fps"),
    )


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as linked accounts; secrets are fixed dummies."""
    mail = F.concat(F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]", "")), F.lit("@example.org"))
    return table(spark, d, "supplier").select(
        F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).when(F.col("s_suppkey") % 3 == 1, mail).otherwise(F.lit("abc@example.org")).alias("display_name"),
        F.concat(F.lit("key-"), F.col("s_suppkey")).alias("client_key"),
        F.lit("x").alias("access_token"),
    )


def item_events(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    """Events as the items of running scans."""
    e = table(spark, d, "events") if events is None else events
    return e.select(F.col("user_id").alias("scan_id"), (F.col("event_type") != "error").alias("done"), "ts")


def listing_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as recorded listing pages: a source's documents by twenties of ids, in no order.

    A page with a text of under 5 characters is of an incomplete search, one with a text of over
    50,000 wasn't recorded, and the last page of an odd source leads back to its second.
    """
    number = F.call_function("div", F.col("doc_id"), F.lit(20))
    size = F.length("text")
    cut = table(spark, d, "documents").groupBy(F.col("source").alias("listing"), number.alias("p")).agg(
        F.sort_array(F.collect_list("doc_id")).alias("files"), F.coalesce(F.bool_or(size < 5), F.lit(False)).alias("incompleteSearch"), F.coalesce(F.bool_or(size > 50_000), F.lit(False)).alias("lost")
    )
    w = Window.partitionBy("listing").orderBy("p")
    token = lambda p: F.md5(F.concat_ws("/", F.col("listing"), p.cast("string")).cast("binary"))
    ranked = cut.withColumns({"n": F.row_number().over(w), "after": F.lead("p").over(w)})
    second = ranked.filter("n = 2").select(F.col("listing").alias("l"), F.col("p").alias("second"))
    odd = F.substring("listing", 4, 10).cast("int") % 2 == 1
    back = F.when(odd & (F.col("n") > 1), F.col("second"))
    linked = ranked.join(second, F.col("listing") == F.col("l"), "left").withColumn("to", F.coalesce("after", back)).filter("NOT lost")
    return linked.select("listing", F.when(F.col("n") > 1, token(F.col("p"))).alias("pageToken"), F.when(F.col("to").isNotNull(), token(F.col("to"))).alias("nextPageToken"), "files", "incompleteSearch")


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """Events as answers to a connector: a user is a listing, a quarter of its keys an item."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    code = F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "signup", 403).when(F.col("event_type") == "click", F.when(k < 20, 500).otherwise(200)).otherwise(200)
    reason = F.when(F.col("event_type") == "signup", F.when(k < 80, "rateLimitExceeded").otherwise("forbidden"))
    return table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("listing"), F.call_function("div", k, F.lit(25)).cast("string").alias("item"), F.col("event_id").alias("attempt"), code.alias("code"), reason.alias("reason"))


def album_pages(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as albums of the parts they delivered: a page for each way of shipping, all in one chain."""
    item = F.struct(F.concat(F.lit("m"), "l_partkey").alias("id"))
    return table(spark, d, "lineitem").groupBy(F.concat(F.lit("s"), "l_suppkey").alias("albumId"), F.col("l_linenumber").alias("page")).agg(F.collect_list(item).alias("mediaItems"))


def counter_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of scans: a signup lists as many items as its key says, errors are skipped items, all others are items done."""
    listed = F.when(F.col("event_type") == "signup", F.get_json_object("props", "$.k").cast("bigint"))
    return table(spark, d, "events").select(F.col("user_id").alias("scan_id"), "event_id", listed.alias("listed"), F.col("event_type").isin("view", "click", "purchase").alias("done"))


def client_events(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    """Events as those of clients' scans: a user is a client, a week a scan that ends at its last event."""
    still = table(spark, d, "events")
    week = F.call_function("div", F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(7 * 86400))
    last = still.groupBy(F.col("user_id").alias("u"), week.alias("w")).agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("last"))
    e = still if events is None else events
    signup = F.when(F.col("event_type") == "signup", F.get_json_object("props", "$.k").cast("bigint"))
    rows = e.select("event_id", "user_id", "ts", week.alias("scan_id"), signup.alias("listed"), F.col("event_type").isin("view", "click", "purchase").alias("done"))
    joined = rows.join(last, (F.col("user_id") == F.col("u")) & (F.col("scan_id") == F.col("w")), "left")
    return joined.select(F.concat(F.lit("u"), "user_id").alias("client_key"), "scan_id", "ts", "listed", "done", (F.col("event_id") == F.col("last")).alias("ended"))


def mail_columns(m: DataFrame) -> DataFrame:
    """Fixture messages as the store's columns, in order of their ids."""
    return m.select("username", "message_id", "thread_id", "mail_from", "subject", "size_estimate", "labels", F.timestamp_seconds("id").cast("timestamp_ntz").alias("date"))


def contents(spark: SparkSession, d: str) -> tuple[DataFrame, StoredContents]:
    """Documents as files of known size, and what hashes their contents."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return rows.select("id", F.octet_length("content").alias("size")), StoredContents(rows)
