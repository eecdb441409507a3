"""Every reference operator as a query over the driver's tables, with the SQL of its result."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import columns as C
from .functions import mail_filter
from .operators import analytics as A
from .operators import contents, ingest, paging, queries as Q, renames, retries, rollup, running
from .plans import Store
from .session import shared_folder
from .sources import remote
from .streaming import progress as P
from .streaming import sinks, ticker

AS_OF = datetime(2024, 6, 1)

# SQL of the fixtures, by the same names.
FILES = "(SELECT doc_id AS id, 'doc_' || doc_id || '.txt' AS name, '/' || lang || '/' || source || '/doc_' || doc_id || '.txt' AS path, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, md5(coalesce(text, '')) AS md5hash, false AS is_dir, CAST(substr(source, 4, 10) AS BIGINT) AS scan_id FROM documents)"
ENTRIES = f"(SELECT * REPLACE (CASE WHEN size > 20000 THEN '' WHEN size >= 60 THEN md5hash END AS md5hash) FROM {FILES} UNION ALL SELECT min(id) + 1000000000, split_part(path, '/', 2), '/' || split_part(path, '/', 2), 4096, '', true, scan_id FROM {FILES} GROUP BY scan_id, 2, 3)"
KNOWN = f"(SELECT * FROM {ENTRIES} WHERE NOT is_dir AND coalesce(md5hash, '') <> '')"
MESSAGES = "(SELECT conv_id * 1000 + turn AS id, CAST(turn AS VARCHAR) AS message_id, CAST(conv_id AS VARCHAR) AS thread_id, 'u' AS username, role AS mail_from, left(text, 2000) AS subject, CAST(octet_length(encode(text)) AS BIGINT) AS size_estimate, 'INBOX,' || upper(role) AS labels, conv_id % 10 AS scan_id FROM conversations)"
SCANS = "(SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'local' WHEN '2-HIGH' THEN 'google_drive' WHEN '3-MEDIUM' THEN 'gmail' ELSE 'photos' END AS scan_type, o_orderdate AS created_on, o_orderdate AS scan_start_time, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate + to_seconds(o_orderkey % 3600) END AS scan_end_time, CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'Completed' END AS status FROM orders)"
META = "(SELECT o_orderkey AS scan_id, c_name AS name, c_mktsegment AS search_path, CAST(NULL AS VARCHAR) AS search_filter FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT o_orderkey, c_name, 'second', NULL FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderstatus = 'F')"
MEDIA = "(SELECT p_partkey AS id, 'm' || p_partkey AS media_item_id, CASE WHEN p_type LIKE 'PROMO%' THEN 'image/jpeg' WHEN p_type LIKE 'STANDARD%' THEN 'video/mp4' ELSE 'text/plain' END AS mime_type, p_name AS filename, CAST(CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE p_size * 1000 END AS BIGINT) AS size, p_partkey % 4 AS scan_id, p_brand, p_type, p_size, p_retailprice FROM part)"
MASK = "CASE WHEN instr(n, '@') - 1 >= 6 THEN left(n, 3) || '****' || substr(n, instr(n, '@') - 2, 2) || substr(n, instr(n, '@')) ELSE client_key END"
TOKENS = "(SELECT CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) || '@example.org' ELSE 'abc@example.org' END AS n, 'key-' || s_suppkey AS client_key FROM supplier)"
LA = "{} AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles'"
PROGRESS = "SELECT scan_id, n_done AS processed_count, n - n_done AS active_count, el AS elapsed_in_sec, n_done * 100.0e0 / n AS completion_pct, CASE WHEN n_done > 0 THEN (el * (n - n_done)) // n_done END AS eta_in_sec FROM (SELECT user_id AS scan_id, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS n_done, date_diff('microsecond', min(ts), max(ts)) // 1000000 AS el FROM events GROUP BY 1)"

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None):
    def add(f: Query) -> Query:
        _ALL[name] = (f, sql)
        return f

    return add


# listings, counts, lookups


@query("list_files_page", f"SELECT id, name, path, size, md5hash, scan_id FROM {FILES} WHERE scan_id = 3 ORDER BY id LIMIT 10 OFFSET 10")
def list_files_page(s, d):
    return Q.list_of_scan(X.files(s, d), 3, 2).select("id", "name", "path", "size", "md5hash", "scan_id")


@query("list_scans_page", f"SELECT s.id, scan_type, {LA.format('created_on')} AS created_on, {LA.format('scan_start_time')} AS scan_start_time, scan_end_time, concat(search_path, search_filter) AS metadata, date_diff('microsecond', scan_start_time, coalesce(scan_end_time, TIMESTAMP '2024-06-01')) // 1000 AS duration_ms FROM {SCANS} s LEFT JOIN {META} m ON s.id = m.scan_id ORDER BY s.id, search_path, search_filter, name LIMIT 10 OFFSET 20")
def list_scans_page(s, d):
    return Q.list_scans(X.scans(s, d), X.scan_metadata(s, d), 3, AS_OF)


@query("scan_listing_fanout", f"SELECT s.id, count(*) AS listed FROM {SCANS} s LEFT JOIN {META} m ON s.id = m.scan_id GROUP BY s.id HAVING count(*) > 1")
def scan_listing_fanout(s, d):
    """Lines of a scan: its rows times those of its metadata, counted on both sides before they meet."""
    scans = X.scans(s, d).groupBy("id").agg(F.count("*").alias("rows"))
    meta = X.scan_metadata(s, d).groupBy(F.col("scan_id").alias("sid")).agg(F.count("*").alias("lines"))
    listed = F.col("rows") * F.coalesce("lines", F.lit(1))
    return scans.join(meta, F.col("id") == F.col("sid"), "left").select("id", listed.alias("listed")).filter("listed > 1")


@query("scan_requests", f"SELECT DISTINCT s.id, coalesce(name, '') AS name, scan_type, search_filter, {LA.format('scan_start_time')} AS scan_start_time, coalesce(date_diff('microsecond', scan_start_time, scan_end_time) / 1e6, -1) AS scan_duration_in_sec FROM {SCANS} s JOIN {META} m ON s.id = m.scan_id WHERE name = 'Customer#000000022' ORDER BY 1 DESC")
def scan_requests(s, d):
    return Q.scan_requests(X.scans(s, d), X.scan_metadata(s, d), "Customer#000000022")


@query("linked_accounts", f"SELECT DISTINCT {MASK} AS display_name, client_key FROM {TOKENS}")
def linked_accounts(s, d):
    return Q.linked_accounts(X.tokens(s, d))


@query("token_exists", f"SELECT client_key FROM {TOKENS} WHERE client_key = 'key-7'")
def token_exists(s, d):
    return Q.token_for(X.tokens(s, d), "key-7").select("client_key")


@query("scanned_accounts", f"SELECT DISTINCT name FROM {META} WHERE name IS NOT NULL ORDER BY 1")
def scanned_accounts(s, d):
    return Q.scanned_accounts(X.scan_metadata(s, d))


@query("list_messages_page", f"SELECT * FROM {MESSAGES} WHERE scan_id = 4 ORDER BY id LIMIT 10")
def list_messages_page(s, d):
    return Q.list_of_scan(X.messages(s, d), 4, 1)


@query("list_photos_page", f"SELECT id, media_item_id, mime_type, filename, size, scan_id FROM {MEDIA} WHERE scan_id = 2 ORDER BY id LIMIT 10 OFFSET 10")
def list_photos_page(s, d):
    return Q.list_of_scan(X.media(s, d), 2, 2).select("id", "media_item_id", "mime_type", "filename", "size", "scan_id")


@query("counts_by_scan", f"SELECT 'files' AS kind, scan_id, count(*) AS n FROM {FILES} GROUP BY scan_id UNION ALL SELECT 'messages', scan_id, count(*) FROM {MESSAGES} GROUP BY scan_id UNION ALL SELECT 'photos', scan_id, count(*) FROM {MEDIA} GROUP BY scan_id")
def counts_by_scan(s, d):
    parts = [Q.counts_by_scan(t(s, d)).select(F.lit(k).alias("kind"), "scan_id", "n") for k, t in (("files", X.files), ("messages", X.messages), ("photos", X.media))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("scan_count", f"SELECT count(*) AS n FROM {SCANS}")
def scan_count(s, d):
    return X.scans(s, d).agg(F.count("*").alias("n"))


@query("scan_by_id", f"SELECT id, scan_type, created_on, scan_end_time, coalesce(status, 'Completed') AS status FROM {SCANS} WHERE id = 33")
def scan_by_id(s, d):
    return Q.scan_by_id(X.scans(s, d), 33).select("id", "scan_type", "created_on", "scan_end_time", "status")


@query("running_scans", f"SELECT id, scan_type FROM {SCANS} WHERE scan_end_time IS NULL")
def running_scans(s, d):
    return X.scans(s, d).filter(F.col("scan_end_time").isNull()).select("id", "scan_type")


@query("existing_messages", f"SELECT m.username, m.message_id, m.thread_id, CAST(count(o.id) AS BIGINT) AS n FROM (SELECT DISTINCT username, message_id, thread_id FROM {MESSAGES}) m LEFT JOIN (SELECT * FROM {MESSAGES} WHERE scan_id < 5) o USING (username, message_id, thread_id) GROUP BY 1, 2, 3")
def existing_messages(s, d):
    m = X.messages(s, d)
    return Q.existing_messages(m, m.filter("scan_id < 5"))


# rollups and ingest


@query("dir_rollup", "SELECT 1::BIGINT AS scan_id, dir, CAST(sum(size) AS BIGINT) AS size, count(*) AS file_count FROM (SELECT size, array_to_string(parts[1:n], '/') AS dir, path FROM (SELECT path, size, parts, unnest(range(1, len(parts))) AS n FROM (SELECT path, string_split(path, '/') AS parts, size FROM (SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+:/', '') AS path, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages)))) WHERE dir <> '' AND dir <> path GROUP BY dir")
def dir_rollup(s, d):
    return rollup.directory_totals(X.page_paths(s, d))


@query("file_rollup", f"SELECT scan_id, dir, CAST(sum(size) AS BIGINT) AS size, count(*) AS file_count FROM (SELECT scan_id, size, unnest(['/' || split_part(path, '/', 2), '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3)]) AS dir FROM {FILES}) GROUP BY 1, 2")
def file_rollup(s, d):
    return rollup.directory_totals(X.files(s, d))


@query("scan_stats", f"SELECT scan_id, count(*) AS num_files, 0::BIGINT AS num_folders, CAST(sum(size) AS BIGINT) AS total_size FROM {FILES} GROUP BY 1")
def scan_stats(s, d):
    return A.scan_stats(X.files(s, d))


@query("message_normalize", "SELECT CAST(turn AS VARCHAR) AS message_id, CAST(conv_id AS VARCHAR) AS thread_id, 'u' AS username, TIMESTAMP '2024-01-01' + to_seconds((123 + conv_id * 1000 + turn) // 1000) AS date, role AS mail_from, '' AS mail_to, left(text, 2000) AS subject, CAST(octet_length(encode(text)) AS BIGINT) AS size_estimate, 'INBOX,' || upper(role) AS labels FROM conversations")
def message_normalize(s, d):
    return ingest.normalize_messages(remote.messages(X.raw_messages(s, d), "u"))


@query("message_dedupe", f"SELECT id, username, message_id, thread_id, scan_id FROM {MESSAGES}")
def message_dedupe(s, d):
    return ingest.dedupe_messages(X.repeated_messages(s, d)).select("id", "username", "message_id", "thread_id", "scan_id")


@query("message_dedupe_incremental", f"SELECT id, thread_id, scan_id FROM {MESSAGES} WHERE scan_id >= 5")
def message_dedupe_incremental(s, d):
    m = X.messages(s, d)
    return ingest.dedupe_messages(m, m.filter("scan_id < 5")).select("id", "thread_id", "scan_id")


@query("mail_filter", "SELECT turn AS message_turn, conv_id FROM conversations WHERE role = 'user' AND TIMESTAMP '2024-01-01' + to_seconds((123 + conv_id * 1000 + turn) // 1000) >= TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-01' + to_seconds((123 + conv_id * 1000 + turn) // 1000) < TIMESTAMP '2024-01-02'")
def mail_filter_query(s, d):
    m = remote.messages(X.raw_messages(s, d), "u").filter(mail_filter("label:inbox label:user after:2024/01/01 before:2024/01/02"))
    return m.select(F.col("message_id").cast("bigint").alias("message_turn"), F.col("thread_id").cast("bigint").alias("conv_id"))


@query("photo_split", f"SELECT 'photo' AS child, id AS photos_media_item_id, p_brand AS camera_make, CAST(p_size AS INTEGER) AS iso, CAST(NULL AS DOUBLE) AS fps FROM {MEDIA} WHERE mime_type LIKE 'image%' UNION ALL SELECT 'video', id, p_brand, NULL, 29.97e0 FROM {MEDIA} WHERE mime_type LIKE 'video%' UNION ALL SELECT 'parent', id, NULL, NULL, NULL FROM {MEDIA}")
def photo_split(s, d):
    parents, photos, videos = ingest.split_media(X.media(s, d))
    row = lambda df, k, i, make, iso, fps: df.select(F.lit(k).alias("child"), F.col(i).alias("photos_media_item_id"), make.cast("string").alias("camera_make"), iso.cast("int").alias("iso"), fps.cast("double").alias("fps"))
    none = F.lit(None)
    return (
        row(photos, "photo", "photos_media_item_id", F.col("camera_make"), F.col("iso"), none)
        .unionByName(row(videos, "video", "photos_media_item_id", F.col("camera_make"), none, F.col("fps")))
        .unionByName(row(parents, "parent", "id", none, none, none))
    )


@query("quarantine", f"SELECT id, length(path) AS path_length, size > 2000 AS rejected FROM {FILES}")
def quarantine(s, d):
    f = X.files(s, d).withColumn("name", F.when(F.col("size") > 2000, F.rpad("name", 201, "x")).otherwise(F.col("name")))
    good, bad = ingest.quarantine(f, "scandata")
    pick = lambda df, r: df.select("id", F.length("path").cast("bigint").alias("path_length"), F.lit(r).alias("rejected"))
    return pick(good, False).unionByName(pick(bad, True))


_REQUESTS = """SELECT doc_id, CASE lang WHEN 'en' THEN 'Local' WHEN 'de' THEN 'GMail' WHEN 'fr' THEN 'GPhotos' WHEN 'es' THEN 'GDrive' ELSE lang END AS scan_type, text, source FROM documents"""


@query(
    "request_errors",
    f"""WITH r AS ({_REQUESTS}), e AS (SELECT doc_id, concat_ws(',',
      CASE WHEN scan_type IS NULL THEN 'scan_type:REQUIRED' END,
      CASE WHEN NOT regexp_matches(scan_type, '[^ \\t\\n\\r\\f\\v]') THEN 'scan_type:EMPTY' END,
      CASE WHEN scan_type NOT IN ('Local', 'GDrive', 'GMail', 'GPhotos') AND regexp_matches(scan_type, '[^ \\t\\n\\r\\f\\v]') THEN 'scan_type:INVALID_VALUE' END,
      CASE WHEN scan_type = 'Local' AND text IS NULL THEN 'path:REQUIRED' END,
      CASE WHEN scan_type = 'Local' AND NOT regexp_matches(text, '[^ \\t\\n\\r\\f\\v]') THEN 'path:EMPTY' END,
      CASE WHEN scan_type = 'Local' AND length(text) > 1000 THEN 'path:TOO_LONG' END,
      CASE WHEN scan_type = 'Local' AND contains(text, chr(0)) THEN 'path:INVALID_CHARS' END,
      CASE WHEN scan_type = 'GDrive' AND length(text) > 500 THEN 'query_string:TOO_LONG' END,
      CASE WHEN scan_type = 'GDrive' AND source IS NULL THEN 'refresh_token:REQUIRED' END,
      CASE WHEN scan_type = 'GMail' AND length(text) > 500 THEN 'filter:TOO_LONG' END,
      CASE WHEN scan_type = 'GMail' AND source IS NULL THEN 'refresh_token:REQUIRED' END,
      CASE WHEN scan_type = 'GMail' AND text IS NULL THEN 'client_key:REQUIRED' END,
      CASE WHEN scan_type = 'GMail' AND NOT regexp_matches(text, '[^ \\t\\n\\r\\f\\v]') THEN 'client_key:EMPTY' END,
      CASE WHEN scan_type = 'GMail' AND length(text) > 100 THEN 'client_key:TOO_LONG' END,
      CASE WHEN scan_type = 'GMail' AND source IS NULL THEN 'username:REQUIRED' END,
      CASE WHEN scan_type = 'GPhotos' AND length(text) > 100 THEN 'album_id:TOO_LONG' END,
      CASE WHEN scan_type = 'GPhotos' AND source IS NULL THEN 'refresh_token:REQUIRED' END) AS errors FROM r)
    SELECT doc_id, errors FROM e WHERE errors <> ''""",
)
def request_errors(s, d):
    kind = F.coalesce(F.create_map(*[F.lit(x) for x in ("en", "Local", "de", "GMail", "fr", "GPhotos", "es", "GDrive")])[F.col("lang")], F.col("lang"))
    text, source = F.col("text"), F.col("source")
    docs = s.read.parquet(f"{d}/documents.parquet")
    asked = docs.select("doc_id", kind.alias("scan_type"), text.alias("path"), text.alias("query_string"), text.alias("filter"), text.alias("client_key"), text.alias("album_id"), source.alias("refresh_token"), source.alias("username"))
    _, refused = ingest.check_requests(asked)
    return refused.select("doc_id", F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["field"], e["code"])), ",").alias("errors"))


@query("serial_ids", f"SELECT id AS item, row_number() OVER (ORDER BY size, id) + 100 AS serial FROM {FILES}")
def serial_ids(s, d):
    f = X.files(s, d).select(F.col("id").alias("item"), "size")
    return ingest.with_ids(f, 101, ["size", "item"], "serial").select("item", "serial")


@query("delete_scan_survivors", f"SELECT 'scandata' AS tbl, count(*) AS n FROM {FILES} WHERE scan_id <> 1 UNION ALL SELECT 'messagemetadata', count(*) FROM {MESSAGES} WHERE scan_id <> 1 UNION ALL SELECT 'photosmediaitem', count(*) FROM {MEDIA} WHERE scan_id <> 1 UNION ALL SELECT 'photometadata', count(*) FROM {MEDIA} WHERE scan_id <> 1 AND mime_type LIKE 'image%' UNION ALL SELECT 'videometadata', count(*) FROM {MEDIA} WHERE scan_id <> 1 AND mime_type LIKE 'video%'")
def delete_scan_survivors(s, d):
    parents, photos, videos = ingest.split_media(X.media(s, d))
    left = A.survivors({"scandata": X.files(s, d), "messagemetadata": X.messages(s, d), "photosmediaitem": parents, "photometadata": photos, "videometadata": videos}, 1)
    out = [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("tbl"), "n") for t, df in left.items()]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]


@query("drive_normalize", f"SELECT name, path, size, md5hash FROM {FILES} WHERE id % 3 <> 0")
def drive_normalize(s, d):
    mime = F.when(F.col("id") % 3 == 0, F.lit(remote.FOLDER)).otherwise(F.lit("text/plain"))
    entry = F.struct("size", F.col("path").alias("id"), "name", mime.alias("mimeType"), F.lit("2024-01-01T00:00:00Z").alias("modifiedTime"), F.col("md5hash").alias("md5Checksum"))
    pages = X.files(s, d).select(F.array(entry).alias("files"), F.lit(False).alias("incompleteSearch"))
    return remote.drive_files(pages).select("name", "path", "size", "md5hash")


@query("media_normalize", f"SELECT media_item_id, CAST(CASE WHEN id % 2 = 0 THEN length(filename) ELSE 0 END AS BIGINT) AS size, CASE WHEN id % 2 = 0 THEN md5(filename) ELSE '' END AS md5hash, CASE WHEN mime_type LIKE 'image%' THEN p_brand WHEN mime_type LIKE 'video%' THEN p_type END AS camera_make, CASE WHEN mime_type LIKE 'image%' THEN 'b=d' WHEN mime_type LIKE 'video%' THEN 'b=dv' END AS content_url FROM {MEDIA}")
def media_normalize(s, d):
    m = X.media(s, d)
    none = F.lit(None).cast("string")
    photo = F.struct(F.col("camera_make").alias("cameraMake"), none.alias("cameraModel"), F.col("focal_length").alias("focalLength"), F.col("f_number").alias("apertureFNumber"), F.col("iso").alias("isoEquivalent"), none.alias("exposureTime"))
    video = F.struct(F.col("camera_model").alias("cameraMake"), none.alias("cameraModel"), F.col("fps").alias("fps"))
    raw = m.select(F.col("media_item_id").alias("id"), F.col("product_url").alias("productUrl"), F.col("mime_type").alias("mimeType"), "filename", F.lit("b").alias("baseUrl"), F.struct(F.lit("2024-01-01T00:00:00Z").alias("creationTime"), photo.alias("photo"), video.alias("video")).alias("mediaMetadata"), F.struct(none.alias("displayName")).alias("contributorInfo"))
    contents = m.filter("id % 2 = 0").select(F.col("media_item_id").alias("id"), F.col("filename").cast("binary").alias("content"))
    return remote.media_items(raw, contents, True, True).select("media_item_id", "size", "md5hash", "camera_make", "content_url")


@query("album_listing", "SELECT n_regionkey::VARCHAR AS id, n_name AS title FROM nation")
def album_listing(s, d):
    entry = F.struct(F.col("n_regionkey").cast("string").alias("id"), F.col("n_name").alias("title"))
    return remote.albums(X.table(s, d, "nation").groupBy("n_regionkey").agg(F.collect_list(entry).alias("albums"))).select("id", "title")


# pages, albums, retries

PAGES = "(WITH c AS (SELECT source AS listing, doc_id // 20 AS p, list(doc_id ORDER BY doc_id) AS files, coalesce(bool_or(length(text) < 5), false) AS bad, coalesce(bool_or(length(text) > 50000), false) AS lost FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS n, lead(p) OVER w AS after, nth_value(p, 2) OVER (PARTITION BY listing ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM c WINDOW w AS (PARTITION BY listing ORDER BY p)) SELECT listing, CASE WHEN n > 1 THEN md5(listing || '/' || p) ELSE '' END AS token, coalesce(md5(listing || '/' || coalesce(after, CASE WHEN CAST(substr(listing, 4) AS INTEGER) % 2 = 1 AND n > 1 THEN second END)), '') AS next, files, bad FROM r WHERE NOT lost)"
_WALK = f"WITH RECURSIVE pages AS MATERIALIZED (SELECT * FROM {PAGES}), walk AS (SELECT listing, token, next, files, bad, 0::BIGINT AS position, [token] AS seen FROM pages WHERE token = '' UNION ALL SELECT p.listing, p.token, p.next, p.files, p.bad, w.position + 1, list_append(w.seen, p.token) FROM walk w JOIN pages p ON p.listing = w.listing AND p.token = w.next WHERE w.next <> '' AND NOT w.bad AND NOT list_contains(w.seen, w.next)), ends AS (SELECT w.listing, CASE WHEN w.bad THEN 'incomplete search' WHEN w.next <> '' AND p.token IS NULL THEN 'missing page' WHEN w.next <> '' THEN 'loop' END AS fault, w.position FROM walk w LEFT JOIN pages p ON p.listing = w.listing AND p.token = w.next QUALIFY row_number() OVER (PARTITION BY w.listing ORDER BY w.position DESC) = 1)"


@query("page_chains", f"{_WALK} SELECT l.listing, coalesce(position + CASE fault WHEN 'incomplete search' THEN 0 ELSE 1 END, 0)::BIGINT AS pages, CASE WHEN position IS NULL THEN 'no first page' ELSE fault END AS fault, CASE WHEN fault IS NOT NULL THEN position END AS fault_at FROM (SELECT DISTINCT listing FROM pages) l LEFT JOIN ends USING (listing)")
def page_chains(s, d):
    return paging.follow(X.listing_pages(s, d), incomplete="incompleteSearch").report


@query("page_sequence", f"{_WALK} SELECT listing, position, len(files) AS files, files[1] AS first_id FROM walk WHERE NOT bad")
def page_sequence(s, d):
    pages = paging.follow(X.listing_pages(s, d), incomplete="incompleteSearch").sequence
    return pages.select("listing", "position", F.size("files").cast("bigint").alias("files"), F.get("files", F.lit(0)).alias("first_id"))


@query("album_scan", f"SELECT media_item_id, mime_type, filename FROM {MEDIA} WHERE media_item_id IN (SELECT 'm' || l_partkey FROM lineitem WHERE l_suppkey = 7)")
def album_scan(s, d):
    raw = X.media(s, d).select(F.col("media_item_id").alias("id"), "mime_type", "filename")
    return remote.album_items(raw, X.album_pages(s, d), "s7").select(F.col("id").alias("media_item_id"), "mime_type", "filename")


@query("album_sizes", f"SELECT album, count(*) AS items, CAST(sum(size) FILTER (WHERE size >= 0) AS BIGINT) AS bytes FROM (SELECT DISTINCT 's' || l_suppkey AS album, 'm' || l_partkey AS media_item_id FROM lineitem) JOIN {MEDIA} USING (media_item_id) GROUP BY 1")
def album_sizes(s, d):
    return A.album_sizes(X.media(s, d), remote.album_members(X.album_pages(s, d)))


ATTEMPTS = "(SELECT *, code >= 400 AS failed, code = 429 OR (code = 403 AND coalesce(reason = 'rateLimitExceeded', false)) AS again FROM (SELECT 'u' || user_id AS listing, CAST(k // 25 AS VARCHAR) AS item, event_id AS attempt, CASE event_type WHEN 'error' THEN 429 WHEN 'signup' THEN 403 WHEN 'click' THEN CASE WHEN k < 20 THEN 500 ELSE 200 END ELSE 200 END AS code, CASE WHEN event_type = 'signup' THEN CASE WHEN k < 80 THEN 'rateLimitExceeded' ELSE 'forbidden' END END AS reason FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events)))"
_ENDED = "SELECT listing, count(*) AS attempts, count(*) FILTER (WHERE failed) AS failures, first_end AS failed_at, {fatal} AS fatal FROM (SELECT *, min(attempt) FILTER (WHERE ends) OVER (PARTITION BY listing) AS first_end, min(attempt) FILTER (WHERE failed AND NOT again) OVER (PARTITION BY listing) AS first_fatal FROM ({ran})) WHERE first_end IS NULL OR attempt <= first_end GROUP BY listing, first_end, first_fatal"


@query("message_outcomes", f"SELECT listing, item, coalesce(arg_min(e, n) FILTER (WHERE e IS NOT NULL), 'open') AS outcome, coalesce(min(n) FILTER (WHERE e IS NOT NULL), max(n)) AS tries FROM (SELECT *, CASE WHEN NOT failed THEN 'stored' WHEN NOT again OR n = 4 THEN 'skipped' END AS e FROM (SELECT *, row_number() OVER (PARTITION BY listing, item ORDER BY attempt) AS n FROM {ATTEMPTS}) WHERE n <= 4) GROUP BY 1, 2")
def message_outcomes(s, d):
    return retries.item_outcomes(X.attempts(s, d))


@query("mail_listings", _ENDED.format(fatal="coalesce(first_end = first_fatal, false)", ran=f"SELECT *, failed AND (NOT again OR count(*) OVER (PARTITION BY listing, resets ORDER BY attempt) - CASE WHEN resets > 0 THEN 1 ELSE 0 END >= 3) AS ends FROM (SELECT *, count(*) FILTER (WHERE NOT failed) OVER (PARTITION BY listing ORDER BY attempt) AS resets FROM {ATTEMPTS})"))
def mail_listings(s, d):
    return retries.listings_in_a_row(X.attempts(s, d))


@query("media_listings", _ENDED.format(fatal="false", ran=f"SELECT *, failed AND count(*) FILTER (WHERE failed) OVER (PARTITION BY listing ORDER BY attempt) > 25 AS ends FROM {ATTEMPTS}"))
def media_listings(s, d):
    return retries.listings_by_budget(X.attempts(s, d))


@query("running_counters", "SELECT scan_id, event_id, CAST(sum(d) OVER w AS BIGINT) AS processed_count, CAST(sum(l - d) OVER w AS BIGINT) AS pending_count FROM (SELECT user_id AS scan_id, event_id, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 1 ELSE 0 END AS d, CASE WHEN event_type = 'signup' THEN CAST(props->>'$.k' AS BIGINT) ELSE 0 END AS l FROM events) WINDOW w AS (PARTITION BY scan_id ORDER BY event_id)")
def running_counters(s, d):
    return running.scan_counters(X.counter_events(s, d)).select("scan_id", "event_id", "processed_count", "pending_count")


# functions


@query("duration_seconds", f"SELECT id, coalesce(date_diff('microsecond', scan_start_time, scan_end_time) / 1e6, -1) AS sec FROM {SCANS}")
def duration_seconds(s, d):
    return X.scans(s, d).select("id", C.duration_seconds("scan_start_time", "scan_end_time").alias("sec"))


@query("local_time_shift", f"SELECT event_id, {LA.format('ts')} AS local_ts FROM events")
def local_time_shift(s, d):
    return X.table(s, d, "events").select("event_id", C.utc_to_local("ts").alias("local_ts"))


@query("human_size", f"SELECT id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', round_even(size / 1024.0, 1)) ELSE printf('%.1f MB', round_even(size / 1048576.0, 1)) END AS human FROM {FILES}")
def human_size(s, d):
    return X.files(s, d).select("id", C.human_size("size").alias("human"))


@query("mask_account", f"SELECT client_key, {MASK} AS masked FROM {TOKENS}")
def mask_account(s, d):
    return X.tokens(s, d).select("client_key", C.mask_account("display_name", "client_key").alias("masked"))


@query("retry_classify", "SELECT event_id, (user_id % 4 = 0) OR (user_id % 4 = 1 AND event_type = 'error') AS retry FROM events")
def retry_classify(s, d):
    e = X.table(s, d, "events")
    code = F.when(F.col("user_id") % 4 == 0, 429).when(F.col("user_id") % 4 == 1, 403).otherwise(500)
    return e.select("event_id", C.is_retryable(code, F.when(F.col("event_type") == "error", "rateLimitExceeded")).alias("retry"))


@query("scan_type_names", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'local' WHEN 1 THEN 'google_drive' WHEN 2 THEN 'gmail' WHEN 3 THEN 'photos' END AS stored FROM customer")
def scan_type_names(s, d):
    kind = F.element_at(F.array(*map(F.lit, ["Local", "GDrive", "GMail", "GPhotos", "GStorage"])), (F.col("c_custkey") % 5 + 1).cast("int"))
    return X.table(s, d, "customer").select("c_custkey", C.stored_scan_type(kind).alias("stored"))


@query("nullable_json", "SELECT item_id, '{\"String\":' || to_json(text) || ',\"Valid\":true}' AS js FROM benchmark")
def nullable_json(s, d):
    return X.table(s, d, "benchmark").select("item_id", F.to_json(C.nullable_json("text")).alias("js"))


# analytics


@query("dup_within_scan", f"SELECT scan_id, md5hash, size, count(*) AS copies, min(id) AS first_id, (count(*) - 1) * size AS wasted FROM {KNOWN} GROUP BY 1, 2, 3 HAVING count(*) > 1")
def dup_within_scan(s, d):
    return A.duplicates_within(X.entries(s, d))


@query("dup_across_scans", f"SELECT md5hash, size, count(DISTINCT scan_id) AS scans, count(*) AS copies FROM {KNOWN} GROUP BY 1, 2 HAVING count(DISTINCT scan_id) > 1")
def dup_across_scans(s, d):
    return A.duplicates_across(X.entries(s, d))


@query("size_collisions", f"SELECT id, size FROM {FILES} WHERE size IN (SELECT size FROM {FILES} GROUP BY size HAVING count(*) > 1)")
def size_collisions(s, d):
    return A.size_collisions(X.files(s, d)).select("id", "size")


def _pair(s, d):
    """Every scan against the next one: all entries, and all again at the places of the scan before. A place is taken by the entry of the smallest id."""
    side = lambda scan: X.entries(s, d).withColumn("path", F.concat(scan.cast("string"), F.lit("/f"), F.call_function("div", F.col("id"), F.lit(20)).cast("string")))
    return side(F.col("scan_id")), side(F.col("scan_id") - 1)


_SIDE = f"(SELECT path, f.size, f.md5hash FROM (SELECT path, arg_min({{{{'size': size, 'md5hash': md5hash}}}}, id) AS f FROM (SELECT ({{}}) || '/f' || (id // 20) AS path, id, size, md5hash FROM {ENTRIES} WHERE NOT is_dir) GROUP BY path))"
_L, _R = _SIDE.format("scan_id"), _SIDE.format("scan_id - 1")
_ALL_LEFT, _ALL_RIGHT = (f"(SELECT ({x}) || '/f' || (id // 20) AS path, size FROM {ENTRIES})" for x in ("scan_id", "scan_id - 1"))
_DIFF = f"SELECT path, l.size AS size_left, l.md5hash AS md5_left, r.size AS size_right, r.md5hash AS md5_right, CASE WHEN r.path IS NULL THEN 'ONLY_LEFT' WHEN l.path IS NULL THEN 'ONLY_RIGHT' WHEN l.size IS NOT DISTINCT FROM r.size AND l.md5hash IS NOT DISTINCT FROM r.md5hash THEN 'SAME' ELSE 'CHANGED' END AS state FROM {_L} l FULL JOIN {_R} r USING (path)"


@query("scan_only_left", f"SELECT path, size FROM {_ALL_LEFT} WHERE path NOT IN (SELECT path FROM {_ALL_RIGHT})")
def scan_only_left(s, d):
    return A.only_left(*_pair(s, d)).select("path", "size")


@query("scan_changed", f"SELECT * EXCLUDE (state) FROM ({_DIFF}) WHERE state = 'CHANGED'")
def scan_changed(s, d):
    return A.changed(*_pair(s, d))


@query("scan_full_diff", _DIFF)
def scan_full_diff(s, d):
    return A.full_diff(*_pair(s, d))


def _lagged(s, d):
    """Every scan against the next one, names kept: files at their own places and, on the other side, one place on."""
    f = X.entries(s, d)
    at = lambda n: f.withColumn("path", F.concat(F.lit("/"), F.call_function("div", F.col("id") + n, F.lit(3)).cast("string"), F.lit("/"), (F.col("id") % 3).cast("string")))
    return at(0).filter("scan_id < 10"), at(1).filter("scan_id >= 5")


_PLACED = f"(SELECT path, f.size, f.md5hash FROM (SELECT path, arg_min({{{{'size': size, 'md5hash': md5hash}}}}, id) AS f FROM (SELECT '/' || ((id + {{}}) // 3) || '/' || (id % 3) AS path, id, size, md5hash FROM {ENTRIES} WHERE NOT is_dir AND {{}}) GROUP BY path))"
_SYNC = _DIFF.replace(_L, _PLACED.format(0, "scan_id < 10")).replace(_R, _PLACED.format(1, "scan_id >= 5"))


@query("sync_plan", f"WITH d AS MATERIALIZED ({_SYNC}), l AS (SELECT path, md5_left AS m, size_left AS z, row_number() OVER (PARTITION BY md5_left, size_left ORDER BY path) AS k FROM d WHERE state = 'ONLY_LEFT' AND coalesce(md5_left, '') <> ''), r AS (SELECT path, md5_right AS m, size_right AS z, row_number() OVER (PARTITION BY md5_right, size_right ORDER BY path) AS k FROM d WHERE state = 'ONLY_RIGHT' AND coalesce(md5_right, '') <> ''), p AS (SELECT l.path AS a, r.path AS b FROM l JOIN r USING (m, z, k)) SELECT d.*, other, CASE state WHEN 'CHANGED' THEN 'UPDATE' WHEN 'SAME' THEN 'NOOP' WHEN 'ONLY_LEFT' THEN CASE WHEN other IS NULL THEN 'COPY' ELSE 'MOVE' END ELSE CASE WHEN other IS NULL THEN 'NOOP' ELSE 'MOVED' END END AS action FROM d LEFT JOIN (SELECT a AS path, b AS other FROM p UNION ALL SELECT b, a FROM p) USING (path)")
def sync_plan(s, d):
    return A.sync_plan(*_lagged(s, d))


_TEXTS = "(SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents)"


@query("staged_duplicates", f"SELECT octet_length(b)::BIGINT AS size, md5(b) AS md5hash, count(*) AS copies FROM {_TEXTS} GROUP BY 1, 2 HAVING count(*) > 1")
def staged_duplicates(s, d):
    out = contents.staged_hashes(*X.contents(s, d), block=512).filter("md5hash <> ''")
    return out.groupBy("size", "md5hash").agg(F.count("*").alias("copies")).filter("copies > 1")


@query("staged_hash_cost", f"WITH t AS (SELECT doc_id, octet_length(b) AS n, b FROM {_TEXTS}), e AS (SELECT *, n > 0 AND count(*) OVER (PARTITION BY n) > 1 AS met FROM t), w AS (SELECT *, met AND n > 1024 AND count(*) OVER (PARTITION BY n, met, CASE WHEN n > 1024 THEN md5(b[1:512] || b[n-511:n]) ELSE md5(b) END) > 1 AS twice FROM e) SELECT CASE WHEN NOT met THEN 'size' WHEN NOT twice THEN 'edges' ELSE 'whole' END AS stage, count(*) AS files, CAST(sum(CASE WHEN NOT met THEN 0 ELSE least(n, 1024) END + CASE WHEN twice THEN n ELSE 0 END) AS BIGINT) AS bytes_read FROM w GROUP BY 1")
def staged_hash_cost(s, d):
    """How many files each stage settles, and what it reads for them."""
    return contents.staged_hashes(*X.contents(s, d), block=512).groupBy("stage").agg(F.count("*").alias("files"), F.sum("bytes_read").alias("bytes_read"))


_SPELLED = "(SELECT DISTINCT '/' || CASE WHEN starts_with(url, 'http:') THEN upper(h) ELSE h END || '/' || CASE WHEN contains(url, '?') THEN upper(l) ELSE l END AS folder, '/' || CASE WHEN starts_with(url, 'http:') THEN upper(h) ELSE h END || '/' || CASE WHEN contains(url, '?') THEN upper(l) ELSE l END || '/' || replace(r, '/', '') AS path FROM (SELECT url, regexp_extract(url, '^[a-z]+://([^/]*)/([^/]*)/([^?#]*)', 1) AS h, regexp_extract(url, '^[a-z]+://([^/]*)/([^/]*)/([^?#]*)', 2) AS l, regexp_extract(url, '^[a-z]+://([^/]*)/([^/]*)/([^?#]*)', 3) AS r FROM pages))"
_NAMES = f"f AS MATERIALIZED (SELECT * FROM {_SPELLED}), d AS (SELECT DISTINCT folder FROM f UNION SELECT DISTINCT '/' || split_part(folder, '/', 2) FROM f), c AS (SELECT lower(trim(name)) AS norm, name, count(*) AS n FROM (SELECT string_split(folder, '/')[-1] AS name FROM d) GROUP BY 1, 2), b AS (SELECT norm, arg_min(name, (-n, name)) AS new_name FROM c GROUP BY 1), m AS (SELECT name, new_name FROM c JOIN b USING (norm))"


@query("folder_rename_paths", f"WITH {_NAMES}, o AS (SELECT path, '/' || a.new_name || '/' || z.new_name || '/' || split_part(path, '/', 4) AS new_path FROM f JOIN m a ON a.name = split_part(path, '/', 2) JOIN m z ON z.name = split_part(path, '/', 3)) SELECT 1::BIGINT AS scan_id, path, new_path, count(*) OVER (PARTITION BY new_path) > 1 AS conflict FROM o")
def folder_rename_paths(s, d):
    return renames.renamed_paths(X.spelled_paths(s, d))


@query("folder_rename_steps", f"WITH {_NAMES}, g AS (SELECT folder, len(string_split(folder, '/')) - 1 AS depth, a.new_name AS top, z.new_name AS low, split_part(folder, '/', 2) AS t, split_part(folder, '/', 3) AS l FROM d JOIN m a ON a.name = split_part(folder, '/', 2) LEFT JOIN m z ON z.name = split_part(folder, '/', 3)), w AS (SELECT *, '/' || top || CASE WHEN depth = 2 THEN '/' || low ELSE '' END AS new_path FROM g), x AS (SELECT *, count(*) OVER (PARTITION BY new_path) > 1 AS merges FROM w) SELECT 1::BIGINT AS scan_id, CAST(depth AS INTEGER) AS depth, folder, CASE WHEN depth = 2 THEN '/' || top || '/' || l ELSE folder END AS path_then, new_path, merges FROM x WHERE CASE WHEN depth = 2 THEN l <> low ELSE t <> top END")
def folder_rename_steps(s, d):
    return renames.rename_steps(X.spelled_paths(s, d))


@query("keeper_plan", f"SELECT id, scan_id, md5hash, size, min(id) OVER w AS keep_id, count(*) OVER w AS copies, CASE WHEN id = min(id) OVER w THEN 'KEEP' ELSE 'DELETE' END AS action FROM {KNOWN} WINDOW w AS (PARTITION BY md5hash, size) QUALIFY count(*) OVER w > 1")
def keeper_plan(s, d):
    return A.keeper_plan(X.entries(s, d))


@query("folder_name_plan", "SELECT id, scan_id, name AS old_name, new_name FROM (SELECT c_custkey AS id, 1::BIGINT AS scan_id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS name, lower(c_mktsegment) AS norm FROM customer) JOIN (SELECT norm, arg_min(name, (-n, name)) AS new_name FROM (SELECT lower(c_mktsegment) AS norm, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS name, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 1) USING (norm) WHERE name <> new_name")
def folder_name_plan(s, d):
    c = X.table(s, d, "customer")
    name = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    return A.folder_name_plan(c.select(F.col("c_custkey").alias("id"), F.lit(1).cast("bigint").alias("scan_id"), name.alias("name")))


@query("top_senders", f"SELECT mail_from, count(*) AS messages, CAST(sum(size_estimate) AS BIGINT) AS bytes FROM {MESSAGES} GROUP BY 1")
def top_senders(s, d):
    return A.space_by(X.messages(s, d), "mail_from")


@query("largest_threads", f"SELECT thread_id, count(*) AS messages, CAST(sum(size_estimate) AS BIGINT) AS bytes FROM {MESSAGES} GROUP BY 1 ORDER BY bytes DESC, messages DESC, thread_id LIMIT 15")
def largest_threads(s, d):
    return A.largest_groups(A.space_by(X.messages(s, d), "thread_id"), "thread_id", 15)


@query("largest_senders", f"SELECT mail_from, count(*) AS messages, CAST(sum(size_estimate) AS BIGINT) AS bytes FROM {MESSAGES} GROUP BY 1 ORDER BY bytes DESC, messages DESC, mail_from LIMIT 2")
def largest_senders(s, d):
    return A.largest_groups(A.space_by(X.messages(s, d), "mail_from"), "mail_from", 2)


@query("largest_labels", f"SELECT label, count(*) AS messages, CAST(sum(size_estimate) AS BIGINT) AS bytes FROM (SELECT size_estimate, unnest(string_split(labels, ',')) AS label FROM {MESSAGES}) GROUP BY 1 ORDER BY bytes DESC, messages DESC, label LIMIT 3")
def largest_labels(s, d):
    return A.largest_groups(A.space_by_label(X.messages(s, d)), "label", 3)


@query("space_by_thread", f"SELECT thread_id, count(*) AS messages, CAST(sum(size_estimate) AS BIGINT) AS bytes FROM {MESSAGES} GROUP BY 1")
def space_by_thread(s, d):
    return A.space_by(X.messages(s, d), "thread_id")


@query("space_by_label", f"SELECT label, count(*) AS messages, CAST(sum(size_estimate) AS BIGINT) AS bytes FROM (SELECT size_estimate, unnest(string_split(labels, ',')) AS label FROM {MESSAGES}) GROUP BY 1")
def space_by_label(s, d):
    return A.space_by_label(X.messages(s, d))


@query("largest_photos", f"SELECT id, size FROM {MEDIA} WHERE size >= 0 ORDER BY size DESC, id LIMIT 20")
def largest_photos(s, d):
    return A.largest(X.media(s, d), 20).select("id", "size")


@query("top_items_per_scan", f"SELECT scan_id, id, size, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY size DESC, id) AS INTEGER) AS rank FROM {ENTRIES} WHERE NOT is_dir QUALIFY rank <= 5")
def top_items_per_scan(s, d):
    return A.largest_per_scan(X.entries(s, d), 5).select("scan_id", "id", "size", "rank")


# progress


@query("progress_batch", PROGRESS)
def progress_batch(s, d):
    return P.progress(X.item_events(s, d))


def _stream(s, d, name):
    """A table as a stream of its files."""
    schema = X.table(s, d, name).schema
    part = sinks.files_of(s, f"{d}/{name}.parquet")
    return s.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(part) if part.endswith("/") else s.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query("progress_stream", PROGRESS)
def progress_stream(s, d):
    return sinks.run(P.progress(X.item_events(s, d, _stream(s, d, "events"))), "complete")


@query("windowed_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(s, d):
    return sinks.run(P.windowed_counts(_stream(s, d, "events"), "ts", "1 day", "2 days"), "complete")


@query("stream_dedupe", "SELECT DISTINCT 'u' AS username, event_type AS message_id, CAST(user_id AS VARCHAR) AS thread_id FROM events")
def stream_dedupe(s, d):
    e = _stream(s, d, "events").select(F.lit("u").alias("username"), F.col("event_type").alias("message_id"), F.col("user_id").cast("string").alias("thread_id"))
    return sinks.run(P.stream_dedupe(e))


_TICKS = "WITH e AS MATERIALIZED (SELECT 'u' || user_id AS client_key, epoch_us(ts) // 1000000 // 604800 AS scan_id, epoch_us(ts) // 1000 AS ms, event_id, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 1 ELSE 0 END AS done, CASE WHEN event_type = 'signup' THEN CAST(props->>'$.k' AS BIGINT) ELSE 0 END AS listed FROM events), s AS MATERIALIZED (SELECT client_key, scan_id, min(ms) AS start, max(ms) AS stop, (SELECT max(ms) - 600000 FROM e) AS now FROM e GROUP BY 1, 2), m AS (SELECT client_key, scan_id, start, start + 86400000 * k AS due, false AS final FROM (SELECT *, unnest(generate_series(1, (least(stop, now) - 1 - start) // 86400000)) AS k FROM s WHERE least(stop, now) > start) UNION ALL SELECT client_key, scan_id, start, stop, true FROM s WHERE stop < now)"


@query("progress_ticks", f"{_TICKS} SELECT client_key, scan_id, make_timestamp(due * 1000) AS ts, CAST(sum(done) AS BIGINT) AS processed_count, CAST(sum(listed - done) AS BIGINT) AS active_count, (due - start) // 1000 AS elapsed_in_sec, final FROM m JOIN e USING (client_key, scan_id) WHERE ms <= due GROUP BY client_key, scan_id, due, start, final")
def progress_ticks(s, d):
    """A snapshot a day for each client and scan, and one at the scan's end, from the stream's state and timers."""
    out = sinks.run(ticker.ticks(X.client_events(s, d, _stream(s, d, "events")), 86_400), state=sinks.state_store.ROCKSDB)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_mail_sink", f"SELECT username, message_id, thread_id, mail_from, subject, size_estimate, labels, 1::BIGINT AS scan_id FROM {MESSAGES}")
def stream_mail_sink(s, d):
    """Conversations as a mail stream that sees every message twice, stored batch by batch."""
    root = f"{shared_folder(s)}/mail-{uuid.uuid4().hex}"
    store = Store(s, f"{root}/store")
    store.ensure()
    stream = X.mail_columns(X.repeated_messages(s, d, _stream(s, d, "conversations")))
    sinks.mail_sink(stream, store, 1, f"{root}/checkpoint").awaitTermination()
    return store.read("messagemetadata").select("username", "message_id", "thread_id", "mail_from", "subject", "size_estimate", "labels", "scan_id")


@query("client_progress", "SELECT event_id FROM events WHERE event_type = 'view'")
def client_progress(s, d):
    return P.for_client(X.table(s, d, "events").withColumn("client_key", F.col("event_type")), "view").select("event_id")


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}
