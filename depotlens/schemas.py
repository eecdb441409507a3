"""Schemas of the stored tables, the connector payloads and the progress events.

Serial ids are longs, zone-less timestamps are ``TIMESTAMP_NTZ`` and unscaled
decimals are ``DECIMAL(18,6)``. ``LIMITS`` holds the width of bounded strings:
rows over it are quarantined on write (see ``operators.ingest``).
"""

from __future__ import annotations

#: Type of each column by table.
TABLES: dict[str, dict[str, str]] = {
    name: dict(column.split(" ", 1) for column in ddl.split(", "))
    for name, ddl in {
        "scans": "id bigint, scan_type string, created_on timestamp_ntz, scan_start_time timestamp_ntz, scan_end_time timestamp_ntz, status string, error_msg string, completed_at timestamp_ntz",
        "scandata": "id bigint, name string, path string, size bigint, file_mod_time timestamp_ntz, md5hash string, is_dir boolean, file_count int, scan_id bigint",
        "scanmetadata": "id bigint, name string, search_path string, search_filter string, scan_id bigint",
        "messagemetadata": "id bigint, message_id string, thread_id string, username string, date timestamp_ntz, mail_from string, mail_to string, subject string, size_estimate bigint, labels string, scan_id bigint",
        "photosmediaitem": "id bigint, media_item_id string, product_url string, mime_type string, filename string, size bigint, file_mod_time timestamp_ntz, md5hash string, scan_id bigint, contributor_display_name string",
        "photometadata": "id bigint, photos_media_item_id bigint, camera_make string, camera_model string, focal_length decimal(18,6), f_number decimal(18,6), iso int, exposure_time string",
        "videometadata": "id bigint, photos_media_item_id bigint, camera_make string, camera_model string, fps decimal(18,6)",
        "privatetokens": "id bigint, access_token string, refresh_token string, display_name string, client_key string, created_on timestamp_ntz, scope string, expires_in int, token_type string",
        "version": "id int",
    }.items()
}

#: Widest allowed value, in code points, by table and column.
LIMITS: dict[str, dict[str, int]] = {
    "scans": {"scan_type": 50, "status": 50},
    "scandata": {"name": 200, "path": 2000, "md5hash": 60},
    "scanmetadata": {"name": 200, "search_path": 2000, "search_filter": 2000},
    "messagemetadata": {"message_id": 200, "thread_id": 200, "username": 200, "mail_from": 500, "mail_to": 500, "subject": 2000, "labels": 500},
    "photometadata": {"camera_make": 500, "camera_model": 500, "exposure_time": 500},
    "videometadata": {"camera_make": 500, "camera_model": 500},
    "privatetokens": {"access_token": 800, "refresh_token": 800, "display_name": 100, "client_key": 100, "scope": 500, "token_type": 100},
}

#: Columns that may not be null on write.
REQUIRED: dict[str, tuple[str, ...]] = {
    "scans": ("scan_type", "created_on", "scan_start_time"),
    "scandata": ("scan_id",),
    "scanmetadata": ("scan_id",),
    "messagemetadata": ("scan_id",),
    "photosmediaitem": ("media_item_id", "product_url", "filename", "scan_id"),
    "photometadata": ("photos_media_item_id",),
    "videometadata": ("photos_media_item_id",),
    "privatetokens": ("client_key", "created_on"),
}

#: The kinds of scan that a request may name, the fields that each takes, their widths, and which must be filled.
SCAN_TYPES = ("Local", "GDrive", "GMail", "GPhotos")
REQUEST_FIELDS: dict[str, dict[str, tuple[int, bool]]] = {
    "Local": {"path": (1000, True)},
    "GDrive": {"query_string": (500, False), "refresh_token": (800, True)},
    "GMail": {"filter": (500, False), "refresh_token": (800, True), "client_key": (100, True), "username": (100, True)},
    "GPhotos": {"album_id": (100, False), "refresh_token": (800, True)},
}

#: Tables that a scan owns rows of, children before parents.
CASCADE = ("photometadata", "videometadata", "photosmediaitem", "messagemetadata", "scandata", "scanmetadata", "scans")

SCHEMA_VERSION = 4

#: Columns that a later version added to a table, with the value that older rows have.
ADDED: dict[str, dict[str, str | None]] = {"scans": {"status": "Completed", "error_msg": None, "completed_at": None}}

DRIVE_PAGE = "files array<struct<size:bigint, id:string, name:string, mimeType:string, parents:array<string>, modifiedTime:string, md5Checksum:string>>, nextPageToken string, incompleteSearch boolean, pageToken string"
MESSAGE = "id string, threadId string, labelIds array<string>, internalDate bigint, sizeEstimate bigint, payload struct<headers: array<struct<name:string, value:string>>>"
MEDIA_ITEM = "id string, description string, productUrl string, baseUrl string, mimeType string, filename string, mediaMetadata struct<creationTime:string, width:string, height:string, photo:struct<cameraMake:string, cameraModel:string, focalLength:double, apertureFNumber:double, isoEquivalent:int, exposureTime:string>, video:struct<cameraMake:string, cameraModel:string, fps:double>>, contributorInfo struct<profilePictureBaseUrl:string, displayName:string>"
ALBUM_PAGE = "albums array<struct<id:string, title:string, productUrl:string, mediaItemsCount:string, coverPhotoBaseUrl:string, coverPhotoMediaItemId:string>>, nextPageToken string, pageToken string"
#: Recorded pages of a mail listing, and of a search for the media items of an album.
MESSAGE_PAGE = "messages array<struct<id:string, threadId:string>>, nextPageToken string, pageToken string"
SEARCH_PAGE = "albumId string, mediaItems array<struct<id:string>>, nextPageToken string, pageToken string"
#: One answer of a connector: which listing and item was asked, when, and the HTTP status with its reason.
ATTEMPT = "listing string, item string, attempt bigint, code int, reason string"
PROGRESS = "client_key string, processed_count int, active_count int, completion_pct float, elapsed_in_sec int, eta_in_sec int, scan_id int"


def ddl(table: str) -> str:
    return ", ".join(f"{c} {kind}" for c, kind in TABLES[table].items())
