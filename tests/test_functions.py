from datetime import datetime

import pytest
from pyspark.sql import functions as F

from depotlens.functions import columns as C
from depotlens.functions import mail_filter


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("n,text", [(0, "0 B"), (512, "512 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1280, "1.2 KB"), (1048576, "1.0 MB"), (1572864, "1.5 MB"), (5242880, "5.0 MB"), (1024**4, "1.0 TB"), (1024**6, "1.0 EB"), (None, None)])
def test_human_size(spark, n, text):
    assert one(spark, C.human_size(F.lit(n).cast("bigint"))) == text


@pytest.mark.parametrize("name,shown", [("abcdefg@x.com", "abc****fg@x.com"), ("abc@x.com", "key"), ("nobody", "key"), (None, "key"), ("abcdef@x.com", "abc****ef@x.com")])
def test_mask(spark, name, shown):
    assert one(spark, C.mask_account(F.lit(name).cast("string"), F.lit("key"))) == shown


def test_concat_skips_null(spark):
    null = F.lit(None).cast("string")
    assert one(spark, C.concat_skip_null(null, F.lit("f"))) == "f"
    assert one(spark, C.concat_skip_null(null, null)) == ""


@pytest.mark.parametrize("utc,local", [("2024-01-01 00:00:00", datetime(2023, 12, 31, 16)), ("2024-07-01 00:00:00", datetime(2024, 6, 30, 17))])
def test_local_time(spark, utc, local):
    assert one(spark, C.utc_to_local(F.lit(utc).cast("timestamp_ntz"))) == local


def test_duration(spark):
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    assert one(spark, C.duration_seconds(t("2024-01-01 00:00:00"), t("2024-01-01 00:01:05.5"))) == 65.5
    assert one(spark, C.duration_seconds(t("2024-01-01 00:00:00"), t(None))) == -1
    assert one(spark, C.duration_millis(t("2024-01-01 00:00:00"), t("2024-01-01 00:00:01.2345"))) == 1234


def test_headers_last_wins_and_case_counts(spark):
    h = F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("value")) for a, b in (("From", "a"), ("from", "b"), ("From", "c"))])
    assert one(spark, C.header_value(h, "From")) == "c"
    assert one(spark, C.header_value(h, "To")) == ""


@pytest.mark.parametrize("code,reason,again", [(429, None, True), (403, "rateLimitExceeded", True), (403, "other", False), (500, None, False)])
def test_retry(spark, code, reason, again):
    assert one(spark, C.is_retryable(F.lit(code), F.lit(reason).cast("string"))) is again


def test_times(spark):
    assert one(spark, C.millis_to_timestamp(F.lit(1704067200999).cast("bigint"))) == datetime(2024, 1, 1)
    assert one(spark, C.parse_rfc3339(F.lit("no time"))) == datetime(1, 1, 1)
    assert one(spark, C.parse_rfc3339(F.lit("2024-01-01T01:00:00+01:00"))) == datetime(2024, 1, 1)
    assert one(spark, C.parse_utc_seconds(F.lit("2024-01-01T00:00:05Z"))) == datetime(2024, 1, 1, 0, 0, 5)
    assert one(spark, C.parse_utc_seconds(F.lit("bad"))) is None


def test_texts(spark):
    assert one(spark, C.first_chars(F.lit("😀😀😀"), 2)) == "😀😀"
    assert one(spark, C.join_labels(F.lit(None).cast("array<string>"))) == ""
    assert one(spark, C.to_int(F.lit("x"), 1)) == 1
    assert one(spark, C.to_int(F.lit("7"), 1)) == 7
    assert one(spark, C.content_url(F.lit("u"), F.lit("video/mp4"))) == "u=dv"
    assert one(spark, C.content_url(F.lit("u"), F.lit("im"))) is None
    assert one(spark, C.md5_hex(F.lit(""))) == "d41d8cd98f00b204e9800998ecf8427e"
    assert one(spark, C.slash_date(F.lit("2024-01-02").cast("date"))) == "2024/01/02"
    assert one(spark, C.prefix_fields(F.array(F.lit("a")), "files/")) == ["files/a"]
    assert one(spark, C.stored_scan_type(F.lit("GMail"))) == "gmail"
    assert one(spark, C.is_blank(F.lit("  "))) is True


def test_mail_filter(spark):
    df = spark.createDataFrame([(1, ["INBOX", "UNREAD"], datetime(2024, 1, 5)), (2, ["INBOX"], datetime(2024, 1, 9)), (3, [], datetime(2024, 1, 5))], "id int, labels array<string>, date timestamp_ntz")
    ids = lambda text: sorted(r.id for r in df.filter(mail_filter(text)).collect())
    assert ids("") == [1, 2, 3]
    assert ids("label:inbox label:unread") == [1]
    assert ids("after:2024/01/05 before:2024/01/09") == [1, 3]
    with pytest.raises(ValueError):
        mail_filter("from:x")
