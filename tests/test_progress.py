from pyspark.sql import functions as F

from depotlens.streaming import progress as P


def test_fan_out_writes_key_and_all(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "client_key string, n int").write.parquet(str(src))
    events = spark.readStream.schema("client_key string, n int").parquet(str(src))
    P.fan_out(events, str(tmp_path / "key"), str(tmp_path / "all"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "all")).count() == 3
    keyed = spark.read.parquet(str(tmp_path / "key"))
    assert P.for_client(keyed, "a").count() == 2 and P.for_client(keyed, "all").count() == 3


def test_progress_extension(spark):
    df = spark.sql("SELECT 1 AS scan_id, true AS done, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts UNION ALL SELECT 1, false, TIMESTAMP_NTZ '2024-01-01 00:00:10'")
    r = P.progress(df).first()
    assert (r.processed_count, r.active_count, r.elapsed_in_sec, r.completion_pct, r.eta_in_sec) == (1, 1, 10, 50.0, 10)


def test_sse(spark):
    text = spark.range(1).select(P.sse_event(F.lit("{}"), F.timestamp_millis(F.lit(5))).alias("x")).first().x
    assert text == "event:progress\nid:5\nretry:10000\ndata:{}\n\n"
