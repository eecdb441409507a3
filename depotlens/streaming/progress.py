"""Progress counters, fan-out and streaming dedupe with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ALL = "all"


def progress(items: DataFrame) -> DataFrame:
    """Running counts by scan from item events (scan_id, done boolean, ts); batch or stream.

    completion_pct and eta_in_sec are an extension: the share done, and the
    elapsed time times what is left over what is done.
    """
    done = F.count_if("done")
    active = F.count_if(~F.col("done"))
    elapsed = F.timestamp_diff("SECOND", F.min("ts"), F.max("ts"))
    counted = items.groupBy("scan_id").agg(done.alias("processed_count"), active.alias("active_count"), elapsed.alias("elapsed_in_sec"))
    total = F.col("processed_count") + F.col("active_count")
    return counted.withColumns(
        {
            "completion_pct": F.col("processed_count") * 100.0 / total,
            "eta_in_sec": F.when(F.col("processed_count") > 0, F.call_function("div", F.col("elapsed_in_sec") * F.col("active_count"), F.col("processed_count"))),
        }
    )


def for_client(events: DataFrame, client_key: str) -> DataFrame:
    """What a subscriber of one key sees."""
    return events if client_key == ALL else events.filter(F.col("client_key") == client_key)


def fan_out(events: DataFrame, keyed_path: str, all_path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Every event to its client's folder and to the folder of all, ``every`` so often ("5 seconds"), or once for all that is there.

    A batch's folder is named by its number and overwritten, so a repeated
    batch gives no second copy.
    """

    def send(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").partitionBy("client_key").parquet(f"{keyed_path}/batch={number}")
        batch.write.mode("overwrite").parquet(f"{all_path}/batch={number}")
        batch.unpersist()

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return events.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def stream_dedupe(messages: DataFrame) -> DataFrame:
    """First-wins over all time: the keys are the state and are never dropped."""
    return messages.dropDuplicates(["username", "message_id", "thread_id"])


def windowed_counts(events: DataFrame, ts: str, every: str, late: str) -> DataFrame:
    """An extension: event-time windows; rows later than ``late`` are left out when the state is closed."""
    w = F.window("_ts", every)
    return (
        events.withColumn("_ts", F.col(ts).cast("timestamp"))
        .withWatermark("_ts", late)
        .groupBy(w.alias("w"), "event_type")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
    )


def sse_event(row_json, ts):
    """One server-sent event as text."""
    return F.concat(F.lit("event:progress\nid:"), F.unix_millis(ts).cast("string"), F.lit("\nretry:10000\ndata:"), row_json, F.lit("\n\n"))
