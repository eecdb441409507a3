"""Where streams put their results: files and stored tables, never the driver's memory."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest
from ..plans.store import Store
from ..session import shared_folder


def append_files(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """New rows to Parquet files. The sink's log names the files of whole batches, so a repeated batch adds nothing."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def replace_files(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The whole result after each batch, in a folder named by the batch; ``latest`` reads the last one."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("complete").trigger(**(trigger or {"availableNow": True})).start()


def latest(stream: DataFrame, path: str) -> DataFrame:
    """The result of the last batch that was written whole."""
    spark = stream.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath().toString() for s in fs.listStatus(at) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if fs.exists(at) else []
    return spark.read.schema(stream.schema).parquet(max(done)) if done else spark.createDataFrame([], stream.schema)


def run(stream: DataFrame, mode: str = "append", state: str | None = None) -> DataFrame:
    """Run a stream over all that is there now and read its result back from the shared folder."""
    root = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    with state_store(stream.sparkSession, state):
        if mode == "complete":
            replace_files(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
            return latest(stream, f"{root}/out")
        append_files(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


def files_of(spark, path: str) -> str:
    """A folder with a trailing slash, a file as it is: a stream reads folders only."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return f"{path}/" if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory() else path


class state_store:  # noqa: N801
    """The state store of the streams started inside, set back afterwards (None leaves it as it is)."""

    KEY = "spark.sql.streaming.stateStore.providerClass"
    ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    def __init__(self, spark, provider: str | None):
        self.conf, self.provider = spark.conf, provider

    def __enter__(self):
        self.before = self.conf.get(self.KEY)
        if self.provider:
            self.conf.set(self.KEY, self.provider)

    def __exit__(self, *_):
        self.conf.set(self.KEY, self.before)


def mail_sink(messages: DataFrame, store: Store, scan_id: int, checkpoint: str, name: str = "mail", order: tuple[str, ...] = ("date", "message_id"), bad: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """A stream of normalised messages into the store: the first of each key that no scan has stored yet.

    A batch is deduplicated in itself by an aggregate, then against the stored keys by a left-anti join
    over the three key columns. Rows and the batch's number are published together, so a batch that
    is repeated after a failure, or by a restart from the checkpoint, changes nothing. Rejected rows go to ``bad``.
    """

    def put(batch: DataFrame, number: int) -> None:
        if store.has_batch(name, number):
            return
        good, rejected = ingest.quarantine(batch.withColumn("scan_id", F.lit(scan_id)), "messagemetadata")
        if bad:
            bad(rejected, number)
        new = ingest.dedupe_messages(good, store.read("messagemetadata"), order)
        placed, n = ingest.placed(new, list(order))
        store.append({"messagemetadata": ingest.numbered(placed, store.reserve("messagemetadata", n))}, scan_id, (name, number))

    return messages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
