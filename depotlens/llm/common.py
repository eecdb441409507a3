"""Helpers that the corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Where it is unset, as in tests, one local folder is made for a session on one machine; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='depotlens-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This ends the lineage, so a lost executor costs the tasks of one step only,
    and it leaves later joins free to choose their own partitioning (and to
    split hot keys). The shuffle files of the finished step are released as soon
    as their plan is collected, which the two collections bring about.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a cut table that nothing will read again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character unchanged. Texts of ASCII alone take the faster lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_row(docs: DataFrame, id_col: str, text_col: str, also: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """docs with a number for each row in ROW, and whether that is its id.

    Where ids are missing or repeat, it is the row's place in id order, rows without an id first. A
    column of docs that has ROW's name is kept as OWN (see ``as_they_were``).
    """
    docs = docs.withColumnRenamed(ROW, OWN) if ROW in docs.columns and ROW != id_col else docs
    ids = docs.select(F.col(id_col).cast("long").alias(ROW))
    if ids.groupBy(ROW).agg(F.count("*").alias("n")).filter(F.col(ROW).isNull() | (F.col("n") > 1)).isEmpty():
        return docs.withColumn(ROW, F.col(id_col).cast("long")), True
    placed = docs.orderBy(F.asc_nulls_first(F.col(id_col).cast("long")), F.xxhash64(text_col), *also)
    return cut(placed.withColumn(ROW, F.monotonically_increasing_id())), False


def as_they_were(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of ``by_row`` with the columns of docs."""
    return rows.select(*[F.col(OWN).alias(c) if c == ROW and OWN in rows.columns else F.col(c) for c in docs.columns])


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(id, v0) of every row, and the ids of the rows (_row, _name) where they are not the numbers themselves."""
    rows, plain = by_row(docs.select(F.col(id_col).cast("long").alias("_name"), F.col(text_col).alias("v0")), "_name", "v0")
    return rows.select(F.col(ROW).alias("id"), "v0"), None if plain else rows.select(F.col(ROW).alias("_row"), "_name")


def named(out: DataFrame, names: DataFrame | None, id_col: str) -> DataFrame:
    """Results by row number with the rows' ids."""
    if names is None:
        return out
    met = out.join(names, F.col(id_col) == F.col("_row"))
    return met.select(*[F.col("_name").alias(c) if c == id_col else F.col(c) for c in out.columns])


ROW, OWN = "_row_number", "_own_row_number"


def map_rows(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of at most BATCH rows where the session has Spark's default, since texts may be long."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH))
    return df.mapInArrow(f, schema)


BATCH = 1000


def texts(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a text column, without a copy through str."""
    return (x.as_py() for x in column.cast(pa.binary()))


def long_lists(parts: list[np.ndarray], kind=np.int64) -> pa.ListArray:
    """Arrays as one Arrow list column."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind, copy=False)))


def list_values(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of an Arrow column as array views; a null list is empty."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for i, ok in enumerate(column.is_valid().to_numpy(zero_copy_only=False)):
        yield flat[offsets[i] : offsets[i + 1]] if ok else flat[:0]


def bucket_counts(df: DataFrame, features: Callable[[pa.RecordBatch], Iterator[tuple[str, np.ndarray]]], bits: int) -> dict[str, np.ndarray]:
    """Counters of 2**bits buckets for each key that ``features`` names, over all rows.

    ``features`` turns a batch into (key, bucket numbers). Tasks count, and 16
    parts of the counters are summed on the executors; what comes to the driver is
    one table of fixed size for each key, and there are few keys (labels).
    """
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for key, buckets in features(b):
                count = held.setdefault(key, np.zeros(size, np.int64))
                count += np.bincount(buckets, minlength=size)
        for key, count in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * PARTS), pa.array(range(PARTS), pa.int32()), pa.array(count_parts(count), pa.binary())], names=["key", "part", "counts"])

    return sum_counts(map_rows(df, run, "key string, part int, counts binary"), size)


#: Pieces in which counters are summed.
PARTS = 16


def count_parts(count: np.ndarray, kind=np.int32) -> list[bytes]:
    """A task's counters in PARTS pieces; what ``kind`` cannot hold counts as its greatest number."""
    return [x.tobytes() for x in np.split(np.minimum(count, np.iinfo(kind).max).astype(kind), PARTS)]


def sum_counts(rows: DataFrame, size: int, kind=np.int32) -> dict[str, np.ndarray]:
    """Add up (key, part, counts) rows on the executors; the driver gets ``size`` numbers for each key."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, kind).astype(np.int64) for x in pdf["counts"])
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "part": pdf["part"].iloc[:1], "counts": [total.tobytes()]})

    out: dict[str, np.ndarray] = {}
    for r in rows.groupBy("key", "part").applyInPandas(add, "key string, part int, counts binary").collect():
        n = size // PARTS
        out.setdefault(r.key, np.zeros(size, np.int64))[r.part * n : (r.part + 1) * n] = np.frombuffer(r.counts, np.int64)
    return out


def struct_lists(column: pa.ListArray) -> Iterator[tuple[np.ndarray, ...]]:
    """The lists of structs of an Arrow column, each as one array for every field; a null list is empty."""
    fields, offsets = [f.to_numpy(zero_copy_only=False) for f in column.values.flatten()], column.offsets.to_numpy()
    for i, ok in enumerate(column.is_valid().to_numpy(zero_copy_only=False)):
        a, b = (offsets[i], offsets[i + 1]) if ok else (0, 0)
        yield tuple(f[a:b] for f in fields)


def small(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows: the check before a broadcast."""
    return df.limit(rows + 1).count() <= rows


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex reachable from each vertex of the edges (u, v).

    Alternating star contractions. Large stars link the greater neighbours of a
    vertex to its least one, small stars the lesser ones; every round keeps the
    components and shortens the trees, so the rounds grow with the logarithm of
    the longest chain. They end when stars are left: every vertex has one edge, to
    a vertex that has none of its own. No component is ever gathered in one place.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.union(e.join(least, "u").select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        least2 = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        star = large.join(least2, "u")
        new = cut(star.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least2.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        for t in (least, large, least2, e):
            drop_table(t)
        e = new
    roots = e.select(F.col("u").alias("v"), F.col("v").alias("root"))
    return cut(roots.union(roots.select(F.col("root").alias("v"), "root").distinct()))


def _stars(e: DataFrame) -> bool:
    n, distinct = e.agg(F.count("*"), F.count_distinct("u")).first()
    return n == distinct and e.join(e.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty()
