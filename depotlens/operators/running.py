"""Running sums over a long order, in two levels.

A window over one key runs in one task, however many rows the key has. Here rows are
dealt by ranges of (key, order), so a hot key spreads over many tasks; sums run inside
each range, and what the ranges before it sum to is added. The ranges of a key are
as many rows as there are tasks, whatever the key's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged


def in_ranges(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """The rows with the number of their range of (keys, order) as ``_range``; ranges are in order.

    Spark draws the bounds from a sample, anew for every plan, so the dealt rows are
    written once: all that is computed from them sees the same ranges.
    """
    columns = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    dealt = df.repartitionByRange(partitions, *columns) if partitions else df.repartitionByRange(*columns)
    return staged(dealt.withColumn("_range", F.spark_partition_id()))


def _carried(parts: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """What the ranges before each range of a key sum to."""
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*keys, "_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{name}") for name, c in sums.items()])


def _meet(df: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what comes before their range."""
    there = carried.select(*[F.col(c).alias(f"_there_{c}") for c in keys], F.col("_range").alias("_there"), *[c for c in carried.columns if c not in (*keys, "_range")])
    same = F.col("_range") == F.col("_there")
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"_there_{c}"))
    return df.join(there, same).drop("_there", *[f"_there_{c}" for c in keys])


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """df with the running sum of each expression over the rows of a key in this order, the row itself included.

    ``order`` must tell the rows of a key apart; nulls come first, and null values count as 0.
    """
    valued = in_ranges(df, keys, order, partitions).withColumns({f"_v_{name}": F.coalesce(c, F.lit(0)).cast("bigint") for name, c in sums.items()})
    inside = Window.partitionBy("_range", *keys).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    ran = valued.withColumns({name: F.sum(f"_v_{name}").over(inside) for name in sums})
    totals = valued.groupBy(*keys, "_range").agg(*[F.sum(f"_v_{name}").alias(f"_v_{name}") for name in sums])
    out = _meet(ran, _carried(totals, keys, {name: F.col(f"_v_{name}") for name in sums}), keys)
    return out.withColumns({name: F.col(name) + F.col(f"_before_{name}") for name in sums}).select(*df.columns, *sums)


def running_streaks(df: DataFrame, keys: list[str], order: list[str], hit: Column, name: str = "streak", partitions: int | None = None) -> DataFrame:
    """df with how many rows in a row, up to this one, were hits; any other row resets the count.

    The same two levels: a range hands on the hits behind its last reset, and those that it
    was handed where it has no reset.
    """
    marked = in_ranges(df, keys, order, partitions).withColumn("_hit", F.coalesce(hit, F.lit(False)))
    ordered = Window.partitionBy("_range", *keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    resets = marked.withColumn("_resets", F.count_if(~F.col("_hit")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("_range", *keys, "_resets").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    local = resets.withColumn("_run", F.count_if("_hit").over(run))
    last = F.struct(*order)
    parts = local.groupBy(*keys, "_range").agg(F.max_by("_run", last).alias("_tail"), F.max("_resets").alias("_r"))
    # ranges between two that reset hand on the sum of their hits
    upto = Window.partitionBy(*keys).orderBy("_range")
    parts = parts.withColumn("_block", F.sum(F.when(F.col("_r") > 0, 1).otherwise(0)).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    held = Window.partitionBy(*keys, "_block").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("_held", F.sum("_tail").over(held)).withColumn("_before_run", F.coalesce(F.lag("_held").over(upto), F.lit(0)))
    out = _meet(local, parts.select(*keys, "_range", "_before_run"), keys)
    return out.withColumn(name, F.when(F.col("_resets") == 0, F.col("_run") + F.col("_before_run")).otherwise(F.col("_run"))).select(*df.columns, name)


def scan_counters(items: DataFrame, partitions: int | None = None) -> DataFrame:
    """What a scan's counters say after each of its events (scan_id, event_id, listed, done): listing adds to pending, an item that is done moves on to processed.

    An item that was skipped was listed and never done, so it stays pending.
    """
    done = F.coalesce(F.col("done").cast("bigint"), F.lit(0))
    return running_sums(items, ["scan_id"], ["event_id"], {"processed_count": done, "pending_count": F.coalesce("listed", F.lit(0)) - done}, partitions)
