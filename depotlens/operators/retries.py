"""What an attempt log says about retries: who got through, who was skipped, which listing failed.

An attempt is (listing, item, attempt, code, reason); ``attempt`` orders all attempts of a
listing. A code below 400 is a success. Three rules of the connectors:

* a message is asked again after a retryable failure, so many times, then skipped, and the scan goes on;
* a mail listing fails at its third failure in a row, or at one that is not retryable; a success resets the count;
* a media listing shares one budget among all its pages and fails when that is used up.

Only what an item or a listing did until its end counts; attempts behind it are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .running import running_streaks, running_sums

MESSAGE_RETRIES, LISTING_TRIES, LISTING_BUDGET = 3, 3, 25


def failed() -> Column:
    """A missing status is a failure of the connection."""
    return F.coalesce(F.col("code") >= 400, F.lit(True))


def retryable() -> Column:
    return F.coalesce(C.is_retryable(F.col("code"), F.col("reason")), F.lit(False))


def item_outcomes(attempts: DataFrame, keys: tuple[str, ...] = ("listing", "item"), retries: int = MESSAGE_RETRIES) -> DataFrame:
    """(keys, outcome, tries) of every item: ``stored`` at its first success, ``skipped`` at a failure that may not
    be retried or is one too many, ``open`` where the log ends before either.

    Only the first ``retries + 1`` attempts of an item can matter. A rank limit keeps just
    these in every task before the shuffle, so an item that was asked without end costs no more than others.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("attempt").asc_nulls_last())
    first = attempts.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= retries + 1)
    end = F.when(~failed(), "stored").when(~retryable() | (F.col("_n") == retries + 1), "skipped")
    found = first.withColumn("_end", end).groupBy(*keys).agg(F.min_by(F.when(F.col("_end").isNotNull(), F.struct("_end", "_n")), F.when(F.col("_end").isNotNull(), F.col("_n"))).alias("_e"), F.max("_n").alias("_all"))
    return found.select(*keys, F.coalesce("_e._end", F.lit("open")).alias("outcome"), F.coalesce("_e._n", F.col("_all")).cast("bigint").alias("tries"))


def listings_in_a_row(attempts: DataFrame, keys: tuple[str, ...] = ("listing",), tries: int = LISTING_TRIES, partitions: int | None = None) -> DataFrame:
    """(keys, attempts, failures, failed_at, fatal) where ``tries`` failures in a row, or one that may not be retried, fail a listing.

    ``failed_at`` is the attempt at which it failed, null for one that went through; ``attempts`` and ``failures`` count up to it.
    """
    ran = running_streaks(attempts, list(keys), ["attempt"], failed(), "_streak", partitions)
    fatal = failed() & ~retryable()
    return _report(ran, attempts, keys, fatal | (F.col("_streak") >= tries), fatal, partitions)


def listings_by_budget(attempts: DataFrame, keys: tuple[str, ...] = ("listing",), budget: int = LISTING_BUDGET, partitions: int | None = None) -> DataFrame:
    """The same where all pages of a listing share a budget of failures, of whatever kind."""
    ran = running_sums(attempts, list(keys), ["attempt"], {"_spent": failed().cast("bigint")}, partitions)
    return _report(ran, attempts, keys, F.col("_spent") > budget, F.lit(False), partitions)


def _report(ran: DataFrame, attempts: DataFrame, keys: tuple[str, ...], end: Column, fatal: Column, partitions: int | None) -> DataFrame:
    """One row for each listing, from its attempts up to the first that ends it. Both steps are plain aggregates with partial sums."""
    ends = ran.groupBy(*keys).agg(F.min(F.when(end, F.col("attempt"))).alias("failed_at"), F.min(F.when(fatal, F.col("attempt"))).alias("_fatal"))
    there = ends.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "failed_at", "_fatal")
    same = F.lit(True)
    for i, c in enumerate(keys):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    lived = attempts.join(there, same).filter(F.col("failed_at").isNull() | (F.col("attempt") <= F.col("failed_at")))
    counted = lived.groupBy(*keys, "failed_at", F.coalesce(F.col("failed_at") == F.col("_fatal"), F.lit(False)).alias("fatal"))
    return counted.agg(F.count("*").alias("attempts"), F.count_if(failed()).alias("failures")).select(*keys, "attempts", "failures", "failed_at", "fatal")
