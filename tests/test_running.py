import random

import pytest
from pyspark.sql import functions as F

from depotlens.operators import retries, running


def log(n=3000, seed=4):
    """Attempts of listings, one of which holds most; codes of every kind, also none."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        listing = "hot" if i % 3 else rng.choice(["a", "b", "c", None])
        code = rng.choice([200] * 8 + [429, 403, 403, 404, 500, None])
        rows.append((listing, f"i{rng.randrange(200)}", i, code, rng.choice(["rateLimitExceeded", "userRateLimitExceeded", "other", None])))
    return rows


SCHEMA = "listing string, item string, attempt bigint, code int, reason string"


@pytest.mark.parametrize("partitions", [None, 1, 3, 40])
def test_running_sums_and_streaks(spark, partitions):
    rows = log()
    df = spark.createDataFrame(rows, SCHEMA)
    bad = F.coalesce(F.col("code") >= 400, F.lit(True))
    sums = {r.attempt: (r.n, r.failures) for r in running.running_sums(df, ["listing"], ["attempt"], {"n": F.lit(1), "failures": bad.cast("int")}, partitions).collect()}
    streaks = {r.attempt: r.streak for r in running.running_streaks(df, ["listing"], ["attempt"], bad, partitions=partitions).collect()}
    count, failures, streak = {}, {}, {}
    for listing, _, at, code, _ in rows:
        hit = code is None or code >= 400
        count[listing] = count.get(listing, 0) + 1
        failures[listing] = failures.get(listing, 0) + hit
        streak[listing] = streak.get(listing, 0) + 1 if hit else 0
        assert sums[at] == (count[listing], failures[listing]) and streaks[at] == streak[listing]
    assert len(sums) == len(streaks) == len(rows)


def test_streaks_across_ranges_without_a_reset(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("at"))
    got = running.running_streaks(df, ["k"], ["at"], F.col("at") != 10, partitions=16).filter("at >= 995").orderBy("at")
    assert [r.streak for r in got.collect()] == [985, 986, 987, 988, 989]


def test_a_hot_key_is_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("at"))
    sizes = [r.n for r in running.in_ranges(df, ["k"], ["at"], 16).groupBy("_range").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 20_000 / 8


def is_retryable(code, reason):
    return code == 429 or (code == 403 and reason == "rateLimitExceeded")


def test_items_are_stored_skipped_or_open(spark):
    rows = log()
    rows += [("x", "fails", 10_000 + i, 429, None) for i in range(6)] + [("x", "last try", 20_000 + i, 429 if i < 3 else 200, None) for i in range(5)] + [("x", "one", 30_000, 429, None), ("x", "fatal", 40_000, 404, None), ("x", "fatal", 40_001, 200, None)]
    got = {(r.listing, r.item): (r.outcome, r.tries) for r in retries.item_outcomes(spark.createDataFrame(rows, SCHEMA)).collect()}
    asked = {}
    for listing, item, _, code, reason in sorted(rows, key=lambda r: r[2]):
        asked.setdefault((listing, item), []).append((code, reason))
    for key, answers in asked.items():
        outcome, tries = "open", len(answers)
        for n, (code, reason) in enumerate(answers):
            if code is not None and code < 400:
                outcome, tries = "stored", n + 1
                break
            if not is_retryable(code, reason) or n == 3:
                outcome, tries = "skipped", n + 1
                break
        assert got[key] == (outcome, tries), key
    assert got["x", "fails"] == ("skipped", 4) and got["x", "last try"] == ("stored", 4) and got["x", "one"] == ("open", 1)


def plain(rows, rule):
    out = {}
    for listing, _, at, code, reason in sorted(rows, key=lambda r: r[2]):
        s = out.setdefault(listing, {"attempts": 0, "failures": 0, "row": 0, "failed_at": None, "fatal": False})
        if s["failed_at"] is not None:
            continue
        bad = code is None or code >= 400
        s["attempts"] += 1
        s["failures"] += bad
        s["row"] = s["row"] + 1 if bad else 0
        fatal = bad and not is_retryable(code, reason)
        if rule == "row" and (fatal or s["row"] >= 3):
            s["failed_at"], s["fatal"] = at, fatal
        if rule == "budget" and s["failures"] > 25:
            s["failed_at"] = at
    return {k: (s["attempts"], s["failures"], s["failed_at"], s["fatal"]) for k, s in out.items()}


@pytest.mark.parametrize("partitions", [None, 7])
def test_listings(spark, partitions):
    rows = log() + [("fine", "p", i, 200, None) for i in range(9000, 9010)] + [("row", "p", 9100 + i, c, "rateLimitExceeded") for i, c in enumerate([200, 429, 403, 200, 403, 429, 429, 200])]
    df = spark.createDataFrame(rows, SCHEMA)
    take = lambda out: {r.listing: (r.attempts, r.failures, r.failed_at, r.fatal) for r in out.collect()}
    assert take(retries.listings_in_a_row(df, partitions=partitions)) == plain(rows, "row")
    assert take(retries.listings_by_budget(df, partitions=partitions)) == plain(rows, "budget")
    assert take(retries.listings_in_a_row(df))["row"] == (7, 5, 9106, False)


def test_no_attempts(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert retries.item_outcomes(df).count() == retries.listings_in_a_row(df).count() == retries.listings_by_budget(df).count() == 0
