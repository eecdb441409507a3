"""Recorded listing pages in any order to one sequence.

A page knows the token it was asked by (none for the first) and the token of the
next page. Where a page stands is found by pointer doubling: in every round
each page's pointer jumps twice as far, and a page whose place is known tells it to
the page its pointer meets. A chain of n pages takes log2(n) rounds of one join and one
aggregate over three narrow columns; contents join only at the end. All chains advance
together, keyed by listing and token, so a listing that holds most pages is spread
over the tasks like any other.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

NO_FIRST, INCOMPLETE, FORKED, MISSING, LOOP = "no first page", "incomplete search", "two next pages", "missing page", "loop"


class Chains(NamedTuple):
    """``sequence``: the pages before a listing's fault, with ``position`` from 0. ``report``: (listing, pages, fault, fault_at) of every listing."""

    sequence: DataFrame
    report: DataFrame


def _links(pages: DataFrame, listing: str, token: str, next_token: str, incomplete: str | None) -> DataFrame:
    """One row for each token of a listing; a page that was recorded again counts once."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    broken = F.bool_or(F.coalesce(F.col(incomplete), F.lit(False))) if incomplete else F.lit(False)
    return pages.groupBy(F.col(listing).alias("_listing"), text(token).alias("_token")).agg(
        F.min(text(next_token)).alias("_next"), (F.min(text(next_token)) != F.max(text(next_token))).alias("_forked"), broken.alias("_incomplete")
    )


def positions(links: DataFrame) -> DataFrame:
    """(_listing, _token, _position) of the pages that can be reached from their listing's first one."""
    longest = links.groupBy("_listing").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    t = links.select("_listing", "_token", F.nullif("_next", F.lit("")).alias("_jump"), F.when(F.col("_token") == "", F.lit(0).cast("bigint")).alias("_position"), F.lit(True).alias("_real"))
    step = 1
    while step < longest:
        t = staged(t)
        ahead = t.select(F.col("_listing").alias("_l"), F.col("_token").alias("_t"), F.col("_jump").alias("_far"))
        moved = t.join(ahead, F.col("_listing").eqNullSafe(F.col("_l")) & (F.col("_jump") == F.col("_t")), "left").select("_listing", "_token", F.col("_far").alias("_jump"), "_position", "_real")
        told = t.filter("_position IS NOT NULL AND _jump IS NOT NULL").select("_listing", F.col("_jump").alias("_token"), F.lit(None).cast("string").alias("_jump"), (F.col("_position") + step).alias("_position"), F.lit(False).alias("_real"))
        both = moved.union(told).groupBy("_listing", "_token").agg(F.max("_jump").alias("_jump"), F.min("_position").alias("_position"), F.max("_real").alias("_real"))
        t = both.filter("_real")  # a token that no page answers was told its place in vain
        step *= 2
    return t.filter("_position IS NOT NULL").select("_listing", "_token", "_position")


def _fault() -> Column:
    """What is wrong behind or at a page, from the page's own row and that of its next one."""
    return (
        F.when(F.col("_incomplete"), INCOMPLETE)
        .when(F.col("_forked"), FORKED)
        .when((F.col("_next") != "") & F.col("_after").isNull(), MISSING)
        .when(F.col("_after") <= F.col("_position"), LOOP)
    )


def follow(pages: DataFrame, listing: str = "listing", token: str = "pageToken", next_token: str = "nextPageToken", incomplete: str | None = None) -> Chains:
    """The chain of each listing from its first page on.

    A listing's sequence ends at its first fault: a next page that was not recorded, one
    that leads back, two different next pages of one token, or (that page left
    out) an incomplete search. Pages off the chain are not part of it, and a page that was
    recorded again counts once (with the least hash, where contents differ). Null and empty
    tokens are the same. A null listing is a listing like others.
    """
    links = staged(_links(pages, listing, token, next_token, incomplete))
    at = staged(positions(links))
    placed = links.join(at, [links[c].eqNullSafe(at[c]) for c in ("_listing", "_token")]).select(links["_listing"], links["_token"], "_next", "_forked", "_incomplete", "_position")
    after = at.select(F.col("_listing").alias("_l"), F.col("_token").alias("_t"), F.col("_position").alias("_after"))
    chain = placed.join(after, F.col("_listing").eqNullSafe(F.col("_l")) & (F.col("_next") == F.col("_t")) & (F.col("_next") != ""), "left").withColumn("_fault", _fault())
    first = F.min_by(F.when(F.col("_fault").isNotNull(), F.struct(F.col("_fault"), F.col("_position"))), F.when(F.col("_fault").isNotNull(), F.col("_position")))
    found = chain.groupBy("_listing").agg(first.alias("_f"), F.count("*").alias("_n"))
    good = F.when(F.col("_f").isNull(), F.col("_n")).otherwise(F.col("_f._position") + F.when(F.col("_f._fault") == INCOMPLETE, 0).otherwise(1))
    found = staged(found.select("_listing", good.alias("_pages"), F.col("_f._fault").alias("_fault"), F.col("_f._position").alias("_at")))
    every = links.select("_listing").distinct()
    report = every.join(found, every["_listing"].eqNullSafe(found["_listing"]), "left").select(
        every["_listing"].alias(listing), F.coalesce("_pages", F.lit(0)).alias("pages"), F.when(F.col("_pages").isNull(), NO_FIRST).otherwise(F.col("_fault")).alias("fault"), F.col("_at").alias("fault_at")
    )
    return Chains(_contents(pages, listing, token, at, found), report)


def _contents(pages: DataFrame, listing: str, token: str, at: DataFrame, found: DataFrame) -> DataFrame:
    """The recorded pages at their places; of a page that was recorded several times one row stays."""
    whole = F.struct(*[F.col(c) for c in pages.columns])
    once = pages.groupBy(F.col(listing).alias("_g"), F.coalesce(F.col(token), F.lit("")).alias("_k")).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("_page"))
    kept = at.join(found.select(F.col("_listing").alias("_l"), "_pages"), F.col("_listing").eqNullSafe(F.col("_l")) & (F.col("_position") < F.col("_pages"))).select("_listing", "_token", "_position")
    return once.join(kept, F.col("_g").eqNullSafe(F.col("_listing")) & (F.col("_k") == F.col("_token"))).select("_page.*", F.col("_position").alias("position"))


class ListingError(RuntimeError):
    """A listing whose chain of pages does not end well."""


def whole_chain(pages: DataFrame, token: str = "pageToken", next_token: str = "nextPageToken", incomplete: str | None = None) -> DataFrame:
    """The pages of one listing in order (``position``); a fault raises. No pages at all are a listing that was never answered."""
    chains = follow(pages.withColumn("_one", F.lit("")), "_one", token, next_token, incomplete)
    found = chains.report.first()  # one listing
    if found is None:
        raise ListingError(NO_FIRST)
    if found.fault:
        raise ListingError(found.fault if found.fault_at is None else f"{found.fault} at page {found.fault_at + 1}")
    return chains.sequence.drop("_one")


def chain_until_fault(pages: DataFrame, token: str = "pageToken", next_token: str = "nextPageToken") -> tuple[DataFrame, str | None]:
    """The pages of one listing before its fault, and the fault: for listings that return what came before an error."""
    chains = follow(pages.withColumn("_one", F.lit("")), "_one", token, next_token)
    found = chains.report.first()
    return chains.sequence.drop("_one"), found.fault if found else NO_FIRST
