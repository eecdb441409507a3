import random

import pytest

from depotlens.operators import paging

PAGE = "listing string, pageToken string, nextPageToken string, files array<int>, bad boolean"


def chain(name, n, end=""):
    """n pages in order; ``end`` is what the last one leads to."""
    tokens = ["", *[f"{name}{k}" for k in range(1, n)], end]
    return [(name, tokens[k] or None, tokens[k + 1], [k], False) for k in range(n)]


def run(spark, rows, shuffle=True):
    random.Random(1).shuffle(rows) if shuffle else None
    c = paging.follow(spark.createDataFrame(rows, PAGE), incomplete="bad")
    sequence = {}
    for r in sorted(c.sequence.collect(), key=lambda r: r.position):
        sequence.setdefault(r.listing, []).append((r.position, r.files[0]))
    return sequence, {r.listing: (r.pages, r.fault, r.fault_at) for r in c.report.collect()}


def test_pages_of_many_listings_in_any_order(spark):
    rows = [x for n in (1, 2, 3, 7, 8, 9, 33) for x in chain(f"l{n}", n)]
    sequence, report = run(spark, rows)
    for n in (1, 2, 3, 7, 8, 9, 33):
        assert sequence[f"l{n}"] == [(k, k) for k in range(n)] and report[f"l{n}"] == (n, None, None)


def test_faults_end_a_listing_where_they_are_met(spark):
    gap = [r for r in chain("gap", 9) if r[1] != "gap5"]
    broken = [(*r[:4], r[1] == "broken3") for r in chain("broken", 6)]
    fork = [*chain("fork", 5), ("fork", "fork2", "fork4", [2], False)]
    off = [*chain("off", 3), ("off", "elsewhere", "off2", [9], False), ("off", "more", "elsewhere", [9], False)]
    again = chain("again", 4) + chain("again", 4)
    headless = chain("headless", 4)[1:]
    rows = gap + broken + fork + off + again + headless + chain("loop", 6, "loop2") + chain("self", 3, "self2") + [(None, None, "x", [0], False), (None, "x", None, [1], None)]
    sequence, report = run(spark, rows)
    assert report == {
        "gap": (5, paging.MISSING, 4),
        "broken": (3, paging.INCOMPLETE, 3),
        "fork": (3, paging.FORKED, 2),
        "off": (3, None, None),
        "again": (4, None, None),
        "headless": (0, paging.NO_FIRST, None),
        "loop": (6, paging.LOOP, 5),
        "self": (3, paging.LOOP, 2),
        None: (2, None, None),
    }
    for name, (pages, _, _) in report.items():
        assert sequence.get(name, []) == [(k, k) for k in range(pages)]


def test_a_long_chain_takes_few_joins(spark, monkeypatch):
    rounds = []
    real = paging.staged
    monkeypatch.setattr(paging, "staged", lambda df: rounds.append(1) or real(df))
    rows = chain("long", 10_000)
    random.Random(2).shuffle(rows)
    links = paging._links(spark.createDataFrame(rows, PAGE), "listing", "pageToken", "nextPageToken", None)
    got = paging.positions(links).toPandas()
    assert len(rounds) <= 14
    assert all(t == (f"long{p}" if p else "") for t, p in zip(got["_token"], got["_position"], strict=True)) and len(got) == 10_000


def test_one_listing(spark):
    df = lambda rows: spark.createDataFrame(rows, PAGE)
    assert sorted(r.position for r in paging.whole_chain(df(chain("a", 4))).collect()) == [0, 1, 2, 3]
    with pytest.raises(paging.ListingError, match="missing page at page 4"):
        paging.whole_chain(df(chain("a", 4, "gone")))
    with pytest.raises(paging.ListingError, match="no first page"):
        paging.whole_chain(df([]))
    got, fault = paging.chain_until_fault(df(chain("a", 4, "gone")))
    assert got.count() == 4 and fault == paging.MISSING
    got, fault = paging.chain_until_fault(df([]))
    assert got.count() == 0 and fault == paging.NO_FIRST
