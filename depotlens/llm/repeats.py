"""Where do passages of a corpus repeat? The frame that both substring dedups fill in.

A window is ``length`` consecutive units (words or bytes) of one text. A window is
a repeat if its units also start earlier: at a smaller id, or before it in the same
text. The steps:

1. Anchors. Every window is named after its rarest-looking inner gram (the least
   hash among its grams, the leftmost of equals), so equal windows have equal
   anchors and about two windows in w start a new one.
2. An anchor that occurs once marks windows that occur once. The other windows are
   sent on, to the route of the smallest id that has their anchor: equal windows
   take the same route, and neighbouring windows mostly do, as one region.
   Where a route would get more than ``HEAVY`` units, its anchors become routes.
3. Equal regions are one region, of their earliest occurrence: the passage that a
   third of all texts hold is looked at once. A route that still has more than
   ``HEAVY`` bytes, such as an anchor at the edge of a passage with ever different
   surroundings, gets no index: its windows are told apart by a hash first, and
   those whose hash occurs again are grouped by their units.
4. Each shard of routes finds, by its own index (suffix automaton or suffix array),
   which windows of its regions are no repeats. A text loses the units of its
   routed windows that are not among these.

Steps 1 to 3 only leave out windows that can't be repeats; step 4 decides on the
units themselves, so no hash decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_table, map_rows, struct_lists, texts
from .shingles import mix

#: Bytes of regions in a shard's index; windows on a route before it is split by anchor, and bytes of its regions before it is split by window.
SHARD_BYTES, HEAVY = 1_000_000, 3_000_000


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k units, k a power of two, by doubling."""
    size, p = 1, 0x9E3779B97F4A7C15
    while size < k:
        h = h[:-size] * np.uint64(p) + h[size:]
        p = p * p % 2**64
        size *= 2
    return mix(h)


def anchors(h: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, number of windows) of each run of windows with one anchor."""
    n = len(h) - length + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none
    g = grams(h, k)
    w = length - k + 1
    least = (g & ~np.uint64(0xFFFFFFFF)) | np.arange(len(g), dtype=np.uint64)
    size = 1
    while size < w:
        step = min(size, w - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return g[at[first]].view(np.int64), first, np.diff(np.append(first, n))


def _anchor_rows(units: Callable[[bytes], np.ndarray], length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            found = [anchors(units(x or b""), length, k) for x in texts(b.column(1))]
            if not found:
                continue
            hs, first, count = (np.concatenate(x) for x in zip(*found, strict=True))
            rows = np.repeat(ids, [len(x[0]) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(hs), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))], names=["id", "h", "a", "c"])

    return run


def _region_rows(slices: Callable[[bytes], Callable[[int, int], bytes]], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"route": [], "id": [], "start": [], "units": []}
            for i, text, (a, c, route) in zip(b.column(0).to_pylist(), texts(b.column(1)), struct_lists(b.column(2)), strict=True):
                part = slices(text)
                first = np.flatnonzero(np.concatenate(([True], (route[1:] != route[:-1]) | (a[:-1] + c[:-1] != a[1:]))))
                last = np.append(first[1:], len(a)) - 1
                for start, end, way in zip(a[first].tolist(), (a[last] + c[last]).tolist(), route[first].tolist(), strict=True):
                    out["route"].append(way)
                    out["id"].append(i)
                    out["start"].append(start)
                    out["units"].append(part(start, end + length - 1))
            yield pa.RecordBatch.from_arrays([pa.array(out["route"], pa.int64()), pa.array(out["id"], pa.int64()), pa.array(out["start"], pa.int32()), pa.array(out["units"], pa.binary())], names=list(out))

    return run


def _spans(news: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boolean arrays as (array, start, length) of their runs of True."""
    begins = np.cumsum([1, *(len(x) + 1 for x in news)])
    flags = np.zeros(begins[-1], np.int8)
    for begin, new in zip(begins.tolist(), news, strict=False):
        flags[begin : begin + len(new)] = new
    edge = np.diff(flags)
    a, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    of = np.searchsorted(begins, a, "right") - 1
    return of, a - begins[of], end - a


def _shard(index: Callable[[list[bytes]], list[np.ndarray]]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "start"], kind="stable")
        of, a, c = _spans(index(list(pdf["units"])))
        return pd.DataFrame({"id": pdf["id"].to_numpy()[of], "a": (a + pdf["start"].to_numpy()[of]).astype(np.int32), "c": c.astype(np.int32)})

    return run


def _window_hashes(slices: Callable[[bytes], Callable[[int, int], bytes]], units: Callable[[bytes], np.ndarray], length: int):
    """(w, id, start, o): the hash of each window of a region and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, start, region in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), strict=True):
                part, n = slices(region), len(units(region)) - length + 1
                w = np.array([xxhash.xxh3_64_intdigest(part(o, o + length)) for o in range(n)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(np.full(n, i, np.int64)), pa.array(np.full(n, start, np.int32)), pa.array(np.arange(n, dtype=np.int32))], names=["w", "id", "start", "o"])

    return run


def _window_units(slices: Callable[[bytes], Callable[[int, int], bytes]], length: int):
    """(id, a, units) of the wanted windows of each region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, start, region, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), b.column(3).to_pylist(), strict=True):
                part = slices(region)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(wanted), pa.int64()), pa.array([start + o for o in wanted], pa.int32()), pa.array([part(o, o + length) for o in wanted], pa.binary())], names=["id", "a", "units"])

    return run


def _new_by_window(regions: DataFrame, units: Callable[[bytes], np.ndarray], slices: Callable[[bytes], Callable[[int, int], bytes]], length: int) -> DataFrame:
    """(id, a, c): the windows of regions (id, start, units) that occur in no earlier one, without an index.

    No group holds more than Spark can sum up on its way: a hash that occurs once
    is a new window, and the others are grouped by their units.
    """
    seen = cut(map_rows(regions.select("id", "start", "units"), _window_hashes(slices, units, length), "w long, id long, start int, o int"))
    counts = cut(seen.groupBy("w").agg(F.count("*").alias("n"), F.min(F.struct("id", "start", "o")).alias("at")))
    once = counts.filter("n = 1").select("at.id", (F.col("at.start") + F.col("at.o")).alias("a"))
    wanted = seen.join(counts.filter("n > 1").select("w"), "w").groupBy("id", "start").agg(F.collect_list("o").alias("wanted"))
    again = map_rows(regions.join(wanted, ["id", "start"]).select("id", "start", "units", "wanted"), _window_units(slices, length), "id long, a int, units binary")
    again = again.groupBy("units").agg(F.min(F.struct("id", "a")).alias("at")).select("at.id", "at.a")
    return once.union(again).select("id", "a", F.lit(1).alias("c"))


def repeat_windows(
    docs: DataFrame,
    units: Callable[[bytes], np.ndarray],
    slices: Callable[[bytes], Callable[[int, int], bytes]],
    index: Callable[[list[bytes]], list[np.ndarray]],
    length: int,
    k: int,
    shard_bytes: int = SHARD_BYTES,
    heavy: int = HEAVY,
) -> DataFrame:
    """(id, v0) to (id, sent, kept): the routed windows of a text and those of them that are no repeats, as lists of (a, c).

    ``units`` hashes a text's units, ``slices`` gives the bytes of a range of units,
    and ``index`` gets regions in their order and tells which of each one's
    windows occur in no earlier place. Texts without routed windows have no row.
    """
    found = cut(map_rows(docs.select("id", "v0"), _anchor_rows(units, length, k), "id long, h long, a int, c int"))
    shared = cut(found.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1").select("h", "first"))
    sent = cut(found.join(shared, "h").select("id", "a", "c", "first", "h"))
    drop_table(found)
    load = cut(sent.groupBy("first").agg(F.sum("c").alias("w")).filter(F.col("w") > heavy).select("first", F.lit(True).alias("split")))
    route = F.when(F.col("split"), F.xxhash64("h")).otherwise(F.col("first"))
    routed = sent.join(load, "first", "left").select("id", F.struct("a", "c", route.alias("route")).alias("r"))
    runs = cut(routed.groupBy("id").agg(F.array_sort(F.collect_list("r")).alias("runs")))
    drop_table(sent)
    regions = map_rows(docs.join(runs, "id").select("id", "v0", "runs"), _region_rows(slices, length), "route long, id long, start int, units binary")
    regions = regions.groupBy("route", "units").agg(F.min(F.struct("id", "start")).alias("at")).select("route", "units", "at.id", "at.start")
    regions = cut(regions)
    size = F.octet_length("units").cast("long")
    loads = regions.groupBy("route").agg(F.sum(size).alias("size")).filter(F.col("size") > heavy).select("route")
    loads = cut(loads)
    whole, split = regions, None
    if not loads.isEmpty():
        whole, split = regions.join(loads, "route", "left_anti"), regions.join(loads, "route", "left_semi")
    total = whole.agg(F.sum(size)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    shard = F.pmod(F.xxhash64("route"), F.lit(shards)).alias("shard")
    kept = whole.select(shard, "id", "start", "units").groupBy("shard").applyInPandas(_shard(index), "id long, a int, c int")
    kept = cut(kept if split is None else kept.union(_new_by_window(split, units, slices, length)))
    drop_table(regions)
    kept = kept.groupBy("id").agg(F.collect_list(F.struct("a", "c")).alias("kept"))
    sent = runs.select("id", F.transform("runs", lambda r: F.struct(r["a"].alias("a"), r["c"].alias("c"))).alias("sent"))
    return cut(sent.join(kept, "id", "left"))


def removed_units(n: int, length: int, sent, kept) -> np.ndarray:
    """Which of n units lie in a routed window that is a repeat."""
    windows = np.zeros(n + 1, np.int32)
    for (a, c), sign in ((sent, 1), (kept, -1)):
        np.add.at(windows, a, sign)
        np.add.at(windows, a + c, -sign)
    edge = np.flatnonzero(np.diff(np.cumsum(windows[:n]) > 0, prepend=False, append=False))
    cover = np.zeros(n + length + 1, np.int32)
    cover[edge[::2]] = 1
    cover[edge[1::2] + length - 1] -= 1
    return np.cumsum(cover[:n]) > 0
