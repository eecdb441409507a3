"""Benchmark decontamination by a prefix-filtered set join.

Items are cut into windows, windows into shingles. Containment needs every shingle
of a window, so only runs of places that all hold a benchmark's shingle, as many as
the shortest window has, can hold a window. One pass over the texts finds them: such
a run can't lie between two places that are looked at, if these are no farther apart.
The runs are counted to order the benchmark's shingles by rarity. A window's rarest
shingle is its necessary prefix: runs are joined to windows on that token, places
where the window would leave the run are ruled out, and the rest is compared word by
word.

Windows are rows like any other, so a large benchmark spreads over tasks. Tasks
that read texts hold a Bloom filter of the benchmark's tokens, of at most
2**FILTER_BITS bits: it only saves rows, what it lets through in vain finds no partner
in the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, as_they_were, by_row, cut, long_lists, map_rows, named, numbered, texts
from .shingles import FOLD, WordHashes, mix, windows

WINDOW, SHINGLE = 13, 3
#: A filter has at most 2**28 bits (32 MB), in PIECES pieces, and PROBES bits for each token.
FILTER_BITS, PIECES, PROBES = 28, 64, 4
#: Windows in one Arrow batch.
CHUNK = 2000


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def codes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A token for each run of ``width`` words; equal runs have equal tokens, the reverse is checked later."""
    return windows(hashes, width) + np.uint64(width) if len(hashes) >= width else hashes[:0]


class TokenFilter:
    """Which tokens may be in a set: no false negatives."""

    def __init__(self, bits: np.ndarray, log: int):
        self.bits, self.log = bits, log

    @staticmethod
    def bit(token: np.ndarray, probe: int, log: int) -> np.ndarray:
        return mix(token + np.uint64(probe * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - log)

    def places(self, tokens: np.ndarray) -> np.ndarray:
        at = np.arange(len(tokens))
        for probe in range(PROBES):
            bit = self.bit(tokens[at], probe, self.log)
            at = at[(self.bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        return at


def token_filter(tokens: DataFrame, most: int = FILTER_BITS) -> TokenFilter:
    """The filter of a column of tokens. Its bits are set on the executors; the driver gets 2**most of them at most."""
    log = min(most, max(16, (32 * tokens.count()).bit_length()))
    size = (1 << log) // PIECES

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            token = b.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([TokenFilter.bit(token, k, log) for k in range(PROBES)]).astype(np.int64))], names=["bit"])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        piece = np.zeros(size, np.uint8)
        piece[pdf["bit"].to_numpy() % size] = 1
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "bits": [np.packbits(piece, bitorder="little").tobytes()]})

    placed = map_rows(tokens, bits, "bit long").distinct().withColumn("piece", F.floor(F.col("bit") / size))
    out = np.zeros(1 << log >> 3, np.uint8)
    for r in placed.groupBy("piece").applyInPandas(fill, "piece long, bits binary").collect():
        out[r.piece * size // 8 : (r.piece + 1) * size // 8] = np.frombuffer(r.bits, np.uint8)
    return TokenFilter(out, log)


def _cut_items(window: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        hashes = WordHashes()
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                words = words_of(text)
                n = min(window, len(words))
                width = min(SHINGLE, n)
                tokens = codes(hashes.of(words), width).view(np.int64) if words else []
                for a in range(len(words) - n + 1 if words else 0):
                    yield item, words[a : a + n], tokens[a : a + n - width + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batched(each(batches), CHUNK):
            item, words, tokens = zip(*part)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(words, pa.list_(pa.binary())), long_lists(list(tokens))], names=["item", "words", "tokens"])

    return run


def every(words: list[bytes], hashes: WordHashes, width: int, step: int) -> np.ndarray:
    """The tokens at places step - 1, 2 * step - 1, ...; of any ``step`` places in a row, one is among these."""
    n = len(words) - width + 1
    if n < step:
        return np.empty(0, np.uint64)
    if step <= width:
        return codes(hashes.of(words), width)[step - 1 :: step]
    beside = np.stack([hashes.of(words[step - 1 + i : n + i : step]) for i in range(width)], axis=1)
    return codes(beside.ravel(), width)[::width]


def _runs(known, steps: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sizes, tokens = [], {width: [np.empty(0, np.uint64)] for width in steps}
            for text in texts(b.column(1)):
                words = words_of(text)
                sizes.append(len(words))
                for width, step in steps.items():
                    tokens[width].append(every(words, hashes, width, step))
            runs = [[] for _ in sizes]
            for width, step in steps.items():
                ends = np.cumsum([len(x) for x in tokens[width][1:]])
                at = known.value.places(np.concatenate(tokens[width]))
                for i in np.unique(np.searchsorted(ends, at, "right")).tolist():
                    words = words_of(next(texts(b.column(1).slice(i, 1))))
                    held = np.zeros(len(words) - width + 3, np.int8)
                    held[known.value.places(codes(hashes.of(words), width)) + 1] = 1
                    edge = np.flatnonzero(np.diff(held)).tolist()
                    runs[i] += [{"first": p, "width": width, "words": words[p : q + width - 1]} for p, q in zip(edge[::2], edge[1::2]) if q - p >= step]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(RUN))], names=["id", "n_words", "runs"])

    return run


RUN = pa.struct([("first", pa.int64()), ("width", pa.int32()), ("words", pa.list_(pa.binary()))])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        held = [np.empty(0, np.uint64)]
        for runs in b.column(1).to_pylist():
            held.append(np.unique(np.concatenate([codes(hashes.of(r["words"]), r["width"]) for r in runs])))
        token, n = np.unique(np.concatenate(held), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])


def _places(prefix, window: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        hashes = WordHashes()
        for b in batches:
            for i, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for r in runs:
                    token = codes(hashes.of(r["words"]), r["width"])
                    for at in prefix.value.places(token).tolist():
                        first = max(0, at - window + 1)
                        yield i, r["first"] + at, int(token[at].view(np.int64)), at - first, r["words"][first : at + window]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batched(each(batches), CHUNK):
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*part), kinds)], names=["id", "at", "token", "lead", "around"])

    return run


def matches(rows: DataFrame, items: DataFrame, window: int = WINDOW, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(id, n_words) of all rows (id, text), and (id, a, b, item): the words [a, b) are a window of that item (item, text)."""
    share = rows.sparkSession.sparkContext.broadcast
    cuts = cut(map_rows(items, _cut_items(window), "item string, words array<binary>, tokens array<long>"))
    steps: dict[int, int] = {}
    for (size,) in cuts.select(F.size("words")).distinct().collect():
        width = min(size, SHINGLE)
        steps[width] = min(size - width + 1, steps.get(width, window))
    known = share(token_filter(cuts.select(F.explode("tokens").alias("token")).distinct(), filter_bits))
    found = cut(map_rows(rows, _runs(known, steps), "id long, n_words long, runs array<struct<first:bigint,width:int,words:array<binary>>>"))
    held = found.filter(F.size("runs") > 0).select("id", "runs")
    counted = map_rows(held, _counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    # a window with a shingle that no run holds is in no text: the inner minimum below drops it
    placed = cuts.dropDuplicates(["words"]).select("words", F.posexplode("tokens").alias("place", "token")).join(counted, "token", "left")
    rarest = placed.groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "place")).alias("r"))
    prefix = cut(rarest.filter("r.n > 0").select("words", F.size("words").alias("size"), "r.token", "r.place"))
    chosen = share(token_filter(prefix.select("token").distinct(), filter_bits))
    hits = map_rows(held, _places(chosen, window), "id long, at long, token long, lead int, around array<binary>")
    skip = F.col("lead") - F.col("place")
    met = (
        hits.join(prefix, "token")
        .filter((skip >= 0) & (skip + F.col("size") <= F.size("around")))
        .filter(F.slice("around", F.greatest(skip, F.lit(0)) + 1, F.col("size")) == F.col("words"))
        .select("id", (F.col("at") - F.col("place")).alias("a"), (F.col("at") - F.col("place") + F.col("size")).alias("b"), "words")
    )
    return found.select("id", "n_words"), cut(met).join(cuts.select("words", "item").distinct(), "words").select("id", "a", "b", "item")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_hit, n_items, items (as sorted strings), spans (hit word ranges), contaminated.

    Null texts have no words. An item without words or without an id has no
    windows; items of one id are taken together. Every document row is
    judged by itself, also where ids are missing or repeat; empty tables give no rows or
    no hits.
    """
    rows, names = numbered(docs, id_col, text_col)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).filter("item is not null and text is not null").distinct()
    sizes, found = matches(rows, items, window, filter_bits)
    before = Window.partitionBy("id").orderBy("a")
    apart = F.col("a") > F.max("b").over(before.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.groupBy("id", "a").agg(F.max("b").alias("b")).withColumn("new", F.coalesce(apart, F.lit(False)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(before)).groupBy("id", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    hit = runs.groupBy("id").agg(F.sum(F.col("b") - F.col("a")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))
    whose = found.select("id", "item").distinct().groupBy("id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = sizes.join(hit, "id", "left").join(whose, "id", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<a:bigint,b:bigint>>")).alias("spans"),
    )
    return named(out, names, id_col).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns, also where ids are missing or repeat."""
    rows, _ = by_row(docs, id_col, text_col)
    stay = contamination(rows.select(ROW, F.col(text_col).alias("text")), benchmark, ROW).filter("not contaminated").select(F.col(ROW).alias("_stay"))
    return rows.join(stay, F.col(ROW) == F.col("_stay"), "left_semi").transform(as_they_were, docs)
