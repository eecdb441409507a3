"""Similarity self-join on word shingles through a token-group matrix.

1. Every text becomes its set of shingles; equal sets are one class.
2. Similar classes are partitioned into groups: classes that agree in a band of
   minimum hashes are compared with the most central class of their bucket, and
   verified links merge into groups. This costs comparisons in proportion to the
   classes, also where thousands of near copies meet.
3. The token-group matrix holds, for each token and group, the smallest set and
   the longest remainder among the group's sets that carry the token in their
   prefix (the rarest tokens, as many as a partner cannot all miss). It bounds the
   overlap of a query set with any set of the group, and a group is opened only
   where the bound reaches the threshold.
4. The query set meets the center of an opened group first; groups joined by that
   are done with each other. Sets of the other opened groups, and sets without a
   group, meet the query set only where their signatures allow it: a signature has the parity of the set's tokens in
   each of SIGNATURE buckets, so two sets differ in at least as many tokens as
   their signatures in bits. Sets around a large group that miss the threshold by
   little share its tokens, and would else be paired with all of it.
5. What is left is verified on whole sets. Every pair of sets above the threshold
   shares a prefix token, so no link between groups is lost; links inside a group
   add nothing to its component.

The order of tokens comes from a counting sketch of fixed size over all texts.
Any order is exact; a good one only makes prefixes rare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PARTS, ROW, as_they_were, by_row, components, count_parts, cut, drop_table, list_values, long_lists, map_rows, named, numbered, small, sum_counts, texts
from .shingles import WordHashes, mix, shingle_set

WORDS, PERCENT = 5, 75
BANDS, WIDTH = 8, 2
#: log2 of the sketch's counters: 1 MB for each task, whatever the input.
SKETCH_BITS = 20
#: Bits of a signature, and sets of a group that its center is judged by.
SIGNATURE, PICKS = 2048, 16
#: Rows of a table that may be broadcast (16 bytes each), checked by a count.
BROADCAST_ROWS = 200_000
#: Prefix tokens of a bucket in which tokens meet, and of a chunk that deals them out (16 bytes each).
BUCKET_TOKENS, CHUNK = 2_000_000, 1_000_000

_SEEDS = np.random.default_rng(8).integers(1, 2**63, BANDS * WIDTH, dtype=np.uint64)


def describe(words: int = WORDS):
    """(id, text) to (id, n, digest, bands): set size, a 128-bit digest of the set, and band keys of minimum hashes.

    After its texts, a task adds the rows (part, counts) of its share of the
    sketch: how many of its texts hold the tokens of each hash bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, shift, count = WordHashes(), np.uint64(64 - SKETCH_BITS), np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            ns, digests, bands = [], [], []
            for text in texts(b.column(1)):
                s = shingle_set(text, words, hashes)
                ns.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    least = np.array([mix(s ^ seed).min() for seed in _SEEDS], np.uint64).reshape(BANDS, WIDTH)
                    bands.append(mix(least[:, 0] * np.uint64(31) + least[:, 1]).view(np.int64))
                    np.add.at(count, (s >> shift).astype(np.int64), 1)
                else:
                    bands.append(np.empty(0, np.int64))
            none = pa.nulls(len(ns), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), long_lists(bands), none, pa.nulls(len(ns), pa.binary())], names=_DESCRIBED)
        null = pa.nulls(PARTS, pa.int64())
        yield pa.RecordBatch.from_arrays([null, null, pa.nulls(PARTS, pa.binary()), pa.nulls(PARTS, pa.list_(pa.int64())), pa.array(range(PARTS), pa.int32()), pa.array(count_parts(count, np.uint8), pa.binary())], names=_DESCRIBED)

    return run


_DESCRIBED = ["id", "n", "digest", "bands", "part", "counts"]


def prefixes(counts, words: int = WORDS, percent: int = PERCENT):
    """(id, text) to (id, n, tokens, bits): the rarest tokens of a set, one more than a partner above the threshold may miss, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, shift, count = WordHashes(), np.uint64(64 - SKETCH_BITS), counts.value
        for b in batches:
            ns, parts, bits = [], [], []
            for text in texts(b.column(1)):
                s = shingle_set(text, words, hashes)
                keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                rare = count[(s >> shift).astype(np.int64)]
                order = np.lexsort((s, rare))[:keep]
                ns.append(len(s))
                parts.append(s[order].view(np.int64))
                odd = np.bincount((s % np.uint64(SIGNATURE)).astype(np.int64), minlength=SIGNATURE) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), long_lists(parts), long_lists(bits)], names=["id", "n", "tokens", "bits"])

    return run


def apart(bits, other):
    """In how many bits two signatures differ."""
    return sum((F.bit_count(F.get(bits, F.lit(k)).bitwiseXOR(F.get(other, F.lit(k)))) for k in range(SIGNATURE // 64)), F.lit(0))


def may_link(n: str, bits: str, m: str, other: str, percent: int):
    """Whether two sets can reach the threshold: at most (100 - percent) / (100 + percent) of their sizes' sum may differ."""
    return (100 + percent) * apart(bits, other) <= (100 - percent) * (F.col(n) + F.col(m))


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), long_lists([shingle_set(x, words, hashes).view(np.int64) for x in texts(b.column(1))])], names=["id", "tokens"])

    return run


def verified(pairs: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) of ids whose whole sets reach the threshold. Sets are built only for the ids named."""
    ids = cut(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    few = F.broadcast(ids) if small(ids, BROADCAST_ROWS) else ids
    sets = cut(map_rows(docs.join(few, "id", "left_semi").select("id", "v0"), _sets(words), "id long, tokens array<long>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(list_values(b.column(2)), list_values(b.column(3)), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("id").alias("u"), F.col("tokens").alias("x"))
    right = sets.select(F.col("id").alias("v"), F.col("tokens").alias("y"))
    out = cut(map_rows(pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y"), run, "u long, v long"))
    drop_table(sets)
    return out


def group_links(classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Verified links between classes and the most central class of each band bucket they fall in."""
    keys = cut(classes.select("id", F.posexplode("bands").alias("band", "key")))
    full = cut(keys.groupBy("band", "key").agg(F.count("*").alias("c")).filter("c > 1"))
    inside = cut(keys.join(full, ["band", "key"]))
    central = cut(inside.groupBy("id").agg(F.sum("c").alias("central")))
    ranked = inside.join(central, "id")
    leader = cut(ranked.groupBy("band", "key").agg(F.max_by("id", F.struct("central", -F.col("id"))).alias("v")))
    pairs = cut(inside.join(leader, ["band", "key"]).select(F.col("id").alias("u"), "v").filter("u != v").distinct())
    for t in (keys, full, inside, central, leader):
        drop_table(t)
    return verified(pairs, docs, words, percent)


def _ends(tokens: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens, and for each the least and the greatest of its groups."""
    order = np.lexsort((groups, tokens))
    tokens, groups = tokens[order], groups[order]
    change = np.flatnonzero(tokens[1:] != tokens[:-1]) + 1
    first = np.concatenate((np.zeros(min(1, len(tokens)), np.int64), change))
    last = np.concatenate((change, np.full(min(1, len(tokens)), len(tokens))))[: len(first)] - 1
    return tokens[first], groups[first], groups[last]


def in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the sets by chunks of about CHUNK tokens, each of one task."""
    task, chunk, held = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        names = []
        for size in np.diff(b.column(3).offsets.to_numpy()).tolist():
            names.append(task << 32 | chunk)
            held += size
            if held >= CHUNK:
                chunk, held = chunk + 1, 0
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *b.columns], names=["chunk", *b.schema.names])


def shared_tokens(prefix: DataFrame, buckets: int) -> DataFrame:
    """(token, id, grp, alone, n, p) for the tokens that prefixes of at least two groups hold, with their places p.

    A chunk sends each token to the token's bucket once, or twice where its groups
    differ, so a frequent token weighs no more than any other. The bucket tells a
    chunk which of its tokens meet, and the chunk looks them up in its sets. All
    this goes in plain arrays, since nearly all tokens end in the bucket.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, tokens, groups = None, [], []

        def flush() -> pa.RecordBatch:
            t, low, high = _ends(np.concatenate(tokens), np.concatenate(groups))
            two = low != high
            t, g = np.concatenate((t, t[two])), np.concatenate((low, high[two]))
            to = (t.view(np.uint64) >> np.uint64(8)) % np.uint64(buckets)
            order = np.lexsort((g, to))
            t, g, to = t[order], g[order], to[order]
            cuts = np.flatnonzero(to[1:] != to[:-1]) + 1
            names = to[np.concatenate((np.zeros(1, np.int64), cuts))].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array([chunk] * len(names), pa.int64()), *[pa.array([x.tobytes() for x in np.split(y, cuts)], pa.binary()) for y in (t, g)]], names=["bucket", "chunk", "tokens", "grps"])

        for b in batches:
            for name, grp, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), list_values(b.column(2)), strict=True):
                if name != chunk and tokens:
                    yield flush()
                    tokens, groups = [], []
                chunk = name
                tokens.append(x)
                groups.append(np.full(len(x), grp, np.int64))
        if tokens:
            yield flush()

    def meet(t: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, np.int64) for x in t.column("tokens").to_pylist()]
        token, low, high = _ends(np.concatenate(sent), np.frombuffer(b"".join(t.column("grps").to_pylist()), np.int64))
        token = token[low != high]
        return pa.table({"chunk": t.column("chunk"), "tokens": pa.array([x[_among(x, token)].tobytes() for x in sent], pa.binary())})

    def find(sets: pa.Table, met: pa.Table) -> pa.Table:
        token = np.unique(np.frombuffer(b"".join(met.column("tokens").to_pylist()), np.int64))
        out = []
        for b in sets.combine_chunks().to_batches():
            lists = b.column(5)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            at = np.flatnonzero(_among(flat, token))
            row = np.repeat(np.arange(len(b)), np.diff(offsets))[at]
            out.append(pa.table([pa.array(flat[at]), *[c.take(pa.array(row)) for c in b.columns[1:5]], pa.array(at - (offsets[:-1] - offsets[0])[row])], schema=_SHARED))
        return pa.concat_tables(out) if out else _SHARED.empty_table()

    met = map_rows(prefix.select("chunk", "grp", "tokens"), spread, "bucket long, chunk long, tokens binary, grps binary").groupBy("bucket").applyInArrow(meet, "chunk long, tokens binary")
    met = cut(met.filter(F.octet_length("tokens") > 0))
    out = cut(prefix.select("chunk", "id", "grp", "alone", "n", "tokens").groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(find, "token long, id long, grp long, alone boolean, n long, p long"))
    drop_table(met)
    return out


_SHARED = pa.schema([("token", pa.int64()), ("id", pa.int64()), ("grp", pa.int64()), ("alone", pa.bool_()), ("n", pa.int64()), ("p", pa.int64())])


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values of x are in the sorted array known."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def group_centers(prefix: DataFrame) -> DataFrame:
    """(grp, center): the set of each group whose signature is nearest to those of PICKS sets picked by hash; ties go to the least id."""
    members = prefix.filter("not alone").select("grp", "id", "bits")
    picks = members.groupBy("grp", F.pmod(F.xxhash64("id"), F.lit(PICKS)).alias("k")).agg(F.min_by("bits", F.xxhash64("id")).alias("pick"))
    picks = picks.groupBy("grp").agg(F.collect_list("pick").alias("picks"))  # at most PICKS
    far = F.aggregate("picks", F.lit(0), lambda total, pick: total + apart("bits", pick))
    return cut(members.join(picks, "grp").select("grp", "id", far.alias("far")).groupBy("grp").agg(F.min_by("id", F.struct("far", "id")).alias("center")))


def cross_links(prefix: DataFrame, centers: DataFrame, docs: DataFrame, buckets: int, words: int, percent: int) -> DataFrame:
    """Verified links (u, v) between groups: enough of them to join all groups between which there is any.

    prefix: chunk, id, grp, alone, n, tokens, bits; centers: grp, center. Query
    sets are compared with the center of the groups they open first. Groups that
    this joins are not opened for each other any more, so two large groups of one
    cluster don't meet member by member.

    A set of n tokens that carries
    a token at place p of its prefix has rest = n - p tokens left, so a partner m
    must satisfy (100 + percent) * rest >= percent * (n + m): ``most`` is the
    largest such m.

    Tokens that the same ids carry (the shingles of a passage) bring the same
    pairs, so one of them stands for all: the first in the order of tokens, whose
    bounds are the widest. Carriers are compared by a 128-bit digest and a count.
    """
    full = shared_tokens(prefix, buckets)
    sign = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"s{k}") for k in range(2)]
    seen = full.groupBy("token").agg(F.min("n").alias("least"), F.count("*").alias("c"), *sign, F.min_by("p", "id").alias("place"))
    first = cut(seen.groupBy("c", "s0", "s1").agg(F.min_by("token", "place").alias("token"), F.min("least").alias("least")).select("token", "least"))
    rest = F.col("n") - F.col("p")
    most = F.call_function("div", (100 + percent) * rest - percent * F.col("n"), F.lit(percent))
    kept = cut(full.join(first, "token").withColumn("most", most).filter("most >= least").select("token", "grp", "alone", "id", "n", "most"))
    rows = cut(kept.join(prefix.select("id", "bits"), "id"))
    for t in (full, first, kept):
        drop_table(t)
    side = lambda df, a: df.select("token", F.col("grp").alias(f"g{a}"), F.col("alone").alias(f"a{a}"), F.col("id").alias(a), F.col("n").alias(f"n{a}"), F.col("most").alias(f"m{a}"), F.col("bits").alias(f"b{a}"))
    fits = (F.col("nu") <= F.col("mv")) & (F.col("nv") <= F.col("mu")) & may_link("nu", "bu", "nv", "bv", percent)
    singles, groups = rows.filter("alone"), rows.filter("not alone")
    pairs = cut(side(singles, "u").join(side(singles, "v"), "token").filter((F.col("u") < F.col("v")) & fits).select("u", "v").distinct())
    matrix = cut(groups.groupBy("token", "grp").agg(F.min("n").alias("least"), F.max("most").alias("reach")).withColumnRenamed("grp", "other"))
    reaches = (F.col("au") | (F.col("other") > F.col("gu"))) & (F.col("least") <= F.col("mu")) & (F.col("nu") <= F.col("reach"))
    opened = cut(side(rows, "u").join(matrix, "token").filter(reaches).drop("au", "least", "reach").withColumnRenamed("other", "gv"))
    middle = prefix.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("bits").alias("bv")).join(centers, F.col("v") == F.col("center"))
    asked = opened.dropDuplicates(["u", "gv"]).join(middle.withColumnRenamed("grp", "gv"), "gv").filter(may_link("nu", "bu", "nv", "bv", percent))
    asked = cut(asked.select("u", "v", "gu", "gv"))
    links = verified(asked.select("u", "v"), docs, words, percent)
    joined = components(asked.join(links, ["u", "v"]).select(F.col("gu").alias("u"), F.col("gv").alias("v")))
    name = lambda g: joined.select(F.col("v").alias(g), F.col("root").alias(f"r{g}"))
    apart = F.coalesce("rgu", "gu") != F.coalesce("rgv", "gv")
    opened_yet = cut(opened.join(name("gu"), "gu", "left").join(name("gv"), "gv", "left").filter(apart).drop("gu", "rgu", "rgv"))
    more = cut(opened_yet.join(side(groups, "v"), ["token", "gv"]).filter(fits).select("u", "v").distinct())
    for t in (rows, matrix, opened, opened_yet, asked):
        drop_table(t)
    return links.union(verified(cut(pairs.union(more)), docs, words, percent))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (the smallest id reachable by links of at least the threshold).

    Null and blank texts have no shingles and stand alone. Every row is
    a document, also where ids are missing or repeat; a component without any id has a
    null component_id; an empty table gives an empty result; other columns are ignored.
    """
    rows, names = numbered(docs, id_col, text_col)
    all_rows = cut(map_rows(rows, describe(words), "id long, n long, digest binary, bands array<long>, part int, counts binary"))
    counts = sum_counts(all_rows.filter("part is not null").select(F.lit("").alias("key"), "part", "counts"), 1 << SKETCH_BITS, np.uint8).get("", np.zeros(1 << SKETCH_BITS, np.int64))
    seen = all_rows.filter("part is null").select("id", "n", "digest", "bands")
    classes = cut(seen.filter("n > 0").groupBy("n", "digest").agg(F.min("id").alias("id"), F.first("bands").alias("bands")))
    links = group_links(classes, rows, words, percent)
    roots = components(links)
    counts = docs.sparkSession.sparkContext.broadcast(counts.astype(np.int32))  # 4 MB
    prefix = map_rows(rows, prefixes(counts, words, percent), "id long, n long, tokens array<long>, bits array<long>")
    grouped = classes.select("id").join(roots.withColumnRenamed("v", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("grp"), F.col("root").isNull().alias("alone"))
    prefix = prefix.join(grouped, "id").select("id", "grp", "n", "tokens", "alone", "bits")
    prefix = cut(map_rows(prefix, in_chunks, "chunk long, id long, grp long, n long, tokens array<long>, alone boolean, bits array<long>"))
    held = prefix.agg(F.sum(F.size("tokens"))).first()[0] or 0
    more = cross_links(prefix, group_centers(prefix), rows, 1 + held // BUCKET_TOKENS, words, percent)
    drop_table(prefix)
    roots = components(links.union(more))
    by_class = classes.select("n", "digest", "id").join(roots.withColumnRenamed("v", "id"), "id", "left").select("n", "digest", F.coalesce("root", "id").alias("root"))
    out = seen.select("id", "n", "digest").join(cut(by_class), ["n", "digest"], "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))
    if names is None:
        return out
    out = cut(named(out.withColumn("_in", F.col("component_id")), names, id_col))
    least = out.groupBy("_in").agg(F.min(id_col).alias("component_id"))  # an id, where any row of the component has one
    return out.drop("component_id").join(least, "_in").select(id_col, "n_shingles", "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with all their columns; one row of each, also where ids are missing or repeat."""
    rows, _ = by_row(docs, id_col, text_col)
    stay = near_groups(rows.select(ROW, text_col), ROW, text_col).filter(F.col(ROW) == F.col("component_id")).select(F.col(ROW).alias("_stay"))
    return rows.join(stay, F.col(ROW) == F.col("_stay"), "left_semi").transform(as_they_were, docs)
