"""Exact dedup by deterministic block naming; DataFrame operations only.

A text, lower-cased A-Z only, is split into blocks of a fixed size. The distinct
blocks of the corpus are sorted, and a block's name is its place in that order.
Then adjacent names are paired, the distinct pairs are sorted and named alike,
and so on, until one name is left of every text. Two texts are equal exactly
when their block counts and last names are.

A block meets its name through a 64-bit fingerprint, so its text moves once. A
fingerprint that two different blocks share is found by a count, and such blocks
are named and joined by their full text: no collision can merge two texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, as_they_were, ascii_lower, by_row, cut, drop_table

BLOCK = 4096


def _names(distinct: DataFrame, keys: list[str], sign: int = 1) -> DataFrame:
    """A number for each row of a table of distinct keys: the partition, then the place in its sorted order."""
    place = F.monotonically_increasing_id()
    return distinct.sortWithinPartitions(*keys).withColumn("name", place if sign > 0 else -place - 2)


def _fingerprint(block: str) -> Column:
    return F.xxhash64(block)


def block_names(docs: DataFrame, block: int = BLOCK, fingerprint=_fingerprint) -> DataFrame:
    """(id, v0) to (id, n, pos, name, sha): the named blocks of every text, with the text's digest at block 0."""
    cut_up = F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    parts = F.when(F.char_length("norm") <= block, F.array("norm")).otherwise(cut_up)
    rows = docs.select("id", ascii_lower(F.coalesce("v0", F.lit(""))).alias("norm")).select("id", parts.alias("parts"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
    blocks = rows.select("id", F.size("parts").alias("n"), "sha", F.posexplode("parts").alias("pos", "block"))
    keyed = blocks.select("id", "n", "pos", F.when(F.col("pos") == 0, F.col("sha")).alias("sha"), fingerprint("block").alias("h"), "block")

    distinct = rows.select(F.explode("parts").alias("block")).distinct()
    names = cut(_names(distinct, ["block"]).select(fingerprint("block").alias("h"), "name"))
    shared = names.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    if shared.isEmpty():
        return cut(keyed.drop("block").join(names, "h").drop("h"))
    shared = cut(shared)
    plain = keyed.drop("block").join(names.join(shared, "h", "left_anti"), "h").drop("h")
    rest = keyed.join(shared, "h", "left_semi")
    full = cut(_names(rest.select("block").distinct(), ["block"], -1))
    return cut(plain.unionByName(rest.join(full, "block").drop("block", "h")))


def text_names(named: DataFrame) -> DataFrame:
    """(id, n, pos, name) to (id, n, name): adjacent names are paired and named until one is left."""
    longest = named.agg(F.max("n")).first()[0] or 0
    done = named.filter("n = 1").select("id", "n", "name")
    level = named.filter("n > 1").select("id", "n", "pos", "name")
    width = longest
    while width > 1:
        even = F.col("pos") % 2 == 0
        pairs = level.groupBy("id", "n", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b")
        )
        pairs = cut(pairs)
        names = cut(_names(pairs.select("a", "b").distinct(), ["a", "b"]))
        level = cut(pairs.join(names, ["a", "b"]).drop("a", "b"))
        drop_table(pairs)
        width = (width + 1) // 2
    return done.unionByName(level.select("id", "n", "name")) if longest > 1 else done


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, fingerprint=_fingerprint) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Equal texts (A-Z folded; null equals empty) are one group and its largest id
    stays. Rows of a repeated id are returned and counted each, also where they
    repeat the text. Rows without an id are read too, and their ``kept`` is null. An empty table gives an empty result; other columns are
    ignored.
    """
    rows, plain = by_row(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("v0")), id_col, "v0")
    named = block_names(rows.select(F.col(ROW).alias("id"), "v0"), block, fingerprint)
    whole = text_names(named).withColumn("doc", F.col("id"))
    if not plain:
        whole = whole.drop("doc").join(rows.select(F.col(ROW).alias("id"), F.col(id_col).alias("doc")), "id")
    whole = cut(whole)
    groups = cut(whole.groupBy("n", "name").agg(F.max("doc").alias("keep_id"), F.count("*").alias("group_size")))
    digests = named.filter("pos = 0").select("id", "sha")
    found = whole.join(groups, ["n", "name"]).select("id", "doc", "keep_id", "group_size")
    return found.join(digests, "id").select(
        F.col("doc").alias(id_col), "keep_id", "group_size", (F.col("doc") == F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group, also where ids are missing or repeat."""
    rows, _ = by_row(docs, id_col, text_col)
    stay = exact_groups(rows.select(ROW, text_col), ROW, text_col).filter("kept").select(F.col(ROW).alias("_stay"))
    return rows.join(stay, F.col(ROW) == F.col("_stay"), "left_semi").transform(as_they_were, docs)
