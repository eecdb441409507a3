"""One query for each corpus operator, with production parameters over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automaton, centroids, chat, contamination, exact, html, jaccard, language, negatives, packing, suffixes, tokenfile, toxicity
from .common import scratch, table

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _ALL[f.__name__] = (f, sql)
        return f

    return add


@query()
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


OP2 = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || chr(10)))
         + length(regexp_replace(replace(text, chr(92), chr(92) || chr(92)), '<(\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|\\|startoftext\\|>|s>|/s>|<SYS>>|</SYS>>)|\\[(INST\\]|/INST\\])', '<+\\1\\2', 'g'))
         + length('<|im_start|>') + length('<|im_end|>') + 2) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@query(OP2)
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as the one branch of its tree, read back from the formatted text."""
    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_trees(chat.linear_trees(rows)).select(F.col("tree").alias("conv_id"), "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("own"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("own").cast("long").alias("loss_chars"),
        F.sha2(F.col("own").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query()
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


@query()
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.dedup_words(table(spark, sf_dir, "documents")).drop("kept")


@query()
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_bytes(table(spark, sf_dir, "documents")).drop("kept")


OP6 = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""


@query(OP6)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@query()
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query()
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents"))


@query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.identify_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")

_NEAREST = """
a{n} AS MATERIALIZED (SELECT k, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT k, c, CAST(sum((e.x - m.x) * (e.x - m.x)) AS BIGINT) AS d FROM e JOIN c{n} m USING (i) GROUP BY k, c) GROUP BY k),"""
_MEANS = """
c{m} AS MATERIALIZED (SELECT c, i, coalesce(y, x) AS x FROM c{n} LEFT JOIN (SELECT c, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS y FROM e JOIN a{n} USING (k) GROUP BY c, i) USING (c, i)),"""
OP11 = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS vector FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64),
e AS MATERIALIZED (SELECT k, unnest(range(64)) AS i, unnest(vector) AS x FROM v),
c0 AS MATERIALIZED (SELECT c, unnest(range(64)) AS i, unnest(vector) AS x FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), vector) - 1 AS c, vector FROM v ORDER BY 1 LIMIT 16)),
{"".join(_NEAREST.format(n=n) + _MEANS.format(n=n, m=n + 1) for n in range(3))}{_NEAREST.format(n=3)}
h AS (SELECT c, sha256(string_agg(x, ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a3 JOIN v USING (k) JOIN h USING (c)
"""


@query(OP11)
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(*centroids.cluster_vectors(table(spark, sf_dir, "embeddings")))


OP12 = """
WITH r AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (SELECT a.k AS a, a.vec_id AS anchor_id, r.k, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score FROM (SELECT * FROM r WHERE vec_id % 100 = 0) a JOIN r ON a.k <> r.k),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, k) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.vec_id, s.k) AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""


@query(OP12)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector carries a false label first."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return negatives.mine_negatives(rows)


@query()
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as it is read back from the shards, by their index."""
    path = f"{scratch(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path)
    return tokenfile.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))



def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in sorted(_ALL.items(), key=lambda x: int(x[0][2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}
