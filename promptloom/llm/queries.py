"""The queries of this folder's operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .hardnegatives import hard_negatives
from .licenses import scan
from .mixing import curriculum, in_range, word_count
from .neighbours import near_duplicates
from .packing import pack_documents
from .pii import KINDS, LEARNED, as_text, spans
from .prefixes import prefix_trie
from .quality import judged
from .simhash import simhash_components
from .toxicity import train_and_score
from .urls import filter_urls
from .votes import fit_and_score
from .warc import read_archives, write_archives


def public_tokenizer() -> str:
    """The path of the vocabulary that the packing query's contract names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("url")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizer())


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "recall"
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    placed = curriculum(docs, size=F.col("size")).select("doc_id", "mix")
    # Rows that the mix doesn't take are due at no time; the hash spreads them.
    return in_range(placed, F.get("mix.due", F.lit(0)), F.xxhash64("doc_id", "mix.size")).select(
        "doc_id",
        "mix.size",
        "mix.source_size",
        "mix.target",
        (F.col("mix.size") * F.size("mix.due")).alias("taken"),
        F.round(F.get("mix.due", F.lit(0)), 6).alias("first_due"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_archives(spark, write_archives(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(as_text(KINDS).cast("binary"), 256).alias("base_sha256"),
        as_text((*KINDS, LEARNED)).alias("spans"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    every = F.array_sort(F.array_distinct(F.concat("base", F.transform("found", lambda x: x["label"]))))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        "score",
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    head = F.crc32(conv.cast("string").cast("binary")) % 9
    return prefix_trie(table(spark, sf_dir, "conversations"), conv - conv % 5, head)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, moved)


def op13_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [v for k, v in globals().items() if k.startswith("op") and callable(v)]
    return {f.__name__: f for f in found}


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS spot,
         CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn
  FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE turn WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         2 * source_size AS cap
  FROM sources
), leveled AS (
  SELECT *, cap / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER () - COALESCE(sum(cap) OVER earlier, 0))
         / (sum(weight) OVER () - COALESCE(sum(weight) OVER earlier, 0)) AS level
  FROM weighted
  WINDOW earlier AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, turn,
         least(CAST(cap AS DOUBLE), (SELECT arg_min(level, ratio) FROM leveled WHERE level <= ratio) * weight) AS target
  FROM leveled
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.turn,
         CAST(COALESCE(sum(d.size) OVER (
           PARTITION BY d.source ORDER BY d.spot, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), demanded AS (
  SELECT *, CAST(ahead < target AS INT) + CAST(ahead + source_size < target AS INT) AS copies,
         (ahead + size / 2) / target AS part
  FROM placed
)
SELECT doc_id, size, source_size, target, size * copies AS taken,
       CASE WHEN copies > 0 THEN round(least(CASE turn
         WHEN 0 THEN 2 * (part * 3) / (sqrt(greatest(16 + 2 * (-2.0::DOUBLE) * (part * 3), 0)) + 4)
         WHEN 1 THEN part
         ELSE 2 * (part * 2) / (sqrt(greatest(1 + 2 * 2.0::DOUBLE * (part * 2), 0)) + 1) END, 1.0), 6) END AS first_due
FROM demanded
"""


OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id AS c, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list({'role': role, 'text': text} ORDER BY place) AS said FROM turns GROUP BY c
), hashed AS (
  SELECT c, said, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x)::BIGINT),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END), 4294967295::BIGINT), 4294967295::BIGINT) % 9 AS h
  FROM own
), rebuilt AS (
  SELECT a.c, list_concat(COALESCE(b.said[1:a.h], []), a.said[a.h + 1:]) AS said
  FROM hashed a LEFT JOIN own b ON b.c = a.c - a.c % 5
), members AS (
  SELECT c, len(said) AS length, unnest(range(0, len(said) + 1)) AS depth, said FROM rebuilt
), nodes AS (
  SELECT said[1:depth] AS path, depth, min(c) AS owner, count(*) AS n,
         COALESCE(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (length = depth), '') AS ends
  FROM members GROUP BY 1, 2
), weighed AS (
  SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n - 1) * strlen(path[depth].text) END AS w FROM nodes
), linked AS (
  SELECT v.*, p.owner AS parent, p.depth AS parent_depth FROM weighed v LEFT JOIN nodes p ON p.depth = v.depth - 1 AND p.path = v.path[1:v.depth - 1]
), kids AS (
  SELECT parent AS owner, parent_depth AS depth, count(*) AS kids FROM linked WHERE parent IS NOT NULL GROUP BY 1, 2
), counted AS (
  SELECT l.*, COALESCE(k.kids, 0) AS kids FROM linked l LEFT JOIN kids k USING (owner, depth)
), below AS (
  SELECT path[1:up] AS path, up AS depth, count(*) FILTER (kids = 0) AS leaves, sum(w) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM counted) x GROUP BY 1, 2
)
SELECT owner AS conv_id, CAST(depth AS BIGINT) AS depth, parent AS parent_conv_id, n AS n_convs, kids AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM counted JOIN below USING (path, depth)
"""

OP12_SQL = r"""
WITH vectors AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same,
         list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.id % 100 = 0 AND a.id IS DISTINCT FROM b.id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": OP5_SQL, "op11_conversations": OP11_SQL, "op12_hard_negatives": OP12_SQL}
