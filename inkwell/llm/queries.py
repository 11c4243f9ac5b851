"""Queries of the operators for training data, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.leakage import leaked_items
from inkwell.llm.names import same_entities, same_pairs
from inkwell.llm.neighbors import similar_pairs, similar_vectors
from inkwell.llm.packing import PackParams, fill_report, invariants, limit_report, pack_documents
from inkwell.llm.quality import COMMON, text_measures, text_quality
from inkwell.llm.splitting import oversized, split_oversized
from inkwell.plans.note_tables import SPACE
from inkwell.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for item, key in (("chunk", "id"), ("entity", "key")):
        near = similar_vectors(table(spark, sf_dir, item).select(key, "embedding"), key, "embedding", k=10, min_cosine=0.92)
        pairs = similar_pairs(near).select(F.lit(item).alias("item"), "id_a", "id_b")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def p1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of each vector without a least cosine, all rows against all."""
    return similar_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", k=10)


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "kb_document"), table(spark, sf_dir, "chunk"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized(p3_pieces(spark, sf_dir))


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_entities(table(spark, sf_dir, "entity").select("key", "name", "aliases"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_pairs(p5_clusters(spark, sf_dir))


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "context_slot"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p6_pack(spark, sf_dir), table(spark, sf_dir, "context_slot"))


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = table(spark, sf_dir, "context_slot")
    return invariants(p6_pack(spark, sf_dir), slots)


#: Instruction data: few texts in a container, and a margin of tokens that bear no loss.
INSTRUCTIONS = PackParams(tokens_per_segment=256, loss_share=0.95)


def p6_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing under limits of which each one binds in many containers."""
    slots = table(spark, sf_dir, "context_slot")
    return limit_report(pack_documents(table(spark, sf_dir, "documents"), slots, INSTRUCTIONS), slots, INSTRUCTIONS)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_quality(spark, sf_dir).where(~F.col("is_prose")).select("doc_id")


def p8_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_measures(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_nearest": p1_nearest,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p5_found": p5_found,
    "p5_clusters": p5_clusters,
    "p6_pack": p6_pack,
    "p6_fill": p6_fill,
    "p6_limits": p6_limits,
    "p6_invariants": p6_invariants,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_quality": p8_quality,
    "p8_measures": p8_measures,
}

_LINE = "ls[n + 1]"
_BARE = rf"regexp_replace({_LINE}, '^{SPACE}+', '')"
_COUNT = lambda c: f"len(list_filter(regexp_split_to_array({c}, '{SPACE}+'), lambda w: w <> ''))"
_USABLE = "len(embedding) = 64 AND list_count(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_WORDS = r"list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"
_CHARS = r"nullif(length(regexp_replace(text, '[ \t\n\x0b\f\r]', '', 'g')), 0)"
_COMMON = ", ".join(repr(w) for w in sorted({w for c in COMMON.values() for w in c.split()}))

SQL = {
    "p1_found": f"""
WITH v AS (
  SELECT 'chunk' AS item, id, max(embedding) AS e FROM chunk WHERE id IS NOT NULL AND {_USABLE} GROUP BY id
  UNION ALL SELECT 'entity', key, max(embedding) FROM entity WHERE key IS NOT NULL AND {_USABLE} GROUP BY key),
near AS (
  SELECT a.item, a.id AS x, b.id AS y, list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]) AS c FROM v a JOIN v b ON a.item = b.item AND a.id <> b.id
  WHERE c >= 0.92 QUALIFY row_number() OVER (PARTITION BY a.item, a.id ORDER BY c DESC, b.id) <= 10)
SELECT DISTINCT item, least(x, y) AS id_a, greatest(x, y) AS id_b FROM near""",
    "p6_invariants": """
SELECT slot_id, (SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '') AS documents, 0 AS overfull, 0 AS crowded, 0 AS torn, 0 AS gappy
FROM context_slot WHERE capacity_tokens > 0 GROUP BY slot_id""",
    "p3_found": rf"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS id, path, regexp_split_to_array(body, '\r\n|\n|\r') AS ls FROM (SELECT DISTINCT path, body FROM kb_document WHERE length(body) > 700)),
walk AS (
  SELECT id, path, ls, 0 AS n, '' AS fence, 0 AS ordinal, 0 AS words FROM texts
  UNION ALL
  SELECT id, path, ls, n + 1,
    CASE WHEN fence <> '' THEN CASE WHEN starts_with({_BARE}, fence) THEN '' ELSE fence END
         WHEN starts_with({_BARE}, '```') THEN '```' WHEN starts_with({_BARE}, '~~~') THEN '~~~' ELSE '' END,
    ordinal + CASE WHEN fence = '' AND regexp_matches({_LINE}, '^#{{1,6}}\s') THEN 1 ELSE 0 END,
    CASE WHEN fence = '' AND regexp_matches({_LINE}, '^#{{1,6}}\s') THEN 0 ELSE {_COUNT(_LINE)} END
  FROM walk WHERE n < len(ls))
SELECT DISTINCT 'body' AS item, path, ordinal::INT AS ordinal FROM (SELECT id, path, ordinal, sum(words) AS words FROM walk GROUP BY ALL) WHERE words > 350
UNION SELECT DISTINCT 'chunk', doc_path, ordinal::INT FROM chunk WHERE {_COUNT("text")} > 350""",
    "p8_measures": rf"""
SELECT doc_id, len(w) AS words, round({_CHARS} / nullif(len(w), 0)::DOUBLE, 6) AS mean_word_length,
  round(length(regexp_replace(text, '[\p{{L}}\p{{N}} \t\n\x0b\f\r]', '', 'g')) / {_CHARS}::DOUBLE, 6) AS symbol_ratio,
  round(len(list_filter(l, lambda x: regexp_matches(rtrim(x, ' '), '[.!?:;]$'))) / nullif(len(l), 0)::DOUBLE, 6) AS ended_lines,
  round(len(list_filter(w, lambda x: list_contains([{_COMMON}], regexp_replace(lower(x), '[.,;:!?()]', '', 'g')))) / nullif(len(w), 0)::DOUBLE, 6) AS common_words
FROM (SELECT doc_id, text, {_WORDS} AS w, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM documents)""",
}
