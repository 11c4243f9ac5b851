"""Graph tables from the delivered, dirty ones: one row a key, labels normalised. With the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell import schemas
from inkwell.functions import text as T
from inkwell.operators.reconcile import tag_edges
from inkwell.session import table

_DOC = ["scanned_at", "chunked_hash", "extracted_hash", "content_hash", "title", "category", "subcategory", "created", "updated", "word_count", "stub"]
_CHUNK = ["doc_path", "ordinal", "text", "breadcrumb", "word_count", "embedding"]
_ENTITY = ["name", "type", "aliases", "embedding"]


def latest(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row a key: the greatest by ``columns`` in order, nulls least. Combined before the shuffle."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*columns)).alias("r")).select(key, "r.*")


def document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "kb_document"), "path", _DOC).drop("scanned_at")


def chunk(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    return latest(table(spark, sf_dir, "chunk"), "id", columns or _CHUNK)


def chunk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id`` and an ``embedding`` that is true or null: what counting asks for, without texts and vectors in the shuffle."""
    rows = table(spark, sf_dir, "chunk").where(F.col("id").isNotNull())
    return rows.groupBy("id").agg(F.max(F.when(F.col("embedding").isNotNull(), True)).alias("embedding"))


def entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = table(spark, sf_dir, "entity").withColumn("type", T.coerced("type", schemas.ENTITY_TYPES, schemas.DEFAULT_ENTITY_TYPE))
    return latest(typed, "key", _ENTITY)


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges to normal tags, through ``tag_edges``: every delivered row is a note with one tag."""
    notes = table(spark, sf_dir, "tagged").where("path is not null").select("path", T.tag_list(F.array("tag"), F.lit(None).cast("string")).alias("tags"))
    return tag_edges(notes)


def links_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "links_to").where("src is not null and dst is not null").distinct()


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.operators.entities import upsert_mentions

    return upsert_mentions(table(spark, sf_dir, "mentions"))


def relates_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.operators.entities import upsert_relations

    rows = table(spark, sf_dir, "relates_to").select(
        "source", T.coerced("type", schemas.RELATION_TYPES, schemas.DEFAULT_RELATION_TYPE).alias("type"), "target", T.confidence("confidence").alias("confidence"), "source_path", F.col("source_path").alias("seq")
    )
    return upsert_relations(rows)


def _latest(source: str, key: str, columns: list[str], keep: str) -> str:
    order = ", ".join(f"{c} DESC NULLS LAST" for c in columns)
    return f"SELECT {key}, {keep} FROM {source} WHERE {key} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"


SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def trim(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def coerced(c: str, vocabulary, default: str) -> str:
    return f"CASE WHEN lower({trim(c)}) IN ({', '.join(repr(v) for v in vocabulary)}) THEN lower({trim(c)}) ELSE '{default}' END"


_TYPED = f"(SELECT * REPLACE ({coerced('type', schemas.ENTITY_TYPES, schemas.DEFAULT_ENTITY_TYPE)} AS type) FROM entity)"
CTE = {
    "g_document": _latest("kb_document", "path", _DOC, ", ".join(_DOC[1:])),
    "g_chunk": _latest("chunk", "id", _CHUNK, ", ".join(_CHUNK)),
    "g_entity": _latest(_TYPED, "key", _ENTITY, ", ".join(_ENTITY)),
    "g_tagged": f"SELECT * FROM (SELECT DISTINCT path, lower(regexp_replace({trim('tag')}, '^#+|#+$', '', 'g')) AS tag FROM tagged WHERE path IS NOT NULL) WHERE tag <> ''",
    "g_links": "SELECT DISTINCT src, dst FROM links_to WHERE src IS NOT NULL AND dst IS NOT NULL",
    "g_mentions": "SELECT path, key, sum(coalesce(count, 0))::BIGINT AS count FROM mentions GROUP BY ALL",
    "g_relates": f"SELECT source, {coerced('type', schemas.RELATION_TYPES, schemas.DEFAULT_RELATION_TYPE)} AS type, target, max(least(1.0, greatest(0.0, coalesce(confidence, 0.5)))) AS confidence, max(source_path) AS source_path FROM relates_to GROUP BY ALL",
}


def with_tables(sql: str) -> str:
    """``sql`` preceded by the graph tables it names."""
    used = [f"{name} AS ({body})" for name, body in CTE.items() if name in sql]
    return f"WITH RECURSIVE {', '.join(used)} {sql}" if used else sql
