"""Queries of the graph operators over the delivered tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell import schemas
from inkwell.functions import text as T
from inkwell.functions import vectors as V
from inkwell.operators import chunking, entities, graph, reconcile
from inkwell.plans import note_tables as N
from inkwell.plans.note_tables import SPACE, coerced, trim, with_tables
from inkwell.session import table
from inkwell.sources import corpus, providers

HUB, OTHER, TAG, SINCE = "Vaultd", "Note graph", "cache", "2026-01-01"
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_tables(sql)
        return f

    return add


@query(f"SELECT path, title, updated FROM g_document WHERE path IN (SELECT path FROM g_tagged WHERE tag = '{TAG}')")
def documents_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return graph.documents_by_tag(N.document(spark, d), N.tagged(spark, d), f" #{TAG.upper()} ")


@query("SELECT tag, count(*) AS documents FROM g_tagged GROUP BY tag HAVING count(*) >= 2")
def list_tags(spark: SparkSession, d: str) -> DataFrame:
    return graph.list_tags(N.tagged(spark, d), 2)


@query("""
SELECT (SELECT count(*) FROM g_document WHERE NOT coalesce(stub, FALSE)) AS documents, (SELECT count(*) FROM g_document WHERE stub) AS stubs,
  (SELECT count(*) FROM g_chunk) AS chunks, (SELECT count(embedding) FROM g_chunk) AS embedded_chunks, (SELECT count(DISTINCT tag) FROM g_tagged) AS tags,
  (SELECT count(*) FROM g_entity) AS entities, (SELECT count(*) FROM g_links) AS links_to, (SELECT count(*) FROM g_tagged) AS tagged,
  (SELECT count(*) FROM g_mentions) AS mentions, (SELECT count(*) FROM g_relates) AS relates_to""")
def graph_overview(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_overview(N.document(spark, d), N.chunk_flags(spark, d), N.tagged(spark, d), N.entity(spark, d).drop("embedding"), N.links_to(spark, d), N.mentions(spark, d), N.relates_to(spark, d))


@query("""
SELECT path, title, category, coalesce(tags, []) AS tags, coalesce(links_out, []) AS links_out, coalesce(links_in, []) AS links_in, coalesce(entities, []) AS entities
FROM g_document
LEFT JOIN (SELECT path, list_sort(list(tag)) AS tags FROM g_tagged GROUP BY path) USING (path)
LEFT JOIN (SELECT src AS path, list_sort(list(dst)) AS links_out FROM g_links GROUP BY src) USING (path)
LEFT JOIN (SELECT dst AS path, list_sort(list(src)) AS links_in FROM g_links GROUP BY dst) USING (path)
LEFT JOIN (SELECT path, list_sort(list(DISTINCT name || ' (' || type || ')')) AS entities FROM g_mentions JOIN g_entity USING (key) GROUP BY path) USING (path)""")
def entities_in_document(spark: SparkSession, d: str) -> DataFrame:
    return graph.entities_in_documents(N.document(spark, d), N.tagged(spark, d), N.links_to(spark, d), N.mentions(spark, d), N.entity(spark, d).drop("embedding"))


_USABLE = "len(embedding) = 64 AND list_count(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _first_usable(spark: SparkSession, d: str) -> list:
    usable = table(spark, d, "chunk").where(F.col("id").isNotNull() & V.usable(F.col("embedding"), 64))
    return usable.select("id", "doc_path", "embedding").orderBy("id", F.desc("doc_path"), F.desc("embedding")).limit(1).collect()


@query(f"""
SELECT a.id, a.doc_path AS path, a.breadcrumb AS section, round((1 + {_COS}) / 2, 4) AS score,
  array_to_string(list_slice(list_filter(regexp_split_to_array(a.text, '{SPACE}+'), lambda w: w <> ''), 1, 60), ' ') || '…' AS snippet
FROM g_chunk a, (SELECT embedding FROM g_chunk WHERE {_USABLE} ORDER BY id LIMIT 1) b WHERE {_USABLE.replace("embedding", "a.embedding")}
ORDER BY score DESC, a.id LIMIT 8""")
def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    first = _first_usable(spark, d)
    probe = first[0].embedding if first else [1.0] * 64
    return graph.semantic_search(table(spark, d, "chunk").where("id is not null"), probe)


@query(f"""
SELECT path, title, round(s, 4) AS score FROM (
  SELECT path, max(s) AS s FROM (
    SELECT b.id AS probe, a.doc_path AS path, (1 + {_COS}) / 2 AS s
    FROM (SELECT * FROM g_chunk WHERE {_USABLE}) a, (SELECT * FROM g_chunk WHERE {_USABLE} AND doc_path = (SELECT doc_path FROM g_chunk WHERE {_USABLE} ORDER BY id LIMIT 1)) b
    QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY s DESC, a.id) <= 20) GROUP BY path)
JOIN g_document USING (path) WHERE path <> (SELECT doc_path FROM g_chunk WHERE {_USABLE} ORDER BY id LIMIT 1) ORDER BY score DESC, path LIMIT 8""")
def similar_documents(spark: SparkSession, d: str) -> DataFrame:
    first = _first_usable(spark, d)
    return graph.similar_documents(N.document(spark, d), N.chunk(spark, d, ["doc_path", "embedding"]), first[0].doc_path if first else "")


_BOTH = "(SELECT row_number() OVER () AS e, source, type, target FROM g_relates)"


@query(f"""
, both_ways AS (SELECT e, source AS f, type, target AS t FROM {_BOTH} UNION ALL SELECT e, target, type, source FROM {_BOTH} WHERE source <> target),
start AS (SELECT key FROM g_entity WHERE lower(name) = lower('{HUB}') OR len(list_filter(coalesce(aliases, []), lambda x: lower(x) = lower('{HUB}'))) > 0),
one AS (SELECT t AS ent, e, [type] AS via FROM both_ways JOIN start ON f = key),
two AS (SELECT b.t AS ent, list_append(one.via, b.type) AS via FROM one JOIN both_ways b ON b.f = one.ent WHERE b.e <> one.e),
reached AS (SELECT DISTINCT ent, via FROM (SELECT ent, via FROM one UNION ALL SELECT ent, via FROM two))
SELECT * FROM (SELECT name AS entity, type, len(via)::INT AS hops, via, coalesce(list_slice(list_sort(list(DISTINCT path) FILTER (path IS NOT NULL)), 1, 4), []) AS documents
FROM reached JOIN (SELECT key, name, type FROM g_entity) ON key = ent
LEFT JOIN (SELECT key AS mk, path FROM g_mentions WHERE path IN (SELECT path FROM g_document)) ON mk = ent
GROUP BY name, type, via) ORDER BY hops, entity, type, array_to_string(via, ',') LIMIT 40""")
def find_related_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.find_related_entities(N.entity(spark, d), N.relates_to(spark, d), N.mentions(spark, d), N.document(spark, d), HUB.lower())


@query(f"""
, both_ways AS (SELECT DISTINCT source AS f, type, target AS t FROM g_relates UNION SELECT DISTINCT target, type, source FROM g_relates),
starts AS (SELECT key FROM g_entity WHERE lower(name) = lower('{HUB}')), goals AS (SELECT key FROM g_entity WHERE lower(name) = lower('{OTHER}')),
walk AS (
  SELECT key AS node, [key] AS keys, []::VARCHAR[] AS types, 0 AS hops FROM starts WHERE key NOT IN (SELECT key FROM goals)
  UNION ALL
  SELECT * FROM (
    SELECT b.t AS node, list_append(w.keys, b.t) AS keys, list_append(w.types, b.type) AS types, w.hops + 1 AS hops
    FROM walk w JOIN both_ways b ON b.f = w.node WHERE w.hops < 6 AND NOT list_contains(w.keys, b.t) AND w.node NOT IN (SELECT key FROM goals)
    QUALIFY row_number() OVER (PARTITION BY b.t ORDER BY list_append(w.keys, b.t), list_append(w.types, b.type)) = 1)),
best AS (SELECT keys, types, hops FROM walk WHERE node IN (SELECT key FROM goals) ORDER BY hops, keys, types LIMIT 1)
SELECT list(name ORDER BY n) AS nodes, any_value(types) AS relations, any_value(hops)::INT AS hops
FROM (SELECT types, hops, unnest(keys) AS key, generate_subscripts(keys, 1) AS n FROM best) JOIN (SELECT key, name FROM g_entity) USING (key) GROUP BY types""")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    return graph.shortest_path(N.entity(spark, d), N.relates_to(spark, d), HUB, OTHER)


@query(f"""
SELECT path, title, updated FROM g_mentions JOIN (SELECT key FROM g_entity WHERE lower(name) = lower('{HUB}')) USING (key) JOIN g_document USING (path)
WHERE updated >= '{SINCE}' ORDER BY updated DESC NULLS FIRST, path LIMIT 25""")
def recent_related_changes(spark: SparkSession, d: str) -> DataFrame:
    return graph.recent_related_changes(N.entity(spark, d), N.mentions(spark, d), N.document(spark, d), HUB, SINCE)


@query("SELECT path FROM g_document WHERE NOT coalesce(stub, FALSE) AND chunked_hash IS DISTINCT FROM content_hash")
def stale_chunks(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.stale(N.document(spark, d), "chunked_hash").select("path")


@query("SELECT path FROM g_document WHERE NOT coalesce(stub, FALSE) AND extracted_hash IS DISTINCT FROM content_hash")
def stale_extraction(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.stale(N.document(spark, d), "extracted_hash").select("path")


@query("SELECT path FROM g_document WHERE NOT coalesce(stub, FALSE)")
def stale_forced(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.stale(N.document(spark, d), "chunked_hash", force=True).select("path")


@query("""
SELECT DISTINCT path FROM document_snapshot WHERE NOT coalesce(stub, FALSE) AND snapshot_no < (SELECT max(snapshot_no) FROM document_snapshot)
AND path NOT IN (SELECT path FROM document_snapshot WHERE snapshot_no = (SELECT max(snapshot_no) FROM document_snapshot) AND path IS NOT NULL)""")
def prune_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "document_snapshot").select("snapshot_no", "path", "stub")
    last = rows.agg(F.max("snapshot_no").alias("last"))
    old, new = rows.join(last, rows["snapshot_no"] < last["last"]), rows.join(last, rows["snapshot_no"] == last["last"])
    return reconcile.prune_documents(old, new).select("path").distinct()


@query("SELECT path FROM g_document WHERE stub AND path NOT IN (SELECT dst FROM g_links)")
def orphan_stubs(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.orphan_stubs(N.document(spark, d), N.links_to(spark, d)).select("path")


@query("""SELECT DISTINCT tag FROM g_tagged WHERE tag NOT IN (SELECT tag FROM g_tagged JOIN kb_document USING (path) WHERE deleted_at IS NULL)""")
def orphan_tags(spark: SparkSession, d: str) -> DataFrame:
    alive = table(spark, d, "kb_document").where("deleted_at is null").select("path")
    return reconcile.orphan_tags(N.tagged(spark, d), N.tagged(spark, d).join(alive, "path", "left_semi"))


@query("SELECT src, dst FROM g_links WHERE src NOT IN (SELECT path FROM kb_document WHERE deleted_at IS NULL) OR dst NOT IN (SELECT path FROM kb_document WHERE deleted_at IS NULL)")
def pruned_links(spark: SparkSession, d: str) -> DataFrame:
    alive, links = table(spark, d, "kb_document").where("deleted_at is null").select("path"), N.links_to(spark, d)
    return reconcile.pruned(links, reconcile.existing_ends(links, alive, ("src", "dst"), "path"), ["src", "dst"])


_LINKS = """
, notes AS (SELECT DISTINCT path, lower(path) AS low FROM kb_document WHERE path IS NOT NULL AND NOT coalesce(stub, FALSE)),
keyed AS (SELECT low AS k, path FROM notes UNION SELECT regexp_replace(low, '\\.md$', ''), path FROM notes),
by_path AS (SELECT k, max(path) AS path FROM keyed GROUP BY k),
by_stem AS (SELECT regexp_replace(string_split(low, '/')[-1], '\\.md$', '') AS stem, min(path) AS path FROM notes GROUP BY 1 HAVING count(*) = 1),
raws AS (SELECT DISTINCT path AS src, raw FROM (SELECT path, unnest(links) AS raw FROM kb_document WHERE path IS NOT NULL AND NOT coalesce(stub, FALSE)) WHERE raw IS NOT NULL),
links AS (SELECT src, raw, lower(trim(raw, '/')) AS k FROM raws),
found AS (
  SELECT src, raw, coalesce(p.path, m.path, s.path) AS dst FROM links l LEFT JOIN by_path p ON p.k = l.k LEFT JOIN by_path m ON m.k = l.k || '.md'
  LEFT JOIN by_stem s ON s.stem = regexp_replace(string_split(l.k, '/')[-1], '\\.md$', ''))
"""


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kb_document").where("path is not null").where(reconcile.not_stub()).select("path", "links")


@query("SELECT 1")
def resolve_links(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.resolve_links(_notes(spark, d))


@query("SELECT 1")
def link_stubs(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.link_tables(reconcile.resolve_links(_notes(spark, d)))[1].select("path", "title", "category", "stub")


SQL["resolve_links"] = "WITH x AS (SELECT 1)" + _LINKS + "SELECT src, min(raw) AS raw, dst FROM found WHERE dst IS NOT NULL AND dst <> src GROUP BY src, dst UNION ALL SELECT src, raw, NULL FROM found WHERE dst IS NULL"
SQL["link_stubs"] = "WITH x AS (SELECT 1)" + _LINKS + "SELECT DISTINCT 'unresolved:' || raw AS path, replace(regexp_replace(string_split(raw, '/')[-1], '\\.md$', ''), '-', ' ') AS title, 'unresolved' AS category, TRUE AS stub FROM found WHERE dst IS NULL"


@query("SELECT DISTINCT path AS src, s AS dst FROM (SELECT path, unnest(supersedes) AS s FROM kb_document WHERE path IS NOT NULL) WHERE s IN (SELECT path FROM kb_document WHERE path IS NOT NULL)")
def supersedes_edges(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.supersedes_edges(table(spark, d, "kb_document").where("path is not null"))


@query("SELECT path, tag FROM g_tagged")
def normal_tags(spark: SparkSession, d: str) -> DataFrame:
    return N.tagged(spark, d)


@query("SELECT path, key, count(*) AS rows FROM mentions GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.duplicate_keys(table(spark, d, "mentions"), schemas.KEYS["mentions"])


_SLUG = "regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"SELECT DISTINCT name, {_SLUG} AS slug FROM entity")
def entity_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity").select("name", T.entity_slug("name").alias("slug")).distinct()


@query("SELECT lower(name) AS key, arg_min(name, key || ' ' || type) AS name, arg_min(type, key || ' ' || type) AS type, list_sort(list_distinct(coalesce(flatten(list(aliases) FILTER (aliases IS NOT NULL)), []))) AS aliases FROM entity GROUP BY lower(entity.name)")
def upsert_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entity").withColumn("seq", F.concat_ws(" ", "key", "type")).withColumn("key", F.lower("name"))
    return entities.upsert_entities(rows).drop("embedding")


@query("SELECT path, key, count FROM g_mentions")
def upsert_mentions(spark: SparkSession, d: str) -> DataFrame:
    return N.mentions(spark, d)


@query("SELECT source, type, target, confidence, source_path FROM g_relates")
def upsert_relations(spark: SparkSession, d: str) -> DataFrame:
    return N.relates_to(spark, d)


@query("SELECT path, key, count FROM g_mentions WHERE path NOT IN (SELECT path FROM g_document WHERE NOT coalesce(stub, FALSE) AND extracted_hash IS DISTINCT FROM content_hash)")
def cleared_mentions(spark: SparkSession, d: str) -> DataFrame:
    return entities.clear_mentions(N.mentions(spark, d), reconcile.stale(N.document(spark, d), "extracted_hash"))


@query(f"SELECT DISTINCT source_path AS path, source, {coerced('type', schemas.RELATION_TYPES, schemas.DEFAULT_RELATION_TYPE)} AS type, target, least(1.0, greatest(0.0, coalesce(confidence, 0.5))) AS confidence FROM relates_to")
def extract_json(spark: SparkSession, d: str) -> DataFrame:
    """Replies as models give them, fenced or in prose, made from the relations, and read back."""
    rows = table(spark, d, "relates_to")
    reply = F.to_json(F.struct(F.array().cast("array<struct<name string, type string, aliases array<string>>>").alias("entities"), F.array(F.struct("source", "target", F.upper("type").alias("type"), F.col("confidence").cast("string").alias("confidence"))).alias("relations")))
    raw = F.when(F.length("source") % 2 == 0, F.concat(F.lit("```json\n"), reply, F.lit("\n```"))).otherwise(F.concat(F.lit("Here you are: "), reply, F.lit(" - done.")))
    replies = entities.parsed_replies(rows.select(F.col("source_path").alias("path"), F.lit(0).alias("window"), raw.alias("raw")))
    r = replies.select("path", F.explode("reply.relations").alias("r"))
    return r.select("path", "r.source", T.coerced("r.type", schemas.RELATION_TYPES, schemas.DEFAULT_RELATION_TYPE).alias("type"), "r.target", T.confidence("r.confidence").alias("confidence")).distinct()


@query(f"""
SELECT path, key, count FROM (
  SELECT path, {_SLUG.replace("name", "key")} AS key, count(*) AS count, min(n) AS first FROM (
    SELECT path, key, row_number() OVER (PARTITION BY path ORDER BY key, count) AS n FROM mentions) WHERE path IS NOT NULL AND {_SLUG.replace("name", "key")} <> '' GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY path ORDER BY count DESC, first) <= 20""")
def top_entities_per_doc(spark: SparkSession, d: str) -> DataFrame:
    """The delivered mentions of a document as the entities of one reply of a model."""
    none = F.array().cast("array<string>")
    named = table(spark, d, "mentions").where("path is not null").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("key", "count"))).alias("e"))
    reply = F.struct(F.transform("e", lambda x: F.struct(x["key"].alias("name"), F.lit("tool").alias("type"), none.alias("aliases"))).alias("entities"))
    return entities.document_entities(named.select("path", F.lit(0).alias("window"), reply.alias("reply"))).select("path", "key", "count")


_TO = "SELECT path, key, min(key) OVER (PARTITION BY path, name) AS resolved FROM g_mentions JOIN (SELECT key, lower(name) AS name FROM g_entity) USING (key)"


@query(f", resolved AS ({_TO}) SELECT r.source_path AS path, a.resolved AS source, r.type, b.resolved AS target, r.confidence FROM g_relates r JOIN resolved a ON a.path = r.source_path AND a.key = r.source JOIN resolved b ON b.path = r.source_path AND b.key = r.target WHERE a.resolved <> b.resolved")
def remap_relations(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    named = N.mentions(spark, d).join(N.entity(spark, d).select("key", F.lower("name").alias("name")), "key")
    resolved = named.select("path", "key", F.min("key").over(Window.partitionBy("path", "name")).alias("resolved"))
    return entities.remap_relations(N.relates_to(spark, d).withColumnRenamed("source_path", "path"), resolved)


@query(f"""
SELECT probe, key, key AS name, score FROM (
  SELECT a.vec_id AS probe, a.label AS pt, CAST(b.vec_id AS VARCHAR) AS key, b.label AS bt, (1 + {_COS}) / 2 AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, key) <= 5) WHERE score >= 0.6 AND pt = bt QUALIFY row_number() OVER (PARTITION BY probe ORDER BY score DESC, key) = 1""")
def similar_entity(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("type", F.col("label").cast("string"))
    stored = rows.select(F.col("vec_id").cast("string").alias("key"), F.col("vec_id").cast("string").alias("name"), "type", "embedding")
    return entities.similar_entity(rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("probe"), "type", "embedding"), stored, threshold=0.6)


@query()
def entity_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The pending documents of a run against the entities of the others."""
    pending = reconcile.stale(N.document(spark, d), "extracted_hash").select("path")
    entity, mentions = N.entity(spark, d).select("key", "type", "embedding"), N.mentions(spark, d)
    fresh = mentions.join(pending, "path", "left_semi").join(entity, "key")
    from pyspark.sql import Window

    order = pending.select("path", F.row_number().over(Window.orderBy("path")).cast("bigint").alias("seq"))  # paths only; the fold below is in this order by definition
    known = mentions.join(pending, "path", "left_anti").select("key").distinct()
    return entities.greedy_dedup(fresh.join(order, "path").select("seq", "path", "key", "type", "embedding"), entity.join(known, "key", "left_semi")).drop("seq")


@query("SELECT DISTINCT path, sha256(body) AS hash, CASE WHEN body IS NULL THEN 0 ELSE len(list_filter(regexp_split_to_array(body, '" + SPACE + "+'), lambda w: w <> '')) END AS words FROM kb_document")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kb_document").select("path", T.content_hash("body").alias("hash"), T.word_count("body").cast("bigint").alias("words")).distinct()


@query("""SELECT DISTINCT path, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '(root)' END AS category,
CASE WHEN len(string_split(path, '/')) > 2 THEN string_split(path, '/')[2] ELSE '' END AS subcategory FROM kb_document""")
def categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kb_document").select("path", T.category("path").alias("category"), T.subcategory("path").alias("subcategory")).distinct()


_BLOCK = r"regexp_extract(text, '\A---\r?\n((?s:.*?))\r?\n---[ \t]*(?:\r?\n)?', 1)"


@query(rf"""
SELECT doc_id, regexp_extract({_BLOCK}, '(?m)^title: *(.*?) *$', 1) AS title, regexp_extract({_BLOCK}, '(?m)^created: *(.*?) *$', 1) AS created,
  list_filter(list_transform(string_split(regexp_extract({_BLOCK}, '(?m)^tags: *\[(.*?)\] *$', 1), ','), lambda t: lower(trim(t))), lambda t: t <> '') AS tags
FROM documents WHERE {_BLOCK} <> ''""")
def frontmatter_fields(spark: SparkSession, d: str) -> DataFrame:
    notes = corpus.with_frontmatter(table(spark, d, "documents")).where(F.size("front") > 0)
    get = lambda k: F.try_element_at("front", F.lit(k))
    return notes.select("doc_id", get("title")["scalar"].alias("title"), get("created")["scalar"].alias("created"), T.tag_list(get("tags")["items"], get("tags")["scalar"]).alias("tags"))


_FENCE = r"(?ms)^[^\S\n]*(?:```.*?(?:\n[^\S\n]*```[^\n]*|\z)|~~~.*?(?:\n[^\S\n]*~~~[^\n]*|\z))"
_RAW_LINKS = rf"regexp_extract_all(regexp_replace(regexp_replace(text, '{_FENCE}', chr(10), 'g'), '`[^`\n]*`', ' ', 'g'), '!?\[\[[^\]\n]+\]\]')"


@query(rf"""
SELECT DISTINCT doc_id, target FROM (
  SELECT doc_id, {trim("string_split(string_split(m[3:-3], '|')[1], '#')[1]")} AS target FROM (SELECT doc_id, unnest({_RAW_LINKS}) AS m FROM documents) WHERE m[1] <> '!')
WHERE target <> '' AND regexp_matches(target, '\p{{L}}') AND NOT contains(target, ':') AND NOT contains(target, '*')""")
def wikilinks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(T.wikilinks("text")).alias("target"))


_SPACED = r"regexp_replace(regexp_replace(string_split(path, '/')[-1], '(?i)\.md$', ''), '[-_]', ' ', 'g')"


@query(rf"""
SELECT DISTINCT path, coalesce(nullif(CASE WHEN regexp_matches(h, '(?i)^[\w.-]+\.(md|txt|yaml|yml|json)$') THEN '' ELSE {trim("h")} END, ''), {trim(_SPACED)}) AS title
FROM (SELECT path, regexp_extract(regexp_replace(regexp_replace(coalesce(body, ''), '{_FENCE}', chr(10), 'g'), '`[^`\n]*`', ' ', 'g'), '(?m)^#\s+(.+?)\s*$', 1) AS h FROM kb_document)""")
def titles(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, d, "kb_document").select("path", T.title(none, F.coalesce("body", F.lit("")), none, F.col("path")).alias("title")).distinct()


@query(f"""
SELECT doc_id, (i)::INT AS ordinal, md5(array_to_string(list_slice(ws, i * 290 + 1, i * 290 + 350), ' ')) AS hash FROM (
  SELECT doc_id, ws, unnest(range(0, CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= 350 THEN 1 ELSE ceil((len(ws) - 350) / 290.0)::BIGINT + 1 END)) AS i
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda w: w <> '') AS ws FROM documents))""")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunking.window_chunks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "ordinal", F.md5("text").alias("hash"))


@query(f"""
SELECT path, (i)::INT AS window, len(list_slice(ws, i * 1500 + 1, i * 1500 + 1500)) AS words FROM (
  SELECT path, ws, unnest(range(0, ceil(len(ws) / 1500.0)::BIGINT)) AS i FROM (SELECT DISTINCT path, list_filter(regexp_split_to_array(coalesce(body, ''), '{SPACE}+'), lambda w: w <> '') AS ws FROM kb_document))""")
def extraction_windows(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "kb_document").select("path", "body").distinct().withColumn("title", F.lit(""))
    prompts = providers.extraction_prompts(notes)
    return prompts.select("path", "window", T.word_count(F.substring_index("prompt", "\nTitle: \n\n", -1)).cast("bigint").alias("words"))


_LINE = "ls[n + 1]"
_SHOWN = rf"array_to_string(list_transform(range(1, len(regexp_split_to_array({_LINE}, '`[^`]*`')) + 1), lambda i: regexp_split_to_array({_LINE}, '`[^`]*`')[i] || repeat(' ', coalesce(length(regexp_extract_all({_LINE}, '`[^`]*`')[i]), 0))), '')"
_MARK = rf"regexp_extract({_LINE}, '^\s*(`{{3}}|~{{3}})', 1)"
_IS_HEAD = rf"fence = '' AND {_MARK} = '' AND regexp_matches({_SHOWN}, '^#{{1,6}}\s+(.*?)\s*#*\s*$')"
_NAME, _DEPTH = rf"regexp_extract({_SHOWN}, '^#{{1,6}}\s+(.*?)\s*#*\s*$', 1)", rf"length(regexp_extract({_SHOWN}, '^(#{{1,6}})\s', 1))"
_OPENS = "len(open) > 0 AND len(open) + len(words) > 350"


@query(rf"""
WITH RECURSIVE notes AS (SELECT DISTINCT path, coalesce(title, '') AS title, body FROM kb_document WHERE NOT coalesce(stub, FALSE) AND body <> ''),
numbered AS (SELECT row_number() OVER () AS id, path, title, body, string_split(body, chr(10)) AS ls FROM notes),
walk AS (
  SELECT id, title, ls, 0 AS n, '' AS fence, 0 AS section, []::VARCHAR[] AS trail, []::VARCHAR[] AS ws FROM numbered
  UNION ALL
  SELECT id, title, ls, n + 1, CASE WHEN fence <> '' THEN CASE WHEN {_MARK} = fence THEN '' ELSE fence END ELSE {_MARK} END,
    section + CASE WHEN {_IS_HEAD} THEN 1 ELSE 0 END,
    CASE WHEN {_IS_HEAD} THEN list_append(list_slice(trail, 1, {_DEPTH} - 1), {_NAME}) ELSE trail END,
    CASE WHEN {_IS_HEAD} THEN [] ELSE list_filter(regexp_split_to_array({_LINE}, '{SPACE}+'), lambda w: w <> '') END
  FROM walk WHERE n < len(ls)),
sections AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY section) AS s, words, array_to_string(list_filter(list_prepend(title, list_filter(trail, lambda t: t <> title)), lambda x: x <> ''), ' > ') AS crumb
  FROM (SELECT id, any_value(title) AS title, section, flatten(list(ws ORDER BY n)) AS words, arg_max(trail, n) AS trail FROM walk GROUP BY id, section) WHERE len(words) > 0),
pack AS (
  SELECT id, 0::BIGINT AS s, []::VARCHAR[] AS open, '' AS label, []::STRUCT(t VARCHAR, c VARCHAR)[] AS made FROM numbered
  UNION ALL
  SELECT p.id, x.s, CASE WHEN len(words) > 350 THEN [] WHEN {_OPENS} THEN words ELSE list_concat(open, words) END,
    CASE WHEN len(words) <= 350 AND (len(open) = 0 OR {_OPENS}) THEN crumb ELSE label END,
    list_concat(CASE WHEN {_OPENS} THEN list_append(made, {{'t': array_to_string(open, ' '), 'c': label}}) ELSE made END,
      CASE WHEN len(words) > 350 THEN list_transform(range(0, ceil((len(words) - 350) / 290.0)::BIGINT + 1), lambda i: {{'t': array_to_string(list_slice(words, i * 290 + 1, i * 290 + 350), ' '), 'c': crumb}}) ELSE [] END)
  FROM pack p JOIN sections x ON x.id = p.id AND x.s = p.s + 1),
done AS (
  SELECT path, title, body, CASE WHEN len(open) > 0 THEN list_append(made, {{'t': array_to_string(open, ' '), 'c': label}}) ELSE made END AS made
  FROM (SELECT * FROM pack QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC) = 1) JOIN numbered USING (id)),
filled AS (SELECT path, CASE WHEN len(made) = 0 AND {trim("body")} <> '' THEN [{{'t': {trim("body")}, 'c': title}}] ELSE made END AS made FROM done)
SELECT path || '#' || (i - 1) AS id, path AS doc_path, (i - 1)::INT AS ordinal, m.t AS text, m.c AS breadcrumb,
  len(list_filter(regexp_split_to_array(m.t, '{SPACE}+'), lambda w: w <> ''))::INT AS word_count
FROM (SELECT path, unnest(made) AS m, generate_subscripts(made, 1) AS i FROM filled)""")
def chunk_packing(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "kb_document").where(reconcile.not_stub()).select("path", "title", "body").distinct()
    return chunking.chunk_documents(notes)


@query("SELECT id, md5(CASE WHEN coalesce(breadcrumb, '') <> '' THEN breadcrumb || chr(10) || chr(10) || text ELSE text END) AS hash FROM g_chunk")
def embed_text(spark: SparkSession, d: str) -> DataFrame:
    return N.chunk(spark, d).select("id", F.md5(T.embed_text("breadcrumb", "text")).alias("hash"))


@query("""SELECT count(*) FILTER (NOT coalesce(stub, FALSE)) AS documents, count(*) FILTER (NOT coalesce(stub, FALSE) AND chunked_hash IS DISTINCT FROM content_hash) AS to_chunk,
count(*) FILTER (NOT coalesce(stub, FALSE) AND extracted_hash IS DISTINCT FROM content_hash) AS to_extract FROM g_document""")
def pending_report(spark: SparkSession, d: str) -> DataFrame:
    own, differs = reconcile.not_stub(), lambda m: ~F.col(m).eqNullSafe(F.col("content_hash"))
    return N.document(spark, d).agg(F.count_if(own).alias("documents"), F.count_if(own & differs("chunked_hash")).alias("to_chunk"), F.count_if(own & differs("extracted_hash")).alias("to_extract"))
