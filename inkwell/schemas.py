"""Tables of the note graph, as Spark DDL, and the closed vocabularies (fixed values)."""

DOCUMENT = "path string, title string, category string, subcategory string, content_hash string, created string, updated string, word_count bigint, stub boolean, chunked_hash string, extracted_hash string"
PARSED = "path string, title string, category string, subcategory string, content_hash string, created string, updated string, word_count bigint, tags array<string>, links array<string>, supersedes array<string>, body string"
TAGGED = "path string, tag string"
LINKS_TO = "src string, dst string"
SUPERSEDES = "src string, dst string"
CHUNK = "id string, doc_path string, ordinal int, text string, breadcrumb string, word_count int, embedding array<float>"
ENTITY = "key string, name string, type string, aliases array<string>, embedding array<float>"
MENTIONS = "path string, key string, count bigint"
RELATES_TO = "source string, target string, type string, confidence double, source_path string"
EXTRACTED = "entities array<struct<name string, type string, aliases array<string>>>, relations array<struct<source string, target string, type string, confidence string>>"

TABLES = {"document": DOCUMENT, "tagged": TAGGED, "links_to": LINKS_TO, "supersedes": SUPERSEDES, "chunk": CHUNK, "entity": ENTITY, "mentions": MENTIONS, "relates_to": RELATES_TO}
#: Key of each table: at most one row each.
KEYS = {"document": ["path"], "tagged": ["path", "tag"], "links_to": ["src", "dst"], "supersedes": ["src", "dst"], "chunk": ["id"], "entity": ["key"], "mentions": ["path", "key"], "relates_to": ["source", "type", "target"]}

ENTITY_TYPES = ("person", "project", "tool", "concept", "organization")
RELATION_TYPES = ("works_on", "depends_on", "part_of", "uses", "supersedes", "contradicts", "created_by", "related_to")
DEFAULT_ENTITY_TYPE, DEFAULT_RELATION_TYPE = "concept", "related_to"
