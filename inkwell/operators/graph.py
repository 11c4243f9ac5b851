"""Questions to the note graph. Every function takes tables and gives a table; sorts that precede a limit have tie-breakers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions import vectors as V
from inkwell.operators.reconcile import not_stub
from inkwell.session import materialize, salted_join

MAX_PATH = 6


def clamped(value: int, low: int, high: int) -> int:
    return max(low, min(value, high))


def documents_by_tag(document: DataFrame, tagged: DataFrame, tag: str) -> DataFrame:
    """Documents with a tag, the latest first."""
    tag = tag.strip().lower().lstrip("#")
    paths = tagged.where(F.col("tag") == tag).select("path").distinct()
    return document.join(paths, "path", "left_semi").select("path", "title", "updated").orderBy(F.desc_nulls_first("updated"), "path")


def list_tags(tagged: DataFrame, min_documents: int = 1) -> DataFrame:
    """Tags and how many documents carry them, the commonest first."""
    counts = tagged.groupBy("tag").agg(F.countDistinct("path").alias("documents"))
    return counts.where(F.col("documents") >= max(1, min_documents)).orderBy(F.desc("documents"), "tag")


def entities_in_documents(document: DataFrame, tagged: DataFrame, links_to: DataFrame, mentions: DataFrame, entity: DataFrame, path: str | None = None) -> DataFrame:
    """What surrounds a document, or each of them: title, category, sorted tags, links out and in, and entities as ``name (type)``.

    Each neighbourhood is gathered by itself, so none multiplies another. Stubs have neighbourhoods too; an unknown path has no row. The lists are
    part of the answer and as long as what they list.
    """

    def of(edges: DataFrame, key: str, value, name: str) -> DataFrame:
        side = edges if path is None else edges.where(F.col(key) == path)
        return side.select(F.col(key).alias("path"), value.alias("v")).groupBy("path").agg(F.array_sort(F.collect_set("v")).alias(name))

    base = document if path is None else document.where(F.col("path") == path)
    named = salted_join(mentions.select("path", "key").distinct(), entity.select("key", F.concat("name", F.lit(" ("), "type", F.lit(")")).alias("label")), ["key"])
    parts = [of(tagged, "path", F.col("tag"), "tags"), of(links_to, "src", F.col("dst"), "links_out"), of(links_to, "dst", F.col("src"), "links_in"), of(named, "path", F.col("label"), "entities")]
    out = base.select("path", "title", "category")
    for part in parts:
        out = out.join(part, "path", "left")
    none = F.array().cast("array<string>")
    return out.select("path", "title", "category", *(F.coalesce(c, none).alias(c) for c in ("tags", "links_out", "links_in", "entities")))


def nearest_chunks(chunk: DataFrame, probe: list[float], k: int, dims: int, mode: str = "normalized") -> DataFrame:
    """The ``k`` chunks nearest to a vector: exact, one pass. Only ids and scores move before the best are known; rows that repeat an id count once."""
    q = F.array(*(F.lit(float(x)) for x in probe))
    usable = chunk.where(V.usable(F.col("embedding"), dims))
    cosine = V.dot(F.col("embedding"), q) / (V.norm(F.col("embedding")) * V.norm(q))
    scored = usable.select("id", F.round(V.score(cosine, mode), 4).alias("score")).groupBy("id").agg(F.max("score").alias("score"))
    best = F.broadcast(scored.orderBy(F.desc("score"), "id").limit(k))  # k rows
    rows = usable.select("id", F.struct("doc_path", "text", "breadcrumb").alias("r")).join(best, "id").groupBy("id", "score").agg(F.max("r").alias("r"))
    return rows.select("id", "r.doc_path", "r.breadcrumb", "r.text", "score").orderBy(F.desc("score"), "id")


def semantic_search(chunk: DataFrame, probe: list[float], limit: int = 8, dims: int = 64, mode: str = "normalized") -> DataFrame:
    """Passages nearest to a query vector: ``id``, ``path``, ``section``, ``score``, ``snippet``."""
    near = nearest_chunks(chunk, probe, clamped(limit, 1, 50), dims, mode)
    return near.select("id", F.col("doc_path").alias("path"), F.col("breadcrumb").alias("section"), "score", T.snippet("text").alias("snippet"))


def similar_documents(document: DataFrame, chunk: DataFrame, path: str, limit: int = 8, nearest: int = 20, dims: int = 64, mode: str = "normalized") -> DataFrame:
    """Documents near a document: of each of its chunks the ``nearest`` chunks, its own included; the best score a document; itself left out.

    The probes are the chunks of one document; they are bounded by that document and meet all chunks in one pass.
    """
    usable = chunk.where(V.usable(F.col("embedding"), dims)).select("id", "doc_path", F.col("embedding").alias("v"), V.norm(F.col("embedding")).alias("n"))
    probes = usable.where(F.col("doc_path") == path).select(F.col("id").alias("probe"), F.col("v").alias("q"), F.col("n").alias("qn"))
    scored = usable.join(probes).select("probe", "id", "doc_path", V.score(V.dot(F.col("v"), F.col("q")) / (F.col("n") * F.col("qn")), mode).alias("score"))
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "id")
    near = scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= nearest)
    best = near.groupBy(F.col("doc_path").alias("path")).agg(F.max("score").alias("score")).where(F.col("path") != path)
    titled = best.join(document.select("path", "title"), "path").select("path", "title", F.round("score", 4).alias("score"))
    return titled.orderBy(F.desc("score"), "path").limit(clamped(limit, 1, 25))


def graph_overview(document: DataFrame, chunk: DataFrame, tagged: DataFrame, entity: DataFrame, links_to: DataFrame, mentions: DataFrame, relates_to: DataFrame) -> DataFrame:
    """One row of counts. Tables must have one row a key; of ``chunk`` only whether it has an ``embedding`` is asked."""
    n = lambda df, name, what="*": df.agg(F.count(what).alias(name))
    parts = [
        document.agg(F.count_if(not_stub()).alias("documents"), F.count_if(~not_stub()).alias("stubs")), chunk.agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded_chunks")),
        tagged.agg(F.countDistinct("tag").alias("tags"), F.count("*").alias("tagged")), n(entity, "entities"), n(links_to, "links_to"), n(mentions, "mentions"), n(relates_to, "relates_to"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # rows of one by one
    return out.select("documents", "stubs", "chunks", "embedded_chunks", "tags", "entities", "links_to", "tagged", "mentions", "relates_to")


def _both_ways(relates_to: DataFrame) -> DataFrame:
    edge = relates_to.select(F.xxhash64("source", "type", "target").alias("edge"), "source", "type", "target")
    return edge.select("edge", F.col("source").alias("from"), "type", F.col("target").alias("to")).unionByName(edge.select("edge", F.col("target").alias("from"), "type", F.col("source").alias("to")).where(F.col("from") != F.col("to")))


def _named(entity: DataFrame, name: str, aliases: bool) -> DataFrame:
    low = name.lower()
    match = F.lower("name") == low
    if aliases:
        match = match | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a) == low)
    return entity.where(F.coalesce(match, F.lit(False)))


def find_related_entities(entity: DataFrame, relates_to: DataFrame, mentions: DataFrame, document: DataFrame, name: str, max_hops: int = 2, limit: int = 40) -> DataFrame:
    """Entities around one, by name or alias: ``entity``, ``type``, ``hops``, ``via``, up to four ``documents`` that mention it.

    Trails of up to ``max_hops`` relations in either direction that use no relation twice; they may come back to a node. Trails that
    agree in end, length and relation types are one row. Trails are joined hop by hop; of those that have used the same relations, with the same types, and stand at the
    same node, one is kept, since they go on alike.
    """
    both = _both_ways(relates_to)
    trail = _named(entity, name, aliases=True).select(F.col("key").alias("at"), F.array().cast("array<bigint>").alias("edges"), F.array().cast("array<string>").alias("via"))
    reached = None
    for _ in range(clamped(max_hops, 1, 4)):
        step = salted_join(trail, both.withColumnRenamed("from", "at"), ["at"]).where(~F.array_contains("edges", F.col("edge")))
        trail = step.select(F.col("to").alias("at"), F.array_sort(F.concat("edges", F.array("edge"))).alias("edges"), F.concat("via", F.array("type")).alias("via")).distinct()
        trail = materialize(trail, "trails")  # the next hop reads it several times
        ends = trail.select("at", "via").distinct()
        reached = ends if reached is None else reached.unionByName(ends)
    found = reached.join(entity.select(F.col("key").alias("at"), "name", "type"), "at")
    known = mentions.join(document.select("path"), "path", "left_semi").select(F.col("key").alias("at"), "path").distinct()
    # Only the first four paths of each entity are ever shown, so no more are gathered; the window is pruned before its shuffle.
    first = known.join(found.select("at").distinct(), "at", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("at").orderBy("path"))).where("r <= 4")
    grouped = found.join(first.select("at", "path"), "at", "left").groupBy("name", "type", F.size("via").alias("hops"), "via").agg(F.slice(F.array_sort(F.collect_set("path")), 1, 4).alias("documents"))
    return grouped.select(F.col("name").alias("entity"), "type", "hops", "via", "documents").orderBy("hops", "entity", "type", F.array_join("via", ",")).limit(limit)


def shortest_path(entity: DataFrame, relates_to: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """One shortest path of up to six relations between two names (no aliases): ``nodes``, ``relations``, ``hops``; none if there is none or they are one node.

    Breadth first, level by level, each node kept once with the least path to it, so a level never outgrows the nodes. The loop ends
    when a level holds the goal or nothing. Among shortest paths the one with the least keys and types counts.
    """
    both = _both_ways(relates_to).select("from", "type", "to").distinct()
    goal = _named(entity, name_b, aliases=False).select(F.col("key").alias("at"))
    empty = F.array().cast("array<string>")
    seen = _named(entity, name_a, aliases=False).select(F.col("key").alias("at"), F.array("key").alias("keys"), empty.alias("types"))
    seen = materialize(seen.join(goal, "at", "left_anti"), "path")
    front, found = seen, None
    for _ in range(MAX_PATH):
        step = front.join(both, front["at"] == both["from"]).select(F.col("to").alias("at"), F.concat("keys", F.array("to")).alias("keys"), F.concat("types", F.array("type")).alias("types"))
        front = materialize(step.groupBy("at").agg(F.min(F.struct("keys", "types")).alias("p")).join(seen.select("at"), "at", "left_anti").select("at", "p.keys", "p.types"), "path")
        found = front.join(goal, "at", "left_semi")
        if found.limit(1).count() or not front.limit(1).count():
            break
        seen = materialize(seen.unionByName(front), "path")
    best = found.orderBy(F.size("types"), "keys", "types").limit(1)
    places = best.select("types", F.posexplode("keys").alias("n", "key")).join(entity.select("key", "name"), "key")
    per = places.groupBy("types").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]).alias("nodes"))
    return per.select("nodes", F.col("types").alias("relations"), F.size("types").alias("hops"))


def render_path(row) -> str:
    """``A -[rel]- B (n hops)``."""
    chain = row["nodes"][0] + "".join(f" -[{r}]- {n}" for r, n in zip(row["relations"], row["nodes"][1:]))
    return f"{chain} ({row['hops']} hop{'s' if row['hops'] != 1 else ''})"


def recent_related_changes(entity: DataFrame, mentions: DataFrame, document: DataFrame, name: str, since: str = "", limit: int = 25) -> DataFrame:
    """Documents that mention an entity of that name (no aliases), the latest first; dates compare as text."""
    keys = _named(entity, name, aliases=False).select("key")
    found = mentions.join(keys, "key").select("path", "key").join(document.select("path", "title", "updated"), "path")
    if since:
        found = found.where(F.col("updated") >= since)
    return found.select("path", "title", "updated").orderBy(F.desc_nulls_first("updated"), "path").limit(limit)


def formatted(rows: list, columns: list[str], empty: str) -> str:
    """Rows as text, one a line; a message where there are none."""
    if not rows:
        return empty
    return "\n".join("- " + " | ".join(", ".join(map(str, r[c])) if isinstance(r[c], list) else str(r[c]) for c in columns) for r in rows)
