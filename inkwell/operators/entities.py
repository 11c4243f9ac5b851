"""Extracted entities and relations: coercion, merging, upserts, and dedup by similarity."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell import schemas
from inkwell.functions import text as T
from inkwell.functions import vectors as V
from inkwell.session import materialize


def parsed_replies(raw: DataFrame) -> DataFrame:
    """``path``, ``window``, ``reply``: model replies read leniently; null where there is no JSON to be found in one."""
    return raw.select("path", "window", T.lenient_json("raw", schemas.EXTRACTED, "entities").alias("reply"))


def checked_replies(raw: DataFrame) -> DataFrame:
    """``raw`` with an ``error`` also where a reply cannot be parsed, so that its document counts as failed. A JSON object without entities is no error."""
    reply, found = T.lenient_json("raw", schemas.EXTRACTED, "entities"), F.regexp_extract("raw", r"(?s)\{.*\}", 0)
    empty = F.get_json_object(found, "$").isNotNull() & F.get_json_object(found, "$.entities").isNull()
    usable = reply.isNotNull() | F.coalesce(empty, F.lit(False))
    return raw.withColumn("error", F.coalesce("error", F.when(~usable, F.lit("reply cannot be parsed: cut off, or no JSON object"))))


def document_entities(replies: DataFrame, cap: int = 20) -> DataFrame:
    """Entities of a document over all its windows: ``path``, ``key``, ``name``, ``type``, ``count``, ``aliases``, ``first``.

    Spellings with one slug are one entity; the name and type seen first count, unknown types become the default. With a positive ``cap`` only the most
    frequent are kept, the earlier first among equals.
    """
    each = replies.select("path", "window", F.posexplode("reply.entities").alias("n", "e")).select(
        "path", (F.col("window").cast("bigint") * 1_000_000 + F.col("n")).alias("seq"), T.trim("e.name").alias("name"), T.coerced("e.type", schemas.ENTITY_TYPES, schemas.DEFAULT_ENTITY_TYPE).alias("type"),
        F.filter(F.transform(F.coalesce("e.aliases", F.array()), T.trim), lambda a: a.isNotNull() & (a != "")).alias("aliases"),
    )
    keyed = each.withColumn("key", T.entity_slug("name")).where("key <> ''")
    merged = keyed.groupBy("path", "key").agg(
        F.min_by("name", "seq").alias("name"), F.min_by("type", "seq").alias("type"), F.count("*").alias("count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("aliases"), F.min("seq").alias("first")
    )
    if cap <= 0:
        return merged
    order = Window.partitionBy("path").orderBy(F.desc("count"), "first")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).drop("rank")


def document_relations(replies: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations between declared entities of a document: ``path``, ``source``, ``type``, ``target``, ``confidence``."""
    each = replies.select("path", F.explode("reply.relations").alias("r")).select(
        "path", T.entity_slug("r.source").alias("source"), T.coerced("r.type", schemas.RELATION_TYPES, schemas.DEFAULT_RELATION_TYPE).alias("type"), T.entity_slug("r.target").alias("target"), T.confidence("r.confidence").alias("confidence")
    )
    declared = entities.select("path", "key").distinct()
    for end in ("source", "target"):
        each = each.join(declared.withColumnRenamed("key", end), ["path", end], "left_semi")
    return each.where("source <> target").groupBy("path", "source", "type", "target").agg(F.max("confidence").alias("confidence"))


def remap_relations(relations: DataFrame, resolved: DataFrame) -> DataFrame:
    """Relations with both ends replaced by what the document's entities resolved to (``path``, ``key``, ``resolved``); those with a missing or equal end are dropped."""
    for end in ("source", "target"):
        to = resolved.select("path", F.col("key").alias(end), F.col("resolved").alias(f"to_{end}"))
        relations = relations.join(to, ["path", end])
    return relations.where("to_source <> to_target").select("path", F.col("to_source").alias("source"), "type", F.col("to_target").alias("target"), "confidence")


def upsert_entities(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """One row a key from rows in order: first name and type, last vector, all aliases. Old rows go first in ``seq``."""
    return rows.groupBy("key").agg(
        F.min_by("name", seq).alias("name"), F.min_by("type", seq).alias("type"),
        F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set(F.coalesce("aliases", F.array().cast("array<string>")))), lambda a: a.isNotNull()))).alias("aliases"),
        F.max_by("embedding", F.when(F.col("embedding").isNotNull(), F.col(seq))).alias("embedding"),
    )


def upsert_mentions(rows: DataFrame) -> DataFrame:
    """Counts added up; a null count adds nothing."""
    return rows.groupBy("path", "key").agg(F.sum(F.coalesce("count", F.lit(0))).alias("count"))


def upsert_relations(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """One row for source, type and target: the highest confidence, and the last path, even if its confidence was lower."""
    return rows.groupBy("source", "type", "target").agg(F.max("confidence").alias("confidence"), F.max_by("source_path", seq).alias("source_path"))


def clear_mentions(mentions: DataFrame, pending: DataFrame) -> DataFrame:
    return mentions.join(pending.select("path").distinct(), "path", "left_anti")


def similar_entity(probes: DataFrame, entities: DataFrame, threshold: float = 0.92, nearest: int = 5, dims: int = 64, mode: str = "normalized", type_first: bool = False) -> DataFrame:
    """For each probe (``probe``, ``type``, ``embedding``) the most similar stored entity: ``probe``, ``key``, ``name``, ``score``.

    As a vector index does it, the ``nearest`` of any type are taken before threshold and type are asked for; ``type_first`` asks for
    the type before. Every probe meets every entity, so the probe side should be one document's entities or another stated query set.
    """
    p = probes.where(V.usable(F.col("embedding"), dims)).select("probe", F.col("type").alias("ptype"), F.col("embedding").alias("q"), V.norm(F.col("embedding")).alias("qn"))
    e = entities.where(V.usable(F.col("embedding"), dims)).select("key", "name", "type", F.col("embedding").alias("v"), V.norm(F.col("embedding")).alias("vn"))
    scored = p.join(e, F.col("type") == F.col("ptype") if type_first else F.lit(True)).select("probe", "ptype", "key", "name", "type", V.score(V.dot(F.col("q"), F.col("v")) / (F.col("qn") * F.col("vn")), mode).alias("score"))
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "key")
    near = scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= nearest).where((F.col("score") >= threshold) & (F.col("type") == F.col("ptype")))
    return near.withColumn("n", F.row_number().over(order)).where("n = 1").select("probe", "key", "name", "score")


#: distinct vectors of a block; a task compares two blocks
BLOCK = 20_000


def near_vectors(vectors: DataFrame, cosine: float, block: int = BLOCK) -> DataFrame:
    """For each probe of ``vectors`` (``vid``, ``embedding``, ``probe``) all vectors that reach the cosine, itself included: ``vid``, ``near`` (``w``, ``c``).

    Exact: every two blocks are multiplied in one task, in single precision with a margin, and what is found is computed again in double precision.
    """
    blocks = max(1, -(-vectors.count() // block))
    mine = F.pmod(F.xxhash64("vid"), F.lit(blocks)).cast("int")
    placed = vectors.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = placed.select(F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "vid", "embedding", "probe")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame["embedding"].to_numpy()).astype(float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        vid, probe, own = frame["vid"].to_numpy(), frame["probe"].to_numpy(bool), (frame["mine"] == frame["lo"]).to_numpy()
        rows = np.flatnonzero(own)
        cols = rows if frame["lo"].iat[0] == frame["hi"].iat[0] else np.flatnonzero(~own)
        single, found = x.astype(np.float32), []
        right = single[cols].T
        for s in range(0, len(rows) if len(cols) else 0, 500):
            i, j = np.nonzero(single[rows[s : s + 500]] @ right >= cosine - 1e-4)
            i, j = rows[s + i], cols[j]
            if cols is rows:
                i, j = i[i <= j], j[i <= j]  # each pair once, so that it has one cosine
            c = np.einsum("ij,ij->i", x[i], x[j])
            for a, b, apart in ((i, j, probe[i]), (j, i, probe[j] & (i != j))):
                ok = apart & (c >= cosine - 1e-9)
                found.append(pd.DataFrame({"vid": vid[a[ok]], "w": vid[b[ok]], "c": c[ok]}))
        return pd.concat(found) if found else pd.DataFrame({"vid": [], "w": [], "c": []})

    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as given, else a few tasks compare all tiles
    pairs = tiles.repartition(tasks, "lo", "hi").groupBy("lo", "hi").applyInPandas(compare, "vid string, w string, c double")
    return pairs.groupBy("vid").agg(F.collect_list(F.struct("w", "c")).alias("near"))


def greedy_dedup(mentioned: DataFrame, stored: DataFrame, threshold: float = 0.92, nearest: int = 5, dims: int = 64, mode: str = "normalized", block: int = BLOCK) -> DataFrame:
    """Resolves entities of documents in order, each against what is stored before its document: ``seq``, ``path``, ``key``, ``resolved``, ``score``.

    ``mentioned`` has ``seq`` (of the document), ``path``, ``key``, ``type``, ``embedding``; ``stored`` the entities there are. What an entity holds is
    always one of the given vectors, and only those that reach the threshold can decide, so all tasks find the near vectors of each distinct one first. Order
    decides the result, so the rest is one sequential fold; it streams over the mentions and holds keys, types and ids of vectors, no vectors.

    Defined cases: a vector that is null, short, long or zero has no neighbour and keeps its own key; ties go to the smaller key; keys of one document never merge with each other.
    """
    if mode not in ("raw", "normalized"):
        raise ValueError(mode)
    usable = V.usable(F.col("embedding"), dims) & (V.norm(F.col("embedding")) < float("inf"))
    vid = F.when(usable, F.concat_ws("-", F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding")))
    old = stored.select(F.lit(-1).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("path"), "key", "type", F.col("embedding").cast("array<double>").alias("embedding")).dropDuplicates(["key"])
    given = old.unionByName(mentioned.select(F.col("seq").cast("bigint"), "path", "key", "type", F.col("embedding").cast("array<double>").alias("embedding")))
    rows = materialize(given.withColumn("vid", vid), "mentioned")
    vectors = materialize(rows.where("vid is not null").groupBy("vid").agg(F.first("embedding").alias("embedding"), F.max(F.col("seq") >= 0).alias("probe")), "vectors")
    near = near_vectors(vectors, threshold if mode == "raw" else 2 * threshold - 1, block)
    fed = rows.drop("embedding").join(near, "vid", "left").withColumn("near", F.when(F.col("seq") >= 0, F.col("near")))

    def fold(batches):
        types, holds, holders, writes, now = {}, {}, {}, [], None

        def put(key, kind, v):
            types.setdefault(key, kind)
            if v is not None and holds.get(key) != v:
                if key in holds:
                    holders[holds[key]].discard(key)
                holds[key] = v
                holders.setdefault(v, set()).add(key)

        for batch in batches:
            out = []
            for seq, path, key, kind, v, close in zip(batch["seq"].tolist(), *(batch[c] for c in ("path", "key", "type", "vid", "near"))):
                if seq < 0:
                    put(key, kind, v)
                    continue
                if seq != now:
                    for write in writes:
                        put(*write)
                    writes, now = [], seq
                met = ((-(x["c"] if mode == "raw" else (1 + x["c"]) / 2), k) for x in (() if close is None else close) for k in holders.get(x["w"], ()))
                top = heapq.nsmallest(nearest, (m for m in met if -m[0] >= threshold))
                best, to = next(((-s, k) for s, k in top if types[k] == kind), (None, key))
                out.append((seq, path, key, to, best))
                writes.append((to, kind, v))
            yield pd.DataFrame(out, columns=["seq", "path", "key", "resolved", "score"]).astype({"score": float})

    return fed.repartition(1).sortWithinPartitions("seq", "key").mapInPandas(fold, "seq bigint, path string, key string, resolved string, score double")
