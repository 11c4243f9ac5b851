"""The pipeline: corpus to graph, chunks with vectors, entities; and the questions to it."""

from __future__ import annotations

import os
import time

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell import schemas
from inkwell.config import Settings
from inkwell.functions import text as T
from inkwell.operators import chunking, entities, graph, reconcile
from inkwell.operators.reconcile import Report
from inkwell.session import materialize, scratch
from inkwell.sources import corpus, providers
from inkwell.store import Store


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings, embedder: providers.Embedder | None = None, extractor: providers.Extractor | None = None):
        self.spark, self.settings, self.store = spark, settings, Store(spark, settings.store)
        self.embedder, self.extractor = embedder or settings.embedder(), extractor or settings.extractor()

    def notes(self) -> DataFrame:
        where = self.settings.corpus
        return corpus.parse_notes(corpus.read_corpus(self.spark, where if "://" in where else os.path.expanduser(where)))

    def schema(self) -> int:
        """Empty tables where there are none."""
        missing = [t for t in schemas.TABLES if t not in self.store.manifest()]
        return self.store.forget(missing) if missing else self.store.versions()[-1]

    def sync_structural(self, notes: DataFrame | None = None) -> Report:
        """The graph of notes, tags, links and supersessions as the corpus has it now; what is gone is pruned."""
        notes = materialize(notes if notes is not None else self.notes(), "notes")
        old = self.store.tables()
        new = {k: materialize(v, k) for k, v in reconcile.structural_state(notes, old).items()}
        none = lambda name: self.spark.createDataFrame([], schemas.TABLES[name])
        before = {k: old.get(k, none(k)) for k in ("document", "tagged", "links_to", "supersedes")}
        unresolved = new["links_to"].where(F.col("dst").startswith(reconcile.UNRESOLVED))
        counts = {
            "documents": new["document"].where(reconcile.not_stub()).count(), "stubs": new["document"].where(~reconcile.not_stub()).count(), "tags": new["tagged"].select("tag").distinct().count(),
            "tag edges": new["tagged"].count(), "link edges": new["links_to"].count(), "supersedes edges": new["supersedes"].count(),
            "removed documents": reconcile.prune_documents(before["document"], new["document"]).count(),
            "removed stubs": reconcile.pruned(before["document"].where(~reconcile.not_stub()), new["document"], ["path"]).count(),
            "removed tags": reconcile.orphan_tags(before["tagged"], new["tagged"]).count(),
            "removed edges": sum(reconcile.pruned(before[t], new[t], schemas.KEYS[t]).count() for t in ("tagged", "links_to", "supersedes")),
        }
        shown = [f"{r.src} -> [[{r.dst[len(reconcile.UNRESOLVED):]}]]" for r in unresolved.orderBy("src", "dst").limit(16).collect()]
        self.store.commit(new)
        return Report("structural", counts, shown)

    def sync_embeddings(self, notes: DataFrame | None = None, force: bool = False, slice_documents: int = 5000) -> Report:
        """Chunks and vectors of the documents whose text changed, in slices that are each committed; the others keep theirs.

        A slice for which the model fails is reported and keeps its old chunks and marks, so it is tried again; the others are not lost.
        """
        notes = notes if notes is not None else self.notes()
        pending = materialize(reconcile.stale(self.store.read("document"), "chunked_hash", force).select("path"), "pending")
        total, written, failed = pending.count(), 0, []
        slices = pending.withColumn("slice", F.pmod(F.xxhash64("path"), F.lit(max(1, -(-total // slice_documents)))))
        slices = materialize(slices, "slices") if total else slices
        for n in range(max(1, -(-total // slice_documents)) if total else 0):
            part = slices.where(F.col("slice") == n).select("path")
            try:
                with scratch(self.spark):
                    written += self._embed(notes, part)
            except PythonException as why:
                if "EmbeddingError" not in str(why) and "Refused" not in str(why):
                    raise
                failed.append(f"slice {n}, {part.count()} documents: {[x for x in str(why).splitlines() if x.strip()][-1][:200]}")
        return Report("embed", {"pending documents": total, "chunks written": written, "failed slices": len(failed), "chunks": self.store.read("chunk").count()}, failed)

    def _embed(self, notes: DataFrame, part: DataFrame) -> int:
        document, chunk = self.store.read("document"), self.store.read("chunk")
        todo = notes.join(part, "path", "left_semi")
        made = chunking.chunk_documents(todo, self.settings.chunk_words, self.settings.chunk_overlap).withColumn("input", T.embed_text("breadcrumb", "text"))
        fresh = materialize(providers.embedded(made, self.embedder, "input", batch=self.settings.embed_batch), "fresh-chunks")
        columns = [c.split()[0] for c in schemas.CHUNK.split(", ")]
        self.store.commit({"chunk": reconcile.replace_chunks(chunk.select(*columns), fresh.select(*columns), part, document), "document": reconcile.marked(document, part, "chunked_hash")})
        return fresh.count()

    def sync_semantic(self, notes: DataFrame | None = None, limit: int | None = None, force: bool = False, extract_words: int = 1500, max_seconds: float | None = None, slice_documents: int = 500) -> Report:
        """Entities and relations of the documents whose text changed, in slices that are each committed; stops between slices when time is up.

        A document's old mentions go when its new ones come, so a run that stops early loses nothing. A document with a failed window keeps its mark and is tried again.
        """
        notes = notes if notes is not None else self.notes()
        began, done, failed, counts = time.monotonic(), 0, [], {"documents": 0, "entities": 0, "mentions": 0, "relations": 0}
        pending = reconcile.stale(self.store.read("document"), "extracted_hash", force).select("path").orderBy("path")
        pending = materialize((pending.limit(limit) if limit else pending).withColumn("n", F.monotonically_increasing_id()), "pending")
        total, last = pending.count(), None
        while done < total and (max_seconds is None or time.monotonic() - began < max_seconds):
            left = pending if last is None else pending.where(F.col("path") > last)
            part = materialize(left.orderBy("path").limit(slice_documents).select("path"), "slice")
            last = part.agg(F.max("path")).first()[0]
            done += part.count()
            with scratch(self.spark):
                made, errors = self._extract(notes.join(part, "path", "left_semi"), part, extract_words)
            failed += errors
            for k, v in made.items():
                counts[k] += v
        return Report("semantic", {"pending": total, **counts, "failed": len(failed), "not reached": max(0, total - done)}, failed)

    def _extract(self, notes: DataFrame, part: DataFrame, size: int) -> tuple[dict[str, int], list[str]]:
        s, store = self.settings, self.store
        prompts = providers.extraction_prompts(notes, size)
        raw = materialize(entities.checked_replies(providers.extracted(prompts.repartition(max(1, s.llm_concurrency)), self.extractor)), "replies")
        errors = raw.where(F.col("error").isNotNull()).groupBy("path").agg(F.min("error").alias("error")).orderBy("path").collect()
        ok = part.join(raw.where(F.col("error").isNotNull()).select("path").distinct(), "path", "left_anti")
        replies = entities.parsed_replies(raw.join(ok, "path", "left_semi"))
        found = materialize(entities.document_entities(replies, s.max_entities), "document-entities")
        relations = entities.document_relations(replies, found)
        vectors = providers.embedded(found.withColumn("label", F.concat("name", F.lit(" ("), "type", F.lit(")"))), self.embedder, "label", batch=s.embed_batch)
        known = materialize(vectors, "entity-vectors")
        from pyspark.sql import Window

        order = known.select("path").distinct().withColumn("seq", F.row_number().over(Window.orderBy("path")).cast("bigint"))
        resolved = materialize(entities.greedy_dedup(known.join(order, "path"), store.read("entity"), s.merge_threshold, dims=s.embed_dims, mode=s.score_mode), "resolved")
        rows = known.join(resolved.select("path", "key", "resolved", F.col("seq").alias("at")), ["path", "key"])
        named = F.when(F.col("resolved") != F.col("key"), F.array_union("aliases", F.array("name"))).otherwise(F.col("aliases"))
        fresh = rows.select(F.col("resolved").alias("key"), "name", "type", named.alias("aliases"), "embedding", F.struct(F.col("at").alias("a"), (F.col("resolved") != F.col("key")).alias("b"), F.col("first").alias("c")).alias("seq"))
        first = F.struct(F.lit(-1).cast("bigint").alias("a"), F.lit(False).alias("b"), F.lit(-1).cast("bigint").alias("c"))
        entity = entities.upsert_entities(store.read("entity").withColumn("seq", first).unionByName(fresh))
        mentions = entities.upsert_mentions(entities.clear_mentions(store.read("mentions"), ok).unionByName(rows.select("path", F.col("resolved").alias("key"), "count")))
        mapped = materialize(entities.remap_relations(relations, resolved), "relations")
        relates = entities.upsert_relations(store.read("relates_to").withColumn("seq", F.lit("")).unionByName(mapped.select("source", "target", "type", "confidence", F.col("path").alias("source_path"), F.col("path").alias("seq"))))
        store.commit({"entity": entity, "mentions": mentions, "relates_to": relates, "document": reconcile.marked(store.read("document"), ok, "extracted_hash")})
        return {"documents": ok.count(), "entities": rows.select("resolved").distinct().count(), "mentions": rows.count(), "relations": mapped.count()}, [f"{r.path}: {r.error}" for r in errors]

    def sync_all(self, force: bool = False, semantic: bool = False) -> list[Report]:
        self.schema()
        notes = materialize(self.notes(), "notes")
        reports = [self.sync_structural(notes), self.sync_embeddings(notes, force)]
        return reports + ([self.sync_semantic(notes, force=force)] if semantic else [])

    def clear_semantics(self) -> int:
        """Without entities, mentions and relations, and with every document to be extracted again."""
        none = lambda t: self.spark.createDataFrame([], schemas.TABLES[t])
        document = self.store.read("document").withColumn("extracted_hash", F.lit(None).cast("string"))
        return self.store.commit({"entity": none("entity"), "mentions": none("mentions"), "relates_to": none("relates_to"), "document": document})

    def overview(self) -> DataFrame:
        t = self.store.read
        return graph.graph_overview(t("document"), t("chunk"), t("tagged"), t("entity"), t("links_to"), t("mentions"), t("relates_to"))

    def status(self) -> str:
        """Counts of the store; says what is wrong instead of failing."""
        try:
            row = self.overview().first().asDict()
            return Report("status", {"version": (self.store.versions() or [0])[-1], **row}).render()
        except Exception as why:
            return f"status: the store cannot be read ({type(why).__name__}: {str(why)[:200]})"

    def parse_check(self) -> Report:
        """A dry run of scan, parsing, link resolution and chunking, without a store."""
        notes = materialize(self.notes(), "notes")
        resolved = materialize(reconcile.resolve_links(notes), "resolved")
        chunks = chunking.chunk_documents(notes, self.settings.chunk_words, self.settings.chunk_overlap)
        missing = resolved.where("dst is null").orderBy("src", "raw").limit(16).collect()
        return Report(
            "parse check",
            {"notes": notes.count(), "with tags": notes.where(F.size("tags") > 0).count(), "tags": notes.select(F.explode("tags")).distinct().count(), "links": resolved.where("dst is not null").count(), "unresolved": resolved.where("dst is null").count(), "chunks": chunks.count()},
            [f"{r.src} -> [[{r.raw}]]" for r in missing],
        )

    def search(self, query: str, limit: int = 8) -> DataFrame:
        probe = providers.query_vector(self.embedder, query, self.settings.embed_instruction)
        return graph.semantic_search(self.store.read("chunk"), probe, limit, self.settings.embed_dims, self.settings.score_mode)

    def documents_by_tag(self, tag: str) -> DataFrame:
        return graph.documents_by_tag(self.store.read("document"), self.store.read("tagged"), tag)

    def list_tags(self, min_documents: int = 1) -> DataFrame:
        return graph.list_tags(self.store.read("tagged"), min_documents)

    def entities_in_document(self, path: str) -> DataFrame:
        t = self.store.read
        return graph.entities_in_documents(t("document"), t("tagged"), t("links_to"), t("mentions"), t("entity"), path)

    def similar_documents(self, path: str, limit: int = 8) -> DataFrame:
        return graph.similar_documents(self.store.read("document"), self.store.read("chunk"), path, limit, dims=self.settings.embed_dims, mode=self.settings.score_mode)

    def _semantic_only(self) -> None:
        if not self.settings.semantic_queries:
            raise PermissionError("questions about entities are off; set semantic_queries")

    def find_related_entities(self, name: str, max_hops: int = 2) -> DataFrame:
        self._semantic_only()
        t = self.store.read
        return graph.find_related_entities(t("entity"), t("relates_to"), t("mentions"), t("document"), name, max_hops)

    def shortest_path(self, name_a: str, name_b: str) -> DataFrame:
        self._semantic_only()
        return graph.shortest_path(self.store.read("entity"), self.store.read("relates_to"), name_a, name_b)

    def ask(self, question: str, *args: str) -> str:
        """The answer to a question as text, one row a line; where there is nothing to say, a message that says so. Numbers may be given as text."""
        about = " ".join(args[:1])
        ways = {
            "search": (self.search, ["path", "section", "score", "snippet"], "No passage is near to that."),
            "tag": (self.documents_by_tag, ["path", "title", "updated"], f"No document has the tag {about}."),
            "tags": (self.list_tags, ["tag", "documents"], "There are no tags."),
            "document": (self.entities_in_document, ["title", "category", "tags", "links_out", "links_in", "entities"], f"There is no document {about}."),
            "similar": (self.similar_documents, ["path", "title", "score"], f"There is no document {about}, or it has no vectors, or none is near to it."),
            "related": (self.find_related_entities, ["entity", "type", "hops", "via", "documents"], f"Nothing is related to {about}."),
            "path": (self.shortest_path, [], f"No path of up to {graph.MAX_PATH} relations leads from {about} to {' '.join(args[1:2])}."),
            "recent": (self.recent_related_changes, ["path", "title", "updated"], f"No document that mentions {about} has changed since."),
        }
        if question not in ways:
            raise ValueError(f"no such question: {question}; there are {', '.join(ways)}")
        answer, columns, empty = ways[question]
        rows = answer(*(int(a) if a.isdigit() else a for a in args)).collect()  # answers have a limit
        return "\n".join(map(graph.render_path, rows)) or empty if question == "path" else graph.formatted(rows, columns, empty)

    def recent_related_changes(self, name: str, since: str = "") -> DataFrame:
        self._semantic_only()
        t = self.store.read
        return graph.recent_related_changes(t("entity"), t("mentions"), t("document"), name, since)
