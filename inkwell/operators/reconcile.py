"""From parsed notes to graph tables, and from one state of the tables to the next.

A run computes the whole next state; what a graph store does by upserting, stamping and pruning is a comparison of two states here.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell import schemas
from inkwell.functions import text as T
from inkwell.session import salted_join

UNRESOLVED = "unresolved:"


def not_stub(c: str = "stub"):
    return ~F.coalesce(F.col(c), F.lit(False))


def resolve_links(notes: DataFrame) -> DataFrame:
    """Links of notes (``path``, ``links``, optional ``seq``): ``src``, ``raw``, ``dst``; ``dst`` is null where no note is meant.

    A link is looked up by path, case, outer ``/`` and ``.md`` ignored, then by file name if one note only has it. Of paths that are equal but for case
    the last in order counts. Links to the note itself are left out. Distinct per source and note.
    """
    seq = F.col("seq") if "seq" in notes.columns else F.col("path")
    named = notes.select("path", seq.alias("seq"), F.lower("path").alias("low")).distinct()
    forms = F.array_distinct(F.array(F.col("low"), F.regexp_replace("low", r"\.md$", "")))
    by_path = named.select(F.explode(forms).alias("key"), "path", "seq").groupBy("key").agg(F.max_by("path", F.struct("seq", "path")).alias("by_path"))
    by_stem = named.groupBy(F.lower(T.file_stem("path")).alias("stem")).agg(F.countDistinct("path").alias("n"), F.min("path").alias("by_stem")).where("n = 1").drop("n")
    key = F.lower(F.regexp_replace("raw", "^/+|/+$", ""))
    raw = notes.select(F.col("path").alias("src"), F.explode("links").alias("raw")).where(F.col("raw").isNotNull()).distinct()
    asked = raw.select("raw").distinct().withColumn("key", key).withColumn("key_md", F.concat(key, F.lit(".md"))).withColumn("stem", F.regexp_replace(F.element_at(F.split(key, "/"), -1), r"\.md$", ""))
    known = (
        asked.join(by_path, "key", "left")
        .join(by_path.select(F.col("key").alias("key_md"), F.col("by_path").alias("by_md")), "key_md", "left")
        .join(by_stem, "stem", "left")
        .select("raw", F.coalesce("by_path", "by_md", "by_stem").alias("dst"))
    )
    found = salted_join(raw, known, ["raw"])  # very many notes may name one target
    linked = found.where(F.col("dst").isNotNull() & (F.col("dst") != F.col("src"))).groupBy("src", "dst").agg(F.min("raw").alias("raw"))
    return linked.select("src", "raw", "dst").unionByName(found.where(F.col("dst").isNull()).select("src", "raw", "dst"))


def link_tables(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``links_to`` and the stub documents that unresolved links need. Targets that differ in case are different stubs."""
    target = F.coalesce("dst", F.concat(F.lit(UNRESOLVED), "raw"))
    links = resolved.select("src", target.alias("dst")).distinct()
    stubs = resolved.where("dst is null").select("raw").distinct()
    none = lambda t: F.lit(None).cast(t)
    return links, stubs.select(
        F.concat(F.lit(UNRESOLVED), "raw").alias("path"), T.stub_title("raw").alias("title"), F.lit("unresolved").alias("category"), none("string").alias("subcategory"), none("string").alias("content_hash"),
        none("string").alias("created"), none("string").alias("updated"), none("bigint").alias("word_count"), F.lit(True).alias("stub"), none("string").alias("chunked_hash"), none("string").alias("extracted_hash"),
    )


def tag_edges(notes: DataFrame) -> DataFrame:
    return notes.select("path", F.explode("tags").alias("tag")).distinct()


def supersedes_edges(notes: DataFrame) -> DataFrame:
    """Edges to exact known paths only; anything else is dropped."""
    known = notes.select(F.col("path").alias("dst")).distinct()
    return notes.select(F.col("path").alias("src"), F.explode("supersedes").alias("dst")).distinct().join(known, "dst", "left_semi").select("src", "dst")


def existing_ends(edges: DataFrame, nodes: DataFrame, ends: tuple[str, str], key: str) -> DataFrame:
    """Edges both of whose ends exist."""
    for end in ends:
        edges = edges.join(nodes.select(F.col(key).alias(end)).distinct(), end, "left_semi")
    return edges


def carry_marks(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """New documents with the watermarks of their path's old row."""
    if old is None:
        return new.withColumn("chunked_hash", F.lit(None).cast("string")).withColumn("extracted_hash", F.lit(None).cast("string"))
    return new.drop("chunked_hash", "extracted_hash").join(old.select("path", "chunked_hash", "extracted_hash"), "path", "left")


def structural_state(notes: DataFrame, old: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The next ``document``, ``tagged``, ``links_to``, ``supersedes`` and surviving ``chunk`` from parsed notes and the state before."""
    old = old or {}
    one = notes.dropDuplicates(["path"])
    links, stubs = link_tables(resolve_links(one))
    own = one.select("path", "title", "category", "subcategory", "content_hash", "created", "updated", "word_count", F.lit(False).alias("stub"))
    document = carry_marks(own, old.get("document")).select(*(c.split()[0] for c in schemas.DOCUMENT.split(", "))).unionByName(stubs)
    state = {"document": document, "tagged": tag_edges(one), "links_to": links, "supersedes": supersedes_edges(one)}
    if "chunk" in old:
        state["chunk"] = old["chunk"].join(own.select(F.col("path").alias("doc_path")), "doc_path", "left_semi")
    return state


def pruned(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """What the old state has and the new one lacks, by key."""
    return old.join(new.select(*key).distinct(), key, "left_anti")


def prune_documents(old: DataFrame, new_paths: DataFrame) -> DataFrame:
    """Documents, stubs aside, that the run did not see."""
    return pruned(old.where(not_stub()), new_paths, ["path"])


def orphan_stubs(document: DataFrame, links_to: DataFrame) -> DataFrame:
    """Stubs that no link leads to."""
    return document.where(~not_stub()).join(links_to.select(F.col("dst").alias("path")).distinct(), "path", "left_anti")


def orphan_tags(tags: DataFrame, tagged: DataFrame) -> DataFrame:
    """Tags that no document carries."""
    return tags.select("tag").distinct().join(tagged.select("tag").distinct(), "tag", "left_anti")


def stale(document: DataFrame, mark: str, force: bool = False) -> DataFrame:
    """Documents, stubs aside, whose watermark is not their hash; all of them with ``force``."""
    own = document.where(not_stub())
    return own if force else own.where(~F.col(mark).eqNullSafe(F.col("content_hash")))


def replace_chunks(old: DataFrame, fresh: DataFrame, pending: DataFrame, document: DataFrame) -> DataFrame:
    """Chunks after a run: the old ones of documents that were not pending, and the fresh ones of documents that exist."""
    kept = old.join(pending.select(F.col("path").alias("doc_path")).distinct(), "doc_path", "left_anti")
    known = document.select(F.col("path").alias("doc_path")).distinct()
    return kept.unionByName(fresh.join(known, "doc_path", "left_semi").select(*old.columns))


def marked(document: DataFrame, done: DataFrame, mark: str) -> DataFrame:
    """Documents with the watermark set to their hash where ``done`` has their path."""
    flag = done.select("path", F.lit(True).alias("__done")).distinct()
    return document.join(flag, "path", "left").withColumn(mark, F.when(F.col("__done"), F.col("content_hash")).otherwise(F.col(mark))).drop("__done").select(*document.columns)


def duplicate_keys(table: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once; a table that keeps its promise has none."""
    return table.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


@dataclass
class Report:
    """Counts of a stage, and its text."""

    stage: str
    counts: dict[str, int] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)

    def render(self, shown: int = 15) -> str:
        lines = [f"{self.stage}:"] + [f"  {k}: {v}" for k, v in self.counts.items()]
        lines += [f"  - {n}" for n in self.notes[:shown]]
        if len(self.notes) > shown:
            lines.append(f"  ... {len(self.notes) - shown} more")
        return "\n".join(lines)
