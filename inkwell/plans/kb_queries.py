"""Queries over the delivered tables of a knowledge base: snapshots and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.orphan_refs import orphan_note_references, orphan_report
from inkwell.operators.snapshot_diff import snapshot_diff
from inkwell.session import table


def p2_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_diff(
        table(spark, sf_dir, "document_snapshot"), key=["path"], version="snapshot_no", compare={"content_hash": F.lower("content_hash")}, delivered="loaded_at"
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_changes(spark, sf_dir).select("snapshot_no", "path", "change")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_changes(spark, sf_dir).groupBy("snapshot_no", "change").agg(F.count("*").alias("records"))


def p4_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_note_references(table(spark, sf_dir, "kb_document").select("path", "stub", "links", "supersedes", "scanned_at", "deleted_at"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_orphans(spark, sf_dir).select("path", "field", "target")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(p4_orphans(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p4_found": p4_found, "p4_report": p4_report}

_CHANGES = """
WITH latest AS (
  SELECT snapshot_no, path, lower(content_hash) AS h FROM document_snapshot WHERE snapshot_no IS NOT NULL AND path IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, path ORDER BY loaded_at DESC NULLS LAST, lower(content_hash) DESC NULLS LAST) = 1),
versions AS (SELECT snapshot_no AS v, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT snapshot_no FROM latest)),
pairs AS (
  SELECT coalesce(n.v, o.ov) AS snapshot_no, coalesce(n.path, o.path) AS path,
         CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
              WHEN n.h IS DISTINCT FROM o.h THEN 'changed' END AS change
  FROM (SELECT v, before, path, h FROM versions JOIN latest ON snapshot_no = v WHERE before IS NOT NULL) n
  FULL JOIN (SELECT v AS ov, path, h FROM versions JOIN latest ON snapshot_no = before) o ON n.v = o.ov AND n.path = o.path),
changes AS (SELECT * FROM pairs WHERE change IS NOT NULL)
"""

_ORPHANS = """
WITH first AS (SELECT path, min(scanned_at) AS scanned_at FROM kb_document WHERE path IS NOT NULL GROUP BY path),
refs AS (
  SELECT DISTINCT r.path, field, target, f.scanned_at FROM (
    SELECT path, 'links' AS field, unnest(links) AS target FROM kb_document
    UNION ALL SELECT path, 'supersedes', unnest(supersedes) FROM kb_document) r
  JOIN first f ON f.path = r.path WHERE target IS NOT NULL AND f.scanned_at IS NOT NULL),
notes AS (
  SELECT path, min(scanned_at) AS born, max(deleted_at) AS died, regexp_replace(lower(path), '\\.md$', '') AS loose
  FROM kb_document WHERE path IS NOT NULL AND NOT coalesce(stub, FALSE) GROUP BY path),
stems AS (
  SELECT string_split(loose, '/')[-1] AS stem, min(born) AS born, max(died) AS died FROM notes GROUP BY 1 HAVING count(*) = 1),
keyed AS (
  SELECT *, regexp_replace(lower(trim(target, '/')), '\\.md$', '') AS loose FROM refs),
judged AS (
  SELECT k.*,
    CASE WHEN field = 'supersedes'
         THEN EXISTS (SELECT 1 FROM notes n WHERE n.path = k.target AND born <= k.scanned_at AND (died IS NULL OR k.scanned_at < died))
         WHEN EXISTS (SELECT 1 FROM notes n WHERE n.loose = k.loose)
         THEN EXISTS (SELECT 1 FROM notes n WHERE n.loose = k.loose AND born <= k.scanned_at AND (died IS NULL OR k.scanned_at < died))
         ELSE EXISTS (SELECT 1 FROM stems s WHERE s.stem = string_split(k.loose, '/')[-1] AND born <= k.scanned_at AND (died IS NULL OR k.scanned_at < died))
    END AS alive
  FROM keyed k),
orphans AS (SELECT path, field, target, scanned_at FROM judged WHERE NOT alive)
"""

SQL = {
    "p2_found": _CHANGES + "SELECT snapshot_no, path, change FROM changes",
    "p2_report": _CHANGES + "SELECT snapshot_no, change, count(*) AS records FROM changes GROUP BY ALL",
    "p4_found": _ORPHANS + "SELECT path, field, target FROM orphans",
    "p4_report": _ORPHANS + "SELECT field, scanned_at, count(*) AS orphans, count(DISTINCT target) AS targets FROM orphans GROUP BY ALL",
}
