"""References to records that do not exist (yet, or any more)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import materialize, salted_join


def orphan_references(
    refs: DataFrame,
    keys: DataFrame,
    columns: Sequence[tuple[str, str]],
    match: str = "partial",
    at: str | None = None,
    lives: tuple[str, str] | None = None,
    hot: bool = True,
) -> DataFrame:
    """The rows of ``refs`` whose composite key names no row of ``keys``.

    ``columns`` pairs a reference column with a key column. References are grouped by which of their columns are null; each
    group is anti-joined on its non-null columns only. ``match`` is the declared semantics of SQL foreign keys: under ``simple`` a reference with
    any null is satisfied, under ``full`` one with some but not all nulls is an orphan, under ``partial``
    the non-null columns must agree with some key. A reference of nulls only refers to nothing and is never an orphan.

    With ``at`` and ``lives`` = (born, died) a key satisfies a reference only if born <= at < died; a null
    ``died`` means alive still, a null ``born`` or ``at`` satisfies nothing. ``hot`` says that one key may take a large
    share of the references, whose rows are then spread over several tasks; callers that have combined equal references set it off.

    Defined cases: repeated references come back as often as they stand, repeated keys match once; no keys make every
    reference with a value an orphan; columns of the two sides may clash, since key columns are renamed before the join.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(match)
    out = None
    for mask in product((True, False), repeat=len(columns)):
        used = [c for c, on in zip(columns, mask) if on]
        if not used or (match == "simple" and len(used) < len(columns)):
            continue
        part = refs
        for (r, _), on in zip(columns, mask):
            part = part.where(F.col(r).isNotNull() if on else F.col(r).isNull())
        if match == "full" and len(used) < len(columns):
            found = part
        else:
            names = [r for r, _ in used]
            side = keys.select(*(F.col(k).alias(r) for r, k in used), *([F.col(lives[0]).alias("__born"), F.col(lives[1]).alias("__died")] if lives else [])).dropna(subset=names).distinct()
            if lives:
                side = side.groupBy(*names).agg(F.collect_list(F.struct("__born", "__died")).alias("__lives"))
                alive = lambda x: (x["__born"] <= F.col(at)) & (x["__died"].isNull() | (F.col(at) < x["__died"]))
                pairs = salted_join(part, side, names, "left") if hot else part.join(side, names, "left")
                found = pairs.where(~F.coalesce(F.exists("__lives", alive), F.lit(False))).select(*refs.columns)
            else:
                found = salted_join(part, side, names, "left_anti") if hot else part.join(side, names, "left_anti")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else refs.limit(0)


def note_references(notes: DataFrame) -> DataFrame:
    """Distinct references of scanned notes: ``path``, ``field``, ``target``, ``scanned_at`` (the path's earliest scan).

    Deliveries of a path are combined before the shuffle. Null elements, null arrays and rows without a path
    refer to nothing; a path that has no scan time at all has no scan to be judged by and is left out.
    """
    per = (
        notes.where(F.col("path").isNotNull())
        .groupBy("path")
        .agg(F.min("scanned_at").alias("scanned_at"), F.collect_set("links").alias("links"), F.collect_set("supersedes").alias("supersedes"))
    )
    each = lambda f: F.transform(F.array_distinct(F.flatten(f)), lambda t: F.struct(F.lit(f).alias("field"), t.alias("target")))
    return (
        per.select("path", "scanned_at", F.explode(F.concat(each("links"), each("supersedes"))).alias("r"))
        .select("path", F.col("r.field").alias("field"), F.col("r.target").alias("target"), "scanned_at")
        .where(F.col("target").isNotNull() & F.col("scanned_at").isNotNull())
    )


def without_md(c):
    return F.regexp_replace(c, r"\.md$", "")


def orphan_note_references(notes: DataFrame) -> DataFrame:
    """References of notes that resolve to no note alive at the scan: ``path``, ``field``, ``target``, ``scanned_at``.

    A note is a path that is no stub (null means no stub); it lives from its earliest ``scanned_at`` until before its
    ``deleted_at``. ``supersedes`` resolves by the exact path. A link resolves by its path, case and ``.md`` and outer ``/``
    ignored, else by its file name if just one note of the table has it. Of notes whose paths differ in case or ``.md`` only, any
    that is alive will do. So a reference is a composite key (exact path, loose path) of which one column is null, and
    later (file name); each is anti-joined by ``orphan_references``.

    Only distinct targets of a scan are resolved; a target that a third of all references name is resolved once a scan, and
    the way back to the references is a salted join.
    """
    refs = materialize(note_references(notes), "refs")
    alive = materialize(
        notes.where(F.col("path").isNotNull() & ~F.coalesce("stub", F.lit(False)))
        .groupBy("path")
        .agg(F.min("scanned_at").alias("born"), F.max("deleted_at").alias("died"))
        .withColumn("loose", without_md(F.lower("path")))
        .withColumn("stem", F.element_at(F.split("loose", "/"), -1)),
        "notes",
    )
    single = alive.groupBy("stem").agg(F.count("*").alias("n"), F.first("born").alias("born"), F.first("died").alias("died")).where("n = 1")
    is_link = F.col("field") == "links"
    trimmed = F.lower(F.regexp_replace("target", "^/+|/+$", ""))
    targets = (
        refs.select("field", "target", "scanned_at").distinct()
        .withColumn("exact", F.when(~is_link, F.col("target")))
        .withColumn("by_path", F.when(is_link, without_md(trimmed)))
        .withColumn("by_name", F.when(is_link, F.element_at(F.split(without_md(trimmed), "/"), -1)))
    )
    by_path = [("exact", "path"), ("by_path", "loose")]
    not_alive = orphan_references(targets, alive, by_path, at="scanned_at", lives=("born", "died"), hot=False)
    not_alive = materialize(not_alive, "not-alive")
    unknown = orphan_references(not_alive, alive, by_path, hot=False)
    ids = ["field", "target", "scanned_at"]
    dead = not_alive.join(unknown.select(*ids), ids, "left_anti")
    unnamed = orphan_references(unknown.where(is_link), single, [("by_name", "stem")], at="scanned_at", lives=("born", "died"), hot=False)
    bad = dead.select(*ids).unionByName(unknown.where(~is_link).select(*ids)).unionByName(unnamed.select(*ids))
    return salted_join(refs, bad, ids, "left_semi").select("path", "field", "target", "scanned_at")


def orphan_report(orphans: DataFrame, by: Sequence[str] = ("field", "scanned_at")) -> DataFrame:
    """Orphans counted per referring table (field) and period."""
    return orphans.groupBy(*by).agg(F.count("*").alias("orphans"), F.countDistinct("target").alias("targets"))
