"""What changed between full snapshots of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows, about, whose keys are sampled for the borders of the ranges.
SAMPLE = 10_000


def snapshot_diff(
    snapshots: DataFrame,
    key: Sequence[str],
    version: str,
    compare: Mapping[str, Column],
    delivered: str,
    ranges: int | None = None,
) -> DataFrame:
    """Typed changes between consecutive existing versions: ``version``, ``key``, ``change``, ``changed_columns``.

    One shuffle: rows go to key ranges, whose borders come from a bounded sample. Before that each batch of rows shrinks to the last delivery of a key in a
    version, so that a key delivered a million times moves a few times a task. Each range is one run sorted by key and version, in which a key's
    consecutive versions are neighbours, and a single pass compares each row with the one before and after it - the two pointers of a merge.

    ``compare`` names the compared expressions; null is a value of its own. ``change`` is ``added``,
    ``removed`` or ``changed``; ``changed_columns`` lists the names that differ and is empty otherwise. The first
    version yields nothing. Versions may have gaps: the one before is the one that exists.

    Defined cases: a row without a version or with a null in its key names no record and is left out; a null
    ``delivered`` counts as earliest; of deliveries at the same instant the one with the greatest compared values
    counts, so repeated rows count once; no rows give no changes; other columns are ignored, whatever their names.
    """
    key, names = list(key), list(compare)
    keys, values = [f"__k{i}" for i in range(len(key))], ["__at", *(f"__c{i}" for i in range(len(names)))]
    flat = snapshots.select(
        F.col(version).alias("__v"), *(F.col(k).alias(a) for k, a in zip(key, keys)), F.col(delivered).alias("__at"), *(compare[n].alias(f"__c{i}") for i, n in enumerate(names))
    ).dropna(subset=["__v", *keys])
    tasks = ranges or int(snapshots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = flat.groupBy("__v").agg(F.count("*").alias("n")).collect()  # one row a snapshot
    versions, total = sorted(r["__v"] for r in counted), sum(r.n for r in counted)
    sampled = flat.select(F.col("__k0").cast("string").alias("k")).sample(min(1.0, SAMPLE / max(1, total)), seed=7)
    seen = sorted({r.k for r in sampled.collect()})
    borders = np.array(sorted({seen[len(seen) * n // (4 * tasks)] for n in range(1, 4 * tasks)}) if seen else [], object)
    schema = flat.withColumn("__range", F.lit(0)).schema

    def shrink(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            order = pc.sort_indices(rows, [("__v", "ascending"), *((k, "ascending") for k in keys)])
            rows = rows.take(order)
            new = np.zeros(len(rows), bool)
            new[:1] = True
            for c in ("__v", *keys):
                column = rows[c].combine_chunks()
                new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            if not new.all():  # only where a batch repeats a key is the last delivery looked for
                group = pa.array(np.cumsum(new))
                rows = rows.append_column("__g", group)
                best = pc.sort_indices(rows, [("__g", "ascending"), *((c, "descending") for c in values)], null_placement="at_end")
                rows = rows.take(best.take(pa.array(np.flatnonzero(new)))).drop(["__g"])
            at = np.searchsorted(borders, np.array(rows["__k0"].cast(pa.string()).to_pylist(), object), "right") if len(borders) else np.zeros(len(rows), int)
            yield from rows.append_column("__range", pa.array(at, pa.int32())).to_batches()

    ranged = flat.mapInArrow(shrink, schema).repartition(tasks, "__range")
    last = ranged.groupBy("__range", *keys, "__v").agg(F.max(F.struct(*values)).alias("__row"))
    run = Window.partitionBy("__range", *keys).orderBy("__v")
    lookup = {v: (versions[n - 1] if n else None, versions[n + 1] if n + 1 < len(versions) else None) for n, v in enumerate(versions)}
    kind = flat.schema["__v"].dataType.simpleString()
    table = F.array(*(F.struct(F.lit(v).cast(kind).alias("v"), F.lit(a).cast(kind).alias("before"), F.lit(b).cast(kind).alias("after")) for v, (a, b) in lookup.items())) if lookup else None
    steps = F.map_from_entries(F.transform(table, lambda x: F.struct(x["v"], F.struct(x["before"], x["after"])))) if lookup else F.lit(None).cast(f"map<{kind},struct<before:{kind},after:{kind}>>")
    seen_ = last.withColumn("__step", F.try_element_at(steps, F.col("__v"))).select(
        "__v", *keys, F.col("__step.before").alias("__before"), F.col("__step.after").alias("__after"), "__row",
        F.lag("__v").over(run).alias("__pv"), F.lag("__row").over(run).alias("__prow"), F.lead("__v").over(run).alias("__nv"),
    )
    none = F.array().cast("array<string>")
    differ = F.filter(
        F.array(*(F.when(~F.col(f"__row.__c{i}").eqNullSafe(F.col(f"__prow.__c{i}")), F.lit(n)) for i, n in enumerate(names))),
        lambda x: x.isNotNull(),
    )
    continued = F.col("__pv").eqNullSafe(F.col("__before"))
    event = lambda v, what, cols: F.struct(v.alias("v"), F.lit(what).alias("change"), cols.alias("cols"))
    here = F.when(F.col("__before").isNotNull() & ~continued, event(F.col("__v"), "added", none)).when(
        F.col("__before").isNotNull() & continued & (F.size(differ) > 0), event(F.col("__v"), "changed", differ)
    )
    gone = F.when(F.col("__after").isNotNull() & ~F.col("__nv").eqNullSafe(F.col("__after")), event(F.col("__after"), "removed", none))
    events = seen_.select(*keys, F.explode(F.filter(F.array(here, gone), lambda x: x.isNotNull())).alias("e"))
    return events.select(
        F.col("e.v").alias(version), *(F.col(a).alias(k) for k, a in zip(key, keys)), F.col("e.change").alias("change"), F.col("e.cols").alias("changed_columns")
    )


def write_snapshot_ranges(snapshots: DataFrame, path: str, key: Sequence[str], version: str, ranges: int) -> None:
    """Keep snapshots as ``ranges`` files a version, range-partitioned and sorted by key. Versions that are kept already and are not in ``snapshots`` stay."""
    kept = snapshots.repartitionByRange(ranges, *key).sortWithinPartitions(version, *key).write.mode("overwrite")
    kept.option("partitionOverwriteMode", "dynamic").partitionBy(version).parquet(path)


def newest_changes(spark: SparkSession, path: str, key: Sequence[str], version: str, compare: Mapping[str, Column], delivered: str) -> DataFrame:
    """The changes that the newest of the kept snapshots brought: only it and the one before it are read."""
    kept = spark.read.parquet(path)
    versions = [r[0] for r in kept.select(version).distinct().orderBy(F.desc(version)).limit(2).collect()]  # from the folder names
    return snapshot_diff(kept.where(F.col(version).isin(versions)), key, version, compare, delivered)
