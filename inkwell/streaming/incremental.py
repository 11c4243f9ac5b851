"""Chunks kept up to date from a stream of note deliveries.

Every micro-batch writes the chunks of the notes whose text changed into a partition of its own, which a repeated batch overwrites, so a restart
after a crash neither loses nor doubles anything. The table's state is, for each path, what its latest delivery says (by ``scanned_at``, then by batch), however late
the others arrive. A deleted note is a row without hash and chunks. ``compact`` folds the history into one partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkwell.functions import text as T
from inkwell.operators import chunking

STATE = "batch bigint, path string, scanned_at timestamp_ntz, hash string, chunks array<struct<id string, ordinal int, text string, breadcrumb string, word_count int>>"


def _rows(spark: SparkSession, sink: str) -> DataFrame:
    """The whole sink; empty if nothing was written yet. Other failures to read are failures."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sink)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(STATE).parquet(sink) if there else spark.createDataFrame([], STATE)


def _last(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy("path").agg(F.max(F.struct("scanned_at", "batch", *columns)).alias("r")).select("path", "r.scanned_at", *(f"r.{c}" for c in columns))


def current(spark: SparkSession, sink: str) -> DataFrame:
    """The state of each path that is not deleted: ``path``, ``hash``, ``chunks``."""
    return _last(_rows(spark, sink), "hash", "chunks").where("hash is not null").select("path", "hash", "chunks")


def merge_batch(batch: DataFrame, number: int, sink: str, size: int = 350, overlap: int = 60) -> None:
    """Writes the changed notes of a batch (``path``, ``title``, ``body``, ``scanned_at``, if need be ``deleted_at``). Of several deliveries of a path the last counts.

    A delivery older than what the sink has of its path changes nothing. Where ``deleted_at`` is set the note is gone from then on.
    """
    spark = batch.sparkSession
    gone = F.col("deleted_at") if "deleted_at" in batch.columns else F.lit(None).cast("timestamp_ntz")
    at = F.coalesce(gone, F.col("scanned_at")).cast("timestamp_ntz").alias("scanned_at")
    rows = batch.where("path is not null").select("path", at, gone.isNotNull().alias("gone"), "title", "body")
    last = rows.groupBy("path").agg(F.max(F.struct("scanned_at", "gone", "title", "body")).alias("r")).select("path", "r.*").withColumn("hash", F.when(~F.col("gone"), T.content_hash(F.coalesce("body", F.lit("")))))
    known = _last(_rows(spark, sink).where(F.col("batch") != number), "hash").select("path", F.col("scanned_at").alias("since"), F.col("hash").alias("known"))  # without what this very batch wrote before
    newer = F.col("since").isNull() | (F.col("scanned_at") >= F.col("since"))
    changed = last.join(known, "path", "left").where(newer & ~F.col("hash").eqNullSafe(F.col("known"))).drop("known", "since")
    cut = chunking.chunk_documents(changed.where("not gone"), size, overlap)
    per = cut.groupBy(F.col("doc_path").alias("path")).agg(F.array_sort(F.collect_list(F.struct("id", "ordinal", "text", "breadcrumb", "word_count"))).alias("chunks"))
    out = changed.select("path", "scanned_at", "hash").join(per, "path", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast(STATE.split("chunks ")[1])))
    out.write.mode("overwrite").parquet(f"{sink}/batch={number}")


def compact(spark: SparkSession, sink: str, into: str) -> None:
    """Writes the state of a sink, deletions included, as the only batch of a new one, which streams go on with; batches count up from there."""
    rows = _rows(spark, sink)
    last = rows.agg(F.max("batch")).first()[0]
    if last is not None:
        _last(rows, "hash", "chunks").select("path", "scanned_at", "hash", "chunks").write.mode("overwrite").parquet(f"{into}/batch={last}")


def run_available(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, files_per_batch: int = 100) -> None:
    """Takes in all files that are there and new, in batches of ``files_per_batch``, and stops."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.select(*(c for c in ("path", "title", "body", "scanned_at", "deleted_at") if c in stream.columns)).writeStream.foreachBatch(lambda batch, number: merge_batch(batch, number, sink)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
