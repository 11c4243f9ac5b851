"""Session helpers: tables, lineage cuts, salted joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``. Where that is unset, a temporary one, if driver and executors are one process, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = getattr(spark.sparkContext, "_inkwell_folder", None)
        if not where:
            where = spark.sparkContext._inkwell_folder = "file://" + tempfile.mkdtemp(prefix="inkwell-")
    return where


#: Paths of materialized tables by the scopes that are open, innermost last.
_scopes: list[list[str]] = []


def materialize(df: DataFrame, label: str = "cut", by: Sequence[str] = ()) -> DataFrame:
    """``df`` written as a parquet table in the shared folder, partitioned ``by`` columns, and read back: cuts the lineage and survives lost executors.

    The table is removed when the ``scratch`` scope it was made in ends, or else when the driver does.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/inkwell-{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    else:
        atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


@contextmanager
def scratch(spark: SparkSession):
    """Removes the tables that were materialized inside when it ends; for stages whose results are written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone already
        pass


def same(a: Column | str, b: Column | str) -> Column:
    """Null-safe equality."""
    a = F.col(a) if isinstance(a, str) else a
    return a.eqNullSafe(F.col(b) if isinstance(b, str) else b)


#: A key with over 1/MAX_HOT of all rows is hot; so there are fewer than MAX_HOT hot keys, whatever the data.
MAX_HOT = 1000


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", salts: int = 32, min_rows: int = 100_000) -> DataFrame:
    """An equi-join whose hot keys on the left are spread over ``salts`` tasks.

    Hot keys are those with at least ``min_rows`` rows and over 1/``MAX_HOT`` of the left side, so the
    broadcast list has under ``MAX_HOT`` rows by arithmetic. Only the right rows of hot keys are repeated, once a salt. Types ``inner``,
    ``left``, ``left_semi`` and ``left_anti`` keep their usual meaning, since a left row has one salt.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    on = list(on)
    counts = left.groupBy(*on).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"))
    hot = counts.where(F.col("__n") >= min_rows).crossJoin(F.broadcast(total)).where(F.col("__n") * MAX_HOT > F.col("__all"))
    hot = F.broadcast(hot.select(*on, F.lit(True).alias("__hot")))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    spread = left.join(hot, on, "left").withColumn("__salt", salt).drop("__hot")
    each = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copies = right.join(hot, on, "left").withColumn("__salt", F.explode(each)).drop("__hot")
    return spread.join(copies, [*on, "__salt"], how).drop("__salt")
