"""Shared pieces of the corpus operators: shared-folder tables, input columns."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import shared_dir, spread

__all__ = ["crc_bucket", "fresh", "materialize", "release", "shared_dir", "shuffle_width", "spread"]
_written: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    The lineage is cut there, so work after this line is not repeated when an executor is lost, and nothing is kept on
    executors. Tables of a session are removed at its end, or by release() once a result has been written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpus-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Remove the tables that materialize() wrote, as far as the session still lives."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: its folder goes with the application
            return


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_bucket(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids: null)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


def fresh(columns: list[str], name: str) -> str:
    """name with underscores before it until no column begins so (without regard to case)."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name = f"_{name}"
    return name
