"""Hashes of files, found where the files are read, and which recorded files changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Larger files are not read.
MOST_BYTES = 256 * 2**20


def file_hashes(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(path, bytes, sha256) of files; sha256 is null for those over ``most`` bytes, of which only the size is read."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= most).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > most).select("path", F.col("length").alias("bytes"), F.lit(None).cast("string").alias("sha256"))
    return small.unionByName(large)


def changed_files(spark: SparkSession, recorded: DataFrame, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(project, path, fault) of recorded files (project, path, sha256) under path: missing, oversize or changed. Paths are as Spark lists them."""
    both = recorded.join(file_hashes(spark, path, most).select("path", "bytes", F.col("sha256").alias("now")), "path", "left")
    fault = F.when(F.col("bytes").isNull(), "missing").when(F.col("bytes") > most, "oversize").when(~F.col("sha256").eqNullSafe(F.col("now")), "changed")
    return both.select("project", "path", fault.alias("fault")).where("fault IS NOT NULL")
