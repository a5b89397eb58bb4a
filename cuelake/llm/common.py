"""Small helpers that several training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII capitals; contracts lower only these.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of at most 64 bytes that a broadcast may hold; larger sides are shuffled.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work").rstrip("/")


#: Whether Spark deletes the shuffle files of a query as soon as it is over, not when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Work:
    """Tables written under the shared folder to cut lineage; a lost executor only costs a re-read."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.live: set[str] = set()
        self.codec = spark.conf.get("spark.sql.parquet.compression.codec")

    def cut(self, df: DataFrame) -> DataFrame:
        """Write df as Parquet and read it back. What it shuffled is deleted: nobody reads that again."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(FREE_SHUFFLES)
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.option("compression", self.codec).parquet(path)
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before)
        self.live.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cut_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in dfs:
            self._delete(df._cut_path)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df and delete every other table of this work: what an operator returns needs no other."""
        older = set(self.live)
        out = self.cut(df)
        for path in older:
            self._delete(path)
        return out

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.live.discard(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many leading underscores as it takes to differ from all columns of df (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, all else as it is. All-ASCII texts take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, separators: str) -> Column:
    """The non-empty pieces of text (null: none) between runs of separators."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if its counted rows are within BROADCAST_ROWS; else left to a shuffle join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def hashed(df: DataFrame, rows: int) -> DataFrame:
    """As small(), but what is left to a shuffle join is hashed there, so that the other, wider side is not sorted. Keys must be unique."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("shuffle_hash")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
