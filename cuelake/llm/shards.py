"""Contiguous shards of nearly equal bytes from prefix sums of partition totals.

Documents in id order are cut where the running sum of sizes crosses equal targets. Rows are dealt to range partitions of about BLOCK rows (more,
beyond MOST_PARTITIONS): the partitions' totals are summed first (one row each), prefix sums of these give every partition its start, and each is then
summed on its own. No task sees more than one partition, and no text is shuffled.

A size is the UTF-8 bytes of the text (null: none) plus 1. Ids may be of any type that can be ordered. Ties of id are ordered by checksum and size, and a
long run of equal or null ids is split between partitions by these; rows of null id come first. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import Work

BLOCK, MOST_PARTITIONS = 8192, 20_000


def shard(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, size, text_crc32, shard, slot) per row: shard by the middle of its bytes, slot by its place in the shard."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    work, parts = Work(docs.sparkSession, "shards"), min(max(1, -(-docs.count() // block)), MOST_PARTITIONS)
    dealt = rows.repartitionByRange(parts, F.col(id_col).asc_nulls_first(), F.col("text_crc32"), F.col("size"))
    rows = work.cut(dealt.withColumn("range", F.spark_partition_id()))
    totals = rows.groupBy("range").agg(F.sum("size").alias("bytes"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("range", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("before"), F.sum("bytes").over(Window.partitionBy(F.lit(0))).alias("total"))
    starts = starts.withColumnRenamed("range", "r")
    order = Window.partitionBy("range").orderBy(F.col(id_col).asc_nulls_first(), "text_crc32", "size")
    placed = rows.withColumns({"upto": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(order)})
    placed = placed.join(starts, F.col("range") == F.col("r"))
    middle = 2 * (F.col("before") + F.col("upto")) - F.col("size")
    placed = placed.withColumn("shard", F.least(F.floor(middle * shards / (2 * F.col("total"))), F.lit(shards - 1)).cast("int"))
    # A range has a run of each shard; a run's first slot follows the shard's rows in earlier ranges.
    runs = placed.groupBy("range", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("range").alias("run"), F.col("shard").alias("s"), "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("slots"))
    out = placed.join(runs, (F.col("range") == F.col("run")) & (F.col("shard") == F.col("s")))
    return out.select(id_col, "size", "text_crc32", "shard", (F.col("slots") + F.col("nth") - F.col("first")).cast("long").alias("slot"))
