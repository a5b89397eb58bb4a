"""SRT files as tables of cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.functions import text as T


def render_srt(cues: DataFrame) -> DataFrame:
    """(media_id, content) from (media_id, pos, cue_id, start_ms, end_ms, text), cues in order of pos."""
    block = F.concat(F.col("cue_id").cast("string"), F.lit("\n"), T.format_timestamp(F.col("start_ms")), F.lit(" --> "), T.format_timestamp(F.col("end_ms")), F.lit("\n"), T.normalize_cue_text(F.col("text")), F.lit("\n\n"))
    blocks = cues.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("block")))).alias("b"))
    return blocks.select("media_id", F.array_join(F.transform("b", lambda x: x["block"]), "").alias("content"))


def _blocks(content: Column) -> Column:
    """Blocks between runs of blank lines, byte-order marks and carriage returns removed."""
    plain = F.regexp_replace(F.regexp_replace(content, "^\ufeff+", ""), r"\r\n?", "\n")
    return F.filter(F.split(plain, r"(?U)\n(?:[^\S\n]*\n)+"), lambda b: T.trim_all(b) != "")


def parse_srt(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues, rejects) of (media_id, content). One bad block rejects its whole file."""
    rows = files.select("media_id", F.posexplode(_blocks(F.col("content"))).alias("pos", "block"))
    lines = F.split(F.regexp_replace("block", r"^\n+", ""), "\n")
    timing = F.split(F.get(lines, 1), "-->", 2)
    rows = rows.select(
        "media_id", "pos", T.trim_all(F.get(lines, 0)).alias("index"), T.parse_timestamp(F.get(timing, 0)).alias("start_ms"), T.parse_timestamp(F.get(timing, 1)).alias("end_ms"),
        T.trim_all(F.array_join(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")).alias("text"),
    )
    cue_id = F.when(F.col("index").rlike(r"^\+?\d+$"), F.col("index").try_cast("long"))
    bad = cue_id.isNull() | F.col("start_ms").isNull() | F.col("end_ms").isNull() | (F.col("end_ms") < F.col("start_ms")) | (F.coalesce("text", F.lit("")) == "")
    rows = rows.withColumns({"cue_id": cue_id, "bad": F.max(bad).over(W.partitionBy("media_id"))})
    cues = rows.where(~F.col("bad")).select("media_id", "pos", "cue_id", "start_ms", "end_ms", "text")
    return cues, rows.where("bad").select("media_id").distinct()


def read_srt(spark, path: str) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("media_id"), F.col("value").alias("content"))
    return parse_srt(files)


def write_srt(cues: DataFrame, path: str) -> None:
    """A folder per media item with its track as one text file; an existing path is left alone and is an error."""
    render_srt(cues).write.partitionBy("media_id").text(path)
