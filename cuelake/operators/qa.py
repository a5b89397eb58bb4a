"""Timing, alignment and readability checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.functions import text as T

# Default cue policy, in ms and lines.
MIN_MS, MAX_MS, MAX_LINES = 800, 6000, 2


def _rows(df: DataFrame, keys: list[str], rules: dict[str, tuple[str, Column]]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(sev).alias("severity"), F.lit(kind).alias("kind"))) for kind, (sev, hit) in rules.items()]))
    return df.select(*keys, F.inline(found))


def check_cues(cues: DataFrame, media: DataFrame) -> DataFrame:
    """(media_id, pos, severity, kind) of exchange cues against their media's duration_ms; null texts are blank. Media without cues are an error at no place."""
    by = W.partitionBy("media_id").orderBy("pos")
    same = F.count(F.lit(1)).over(W.partitionBy("media_id", "cue_id"))
    rows = cues.withColumns({"before": F.lag("end_ms", 1, 0).over(by), "same": same}).join(media, "media_id", "left")
    duration, lines = F.col("end_ms") - F.col("start_ms"), F.split("text", r"\r?\n")
    return no_cues(cues, media).unionByName(_rows(rows, ["media_id", "pos"], {
        "cue_id": ("error", (F.col("cue_id") <= 0) | (F.col("same") > 1)),
        "blank": ("error", T.trim_all(F.coalesce("text", F.lit(""))) == ""),
        "overlap": ("error", F.col("start_ms") < F.col("before")),
        "order": ("error", F.col("end_ms") <= F.col("start_ms")),
        "past_end": ("error", F.col("end_ms") > F.col("duration_ms") + 50),
        "short_cue": ("warning", duration < MIN_MS),
        "long_cue": ("warning", duration > MAX_MS),
        "line_count": ("warning", F.size(lines) > MAX_LINES),
        "line_length": ("warning", F.exists(lines, lambda x: F.length(x) > T.char_limit(x, variant="workflow"))),
    }))


def no_cues(cues: DataFrame, media: DataFrame) -> DataFrame:
    """(media_id, pos, severity, kind): an error for every media item that has no cue."""
    none = media.join(cues.select("media_id").distinct(), "media_id", "left_anti")
    return none.select("media_id", F.lit(None).cast(cues.schema["pos"].dataType).alias("pos"), F.lit("error").alias("severity"), F.lit("no_cues").alias("kind"))


def validate_cues(cues: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """(media_id, pos, severity, kind) of build cues (cs): order, overlap, length, repeated text; with media, also items that have no cue."""
    by = W.partitionBy("media_id").orderBy("pos")
    rows = cues.withColumns({"before": F.lag("end_cs").over(by), "said": F.lag(T.comparable_text(F.col("text"))).over(by), "nth": F.row_number().over(by)})
    none = no_cues(cues, cues.select("media_id").limit(0) if media is None else media)
    duration, lines, key = F.col("end_cs") - F.col("start_cs"), F.split("text", r"\r?\n"), T.comparable_text(F.col("text"))
    return none.unionByName(_rows(rows, ["media_id", "pos"], {
        "index": ("error", F.col("idx") != F.col("nth")),
        "blank": ("error", T.trim_all(F.coalesce("text", F.lit(""))) == ""),
        "order": ("error", (F.col("start_cs") < 0) | (F.col("end_cs") <= F.col("start_cs"))),
        "overlap": ("error", F.col("start_cs") < F.col("before")),
        "short_cue": ("warning", duration * 10 < MIN_MS),
        "long_cue": ("warning", duration * 10 > MAX_MS),
        "line_count": ("warning", F.size(lines) > MAX_LINES),
        "line_length": ("warning", F.exists(lines, lambda x: F.length(x) > T.char_limit(x))),
        "repeated": ("warning", (key != "") & (key == F.col("said"))),
    }))


def check_alignment(source: DataFrame, target: DataFrame) -> DataFrame:
    """(media_id, misaligned): places where id or timing differ or one side has no cue."""
    side = lambda df, p: df.select("media_id", "pos", F.struct("cue_id", "start_ms", "end_ms").alias(p))
    both = side(source, "s").join(side(target, "t"), ["media_id", "pos"], "full")
    return both.groupBy("media_id").agg(F.count_if(~F.col("s").eqNullSafe(F.col("t"))).alias("misaligned"))


def qa_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("media_id", "severity", "kind").agg(F.count(F.lit(1)).alias("n"))


def short_cue_issues(cues: DataFrame) -> DataFrame:
    return cues.where(F.col("end_ms") - F.col("start_ms") < 800).select("media_id", "cue_id", F.lit("readability").alias("kind"))


def neighbours(batches: DataFrame, n: int = 2) -> DataFrame:
    """(media_id, batch_id, pos) of up to n cues on either side of each batch, which is a stretch of an item's cues (media_id, pos, batch_id)."""
    rows = batches.select("media_id", "pos", "batch_id", F.row_number().over(W.partitionBy("media_id").orderBy("pos")).alias("at"))
    spans = rows.groupBy("media_id", "batch_id").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    near = F.concat(*[F.array(F.col("lo") - k, F.col("hi") + k) for k in range(1, n + 1)])
    return spans.select("media_id", "batch_id", F.explode(near).alias("at")).join(rows.select("media_id", "at", "pos"), ["media_id", "at"]).select("media_id", "batch_id", "pos")


def validate_source(cues: DataFrame, max_chars: int = 8000) -> DataFrame:
    """(media_id, pos, severity, kind): what makes a track unfit for review. A track without cues is no row here; see no_cues."""
    same = F.count(F.lit(1)).over(W.partitionBy("media_id", "cue_id"))
    text = F.coalesce("text", F.lit(""))
    return _rows(cues.withColumn("same", same), ["media_id", "pos"], {
        "cue_id": ("error", F.coalesce(F.col("cue_id") <= 0, F.lit(True)) | (F.col("same") > 1)), "blank": ("error", T.trim_all(text) == ""),
        "order": ("error", (F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms"))), "too_long": ("error", F.length(text) > max_chars),
    })
