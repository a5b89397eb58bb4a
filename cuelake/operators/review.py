"""Review protocol, multilingual cues, project state and video comparison as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.operators import scan

# Limits of a request, and the kinds of issue that later edits do not settle.
BATCH_CUES, BATCH_CHARS = 24, 8000
STANDING = ("uncertain_transcript", "unsafe_edit")


def batch_cues(cues: DataFrame, max_cues: int = BATCH_CUES, max_chars: int = BATCH_CHARS) -> DataFrame:
    """(media_id, pos, batch_id): cues in order of pos, a new batch where the next cue would pass either limit. A cue over the limit is a batch alone; null texts count nothing."""
    rows = cues.select("media_id", F.col("pos").cast("long").alias("pos"), F.coalesce(F.length("text"), F.lit(0)).alias("size"), F.lit(False).alias("forced"))
    rows = scan.along(rows, ["media_id"], ["pos"], F.floor(F.col("pos") / scan.BLOCK), nth="nth")
    cut = scan.cut(rows, ["media_id"], most=max_cues, room=max_chars)
    return rows.join(cut, ["media_id", "nth"]).select("media_id", "pos", F.col("piece").cast("int").alias("batch_id"))


def apply_responses(source: DataFrame, responses: DataFrame) -> DataFrame:
    """Source cues with the text of the response of the same cue_id; order, ids and timing stay the source's."""
    new = responses.select("media_id", "cue_id", F.col("text").alias("new_text"))
    return source.join(new, ["media_id", "cue_id"]).withColumn("text", F.col("new_text")).drop("new_text")


def carry_issues(issues: DataFrame, draft: DataFrame, final: DataFrame) -> DataFrame:
    """Issues on a draft that still stand for the final text."""
    side = lambda df, name: df.select("media_id", "cue_id", F.col("text").alias(name))
    both = issues.join(side(draft, "was"), ["media_id", "cue_id"], "left").join(side(final, "now"), ["media_id", "cue_id"], "left")
    same = (F.col("kind") != "number_mismatch") & F.coalesce(F.col("was") == F.col("now"), F.lit(False))
    return both.where(F.col("kind").isin(*STANDING) | same).select(*issues.columns)


def dedup_issues(issues: DataFrame) -> DataFrame:
    return issues.dropDuplicates(["media_id", "cue_id", "kind", "message"])


def changed_cues(source: DataFrame, final: DataFrame) -> DataFrame:
    """(media_id, n_cues, n_changed) by position."""
    both = source.select("media_id", "pos", F.col("text").alias("a")).join(final.select("media_id", "pos", F.col("text").alias("b")), ["media_id", "pos"])
    return both.groupBy("media_id").agg(F.count(F.lit(1)).alias("n_cues"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_changed"))


def order_lines(lines: Column, order: list[str]) -> Column:
    """Lines, structs (label, line), as text: the first of each label of order in that order, then the rest as they came."""
    wanted = F.array(*[F.lit(x) for x in order]).cast("array<string>")
    labels = F.transform(lines, lambda x: x["label"])

    def ranked(x: Column, i: Column) -> Column:
        at = F.array_position(wanted, x["label"])
        first = F.array_position(labels, x["label"]) == i + 1
        return F.struct(F.when(first & (at > 0), at).otherwise(len(order) + 1).alias("rank"), i.alias("i"), x["line"].alias("line"))

    return F.array_join(F.transform(F.array_sort(F.transform(lines, ranked)), lambda x: x["line"]), "\n")


def compose_multilingual(source: DataFrame, translations: DataFrame, targets: list[str], order: list[str] | None = None, with_source: bool = True) -> DataFrame:
    """Source cues whose text is the source line (with_source) and one line per target, in the asked order."""
    rank = F.array_position(F.array(*[F.lit(t) for t in targets]), F.col("target"))
    told = translations.where(F.col("target").isin(targets)).groupBy("media_id", "pos").agg(F.sort_array(F.collect_list(F.struct(rank.alias("at"), F.col("target").alias("label"), F.col("text").alias("line")))).alias("told"))
    told = told.withColumn("told", F.transform("told", lambda x: F.struct(x["label"].alias("label"), x["line"].alias("line"))))
    own = F.array(F.struct(F.lit("source").alias("label"), F.col("text").alias("line"))) if with_source else F.array().cast("array<struct<label:string,line:string>>")
    both = source.join(told, ["media_id", "pos"], "left")
    lines = F.concat(own, F.coalesce("told", F.array().cast("array<struct<label:string,line:string>>")))
    return both.withColumn("text", order_lines(lines, order or [])).drop("told")


def next_revision(revisions: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """(project, kind, name): the lowest number from 1 that no revision of the kind has; kinds (project, kind) adds those that may have none yet."""
    by = W.partitionBy("project", "kind").orderBy("n")
    ranked = revisions.select("project", "kind", "n").distinct().where("n >= 1").withColumn("i", F.row_number().over(by))
    free = ranked.groupBy("project", "kind").agg((F.count_if(F.col("n") == F.col("i")) + 1).alias("n"))  # n = i holds for an unbroken start only
    known = revisions.select("project", "kind") if kinds is None else revisions.select("project", "kind").unionByName(kinds.select("project", "kind"))
    free = known.distinct().join(free, ["project", "kind"], "left")
    return free.select("project", "kind", F.format_string("%s-%04d", "kind", F.coalesce("n", F.lit(1).cast("long"))).alias("name"))


def workflow_status(projects: DataFrame) -> DataFrame:
    """(project, state) from a project's recorded hashes and fingerprints; a null hash is a file that does not exist."""
    c = F.col
    translated = c("target_language").isNotNull()
    accepted = F.coalesce(c("accepted_fingerprint") == c("fingerprint"), F.lit(False))
    rendered = F.coalesce((c("render_fingerprint") == c("fingerprint")) & (c("render_sha") == c("output_sha")), F.lit(False))
    state = F.when(c("raw_sha").isNull() & c("source_sha").isNull(), "transcription_pending").when(c("source_sha").isNull(), "source_review_pending")
    state = state.when(translated & c("target_sha").isNull(), "translation_pending").when(translated & ~c("target_input_sha").eqNullSafe(c("source_sha")), "translation_stale")
    return projects.select("project", state.when(accepted & rendered, "rendered").when(accepted, "accepted").otherwise("review_required").alias("state"))


def compare_video(source: DataFrame, output: DataFrame) -> DataFrame:
    """(media_id, same_size, one_stream, same_duration, same_frames); same_frames is null where a count is unknown."""
    fields = ("width", "height", "duration_s", "fps", "frame_count", "video_stream_count")
    side = lambda df, p: df.select("media_id", F.struct(*fields).alias(p))
    both = side(source, "s").join(side(output, "o"), "media_id")
    margin = F.greatest(F.coalesce(F.try_divide(F.lit(1.0), F.col("s.fps")), F.lit(0.05)), F.lit(0.05))
    return both.select(
        "media_id", ((F.col("s.width") == F.col("o.width")) & (F.col("s.height") == F.col("o.height"))).alias("same_size"), (F.col("o.video_stream_count") == 1).alias("one_stream"),
        (F.abs(F.col("s.duration_s") - F.col("o.duration_s")) <= margin).alias("same_duration"), (F.col("s.frame_count") == F.col("o.frame_count")).alias("same_frames"),
    )
