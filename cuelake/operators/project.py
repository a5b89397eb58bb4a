"""Projects as tables: what is left to do, whether an acceptance or a render still holds, and what waits for review."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The five parts of a fingerprint; the target's report and the bundle may be null.
FINGERPRINT = ("source", "selected", "source_report", "target_report", "bundle")
# The file of a bundle that is compared by meaning, its largest size, and the states in which a project may be accepted.
DEFINITION, DEFINITION_BYTES = "preset.json", 65_536
ACCEPTABLE = ("review_required", "accepted", "rendered")


def content_sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON without white space, keys in order, so that formatting doesn't count; null for texts that are no JSON or too large for a definition."""

    def plain(t: str | None) -> str | None:
        try:
            return None if t is None or len(t.encode()) > DEFINITION_BYTES else json.dumps(json.loads(t, parse_constant=_refuse), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return text.map(plain)


def bundle_sha256(files: DataFrame) -> DataFrame:
    """(bundle, sha256) of the files (bundle, name, content) of folders: name is the path within the bundle.

    A folder's hash is of its entries in order of name: the name, a zero byte, and the hexadecimal hash of a file's content or of a folder; of a DEFINITION the canonical JSON
    itself. Folders are hashed from the deepest up, a grouping for each depth. A bundle with a definition that can't be read has no hash.
    """
    path = F.split("name", "/")
    leaf = F.element_at(path, -1)
    payload = F.when(leaf == DEFINITION, canonical_json(F.col("content").cast("string"))).otherwise(content_sha256(F.col("content")))
    rows = files.select("bundle", path.alias("path"), payload.alias("payload"))
    deepest = rows.agg(F.max(F.size("path"))).first()[0] or 0
    made = None
    for depth in range(deepest, 0, -1):
        here = rows.where(F.size("path") == depth)
        here = here if made is None else here.unionByName(made)
        name = F.element_at("path", -1)
        entry = F.struct(name.alias("name"), F.hex(F.concat(name.cast("binary"), F.lit(b"\x00"), F.col("payload").cast("binary"))).alias("entry"))
        folder = F.slice("path", 1, depth - 1) if depth > 1 else F.array().cast("array<string>")
        whole = F.sha2(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["entry"]), "")), 256)
        made = here.groupBy("bundle", folder.alias("path")).agg(F.when(F.count("payload") == F.count(F.lit(1)), whole).alias("payload"))
    empty = rows.limit(0).select("bundle", F.lit("").alias("sha256"))
    return empty if made is None else made.select("bundle", F.col("payload").alias("sha256"))


def fingerprint(source: Column, target: Column, target_language: Column, source_report: Column, target_report: Column, bundle: Column) -> Column:
    """What an acceptance binds: hashes of the cues shown and of what led to them."""
    translated = target_language.isNotNull()
    values = (source, F.when(translated, target).otherwise(source), source_report, F.when(translated, target_report), bundle)
    return F.struct(*[v.alias(k) for k, v in zip(FINGERPRINT, values, strict=True)])


def acceptance_valid(projects: DataFrame, acceptances: DataFrame) -> DataFrame:
    """(project, accepted) of projects (project, fingerprint) by their latest acceptance (project, at, note, fingerprint); a blank note accepts nothing.

    acceptances may have ``state``, the project's when it was accepted: those given while it was not ready for review never counted.
    """
    ready = acceptances.where(F.col("state").isin(*ACCEPTABLE)) if "state" in acceptances.columns else acceptances
    latest = ready.groupBy("project").agg(F.max_by(F.struct("note", "fingerprint"), "at").alias("a"))
    noted = F.regexp_replace(F.coalesce("a.note", F.lit("")), r"(?U)\s+", "") != ""
    return projects.join(latest, "project", "left").select("project", F.coalesce(F.col("a").isNotNull() & noted & F.col("fingerprint").eqNullSafe(F.col("a.fingerprint")), F.lit(False)).alias("accepted"))


def render_current(projects: DataFrame, renders: DataFrame) -> DataFrame:
    """(project, rendered): does the last render (project, seq, fingerprint, output_sha) show the project's present fingerprint, its file unchanged?"""
    last = renders.groupBy("project").agg(F.max_by(F.struct("fingerprint", "output_sha"), "seq").alias("r"))
    same = F.col("fingerprint").eqNullSafe(F.col("r.fingerprint")) & (F.col("output_now") == F.col("r.output_sha"))
    return projects.join(last, "project", "left").select("project", F.coalesce(F.col("r").isNotNull() & same, F.lit(False)).alias("rendered"))


def plan_resume(projects: DataFrame) -> DataFrame:
    """(project, transcribe, review, translate): stages that a project (raw_sha, source_sha, target_language, target_sha, target_input_sha, force_review, force_translation) still needs."""
    c = F.col
    redo = lambda name: F.coalesce(c(name), F.lit(False))
    review = c("source_sha").isNull() | redo("force_review")
    stale = c("target_sha").isNull() | ~c("target_input_sha").eqNullSafe(c("source_sha"))
    return projects.select("project", c("raw_sha").isNull().alias("transcribe"), review.alias("review"), (c("target_language").isNotNull() & (redo("force_translation") | stale)).alias("translate"))


def manual_edits(revisions: DataFrame) -> DataFrame:
    """(project, stage, edited): has a revision's file changed since it was generated?"""
    return revisions.select("project", "stage", (~F.col("generated_sha").eqNullSafe(F.col("current_sha"))).alias("edited"))


def tamper_check(recorded: DataFrame, present: DataFrame) -> DataFrame:
    """(project, path, fault) of recorded files (project, path, sha256) that are missing or changed among the present ones (path, sha256)."""
    both = recorded.join(present.select("path", F.col("sha256").alias("now")), "path", "left")
    return both.where(~F.col("sha256").eqNullSafe(F.col("now"))).select("project", "path", F.when(F.col("now").isNull(), "missing").otherwise("changed").alias("fault"))


def all_issues(stages: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Issues (project, kind, message) of the stages, then of source and target cues, with ``part`` to keep that order."""
    return stages.withColumn("part", F.lit(0)).unionByName(source.withColumn("part", F.lit(1))).unionByName(target.withColumn("part", F.lit(2)))


def review_queue(states: DataFrame, issues: DataFrame, acceptances: DataFrame) -> DataFrame:
    """(project, state, issues, note, next_action): what a reviewer needs of each project; issues (project, part, seq, kind, message) in order."""
    found = issues.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "kind", "message"))), lambda x: F.concat_ws(": ", x["kind"], x["message"])).alias("issues"))
    noted = acceptances.groupBy("project").agg(F.max_by("note", "at").alias("note"))
    done = {"review_required": "accept", "accepted": "render", "rendered": "none"}
    action = F.coalesce(F.create_map(*[F.lit(x) for kv in done.items() for x in kv])[F.col("state")], F.lit("resume"))
    rows = states.join(found, "project", "left").join(noted, "project", "left")
    return rows.select("project", "state", F.coalesce("issues", F.array().cast("array<string>")).alias("issues"), "note", action.alias("next_action"))


def render_queue(queue: DataFrame) -> DataFrame:
    """(project, content): what review_queue() says of each project as JSON."""
    return queue.select("project", F.to_json(F.struct("state", "next_action", "issues", "note"), {"ignoreNullFields": "false"}).alias("content"))


def write_queue(queue: DataFrame, path: str) -> None:
    """A folder per project with its part of the queue as one text file; an existing path is left alone and is an error."""
    render_queue(queue).write.partitionBy("project").text(path)


def verification_report(video: DataFrame, audio: DataFrame, packets: DataFrame) -> DataFrame:
    """(media_id, passed, streams): all verdicts of an item in one row, with the packet counts of each stream.

    audio: (media_id, n_streams, same_count, same_streams). What was not looked at is not verified: an item passes only with an audio verdict and packets of each of its n_streams streams.
    Unknown frame counts alone fail nothing.
    """
    good = F.col("n_source").eqNullSafe(F.col("n_output")) & F.col("first_bad").isNull()
    streams = packets.groupBy("media_id").agg(F.bool_and(good).alias("packets_ok"), F.count_distinct("stream").alias("seen"), F.array_sort(F.collect_list(F.struct("stream", "n_source", "n_output"))).alias("streams"))
    rows = video.join(audio, "media_id", "left").join(streams, "media_id", "left")
    ok = F.col("same_size") & F.col("one_stream") & F.col("same_duration") & F.coalesce("same_frames", F.lit(True)) & F.col("same_count") & F.col("same_streams")
    ok &= (F.col("n_streams") == F.coalesce("seen", F.lit(0))) & F.coalesce("packets_ok", F.lit(True))  # no packets are right where there are no streams
    return rows.select("media_id", F.coalesce(ok, F.lit(False)).alias("passed"), "streams")
