"""The review protocol in batches: requests, checks of responses, guards of edits, rounds, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.functions import numbers
from cuelake.functions import text as T
from cuelake.operators import qa, review, scan

# Kinds of issue, limits of texts, utterances and attempts.
KINDS = ("uncertain_transcript", "meaning_alignment", "number_mismatch", "name_consistency", "readability", "unsafe_edit", "other")
MAX_CHARS, UTTERANCE_CUES, UTTERANCE_CHARS, PAUSE_MS, CONTEXT_CHARS, ATTEMPTS = 8000, 32, 8000, 1500, 32_000, 2
#: The types of an answer's items; a value of another type, a field too many or one too few is a fault.
CUE, ISSUE = "OBJECT<cue_id: BIGINT, text: STRING>", "OBJECT<cue_id: BIGINT, kind: STRING, message: STRING>"


def utterances(cues: DataFrame) -> DataFrame:
    """(media_id, pos, utterance): cues joined into sentences; a pause or a limit ends one before a cue, a full stop after it."""
    text = F.coalesce("text", F.lit(""))
    stop = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+$", ""), "[\"'”’)\\]]+$", "").rlike("[.!?。！？]$")
    rows = cues.select("media_id", "pos", "start_ms", "end_ms", (F.length(text) + 1).alias("size"), stop.alias("stop"))
    rows = scan.along(rows, ["media_id"], ["pos"], F.floor(F.col("pos") / scan.BLOCK), nth="nth", before={"prior": ["end_ms", "stop"]})
    rows = rows.withColumn("forced", F.coalesce((F.col("start_ms") - F.col("prior.end_ms") > PAUSE_MS) | F.col("prior.stop"), F.lit(False)))
    cut = scan.cut(rows, ["media_id"], most=UTTERANCE_CUES, room=UTTERANCE_CHARS)
    return rows.join(cut, ["media_id", "nth"]).select("media_id", "pos", F.col("piece").alias("utterance"))


def utterance_context(batches: DataFrame, cues: DataFrame, draft: DataFrame | None = None, spoken: DataFrame | None = None) -> DataFrame:
    """(media_id, batch_id, utterance, context_only, cue_ids, text, draft_text): utterances that a batch touches, and one on either side while all stay within CONTEXT_CHARS.

    draft_text is null without a draft (media_id, pos, text). Cues without text count one character. spoken: what utterances() gives, if it is at hand.
    """
    texts = cues.select("media_id", "pos", "cue_id", F.coalesce("text", F.lit("")).alias("text"))
    drafted = texts.withColumn("draft", F.lit(None).cast("string")) if draft is None else texts.join(draft.select("media_id", "pos", F.col("text").alias("draft")), ["media_id", "pos"], "left")
    said = (utterances(cues) if spoken is None else spoken).join(drafted, ["media_id", "pos"])
    item = F.struct("pos", "cue_id", "text", "draft")
    whole = said.groupBy("media_id", "utterance").agg(F.array_sort(F.collect_list(item)).alias("c"), F.sum(F.length("text") + 1).alias("chars"))
    joined = lambda name: T.trim_all(F.regexp_replace(F.array_join(F.transform("c", lambda x: x[name]), " "), r"(?U)\s+", " "))
    told = F.lit(None).cast("string") if draft is None else joined("draft")
    whole = whole.select("media_id", "utterance", "chars", F.transform("c", lambda x: x["cue_id"]).alias("cue_ids"), joined("text").alias("text"), told.alias("draft_text"))
    spans = batches.join(said.select("media_id", "pos", "utterance"), ["media_id", "pos"]).groupBy("media_id", "batch_id").agg(F.min("utterance").alias("lo"), F.max("utterance").alias("hi"))
    asked = spans.select("media_id", "batch_id", "lo", "hi", F.explode(F.sequence(F.col("lo") - 1, F.col("hi") + 1)).alias("utterance")).join(whole, ["media_id", "utterance"])
    own = F.sum(F.when(F.col("utterance").between(F.col("lo"), F.col("hi")), F.col("chars")).otherwise(0)).over(W.partitionBy("media_id", "batch_id"))
    before = F.coalesce(F.sum(F.when(F.col("utterance") < F.col("lo"), F.col("chars"))).over(W.partitionBy("media_id", "batch_id")), F.lit(0))
    asked = asked.withColumns({"own": own, "before": before})
    takes_before = F.col("own") + F.col("before") <= CONTEXT_CHARS
    used = F.col("own") + F.when(takes_before, F.col("before")).otherwise(0)
    fits = F.when(F.col("utterance") < F.col("lo"), takes_before).when(F.col("utterance") > F.col("hi"), used + F.col("chars") <= CONTEXT_CHARS).otherwise(True)
    return asked.where(fits).select("media_id", "batch_id", "utterance", (~F.col("utterance").between(F.col("lo"), F.col("hi"))).alias("context_only"), "cue_ids", "text", "draft_text")


def build_requests(batches: DataFrame, source: DataFrame, draft: DataFrame | None, issues: DataFrame, *, stage: str, task: str, target: str | None = None, context: DataFrame | None = None, spoken: DataFrame | None = None, n: int = 2) -> DataFrame:
    """(media_id, batch_id, request): a JSON text per batch with its cues, the n cues on either side, the utterances that they are part of, and what is known to be wrong with its cues.

    context: (media_id, context), an item's glossary or summary; spoken: its utterances(), if at hand. batches may have ``attempt``: from the second on, the request says that it is asked again.
    """
    drafted = source.select("media_id", "pos", F.lit(None).cast("string").alias("draft")) if draft is None else draft.select("media_id", "pos", F.col("text").alias("draft"))
    both = source.join(drafted, ["media_id", "pos"], "left")
    cue = F.struct("pos", F.struct("cue_id", "start_ms", "end_ms", F.col("text").alias("source"), "draft").alias("cue"))
    key = ["media_id", "batch_id"]
    listed = lambda df, name: df.join(both, ["media_id", "pos"]).groupBy(*key).agg(F.array_sort(F.collect_list(cue)).alias(name))
    known = issues.join(source.select("media_id", "pos", "cue_id"), ["media_id", "cue_id"]).join(batches, ["media_id", "pos"])
    known = known.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("cue_id", "kind", "message"))).alias("issues"))
    said = utterance_context(batches.select("media_id", "pos", "batch_id"), source, draft, spoken)
    said = said.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("utterance", "cue_ids", "text", "draft_text", "context_only"))).alias("said"))
    again = batches.groupBy(*key).agg((F.max("attempt") > 1 if "attempt" in batches.columns else F.lit(False)).alias("retry"))
    rows = listed(batches, "cues").join(listed(qa.neighbours(batches.select("media_id", "pos", "batch_id"), n), "around"), key, "left").join(known, key, "left").join(said, key, "left").join(again, key)
    rows = rows.withColumn("context", F.lit(None).cast("string")) if context is None else rows.join(context.select("media_id", "context"), "media_id", "left")
    full = lambda name: F.coalesce(name, F.array().cast(rows.schema[name].dataType))
    plain = lambda name: F.transform(full(name), lambda x: x["cue"])
    spoken = F.transform(full("said"), lambda x: F.struct(x["cue_ids"].alias("cue_ids"), x["text"].alias("source"), x["draft_text"].alias("draft"), x["context_only"].alias("context_only")))
    body = F.struct(
        F.lit(stage).alias("stage"), F.lit(task).alias("task"), F.lit(target).cast("string").alias("target"), "context", "retry", plain("cues").alias("cues"), plain("around").alias("neighbours"), spoken.alias("utterances"), full("issues").alias("issues"),
    )
    return rows.select(*key, F.to_json(body, {"ignoreNullFields": "false"}).alias("request"))


def validate_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(media_id, batch_id, cues, issues, fault) per response: requests hold (media_id, batch_id, cue_ids), responses their JSON in ``response``.

    fault is null for a response that is one JSON document of the right fields and types and gives every requested cue once, with text that can be shown, and issues of
    known kinds on these cues; else it names the first rule broken, and cues and issues are null.
    """
    rows = requests.join(responses, ["media_id", "batch_id"]).withColumn("doc", T.one_document(F.col("response")))
    items = lambda name: F.try_variant_get("doc", f"$.{name}", "array<variant>")
    typed = lambda name, kind: F.forall(name, lambda x: F.schema_of_variant(x) == kind)
    rows = rows.withColumns({"c": items("cues"), "i": items("issues"), "top": F.array_sort(F.map_keys(F.try_variant_get("doc", "$", "map<string,variant>")))})
    known = (F.col("top") == F.array(F.lit("cues"), F.lit("issues"))) & typed("c", CUE) & typed("i", ISSUE)
    rows = rows.withColumn("known", F.coalesce(known, F.lit(False)))
    part = lambda x, name, kind: F.try_variant_get(x, f"$.{name}", kind).alias(name)
    text = lambda c: F.replace(T.trim_all(F.try_variant_get(c, "$.text", "string")), F.lit("\r\n"), F.lit("\n"))
    rows = rows.withColumns({
        "cues": F.when(F.col("known"), F.transform("c", lambda c: F.struct(part(c, "cue_id", "bigint"), text(c).alias("text")))),
        "issues": F.when(F.col("known"), F.transform("i", lambda i: F.struct(part(i, "cue_id", "bigint"), part(i, "kind", "string"), part(i, "message", "string")))),
    })
    shown = lambda c: (c["text"] != "") & (F.length(c["text"]) <= MAX_CHARS) & ~c["text"].contains("\r") & ~c["text"].rlike(r"(?U)\n[^\S\n]*\n")
    sound = lambda i: F.array_contains("cue_ids", i["cue_id"]) & i["kind"].isin(*KINDS) & (T.trim_all(i["message"]) != "")
    rules = {
        "json": F.col("doc").isNotNull(), "fields": F.col("known"), "count": F.size("cues") == F.size("cue_ids"), "ids": F.size(F.array_except("cue_ids", F.transform("cues", lambda c: c["cue_id"]))) == 0,
        "text": F.forall("cues", shown), "issues": F.forall("issues", sound),
    }
    fault = F.lit(None).cast("string")
    for name, holds in reversed(rules.items()):
        fault = F.when(F.coalesce(holds, F.lit(False)), fault).otherwise(name)
    rows = rows.withColumn("fault", fault)
    good = lambda name: F.when(F.col("fault").isNull(), F.col(name)).alias(name)
    return rows.select("media_id", "batch_id", good("cues"), good("issues"), "fault")


def next_round(batches: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batches, errors) after a round. failed: (media_id, batch_id, attempt) of batches without a valid response.

    A batch is asked ATTEMPTS times, then halved; one cue that still fails is an error. Batches (media_id, pos, batch_id, attempt) keep text ids: a half adds .0 or .1.
    """
    rows = batches.join(failed, ["media_id", "batch_id"]).withColumns({"n": F.count(F.lit(1)).over(W.partitionBy("media_id", "batch_id")), "nth": F.row_number().over(W.partitionBy("media_id", "batch_id").orderBy("pos"))})
    spent = F.col("attempt") >= ATTEMPTS
    half = F.concat(F.col("batch_id").cast("string"), F.when(F.col("nth") <= F.floor(F.col("n") / 2), ".0").otherwise(".1"))
    again = rows.where(~(spent & (F.col("n") == 1))).select("media_id", "pos", F.when(spent, half).otherwise(F.col("batch_id").cast("string")).alias("batch_id"), F.when(spent, 1).otherwise(F.col("attempt") + 1).alias("attempt"))
    return again, rows.where(spent & (F.col("n") == 1)).select("media_id", "pos")


def _pairs(source: DataFrame, draft: DataFrame) -> DataFrame:
    both = source.select("media_id", "cue_id", F.col("text").alias("was")).join(draft.select("media_id", "cue_id", F.col("text").alias("now")), ["media_id", "cue_id"])
    return both.withColumns({"q_was": numbers.quantities("was"), "q_now": numbers.quantities("now")})


def judge_edits(source: DataFrame, draft: DataFrame) -> DataFrame:
    """draft with the source's text where the edit is ``unsafe``: it adds lines, rewrites the cue or changes a number. Each edit is judged once."""
    was = source.select("media_id", "cue_id", F.col("text").alias("was"), F.lit(True).alias("known"))
    both = draft.withColumn("now", F.col("text")).join(was, ["media_id", "cue_id"], "left")
    both = both.withColumns({"q_was": numbers.quantities("was"), "q_now": numbers.quantities("now")})
    lines = lambda c: F.size(F.split(c, "\n"))
    unsafe = (lines("now") > lines("was")) | T.is_wholesale_rewrite(F.col("was"), F.col("now")) | numbers.numbers_differ(F.col("q_was"), F.col("q_now"))
    judged = both.withColumn("unsafe", F.coalesce(F.col("known") & unsafe, F.lit(False)))
    return judged.withColumn("text", F.when(F.col("unsafe"), F.col("was")).otherwise(F.col("text"))).select(*draft.columns, "unsafe")


def unsafe_edits(judged: DataFrame) -> DataFrame:
    return judged.where("unsafe").select("media_id", "cue_id", F.lit("unsafe_edit").alias("kind"), F.lit("the edit was taken back").alias("message"))


def guard_edits(source: DataFrame, draft: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(draft, issues): transcription edits that add lines, rewrite a cue or change a number are taken back and reported."""
    judged = judge_edits(source, draft)
    return judged.select(*draft.columns), unsafe_edits(judged)


def number_issues(source: DataFrame, draft: DataFrame) -> DataFrame:
    """(media_id, cue_id, kind, message) of cues whose numbers differ from the source's."""
    differ = _pairs(source, draft).where(numbers.numbers_differ(F.col("q_was"), F.col("q_now")))
    return differ.select("media_id", "cue_id", F.lit("number_mismatch").alias("kind"), F.lit("numbers differ from the source").alias("message"))


Ask = Callable[[DataFrame, DataFrame | None, DataFrame], tuple[DataFrame, DataFrame]]
#: Writes a table under a name and gives it read again.
Keep = Callable[[str, DataFrame], DataFrame]


def no_issues(cues: DataFrame) -> DataFrame:
    """An empty table of issues, typed as those of cues."""
    return cues.limit(0).select("media_id", "cue_id", F.lit("").alias("kind"), F.lit("").alias("message"))


def review_tracks(source: DataFrame, ask: Ask, *, edits: bool, keep: Keep = lambda name, df: df) -> tuple[DataFrame, DataFrame]:
    """(final, issues) of two passes. ask(source, draft, known) gives the model's texts (media_id, cue_id, text) and issues (media_id, cue_id, kind, message).

    In the first pass there is no draft and nothing known; the second sees the draft and all issues of the first. What ask gives should be written tables, as models
    are not deterministic. edits: the task corrects a transcript, so that unsafe edits are taken back; translations are only checked for their numbers.
    keep: each pass reads the track and the issues of the one before many times, so large ones should be written; the default leaves them to be computed each time.
    """
    columns = ("media_id", "cue_id", "kind", "message")
    message = F.lit("shown for less than 800 ms").alias("message")

    def guarded(name: str, texts: DataFrame, found: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
        track, found = review.apply_responses(base, texts), found.select(*columns)
        if not edits:
            return keep(name, track), found
        judged = keep(name, judge_edits(source, track))
        return judged.select(*track.columns), found.unionByName(unsafe_edits(judged))

    draft, found = guarded("drafted", *ask(source, None, no_issues(source)), source)
    found = keep("found", found.unionByName(number_issues(source, draft)))
    final, issues = guarded("verified", *ask(source, draft, found), draft)
    issues = issues.unionByName(review.carry_issues(found, draft, final)).unionByName(number_issues(source, final))
    issues = issues.unionByName(qa.short_cue_issues(final).select("media_id", "cue_id", "kind", message))
    return final, review.dedup_issues(issues)


def clean_cues(cues: DataFrame, ask: Ask, language: Column, keep: Keep = lambda name, df: df) -> tuple[DataFrame, DataFrame]:
    """(cues, issues): cues timed in hundredths of a second with reviewed texts, all else as it was; ask also gets the ``context`` that names the language."""
    context = F.concat(F.lit("Transcript language: "), language)
    source = cues.select("media_id", "pos", "cue_id", (F.col("start_cs") * 10).alias("start_ms"), (F.col("end_cs") * 10).alias("end_ms"), "text", context.alias("context"))
    final, issues = review_tracks(source, ask, edits=True, keep=keep)
    return cues.drop("text").join(final.select("media_id", "pos", "text"), ["media_id", "pos"]).select(*cues.columns), issues


def translation_report(reports: DataFrame) -> DataFrame:
    """(media_id, targets, issues): the reports (media_id, target, n_changed, n_issues) of an item in order of target, and all their issues."""
    report = F.struct("target", "n_changed", "n_issues")
    return reports.groupBy("media_id").agg(F.array_sort(F.collect_list(report)).alias("targets"), F.sum("n_issues").alias("issues"))
