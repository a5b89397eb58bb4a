"""Review by a model as a durable loop: what was asked, answered and settled in each round is a written table, and a run that was killed goes on where it stopped.

A pass asks its batches; batches without a sound answer are asked again, then halved, until single cues either succeed or are errors. Every round writes its
requests, its answers (in waves, each a table of its own) and what came of them. A table that is complete is never made again, so after a crash only the wave
that was under way is asked anew. Batches, at most BATCH_CUES cues, can be halved only so often: the number of rounds is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.operators import protocol, review

#: Requests of a wave.
WAVE = 2000
MOST_ROUNDS = protocol.ATTEMPTS * (review.BATCH_CUES.bit_length() + 1)

Model = Callable[[list[str]], list[str]]


class Store:
    """Tables that are written once, in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of that name; only if it is not complete, it is made (again) from make()."""
        path = f"{self.root}/{name}"
        if not self.holds(name):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        return self.once(name, lambda: df)

    def holds(self, name: str) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)


class Passed(NamedTuple):
    """texts (media_id, cue_id, text) and issues (media_id, cue_id, kind, message) of items without errors; errors (media_id, cue_id); requests (media_id, n)."""

    texts: DataFrame
    issues: DataFrame
    errors: DataFrame
    requests: DataFrame


def ask_model(requests: DataFrame, model: Model, prompt: Callable[[Column], Column] | None = None) -> DataFrame:
    """(media_id, batch_id, response): model takes the texts of some requests and gives as many answers. An exception of its own fails the task and is no answer."""
    text = F.col("request") if prompt is None else prompt(F.col("request"))
    rows = requests.select("media_id", "batch_id", text.alias("request"))

    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            yield some[["media_id", "batch_id"]].assign(response=model(some["request"].tolist()))

    types = dict(rows.dtypes)
    return rows.mapInPandas(answered, f"media_id {types['media_id']}, batch_id {types['batch_id']}, response string")


def one_pass(store: Store, name: str, source: DataFrame, draft: DataFrame | None, known: DataFrame, ask: Callable[[DataFrame], DataFrame], *, task: str, target: str | None = None, context: DataFrame | None = None, wave: int = WAVE) -> Passed:
    """One pass over all cues. ask gives (media_id, batch_id, response) of requests (media_id, batch_id, request)."""
    stage = "generate" if draft is None else "verify"
    key = ["media_id", "batch_id"]
    open_ = store.once(f"{name}/batches-0", lambda: review.batch_cues(source).select("media_id", "pos", F.col("batch_id").cast("string").alias("batch_id"), F.lit(1).alias("attempt")))
    spoken = store.once(f"{name}/utterances", lambda: protocol.utterances(source))
    texts, issues, errors, asked = [], [], [], []
    for n in range(MOST_ROUNDS + 1):
        if open_.isEmpty():
            break
        here = f"{name}/round-{n}"
        requests = store.once(f"{here}/requests", lambda now=open_: protocol.build_requests(now, source, draft, known, stage=stage, task=task, target=target, context=context, spoken=spoken))
        waves = max(1, -(-requests.count() // wave))
        of = F.pmod(F.xxhash64(*key), F.lit(waves))
        answers = [store.once(f"{here}/answers-{k}", lambda k=k, r=requests, w=of: ask(r.where(w == k))) for k in range(waves)]
        responses = answers[0]
        for more in answers[1:]:
            responses = responses.unionByName(more)
        wanted = open_.join(source.select("media_id", "pos", "cue_id"), ["media_id", "pos"]).groupBy(*key).agg(F.collect_set("cue_id").alias("cue_ids"), F.max("attempt").alias("attempt"))
        # A batch that was not answered at all has failed like one whose answer has a fault.
        judged = store.once(f"{here}/judged", lambda w=wanted, r=responses: w.join(protocol.validate_responses(w, r), key, "left").select(*key, "attempt", "cues", "issues", F.coalesce("fault", F.when(F.col("cues").isNull(), "no answer")).alias("fault")))
        again, lost = protocol.next_round(open_.drop("attempt"), judged.where("fault IS NOT NULL").select(*key, "attempt"))
        texts.append(judged.where("fault IS NULL").select("media_id", F.inline("cues")))
        issues.append(judged.where("fault IS NULL").select("media_id", F.inline("issues")))
        errors.append(lost.join(source.select("media_id", "pos", "cue_id"), ["media_id", "pos"]).select("media_id", "cue_id"))
        asked.append(requests.select("media_id"))
        open_ = store.once(f"{name}/batches-{n + 1}", lambda x=again: x)
    else:
        raise RuntimeError(f"batches are left after {MOST_ROUNDS} rounds")

    def together(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
        for part in parts:
            empty = empty.unionByName(part.select(*empty.columns))
        return empty

    none = protocol.no_issues(source).select("media_id", F.col("cue_id").cast("long").alias("cue_id"), "kind", "message")
    failed = store.once(f"{name}/errors", lambda: together(errors, none.select("media_id", "cue_id")))
    whole = failed.select("media_id").distinct()
    sound = lambda df: df.join(whole, "media_id", "left_anti")
    n = together(asked, none.select("media_id")).groupBy("media_id").agg(F.count(F.lit(1)).alias("n"))
    return Passed(sound(together(texts, none.select("media_id", "cue_id", F.col("message").alias("text")))), sound(together(issues, none)), failed, n)


def run_review(store: Store, source: DataFrame, ask: Callable[[DataFrame], DataFrame], *, task: str, target: str | None = None, context: DataFrame | None = None, verify: Callable[[DataFrame], DataFrame] | None = None, wave: int = WAVE) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(final, issues, errors, report) of both passes over source (media_id, pos, cue_id, start_ms, end_ms, text).

    An item with a cue that got no sound answer has errors and nothing else. report: (media_id, generation_passes, verification_passes, changed_cues, n_issues), passes being requests made.
    """
    source = store.once("source", lambda: source)
    passes: list[Passed] = []

    def both(base: DataFrame, draft: DataFrame | None, known: DataFrame) -> tuple[DataFrame, DataFrame]:
        name, who = ("generate", ask) if draft is None else ("verify", verify or ask)
        done = passes[0].errors.select("media_id").distinct() if passes else None
        left = base if done is None else base.join(done, "media_id", "left_anti")
        shown = None if draft is None else store.once("draft", lambda: draft)
        told = store.once(f"{name}-known", lambda: known)
        passes.append(one_pass(store, name, left, shown, told, who, task=task, target=target, context=context, wave=wave))
        return passes[-1].texts, passes[-1].issues

    final, issues = protocol.review_tracks(source, both, edits=task == "transcription", keep=store.keep)
    final, issues = store.once("final", lambda: final), store.once("issues", lambda: issues)
    errors = passes[0].errors.unionByName(passes[1].errors)
    made = lambda p, name: p.requests.withColumnRenamed("n", name)
    found = issues.groupBy("media_id").agg(F.count(F.lit(1)).alias("n_issues"))
    report = review.changed_cues(source, final).join(made(passes[0], "generation_passes"), "media_id").join(made(passes[1], "verification_passes"), "media_id").join(found, "media_id", "left")
    return final, issues, errors, report.select("media_id", "generation_passes", "verification_passes", F.col("n_changed").alias("changed_cues"), F.coalesce("n_issues", F.lit(0)).alias("n_issues"))
