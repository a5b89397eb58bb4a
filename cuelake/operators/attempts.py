"""Decode attempts in stages: another decoding, then another language, only for items that have no cue yet."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.operators.rounds import Store

# The decodings in the order in which they are tried.
DECODINGS = ("beam", "greedy")


class Decoded(NamedTuple):
    """chosen (media_id, attempt_no, language, decoding, fallback_language, fallback_decoding, n_cues), cues of the chosen attempts, failed (media_id, n_attempts, summary)."""

    chosen: DataFrame
    cues: DataFrame
    failed: DataFrame


def decode_in_stages(store: Store, media: DataFrame, decode: Callable[[DataFrame], DataFrame], detect: Callable[[DataFrame], DataFrame]) -> Decoded:
    """Attempts at media (media_id, language), language null where it has to be detected.

    detect gives (media_id, detected) of (media_id); it runs for items without a language, and for the others once both decodings in theirs gave nothing. decode gives cues
    (media_id, ...) of a plan (media_id, attempt_no, language, decoding, fallback_language, fallback_decoding). The detected language is tried only if it is another one.
    Each stage is written, so a run that stopped goes on with the stage that was under way.
    """
    unknown = media.where("language IS NULL").select("media_id")
    found = store.once("detected-first", lambda: detect(unknown))
    primary = media.join(found, "media_id", "left").select("media_id", F.col("language").alias("requested"), F.coalesce("language", "detected").alias("language"))
    left = store.once("stage-0/left", lambda: primary)
    chosen, cues, tried = [], [], []
    for no in range(1, 2 * len(DECODINGS) + 1):
        fallback, decoding = no > len(DECODINGS), DECODINGS[(no - 1) % len(DECODINGS)]
        if no == len(DECODINGS) + 1:
            again = store.once("detected-again", lambda x=left: detect(x.where("requested IS NOT NULL").select("media_id")))
            other = left.join(again, "media_id", "left").where("requested IS NOT NULL AND detected IS NOT NULL AND detected <> requested")
            left = store.once(f"stage-{no}/fallback", lambda x=other: x.select("media_id", "requested", F.col("detected").alias("language")))
        if left.isEmpty():
            break
        plan = left.where("language IS NOT NULL").select("media_id", F.lit(no).alias("attempt_no"), "language", F.lit(decoding).alias("decoding"), F.lit(fallback).alias("fallback_language"), F.lit(decoding != DECODINGS[0]).alias("fallback_decoding"))
        got = store.once(f"stage-{no}/cues", lambda p=plan: decode(p))
        counts = got.groupBy("media_id").agg(F.count(F.lit(1)).alias("n_cues"))
        chosen.append(plan.join(counts, "media_id"))
        cues.append(got)
        tried.append(plan.select("media_id", "attempt_no", "language", "decoding"))
        left = store.once(f"stage-{no}/left", lambda x=left, c=counts: x.join(c, "media_id", "left_anti"))
    if not tried:
        tried = [media.limit(0).select("media_id", F.lit(1).alias("attempt_no"), "language", F.lit("").alias("decoding"))]
        chosen = [tried[0].select("*", F.lit(False).alias("fallback_language"), F.lit(False).alias("fallback_decoding"), F.lit(0).cast("long").alias("n_cues"))]
        cues = [store.once("stage-1/cues", lambda: decode(chosen[0].drop("n_cues")))]

    def together(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    done = together(chosen)
    steps = F.transform(F.array_sort(F.collect_list(F.struct("attempt_no", "language", "decoding"))), lambda x: F.concat_ws(" ", x["language"], x["decoding"]))
    lost = together(tried).groupBy("media_id").agg(F.count(F.lit(1)).alias("n_attempts"), F.array_join(steps, " | ").alias("summary"))
    failed = media.select("media_id").join(done.select("media_id"), "media_id", "left_anti").join(lost, "media_id", "left")
    return Decoded(done, together(cues), failed.select("media_id", F.coalesce("n_attempts", F.lit(0)).alias("n_attempts"), F.coalesce("summary", F.lit("")).alias("summary")))
