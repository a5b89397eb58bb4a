"""Decoder output as tables: clamping to a chunk, tokens into words, segments against words, long cues into parts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from cuelake.functions import text as T

# Marks after which a line may break, and the longest cue in cs.
BREAKS = "。！？；，、：.!?;,:"
MAX_CS = 600
PIECES = ArrayType(StructType([StructField("done", LongType()), StructField("text", StringType())]))


def valid_words(words: DataFrame) -> DataFrame:
    """Words that last and have text; white space alone counts as text."""
    return words.where("end_cs > start_cs AND text <> ''")


def clamp_tokens(tokens: DataFrame, eot: int | None = None) -> DataFrame:
    """Tokens (start_cs, end_cs relative to their chunk) moved to media time within chunk_cs and chunk_cs + chunk_len.

    Tokens that start at the chunk's end or after it go, as do special ones (token_id of eot and more); the others last at least 1 cs.
    """
    kept = tokens if eot is None else tokens.where(F.col("token_id") < eot)
    last = F.col("chunk_cs") + F.col("chunk_len")
    inside = lambda c: F.least(F.greatest(F.col("chunk_cs") + F.col(c), F.col("chunk_cs")), last)
    moved = kept.withColumns({"start_cs": inside("start_cs"), "end_cs": inside("end_cs")}).where(F.col("start_cs") < last)
    return moved.withColumn("end_cs", F.greatest("end_cs", F.col("start_cs") + 1))


def clamp_segments(segments: DataFrame) -> DataFrame:
    """As clamp_tokens for segments: trimmed, and those without text or length go."""
    last = F.col("chunk_cs") + F.col("chunk_len")
    inside = lambda c: F.least(F.greatest(F.col("chunk_cs") + F.col(c), F.col("chunk_cs")), last)
    moved = segments.withColumns({"start_cs": inside("start_cs"), "end_cs": inside("end_cs"), "text": T.trim_all(F.col("text"))})
    return moved.where("end_cs > start_cs AND text <> ''")


def words_match_segments(words: DataFrame, segments: DataFrame) -> DataFrame:
    """(media_id, chunk_id, matched): do the words of a chunk spell its segments' texts, in order, with nothing left over?"""
    key = ["media_id", "chunk_id"]
    gathered = lambda df, by, name: df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(by, "text"))).alias(name))
    said = gathered(words, "word_idx", "words").select(*key, _said("words").alias("said"))
    return said.join(gathered(segments, "seg_idx", "segments"), key, "full").select(*key, _spelled(F.col("said"), "segments").alias("matched"))


def windows_match_segments(windows: DataFrame, *keep: str) -> DataFrame:
    """As words_match_segments for windows (media_id, chunk_id, words, segments) that hold both as arrays in order: nothing is shuffled. keep: further columns that pass through."""
    return windows.select("media_id", "chunk_id", *keep, _spelled(F.when(F.size("words") > 0, _said("words")), "segments").alias("matched"))


def _said(words: str) -> Column:
    return T.transcript_key(F.array_join(F.transform(words, lambda x: x["text"]), ""))


def _spelled(said: Column, segments: str) -> Column:
    def walk(rest: Column, part: Column) -> Column:
        after = lambda x: F.when(F.startswith(x["rest"], x["k"]), F.substring(x["rest"], F.length(x["k"]) + 1, F.length(x["rest"])))  # noqa: E731  null from the first miss on
        return T.let(F.struct(F.ltrim(rest).alias("rest"), T.transcript_key(part["text"]).alias("k")), after)

    left = F.aggregate(F.when(F.size(segments) > 0, F.col(segments)), said, walk)
    return F.coalesce(F.trim(left) == "", F.lit(False))


def choose_timing(matches: DataFrame) -> DataFrame:
    """(media_id, timing) from (media_id, chunk_id, matched): word, mixed or segment-fallback."""
    n = matches.groupBy("media_id").agg(F.count_if("matched").alias("words"), F.count(F.lit(1)).alias("all"))
    return n.select("media_id", F.when(F.col("words") == 0, "segment-fallback").when(F.col("words") == F.col("all"), "word").otherwise("mixed").alias("timing"))


def pieces(text: str, size: int) -> Iterator[str]:
    """Text as pieces of at most size characters, cut after the last break in the last three tenths of a piece, else at size.

    A mark that would begin the next piece pulls the cut back by one character; pieces have no white space at their ends.
    """
    at, breaks = 0, re.compile(rf"(?s:.*)[\s{BREAKS}]")
    while at < len(text):
        cut = at + size
        if cut < len(text):
            found = breaks.match(text, at + size * 7 // 10, cut)
            cut = found.end() if found else cut
            cut -= cut > at + 1 and text[cut] in BREAKS
        piece, at = text[at:cut].strip(), cut
        if piece:
            yield piece
        while at < len(text) and text[at].isspace():
            at += 1


@F.pandas_udf(PIECES)
def split_text(text: pd.Series, size: pd.Series) -> pd.Series:
    """The pieces of each text, with the characters of the pieces before; null texts have none."""

    def placed(t: str | None, n: int) -> list[dict]:
        found = list(pieces(t, max(int(n), 1))) if t else []
        return [{"done": done, "text": p} for done, p in zip(accumulate(map(len, found), initial=0), found, strict=False)]

    return pd.Series([placed(t, n) for t, n in zip(text, size, strict=True)])


def split_long_cues(cues: DataFrame, max_cs: int = MAX_CS) -> DataFrame:
    """Build cues that are too long, in characters or time, as parts timed by their lengths; unsplit where a part would not last."""
    chars, dur = F.coalesce(F.length("text"), F.lit(0)), F.col("end_cs") - F.col("start_cs")
    limit = T.char_limit(F.coalesce("text", F.lit("")))
    parts = F.greatest(F.ceil(chars / limit), F.least(F.ceil(dur / max_cs), F.greatest(F.floor(chars / 4), F.lit(1))), F.lit(1))
    sized = cues.withColumns({"_limit": limit, "_parts": parts})
    size = F.greatest(F.least(F.ceil(chars / F.col("_parts")), F.col("_limit")), F.lit(1)).cast("long")
    cut = sized.withColumn("_pieces", split_text(F.coalesce("text", F.lit("")), size))
    last = F.get("_pieces", F.size("_pieces") - 1)
    cut = cut.withColumn("_total", F.when(F.size("_pieces") > 0, last["done"] + F.length(last["text"])))
    at = lambda done: T.proportional_time(F.col("start_cs"), dur, done, F.col("_total"))
    end = lambda x: F.when(x["done"] + F.length(x["text"]) == F.col("_total"), F.col("end_cs")).otherwise(at(x["done"] + F.length(x["text"])))
    cut = cut.withColumn("_timed", F.transform("_pieces", lambda x: F.struct(at(x["done"]).alias("s"), end(x).alias("e"), x["text"].alias("t"))))
    whole = F.array(F.struct(F.col("start_cs").alias("s"), F.col("end_cs").alias("e"), F.when(F.size("_timed") == 1, F.col("_timed")[0]["t"]).otherwise(F.col("text")).alias("t")))
    split = (F.col("_parts") > 1) & (F.size("_timed") > 1) & F.forall("_timed", lambda x: x["e"] > x["s"])
    rows = cut.withColumn("_timed", F.when(split, F.col("_timed")).otherwise(whole))
    rows = rows.select(*[c for c in cues.columns if c not in ("start_cs", "end_cs", "text")], F.posexplode("_timed").alias("part", "_x"))
    return rows.select("*", F.col("_x.s").alias("start_cs"), F.col("_x.e").alias("end_cs"), F.col("_x.t").alias("text")).drop("_x")


def audio_streams_equal(source: DataFrame, output: DataFrame) -> DataFrame:
    """(media_id, n_streams, same_count, same_streams) of probes with ``audio``, an array of streams, by place; unknown values equal each other, n_streams are the source's."""
    fields = ("codec", "sample_rate", "channels")
    side = lambda df, p: df.select("media_id", F.coalesce("audio", F.array()).alias(p))
    both = side(source, "s").join(side(output, "o"), "media_id")
    alike = F.zip_with("s", "o", lambda a, b: reduce(lambda x, y: x & y, [a[f].eqNullSafe(b[f]) for f in fields]))
    return both.select("media_id", F.size("s").cast("long").alias("n_streams"), (F.size("s") == F.size("o")).alias("same_count"), ((F.size("s") == F.size("o")) & F.forall(alike, lambda x: x)).alias("same_streams"))
