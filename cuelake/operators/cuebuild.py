"""From decoder output to cues: token bytes into words, words into cues, overlaps merged, windows planned, cues finished.

The folds (each step depends on what the last one gave) run in sorted passes, per decode window or where nothing natural cuts a run of cues.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators import scan, segments, transcript

# Default limits of a cue in cs and characters, the slack between copies of a cue, the shortest text that may be part of another.
MARKS = tuple(T.STRONG_END + T.SOFT_END)
CJK_RANGE = re.compile("[㐀-䶿一-鿿豈-﫿぀-ヿ가-힯]")
SLACK_CS, LEAST_PART, DETECT_S = 25, 4, 30


@dataclass(frozen=True)
class CuePolicy:
    min_cs: int = 80
    max_cs: int = 600
    cjk_chars: int = T.CJK_CHARS
    latin_chars: int = T.LATIN_CHARS
    pause_cs: int = 50


class _Track:
    """Timed words with their joined text, so that any stretch is a slice of it."""

    def __init__(self, starts: list[int], ends: list[int], texts: list[str], policy: CuePolicy) -> None:
        self.starts, self.ends, self.policy, self.n = starts, ends, policy, len(texts)
        self.marks = [bool(t.strip()) and not t.strip().strip("".join(MARKS)) for t in texts]
        self.last_cjk = max((i for i, t in enumerate(texts) if CJK_RANGE.search(t)), default=-1)
        parts, self.at, size, spaced = [], [], 0, False
        for t in texts:
            t = re.sub(r"\s+", " ", t)
            t = t[1:] if spaced and t.startswith(" ") else t
            spaced = t.endswith(" ") if t else spaced
            self.at.append(size)
            parts.append(t)
            size += len(t)
        self.flat = "".join(parts)
        self.at.append(size)
        # Of each word's place: the next character that is no space, and the end of the last one before it.
        self.lead, self.tail, nearest = [0] * (self.n + 1), [0] * (self.n + 1), size
        for i in range(self.n, -1, -1):
            stripped = parts[i].lstrip() if i < self.n else ""
            nearest = self.at[i] + len(parts[i]) - len(stripped) if stripped else nearest
            self.lead[i] = nearest
        nearest = 0
        for i, part in enumerate(parts):
            stripped = part.rstrip()
            nearest = self.at[i] + len(stripped) if stripped else nearest
            self.tail[i + 1] = nearest

    def chars(self, first: int, last: int) -> int:
        """The length of what said() gives, without making it."""
        return max(self.tail[last + 1] - self.lead[first], 0)

    def ends_marked(self, first: int, last: int) -> bool:
        return self.chars(first, last) > 0 and self.flat[self.tail[last + 1] - 1] in MARKS

    def said(self, first: int, last: int) -> str:
        return self.flat[self.lead[first] : self.lead[first] + self.chars(first, last)]

    def last_word(self, first: int) -> int:
        """The last word of the cue that begins with word first: what remains, shared out evenly, bounds it; marks and pauses end it."""
        p, n = self.policy, self.n
        limit = max(p.cjk_chars if first <= self.last_cjk else p.latin_chars, 1)
        chars, span = max(self.chars(first, n - 1), 1), max(self.ends[-1] - self.starts[first], 1)
        shares = max(-(-chars // limit), -(-span // max(p.max_cs, 1)), 1)
        chars, span = -(-chars // shares), max(-(-span // shares), p.min_cs, 1)
        boundary, hard = None, n - 1
        for i in range(first, n):
            said, lasts = self.chars(first, i), self.ends[i] - self.starts[first]
            pause = i + 1 < n and self.starts[i + 1] - self.ends[i] >= max(p.pause_cs, 1)
            natural, over = self.ends_marked(first, i) or pause, said > limit
            if i >= first + 2 and over and self.marks[i]:
                hard = i - 2  # the mark stays with the word before it, in the next cue
                break
            if i > first and (said > chars or lasts > span) and not self.marks[i] and not (natural and not over and lasts <= max(p.max_cs, 1)):
                hard = i - 1
                break
            if natural:
                boundary = i
                if lasts >= max(p.min_cs, 1):
                    hard = i
                    break
        hard = max(hard, first)
        return hard if boundary is None or boundary > hard else boundary

    def cues(self) -> Iterator[tuple[int, int, str]]:
        first = 0
        while first < self.n:
            last = self.last_word(first)
            if said := self.said(first, last):
                yield self.starts[first], self.ends[last], said
            first = last + 1


def cues_from_words(words: DataFrame, policy: CuePolicy | None = None, keys: tuple[str, ...] = ("media_id", "chunk_id")) -> DataFrame:
    """(keys, idx from 1, start_cs, end_cs, text): the words of each key, in order of word_idx, as readable cues."""
    limits = policy or CuePolicy()
    kept = transcript.valid_words(words).select(*keys, "word_idx", "start_cs", "end_cs", "text")
    return scan.stream(kept, list(keys), ["word_idx"], lambda cols: _built(*cols[1:], limits), CUES)


def cues_from_windows(windows: DataFrame, policy: CuePolicy | None = None, keys: tuple[str, ...] = ("media_id", "chunk_id")) -> DataFrame:
    """As cues_from_words for windows that hold their ``words`` as an array in order: nothing is shuffled or sorted."""
    limits = policy or CuePolicy()
    kept = windows.select(*keys, F.filter("words", lambda w: (w["end_cs"] > w["start_cs"]) & (w["text"] != "")).alias("words"))
    kept = kept.select(*keys, *[_each("words", c) for c in ("start_cs", "end_cs", "text")])
    return scan.each(kept, list(keys), lambda cols: _built(*cols, limits), CUES)


CUES = "idx long, start_cs long, end_cs long, text string"


def _each(items: str, field: str) -> Column:
    return F.transform(items, lambda x: x[field]).alias(field)


def _built(starts: list[int], ends: list[int], texts: list[str], policy: CuePolicy) -> list[tuple]:
    return [(i, *cue) for i, cue in enumerate(_Track(starts, ends, texts, policy).cues(), 1)]


def assemble_tokens(tokens: DataFrame) -> DataFrame:
    """(media_id, chunk_id, seg_idx, word_idx, start_cs, end_cs, text): tokens' bytes gathered, within a segment, until they are whole characters.

    A tail that stays incomplete is dropped, as are bytes that can't become text.
    """
    keys = ["media_id", "chunk_id", "seg_idx"]
    item = F.struct("tok_idx", "bytes", *[F.col(c).cast("long").alias(c) for c in ("start_cs", "end_cs")])
    segments_ = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("tokens"))
    return assemble_segments(segments_).select(*keys, F.inline("words"))


def assemble_segments(segments: DataFrame, keys: tuple[str, ...] = ("media_id", "chunk_id", "seg_idx")) -> DataFrame:
    """(keys, words) of segments (keys, tokens) that hold their tokens (bytes, start_cs, end_cs as long) as an array in order, words (word_idx, start_cs, end_cs, text) likewise.

    Segments without a word have an empty array. Nothing is shuffled, and whole batches are gathered at once; only segments that are no sound text are walked through.
    """
    rows = segments.select(*keys, *[_each("tokens", c) for c in ("bytes", "start_cs", "end_cs")])
    head = ", ".join(f"{k} {kind}" for k, kind in rows.select(*keys).dtypes)
    return rows.mapInArrow(partial(_assembled, n_keys=len(keys)), f"{head}, words {WORDS}")


WORDS = "array<struct<word_idx: bigint, start_cs: bigint, end_cs: bigint, text: string>>"
_WORD = {"word_idx": pa.int64(), "start_cs": pa.int64(), "end_cs": pa.int64(), "text": pa.string()}


def _assembled(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, names = batch.columns[:n_keys], batch.schema.names[:n_keys]
        lists = batch.columns[n_keys:]
        counts = np.asarray(lists[0].value_lengths().fill_null(0), np.int64)
        pieces, starts, ends = (x.flatten() for x in lists)
        firsts = np.concatenate([[0], np.cumsum(counts)])  # of tokens
        sizes = np.asarray(pc.fill_null(pc.binary_length(pieces), 0), np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])  # of bytes
        raw = b"".join(pieces.drop_null().to_pylist())
        starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
        sound = np.array([_is_text(raw[at[lo] : at[hi]]) for lo, hi in zip(firsts, firsts[1:], strict=False)], bool)
        # A token ends a word if no character goes on after it, or if its segment ends.
        goes_on = np.append((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80, False)
        stop = ~goes_on[at[1:]]
        stop[firsts[1:][counts > 0] - 1] = True
        stop &= np.repeat(sound, counts)
        lasts = np.flatnonzero(stop)
        first = np.flatnonzero(np.repeat(sound, counts) & np.append(True, stop[:-1] | ~np.repeat(sound, counts)[:-1])[: len(stop)])
        latest = np.maximum.reduceat(np.where(np.repeat(sound, counts), ends, np.iinfo(np.int64).min), first) if len(first) else ends[:0]
        own = np.repeat(np.arange(len(counts)), counts)[lasts]
        full = at[lasts + 1] > at[first]  # tokens without bytes are no word
        own, first, lasts, latest = own[full], first[full], lasts[full], latest[full]
        n = np.bincount(own, minlength=len(counts))
        before = np.concatenate([[0], np.cumsum(n)])
        texts = [raw[lo:hi] for lo, hi in zip(at[first].tolist(), at[lasts + 1].tolist(), strict=True)]
        columns = [pa.array(np.arange(len(own)) - before[own]), pa.array(starts[first]), pa.array(latest), pa.array(texts, pa.binary()).cast(pa.string())]
        words = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.StructArray.from_arrays(columns, list(_WORD)))
        good = pa.array(sound)
        yield pa.RecordBatch.from_arrays([*[k.filter(good) for k in keys], words.filter(good)], names=[*names, "words"])
        odd = np.flatnonzero(~sound).tolist()
        if odd:
            walked = [_walked(*(x[firsts[i] : firsts[i + 1]] for x in (pieces.to_pylist(), starts.tolist(), ends.tolist()))) for i in odd]
            yield pa.RecordBatch.from_arrays([*[k.take(pa.array(odd)) for k in keys], pa.array(walked, words.type)], names=[*names, "words"])


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def _walked(pieces: list[bytes], starts: list[int], ends: list[int]) -> list[dict]:
    out, held, start, end = [], b"", None, None
    for piece, s, e in zip(pieces, starts, ends, strict=True):
        held += piece
        start, end = (s, e) if start is None else (start, max(end, e))
        try:
            text = held.decode()
        except UnicodeDecodeError as bad:
            if bad.reason == "unexpected end of data":
                continue
            text = ""
        if text:
            out.append({"word_idx": len(out), "start_cs": start, "end_cs": end, "text": text})
        held, start = b"", None
    return out


def dedup_boundary(cues: DataFrame, windows: DataFrame, rate: int) -> DataFrame:
    """Cues (media_id, chunk_id, pos, start_cs, end_cs, text) with copies of one cue from overlapping windows merged into one.

    A cue is a copy of the last one kept if they come from different windows that overlap, both touch that overlap, their keys are equal or one of
    LEAST_PART characters or more is part of the other, and it begins at most SLACK_CS after the other ends. The longer text stays.
    An item is cut wherever a cue and the one before it can't be copies, whatever they say; only what is left between cuts is folded.
    """
    cs = lambda c: F.floor(F.col(c) * 100 / rate)
    bounds = windows.select("media_id", "chunk_id", cs("start").alias("w_start"), cs("end").alias("w_end"))
    rows = cues.select("media_id", "chunk_id", "pos", "start_cs", "end_cs", "text", T.boundary_key(F.col("text")).alias("key")).join(bounds, ["media_id", "chunk_id"])

    block = F.floor(F.col("chunk_id") / 16)
    rows = scan.along(rows, ["media_id"], ["chunk_id", "pos"], block, nth="nth", before={"prior": ["chunk_id", "w_start", "w_end"]})
    lo, hi = F.greatest("prior.w_start", "w_start"), F.least("prior.w_end", "w_end")
    may = (F.col("prior.chunk_id") != F.col("chunk_id")) & (lo < hi) & (F.col("start_cs") < hi) & (F.col("end_cs") > lo) & (F.col("key") != "")
    rows = scan.along(rows.withColumn("own", (~F.coalesce(may, F.lit(False))).cast("long")), ["media_id"], ["chunk_id", "pos"], block, sums={"island": F.col("own")})
    rows = rows.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("media_id", "island")))

    def fold(cols: list[list]) -> list[tuple]:
        kept: list[list] = []
        for nth, chunk, start, end, text, key, w_start, w_end in zip(*cols, strict=True):
            if kept:
                _, _, s, e, t, k, ws, we = last = kept[-1]
                lo, hi = max(ws, w_start), min(we, w_end)
                x, y = sorted((k, key), key=len)
                if s < hi and e > lo and (x == y or (len(x) >= LEAST_PART and x in y)) and start <= e + SLACK_CS:
                    t, k = (text, key) if len(text) > len(t) else (t, k)
                    last[1:] = [chunk, min(s, start), max(e, end), t, k, w_start, w_end]
                    continue
            kept.append([nth, chunk, start, end, text, key, w_start, w_end])
        return [tuple(c[:5]) for c in kept]

    out = ["nth", "chunk_id", "start_cs", "end_cs", "text"]
    types = dict(rows.dtypes)
    several = scan.stream(rows.where("n > 1").select("media_id", "island", *out, "key", "w_start", "w_end"), ["media_id", "island"], ["nth"], fold, f"nth long, chunk_id {types['chunk_id']}, start_cs long, end_cs long, text string")
    kept = rows.where("n = 1").select("media_id", *out).unionByName(several.drop("island"))
    kept = scan.along(kept, ["media_id"], ["nth"], F.floor(F.col("nth") / scan.BLOCK), nth="idx")
    return kept.select("media_id", (F.col("idx") + 1).alias("idx"), "chunk_id", "start_cs", "end_cs", "text")


def optimize_cues(cues: DataFrame, media: DataFrame, pad_cs: int, min_cs: int = 80) -> DataFrame:
    """Build cues made fit to show: valid ones, long ones split, padded and lengthened, cut at the next start, numbered from 1."""
    split = transcript.split_long_cues(segments.valid_cues(cues, media, min_cs).drop("duration_cs"))
    return segments.fit_timing(split, media, pad_cs, min_cs)


def fixed_windows(media: DataFrame, size: int, overlap: int) -> DataFrame:
    """Windows over the whole of each item (media_id, n_samples)."""
    return segments.split_windows(media.where("n_samples > 0").select("media_id", F.lit(0).cast("long").alias("start"), F.col("n_samples").alias("end")), size, overlap)


def plan_windows(frames: DataFrame, media: DataFrame, *, frame: int, silence: int, min_speech: int, pad: int, size: int, overlap: int, mode: str = "speech", chunk: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(windows, plans) of items (media_id, n_samples). Windows of at most ``size`` over the speech of each, or of ``chunk`` (by default size) over all of it where none is found or mode is "fixed".

    plans: (media_id, strategy, regions, threshold, coverage): "speech", "fixed-fallback" or "fixed", which looks at no frames: no regions, no threshold.
    """
    none = lambda *columns: media.select("media_id", *columns)
    if mode == "fixed":
        plans = none(F.lit("fixed").alias("strategy"), F.lit(0).cast("long").alias("regions"), F.lit(None).cast("float").alias("threshold"), F.lit(0.0).alias("coverage"))
        windows = fixed_windows(media, chunk or size, overlap)
    else:
        runs = segments.speech_runs(frames, frame, silence, min_speech)
        spoken = segments.split_windows(segments.pad_regions(runs, media, pad), size, overlap)
        silent = media.join(runs.select("media_id").distinct(), "media_id", "left_anti")
        windows = spoken.unionByName(fixed_windows(silent, chunk or size, overlap))
        by = runs.groupBy("media_id").agg(F.count(F.lit(1)).alias("regions"), F.sum(F.col("end") - F.col("start")).alias("speech"))
        plans = media.join(by, "media_id", "left").join(segments.adaptive_threshold(frames), "media_id", "left").select(
            "media_id", F.when(F.col("regions") > 0, "speech").otherwise("fixed-fallback").alias("strategy"), F.coalesce("regions", F.lit(0)).alias("regions"), "threshold",
            (F.coalesce("speech", F.lit(0)) / F.greatest("n_samples", F.lit(1))).alias("coverage"),
        )
    return windows.withColumn("chunk_id", F.row_number().over(W.partitionBy("media_id").orderBy("start", "end")) - 1), plans


def choose_cues(word_cues: DataFrame, segment_cues: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues, timing): of each window (media_id, chunk_id) the cues built from words, where there are some and the words spell its segments, else those of its segments.

    matches: (media_id, chunk_id, matched) of all windows. cues say their ``timing``; timing: (media_id, timing, windows, word_timed).
    """
    key = ["media_id", "chunk_id"]
    worded = matches.where("matched").select(*key).join(word_cues.select(*key).distinct(), key, "left_semi")
    cues = word_cues.join(worded, key, "left_semi").withColumn("timing", F.lit("word"))
    cues = cues.unionByName(segment_cues.join(worded, key, "left_anti").withColumn("timing", F.lit("segment-fallback")))
    each = matches.select(*key).join(worded.withColumn("matched", F.lit(True)), key, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    n = each.groupBy("media_id").agg(F.count(F.lit(1)).alias("windows"), F.count_if("matched").alias("word_timed"))
    return cues, transcript.choose_timing(each).join(n, "media_id").select("media_id", "timing", "windows", "word_timed")


def choose_window_cues(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As choose_cues for windows (media_id, chunk_id, word_cues, segment_cues, matched) that hold their cues as arrays: no cue is shuffled, timing takes counts only.

    cues: (media_id, chunk_id, timing, cues) of windows that have some.
    """
    worded = F.coalesce(F.col("matched") & (F.size("word_cues") > 0), F.lit(False))
    each = windows.select("media_id", "chunk_id", worded.alias("matched"))
    n = each.groupBy("media_id").agg(F.count(F.lit(1)).alias("windows"), F.count_if("matched").alias("word_timed"))
    timing = F.when(F.col("word_timed") == 0, "segment-fallback").when(F.col("word_timed") == F.col("windows"), "word").otherwise("mixed")
    chosen = windows.withColumn("matched", worded)
    chosen = chosen.select("media_id", "chunk_id", F.when(F.col("matched"), "word").otherwise("segment-fallback").alias("timing"), F.when(F.col("matched"), F.col("word_cues")).otherwise(F.col("segment_cues")).alias("cues"))
    return chosen.where(F.size("cues") > 0), n.select("media_id", timing.alias("timing"), "windows", "word_timed")


def detection_window(samples: Column, rate: Column, seconds: int = DETECT_S) -> Column:
    """The first seconds of an array of samples."""
    return F.slice(samples, 1, (rate * seconds).cast("int"))


def attempt_diagnostics(windows: DataFrame, found: DataFrame, words: DataFrame) -> DataFrame:
    """(media_id, windows, segments, non_empty, blank, timed_words) of a decode attempt."""
    n = lambda df, **aggs: df.groupBy("media_id").agg(*[a.alias(k) for k, a in aggs.items()])
    blank = F.count_if(T.trim_all(F.coalesce("text", F.lit(""))) == "")
    out = n(windows, windows=F.count(F.lit(1))).join(n(found, segments=F.count(F.lit(1)), blank=blank), "media_id", "left").join(n(words, timed_words=F.count(F.lit(1))), "media_id", "left")
    out = out.fillna(0, ["segments", "blank", "timed_words"])
    return out.select("media_id", "windows", "segments", (F.col("segments") - F.col("blank")).alias("non_empty"), "blank", "timed_words")


def attempt_report(diagnostics: DataFrame, plans: DataFrame, timing: DataFrame) -> DataFrame:
    """(media_id, ..., summary): what attempt_diagnostics() counts, with the plan of windows, the cues' timing, and both in a line of text."""
    rows = diagnostics.join(plans, "media_id").join(timing.select("media_id", "timing"), "media_id", "left").withColumn("timing", F.coalesce("timing", F.lit("segment-fallback")))
    shown = ("strategy", "windows", "regions", "threshold", "coverage", "timing", "timed_words", "segments", "non_empty")
    line = F.concat_ws(" ", *[F.concat(F.lit(f"{n}="), F.coalesce(F.format_number(F.col(n), 4) if n in ("threshold", "coverage") else F.col(n).cast("string"), F.lit("none"))) for n in shown])
    return rows.withColumn("summary", line)
