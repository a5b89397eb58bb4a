"""Scalar rules for caption text and media time, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character ranges of the three CJK rules, punctuation sets, default limits.
CJK = {
    "cue": r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]",
    "workflow": r"[\x{3400}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]",
    "number": r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]",
}
STRONG_END, SOFT_END = "。！？；.!?;…", "，、：,:"
CJK_CHARS, LATIN_CHARS = 18, 42
EDGE_SPACE = r"(?U)^\s+|\s+$"
TIME = r"^\s*(\d+):(\d+):(\d+)[,.](\d+)\s*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def has_cjk(text: Column, variant: str = "cue") -> Column:
    return text.rlike(CJK[variant])


def trim_all(text: Column) -> Column:
    """Without white space (Unicode) at either end."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def normalize_cue_text(text: Column) -> Column:
    """Lines trimmed, blank ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(text, r"\r?\n"), trim_all), lambda x: x != ""), "\n")


def boundary_key(text: Column) -> Column:
    """Letters and digits alone, lower-cased one by one."""
    return F.replace(F.lower(F.regexp_replace(text, r"[^\p{IsAlphabetic}\p{N}]", "")), F.lit("ς"), F.lit("σ"))


def comparable_text(text: Column) -> Column:
    return F.replace(F.lower(F.regexp_replace(text, r"[^\p{IsAlphabetic}\p{N}\x{3040}-\x{30ff}]", "")), F.lit("ς"), F.lit("σ"))


def transcript_key(text: Column) -> Column:
    """As boundary_key, with one space where white space stood between two ASCII letters or digits."""
    kept = F.regexp_replace(text, r"(?U)[^\s\p{IsAlphabetic}\p{N}]", "")
    marked = F.regexp_replace(kept, r"(?<=[A-Za-z0-9])(?U:\s+)(?=[A-Za-z0-9])", "\u0001")
    return F.replace(F.lower(F.replace(F.regexp_replace(marked, r"(?U)\s", ""), F.lit("\u0001"), F.lit(" "))), F.lit("ς"), F.lit("σ"))


def join_words(words: Column) -> Column:
    return trim_all(F.regexp_replace(F.array_join(words, ""), r"(?U)\s+", " "))


def ends_strong(text: Column) -> Column:
    return trim_all(text).rlike(f"[{STRONG_END}]$")


def ends_soft(text: Column) -> Column:
    return trim_all(text).rlike(f"[{SOFT_END}]$")


def is_punctuation_only(text: Column) -> Column:
    return trim_all(text).rlike(f"^[{STRONG_END}{SOFT_END}]+$")


def char_limit(text: Column, cjk: int = CJK_CHARS, latin: int = LATIN_CHARS, variant: str = "cue") -> Column:
    return F.greatest(F.when(has_cjk(text, variant), cjk).otherwise(latin), F.lit(1))


def ms_to_cs(ms: Column) -> Column:
    return F.floor((ms + 9) / 10)


def seconds_to_cs(seconds: Column) -> Column:
    bad = seconds.isNull() | F.isnan(seconds) | (seconds <= 0) | (seconds == float("inf"))
    return F.when(bad, 0).otherwise(F.round(seconds * 100)).cast("long")


def proportional_time(start: Column, duration: Column, done: Column, total: Column) -> Column:
    return start + F.floor(duration * done / total)


def parse_rate(text: Column) -> Column:
    """``n/d`` as a number; null unless finite and above 0."""
    parts = F.split(text, "/")
    rate = F.try_divide(F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double"))
    return F.when((F.size(parts) == 2) & (rate > 0) & (rate < float("inf")), rate)


def format_timestamp(ms: Column) -> Column:
    part = lambda by, of: F.floor(ms / by) % of if of else F.floor(ms / by)
    return F.format_string("%02d:%02d:%02d,%03d", part(3_600_000, 0), part(60_000, 60), part(1_000, 60), ms % 1000)


def parse_timestamp(text: Column) -> Column:
    """``H:M:S,mmm`` in ms (``,5`` is 5 ms); null if it is not one."""
    h, m, s, ms = (F.regexp_extract(text, TIME, i).try_cast("long") for i in (1, 2, 3, 4))
    return F.when((m < 60) & (s < 60) & (ms < 1000), F.try_add(F.try_multiply(h, F.lit(3_600_000)), m * 60_000 + s * 1_000 + ms))


def is_wholesale_rewrite(a: Column, b: Column) -> Column:
    x, y = boundary_key(a), boundary_key(b)
    longest = F.greatest(F.length(x), F.length(y))
    return (longest >= 5) & (2 * F.levenshtein(x, y) > longest)


#: Half of a character pair, escaped: text that can't be.
LONE = r"(?i)(?<!\\)(?:\\\\)*(?:\\ud[89ab][0-9a-f]{2}(?!\\ud[c-f][0-9a-f]{2})|(?<!\\ud[89ab][0-9a-f]{2})\\ud[c-f][0-9a-f]{2})"


def one_document(text: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else, no key repeated; null for others.

    A parser that stops where the value ends would let anything follow it: here the text's own hash has to.
    """
    mark = F.sha2(text, 256)
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
    return F.when((F.try_variant_get(both, "$[1]", "string") == mark) & ~text.rlike(LONE), F.try_variant_get(both, "$[0]", "variant"))


def ms_to_samples(ms: Column, rate: Column) -> Column:
    """Whole samples that begin before ms; times before the start have none."""
    return F.greatest(F.floor(ms * rate / 1000), F.lit(0)).cast("long")
