"""Quantities named in English and Chinese text, and whether two texts name different ones."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

# Number words, units, and the words that make a Chinese run a quantity.
DIGITS = dict(zip("零〇一二两兩三四五六七八九", (0, 0, 1, 2, 2, 2, 3, 4, 5, 6, 7, 8, 9), strict=True))
UNITS = {"十": 1e1, "百": 1e2, "千": 1e3, "万": 1e4, "萬": 1e4, "亿": 1e8, "億": 1e8, "兆": 1e12}
SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"hundred": 1e2, "thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}
MEASURES = "个 個 位 人 名 只 件 台 本 次 年 月 天 日 小时 小時 分钟 分鐘 秒 岁 歲 元 美元 欧元 英镑 公里 米 公斤 吨 噸 度 %".split()
LONGEST, CLOSE = 80, 1e-9

WORDS = {w: float(i) for i, w in enumerate(SMALL)} | {w: 10.0 * i for i, w in enumerate(TENS, 2)}
RUN = re.compile("(?:[0-9" + "".join(DIGITS) + "".join(UNITS) + "点點]|[.,](?=[0-9]))+")
HAN = re.compile(r"[㐀-䶿一-鿿]")
SCALE_AFTER = re.compile(r"\s*([a-z]+)")
PERCENT_AFTER = re.compile(r"\s*(?:%|per\s?cent)")
QUANTITIES = ArrayType(StructType([StructField("value", DoubleType()), StructField("percent", BooleanType())]))
#: Where a quantity may begin; no other place gives one.
START = re.compile("-|[0-9" + "".join(DIGITS) + "".join(UNITS) + "点點]|[.,](?=[0-9])|(?:" + "|".join(WORDS) + "|an?)(?![a-z])")
FIRST, NEXT, AFTER_AND = re.compile("([a-z]+)"), re.compile(r"[\s-]*([a-z]+)"), re.compile(r"\s*([a-z]+)")


def _chinese(run: str) -> float | None:
    """The value of a run: its largest unit (the leftmost of equal ones) splits it into a factor and a rest."""
    units = [(UNITS[c], -i) for i, c in enumerate(run) if c in UNITS]
    if units:
        unit, at = max(units)
        left, right = run[:-at], run[1 - at :]
        factor, rest = _chinese(left) if left else 1.0, _chinese(right) if right else 0.0
        return None if factor is None or rest is None else factor * unit + rest
    try:
        return float("".join(str(DIGITS.get(c, c)) for c in run))
    except ValueError:
        return None


def _is_quantity(text: str, start: int, end: int, percent: bool) -> bool:
    """Does the run text[start:end] count, or is it part of a word such as 一起?"""
    run, before, after = text[start:end], text[start - 1 : start] if start else "", text[end : end + 1]
    if percent or before == "第" or re.search("[0-9]", run) or not (HAN.match(before) or HAN.match(after)):
        return True
    with_unit = len(run) > 1 and (run[0] == "十" or run[0] in DIGITS) and any(c in UNITS or c in "点點" for c in run)
    return with_unit or text.startswith(tuple(MEASURES), end)


def _english(text: str, at: int) -> tuple[float, int] | None:
    """(value, end) of the number words from at on."""
    if at and text[at - 1].isalnum():
        return None
    total = current = 0.0
    end, found, m = at, False, FIRST.match(text, at)
    while m:
        name, after = m.group(1), NEXT.match(text, m.end())
        if name in WORDS:
            current, found = current + WORDS[name], True
        elif name in ("a", "an") and not found and after and after.group(1) in SCALES and "-" not in after.group():
            current, found = 1.0, True
        elif name in SCALES and found:
            total, current = (total, current * 100.0) if name == "hundred" else (total + current * SCALES[name], 0.0)
        elif name == "and" and found and (total > 0 or current >= 100):
            m = AFTER_AND.match(text, m.end())  # taken only if a number follows
            continue
        else:
            break
        end, m = m.end(), after
    return (total + current, end) if found else None


def quantities_of(text: str) -> Iterator[tuple[float, bool]]:
    text, at = text.lower().replace("−", "-"), 0
    while place := START.search(text, at):
        at = place.start()
        percent = text.startswith("百分之", at)
        start = at + 3 * percent
        signed = text[start : start + 1] == "-" and (start == 0 or not text[start - 1].isalnum())
        run = RUN.match(text, start + signed)
        value, end = None, at
        if run and len(run.group()) <= LONGEST and _is_quantity(text, run.start(), run.end(), percent):
            value, end = _chinese(run.group().replace(",", "").replace("点", ".").replace("點", ".")), run.end()
            value = -value if signed and value is not None else value
        elif not run and (named := _english(text, start)):
            value, end = named
        if value is None:
            at += 1
            continue
        while (more := SCALE_AFTER.match(text, end)) and more.group(1) in SCALES:
            value, end = value * SCALES[more.group(1)], more.end()
        if ending := PERCENT_AFTER.match(text, end):
            percent, end = True, ending.end()
        yield value, percent
        at = end


@F.pandas_udf(QUANTITIES)
def quantities(text: pd.Series) -> pd.Series:
    """The quantities of each text in order; null texts have none."""
    return pd.Series([[{"value": v, "percent": p} for v, p in quantities_of(t)] if t else [] for t in text])


def numbers_differ(a: Column, b: Column) -> Column:
    """Do two arrays of quantities hold different numbers, in whatever order?"""
    ordered = lambda q: F.array_sort(F.transform(q, lambda x: F.struct(x["percent"].alias("percent"), x["value"].alias("value"))))
    near = lambda x, y: F.abs(x - y) <= CLOSE * F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
    alike = F.zip_with(ordered(a), ordered(b), lambda x, y: (x["percent"] == y["percent"]) & near(x["value"], y["value"]))
    return (F.size(a) != F.size(b)) | ~F.forall(alike, lambda x: F.coalesce(x, F.lit(False)))
