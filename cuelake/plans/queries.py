"""Registered queries: operators over caption tables derived from the given tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators import qa, segments
from cuelake.sources import srt


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caption track per conversation: a cue per turn, timed by its length."""
    c = _read(spark, sf_dir, "conversations")
    dur = 300 + 40 * F.least(F.length("text"), F.lit(150))
    gap = (F.col("conv_id") * 7 + F.col("turn") * 13) % 5 * 500
    by = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    rows = c.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("pos"), (2 * F.col("turn") + 1).alias("cue_id"), dur.cast("long").alias("dur"), F.coalesce(F.sum(dur + gap).over(by), F.lit(0)).cast("long").alias("start_ms"), "text")
    return rows.withColumn("end_ms", F.col("start_ms") + F.col("dur")).drop("dur")


def cues_cs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    start = F.floor(F.col("start_ms") / 10) - F.when(F.col("pos") % 7 == 0, 20).otherwise(0)
    end = F.floor(F.col("end_ms") / 10) + F.when(F.col("pos") % 5 == 0, 60).otherwise(0)
    return c.select("media_id", "pos", (F.col("pos") + 1).alias("idx"), start.alias("start_cs"), end.alias("end_cs"), "text")


def media(track: DataFrame) -> DataFrame:
    return track.groupBy("media_id").agg((F.max("end_ms") - 40).alias("duration_ms"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("media_id"), n.cast("long").alias("frame_idx"), (F.col("value") / 100).cast("float").alias("rms"))


def packets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _read(spark, sf_dir, "events")
    n = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) - 1
    rows = e.select("event_id", F.col("user_id").alias("media_id"), F.col("event_type").alias("stream"), n.cast("long").alias("packet_no"), F.concat(F.lit("SHA256:"), F.sha2(F.col("event_id").cast("string"), 256)).alias("hash"), (F.col("event_id") % 1500).alias("size"))
    k, pts = F.col("event_id"), F.col("packet_no") * 0.02
    rows = rows.withColumns({"pts": pts, "dts": F.when(k % 3 > 0, pts - 0.01), "duration": F.lit(0.02)})
    off = lambda name, by, at: F.when(k % by == at, F.col(name) + 0.5).when(k % by == at + 1, F.col(name) + 0.0005).otherwise(F.col(name))
    changed = rows.withColumns({"size": F.when(k % 997 == 0, F.col("size") + 1).otherwise(F.col("size")), "pts": off("pts", 491, 7), "dts": off("dts", 463, 5), "duration": off("duration", 479, 2)})
    return rows, changed.where("event_id % 1499 <> 3")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus rendered to SRT, read back, and its findings counted by kind for each media item."""
    track, _ = srt.parse_srt(srt.render_srt(cues(spark, sf_dir)))
    return qa.qa_summary(qa.check_cues(track, media(cues(spark, sf_dir))))


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", T.has_cjk(t).alias("cjk"), T.normalize_cue_text(t).alias("normal"), T.boundary_key(t).alias("boundary"), T.transcript_key(t).alias("transcript"),
        T.ends_strong(t).alias("strong"), T.ends_soft(t).alias("soft"), T.is_punctuation_only(t).alias("marks_only"), T.char_limit(t).cast("long").alias("char_limit"),
    )


def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    shown = T.format_timestamp(F.col("start_ms"))
    return c.select("media_id", "pos", shown.alias("shown"), T.parse_timestamp(shown).alias("back_ms"), T.ms_to_cs(F.col("start_ms")).alias("cs"), T.seconds_to_cs(F.col("end_ms") / 1000).alias("end_cs"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = segments.speech_regions(frames(spark, sf_dir), frame=20, silence=40, min_speech=40, pad=30)
    return segments.split_windows(regions, 300, 60)


def visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    points = c.groupBy("media_id").agg(F.max("end_ms").alias("last")).select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(500).cast("long"))).alias("t"))
    return segments.visible_cues(points, c)


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues_cs(spark, sf_dir)
    d = c.groupBy("media_id").agg((F.max("end_cs") - 70).alias("duration_cs"))
    return segments.valid_cues(c, d).select("media_id", "pos", "start_cs", "end_cs", "text")


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    late = c.where("pos % 11 <> 7").withColumn("start_ms", F.col("start_ms") + F.when(F.col("pos") % 4 == 3, 1).otherwise(0))
    return qa.check_alignment(c, late)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "srt_round_trip_qa": flagship,
    "text_keys": text_keys,
    "timestamps": timestamps,
    "validate_cues": lambda s, d: qa.qa_summary(qa.validate_cues(cues_cs(s, d))),
    "check_cues": lambda s, d: qa.check_cues(cues(s, d), media(cues(s, d))),
    "check_alignment": alignment,
    "short_cues": lambda s, d: qa.short_cue_issues(cues(s, d).withColumn("end_ms", F.col("end_ms") - F.when(F.col("pos") % 3 == 1, F.lit(3500)).otherwise(0))),
    "neighbours": lambda s, d: qa.neighbours(cues(s, d).withColumn("batch_id", F.floor(F.col("pos") / 2)), n=3),
    "valid_cues": valid,
    "adaptive_threshold": lambda s, d: segments.adaptive_threshold(frames(s, d)).withColumn("threshold", F.col("threshold").cast("double")),
    "speech_windows": windows,
    "compare_packets": lambda s, d: segments.compare_packets(*packets(s, d)),
    "visible_cues": visible,
}

_CUES = """
base AS (SELECT conv_id AS media_id, turn AS pos, 2 * turn + 1 AS cue_id, 300 + 40 * least(length(text), 150) AS dur, (conv_id * 7 + turn * 13) % 5 * 500 AS gap, text FROM conversations),
timed AS (SELECT *, CAST(coalesce(sum(dur + gap) OVER (PARTITION BY media_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM base),
cues AS (SELECT media_id, pos, cue_id, start_ms, CAST(start_ms + dur AS BIGINT) AS end_ms, text FROM timed),
cs AS (SELECT media_id, pos, pos + 1 AS idx, start_ms // 10 - CASE WHEN pos % 7 = 0 THEN 20 ELSE 0 END AS start_cs, end_ms // 10 + CASE WHEN pos % 5 = 0 THEN 60 ELSE 0 END AS end_cs, text FROM cues)
"""
_TRIM = r"regexp_replace(regexp_replace({}, '^[\s\x0b]+', ''), '[\s\x0b]+$', '')"
_NORMAL = "array_to_string(list_filter(list_transform(string_split({}, chr(10)), lambda x: " + _TRIM.format("x") + "), lambda x: x <> ''), chr(10))"
_KEY = r"lower(regexp_replace({}, '[^\pL\pN]', '', 'g'))"
_CJK = r"regexp_matches({}, '[\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{f900}}-\x{{faff}}\x{{3040}}-\x{{30ff}}\x{{ac00}}-\x{{d7af}}]')"
_LONG = "len(list_filter(string_split(text, chr(10)), lambda x: length(x) > CASE WHEN " + _CJK.format("x") + " THEN 18 ELSE 42 END)) > 0"


def _kinds(rules: dict[str, tuple[str, str]], source: str) -> str:
    return " UNION ALL ".join(f"SELECT media_id, pos, '{sev}' AS severity, '{kind}' AS kind FROM {source} WHERE {hit}" for kind, (sev, hit) in rules.items())


_SUMMARY = "SELECT media_id, severity, kind, count(*) AS n FROM found GROUP BY ALL"
_CHECK = f"""
WITH {_CUES}, m AS (SELECT media_id, max(end_ms) - 40 AS duration_ms FROM cues GROUP BY media_id),
r AS (SELECT cues.*, duration_ms, coalesce(lag(end_ms) OVER (PARTITION BY cues.media_id ORDER BY pos), 0) AS before, count(*) OVER (PARTITION BY cues.media_id, cue_id) AS same FROM cues JOIN m ON cues.media_id = m.media_id),
found AS ({_kinds({
    "cue_id": ("error", "cue_id <= 0 OR same > 1"), "blank": ("error", _TRIM.format("text") + " = ''"), "overlap": ("error", "start_ms < before"), "order": ("error", "end_ms <= start_ms"),
    "past_end": ("error", "end_ms > duration_ms + 50"), "short_cue": ("warning", "end_ms - start_ms < 800"), "long_cue": ("warning", "end_ms - start_ms > 6000"),
    "line_count": ("warning", "len(string_split(text, chr(10))) > 2"), "line_length": ("warning", _LONG),
}, "r")})
"""
_EVENTS = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, CAST(value / 100 AS FLOAT) AS rms FROM events"
_THRESHOLD = f"""
f AS (SELECT user_id AS media_id, frame_idx, rms FROM ({_EVENTS})),
k AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY rms) - 1 AS i, count(*) OVER (PARTITION BY media_id) AS n FROM f),
lv AS (SELECT media_id, max(rms) FILTER (i = (n - 1) * 20 // 100) AS low, max(rms) FILTER (i = (n - 1) * 90 // 100) AS high FROM k GROUP BY media_id),
th AS (SELECT media_id, CASE WHEN high < 0.003::FLOAT THEN 0.003::FLOAT ELSE least(greatest(2.5::FLOAT * low, 0.08::FLOAT * high, 0.003::FLOAT), 0.5::FLOAT * high) END AS threshold FROM lv)
"""


def _merge(name: str, source: str, gap: int) -> str:
    return f"""
{name}_a AS (SELECT *, CASE WHEN greatest(s - max(e) OVER (PARTITION BY media_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= {gap}
             AND row_number() OVER (PARTITION BY media_id ORDER BY s, e) > 1 THEN 0 ELSE 1 END AS new FROM {source}),
{name}_b AS (SELECT *, sum(new) OVER (PARTITION BY media_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM {name}_a),
{name} AS (SELECT media_id, min(s) AS s, max(e) AS e FROM {name}_b GROUP BY media_id, island)"""


ORACLES: dict[str, str] = {
    "srt_round_trip_qa": _CHECK + _SUMMARY,
    "check_cues": _CHECK + "SELECT * FROM found",
    "text_keys": rf"""
SELECT conv_id, turn, {_CJK.format("text")} AS cjk, {_NORMAL.format("text")} AS normal, {_KEY.format("text")} AS boundary,
       lower(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[^\s\pL\pN]', '', 'g'), '([A-Za-z0-9])\s+([A-Za-z0-9])', '\1' || chr(1) || '\2', 'g'), '([A-Za-z0-9])\s+([A-Za-z0-9])', '\1' || chr(1) || '\2', 'g'), '\s', '', 'g'), chr(1), ' ')) AS transcript,
       regexp_matches({_TRIM.format("text")}, '[。！？；.!?;…]$') AS strong, regexp_matches({_TRIM.format("text")}, '[，、：,:]$') AS soft,
       regexp_matches({_TRIM.format("text")}, '^[。！？；.!?;…，、：,:]+$') AS marks_only, CAST(CASE WHEN {_CJK.format("text")} THEN 18 ELSE 42 END AS BIGINT) AS char_limit FROM conversations""",
    "timestamps": f"""
WITH {_CUES} SELECT media_id, pos, printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) AS shown,
       start_ms AS back_ms, (start_ms + 9) // 10 AS cs, CAST(round(end_ms / 1000 * 100) AS BIGINT) AS end_cs FROM cues""",
    "validate_cues": f"""
WITH {_CUES}, r AS (SELECT *, lag(end_cs) OVER w AS before, lag({_KEY.format("text")}) OVER w AS said, row_number() OVER w AS nth FROM cs WINDOW w AS (PARTITION BY media_id ORDER BY pos)),
found AS ({_kinds({
    "index": ("error", "idx <> nth"), "blank": ("error", _TRIM.format("text") + " = ''"), "order": ("error", "start_cs < 0 OR end_cs <= start_cs"), "overlap": ("error", "start_cs < before"),
    "short_cue": ("warning", "(end_cs - start_cs) * 10 < 800"), "long_cue": ("warning", "(end_cs - start_cs) * 10 > 6000"), "line_count": ("warning", "len(string_split(text, chr(10))) > 2"),
    "line_length": ("warning", _LONG), "repeated": ("warning", f"{_KEY.format('text')} <> '' AND {_KEY.format('text')} = said"),
}, "r")}) {_SUMMARY}""",
    "check_alignment": f"""
WITH {_CUES}, late AS (SELECT media_id, pos, cue_id, start_ms + CASE WHEN pos % 4 = 3 THEN 1 ELSE 0 END AS start_ms, end_ms FROM cues WHERE pos % 11 <> 7)
SELECT c.media_id, count(*) FILTER (l.pos IS NULL OR c.start_ms <> l.start_ms) AS misaligned FROM cues c LEFT JOIN late l ON c.media_id = l.media_id AND c.pos = l.pos GROUP BY c.media_id""",
    "short_cues": f"WITH {_CUES} SELECT media_id, cue_id, 'readability' AS kind FROM cues WHERE end_ms - CASE WHEN pos % 3 = 1 THEN 3500 ELSE 0 END - start_ms < 800",
    "neighbours": f"""
WITH {_CUES}, b AS (SELECT DISTINCT media_id, pos // 2 AS batch_id FROM cues)
SELECT c.media_id, b.batch_id, c.pos FROM cues c JOIN b ON c.media_id = b.media_id AND c.pos BETWEEN b.batch_id * 2 - 3 AND b.batch_id * 2 + 4 AND c.pos // 2 <> b.batch_id""",
    "valid_cues": f"""
WITH {_CUES}, d AS (SELECT media_id, max(end_cs) - 70 AS d FROM cs GROUP BY media_id),
n AS (SELECT cs.media_id, pos, least(greatest(start_cs, 0), d) AS s, least(greatest(end_cs, 0), d) AS e, d, {_NORMAL.format("text")} AS text FROM cs JOIN d ON cs.media_id = d.media_id),
v AS (SELECT media_id, pos, s AS start_cs, CASE WHEN e <= s THEN least(s + 80, d) ELSE e END AS end_cs, text FROM n WHERE text <> '' AND s < d)
SELECT * FROM v WHERE end_cs > start_cs""",
    "adaptive_threshold": f"WITH {_THRESHOLD} SELECT media_id, CAST(threshold AS DOUBLE) AS threshold FROM th",
    "speech_windows": f"""
WITH {_THRESHOLD}, total AS (SELECT media_id, (max(frame_idx) + 1) * 20 AS n FROM f GROUP BY media_id),
loud AS (SELECT f.media_id, frame_idx, frame_idx - row_number() OVER (PARTITION BY f.media_id ORDER BY frame_idx) AS run FROM f JOIN th ON f.media_id = th.media_id WHERE rms >= threshold),
act AS (SELECT media_id, min(frame_idx) * 20 AS s, (max(frame_idx) + 1) * 20 AS e FROM loud GROUP BY media_id, run), {_merge("mrg", "act", 40)},
pad AS (SELECT mrg.media_id, greatest(s - 30, 0) AS s, least(e + 30, n) AS e FROM mrg JOIN total ON mrg.media_id = total.media_id WHERE e - s >= 40), {_merge("reg", "pad", 0)}
SELECT media_id, s + k * 240 AS start, least(s + k * 240 + 300, e) AS "end" FROM (SELECT media_id, s, e, unnest(range(0, CAST(ceil(greatest(e - s - 300, 0) / 240) AS BIGINT) + 1)) AS k FROM reg)""",
    "compare_packets": """
WITH s AS (SELECT event_id, user_id AS media_id, event_type AS stream, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS packet_no FROM events)
SELECT media_id, stream, count(*) AS n_source, count(*) FILTER (event_id % 1499 <> 3) AS n_output, min(packet_no) FILTER (event_id % 997 = 0 OR event_id % 1499 = 3 OR event_id % 491 = 7 OR event_id % 463 = 5 AND event_id % 3 > 0 OR event_id % 479 = 2) AS first_bad FROM s GROUP BY media_id, stream""",
    "visible_cues": f"""
WITH {_CUES}, p AS (SELECT media_id, unnest(range(0, max(end_ms) + 1, 500)) AS t FROM cues GROUP BY media_id)
SELECT p.media_id, p.t, c.pos FROM p JOIN cues c ON p.media_id = c.media_id AND p.t BETWEEN c.start_ms AND c.end_ms""",
}
