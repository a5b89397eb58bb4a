"""Speech regions and decode windows from frame levels; cue repair; packet comparison; visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.functions import text as T

#: Bins of a histogram; the samples and the frames of one item that a task takes at a time.
BINS, SPAN, FRAMES = 1024, 2**24, 2**16


def order_statistics(rows: DataFrame, value: str, percents: tuple[int, ...], bins: int = BINS) -> DataFrame:
    """(media_id, percent, level): of each item's n values in order that of place (n - 1) * percent // 100, exactly. Nulls come first, NaN last, as in a sort.

    Equal values are counted first. A histogram of each item says which of its bins a place is in; only the distinct values of these bins are put in order.
    """
    x, finite = F.col(value), F.abs(F.col(value).cast("double")) < float("inf")
    values = rows.groupBy("media_id", value).agg(F.count(F.lit(1)).alias("k"))
    sizes = values.groupBy("media_id").agg(F.sum("k").alias("n"), F.min(F.when(finite, x)).cast("double").alias("low"), F.max(F.when(finite, x)).cast("double").alias("high"))
    width = F.col("high") - F.col("low")
    inner = F.when(width > 0, F.least(F.floor((x.cast("double") - F.col("low")) / width * bins), F.lit(bins - 1))).otherwise(0)
    outer = F.when(x.isNull(), -2).when(F.isnan(x), bins + 1).when(x.cast("double") == float("inf"), bins).when(x.cast("double") == float("-inf"), -1)
    binned = values.join(sizes, "media_id").withColumn("bin", F.coalesce(outer, inner).cast("int"))
    counts = binned.groupBy("media_id", "bin").agg(F.sum("k").alias("k"), F.first("n").alias("n"))
    earlier = W.partitionBy("media_id").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    asked = counts.withColumn("before", F.coalesce(F.sum("k").over(earlier), F.lit(0)))
    asked = asked.select("*", F.explode(F.array(*map(F.lit, percents))).alias("percent"))
    place = F.floor((F.col("n") - 1) * F.col("percent") / 100)
    asked = asked.where((F.col("before") <= place) & (place < F.col("before") + F.col("k"))).select("media_id", "bin", "percent", (place - F.col("before")).alias("place"))
    near = binned.select("media_id", "bin", value, "k").join(asked, ["media_id", "bin"])
    near = near.withColumn("upto", F.sum("k").over(W.partitionBy("media_id", "percent").orderBy(value).rowsBetween(W.unboundedPreceding, 0)))
    return near.where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("k") <= F.col("place"))).select("media_id", "percent", F.col(value).alias("level"))


def adaptive_threshold(frames: DataFrame) -> DataFrame:
    """(media_id, threshold) from the 20th and 90th percentile frames, in single precision throughout."""
    level = lambda p: F.max(F.when(F.col("percent") == p, F.col("level")))
    f = lambda x: F.lit(x).cast("float")
    low, high = F.col("low"), F.col("high")
    noise = F.greatest((f(2.5) * low).cast("float"), (f(0.08) * high).cast("float"), f(0.003))
    value = F.when(high < f(0.003), f(0.003)).otherwise(F.least(noise, (f(0.5) * high).cast("float")))
    levels = order_statistics(frames, "rms", (20, 90))
    return levels.groupBy("media_id").agg(level(20).alias("low"), level(90).alias("high")).select("media_id", value.cast("float").alias("threshold"))


def _islands(df: DataFrame, keys: list[str], max_gap: int) -> DataFrame:
    by = W.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("new", F.when(F.greatest(F.col("start") - reach, F.lit(0)) <= max_gap, 0).otherwise(1))
    islands = marked.withColumn("island", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def merge_intervals(df: DataFrame, max_gap: int, span: int = SPAN) -> DataFrame:
    """Intervals (media_id, start, end) joined where the gap to what came before is at most max_gap.

    Those that start in one span are merged first, so a long item's are shared out between tasks and only what does not merge there meets again.
    """
    spans = df.select("media_id", F.floor(F.col("start") / span).alias("span"), "start", "end")
    return _islands(_islands(spans, ["media_id", "span"], max_gap).drop("span"), ["media_id"], max_gap)


def active_regions(frames: DataFrame, thresholds: DataFrame, frame: int) -> DataFrame:
    """Maximal runs of frames at or above the threshold, as intervals of samples."""
    loud = frames.join(thresholds, "media_id").where("rms >= threshold")
    by = W.partitionBy("media_id", "part").orderBy("frame_idx")
    runs = loud.withColumn("part", F.floor(F.col("frame_idx") / FRAMES)).withColumn("run", F.col("frame_idx") - F.row_number().over(by))
    runs = runs.groupBy("media_id", "part", "run").agg(F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b"))
    return _islands(runs.select("media_id", (F.col("a") * frame).alias("start"), ((F.col("b") + 1) * frame).alias("end")), ["media_id"], 0)  # runs cut at the border of parts


def speech_runs(frames: DataFrame, frame: int, silence: int, min_speech: int) -> DataFrame:
    """Runs of loud frames merged over short silence, short ones dropped."""
    joined = merge_intervals(active_regions(frames, adaptive_threshold(frames), frame), max(silence, frame))
    return joined.where(F.col("end") - F.col("start") >= max(min_speech, frame))


def pad_regions(runs: DataFrame, media: DataFrame, pad: int) -> DataFrame:
    """Runs padded within their item (media_id, n_samples), and merged where they touch."""
    long = runs.join(media, "media_id")
    return merge_intervals(long.select("media_id", F.greatest(F.col("start") - pad, F.lit(0)).alias("start"), F.least(F.col("end") + pad, F.col("n_samples")).alias("end")), 0)


def speech_regions(frames: DataFrame, frame: int, silence: int, min_speech: int, pad: int) -> DataFrame:
    """Runs merged over short silence, short ones dropped, padded within the item, and merged again."""
    total = frames.groupBy("media_id").agg(((F.max("frame_idx") + 1) * frame).alias("n_samples"))
    return pad_regions(speech_runs(frames, frame, silence, min_speech), total, pad)


def split_windows(regions: DataFrame, size: int, overlap: int) -> DataFrame:
    """Windows of at most size samples that overlap, over each region."""
    step = size - min(overlap, size - 1)
    last = F.ceil(F.greatest(F.col("end") - F.col("start") - size, F.lit(0)) / step)
    rows = regions.select("media_id", "start", "end", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    start = F.col("start") + F.col("k") * step
    return rows.select("media_id", start.alias("start"), F.least(start + size, F.col("end")).alias("end"))


def valid_cues(cues: DataFrame, media: DataFrame, min_cs: int = 80) -> DataFrame:
    """Build cues with normalised text, clamped to [0, duration_cs], the too short lengthened, the empty dropped."""
    d = F.col("duration_cs")
    rows = cues.join(media, "media_id").withColumn("text", T.normalize_cue_text(F.col("text"))).where("text <> ''")
    rows = rows.withColumns({"start_cs": F.least(F.greatest("start_cs", F.lit(0)), d), "end_cs": F.least(F.greatest("end_cs", F.lit(0)), d)}).where(F.col("start_cs") < d)
    end = F.when(F.col("end_cs") <= F.col("start_cs"), F.least(F.col("start_cs") + min_cs, d)).otherwise(F.col("end_cs"))
    return rows.withColumn("end_cs", end).where("end_cs > start_cs")


def compare_packets(source: DataFrame, output: DataFrame) -> DataFrame:
    """(media_id, stream, n_source, n_output, first_bad) by packet number: hash and size, and pts, dts and duration within 1 ms, null-safe."""
    key, times = ["media_id", "stream", "packet_no"], ("pts", "dts", "duration")
    side = lambda df, p: df.select(*key, *[F.col(c).alias(p + c) for c in ("hash", "size", *times)], F.lit(True).alias(p + "in"))
    both = side(source, "s_").join(side(output, "o_"), key, "full")
    same = F.col("s_hash").eqNullSafe(F.col("o_hash")) & F.col("s_size").eqNullSafe(F.col("o_size")) & F.col("s_in").eqNullSafe(F.col("o_in"))
    for t in times:
        x, y = F.col(f"s_{t}"), F.col(f"o_{t}")
        same &= x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= 0.001 + 2.3e-16, F.lit(False))
    return both.groupBy("media_id", "stream").agg(F.count("s_in").alias("n_source"), F.count("o_in").alias("n_output"), F.min(F.when(~same, F.col("packet_no"))).alias("first_bad"))


def visible_cues(points: DataFrame, cues: DataFrame, bucket_ms: int = 10_000) -> DataFrame:
    """(media_id, t, pos) of cues shown at t, both ends included. Time buckets make the range join an equi-join."""
    at = points.withColumn("bucket", F.floor(F.col("t") / bucket_ms))
    spans = cues.select("media_id", "pos", "start_ms", "end_ms", F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor(F.col("end_ms") / bucket_ms))).alias("bucket"))
    return at.join(spans, ["media_id", "bucket"]).where("t >= start_ms AND t <= end_ms").select("media_id", "t", "pos")


def frame_rms(audio: DataFrame, frame_ms: int = 20) -> DataFrame:
    """(media_id, frame_idx, rms) of frames of samples, the short last one too; squares are summed in double, the level is single."""
    size = F.greatest(F.floor(F.col("sample_rate") * frame_ms / 1000), F.lit(1))
    n = F.ceil(F.size("samples") / size).cast("int")
    frames = audio.where(F.size("samples") > 0).select("media_id", "samples", size.cast("int").alias("size"), F.explode(F.sequence(F.lit(0), n - 1)).alias("frame_idx"))
    part = F.slice("samples", F.col("frame_idx") * F.col("size") + 1, F.col("size"))
    power = F.aggregate(part, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return frames.select("media_id", "frame_idx", F.sqrt(power / F.size(part)).cast("float").alias("rms"))


def own_cues(cues: DataFrame, windows: DataFrame, rate: int) -> DataFrame:
    """Cues (media_id, chunk_id, start_cs, end_cs, ...) whose midpoint their window owns, clamped to what it owns.

    Neighbouring windows part at the middle of their overlap (or gap); the first and last own their outer ends, and the last
    owns cues beyond it.
    """
    by = W.partitionBy("media_id").orderBy("chunk_id")
    middle = lambda a, b: F.floor((a + b) / 2)
    lower = F.coalesce(middle(F.lag("end").over(by), F.col("start")), F.col("start"))
    after = F.lead("start").over(by)
    upper = F.coalesce(middle(F.col("end"), after), F.col("end"))
    cs = lambda x: F.floor(x * 100 / rate)
    bounds = windows.select("media_id", "chunk_id", cs(lower).alias("lower"), cs(upper).alias("upper"), after.isNull().alias("last"))
    at = F.floor((F.col("start_cs") + F.col("end_cs")) / 2)
    owned = cues.join(bounds, ["media_id", "chunk_id"]).where((at >= F.col("lower")) & (F.col("last") | (at < F.col("upper"))))
    owned = owned.withColumns({"start_cs": F.greatest("start_cs", "lower"), "end_cs": F.least("end_cs", "upper")})
    return owned.where("end_cs > start_cs").select(*cues.columns)


def select_attempt(attempts: DataFrame) -> DataFrame:
    """(media_id, attempt_no, n_attempts): the first attempt with a cue, null where none has one."""
    return attempts.groupBy("media_id").agg(F.min(F.when(F.col("cue_count") > 0, F.col("attempt_no"))).alias("attempt_no"), F.count(F.lit(1)).alias("n_attempts"))


def fit_timing(cues: DataFrame, media: DataFrame, pad_cs: int, min_cs: int = 80) -> DataFrame:
    """Cues padded and lengthened within duration_cs, cut at the next start, the empty dropped, numbered from 1."""
    end = F.least(F.greatest(F.col("end_cs") + pad_cs, F.col("start_cs") + min_cs), F.col("duration_cs"))
    rows = cues.drop("duration_cs").join(media, "media_id").withColumn("end_cs", end)
    cut = rows.withColumn("end_cs", F.least("end_cs", F.coalesce(F.lead("start_cs").over(W.partitionBy("media_id").orderBy("start_cs", "end_cs", "idx")), F.col("end_cs"))))
    kept = cut.where("end_cs > start_cs")
    return kept.withColumn("idx", F.row_number().over(W.partitionBy("media_id").orderBy("start_cs", "end_cs", "idx"))).drop("duration_cs")
