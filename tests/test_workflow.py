from pyspark.sql import functions as F

from cuelake.operators import review, segments


def test_batches_keep_both_limits(spark):
    sizes = [10] * 24 + [8000, 1, 9000, 5]
    cues = spark.createDataFrame([("m", i, "x" * n) for i, n in enumerate(sizes)], "media_id string, pos long, text string")
    got = [r.batch_id for r in review.batch_cues(cues).orderBy("pos").collect()]
    assert got == [0] * 24 + [1, 2, 3, 4]


def test_line_order(spark):
    row = spark.sql("select array(named_struct('label', 'en', 'line', 'a'), named_struct('label', 'fr', 'line', 'b'), named_struct('label', 'en', 'line', 'c')) as x")
    show = lambda order: row.select(review.order_lines(F.col("x"), order)).first()[0]
    assert show([]) == "a\nb\nc" and show(["fr"]) == "b\na\nc" and show(["fr", "en", "de"]) == "b\na\nc"


def test_next_revision_takes_the_gap(spark):
    rows = [("p", "source", n) for n in (1, 2, 4)] + [("p", "target", 3), ("q", "source", 1)]
    got = {(r.project, r.name) for r in review.next_revision(spark.createDataFrame(rows, "project string, kind string, n int")).collect()}
    assert got == {("p", "source-0003"), ("p", "target-0001"), ("q", "source-0002")}


def test_windows_own_cues_by_midpoint(spark):
    windows = spark.createDataFrame([("m", 0, 0, 3000), ("m", 1, 2800, 5000)], "media_id string, chunk_id int, start long, end long")
    cues = spark.createDataFrame([("m", 0, 280, 298), ("m", 1, 280, 298), ("m", 0, 100, 295), ("m", 1, 480, 520)], "media_id string, chunk_id int, start_cs long, end_cs long")
    got = sorted(tuple(r)[1:] for r in segments.own_cues(cues, windows, 1000).collect())
    assert got == [(0, 100, 290), (0, 280, 290), (1, 480, 500)]


def test_equal_starts_keep_the_later_cue(spark):
    cues = spark.createDataFrame([("m", 1, 0, 50), ("m", 2, 0, 60), ("m", 3, 200, 210)], "media_id string, idx int, start_cs long, end_cs long")
    media = spark.createDataFrame([("m", 250)], "media_id string, duration_cs long")
    got = [(r.idx, r.start_cs, r.end_cs) for r in segments.fit_timing(cues, media, pad_cs=10).orderBy("idx").collect()]
    assert got == [(1, 0, 80), (2, 200, 250)]


def test_empty_tables(spark):
    attempts = spark.createDataFrame([], "media_id string, attempt_no long, cue_count int")
    audio = spark.createDataFrame([("a", 1000, []), ("b", 10, [3.0, -4.0])], "media_id string, sample_rate int, samples array<float>")
    assert segments.select_attempt(attempts).count() == 0
    assert [(r.media_id, r.frame_idx, r.rms) for r in segments.frame_rms(audio).orderBy("frame_idx").collect()] == [("b", 0, 3.0), ("b", 1, 4.0)]
