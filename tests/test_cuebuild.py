import random
import re
import time

from cuelake.operators import cuebuild


def words(spark, rows):
    return spark.createDataFrame([("m", 0, i, *r) for i, r in enumerate(rows)], "media_id string, chunk_id int, word_idx long, start_cs long, end_cs long, text string")


def built(spark, rows):
    got = cuebuild.cues_from_words(words(spark, rows), cuebuild.CuePolicy(min_cs=80, max_cs=600, pause_cs=50)).orderBy("idx").collect()
    return [(r.start_cs, r.end_cs, r.text) for r in got]


def test_cjk_punctuation_ends_cues(spark):
    got = built(spark, [(5, 75, "先看左边的图，"), (75, 165, "再看右边。"), (230, 320, "都看完了。")])
    assert got == [(5, 165, "先看左边的图，再看右边。"), (230, 320, "都看完了。")]


def test_latin_spacing_and_pause(spark):
    assert built(spark, [(0, 40, " Tea"), (40, 95, " for"), (95, 130, " two"), (190, 260, " please"), (300, 300, "no length"), (300, 310, "")]) == [(0, 130, "Tea for two"), (190, 260, "please")]


def test_cjk_limit_keeps_marks_with_their_words(spark):
    got = built(spark, [(i * 100, i * 100 + 100, "东南西北。" if i == 4 else "春夏秋冬") for i in range(5)])
    assert len(got) >= 2 and all(len(t) <= 18 and not t.startswith("。") for *_, t in got)
    got = built(spark, [(0, 200, "山高月小水落石出江流有声断岸千尺"), (200, 250, "复游"), (250, 251, "。")])
    assert [t for *_, t in got] == ["山高月小水落石出江流有声断岸千尺", "复游。"]


def test_lengths_by_place_equal_slices():
    rng = random.Random(3)
    for _ in range(200):
        texts = [rng.choice([" word", "  ", " two  words ", "。", " end.", "日本", "\n", " ,", "x"]) for _ in range(rng.randrange(1, 14))]
        track = cuebuild._Track(list(range(len(texts))), list(range(1, len(texts) + 1)), texts, cuebuild.CuePolicy())
        for first in range(len(texts)):
            for last in range(first, len(texts)):
                plain = re.sub(r"\s+", " ", "".join(texts[first : last + 1])).strip()
                assert track.said(first, last) == plain and track.chars(first, last) == len(plain) and track.ends_marked(first, last) == plain.endswith(cuebuild.MARKS)


def test_a_long_key_takes_one_pass():
    n = 60_000
    track = cuebuild._Track([30 * i for i in range(n)], [30 * i + 25 for i in range(n)], [" word." if i % 9 == 8 else " word" for i in range(n)], cuebuild.CuePolicy())
    start = time.time()
    found = list(track.cues())
    assert time.time() - start < 10 and " ".join(t for *_, t in found) == " ".join(t.strip() for t in [" word." if i % 9 == 8 else " word" for i in range(n)])


def test_no_words_no_cues(spark):
    assert cuebuild.cues_from_words(words(spark, [(5, 5, "x")])).count() == 0


def test_tokens_wait_for_whole_characters(spark):
    b = "日本".encode()
    rows = [("m", 0, 0, 0, b[:2], 0, 5), ("m", 0, 0, 1, b[2:4], 5, 9), ("m", 0, 0, 2, b[4:], 9, 12), ("m", 0, 0, 3, b"\xff", 12, 13), ("m", 0, 0, 4, b"ok", 13, 15), ("m", 0, 0, 5, b[:1], 15, 16), ("m", 0, 1, 6, b"x", 16, 17)]
    tokens = spark.createDataFrame([(*r[:4], bytearray(r[4]), *r[5:]) for r in rows], "media_id string, chunk_id int, seg_idx int, tok_idx int, bytes binary, start_cs long, end_cs long")
    got = sorted((r.seg_idx, r.word_idx, r.start_cs, r.end_cs, r.text) for r in cuebuild.assemble_tokens(tokens).collect())
    assert got == [(0, 0, 0, 12, "日本"), (0, 1, 13, 15, "ok"), (1, 0, 16, 17, "x")]


def test_copies_at_window_borders_merge(spark):
    windows = spark.createDataFrame([("m", 0, 0, 3000), ("m", 1, 2800, 5000)], "media_id string, chunk_id int, start long, end long")
    rows = [("m", 0, 0, 0, 100, "First."), ("m", 0, 1, 270, 295, "Same words"), ("m", 1, 0, 281, 300, "same words here"), ("m", 1, 1, 300, 320, "same words here")]
    cues = spark.createDataFrame(rows, "media_id string, chunk_id int, pos int, start_cs long, end_cs long, text string")
    got = [(r.start_cs, r.end_cs, r.text) for r in cuebuild.dedup_boundary(cues, windows, 1000).orderBy("idx").collect()]
    assert got == [(0, 100, "First."), (270, 300, "same words here"), (300, 320, "same words here")]


def test_optimized_cues_never_overlap(spark):
    cues = spark.createDataFrame([("m", 1, 50, 400, "b " * 60), ("m", 2, -20, 90, " a "), ("m", 3, 380, 390, "c"), ("m", 4, 500, 480, "late")], "media_id string, idx int, start_cs long, end_cs long, text string")
    media = spark.createDataFrame([("m", 450)], "media_id string, duration_cs long")
    got = cuebuild.optimize_cues(cues, media, pad_cs=20).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(1, len(got) + 1)) and got[0].start_cs == 0 and got[-1].end_cs <= 450
    assert all(a.end_cs <= b.start_cs for a, b in zip(got, got[1:], strict=False)) and all(len(r.text) <= 42 for r in got)


def test_silent_media_take_fixed_windows(spark):
    frames = spark.createDataFrame([("a", i, 0.5 if 10 <= i < 20 else 0.001) for i in range(40)] + [("b", i, 0.0) for i in range(5)], "media_id string, frame_idx long, rms float")
    media = spark.createDataFrame([("a", 800), ("b", 100)], "media_id string, n_samples long")
    windows, plans = cuebuild.plan_windows(frames, media, frame=20, silence=40, min_speech=40, pad=30, size=150, overlap=20)
    assert {(r.media_id, r.strategy, r.regions, r.coverage) for r in plans.collect()} == {("a", "speech", 1, 0.25), ("b", "fixed-fallback", 0, 0.0)}
    assert sorted((r.media_id, r.chunk_id, r.start, r.end) for r in windows.collect()) == [("a", 0, 170, 320), ("a", 1, 300, 430), ("b", 0, 0, 100)]


def test_fixed_mode_looks_at_no_frames(spark):
    frames = spark.createDataFrame([("a", i, 0.5) for i in range(40)], "media_id string, frame_idx long, rms float")
    media = spark.createDataFrame([("a", 800), ("b", 0)], "media_id string, n_samples long")
    windows, plans = cuebuild.plan_windows(frames, media, frame=20, silence=40, min_speech=40, pad=30, size=150, overlap=20, mode="fixed", chunk=500)
    assert {tuple(r) for r in plans.collect()} == {("a", "fixed", 0, None, 0.0), ("b", "fixed", 0, None, 0.0)}
    assert sorted((r.chunk_id, r.start, r.end) for r in windows.collect()) == [(0, 0, 500), (1, 480, 800)]


def test_windows_choose_words_only_where_they_spell_the_segments(spark):
    schema = "media_id string, chunk_id int, idx int, text string"
    words_ = spark.createDataFrame([("a", 0, 0, "w"), ("a", 1, 0, "w"), ("b", 0, 0, "w")], schema)
    segments_ = spark.createDataFrame([(m, c, 0, "s") for m, c in (("a", 0), ("a", 1), ("a", 2), ("b", 0), ("c", 0))], schema)
    matched = spark.createDataFrame([("a", 0, True), ("a", 1, False), ("a", 2, True), ("b", 0, True), ("c", 0, True)], "media_id string, chunk_id int, matched boolean")
    cues, timing = cuebuild.choose_cues(words_, segments_, matched)
    assert sorted((r.media_id, r.chunk_id, r.text) for r in cues.collect()) == [("a", 0, "w"), ("a", 1, "s"), ("a", 2, "s"), ("b", 0, "w"), ("c", 0, "s")]
    assert {tuple(r) for r in timing.collect()} == {("a", "mixed", 3, 1), ("b", "word", 1, 1), ("c", "segment-fallback", 1, 0)}


def test_windows_with_their_cues_choose_alike_and_shuffle_none(spark):
    cue, rows = [("w",)], [("a", 0, [("w",)], True), ("a", 1, [("w",)], False), ("a", 2, None, True), ("b", 0, [("w",)], True), ("c", 0, [], True), ("c", 1, [("w",)], None)]
    windows = spark.createDataFrame([(m, c, w, [("s",)], ok) for m, c, w, ok in rows] + [("d", 0, cue, [], False)], "media_id string, chunk_id int, word_cues array<struct<text: string>>, segment_cues array<struct<text: string>>, matched boolean")
    cues, timing = cuebuild.choose_window_cues(windows)
    got = sorted((r.media_id, r.chunk_id, r.timing, r.cues[0].text) for r in cues.collect())
    f = "segment-fallback"
    assert got == [("a", 0, "word", "w"), ("a", 1, f, "s"), ("a", 2, f, "s"), ("b", 0, "word", "w"), ("c", 0, f, "s"), ("c", 1, f, "s")]
    assert {tuple(r) for r in timing.collect()} == {("a", "mixed", 3, 1), ("b", "word", 1, 1), ("c", f, 2, 0), ("d", f, 1, 0)}
    assert "Exchange" not in cues._jdf.queryExecution().executedPlan().toString()
