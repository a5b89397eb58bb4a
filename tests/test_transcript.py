import random

from pyspark.sql import functions as F

from cuelake.operators import transcript

def test_pieces_keep_text_and_limits():
    rng = random.Random(5)
    for _ in range(300):
        text, size = "".join(rng.choices("ab 漢,.", [6, 6, 3, 2, 1, 1], k=rng.randrange(1, 90))), rng.choice([1, 5, 18, 42])
        got = list(transcript.pieces(text, size))
        assert "".join("".join(got).split()) == "".join(text.split()) and all(0 < len(p) <= size for p in got)
    assert list(transcript.pieces("abcdefgh ij", 10)) == ["abcdefgh", "ij"] and list(transcript.pieces("abcd, efgh", 4)) == ["abc", "d,", "efgh"]
    assert list(transcript.pieces("  ", 1)) == [] and len(list(transcript.pieces("word " * 50_000, 40))) == 6250


def test_long_cues_keep_text_and_time(spark):
    rows = [("m", 0, 1, 0, 300, "a " * 50 + "end"), ("m", 1, 2, 300, 301, "b" * 90), ("m", 2, 3, 400, 2000, "one two three four"), ("m", 3, 4, 2000, 2100, "short"), ("m", 4, 5, 2100, 2200, None)]
    got = transcript.split_long_cues(spark.createDataFrame(rows, "media_id string, pos int, idx int, start_cs long, end_cs long, text string")).orderBy("pos", "part").collect()
    by = {p: [r for r in got if r.pos == p] for p in range(5)}
    assert len(by[0]) == 3 and by[0][0].start_cs == 0 and by[0][-1].end_cs == 300 and " ".join(r.text for r in by[0]) == rows[0][5]
    assert all(a.end_cs == b.start_cs for p in by.values() for a, b in zip(p, p[1:], strict=False))
    assert len(by[1]) == 1 and len(by[2]) == 3 and len(by[3]) == 1 and [r.text for r in by[4]] == [None]


def test_words_against_segments(spark):
    words = [("m", 0, 0, " Hello"), ("m", 0, 1, ", world"), ("m", 1, 0, " left"), ("m", 1, 1, " over"), ("m", 2, 0, " alone")]
    segs = [("m", 0, 0, "Hello,"), ("m", 0, 1, "world!"), ("m", 1, 0, "left")]
    w = spark.createDataFrame(words, "media_id string, chunk_id int, word_idx long, text string")
    s = spark.createDataFrame(segs, "media_id string, chunk_id int, seg_idx long, text string")
    got = transcript.words_match_segments(w, s)
    assert {(r.chunk_id, r.matched) for r in got.collect()} == {(0, True), (1, False), (2, False)}
    assert transcript.choose_timing(got).first().timing == "mixed"


def test_clamping(spark):
    t = spark.createDataFrame([(1, 100, 50, 10, 10), (2, 100, 50, 50, 60), (3, 100, 50, 40, 90), (9, 100, 50, 0, 5)], "token_id int, chunk_cs long, chunk_len long, start_cs long, end_cs long")
    assert sorted((r.token_id, r.start_cs, r.end_cs) for r in transcript.clamp_tokens(t, eot=9).collect()) == [(1, 110, 111), (3, 140, 150)]
    s = t.withColumn("text", F.when(F.col("token_id") == 9, "  ").otherwise(" x "))
    assert [(r.token_id, r.start_cs, r.end_cs, r.text) for r in transcript.clamp_segments(s).collect()] == [(3, 140, 150, "x")]


def test_audio_streams(spark):
    schema = "media_id string, audio array<struct<codec:string,sample_rate:int,channels:int>>"
    a = spark.createDataFrame([("x", [("aac", 48000, None)]), ("y", [("aac", 48000, 2)]), ("z", None)], schema)
    b = spark.createDataFrame([("x", [("aac", 48000, None)]), ("y", [("aac", 44100, 2)]), ("z", [("aac", 1, 1)])], schema)
    assert {tuple(r) for r in transcript.audio_streams_equal(a, b).collect()} == {("x", 1, True, True), ("y", 1, True, False), ("z", 0, False, False)}
