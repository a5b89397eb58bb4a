import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators import cuebuild, protocol, review, scan, segments


def test_scans_carry_over_blocks(spark):
    rng = random.Random(1)
    rows = [(m, i * 3 + rng.randrange(3), rng.randrange(9)) for m in range(4) for i in range([1, 7, 60, 200][m])]
    df = spark.createDataFrame(rows, "m int, at int, v int")
    got = scan.along(df, ["m"], ["at"], F.floor(F.col("at") / 50), nth="nth", sums={"total": F.col("v")}, maxima={"most": F.col("v")}, before={"prior": ["v", "at"]})
    for m in range(4):
        total, most, prior = 0, None, None
        for i, r in enumerate(sorted((r for r in got.collect() if r.m == m), key=lambda r: r["at"])):
            total += r.v
            assert (r.nth, r.total, r.most, r.prior and tuple(r.prior)) == (i, total, most, prior)
            most, prior = r.v if most is None else max(most, r.v), (r.v, r["at"])
    assert scan.along(df.limit(0), ["m"], ["at"], F.floor(F.col("at") / 50), nth="nth").count() == 0


@pytest.mark.parametrize("block", [8, 16, 1024])
def test_cuts_over_blocks_equal_a_loop(spark, block):
    rng, rows, want = random.Random(2), [], {}
    for m, n in enumerate([1, 5, 64, 65, 700]):
        k = size = piece = 0
        for i in range(n):
            s, forced = rng.choice([0, 1, 5, 30, 60, 200]), rng.random() < (0.1 if m % 2 else 0)
            if i and (k >= 8 or size + s > 150 or forced):
                piece, k, size = piece + 1, 0, 0
            k, size = k + 1, size + s
            want[m, i] = piece
            rows.append((m, i, s, forced))
    df = spark.createDataFrame(rows, "m int, nth int, size int, forced boolean")
    assert {(r.m, r.nth): r.piece for r in scan.cut(df, ["m"], most=8, room=150, block=block).collect()} == want
    assert scan.cut(df.limit(0), ["m"], most=8, room=150).count() == 0


def test_batches_of_a_long_item(spark):
    texts = ["x" * (i * 37 % 900) for i in range(5000)]
    cues = spark.createDataFrame([("m", 2 * i, t) for i, t in enumerate(texts)], "media_id string, pos long, text string")
    want, n, chars, batch = {}, 0, 0, 0
    for i, t in enumerate(texts):
        if n and (n >= 24 or chars + len(t) > 8000):
            n, chars, batch = 0, 0, batch + 1
        n, chars, want[2 * i] = n + 1, chars + len(t), batch
    assert {r.pos: r.batch_id for r in review.batch_cues(cues).collect()} == want


def test_utterances_of_a_long_item(spark):
    rng, rows, at = random.Random(3), [], 0
    for i in range(3000):
        at += rng.choice([0, 100, 1500, 1501])
        rows.append(("m", i, at, at + 200, rng.choice(["and so", "it ends.", 'he said "yes!" ', "long " * 200, "", "等等。"])))
        at += 200
    want, n, chars, number, last = {}, 0, 0, 0, 0
    for _, i, s, e, t in rows:
        if n and (n >= 32 or chars + len(t) + 1 > 8000 or s - last > 1500):
            number, n, chars = number + 1, 0, 0
        want[i], n, chars, last = number, n + 1, chars + len(t) + 1, e
        if t.rstrip().rstrip("\"'”’)]").endswith((".", "!", "?", "。", "！", "？")):
            number, n, chars = number + 1, 0, 0
    df = spark.createDataFrame(rows, "media_id string, pos int, start_ms long, end_ms long, text string")
    assert {r.pos: r.utterance for r in protocol.utterances(df).collect()} == want


def test_streams_cross_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(200).select((F.col("id") % 3).alias("k"), "id")
        got = scan.stream(df, ["k"], ["id"], lambda cols: [(len(cols[0]), cols[0] == sorted(cols[0]))], "n long, sorted boolean")
        assert sorted(tuple(r) for r in got.collect()) == [(0, 67, True), (1, 67, True), (2, 66, True)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def naive_copies(cues, windows):
    """One cue after the other against the last one kept."""
    kept = []
    for chunk, pos, s, e, text in sorted(cues):
        lo, hi = windows[chunk]
        key = "".join(c for c in text.lower() if c.isalnum())
        if kept:
            c2, s2, e2, t2, k2 = kept[-1]
            lo2, hi2 = max(windows[c2][0], lo), min(windows[c2][1], hi)
            x, y = sorted((k2, key), key=len)
            if c2 != chunk and lo2 < hi2 and all(a < hi2 and b > lo2 for a, b in ((s2, e2), (s, e))) and key and (x == y or (len(x) >= 4 and x in y)) and s <= e2 + cuebuild.SLACK_CS:
                t, k = (text, key) if len(text) > len(t2) else (t2, k2)
                kept[-1] = (chunk, min(s, s2), max(e, e2), t, k)
                continue
        kept.append((chunk, s, e, text, key))
    return [(i + 1, c, s, e, t) for i, (c, s, e, t, _) in enumerate(kept)]


def test_boundary_copies_of_a_long_item(spark):
    rng = random.Random(4)
    windows = {c: (c * 100, c * 100 + 150) for c in range(300)}
    cues = []
    for c, (lo, _) in windows.items():
        for p in range(rng.choice([0, 1, 1, 2, 4])):
            s = lo + rng.randrange(140)
            cues.append((c, p, s, s + rng.choice([5, 30, 60]), rng.choice(["same words", "same words here", "Same, words!", "other", "...", "abc"])))
    df = spark.createDataFrame([("m", *c) for c in cues], "media_id string, chunk_id int, pos int, start_cs long, end_cs long, text string")
    w = spark.createDataFrame([("m", c, lo, hi) for c, (lo, hi) in windows.items()], "media_id string, chunk_id int, start long, end long")
    got = sorted(tuple(r)[1:] for r in cuebuild.dedup_boundary(df, w, 100).collect())
    assert got == naive_copies(cues, windows) and len(got) < len(cues)


def test_order_statistics_are_exact(spark):
    rng = random.Random(5)
    values = {0: [0.0] * 500 + [rng.random() for _ in range(301)], 1: [float("nan"), None, float("inf"), -float("inf"), 1.0], 2: [3.5], 3: [rng.gauss(0, 1) ** 3 for _ in range(2000)]}
    df = spark.createDataFrame([(m, v) for m, vs in values.items() for v in vs], "media_id int, rms double")
    key = lambda v: (0, 0) if v is None else (2, 0) if v != v else (1, v)
    for bins in (1, 7, 1024):
        got = {(r.media_id, r.percent): key(r.level) for r in segments.order_statistics(df, "rms", (0, 20, 90, 100), bins).collect()}
        assert got == {(m, p): key(sorted(vs, key=key)[(len(vs) - 1) * p // 100]) for m, vs in values.items() for p in (0, 20, 90, 100)}


def test_intervals_of_one_item_merge_over_spans(spark):
    rng = random.Random(6)
    rows = [(s := rng.randrange(20_000), s + rng.choice([1, 5, 40, 900])) for _ in range(900)]
    want = []
    for s, e in sorted(rows):
        if want and s - want[-1][1] <= 6:
            want[-1][1] = max(want[-1][1], e)
        else:
            want.append([s, e])
    df = spark.createDataFrame([("m", *r) for r in rows], "media_id string, start long, end long")
    assert sorted([r.start, r.end] for r in segments.merge_intervals(df, 6, span=100).collect()) == want
