"""Queries on tables that hold what the small ones do not: larger keys, plans that must not grow."""

import duckdb

from cuelake.plans import protocol_queries


def test_probe_of_a_part_whose_frame_count_holds_the_height(spark, tmp_path):
    """Part 36016 has 108048 frames."""
    path = str(tmp_path / "part.parquet")
    duckdb.sql(f"copy (select k::bigint as p_partkey, 5 as p_size from (values (36016), (36934), (7), (8)) t(k)) to '{path}' (format parquet)")
    got = {(r.media_id, r.reason) for r in protocol_queries.QUERIES["media_probe"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{path}'")
    want = {(r.media_id, r.reason) for r in con.sql(protocol_queries.ORACLES["media_probe"]).df().itertuples()}
    assert got == want == {(36016, "fields"), (36934, "fields"), (7, "fields"), (8, "")}


def test_windows_shuffle_nothing_and_equal_rows(spark):
    """Words, segments and tokens that come as arrays give what their rows give, without an exchange."""
    from pyspark.sql import functions as F

    from cuelake.operators import cuebuild, transcript

    words = [(m, c, i, 30 * i, 30 * i + (25 if i % 4 else 0), t) for m, c, said in ((1, 0, " One two. three"), (1, 1, " four 今天"), (2, 0, "")) for i, t in enumerate(said.split("_") if m == 2 else [f" {x}" for x in said.split()])]
    w = spark.createDataFrame(words, "media_id long, chunk_id long, word_idx long, start_cs long, end_cs long, text string")
    s = spark.createDataFrame([(1, 0, 0, "one"), (1, 0, 1, "two three"), (1, 1, 0, "four x"), (3, 0, 0, "five")], "media_id long, chunk_id long, seg_idx long, text string")
    key = ["media_id", "chunk_id"]
    gather = lambda df, name, *c: df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*c))).alias(name))
    table = gather(w, "words", "word_idx", "start_cs", "end_cs", "text").join(gather(s, "segments", "seg_idx", "text"), key, "full")
    windows = spark.createDataFrame(table.collect(), table.schema)
    rows = lambda df: sorted(map(tuple, df.collect()))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for by_row, by_window in ((transcript.words_match_segments(w, s), transcript.windows_match_segments(windows)), (cuebuild.cues_from_words(w), cuebuild.cues_from_windows(windows))):
        assert rows(by_row) == rows(by_window) != []
        assert "Exchange" not in plan(by_window)


def test_batches_of_tokens_equal_the_walk(spark):
    """Sound and broken texts, empty tokens and open tails side by side."""
    from cuelake.operators import cuebuild

    raw = ["今天 we 🎉 go".encode(), b"ab\xff\xe4\xbb\x8acd", "é今".encode()[:-1], b"", b"abc"]
    cut = {i: [r[k : k + 2] for k in range(0, len(r), 2)] + ([b""] if i % 2 else []) for i, r in enumerate(raw)}
    cut[5] = [b"", b"a", b"", b"\xc3", b"", b"\xa9"]
    tokens = [(i, [{"bytes": b, "start_cs": 2 * k, "end_cs": 40 - k} for k, b in enumerate(p)]) for i, p in cut.items()]
    got = cuebuild.assemble_segments(spark.createDataFrame(tokens, "media_id long, tokens array<struct<bytes: binary, start_cs: bigint, end_cs: bigint>>").coalesce(1), ("media_id",)).collect()
    want = {i: cuebuild._walked([t["bytes"] for t in p], [t["start_cs"] for t in p], [t["end_cs"] for t in p]) for i, p in tokens}
    assert {r.media_id: [x.asDict() for x in r.words] for r in got} == want
    assert [x["text"] for x in want[5]] == ["a", "é"]


def test_edits_are_judged_once(spark):
    """A draft's edit runs through one join and one pass of quantities; cues without a source stay as they are."""
    from cuelake.operators import protocol

    make = lambda rows: spark.createDataFrame(rows, "media_id long, cue_id long, text string")
    judged = protocol.judge_edits(make([(1, 1, "it is 5"), (1, 2, "it is 5"), (1, 3, None)]), make([(1, 1, "it is 6"), (1, 2, "it was 5"), (1, 3, None), (1, 4, "new 7")]))
    assert sorted((r.cue_id, r.text, r.unsafe) for r in judged.collect()) == [(1, "it is 5", True), (2, "it was 5", False), (3, None, False), (4, "new 7", False)]
    assert judged._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_places_that_cannot_begin_a_quantity_are_not_tried():
    """A long text of other letters takes one search, not a match at every letter."""
    import time

    from cuelake.functions import numbers

    text = "another lantern stands near the northern sea " * 20_000 + "one hundred and five"
    start = time.process_time()
    assert list(numbers.quantities_of(text)) == [(105.0, False)]
    took = time.process_time() - start
    start = time.process_time()
    for at in range(len(text)):
        numbers.RUN.match(text, at), numbers._english(text, at)
    assert took < (time.process_time() - start) / 2
