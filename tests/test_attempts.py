from pyspark.sql import functions as F

from cuelake.operators import attempts, rounds


def staged(spark, root, gives, detected, rows, dies_at=99):
    """gives: (media_id, attempt_no) to a number of cues."""
    asked = []

    def decode(plan):
        some = plan.collect()
        if any(r.attempt_no >= dies_at for r in some):
            raise RuntimeError("decoder is gone")
        asked.extend((r.media_id, r.attempt_no, r.language, r.decoding) for r in some)
        cues = [(r.media_id, i) for r in some for i in range(gives.get((r.media_id, r.attempt_no), 0))]
        return spark.createDataFrame(cues, "media_id string, pos int")

    detect = lambda m: m.withColumn("detected", F.create_map(*[F.lit(x) for kv in detected.items() for x in kv])[F.col("media_id")])
    media = spark.createDataFrame(rows, "media_id string, language string")
    out = attempts.decode_in_stages(rounds.Store(spark, root), media, decode, detect)
    chosen = {r.media_id: (r.attempt_no, r.language, r.decoding, r.fallback_language, r.fallback_decoding, r.n_cues) for r in out.chosen.collect()}
    return chosen, {r.media_id: (r.n_attempts, r.summary) for r in out.failed.collect()}, out.cues.count(), asked


ROWS = [("a", "en"), ("b", None), ("c", "en"), ("d", "en"), ("e", None), ("f", "en")]
FOUND = {"a": "fr", "b": "de", "c": "fr", "d": "en", "e": "de", "f": "fr"}
GIVES = {("a", 1): 2, ("b", 2): 3, ("c", 3): 1, ("f", 4): 5}


def test_stages_run_only_where_cues_are_missing(spark, tmp_path):
    chosen, failed, n, asked = staged(spark, f"file://{tmp_path}/s", GIVES, FOUND, ROWS)
    assert chosen == {"a": (1, "en", "beam", False, False, 2), "b": (2, "de", "greedy", False, True, 3), "c": (3, "fr", "beam", True, False, 1), "f": (4, "fr", "greedy", True, True, 5)}
    assert failed == {"d": (2, "en beam | en greedy"), "e": (2, "de beam | de greedy")} and n == 11
    assert len(asked) == 6 + 5 + 2 + 1 and sorted(m for m, no, *_ in asked if no == 3) == ["c", "f"]


def test_stages_resume(spark, tmp_path):
    try:
        staged(spark, f"file://{tmp_path}/s", GIVES, FOUND, ROWS, dies_at=3)
        raise AssertionError("should have died")
    except RuntimeError:
        pass
    chosen, failed, n, asked = staged(spark, f"file://{tmp_path}/s", GIVES, FOUND, ROWS)
    assert n == 11 and set(chosen) == {"a", "b", "c", "f"} and {no for _, no, *_ in asked} == {3, 4}


def test_no_items(spark, tmp_path):
    chosen, failed, n, asked = staged(spark, f"file://{tmp_path}/s", {}, FOUND, [])
    assert (chosen, failed, n) == ({}, {}, 0)
