import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuelake.operators import rounds

CUES = "media_id string, pos long, cue_id long, start_ms long, end_ms long, text string"


def tracks(spark):
    return spark.createDataFrame([(m, i, i + 1, 2000 * i, 2000 * i + 1500, f"word {m} here") for m in ("a", "b", "c") for i in range(30)], CUES)


def answer(request):
    r = json.loads(request)
    return json.dumps({"cues": [{"cue_id": c["cue_id"], "text": c["source"].upper()} for c in r["cues"]], "issues": [{"cue_id": c["cue_id"], "kind": "other", "message": "x"} for c in r["cues"] if c["cue_id"] == 7]})


class Asker:
    """Answers on the driver, so that what was asked can be counted; may die after some requests, and leaves some unanswered."""

    def __init__(self, spark, dies_after=10**9, bad=lambda media, ids: False):
        self.spark, self.dies_after, self.bad, self.asked = spark, dies_after, bad, []

    def __call__(self, requests):
        out = []
        for r in requests.collect():
            ids = [c["cue_id"] for c in json.loads(r.request)["cues"]]
            if len(self.asked) >= self.dies_after:
                raise RuntimeError("the model is gone")
            self.asked.append((r.media_id, tuple(ids), json.loads(r.request)["stage"], json.loads(r.request)["retry"]))
            if not self.bad(r.media_id, ids):
                out.append((r.media_id, r.batch_id, answer(r.request)))
        return self.spark.createDataFrame(out, "media_id string, batch_id string, response string")


def review(spark, root, ask, **how):
    final, issues, errors, report = rounds.run_review(rounds.Store(spark, root), tracks(spark), ask, task="translation", target="fr", **how)
    texts = sorted((r.media_id, r.cue_id, r.text) for r in final.collect())
    return texts, sorted((r.media_id, r.cue_id, r.kind) for r in issues.collect()), sorted(tuple(r) for r in errors.collect()), {r.media_id: tuple(r)[1:] for r in report.collect()}


def test_rounds_ask_again_then_halve(spark, tmp_path):
    ask = Asker(spark, bad=lambda m, ids: (m == "b" and 25 in ids and len(ids) > 3) or (m == "c" and 30 in ids))
    texts, issues, errors, report = review(spark, f"file://{tmp_path}/r", ask)
    assert errors == [("c", 30)] and texts == [(m, i, f"WORD {m} HERE".upper()) for m in "ab" for i in range(1, 31)]
    assert issues == [("a", 7, "other"), ("b", 7, "other")]
    # b: 24 cues at once; 25 to 30 twice, then two halves.
    assert report["a"] == (2, 2, 30, 1) and report["b"] == (1 + 2 + 2, 1 + 2 + 2, 30, 1) and set(report) == {"a", "b"}
    assert not any(m == "c" and stage == "verify" for m, _, stage, _ in ask.asked)


def test_a_killed_run_goes_on_without_asking_again(spark, tmp_path):
    whole = Asker(spark)
    want = review(spark, f"file://{tmp_path}/whole", whole)
    first = Asker(spark, dies_after=4)
    with pytest.raises(RuntimeError):
        review(spark, f"file://{tmp_path}/killed", first, wave=1)
    second = Asker(spark)
    assert review(spark, f"file://{tmp_path}/killed", second, wave=1) == want
    twice = Counter(first.asked) + Counter(second.asked)
    assert set(twice) == set(whole.asked) and sum(twice.values()) - len(whole.asked) <= 3  # at most the wave under way is asked anew
    third = Asker(spark)
    assert review(spark, f"file://{tmp_path}/killed", third, wave=1) == want and not third.asked


def test_model_in_tasks(spark):
    requests = spark.createDataFrame([("a", "0", "x"), ("a", "1", "y")], "media_id string, batch_id string, request string")
    got = rounds.ask_model(requests, lambda texts: [t.upper() for t in texts], prompt=lambda c: F.concat(F.lit("say "), c))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "0", "SAY X"), ("a", "1", "SAY Y")]
