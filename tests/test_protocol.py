import hashlib
import json

from pyspark.sql import functions as F

from cuelake.operators import project, protocol, qa, review, rounds
from cuelake.sources import decoder, files, srt


def test_neighbours_cross_small_batches(spark):
    rows = spark.createDataFrame([("m", i, i) for i in range(5)], "media_id string, pos int, batch_id int")
    got = sorted(r.pos for r in qa.neighbours(rows, 2).where("batch_id = 2").collect())
    assert got == [0, 1, 3, 4]


def test_blank_and_missing_cues(spark):
    cues = spark.createDataFrame([("a", 0, 1, 0, 1000, None)], "media_id string, pos int, cue_id int, start_ms long, end_ms long, text string")
    media = spark.createDataFrame([("a", 2000), ("b", 2000)], "media_id string, duration_ms long")
    got = {(r.media_id, r.pos, r.kind) for r in qa.check_cues(cues, media).collect()}
    assert got == {("a", 0, "blank"), ("b", None, "no_cues")}


def test_response_faults(spark):
    requests = spark.createDataFrame([("m", b, [7, 42]) for b in range(6)], "media_id string, batch_id int, cue_ids array<long>")
    good = '{"cues":[{"cue_id":42,"text":"b\\r\\nc"},{"cue_id":7,"text":" a "}],"issues":[]}'
    texts = [good, "no json", good.replace("42", "41"), good.replace('"b\\r\\nc"', '"b\\n\\nc"'), good.replace("[]", '[{"cue_id":9,"kind":"other","message":"x"}]'), good.replace('" a "', '" a ","x":"y"')]
    responses = spark.createDataFrame([("m", b, t) for b, t in enumerate(texts)], "media_id string, batch_id int, response string")
    got = {r.batch_id: r for r in protocol.validate_responses(requests, responses).collect()}
    assert [got[b].fault for b in range(6)] == [None, "json", "ids", "text", "issues", "fields"]
    assert {c.cue_id: c.text for c in got[0].cues} == {42: "b\nc", 7: "a"}


def test_failed_batches_are_asked_again_then_halved(spark):
    batches = spark.createDataFrame([("m", i, "a") for i in range(3)] + [("m", 3, "b"), ("m", 4, "c")], "media_id string, pos int, batch_id string")
    failed = spark.createDataFrame([("m", "a", 2), ("m", "b", 2), ("m", "c", 1)], "media_id string, batch_id string, attempt int")
    again, errors = protocol.next_round(batches, failed)
    assert sorted((r.pos, r.batch_id, r.attempt) for r in again.collect()) == [(0, "a.0", 1), (1, "a.1", 1), (2, "a.1", 1), (4, "c", 2)]
    assert [r.pos for r in errors.collect()] == [3]


def test_utterances_end_at_stops_and_pauses(spark):
    rows = [("m", 0, 0, 10, "One"), ("m", 1, 10, 20, 'two."'), ("m", 2, 20, 30, "three"), ("m", 3, 1531, 1540, "four"), ("m", 4, 1540, 1550, "x" * 7999)]
    cues = spark.createDataFrame(rows, "media_id string, pos int, start_ms long, end_ms long, text string")
    assert [r.utterance for r in protocol.utterances(cues).orderBy("pos").collect()] == [0, 0, 1, 2, 3]


def test_guard_takes_back_unsafe_edits(spark):
    cols = "media_id string, cue_id int, text string"
    source = spark.createDataFrame([("m", 1, "about 20 people"), ("m", 2, "hello there friend"), ("m", 3, "a b")], cols)
    draft = spark.createDataFrame([("m", 1, "About 30 people"), ("m", 2, "Hello there, friend."), ("m", 3, "a\nb")], cols)
    kept, found = protocol.guard_edits(source, draft)
    assert [r.text for r in kept.orderBy("cue_id").collect()] == ["about 20 people", "Hello there, friend.", "a b"]
    assert sorted(r.cue_id for r in found.collect()) == [1, 3]


def test_acceptance_needs_a_note_and_the_same_hashes(spark):
    mark = lambda *v: F.struct(*[F.lit(x).alias(k) for k, x in zip(project.FINGERPRINT, v, strict=True)])
    p = spark.createDataFrame([("a",), ("b",), ("c",)], "project string").withColumn("fingerprint", mark("s", "s", "r", None, None))
    acc = p.withColumns({"at": F.lit(1), "note": F.when(F.col("project") == "b", " ").otherwise("ok"), "fingerprint": F.when(F.col("project") == "c", mark("s", "s", "r", None, "x")).otherwise(F.col("fingerprint"))})
    assert {(r.project, r.accepted) for r in project.acceptance_valid(p, acc).collect()} == {("a", True), ("b", False), ("c", False)}


def test_decoder_files(spark, tmp_path):
    digest = "SHA256:" + "a" * 64
    files = spark.createDataFrame([("ok", f"x|size=1|size=2|data_hash={digest}|pts_time=N/A|dts_time=0.5\n\n"), ("bad", f"size=-1|data_hash={digest}"), ("nan", f"size=1|data_hash={digest}|pts_time=nan")], "media_id string, content string")
    packets, rejects = decoder.packet_manifest(files)
    assert [tuple(r) for r in packets.collect()] == [("ok", 0, digest, 2, None, 0.5, None)] and {r.media_id for r in rejects.collect()} == {"bad", "nan"}
    probe = '{"streams":[{"codec_type":"audio","sample_rate":"x","channels":2},{"codec_type":"video","width":4,"height":3,"avg_frame_rate":"0/0","nb_frames":"N/A"}],"format":{"duration":"2.5","extra":1}}'
    probes, rejects = decoder.media_probe(spark.createDataFrame([("p", probe), ("q", "{}"), ("r", probe.replace('"2.5"', '"inf"')), ("s", probe + "x"), ("t", None)], "media_id string, content string"))
    r = probes.collect()
    assert len(r) == 1 and (r[0].fps, r[0].frame_count, r[0].video_stream_count, r[0].audio[0].codec, r[0].audio[0].sample_rate) == (None, None, 1, "unknown", None)
    assert {(x.media_id, x.reason) for x in rejects.collect()} == {("q", "fields"), ("r", "duration"), ("s", "json"), ("t", "json")}
    report = '{"schema_version":1,"targets":[{"language":"fr","review":{"stage":"translation","changed_cues":2,"issues":[]}}]}'
    single = '{"schema_version":1,"stage":"transcription","model":"m","changed_cues":1,"issues":[{"cue_id":3,"kind":"other","message":"x"}]}'
    found, rejects = decoder.review_reports(spark.createDataFrame([("r", report), ("s", single), ("t", single.replace("3", '"3"'))], "media_id string, content string"))
    assert sorted((x.media_id, x.language, x.stage, x.changed_cues, [tuple(i) for i in x.issues]) for x in found.collect()) == [("r", "fr", "translation", 2, []), ("s", None, "transcription", 1, [(3, "other", "x")])]
    assert [tuple(x) for x in rejects.collect()] == [("t", "fields")]
    decoder.write_reports(found, str(tmp_path / "reports"))
    again, rejects = decoder.review_reports(decoder.whole_files(spark, str(tmp_path / "reports" / "*" / "*.txt")))
    assert sorted((x.stage, x.changed_cues) for x in again.collect()) == [("transcription", 1), ("translation", 2)] and rejects.count() == 0
    fits, over = decoder.contexts(spark.createDataFrame([("a", "x" * 32_000), ("b", "é" * 32_001)], "media_id string, content string"))
    assert [r.media_id for r in fits.collect()] == ["a"] and [r.media_id for r in over.collect()] == ["b"]
    cues = spark.createDataFrame([("m", 0, 7, 0, 1500, "Hi\n there")], "media_id string, pos int, cue_id long, start_ms long, end_ms long, text string")
    srt.write_srt(cues, str(tmp_path / "out"))
    read, rejected = srt.read_srt(spark, str(tmp_path / "out" / "*" / "*.txt"))
    assert [(r.cue_id, r.start_ms, r.end_ms, r.text) for r in read.collect()] == [(7, 0, 1500, "Hi\nthere")] and rejected.count() == 0


def folder_hash(entries):
    """entries: name to text, or to a folder of the same kind."""
    whole = b""
    for name, value in sorted(entries.items(), key=lambda kv: kv[0].encode()):
        own = folder_hash(value) if isinstance(value, dict) else json.dumps(json.loads(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False) if name == "preset.json" else hashlib.sha256(value.encode()).hexdigest()
        whole += name.encode() + b"\x00" + own.encode()
    return hashlib.sha256(whole).hexdigest()


def test_bundle_hashes_names_and_contents(spark):
    flat, deep = {"b": "two", "a": "one", "é": ""}, {"x": {"y": {"z": "1", "preset.json": '{"b": 1.50, "a": ["é", null]}'}, "w": "2"}, "v": "3", "preset.json": " {} "}

    def listed(entries, before=""):
        for k, v in entries.items():
            yield from listed(v, f"{before}{k}/") if isinstance(v, dict) else [(f"{before}{k}", v)]

    rows = [(b, *f) for b, files in (("flat", flat), ("deep", deep)) for f in listed(files)] + [("bad", "preset.json", "{'a': 1}"), ("bad", "c", "d"), ("nan", "x/preset.json", '{"a": NaN}')]
    got = {r.bundle: r.sha256 for r in project.bundle_sha256(spark.createDataFrame(rows, "bundle string, name string, content string")).collect()}
    assert got == {"flat": folder_hash(flat), "deep": folder_hash(deep), "bad": None, "nan": None}
    assert project.bundle_sha256(spark.createDataFrame([], "bundle string, name string, content string")).count() == 0


def test_files_that_changed(spark, tmp_path):
    for name, text in {"same": "a", "other": "b", "large": "c" * 100}.items():
        (tmp_path / name).write_text(text)
    at = {r.path.rsplit("/", 1)[1]: r.path for r in files.file_hashes(spark, str(tmp_path), 50).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    recorded = [("p", at["same"], sha("a")), ("p", at["other"], sha("x")), ("p", at["large"], sha("c" * 100)), ("p", at["same"] + "x", sha("a"))]
    got = files.changed_files(spark, spark.createDataFrame(recorded, "project string, path string, sha256 string"), str(tmp_path), 50).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.fault) for r in got) == [("large", "oversize"), ("other", "changed"), ("samex", "missing")]


def test_decoder_output_is_read_whole_or_rejected(spark):
    good = '{"language":"en","duration":2,"duration_after_vad":1.5,"segments":[{"text":" hi ","start":0,"end":1.26,"id":4},{"text":" ","start":1,"end":2}],"words":[{"text":" hi","start":0.1,"end":0.5}],"more":1}'
    texts = [good, good + "}", good.replace("1.26", "null"), good.replace('"words"', '"word"'), good.replace('"end":0.5', '"end":"0.5"')]
    segments, words, headers, rejects = decoder.asr_tables(spark.createDataFrame(list(enumerate(texts)), "media_id int, content string"))
    assert [tuple(r) for r in segments.collect()] == [(0, 1, 0, 126, "hi")] and [tuple(r) for r in words.collect()] == [(0, 0, 10, 50, " hi")] and [tuple(r) for r in headers.collect()] == [(0, "en", 200, 150)]
    assert sorted(tuple(r) for r in rejects.collect()) == [(1, "json"), (2, "fields"), (3, "fields"), (4, "fields")]


def test_acceptances_count_only_in_a_state_that_allows_them(spark):
    p = spark.createDataFrame([("a", "x"), ("b", "x")], "project string, fingerprint string")
    rows = [("a", 1, "ok", "x", "review_required"), ("a", 2, "ok", "y", "translation_stale"), ("b", 1, "ok", "x", "source_review_pending")]
    acc = spark.createDataFrame(rows, "project string, at int, note string, fingerprint string, state string")
    assert {(r.project, r.accepted) for r in project.acceptance_valid(p, acc).collect()} == {("a", True), ("b", False)}
    assert {(r.project, r.accepted) for r in project.acceptance_valid(p, acc.drop("state")).collect()} == {("a", False), ("b", True)}


def test_first_revision_of_a_kind(spark):
    revisions = spark.createDataFrame([("p", "source", 1), ("p", "target", 0)], "project string, kind string, n int")
    kinds = spark.createDataFrame([("q", "source"), ("p", "source")], "project string, kind string")
    assert {(r.project, r.name) for r in review.next_revision(revisions, kinds).collect()} == {("p", "source-0002"), ("p", "target-0001"), ("q", "source-0001")}


def test_context_takes_an_utterance_on_either_side_while_it_fits(spark):
    big = "y" * 7997 + "."
    texts = ["One", "two.", "three.", "four.", "x.", big, big, big, big, "z."]
    cues = spark.createDataFrame([("m", i, 100 + i, 10 * i, 10 * i + 10, t) for i, t in enumerate(texts)], "media_id string, pos int, cue_id long, start_ms long, end_ms long, text string")
    batches = spark.createDataFrame([("m", 2, 0)] + [("m", p, 1) for p in range(5, 9)], "media_id string, pos int, batch_id int")
    got = protocol.utterance_context(batches, cues).orderBy("batch_id", "utterance").collect()
    assert [(r.utterance, r.context_only, r.cue_ids, r.text) for r in got if r.batch_id == 0] == [(0, True, [100, 101], "One two."), (1, False, [102], "three."), (2, True, [103], "four.")]
    assert [(r.context_only, r.cue_ids) for r in got if r.batch_id == 1] == [(True, [104]), *[(False, [p]) for p in range(105, 109)]]


def test_verification_passes_only_if_all_parts_do(spark):
    video = spark.createDataFrame([(m, True, True, True, None if m == 1 else True) for m in range(1, 8)], "media_id int, same_size boolean, one_stream boolean, same_duration boolean, same_frames boolean")
    audio = spark.createDataFrame([(1, 2, True, True), (2, 0, True, False), (3, 1, True, True), (4, 1, True, True), (6, 0, True, True), (7, 2, True, True)], "media_id int, n_streams long, same_count boolean, same_streams boolean")
    packets = spark.createDataFrame([(1, 1, 5, 5, None), (1, 0, 3, 3, None), (3, 0, 3, 3, 2), (4, 0, 3, 4, None), (7, 1, 5, 5, None)], "media_id int, stream int, n_source long, n_output long, first_bad int")
    got = {r.media_id: (r.passed, r.streams and [tuple(x) for x in r.streams]) for r in project.verification_report(video, audio, packets).collect()}
    # 5 has no audio verdict, 7 no packets of a stream: both fail. 6 has no audio at all.
    assert got == {1: (True, [(0, 3, 3), (1, 5, 5)]), 2: (False, None), 3: (False, [(0, 3, 3)]), 4: (False, [(0, 3, 4)]), 5: (False, None), 6: (True, None), 7: (False, [(1, 5, 5)])}


def test_answers_that_only_look_like_json(spark):
    good = '{"cues":[{"cue_id":42,"text":"b"},{"cue_id":7,"text":"a"}],"issues":[{"cue_id":7,"kind":"other","message":"m"}]}'
    forms = {
        good: None, f" {good}\n": None, good + " done": "json", good + good: "json", good + "]": "json", good + ",1": "json", good.replace('"', "'"): "json", good.replace('"text":"a"', '"text":"a","text":"b"'): "json",
        good.replace('"a"', "5"): "fields", good.replace('"a"', '{"x":"y"}'): "fields", good.replace('"m"', "5"): "fields", good.replace("42", "42.0"): "fields", good.replace("42", '"42"'): "fields", good.replace('"a"', "null"): "fields",
        good.replace('"issues"', '"d":1,"issues"'): "fields", '{"cues":[]}': "fields", f"[{good}]": "fields", '{"cues":{},"issues":[]}': "fields", '{"cues":[],"issues":[]}': "count", "": "json", None: "json", "null": "fields",
        good.replace('"a"', '"\\ud800"'): "json", good.replace('"a"', '"\\ud83d\\ude00"'): None, good.replace('"a"', '"\\\\ud800"'): None,
    }
    requests = spark.createDataFrame([(1, b, [7, 42]) for b in range(len(forms))], "media_id int, batch_id int, cue_ids array<long>")
    responses = spark.createDataFrame([(1, b, t) for b, t in enumerate(forms)], "media_id int, batch_id int, response string")
    got = {r.batch_id: r.fault for r in protocol.validate_responses(requests, responses).collect()}
    assert [got[b] for b in range(len(forms))] == list(forms.values())


def test_what_the_model_reports_is_kept(spark):
    source = spark.createDataFrame([("m", 0, 1, 0, 2000, "one"), ("m", 1, 2, 2000, 4000, "two"), ("m", 2, 3, 4000, 6000, "three")], "media_id string, pos int, cue_id int, start_ms long, end_ms long, text string")
    seen = []

    def ask(base, draft, known):
        seen.append(sorted((r.cue_id, r.kind) for r in known.collect()))
        kinds = {1: "uncertain_transcript", 2: "readability"} if draft is None else {3: "other"}
        texts = base.select("media_id", "cue_id", F.when(F.col("cue_id") == 2, F.lit("two" if draft is None else "Two")).otherwise(F.col("text")).alias("text"))
        return texts, spark.createDataFrame([("m", i, k, "said") for i, k in kinds.items()], "media_id string, cue_id int, kind string, message string")

    final, issues = protocol.review_tracks(source, ask, edits=True)
    assert seen == [[], [(1, "uncertain_transcript"), (2, "readability")]]
    assert sorted((r.cue_id, r.kind) for r in issues.collect()) == [(1, "uncertain_transcript"), (3, "other")]  # cue 2 was changed since
    assert [r.text for r in final.orderBy("pos").collect()] == ["one", "Two", "three"]


def test_each_pass_is_judged_once_and_read_from_its_table(spark, tmp_path):
    source = spark.createDataFrame([("m", i, i, 2000 * i, 2000 * i + 1000, t) for i, t in enumerate(["one", "two", "three"])], "media_id string, pos int, cue_id int, start_ms long, end_ms long, text string")
    store = rounds.Store(spark, str(tmp_path))

    def ask(base, draft, known):
        track = base if draft is None else draft
        text = F.when(F.col("cue_id") == 1, F.concat("text", F.lit(" 42"))).otherwise(F.upper("text"))
        return track.select("media_id", "cue_id", text.alias("text")), protocol.no_issues(base)

    final, issues = protocol.review_tracks(source, ask, edits=True, keep=store.keep)
    assert [(r.cue_id, r.text) for r in final.orderBy("pos").collect()] == [(0, "ONE"), (1, "two"), (2, "THREE")]
    assert [(r.cue_id, r.kind) for r in issues.collect()] == [(1, "unsafe_edit")]
    plan = final._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and all(store.holds(name) for name in ("drafted", "found", "verified"))


def test_requests_say_what_is_known(spark):
    cues = spark.createDataFrame([("m", i, i + 1, 10 * i, 10 * i + 10, t) for i, t in enumerate(["One", "two.", None, "four"])], "media_id string, pos int, cue_id long, start_ms long, end_ms long, text string")
    batches = spark.createDataFrame([("m", 0, "a", 2), ("m", 3, "b", 1)], "media_id string, pos int, batch_id string, attempt int")
    context = spark.createDataFrame([("m", "glossary")], "media_id string, context string")
    draft = cues.select("media_id", "pos", F.upper("text").alias("text"))
    got = {r.batch_id: json.loads(r.request) for r in protocol.build_requests(batches, cues, draft, protocol.no_issues(cues), stage="verify", task="translation", target="fr", context=context).collect()}
    assert (got["a"]["retry"], got["b"]["retry"], got["a"]["context"], got["a"]["target"]) == (True, False, "glossary", "fr")
    assert [(u["cue_ids"], u["source"], u["draft"], u["context_only"]) for u in got["a"]["utterances"]] == [([1, 2], "One two.", "ONE TWO.", False), ([3, 4], "four", "FOUR", True)]
    assert [u["context_only"] for u in got["b"]["utterances"]] == [True, False]
    plain = protocol.build_requests(batches, cues, None, protocol.no_issues(cues), stage="generate", task="transcription").collect()
    assert all(json.loads(r.request)["cues"][0]["draft"] is None and json.loads(r.request)["context"] is None for r in plain)


def test_the_queue_as_files(spark, tmp_path):
    states = spark.createDataFrame([("p", "accepted"), ("q", "translation_stale")], "project string, state string")
    issues = spark.createDataFrame([("p", 1, 2, "other", 'say "x"'), ("p", 0, 5, "readability", "long")], "project string, part int, seq int, kind string, message string")
    notes = spark.createDataFrame([("p", 1, "seen")], "project string, at int, note string")
    project.write_queue(project.review_queue(states, issues, notes), str(tmp_path / "queue"))
    got = {r.media_id.rsplit("project=", 1)[1][0]: json.loads(r.content) for r in decoder.whole_files(spark, str(tmp_path / "queue" / "*" / "*.txt")).collect()}
    assert got["p"] == {"state": "accepted", "next_action": "render", "issues": ["readability: long", 'other: say "x"'], "note": "seen"}
    assert got["q"] == {"state": "translation_stale", "next_action": "resume", "issues": [], "note": None}
