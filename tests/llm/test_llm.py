import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from cuelake.llm import chat, language, lines, minhash, packing, pages, postings, quality, shards, toxicity
from cuelake.llm.common import FREE_SHUFFLES, Work

DOCS = "doc_id long, text string, lang string, extra string"
COMMON = [(1, None, None, "x"), (2, "", "en", None), (3, " \n\t", "en", "x"), (4, "one two", "en", "x"), (5, "one two", "en", "x"), (None, "a b c d e f g", "en", "x"), (6, "word " * 50_000, "en", "x")]


def table(spark, rows=COMMON):
    return spark.createDataFrame(rows, DOCS)


def family(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(80)]
        for _ in range(6):
            near = list(base)
            for _ in range(rng.randrange(4)):
                near[rng.randrange(80)] = rng.choice(words)
            out.append((len(out), " ".join(near), "en", None))
    return out


def test_minhash_equals_brute_force(spark):
    docs = family()
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t, *_ in docs}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: (min(a, b) if v in (a, b) else v) for k, v in root.items()}
    got = {r.doc_id: r.component for r in minhash.near_duplicates(Work(spark, "t"), table(spark, docs)).collect()}
    assert got == root


def test_minhash_edges(spark):
    got = {r.doc_id: (r.n_shingles, r.component) for r in minhash.near_duplicates(Work(spark, "t"), table(spark)).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), None: (3, None), 6: (1, 6)}
    assert minhash.near_duplicates(Work(spark, "t"), table(spark, [])).count() == 0


def test_bayesian_bounds_keep_true_links():
    assert all(m < 0.85 * n for m, n in zip(minhash.least_matches(), range(16, 129, 16), strict=True))


def test_lines(spark):
    a = "the quick brown fox jumps over the lazy dog and then runs far away from the old red barn"
    docs = [(1, f"{a}\nshort line", "en", None), (2, f"own words stand here alone today\n{a}", "en", None), (3, "short line\n" + a.replace("old", "odd"), "en", None)]
    got = {r.doc_id: (r.n_lines, r.n_gone, r.text) for r in lines.dedup_lines(Work(spark, "t"), table(spark, docs)).collect()}
    assert got[1] == (2, 0, docs[0][1]) and got[2] == (2, 1, "own words stand here alone today") and got[3][0] == 2
    edges = {r.doc_id: (r.n_gone, r.text) for r in lines.dedup_lines(Work(spark, "t"), table(spark)).collect()}
    assert edges[1] == (0, None) and edges[2] == (0, "") and edges[None] == (0, "a b c d e f g")
    assert lines.dedup_lines(Work(spark, "t"), table(spark, [])).count() == 0


def test_postings(spark):
    item = "alpha beta gamma delta eps zeta eta theta iota kappa lambda"
    items = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (4, "")], "item_id long, text string")
    docs = [(10, f"x {item.upper()} y", "en", None), (11, "a tiny, item! tiny item", "en", None), (12, "alpha beta", "en", None), *COMMON]
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in postings.contamination(Work(spark, "t"), table(spark, docs), items).collect()}
    assert got[10] == (13, 11, ["1"]) and got[11] == (5, 4, ["2"]) and got[12] == (2, 0, []) and got[1] == (0, 0, []) and got[6][1] == 0
    assert postings.contamination(Work(spark, "t"), table(spark, []), items).count() == 0


def test_packing(spark):
    rng = np.random.default_rng(1)
    histogram = {int(n): int(c) for n, c in zip(range(1, 65), rng.integers(0, 30, 64), strict=True) if c}
    used: dict[int, int] = {}
    spans = []
    for length, _, placed, first, each, base in packing.plan(histogram, 64):
        for i in range(placed):
            spans.append((first + i // each, base + i % each * length, length))
    assert len(spans) == sum(histogram.values())
    for seq, at, length in sorted(spans):
        assert used.get(seq, 0) == at
        used[seq] = at + length
    assert max(used.values()) <= 64 and len(used) <= 1.1 * sum(k * v for k, v in histogram.items()) / 64 + 1


def test_packing_query(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = __import__("public_tokenizers").path("word_bpe_49k.json")
    got = packing.pack(Work(spark, "t"), table(spark), path).toPandas()
    encode = tokenizers.Tokenizer.from_file(path).encode
    total = got.groupby("doc_id")["length"].sum()
    assert total[6] == len(encode("word " * 50_000, add_special_tokens=False).ids) + 1 and total[2] == 1 and total[1] == 1
    assert got["length"].max() <= 4096 and not got.duplicated(["sequence_id", "offset"]).any()


def test_shards(spark):
    rows = [(i, "x" * (i % 97), "en", None) for i in range(500)]
    got = shards.shard(table(spark, rows), 8, block=32).toPandas().sort_values("doc_id")
    size = got["size"].to_numpy()
    want = np.minimum((2 * size.cumsum() - size) * 8 // (2 * size.sum()), 7)
    assert (got["shard"].to_numpy() == want).all()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert shards.shard(table(spark), 8).count() == len(COMMON) and shards.shard(table(spark, []), 8).count() == 0


def test_chat_folds_and_reads_back(spark):
    log = [(1, 1, 0, "open", "user", None), (1, 2, 0, "delta", None, "a\\<b"), (1, 3, 1, "open", "assistant", None), (1, 4, 1, "delta", None, "bad"), (1, 5, 1, "regenerate", None, None), (1, 6, 1, "delta", None, "<|im_end|>\n["), (1, 7, 1, "delta", None, "ok\\l"), (1, 8, 0, "edit", None, "new")]
    df = spark.createDataFrame(log, "conv long, seq int, message int, kind string, role string, text string")
    out = chat.render(chat.final_messages(df)).select(chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("said")).first()
    assert [tuple(t) for t in out.t] == [("user", "new"), ("assistant", "<|im_end|>\n[ok\\l")] and out.said == "<|im_end|>\n[ok\\l"


def test_quality(spark):
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    seen = quality.counts(table(spark), "text")
    got = {r.doc_id: (r.base_failed, r.kept, r.q.n_repeat_words) for r in quality.judge(seen, quality.calibrate(seen, labels)).collect()}
    assert got[6] == (True, False, 50_000) and got[1] == (True, False, 0)


def test_toxicity_learns(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(200)], k=30) + (["vile"] if i % 5 == 0 else [])) for i in range(600)]
    docs = table(spark, [(i, t, "en", None) for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels)).toPandas()
    assert ((got["score"] >= 0.7) == (got["doc_id"] % 5 == 0)).mean() > 0.97
    assert toxicity.score(table(spark), toxicity.train(table(spark, []), labels)).count() == len(COMMON)


def test_language_learns(spark):
    rng = random.Random(4)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(40))
    docs = table(spark, [(i, make("abcde" if i % 2 else "vwxyz"), "aa" if i % 2 else "zz", None) for i in range(200)] + COMMON[:3])
    got = language.predict(docs.select("doc_id", "text", "lang"), language.train(docs.where("lang <> 'en'"))).toPandas()
    full = got[got["lang"].isin(["aa", "zz"])]
    assert (full["lang"] == full["lang_pred"]).mean() > 0.97 and (got[~got["lang"].isin(["aa", "zz"])]["lang_pred"] == "und").all()
    assert language.train(table(spark, [])) is None


def test_pages():
    page = "<nav><a href=x>Home</a></nav><div class='cookie-notice'>We use cookies to make this long enough text</div><article><h1>T</h1><p>a &amp; b<br>c</p><div class=comments><p>nice post</p></div></article><footer>end</footer>"
    assert pages.main_text(page) == "T\na & b c" and pages.main_text(None) == "" and pages.main_text("<p") == ""


def test_sim_hash_of_long_and_short_lines(spark):
    both = " ".join(f"w{i * i}" for i in range(700)), " ".join(f"w{i}" for i in range(40))
    words = spark.createDataFrame([(w,) for w in sorted(set(" ".join(both).split()))], "w string")
    hashes = {r.w: r.h | 1 for r in words.selectExpr("w", "xxhash64(w) AS h").collect()}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(both)], "pos int, line string").select("pos", F.array_distinct(lines.tokens(F.col("line"))).alias("h"))
    for row, line in zip(rows.select("pos", F.size("h").alias("n_words"), lines.simhash(F.col("h")).alias("sim")).orderBy("pos").collect(), both, strict=True):
        ws = set(line.split())
        assert row.n_words == len(ws) and row.sim == sum(1 << b for b in range(63) if 2 * sum(hashes[w] >> b & 1 for w in ws) > len(ws))


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def altered_lines(n_words, typos, n=60, seed=7):
    """Pairs of a line and a copy with typos, or with a tenth of its words replaced, that brute force finds similar at 0.9."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    out = []
    while len(out) < n:
        a = [word() for _ in range(n_words)]
        b = list(a)
        for at in rng.sample(range(n_words), typos or max(1, n_words // 10)):
            b[at] = b[at][:1] + rng.choice("abcdefghijklmnopqrstuvwxyz") + b[at][2:] if typos else word()
        a, b = " ".join(a), " ".join(b)
        if a != b and 10 * edits(a, b) <= max(len(a), len(b)):
            out.append((a, b))
    return out


def n_gone(spark, pairs):
    docs = [(i, line, "en", None) for i, line in enumerate(x for pair in pairs for x in pair)]
    return lines.dedup_lines(Work(spark, "t"), table(spark, docs)).agg(F.sum("n_gone")).first()[0]


def test_lines_recall_of_changed_words(spark):
    assert n_gone(spark, altered_lines(20, 0) + altered_lines(15, 1) + altered_lines(40, 0)) == 180


def test_lines_recall_of_many_typos(spark):
    assert n_gone(spark, altered_lines(30, 8)) >= 57


def test_lines_short_fuzzy_equals_brute_force(spark):
    near = altered_lines(7, 1, 40) + altered_lines(9, 2, 40, seed=8)
    docs = [a for a, b in near for a in (a, b, a[:9] + a[10:], "x" + b)]
    root = list(range(len(docs)))
    for i, a in enumerate(docs):
        for j in range(i - i % 4, i):
            if 10 * edits(a, docs[j]) <= max(len(a), len(docs[j])):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    got = lines.dedup_lines(Work(spark, "t"), table(spark, [(i, t, "en", None) for i, t in enumerate(docs)])).where("n_gone = 1")
    assert {r.doc_id for r in got.collect()} == {i for i, r in enumerate(root) if r != i}


def test_lines_marks_and_spaces(spark):
    docs = [(1, "Now, one two three four!", "en", None), (2, "now one  two: three four", "en", None), (3, "* * * * *", "en", None), (4, "- - - - -", "en", None)]
    got = {r.doc_id: r.n_gone for r in lines.dedup_lines(Work(spark, "t"), table(spark, docs)).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0}


def test_lines_recall_by_length(spark):
    """Of 60 pairs each, at least nine in ten."""
    classes = ((7, 1, 54), (9, 1, 54), (12, 2, 54), (25, 3, 54), (60, 0, 57), (150, 0, 57), (5, 1, 54), (7, 2, 54), (10, 3, 54), (15, 4, 54), (20, 4, 54), (20, 6, 54), (30, 5, 54), (30, 8, 54), (40, 10, 54), (60, 15, 54), (100, 20, 54))
    pairs = [pair for k, (n_words, typos, _) in enumerate(classes) for pair in altered_lines(n_words, typos, seed=k)]
    docs = [(i, line, "en", None) for i, line in enumerate(x for pair in pairs for x in pair)]
    gone = [r.doc_id for r in lines.dedup_lines(Work(spark, "t"), table(spark, docs)).where("n_gone = 1").collect()]
    found = {c[:2]: sum(i // 120 == k for i in gone) for k, c in enumerate(classes)}
    assert all(found[n_words, typos] >= least for n_words, typos, least in classes), found


def test_rare_shingles_pass_over_families_below_the_threshold_but_no_link(spark):
    rng, texts = random.Random(5), []
    for family in range(4):
        base = [f"t{family}x{i}" for i in range(300)]
        for k in range(24):
            words = base[: 300 - rng.randrange(0, 12)] if family else list(base)
            for at in rng.sample(range(5, len(words) - 5), 8 if family == 0 else rng.randrange(0, 9)):
                words[at] = f"own{family}x{k}x{at}"
            texts.append(" ".join(words))
    sets = [set(minhash.shingles(t, minhash._Words()).tolist()) for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    buckets = {}
    for r in minhash.rare_shingles(Work(spark, "t"), frame, frame.selectExpr("id AS item")).collect():
        buckets.setdefault(r.bucket, []).append((r.item, r.side))
    asked = {(min(a, b), max(a, b)) for x in buckets.values() for a, s in x for b, t in x if a != b and (s != t or s == 2)}
    linked = {(a, b) for b in range(len(texts)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert linked <= asked and len(linked) > 100
    assert not any(b < 24 for _, b in asked)  # of 300 words 8 are changed in each of family 0, so that all its pairs are at 0.76 or so


def test_lines_keys_that_no_other_line_has_are_never_written(spark, monkeypatch):
    rng, rows = random.Random(3), []
    docs = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(20)), "en", None) for i in range(40)]
    cut = Work.cut
    monkeypatch.setattr(Work, "cut", lambda work, df: rows.append((out := cut(work, df)).count()) or out)
    assert lines.dedup_lines(Work(spark, "t"), table(spark, docs)).agg(F.sum("n_gone")).first()[0] == 0
    assert max(rows) == 40  # 48 keys a line


def test_lines_shuffles_are_deleted_once_written(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {name for f in (disk.getAllFiles().apply(i) for i in range(disk.getAllFiles().size())) if (name := f.getName()).startswith("shuffle_")}
    before, df = files(), spark.range(1000).repartition(4, "id").groupBy("id").count()
    out = Work(spark, "t").cut(df)
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(FREE_SHUFFLES) == "false" and out.count() == df.count() == 1000


def test_lines_copies_share_one_bucket_and_no_candidate_is_lost(spark):
    pairs = altered_lines(40, 2, 20) + altered_lines(9, 1, 20)
    frame = spark.createDataFrame([(i, line) for i, line in enumerate(x for pair in pairs for x in pair)], "item long, line string")
    frame = frame.unionByName(spark.createDataFrame([(1000 + i, " ".join(f"u{i}x{k}" for k in range(30))) for i in range(5)], "item long, line string")).persist()
    rows = [(r.bucket, r.item) for r in lines.shared(Work(spark, "t"), frame, 85).collect()]
    assert len(rows) == len(set(rows)) == 80  # two rows a pair, not two for each key that it shares
    keyed = [(turn, r.bucket, r.item) for turn in range(lines.TURNS) for r in lines.bucketed(frame, turn).collect()]
    by = {}
    for turn, bucket, item in keyed:
        by.setdefault((turn, bucket), set()).add(item)
    sets = {}
    for bucket, item in rows:
        sets.setdefault(bucket, set()).add(item)
    assert {frozenset(x) for x in by.values() if len(x) > 1} == {frozenset(x) for x in sets.values()}


def test_lines_of_pairs_meet_in_turns_and_few_tasks(spark, monkeypatch):
    jobs, cut, repartition = [], Work.cut, DataFrame.repartition
    monkeypatch.setattr(lines, "PAIRS_PER_LINE", 0.1)
    monkeypatch.setattr(Work, "cut", lambda work, df: jobs.append(df.columns) or cut(work, df))
    monkeypatch.setattr(DataFrame, "repartition", lambda df, n, *cols: repartition(df, n, *cols) if cols == ("bucket",) else 1 / 0)
    assert n_gone(spark, altered_lines(20, 1, 30)) == 30
    assert jobs.count(["a", "b"]) >= 8  # the links of each turn, besides the pairs


def test_lines_that_share_common_words_alone_share_no_key(spark):
    """Sixty words that any line may have, eighteen long ones of its own each: few keys are made, and next to none is shared."""
    rng = random.Random(11)
    common = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 4))) for _ in range(60)]
    own = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
    rows = []
    for i in range(400):
        words = [rng.choice(common) for _ in range(12)] + [own() for _ in range(18)]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "item long, line string").persist()
    assert sum(lines.bucketed(frame, turn).count() for turn in range(lines.TURNS)) <= 20 * len(rows)
    assert lines.shared(Work(spark, "t"), frame, len(rows)).count() <= 20


def test_lines_of_many_copies_make_their_keys_once(spark):
    frame = spark.createDataFrame([(i % 3 if i < 300 else i, f"line {i % 3 if i < 300 else i}", i) for i in range(320)], "item long, line string, at long")
    got = sorted((r.item, r.line) for r in lines.few_copies(Work(spark, "t"), frame, 320).collect())
    assert got == [(i, f"line {i}") for i in [0, 1, 2, *range(300, 320)]]


def test_lines_between_common_words_are_as_far_apart(spark):
    rng = random.Random(1)
    line = lambda: " ".join(rng.choice("ab abc c d x abd".split()) for _ in range(rng.randrange(1, 9)))
    frame = spark.createDataFrame([(line(), line()) for _ in range(2000)] + [("a b", "a b"), ("a", "a a"), ("a b", "a c b")], "x string, y string")
    x, y = lines.between(F.col("x"), F.col("y"))
    rows = frame.select(F.levenshtein("x", "y").alias("whole"), F.levenshtein(x, y).alias("rest"), F.length(x).alias("n")).collect()
    assert all(r.whole == r.rest for r in rows) and rows[-1].n == 0


def test_lines_without_spaces_are_found(spark):
    rng, docs = random.Random(4), []
    for i in range(60):
        a = [chr(0x4E00 + rng.randrange(3000)) for _ in range(40)]
        b = list(a)
        for at in rng.sample(range(40), 3):
            b[at] = chr(0x4E00 + rng.randrange(3000))
        docs += [(2 * i, "".join(a), "zh", None), (2 * i + 1, "".join(b), "zh", None)]
    assert lines.dedup_lines(Work(spark, "t"), table(spark, docs)).agg(F.sum("n_gone")).first()[0] >= 57


def test_lines_clashing_columns_and_empty_table(spark):
    docs = table(spark, [(1, "a b c d e f", "en", None), (2, "a b c d e f\nx", "en", None)]).withColumns({"_gone": F.lit(1), "_gone_doc": F.lit(2), "n_lines": F.lit("x")})
    got = {r.doc_id: (r.text, r.n_lines, r.n_gone, r._gone, r._gone_doc) for r in lines.dedup_lines(Work(spark, "t"), docs).collect()}
    assert got == {1: ("a b c d e f", 1, 0, 1, 2), 2: ("x", 2, 1, 1, 2)}
    assert lines.dedup_lines(Work(spark, "t"), docs.limit(0)).count() == 0


def test_pages_of_loose_markup(spark):
    long = " ".join(["word"] * 60)
    html = {
        1: f"<html><head><title>x</title><body><p>{long}", 2: f"<article><p class='ad'>Buy now<p>{long}<p>{long}</article>", 3: f"<ul><li class='share'>x<li>{long}</ul>",
        4: f"<div><a href=1>Home</a> <a>News</a> <a>Sport</a></div><p>{long}</p><p>{long}</p>", 5: f"<p hidden>{long}</p><p>{long}</p><div aria-hidden=true><p>{long}</p></div>",
        6: f"<article><p class='story-header'>{long}</p></article>", 7: "", 8: None,
    }
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(list(html.items()), "page_id int, html string")).collect()}
    assert got == {1: long, 2: f"{long}\n{long}", 3: long, 4: f"{long}\n{long}", 5: long, 6: long, 7: "", 8: ""}
    assert pages.extract(spark.createDataFrame([], "page_id int, html string")).count() == 0


def test_shards_of_any_ids(spark):
    rows = [(None, "x" * (i % 7)) for i in range(50)] + [(f"id{i % 40}", "y" * (i % 11)) for i in range(100)]
    got = shards.shard(spark.createDataFrame(rows, "doc_id string, text string"), 4, block=16).collect()
    size = [sum(r.size for r in got if r.shard == k) for k in range(4)]
    assert len(got) == 150 and max(size) - min(size) <= 2 * 11
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got))) for k in range(4))


def test_packing_equals_naive(spark):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encode = Tokenizer.from_file(path).encode
    rng = random.Random(4)
    texts = [None, "", "Héllo  wörld\u3000x\t…", "a", "a"] + [" ".join(rng.choice(["Token", "izer's", "naïve", "日本語", "42,000", "🙂x"]) for _ in range(rng.randrange(400))) for _ in range(60)]
    got = packing.pack(Work(spark, "t"), table(spark, [(i, t, None, None) for i, t in enumerate(texts)]), path, capacity=256).collect()
    for i, t in enumerate(texts):
        ids = [*encode(t or "", add_special_tokens=False).ids, 1]
        parts = [ids[k : k + 256] for k in range(0, len(ids), 256)]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)] == [(k, 256 * k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(parts)]
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert all(o == sum(n for _, n in b[:k]) for k, (o, _) in enumerate(b)) and sum(n for _, n in b) <= 256
    room = []  # best fit, longest first, one piece at a time
    for n in sorted((r.length for r in got), reverse=True):
        fits = [k for k in range(len(room)) if room[k] >= n]
        k = min(fits, key=lambda k: room[k]) if fits else len(room)
        room[k:k] = [256] if k == len(room) else []
        room[k] -= n
    assert len(bins) <= len(room)


def test_lines_equal_at_any_length(spark):
    same = ["all rights reserved.", "一個沒有空格的句子在這裡重複出現", "col\tcol\tcol", "buy " * 160, ""]
    docs = [(i, "\n".join(same), "en", None) for i in (1, 2)]
    got = {r.doc_id: (r.n_gone, r.text) for r in lines.dedup_lines(Work(spark, "t"), table(spark, docs)).collect()}
    assert got == {1: (0, "\n".join(same)), 2: (4, "")}


def test_toxicity_learns_a_pair_of_neutral_terms():
    # Each of two terms is in half of the toxic and half of the other rows; only both, or neither, are toxic.
    rng, cache, rows = random.Random(2), toxicity._Terms(), []
    for i in range(2000):
        some = [f"w{rng.randrange(300)}" for _ in range(15)] + ["insult"] * (i % 4 in (1, 3)) + ["group"] * (i % 4 in (2, 3))
        rows.append(toxicity.terms(" ".join(some), cache))
    toxic = np.array([float(i % 4 in (0, 3)) for i in range(2000)])
    found = toxicity.fit(rows[:1000], toxic[:1000]).logits(rows[1000:]) > 0
    assert (found == toxic[1000:]).mean() > 0.9


def test_language_sample_holds_rare_languages(spark):
    docs = [(i, "the words of a common line", "en", None) for i in range(300)] + [(300, "слова редкой строки", "ru", None)]
    assert language.train(table(spark, docs), rows=20).languages == ["en", "ru"]
    assert language.shares({"a": 100, "b": 2, "c": 50}, 30) == {"b": 2, "c": 14, "a": 14}


def test_pages_are_read_in_one_pass():
    import time

    story = "<p>" + "word " * 60 + "</p>"
    for bad in ("<a b='x", "<a b='x>", '<a b="', "<!", "<div>", "<li><div>", "</b>", "<p class=' ", "<a href=x ", "<!-- ", "<script>", "&", "<"):
        page = story + bad * (1_000_000 // len(bad))
        start = time.time()
        found = pages.blocks(page)
        assert time.time() - start < 20, bad
        assert found[0][0].startswith("word word"), bad
    deep = "<div>" * 100_000 + "</i>" * 100_000 + story
    start = time.time()
    assert pages.blocks(deep)[-1][1] == 60 and time.time() - start < 20


def test_language_clashing_columns(spark):
    docs = table(spark, [(1, "some words", "en", None), (2, None, "en", None)]).withColumns({"_p": F.lit(3), "score": F.lit("x")})
    got = {r.doc_id: (r.lang_pred, r.score, r._p) for r in language.predict(docs, None).collect()}
    assert got == {1: ("und", 0.0, 3), 2: ("und", 0.0, 3)}
