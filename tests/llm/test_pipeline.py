"""The registered queries against their SQL, and the pipeline and its stages against a brute-force chain."""

import glob
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuelake.llm import language, toxicity
from cuelake.llm.queries import QUERIES
from cuelake.llm.sql import ORACLES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("mar", "tel", "von", "sib", "kar", "dun", "pol", "rif", "gam", "hes") for b in ("ton", "ling", "der", "mak", "ost", "una", "ipe", "ard", "eth", "olo", "umb", "isk")]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got, found = QUERIES[name](spark, SF), con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(names)
    # Rows as both give them: data frames would turn whole numbers beside nulls into fractions.
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == sorted(map(repr, found.fetchall()))


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def groups(keys, linked):
    """The least key that each key reaches."""
    root = {k: k for k in keys}
    for a in keys:
        for b in keys:
            if a < b and root[a] != root[b] and linked(a, b):
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    return root


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_chain(docs, items):
    """{id: text} that is left before packing, by the rules of each stage written plainly."""
    docs = {i: t or "" for i, t, *_ in docs}
    for i, t in list(docs.items()):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = {}
        for k in range(len(words) - 7):
            seen.setdefault(tuple(words[k : k + 8]), []).append(k)
        repeated = {p for at in seen.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
        if len(words) < 20 or 100 * len(repeated) > 30 * len(words):
            del docs[i]
    lines = {(i, p): " ".join(re.findall(r"[^\W_]+", x.lower())) for i, t in sorted(docs.items()) for p, x in enumerate(t.split("\n")) if x.strip()}

    def alike(a, b):
        x, y = lines[a], lines[b]
        if min(len(x.split()), len(y.split())) < 5 or len(set(x.split()) & set(y.split())) * 2 < len(set(x.split())):
            return x == y
        return 10 * edits(x, y) <= max(len(x), len(y))

    root = groups(list(lines), alike)
    for i, t in list(docs.items()):
        docs[i] = "\n".join(x for p, x in enumerate(t.split("\n")) if root.get((i, p), (i, p)) == (i, p))
        if docs[i] != t and not docs[i].strip():
            del docs[i]
    sets = {i: shingles(t) for i, t in docs.items()}
    root = groups(sorted(docs), lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    docs = {i: t for i, t in docs.items() if root[i] == i}
    words_of = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())
    windows = {tuple(w[k : k + 10]) for w in map(words_of, items) for k in range(max(1, len(w) - 9)) if w}
    holds = lambda w: any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    return {i: t for i, t in docs.items() if not holds(words_of(t))}


def corpus():
    rng = random.Random(11)
    line = lambda n=14: " ".join(rng.choice(WORDS) for _ in range(n))
    shared, item = line(16), line(12)
    docs = [[line() for _ in range(6)] for _ in range(12)]
    docs[1][2] = docs[2][0] = docs[3][5] = shared
    docs[4][1] = shared.replace("a", "e", 1)  # one typo
    docs.append(list(docs[5]))  # an exact copy: all of its lines go
    # A near copy that no line rule sees: the same words, cut into other lines.
    words = " ".join(docs[6]).split()
    docs.append([" ".join(words[k : k + 28]) for k in range(0, len(words), 28)])
    docs[7][3] = f"{item} and more of it"
    docs[8] = [" ".join(["spam"] * 60)]
    docs[9] = ["too few words"]
    rows = [(i + 1, "\n".join(t), "en", "s", 0) for i, t in enumerate(docs)]
    return [*rows, (90, None, "en", "s", 0), (91, "", "en", "s", 0), (92, "one\n\ntwo", None, None, None)], [item, "", None]


def tables(spark, folder, docs, items, labels=()):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_equals_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, items = corpus()
    want = brute_chain(docs, [x or "" for x in items])
    assert {1, 2, 3, 4, 5, 6, 7} <= set(want) and not {8, 9, 10, 13, 14, 90, 91, 92} & set(want)
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    got = corpus_pipeline.run(spark, tables(spark, tmp_path, docs, items)).collect()
    assert {r.doc_id: (r.piece, r.start, r.length) for r in got} == {i: (0, 0, len(encode(t, add_special_tokens=False).ids) + 1) for i, t in want.items()}
    assert len({r.sequence_id for r in got}) == 1


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, tmp_path, name):
    """Nulls, empties, repeated rows, a long text, an empty table, and columns with names that stages use inside."""
    stage, (docs, items) = dict(corpus_pipeline.STAGES)[name], corpus()
    folder = tables(spark, tmp_path, docs, items)
    rows = [*docs[:3], docs[0], (None, docs[1][1], "en", "s", 1), (95, " ".join(WORDS * 300), "en", "s", 1), *docs[-3:]]
    clash = {c: F.lit(1) for c in ("kept", "component", "doc", "gone", "_gone", "q", "_s", "item", "items", "n_words", "n_lines", "bucket", "score", "word", "pos", "keys", "digest")}
    df = spark.createDataFrame(rows, DOCS).withColumns(clash)
    out, empty = stage(spark, df, folder), stage(spark, df.limit(0), folder)
    assert empty.count() == 0
    if name == "best_fit_packing":
        assert {r.doc_id for r in out.collect()} == {r[0] for r in rows}
    else:
        assert out.columns == df.columns
        assert {1, 2, 3} <= {r.doc_id for r in out.collect()}


def test_toxicity_of_null_and_repeated_labels(spark):
    docs = spark.createDataFrame([(i, "vile words here" if i % 2 else "kind words there", None, None, None) for i in range(40)], DOCS).select("doc_id", "text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] * 2 + [(35, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(40)) and len({got[i] for i in range(1, 40, 2)}) == 1


def test_language_of_an_empty_table_and_of_ties(spark):
    docs = spark.createDataFrame([(i, "abc abd" if i % 2 else "xyz xyw", "aa" if i % 2 else "zz", None, None) for i in range(60)], DOCS).select("doc_id", "text", "lang")
    net = language.train(docs)
    assert language.predict(docs.limit(0), net).count() == 0
    got = {(r.doc_id % 2, r.lang_pred, r.score) for r in language.predict(docs, net).collect()}
    assert len(got) == 2  # equal texts get equal results
