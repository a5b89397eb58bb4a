import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cuelake.llm import alignment, resample, topk
from cuelake.llm.common import Work

BIG = 2**63 - 1


def answers(rows, queries, k):
    """All products, by plain loops. rows and queries: (id, vector)."""
    ints = [(i, [max(-BIG - 1, min(BIG, math.floor(x * topk.SCALE))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in queries:
        own = min((v for i, v in ints if i == q), default=None)
        if own is None:
            continue
        scored = [(-max(-BIG - 1, min(BIG, sum(a * b for a, b in zip(v, own, strict=True)))), i) for i, v in ints if i != q and len(v) == len(own)]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])}
    return out


def searched(spark, rows, k=10, **fit):
    vectors = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int" if len(rows[0]) == 3 else "vec_id long, embedding array<float>"))
    return [tuple(r) for r in topk.top_k(Work(spark, "t"), vectors, vectors.where("vec_id % 100 = 0"), k, **fit).collect()]


@pytest.mark.parametrize("norms", [(1.0, 1.0), (0.01, 30.0)])
def test_topk_equals_all_products(spark, norms):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2600, 12)) * rng.uniform(*norms, size=(2600, 1))
    x[1200:1900] = x[7]  # a third of all rows, and the nearest of many queries
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got = searched(spark, rows, pivots=8, sample=100)
    assert len(got) == 260 and set(got) == answers(rows, range(0, 2600, 100), 10)


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (100, None, 1), (200, [], 1), (300, [nan, 1.0], 1), (400, [None, 1.0], 1), (500, [inf, 1.0], 1), (600, [1.0, 2.0, 3.0], 1), (None, [9.0, 9.0], 1), (700, [3e38, -3e38], 1),
        (1, [1.0, 2.0], None), (2, [1.0, 2.0], 2), (2, [1.0, 2.0], 2), (0, [-5.0, 0.0], 3), (3, [-0.0001, 0.0], 4), (4, [3e38, 3e38], 5), (800, [0.0, 0.0], 1),
    ]
    got = searched(spark, rows)
    assert sorted(got) == sorted(answers([r[:2] for r in rows], range(0, 900, 100), 10))
    assert {r[0] for r in got} == {0, 700, 800}  # one vector of another length has no candidates
    assert [r[2] for r in sorted(got) if r[0] == 800][:3] == [0, 0, 1]  # all products with nothing are equal: ties by id, repeated rows each
    assert topk.top_k(Work(spark, "t"), topk.integers(spark.createDataFrame([], "vec_id long, embedding array<float>")), topk.integers(spark.createDataFrame([], "vec_id long, embedding array<float>"))).count() == 0


def test_bounds_are_never_too_low():
    rng = np.random.default_rng(1)
    for scale in (1, 1000, 10**6):
        x = np.floor(rng.normal(size=(400, 40)) * scale).astype(np.int64)
        p = topk.choose_pivots(x, 16)
        d, n = topk.distances(x, p).astype(np.float32), (x.astype(float) ** 2).sum(1)
        for i in range(50):
            assert (topk.bounds(d[i], n[i], np.ascontiguousarray(d.T), n) >= x @ x[i]).all()


def test_pivots_stop_searches_early():
    """Of tight, distant clusters only the query's own is evaluated."""
    rng = np.random.default_rng(2)
    x = np.floor(1024 * (np.repeat(rng.normal(size=(20, 16)) * 5, 100, axis=0) + 0.01 * rng.normal(size=(2000, 16)))).astype(np.int64)
    x = np.floor(x * (5000 / np.sqrt((x**2).sum(1)))[:, None]).astype(np.int64)
    p = topk.choose_pivots(x, 20)
    d, n = topk.distances(x, p).astype(np.float32), (x.astype(float) ** 2).sum(1)
    upper = topk.bounds(d[0], n[0], np.ascontiguousarray(d.T), n)
    tenth = np.sort(x[1:] @ x[0])[-10]
    assert (upper >= tenth).sum() < 300


def naive_alignment(docs):
    """Whole texts, offsets as sets, no units and no galloping."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    alphabet, held, rows = alignment.byte_alphabet(), Counter(), []
    for i, text in docs:
        found = []
        raw = f" {text}".encode() if text else b""
        ids_a, ids_b = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts_a = [bytes(alphabet[c] for c in a.id_to_token(x)) for x in ids_a]
        parts_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
        if b"".join(parts_a) != raw or b"".join(parts_b) != raw or not raw:
            rows.append((i, 0, 0, [], ""))
            continue
        ends_a = {len(b"".join(parts_a[: k + 1])): k for k in range(len(ids_a))}
        ends_b = {len(b"".join(parts_b[: k + 1])): k for k in range(len(ids_b))}
        groups, ka, kb = [], -1, -1
        for end in sorted(ends_a.keys() & ends_b.keys()):
            groups.append(f"{','.join(map(str, ids_a[ka + 1 : ends_a[end] + 1]))}|{','.join(map(str, ids_b[kb + 1 : ends_b[end] + 1]))}")
            ka, kb = ends_a[end], ends_b[end]
            found.append((ids_a[ka], ids_b[kb]))
        held.update(found)
        rows.append((i, len(ids_a), len(ids_b), found, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, x), n in held.items():
        most[x] = max(most[x], n)
    return sorted(((i, n_a, n_b, len(f), len(f), sum(held[x] == most[x[1]] for x in f), sum(held[x] for x in f), h) for i, n_a, n_b, f, h in rows), key=repr)


def aligned(spark, docs, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("n_a", F.lit(1))
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return sorted((tuple(r) for r in alignment.align(Work(spark, "t"), df, *paths, **how).collect()), key=repr)


@pytest.mark.parametrize("hot", [200_000, 4, 0])
def test_alignment_equals_naive(spark, hot):
    texts = [
        None, "", " ", "a ", "a  ", "  a", " \n x", "x\ny\tz\r\n w ;\r q", "<s> </s> <|endoftext|> x", "▁x", "日本語の文章 です、日本語　x", "ﬁ é é x\xa0y", "\x00a", "a\x1c b\x1d\x1e c", "it's we'll 12,345.67 !!!  ??", "\n\n\n", "\t\t a\t\tb",
        "x" * 3000, "🙂🙂 a🙂", "a b   c\u0085 d", "<0x41> <unk>", "word " * 20_000, "日本語" * 2000,
    ]
    rng = random.Random(6)
    texts += ["".join(rng.choice(["Token", "izer's", " ", "  ", "\n", "naïve", "日本語", "42,000", "…", " the", ".", "ing"]) for _ in range(rng.randrange(60))) for _ in range(80)]
    docs = [*enumerate(texts), (3, "a "), (None, "some words"), (None, "some words")]
    assert aligned(spark, docs, hot=hot) == naive_alignment(docs)


def test_alignment_empty(spark):
    assert aligned(spark, [(1, None)]) == [(1, 0, 0, 0, 0, 0, 0, "")]
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(Work(spark, "t"), df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_gallop_equals_sets():
    rng = random.Random(7)
    for _ in range(300):
        a, b = (sorted(rng.sample(range(200), rng.randrange(60))) for _ in range(2))
        assert alignment.common_ends(a, b) == [(a.index(x), b.index(x)) for x in sorted(set(a) & set(b))]


def drawn(docs, target, buckets, run, percent, least):
    def features(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) > 127 else " " for c in text or "").split(" ")
        words = [w for w in words if w]
        return len(words), Counter(zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, run + 1) for i in range(len(words) - n + 1))

    own = [(i, *features(t)) for i, t in docs]
    s, t = sum((f for *_, f in own), Counter()), sum((features(x)[1] for x in target), Counter())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    rows = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"{resample.SEED}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(k * gain[b] for b, k in f.items())
        rows.append((i, n, f.total(), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    take = len(able) * percent // 100
    return Counter([(*r, k + 1 if k < take else None) for k, r in enumerate(able)] + [(*r, None) for r in rows if r[1] < least])


@pytest.mark.parametrize(("buckets", "run"), [(10_000, 1), (97, 3)])
def test_resample_equals_plain_sums(spark, buckets, run):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)] + ["Élan", "日本", "A1", "x_y"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(300)]
    docs += [(1, docs[1][1]), (None, None), (None, "B " * 40), (901, ""), (902, "word " * 70_000), (903, "?! \n")] + [(904, "the same words again " * 9)] * 100
    target = ["w1 w2 w3 w4 w5", None, "", "w1 w1 ÉLAN a1"]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, weight int, Score string")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = Counter(tuple(r) for r in resample.resample(Work(spark, "t"), df, aim, buckets=buckets, run=run, percent=30).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect())
    assert got == drawn(docs, target, buckets, run, 30, resample.LEAST_WORDS)


def test_resample_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(Work(spark, "t"), none, none.select("text")).count() == 0
    some = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert [r["rank"] for r in resample.resample(Work(spark, "t"), some, none.select("text"), percent=100).collect()] == [1]


def test_sliced_weights_are_exact():
    rng = np.random.default_rng(9)
    gain = rng.integers(-20_000, 20_000, 10_000)
    counts = rng.integers(0, 40, (7, 10_000)) * (rng.random((7, 10_000)) < 0.02)
    counts[3, 5] = 10**9
    doc, bucket = np.nonzero(counts)
    got = resample.sliced_weights(doc, bucket, counts[doc, bucket], 7, resample.gain_planes(gain), 10_000)
    assert (got == counts @ gain).all()
