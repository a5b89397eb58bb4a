"""Quality rules with risk-controlled thresholds.

Every rule is a ratio of two counts of a text. A cutoff for it is taken only if labelled good documents show, by an
exact binomial bound, that it rejects at most ``alpha / rules`` of the good documents of a stratum (language); the
level ``delta`` is divided by the number of tests (Bonferroni), so all taken cutoffs hold together with probability
``1 - delta`` and no stratum loses more than ``alpha`` of its good documents.

Null texts count as empty, null languages form a stratum of their own, labels that repeat for a document count once
(the lower quality), unlabelled documents never calibrate. With too few labels no cutoff can be proven and only the
base rule rejects. Extra columns pass through; computed columns (q, base_failed, kept) are returned beside them and replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import free_names, let, small, split_words

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: Rules and the cutoffs (hundredths of numerator over denominator) that calibration may choose between.
RULES = {
    "symbols_per_word": (5, 10, 20, 35, 50, 75, 100, 150),
    "marks_per_word": (5, 10, 20, 35, 50, 75, 100, 150),
    "capitals_share": (5, 10, 15, 20, 30, 40, 60, 80),
    "repeated_lines": (5, 10, 15, 20, 30, 40, 60, 80),
}
ALPHA, DELTA = 0.02, 0.05
SPACE = r"[\x20\x09-\x0D]+"


def repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more in the array, each word once."""
    size = F.size(words)

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(p: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(p, a)["h"] == F.get(p, b)["h"], F.lit(False))
            hit = F.filter(p, lambda x, i: same(i, i - 1) | same(i, i + 1))
            return F.array_sort(F.transform(hit, lambda x: x["i"]))

        total = F.aggregate(
            let(pairs, positions),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")),
            lambda a: a["n"],
        )
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), total).otherwise(0)

    word_hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(word_hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
    return F.when(size > WINDOW, let(windows, covered)).otherwise(0).cast("long")


def counts(docs: DataFrame, text: str, repeats: bool = True) -> DataFrame:
    """docs with the counts that rules use in struct column ``q``; ``repeats`` also counts repeated windows."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def fields(words: Column) -> Column:
        cols = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")),
            "n_marks": F.regexp_count(t, F.lit(r"[!|]")),
            "n_capitals": F.regexp_count(t, F.lit(r"\p{Lu}")),
            "n_lines": let(lines, F.size),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        }
        if repeats:
            cols["n_repeat_words"] = repeated_words(words)
        return F.struct(*[v.cast("long").alias(k) for k, v in cols.items()])

    return docs.withColumn("q", let(split_words(F.col(text), SPACE), fields))


def ratios() -> dict[str, tuple[Column, Column]]:
    q = F.col("q")
    return {
        "symbols_per_word": (q["n_symbols"], q["n_words"]),
        "marks_per_word": (q["n_marks"], q["n_words"]),
        "capitals_share": (q["n_capitals"], q["word_chars"]),
        "repeated_lines": (q["n_dup_lines"], q["n_lines"]),
    }


def tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), exactly summed; 1 where k exceeds the mean, as no level accepts that."""
    step = lambda a, j: let(
        a["log"] + F.log((n - j + 1) / j) + F.log(F.lit(p / (1 - p))),
        lambda log: F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum")),
    )
    first = n * F.log(F.lit(1 - p))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), k), F.struct(first.alias("log"), F.exp(first).alias("sum")), lambda a, j: F.when(j == 0, a).otherwise(step(a, F.greatest(j, F.lit(1)))), lambda a: a["sum"])
    return F.when(k <= n * p, total).otherwise(1.0)


def calibrate(seen: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Cutoffs per stratum from documents with ``q``: (stratum, one nullable column per rule). The lowest proven cutoff is taken."""
    good = labels.groupBy(F.col(id_col).alias("label_id")).agg(F.min("quality").alias("quality")).where("quality = 1")
    seen = seen.select(F.col(id_col).alias("label_id"), F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), "q").join(good, "label_id", "left_semi")
    tests = [(rule, c, (100 * num > c * den)) for (rule, cuts), (num, den) in zip(RULES.items(), ratios().values(), strict=True) for c in cuts]
    by = seen.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(hit).alias(f"k{i}") for i, (_, _, hit) in enumerate(tests)])
    by = by.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) * len(tests))  # a row per stratum
    rows = by.select("stratum", "n", "m", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("k")) for i, (r, c, _) in enumerate(tests)])))
    proven = rows.where(tail(F.col("n"), F.col("k"), alpha / len(RULES)) <= F.lit(delta) / F.col("m"))
    return proven.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r) for r in RULES])


def judge(seen: DataFrame, cutoffs: DataFrame, *, stratum: str = "lang") -> DataFrame:
    """Documents with ``q`` get ``base_failed`` and ``kept``. Cutoffs are one row per stratum, counted before any broadcast."""
    of, cut = free_names(seen, "s", "cut")
    cutoffs = cutoffs.select(F.col("stratum").alias(of), F.struct(*RULES).alias(cut))
    joined = seen.join(small(cutoffs, cutoffs.count()), F.coalesce(F.col(stratum), F.lit("")) == F.col(of), "left")
    q, over = F.col("q"), F.lit(False)
    for rule, (num, den) in ratios().items():
        over |= F.coalesce(100 * num > F.col(cut)[rule] * den, F.lit(False))
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])
    return joined.withColumns({"base_failed": failed, "kept": ~failed & ~over}).drop(of, cut)
