"""Benchmark decontamination with a distributed positional inverted index.

The training corpus is indexed as segments: every task turns its documents into postings (term, document, position)
and sorts them by term, so a lookup of a term skips all other row groups and pages. Segments are dealt by input
split, not by term: a frequent term is spread over all of them, and building the index shuffles nothing. Only terms of
the benchmark's vocabulary are stored, as no query can ask for another.

A query is a window of consecutive benchmark words. Its rarest terms (by corpus frequency) come first: the list of the
rarest, moved back by its offset in the window, gives possible starts; the next rarest, moved likewise, is
intersected with these, and so on until every term of the window has agreed. Starts that survive are exact phrase
matches. ``slack`` greater than 0 gives proximity matches: each term within ``slack`` words of its place.

Null texts have no words. Rows of equal id are one document and must have one text; rows of null id match nothing. An
empty benchmark or corpus gives no match. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import BROADCAST_ROWS, Work, let, lower_ascii, small, split_words

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Lists of the rarest terms are intersected one by one; after that many the survivors are few and the rest come at once.
LISTS_ALONE = 3


def words(text: Column) -> Column:
    return split_words(lower_ascii(text), SEPARATORS)


def windows(items: DataFrame, *, id_col: str = "item_id", text: str = "text", size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(terms, owners): terms(window, k, term) of every distinct window, owners(window, item). A short item is one window."""
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))
    cut = let(words(F.col(text)), lambda w: F.when(F.size(w) > 0, F.transform(starts(w), lambda i: F.slice(w, i, size))))
    each = items.select(F.col(id_col).alias("item"), F.explode(cut).alias("terms"))
    each = each.withColumn("window", F.sha2(F.array_join("terms", " "), 256))
    terms = each.groupBy("window").agg(F.first("terms").alias("terms")).select("window", F.posexplode("terms").alias("k", "term"))
    return terms, each.select("window", "item").distinct()


def index(docs: DataFrame, vocabulary: DataFrame, n_terms: int, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (term_id, doc, pos), sorted by term within each segment. vocabulary: (term, term_id), n_terms rows."""
    flat = docs.select(F.col(id_col).alias("doc"), F.posexplode(words(F.col(text))).alias("pos", "term"))
    return flat.join(small(vocabulary, n_terms), "term").select("term_id", "doc", "pos").sortWithinPartitions("term_id", "doc", "pos")


def matches(work: Work, docs: DataFrame, terms: DataFrame, *, id_col: str = "doc_id", text: str = "text", slack: int = 0) -> DataFrame:
    """Distinct (doc, window, start, size) of every place where a window's terms stand in order (within slack)."""
    vocabulary = work.cut(terms.select("term").distinct().withColumn("term_id", F.xxhash64("term")))
    n_terms = vocabulary.count()
    postings = work.cut(index(docs, vocabulary, n_terms, id_col=id_col, text=text))
    frequency = postings.groupBy("term_id").agg(F.count(F.lit(1)).alias("n"))
    plan = terms.join(vocabulary, "term").join(frequency, "term_id", "left").select("window", "k", "term_id", F.coalesce("n", F.lit(0)).alias("n"))
    # Rarest first; a window with a term that the corpus lacks has no match.
    plan = plan.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("n", "k", "term_id"))).alias("order"), F.min("n").alias("least")).where("least > 0")
    plan = work.cut(plan.select("window", "order"))
    n_windows = plan.count()
    most = (plan.agg(F.max(F.size("order"))).first()[0] or 0) if n_windows else 0

    def wanted(first: int, last: int) -> DataFrame:
        """(window, size, term_id, k) of the terms ranked first to last (exclusive) by rarity."""
        ranked = F.slice(F.col("order"), first + 1, max(last - first, 1))
        return plan.where(F.size("order") > first).select("window", F.size("order").alias("size"), F.explode(ranked).alias("o")).select("window", "size", "o.term_id", "o.k")

    hits = postings.join(small(wanted(0, 1), n_windows), "term_id")
    found = work.cut(hits.select("doc", "window", "size", (F.col("pos") - F.col("k")).alias("start")).where(F.col("start") >= (-slack)).distinct())
    rounds = [(i, i + 1) for i in range(1, min(LISTS_ALONE, most))] + [(LISTS_ALONE, most)] * (most > LISTS_ALONE)
    for first, last in rounds:
        n_found = found.count()
        if not n_found:
            break
        terms_now = wanted(first, last)
        # Only postings of documents that still have a start, and of terms that this round asks for.
        alive = found.select("doc").distinct()
        lists = postings.join(small(terms_now.select("term_id").distinct(), n_terms), "term_id", "left_semi")
        lists = lists.join(small(alive, n_found), "doc", "left_semi") if n_found <= BROADCAST_ROWS else lists
        asked = found.join(small(terms_now, n_windows * (last - first)), ["window", "size"], "inner")
        asked = asked.withColumn("pos", F.col("start") + F.col("k"))
        asked = asked.withColumn("pos", F.explode(F.sequence(F.col("pos") - slack, F.col("pos") + slack))) if slack else asked
        got = asked.join(lists, ["term_id", "doc", "pos"], "left_semi")
        if last - first > 1 or slack:
            n_seen = F.count_distinct("k") if slack else F.count(F.lit(1))
            got = got.groupBy("doc", "window", "size", "start").agg(n_seen.alias("n")).where(F.col("n") == F.least(F.col("size"), F.lit(last)) - first)
        older, done = found, found.where(F.col("size") <= first)
        found = work.cut(got.select("doc", "window", "size", "start").unionByName(done.select("doc", "window", "size", "start")))
        work.drop(older)
    return found


def coverage(found: DataFrame) -> DataFrame:
    """(doc, n_hit): words inside any match, each once."""
    by = Window.partitionBy("doc").orderBy("start", "end")
    ends = found.select("doc", "start", (F.col("start") + F.col("size")).alias("end")).distinct()
    before = F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = ends.withColumn("new", F.greatest(F.col("end") - F.greatest(F.col("start"), before), F.lit(0)))
    return new.groupBy("doc").agg(F.sum("new").cast("long").alias("n_hit"))


def contamination(work: Work, docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document of docs: its id, n_words, n_hit, items (sorted item ids as strings), contaminated."""
    terms, owners = windows(items)
    terms, owners = work.cut(terms), work.cut(owners)
    found = matches(work, docs, terms, id_col=id_col, text=text)
    n_owners = owners.count()
    names = found.select("doc", "window").distinct().join(small(owners, n_owners), "window").select("doc", F.col("item").cast("string").alias("item")).distinct()
    names = names.groupBy("doc").agg(F.array_sort(F.collect_list("item")).alias("items"))
    hit = coverage(found).join(names, "doc")
    n_words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    out = docs.select(F.col(id_col), n_words.alias("n_words")).join(hit, F.col(id_col) == F.col("doc"), "left")
    none = F.array().cast("array<string>")
    return out.select(id_col, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))
