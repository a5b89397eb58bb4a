"""MinHash near-duplicate detection with sequential Bayesian verification.

Texts become sets of distinct 5-word shingles and signatures of HASHES minima. Documents of equal sets are one class.
Signatures are cut into BANDS; classes that share a band are candidates. At the agreed similarity of 0.85 a pair
shares no band with probability (1 - 0.85**4)**32, about 6e-11. A candidate's signatures are compared in batches: after each
batch, the posterior of the similarity (uniform prior) is a Beta distribution, and the pair is dropped as soon as it is
below the threshold but for a probability of MISS. What survives all batches is verified on the full sets.

Null or empty texts, and texts without words, have empty sets and are linked with nothing. Texts of fewer than five
words are one shingle, their whole word sequence. Rows of equal id must have equal texts; each row is returned. Rows of
null id keep themselves and have no component. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import BROADCAST_ROWS, Work, small
from cuelake.llm.components import Groups

SHINGLE, HASHES, BANDS, BATCH = 5, 128, 32, 16
PERCENT, MISS = 85, 1e-9
#: Rounds of hubs (one a bucket) for the bands. What they leave unresolved is candidates by rare shingles; eight hubs for each of 32 bands would be all different.
HUB_ROUNDS = 1
#: Set sizes of one class differ by at most this factor.
SIZE_CLASS = 1.01
_CACHE = 200_000


class _Words(dict):
    """Word hashes, remembered; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


@cache
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    draw = lambda n: rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return draw(SHINGLE), draw(HASHES), draw(HASHES)


def shingles(text: str | None, words: _Words) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(parts)
    if n < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), seed=n)] if n else [], np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, n)
    c = _constants()[0]
    total = h[: n - SHINGLE + 1] * c[0]
    for k in range(1, SHINGLE):
        total += h[k : n - SHINGLE + 1 + k] * c[k]
    return np.unique(_mix(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """HASHES minima (32 bits each), taken over blocks so that memory stays small for any length."""
    _, a, b = _constants()
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(hashes), 512):
        block = hashes[i : i + 512, None] * a
        block += b
        block >>= np.uint64(32)
        np.minimum(out, block.min(axis=0).astype(np.uint32), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, -1).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(rows.shape[1]):
        key = _mix(key * np.uint64(0xD1B54A32D192ED03) + rows[:, k])
    return key.view(np.int64)


SKETCH = "id long, n_shingles long, digest binary, sig binary, bands array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])
    for batch in batches:
        sizes, digests, sigs, bands = [], [], [], []
        for text in batch.column(1):
            s = shingles(text.as_py(), words)
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            sig = signature(s) if len(s) > SHINGLE else None  # smaller sets can only link with equal ones
            sigs.append(None if sig is None else sig.tobytes())
            bands.append([] if sig is None else band_keys(sig))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For each batch, the fewest equal minima so far that leave P(similarity >= threshold) at ``miss`` or more."""
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        cdf, m = 0.0, 0
        for m in range(n + 1):  # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
            cdf += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if cdf >= miss:
                break
        out.append(m)
    return out


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    need = least_matches()
    for batch in batches:
        alive = np.arange(batch.num_rows)
        left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, HASHES) for i in (2, 3))
        same = np.zeros(batch.num_rows, np.int64)
        for k, least in enumerate(need):
            at = slice(k * BATCH, (k + 1) * BATCH)
            same[alive] += (left[alive, at] == right[alive, at]).sum(axis=1)
            alive = alive[same[alive] >= least]
        yield batch.select([0, 1]).take(pa.array(alive))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: _Words = _Words()
    for batch in batches:
        ids_a, ids_b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        last: dict[int, np.ndarray] = {}
        keep = []
        for i, (a, b) in enumerate(zip(ids_a, ids_b, strict=True)):
            if len(last) > 64:
                last.clear()
            for key, column in ((a, 2), (b, 3)):
                if key not in last:
                    last[key] = shingles(batch.column(column)[i].as_py(), words)
            x, y = last[a], last[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            sets = [shingles(t.as_py(), words).view(np.int64) for t in part.column(1)]
            n = np.array([len(s) for s in sets], np.int64)
            ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets))], names=["item", "n", "s"])


def rare_shingles(work: Work, texts: DataFrame, items: DataFrame) -> DataFrame:
    """Exact candidates for the items of buckets in which many are alike, yet not linked: (bucket, item, side).

    Two sets of sizes n and m that reach the threshold have at least 17/37 * (n + m) shingles in common (0.85 / 1.85),
    so among the n - 17/37 * (n + m) + 1 rarest of either, one is shared. Sizes are put into classes; an item is listed
    under these rarest shingles once for every class a partner may have, so that only pairs which may still reach
    the threshold meet in a bucket. Shingles that no other item has take their place in the ranking but list nothing.

    Items of which more than 3/37 (15 / 185) is such shingles are apart: of two of them at most 34/37 of the smaller set is shared, and the union is at
    least 40/37 of it, which is below the threshold. So they are asked only about items that are not apart, and a family of texts just below the threshold makes no pairs.
    """
    texts = texts.join(items.withColumnRenamed("item", "id"), "id", "left_semi")
    flat = work.cut(texts.select("id", "text").mapInArrow(_explode, "item long, n long, s long").distinct())
    shared = flat.groupBy("s").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    ranked = flat.join(shared, "s").groupBy("item", "n").agg(F.array_sort(F.collect_list(F.struct("rows", "s"))).alias("ranked"))
    n, ratio = F.col("n"), float(np.log(SIZE_CLASS))
    size_class = lambda x: F.floor(F.log(F.greatest(x, F.lit(1))) / ratio).cast("int")
    own = size_class(n)
    alone = n - F.size("ranked")
    apart = (100 + PERCENT) * alone > (100 - PERCENT) * n

    def listed(m: Column) -> Column:
        least = F.greatest(F.floor(F.pow(F.lit(SIZE_CLASS), m)) - 1, F.lit(1))
        prefix = n - F.ceil(PERCENT * (n + least) / (100 + PERCENT)) + 1
        rare = F.slice("ranked", F.lit(1), F.greatest(prefix - alone, F.lit(0)).cast("int"))
        under = lambda part, side: F.transform(rare, lambda r: F.struct(F.xxhash64(r["s"], F.least(own, m), F.greatest(own, m), part).alias("bucket"), side.alias("side")))
        # Part 0 holds the smaller sets that are not apart and all larger ones, part 1 the smaller ones that are apart and the larger that are not.
        first = under(F.when((own < m) & apart, 1).otherwise(0), F.when(own > m, 1).when((own < m) | apart, 0).otherwise(2))
        return F.concat(first, F.when((own > m) & ~apart, under(F.lit(1), F.lit(1))).otherwise(F.slice(first, 1, 0)))

    partners = F.sequence(size_class(n * PERCENT / 100 - 1), size_class(n * 100 / PERCENT + 1))
    return ranked.select("item", F.inline(F.flatten(F.transform(partners, listed))))


def near_duplicates(work: Work, docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: id, n_shingles, component (least id reachable over links), n_copies (rows of the same set)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    sketches = work.cut(texts.mapInArrow(_sketch, SKETCH))
    linked = sketches.where("n_shingles > 0 AND id IS NOT NULL")
    classes = work.cut(linked.groupBy("digest", "sig", "bands").agg(F.min("id").alias("item"), F.count(F.lit(1)).alias("n_copies")))
    members = classes.select(F.posexplode("bands").alias("band", "key"), "item").select(F.xxhash64("band", "key").alias("bucket"), "item")
    sigs = classes.where("sig IS NOT NULL").select("item", "sig")

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda df, end, value: df.select(F.col(df.columns[0]).alias(end), F.col(value).alias(f"{value}_{end}"))
        signed = pairs.join(side(sigs, "a", "sig"), "a").join(side(sigs, "b", "sig"), "b")
        likely = work.cut(signed.select("a", "b", "sig_a", "sig_b").mapInArrow(_plausible, "a long, b long"))
        ends = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        n = likely.count()
        needed = texts.join(small(ends, 2 * n), "id", "left_semi") if 2 * n <= BROADCAST_ROWS else texts
        # Only rows that represent their class are asked for; rows of equal id have equal texts, and one is enough.
        full = likely.join(side(needed, "a", "text"), "a").join(side(needed, "b", "text"), "b")
        links = full.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long")
        return links.distinct()

    groups = Groups(work, verify)
    rest = groups.resolve(members, HUB_ROUNDS)
    if rest is not None:
        groups.resolve(rare_shingles(work, texts, rest.select("item").distinct()), hubs=8)
    labels = groups.table()
    found = classes.select("digest", "item", "n_copies").join(labels, "item", "left").select("digest", F.coalesce("component", "item").alias("component"), "n_copies")
    out = sketches.select("id", "n_shingles", "digest").join(found, "digest", "left")
    own = (F.col("n_shingles") == 0) | F.col("id").isNull()
    component, copies = F.when(own, F.col("id")).otherwise(F.col("component")), F.when(own, F.lit(1)).otherwise(F.col("n_copies"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component"), copies.cast("long").alias("n_copies"))
