"""Importance resampling towards a target, with weights summed on bit planes.

Every document becomes counts of hashed word runs. The corpus's counts and the target's give each bucket an integer gain. A document's counts are cut
into bit planes of as many bits as there are buckets, and so are the gains (two's complement: the highest plane counts negative). Its weight, the sum of
count times gain, is then the sum over pairs of planes of popcount(counts AND gains) times a power of two: exact, and the same in any order.

The draw is by Gumbel keys: the highest sums of weight and a random number that the id alone decides. Rows are dealt to ranges of falling score, so ranks are
a range's start plus the place within it; only one row for each range is gathered.

Null and empty texts have no words: weight 0. Documents with fewer than ``least`` words are never drawn. Rows of equal id are each their own document and
share their random number; among equal scores and ids any order holds. A null id is hashed as an empty text and comes after all others. An empty table gives no rows, an empty target
gains that only reflect the corpus. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import Work

BUCKETS, RUN, SEED, LEAST_WORDS, PERCENT = 10_000, 1, "2024", 20, 10
BLOCK, MOST_PARTITIONS = 8192, 20_000
_DOCS, _CACHE, _LONG = 64, 500_000, 64

#: Bytes of words: digits, small letters and all beyond ASCII; capitals are lowered and all others become spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class _Buckets(dict):
    """Buckets of features, found once; long features are not kept, and all go when there is no room."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        if len(feature) <= _LONG:
            if len(self) >= _CACHE:
                self.clear()
            self[feature] = bucket
        return bucket


@cache
def _buckets(buckets: int) -> _Buckets:
    return _Buckets(buckets)


COUNTS = "n_words long, n_features long, buckets binary, counts binary"


def _count(batches: Iterator[pa.RecordBatch], buckets: int, run: int) -> Iterator[pa.RecordBatch]:
    """The last column holds texts; the others stay in front of COUNTS."""
    of = _buckets(buckets)
    for batch in batches:
        out: list[tuple[int, int, bytes, bytes]] = []
        for text in batch.column(batch.num_columns - 1):
            words = (text.as_py() or "").encode("utf-8", "replace").translate(_TABLE).split()
            features = Counter(words)
            for n in range(2, run + 1):
                features.update(map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False)))
            at = np.fromiter(map(of.__getitem__, features), np.int64, len(features))
            some, back = np.unique(at, return_inverse=True)
            n = np.zeros(len(some), np.int64)
            np.add.at(n, back, np.fromiter(features.values(), np.int64, len(features)))
            out.append((len(words), int(n.sum()), some.astype("<u4").tobytes(), n.astype("<u4" if n.size and n.max() < 2**32 else "<u8").tobytes()))
        columns = list(zip(*out, strict=True)) or [()] * 4
        made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "n_words", "n_features", "buckets", "counts"])


def counts(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(doc_id, n_words, n_features, buckets, counts): a text's distinct buckets (little-endian uint32) and how many of its features each holds."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(partial(_count, buckets=buckets, run=run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {COUNTS}")


def _sparse(batch: pa.RecordBatch, first: int, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) of some documents of a batch that has columns buckets and counts."""
    at = [np.frombuffer(x.as_py(), "<u4") for x in batch.column("buckets").slice(first, docs)]
    n = [np.frombuffer(x.as_py(), "<u4" if len(x.as_py()) == 4 * len(b) else "<u8") for x, b in zip(batch.column("counts").slice(first, docs), at, strict=True)]
    none = np.zeros(0, np.int64)
    return np.repeat(np.arange(len(at)), [len(b) for b in at]), np.concatenate([none, *at]).astype(np.int64), np.concatenate([none, *n]).astype(np.int64)


def _total(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """One row for each bucket that this task's documents hold."""
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for first in range(0, batch.num_rows, _DOCS):
            _, at, n = _sparse(batch, first, _DOCS)
            np.add.at(total, at, n)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])


def totals(counted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all documents: each task sends at most one row for a bucket."""
    return counted.select("buckets", "counts").mapInArrow(partial(_total, buckets=buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of the buckets that the source holds, from the totals of source and target: the logarithm of their smoothed ratio in thousandths, rounded down."""
    both = source.select("bucket", F.col("n").alias("s")).join(target.select("bucket", F.col("n").alias("t")), "bucket", "full").fillna(0, ["s", "t"])
    everything = Window.partitionBy(F.lit(0))  # as many rows as buckets at most
    both = both.withColumns({"all_s": F.sum("s").over(everything), "all_t": F.sum("t").over(everything)})
    smoothed = lambda n, more: n.cast("double") + more
    ratio = smoothed(F.col("t"), 1.0) * smoothed(F.col("all_s"), float(buckets)) / (smoothed(F.col("s"), 1.0) * smoothed(F.col("all_t"), float(buckets)))
    return both.where("s > 0").select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def planes(set_bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(set_bits, axis=-1, bitorder="little")
    room = -packed.shape[-1] % 8
    return np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, room)]).view("<u8")


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two's complement planes of gains, and what a bit of each is worth."""
    bits = max(int(np.abs(gain).max(initial=0)).bit_length(), 1) + 1
    worth = 2 ** np.arange(bits, dtype=np.int64)
    worth[-1] *= -1
    return np.stack([planes((gain >> i) & 1 == 1) for i in range(bits)]), worth


def sliced_weights(doc: np.ndarray, bucket: np.ndarray, count: np.ndarray, docs: int, gain: tuple[np.ndarray, np.ndarray], buckets: int) -> np.ndarray:
    """Sums of count times gain of some documents."""
    out, level = np.zeros(docs, np.int64), 0
    while len(count):
        odd = (count & 1) == 1
        if odd.any():
            rows, back = np.unique(doc[odd], return_inverse=True)
            dense = np.zeros((len(rows), buckets), bool)
            dense[back, bucket[odd]] = True
            own = planes(dense)
            for plane, worth in zip(*gain, strict=True):
                out[rows] += (np.bitwise_count(own & plane).sum(axis=1, dtype=np.int64) * worth) << level
        more = count > 1
        doc, bucket, count, level = doc[more], bucket[more], count[more] >> 1, level + 1
    return out


def _weigh(batches: Iterator[pa.RecordBatch], gain: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    sliced = gain_planes(gain)
    for batch in batches:
        out = [sliced_weights(*_sparse(batch, first, _DOCS), min(_DOCS, batch.num_rows - first), sliced, buckets) for first in range(0, batch.num_rows, _DOCS)]
        kept = [n for n in batch.schema.names if n not in ("buckets", "counts")]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(np.concatenate([np.zeros(0, np.int64), *out]), pa.int64())], names=[*kept, "weight"])


def weights(counted: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """counted with the weight of each document instead of its counts. Of gain, at most one row for each bucket goes to the driver."""
    dense = np.zeros(buckets, np.int64)
    for row in gain.collect():
        dense[row["bucket"]] = row["gain"]
    kept = [c for c in counted.columns if c not in ("buckets", "counts")]
    schema = ", ".join([*[f"{c} {counted.schema[c].dataType.simpleString()}" for c in kept], "weight long"])
    return counted.mapInArrow(partial(_weigh, gain=dense, buckets=buckets), schema)


def gumbel(id_: Column, seed: str = SEED) -> Column:
    """A random number that seed and id alone decide, in thousandths, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def draw(work: Work, weighed: DataFrame, *, percent: int = PERCENT, least: int = LEAST_WORDS, seed: str = SEED, block: int = BLOCK) -> DataFrame:
    """weighed (doc_id, n_words, weight, ...) with score and rank: of the N documents with at least ``least`` words the N * percent // 100 highest, from 1; null for the others."""
    scored = weighed.withColumns({"score": F.col("weight") + gumbel(F.col("doc_id"), seed), "able": F.col("n_words") >= least, "row": F.monotonically_increasing_id()})
    scored = work.cut(scored)
    parts = min(max(1, -(-scored.count() // block)), MOST_PARTITIONS)
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    dealt = scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())  # the partition's number, and the place in it from bit 33 down
    dealt = work.keep(dealt.drop("row").withColumns({"part": F.shiftright("place", 33), "nth": F.col("place").bitwiseAND(2**33 - 1) + 1}).drop("place"))
    sizes = dealt.groupBy("part").agg(F.count_if("able").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.floor(F.sum("n").over(Window.partitionBy(F.lit(0))) * percent / 100).alias("take"))
    rank = F.col("before") + F.col("nth")
    out = dealt.join(F.broadcast(starts), F.col("part") == F.col("p"))  # at most MOST_PARTITIONS rows
    return out.withColumn("rank", F.when(F.col("able") & (rank <= F.col("take")), rank)).drop("able", "part", "nth", "p", "before", "take")


def resample(work: Work, docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least: int = LEAST_WORDS, seed: str = SEED, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of docs (doc_id, text), drawn to be like the texts of target."""
    counted = work.cut(counts(docs, buckets=buckets, run=run))
    aim = totals(counts(target.select(F.lit(0).alias("doc_id"), "text"), buckets=buckets, run=run), buckets)
    gain = gains(totals(counted, buckets), aim, buckets)
    return draw(work, weights(counted, gain, buckets), percent=percent, least=least, seed=seed)
