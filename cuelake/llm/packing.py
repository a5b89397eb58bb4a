"""Best-fit packing planned on the length histogram.

Texts become token pieces of at most CAPACITY tokens. Only the histogram of piece lengths (at most CAPACITY rows, whatever the
corpus) goes to the driver, where best-fit decreasing runs over counts: a row of the plan places a run of equal pieces into
a run of equally filled sequences. Pieces find their slot by their rank within their length. Ranks come from counts per (length,
bucket), so a length that a third of all pieces share is ranked by many tasks.

Null texts count as empty: they are the one end token. Rows of equal id are packed each on its own. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache, partial
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import Work, small

if TYPE_CHECKING:
    from tokenizers import Encoding

CAPACITY, END_ID, RANK_ROWS = 4096, 1, 20_000
_CACHE, _DOCS, _RUNS = 400_000, 64, 128


class _Tokens(dict):
    """The ids of white-space-free runs of bytes, as little-endian uint32; white space is dropped by the vocabulary, so texts are the runs in a row."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core: threads of its own would only wait
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def learn(self, runs: set[bytes]) -> None:
        """Add the runs that are not known, many to a call: a call costs as much as a run. All others go when there is no room."""
        fresh = [r for r in runs if r not in self]
        if len(self) + len(fresh) > _CACHE:
            self.clear()
            fresh = list(runs)
        plain = [r for r in fresh if r.isalpha()]
        for some, letters in ((plain, True), ([r for r in fresh if not r.isalpha()], False)):
            parts = [some[i : i + _RUNS] for i in range(0, len(some), _RUNS)]
            texts = [[r.decode("utf-8", "replace") for r in part] for part in parts]
            encode = self.tokenizer.encode_batch_fast if letters else self.tokenizer.encode_batch
            for part, text, found in zip(parts, texts, encode([" ".join(t) for t in texts], add_special_tokens=False), strict=True):
                self._split(part, text, found, letters)

    def _split(self, part: list[bytes], text: list[str], found: Encoding, letters: bool) -> None:
        ids = np.array(found.ids, "<u4")
        at = np.flatnonzero(self.ends_word[ids]) + 1 if letters else None  # a run of letters is one word of the vocabulary
        if at is None or len(at) != len(part):
            found = self.tokenizer.encode(" ".join(text), add_special_tokens=False) if letters else found
            at = np.searchsorted(np.array([o[0] for o in found.offsets], np.int64), np.cumsum([len(t) + 1 for t in text]))
        raw, ends = ids.tobytes(), (4 * at).tolist()
        self.update(zip(part, [raw[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)], strict=True))


@cache
def _tokens(path: str) -> _Tokens:
    return _Tokens(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    tokens, end = _tokens(path), np.array([END_ID], "<u4").tobytes()
    for batch in batches:
        rows: list[tuple] = []
        for first in range(0, batch.num_rows, _DOCS):
            some = batch.slice(first, _DOCS)
            runs = [(text.as_py() or "").encode("utf-8", "replace").split() for text in some.column(1)]
            tokens.learn(set().union(*runs))
            for doc, own in zip(some.column(0).to_pylist(), runs, strict=True):
                ids = b"".join(map(tokens.__getitem__, own)) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
        names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types[: len(names)], strict=True)], names=names)


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The token pieces of every text; with_ids adds the ids themselves (little-endian uint32)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(partial(_cut, path=tokenizer, capacity=capacity, with_ids=with_ids), PIECES + ", ids binary" * with_ids)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, pieces in each, offset) of best-fit decreasing over counts."""
    rows, sequences = [], 0
    groups: dict[int, list[tuple[int, int]]] = {}  # room left: runs of sequences (first, number)
    rooms: list[int] = []

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            each = room // length
            placed = min(left, n * each)
            full, part = divmod(placed, each)
            rows.append((length, rank, placed, first, each, capacity - room))
            put(room - each * length, first, full)
            put(room - part * length, first + full, 1 if part else 0)
            put(room, first + full + bool(part), n - full - bool(part))
            left, rank = left - placed, rank + placed
    return rows


def pack(work: Work, docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their sequence_id and offset."""
    spark = work.spark
    cut = work.cut(pieces(docs, tokenizer, id_col=id_col, text=text, capacity=capacity).withColumn("row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan(histogram, capacity)
    planned = spark.createDataFrame(rows or [(0,) * 6], "length long, low long, placed long, first long, each long, base long")
    bucket = F.pmod(F.xxhash64("row"), F.lit(max(1, sum(histogram.values()) // RANK_ROWS)))
    cut = cut.withColumn("bucket", bucket)
    counts = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("length", "bucket", before.alias("before"))
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1)
    ranked = ranked.join(counts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    in_run = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("placed"))
    slots = ranked.join(small(planned.withColumnRenamed("length", "of"), len(rows)), (F.col("length") == F.col("of")) & in_run)
    i = F.col("rank") - F.col("low")
    return slots.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(i / F.col("each"))).cast("long").alias("sequence_id"), (F.col("base") + i % F.col("each") * F.col("length")).cast("long").alias("offset"))
