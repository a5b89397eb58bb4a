"""Exact top-k search by inner product, with a pivot table to pass over candidates.

Vectors become integers. As |x - q|^2 = |x|^2 + |q|^2 - 2 x.q, a lower bound of the distance is an upper bound of the inner product. For any pivot p the
triangle inequality gives |x - q| >= | |x - p| - |q - p| |, and the greatest of these over many pivots is the bound. The distances of all rows to the pivots
are computed once and written with the rows, in blocks. Query blocks meet all row blocks: of each pair, candidates are taken in falling order of their bounds, and the
search of a query stops when the next bound is below the k-th score it has. That starts as the k-th score among a sample of rows, so it is good from the first block.
Nothing is approximate: pivots and sample only decide how early a search stops.

Pivots are fitted on the SAMPLE rows with the least hashes of their ids, each the row farthest from those before it. Vectors of other lengths than a query's are
no candidates of it; lengths that the sample lacks have no pivots, and are bounded by their norms alone.

Vectors that are null or empty or hold null, infinite or NaN components take no part, nor do rows of null id. Rows of a query's own id are never its candidates; other rows that share an
id are candidates each. Queries that share an id count once, with the least vector. Ties go to the smaller id. Fewer candidates than k give fewer rows; no queries give none. Components and scores
beyond a long stay at its limits. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import Work

K, SCALE, PIVOTS, SAMPLE = 10, 1024, 64, 2000
#: Rows of a block, query rows of a block, rows of a part (what a task holds at once).
BLOCK, QUERY_BLOCK, PART = 2048, 256, 8192
_FIRST, _LIMIT = 32, 2**63 - 1


def integers(vectors: DataFrame, *, id_col: str = "vec_id", vec: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the rows that take part: components times scale, rounded down."""
    x = F.col(vec)
    sound = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return vectors.where(F.col(id_col).isNotNull() & (F.size(x) > 0) & sound).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def _matrix(rows: list[list[int]]) -> np.ndarray:
    return np.array(rows, np.int64).reshape(len(rows), -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b = x.astype(float), y.astype(float)
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(x: np.ndarray, most: int) -> np.ndarray:
    """Rows of x, each the farthest from those before it; the first is the farthest from the mean."""
    near = distances(x, x.mean(axis=0, keepdims=True))[:, 0]
    chosen: list[int] = []
    while len(chosen) < min(most, len(x)):
        at = int(near.argmax())
        if chosen and near[at] <= 0:
            break
        own = distances(x, x[at : at + 1])[:, 0]
        near = own if not chosen else np.minimum(near, own)
        chosen.append(at)
    return x[chosen]


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products of the rows of x with q, at the limits of a long where they leave it."""
    most = lambda v: max(int(v.max(initial=0)), -int(v.min(initial=0)))
    size = most(x) * most(q) * len(q)
    if size < 2**53:
        return (x.astype(float) @ q.astype(float)).astype(np.int64)
    if size < 2**63:
        return x @ q
    return np.array([max(-_LIMIT - 1, min(_LIMIT, sum(int(a) * int(b) for a, b in zip(row, q, strict=True)))) for row in x], np.int64)


class Best:
    """The k best (score, smaller id first) so far, as a heap whose first is the worst."""

    def __init__(self, k: int, floor: int | None) -> None:
        self.k, self.floor, self.heap = k, floor, []

    def least(self) -> float:
        """Candidates below this score are of no use; those equal to it may be."""
        if len(self.heap) == self.k:
            return self.heap[0][0] if self.floor is None else max(self.heap[0][0], self.floor)
        return float("-inf") if self.floor is None else self.floor

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        some = np.flatnonzero(scores >= self.least())
        if len(some) > self.k:
            some = some[np.lexsort((ids[some], -scores[some]))[: self.k]]
        for i in some.tolist():
            item = (int(scores[i]), -int(ids[i]))
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, item)
            elif item > self.heap[0]:
                heapq.heapreplace(self.heap, item)


Model = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def fit(vectors: DataFrame, *, pivots: int = PIVOTS, sample: int = SAMPLE) -> Model:
    """Of each vector length in the sample: (pivots, ids, rows). At most ``sample`` rows go to the driver."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect()
    out = {}
    for size, own in groupby(sorted(rows, key=lambda r: len(r["v"])), key=lambda r: len(r["v"])):
        own = list(own)
        x = _matrix([r["v"] for r in own])
        out[size] = (choose_pivots(x, pivots), np.array([r["vec_id"] for r in own], np.int64), x)
    return out


BLOCKS = "block long, dim int, ids binary, rows binary, dists binary, floors array<long>"


def _pack(batches: Iterator[pa.RecordBatch], model: Model, size: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows as blocks with their distances to the pivots; for k > 0 also the k-th best score of each among the sample (null: too few)."""
    for batch in batches:
        ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        out = []
        for dim in sorted(set(np.diff(at).tolist())):
            which = np.flatnonzero(np.diff(at) == dim)
            for first in range(0, len(which), size):
                some = which[first : first + size]
                x = np.stack([flat[at[i] : at[i] + dim] for i in some]).astype(np.int64)
                pivots, known, rows = model.get(dim, (np.zeros((0, dim), np.int64),) * 3)
                floors = [None] * len(some)
                if k:
                    for i, row in enumerate(x):
                        scores = inner(rows, row)[known.ravel() != ids[some[i]]] if len(rows) else np.zeros(0, np.int64)
                        floors[i] = int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else None
                kind = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max)
                out.append((int(ids[some[0]]), dim, ids[some].astype("<i8").tobytes(), x.astype(kind).tobytes(), distances(x, pivots).astype("<f4").tobytes(), floors))
        columns = list(zip(*out, strict=True)) or [()] * 6
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["block", "dim", "ids", "rows", "dists", "floors"])


def blocks(vectors: DataFrame, model: Model, size: int, k: int = 0) -> DataFrame:
    return vectors.select("vec_id", "v").mapInArrow(partial(_pack, model=model, size=size, k=k), BLOCKS)


def _open(ids: bytes, rows: bytes, dists: bytes, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, rows, distances to pivots, squared norms) of a block."""
    own = np.frombuffer(ids, "<i8")
    x = np.frombuffer(rows, f"<i{len(rows) // (len(own) * dim)}").reshape(len(own), dim).astype(np.int64)
    return own, x, np.frombuffer(dists, "<f4").reshape(len(own), -1), (x.astype(float) ** 2).sum(1)


def bounds(dq: np.ndarray, nq: float, dx: np.ndarray, nx: np.ndarray) -> np.ndarray:
    """Upper bounds of the products of a query with rows. dx: pivots by rows. Distances are rounded: what that may add is taken off."""
    with np.errstate(all="ignore"):
        gap = np.zeros(len(nx), np.float32)
        for of_rows, of_query in zip(dx, dq, strict=True):
            np.maximum(gap, np.abs(of_rows - of_query), out=gap)
        apart = np.maximum(gap.astype(float) - 3e-6 * (np.sqrt(nx) + np.sqrt(nq) + np.abs(dq).max(initial=0)), 0)
    by_pivots = (nq + nx - np.where(np.isfinite(apart), apart, 0) ** 2) / 2
    return np.minimum(by_pivots, np.sqrt(nq * nx)) + 1e-9 * (nq + nx) + 1


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a query block and a row block; those of one query block and part come in a row."""
    now, best, query = None, [], None

    def done() -> pa.RecordBatch:
        rows = [(int(q), -minus_id, score) for q, b in zip(query[0], best, strict=True) for score, minus_id in b.heap] if query else []
        columns = list(zip(*rows, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    for batch in batches:
        for i in range(batch.num_rows):
            r = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
            if (r["q_block"], r["part"], r["dim"]) != now:
                yield done()
                now, query = (r["q_block"], r["part"], r["dim"]), _open(r["q_ids"], r["q_rows"], r["q_dists"], r["dim"])
                best = [Best(k, floor) for floor in r["q_floors"]]
            ids, x, dx, nx = _open(r["ids"], r["rows"], r["dists"], r["dim"])
            dx = np.ascontiguousarray(dx.T)
            for q_id, q, dq, nq, b in zip(*query, best, strict=True):
                upper = bounds(dq, nq, dx, nx)
                some = np.flatnonzero((upper >= b.least()) & (ids != q_id))
                some, at, step = some[np.argsort(-upper[some], kind="stable")], 0, _FIRST
                while at < len(some) and upper[some[at]] >= b.least():
                    part = some[at : at + step]
                    b.add(inner(x[part], q), ids[part])
                    at, step = at + step, step * 2
    yield done()


def top_k(work: Work, vectors: DataFrame, queries: DataFrame, k: int = K, *, pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of vectors for each row of queries; both are (vec_id, v) as integers() gives them."""
    model = fit(vectors, pivots=pivots, sample=sample)
    parts = max(1, -(-vectors.count() // PART))
    rows = work.cut(blocks(vectors, model, BLOCK).drop("floors").withColumn("part", F.pmod(F.xxhash64("block", "ids"), F.lit(parts))))
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = work.cut(blocks(asked, model, QUERY_BLOCK, k).select(F.xxhash64("ids").alias("q_block"), "dim", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("dists").alias("q_dists"), F.col("floors").alias("q_floors")))
    # Queries are few to a row (blocks of them are copied to every part), and a part's rows are what a task holds while the query blocks pass.
    met = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).hint("merge").join(rows, ["part", "dim"])
    found = met.mapInArrow(partial(_search, k=k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
