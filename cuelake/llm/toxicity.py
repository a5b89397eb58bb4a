"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms; the score is the logistic of a bias, a weight per term and, for every pair of terms, the
product of their factor vectors, so that a pair (an insult and whom it is aimed at) can weigh more than its parts. The model
is fitted with AdaGrad on at most TRAIN_ROWS labelled rows, the first by a hash of the id. All terms that MIN_SEEN of these rows hold take
part: first those whose share among toxic and other rows differs by over MIN_Z standard errors, then, starting from there, all of
them, so that terms that are neutral by themselves can weigh as a pair.

Null and empty texts score by the bias alone. Without labelled rows every score is 0.5. Labels that repeat count once (the
higher). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, FACTORS, TRAIN_ROWS, MIN_SEEN, EPOCHS, RATE, DECAY = 1 << 18, 4, 8_000, 3, 30, 0.2, 1e-4
#: The first EPOCHS move the terms that tell the classes apart by themselves; ALL_EPOCHS more, more slowly, move all terms.
MIN_Z, ALL_EPOCHS, ALL_RATE, ALL_START = 4.0, 10, 0.02, 0.01
MARKS = " .,;:!?\"'()[]{}<>|*#$%&-_/\\…“”‘’«»"
_CACHE = 300_000


class _Terms(dict):
    """The bucket of a raw word, lower-cased and without marks around it; -1 for marks alone."""

    def __missing__(self, raw: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        word = raw.lower().strip(MARKS)
        self[raw] = out = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) % BUCKETS if word else -1
        return out


def terms(text: str | None, cache: _Terms) -> np.ndarray:
    raw = (text or "").split()
    found = np.unique(np.fromiter(map(cache.__getitem__, raw), np.int64, len(raw)))
    return found[found >= 0]


@dataclass(frozen=True)
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    used: np.ndarray  # position of a bucket among the fitted terms, else -1

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        for i, row in enumerate(rows):
            at = self.used[row]
            at = at[at >= 0]
            if len(at):
                v = self.factors[at]
                out[i] += self.weights[at].sum() + 0.5 * (v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum()
        return out


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Machine:
    """AdaGrad on the logistic loss, one row at a time, in a fixed random order."""
    used, pos, neg = np.full(BUCKETS, -1), max(labels.sum(), 1), max((1 - labels).sum(), 1)
    seen = [np.bincount(np.concatenate([np.empty(0, np.int64), *[r for r, y in zip(rows, labels, strict=True) if y == k]]), minlength=BUCKETS) for k in (0, 1)]
    share = (seen[0] + seen[1]) / max(len(rows), 1)
    error = np.sqrt(share * (1 - share) * (1 / pos + 1 / neg))
    z = np.abs(seen[1] / pos - seen[0] / neg) / np.maximum(error, 1e-9)
    kept = np.flatnonzero(seen[0] + seen[1] >= MIN_SEEN)
    used[kept] = np.arange(len(kept))
    telling = z[kept] > MIN_Z
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(kept)), rng.normal(0, 0.05, (len(kept), FACTORS))
    v[~telling] *= ALL_START / 0.05
    bias = float(np.log(pos / neg)) if len(rows) and 0 < labels.sum() < len(rows) else 0.0
    gw, gv, gb = np.full(len(kept), 1e-2), np.full(v.shape, 1e-2), 1e-2
    every = [at[at >= 0] for at in (used[r] for r in rows)]
    for epochs, rate, data in ((EPOCHS if telling.any() else 0, RATE, [at[telling[at]] for at in every]), (ALL_EPOCHS if len(kept) else 0, ALL_RATE, every)):
        for i in (i for _ in range(epochs) for i in rng.permutation(len(data))):
            at, y = data[i], labels[i]
            total = v[at].sum(axis=0)
            logit = bias + w[at].sum() + 0.5 * (total**2 - (v[at] ** 2).sum(axis=0)).sum()
            g = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
            if len(at):
                step = g + DECAY * w[at]
                gw[at] += step**2
                w[at] -= rate * step / np.sqrt(gw[at])
                step = g * (total - v[at]) + DECAY * v[at]
                gv[at] += step**2
                v[at] -= rate * step / np.sqrt(gv[at])
    return Machine(bias, w, v, used)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Machine:
    """Fit on at most ``rows`` labelled documents of docs."""
    labels = labels.where("toxic IS NOT NULL").groupBy(F.col(id_col).alias("_label")).agg(F.max("toxic").alias("toxic"))
    ids = docs.select(id_col).join(labels, F.col(id_col) == F.col("_label")).select("_label", "toxic").distinct()
    chosen = ids.orderBy(F.xxhash64(F.col("_label").cast("string")), "_label").limit(rows)
    cache = _Terms()
    hashed = F.pandas_udf(lambda batch: batch.map(lambda t: terms(t, cache).astype(np.int32)), "array<int>")  # the driver gets distinct terms, not texts
    sample = docs.select(id_col, F.col(text).alias("text")).join(F.broadcast(chosen), F.col(id_col) == F.col("_label")).select("_label", "toxic", hashed("text").alias("terms"))
    found = sample.toPandas().drop_duplicates("_label").sort_values("_label")
    return fit([np.asarray(t, np.int64) for t in found["terms"]], found["toxic"].to_numpy(np.float64))


def score(docs: DataFrame, machine: Machine, *, text: str = "text") -> DataFrame:
    """docs, without the text, and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    cache = _Terms()

    def logistic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            logits = shared.value.logits([terms(t, cache) for t in batch])
            yield pd.Series(1 / (1 + np.exp(-np.clip(logits, -30, 30))))

    return docs.withColumn("score", F.pandas_udf(logistic, "double")(F.col(text))).drop(text)
