"""Language identification by a byte convolutional network.

Texts are cut into windows of WINDOW bytes. Bytes are embedded, filters of several widths slide over them, each filter's largest response
goes to a softmax over the languages. The net is trained in numpy (Adam) on windows of labelled rows, of each
language at most TRAIN_ROWS shared out evenly (what small languages leave goes to the others; one row at least): its first by a hash of the id. A text's probabilities are the mean over all its windows, weighted by their bytes.

Null texts and texts without a letter are ``und`` with score 0, as is everything if no labelled text was given.
Extra columns pass through, whatever their names; lang_pred and score replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import free_names

WINDOW, EMBED, WIDTHS, FILTERS, TRAIN_ROWS, EPOCHS, BATCH, RATE = 256, 6, (2, 3, 4), 12, 3_000, 6, 32, 0.01
UNKNOWN = "und"


@dataclass
class Net:
    """Embeddings, one filter matrix for all widths (narrower filters have zeros beyond their width), softmax layer."""

    languages: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def patches(self, windows: np.ndarray) -> np.ndarray:
        wide = max(WIDTHS)
        e = self.embed[np.pad(windows, ((0, 0), (0, wide - 1)))]
        n, length, d = e.shape
        view = np.lib.stride_tricks.as_strided(e, (n, length - wide + 1, wide * d), (e.strides[0], e.strides[1], e.strides[2]))
        return np.ascontiguousarray(view)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(0, len(windows), 256):
            p = self.patches(windows[i : i + 256])
            top = np.maximum((p.reshape(-1, p.shape[2]) @ self.filters).reshape(*p.shape[:2], -1).max(axis=1) + self.bias, 0)
            z = top @ self.out + self.out_bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            parts.append(e / e.sum(axis=1, keepdims=True))
        return np.concatenate(parts)


def cut(data: bytes) -> np.ndarray:
    """All windows of a text, the last padded with zeros."""
    padded = np.zeros(-(-len(data) // WINDOW) * WINDOW, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return padded.reshape(-1, WINDOW)


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 5) -> Net:
    rng = np.random.default_rng(seed)
    mask = np.concatenate([np.tile((np.arange(max(WIDTHS)) < w).repeat(EMBED)[:, None], FILTERS) for w in WIDTHS], axis=1)
    n_filters, k = FILTERS * len(WIDTHS), len(languages)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    params = [draw(256, EMBED, scale=0.5), draw(max(WIDTHS) * EMBED, n_filters, scale=0.3) * mask, np.zeros(n_filters, np.float32), draw(n_filters, k, scale=0.2), np.zeros(k, np.float32)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), BATCH):
            x, y = windows[order[i : i + BATCH]], labels[order[i : i + BATCH]]
            net, rows = Net(languages, *params), np.arange(len(x))
            p = net.patches(x)
            r = (p.reshape(-1, p.shape[2]) @ params[1]).reshape(*p.shape[:2], -1)
            at = r.argmax(axis=1)
            top = np.take_along_axis(r, at[:, None, :], 1)[:, 0] + params[2]
            hidden = np.maximum(top, 0)
            z = hidden @ params[3] + params[4]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            d = e / e.sum(axis=1, keepdims=True)
            d[rows, y] -= 1
            d /= len(x)
            back = (d @ params[3].T) * (top > 0)
            chosen = p[rows[:, None], at]  # rows, filters, patch
            g_filters = np.einsum("nf,nfp->pf", back, chosen) * mask
            g_embed = np.zeros_like(params[0])
            spread = (back[:, :, None] * params[1].T[None]).reshape(len(x), n_filters, max(WIDTHS), EMBED)
            padded = np.pad(x, ((0, 0), (0, max(WIDTHS) - 1)))
            for j in range(max(WIDTHS)):
                np.add.at(g_embed, padded[rows[:, None], at + j], spread[:, :, j])
            t += 1
            for q, g in enumerate([g_embed, g_filters, back.sum(axis=0), hidden.T @ d, d.sum(axis=0)]):
                m[q] = 0.9 * m[q] + 0.1 * g
                v[q] = 0.999 * v[q] + 0.001 * g * g
                params[q] = (params[q] - RATE * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Net(languages, *params)


def shares(counts: dict[str, int], rows: int) -> dict[str, int]:
    """Rows of each language: smallest languages first, each at most an even part of what is left, and at least one."""
    out: dict[str, int] = {}
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda c: (c[1], c[0]))):
        out[lang] = min(n, max(1, (rows - sum(out.values())) // (len(counts) - i)))
    return out


def train(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Net | None:
    """Fit on at most ``rows`` labelled documents (one per language if there are more languages), two windows of each, at places that a hash gives."""
    known = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(id_col).cast("string").alias("id"), F.col(lang).alias("lang"), F.col(text).alias("t"))
    room = F.greatest(F.length("t") - WINDOW, F.lit(0)) + 1
    places = F.array(*[F.substr("t", F.pmod(F.xxhash64("id", F.lit(i)), room).cast("int") + 1, F.lit(WINDOW)) for i in (1, 2)])
    share = shares({r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}, rows)
    if not share:
        return None
    # A top-n per language: every partition sends at most its share of each.
    firsts = [known.where(F.col("lang") == y).select("id", "lang", places.alias("parts")).orderBy(F.xxhash64("id"), "id").limit(n).toPandas() for y, n in share.items()]
    chosen = pd.concat(firsts).sort_values(["id", "lang"])
    languages = sorted(chosen["lang"].unique())
    pairs = [(cut(part.encode("utf-8", "replace"))[0], languages.index(y)) for parts, y in zip(chosen["parts"], chosen["lang"], strict=True) for part in parts]
    return fit(np.stack([w for w, _ in pairs]), np.array([y for _, y in pairs]), languages)


def predict(docs: DataFrame, net: Net | None, *, text: str = "text") -> DataFrame:
    """docs, without the text, and lang_pred and score, which replace columns of these names; all others stay, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def languages(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            net = shared.value
            found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(batch)
            todo = [i for i, t in enumerate(batch) if net is not None and t is not None and any(map(str.isalpha, t))]
            for at in range(0, len(todo), 200):
                part = [(i, batch.iloc[i].encode("utf-8", "replace")) for i in todo[at : at + 200]]
                windows = [cut(data) for _, data in part]
                p, lo = net.probabilities(np.concatenate(windows)), 0
                for (i, data), w in zip(part, windows, strict=True):
                    weights = np.full(len(w), WINDOW, np.float64)
                    weights[-1] = len(data) - WINDOW * (len(w) - 1)
                    mean = (p[lo : lo + len(w)] * weights[:, None]).sum(axis=0) / weights.sum()
                    lo += len(w)
                    best = int(mean.argmax())
                    found[i] = (net.languages[best], float(min(mean[best], 1.0)))
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    udf = F.pandas_udf(languages, "lang_pred string, score double")
    (p,) = free_names(docs, "p")
    out = docs.withColumn(p, udf(F.col(text)))
    return out.withColumns({"lang_pred": F.col(p)["lang_pred"], "score": F.col(p)["score"]}).drop(p, text)
