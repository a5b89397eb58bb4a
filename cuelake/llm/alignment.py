"""Alignment of two tokenizers over one text: where both end a token, and which token ids meet there.

A document is space+text. Tokenizer A (byte-level BPE) encodes that, tokenizer B (sentencepiece, which adds the space itself) the text. The byte offsets at
which their tokens end are two rising lists. The shorter drives a galloping search into the longer: steps that double, then a binary search. Common offsets
slice both lists into groups; differences of ranks give each group its range of tokens. The A and B tokens that end together are a link.

Texts are cut before white space that follows another character into units: no token of either vocabulary spans such a place (checked for B when it is
loaded), so a unit is encoded and aligned once and then looked up. Only the ids of a document's links leave Python, distinct ones with their number.
How often an id pair is linked in the whole corpus is counted natively. Pairs of high counts, at most HOT rows whatever the corpus, are looked up in a broadcast table; the
others, of which no one is frequent, by a shuffle join.

Texts that are null or empty, or whose tokens' bytes differ from space+text in either tokenizer, have no tokens: zeros and an empty digest. Rows of equal id are
each their own document, and their links all count. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache, partial
from itertools import accumulate
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import BROADCAST_ROWS, Work

_CACHE, _LONG, _RUN, _DOCS = 300_000, 96, 64, 64
#: Pairs in the broadcast table: 24 bytes each.
HOT = BROADCAST_ROWS
_SIGN = 2**31  # ids of A are below this, those of B too


def gallop(short: list[int], long: list[int]) -> list[tuple[int, int]]:
    """Places (i in short, j in long) of the values that both rising lists hold."""
    found, low, n = [], 0, len(long)
    for i, x in enumerate(short):
        step = 1
        while low + step < n and long[low + step] < x:
            step *= 2
        low = bisect_left(long, x, low + step // 2, min(low + step + 1, n))
        if low == n:
            break
        if long[low] == x:
            found.append((i, low))
            low += 1
            if low == n:
                break
    return found


def common_ends(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places in a and in b of their common values; the shorter list drives."""
    return gallop(a, b) if len(a) <= len(b) else [(i, j) for j, i in gallop(b, a)]


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others in turn from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


Known = tuple[str, bytes, int]


class _Units(dict):
    """What is known of a unit: its groups as text, its link keys as little-endian int64, and 2**32 times its number of A tokens plus that of B; None if bytes differ."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core: threads of its own would only wait
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        super().__init__()
        gc.set_threshold(100_000)  # many small tuples are made, none of them in cycles
        self.old: dict[str, Known | None] = {}
        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        alphabet, vocabulary = byte_alphabet(), self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(map(alphabet.__getitem__, token))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.digits = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))
        joined = {c for p in pieces for before, c in zip(p, p[1:], strict=False) if before != c}
        cuts = "".join(c for c in " \t\n\r" if c not in joined and (c != " " or "▁" not in joined))
        self.cut = re.compile(rf"(?<=\S)(?=[{cuts}])") if cuts else None

    def split(self, text: str) -> list[str]:
        return self.cut.split(text) if self.cut else [text]

    def learn(self, units: set[str]) -> dict[str, Known | None]:
        """Make units known; those that are too long to keep are returned.

        When there is no room, what was not used since the last time goes. Units that end in no white space are encoded in runs, as a call costs as much as a unit.
        """
        fresh = []
        for unit in units:
            if unit not in self:
                if unit in self.old:
                    self[unit] = self.old[unit]
                else:
                    fresh.append(unit)
        if len(self) + len(fresh) > _CACHE:
            self.old = dict(self)
            self.clear()
            self.update((u, self.old[u]) for u in units if u in self.old)
        plain = [u for u in fresh if not u[-1].isspace() and len(u) <= _LONG]
        runs = [plain[i : i + _RUN] for i in range(0, len(plain), _RUN)] + [[u] for u in fresh if u[-1].isspace() or len(u) > _LONG]
        made: dict[str, Known | None] = {}
        for run, found in zip(runs, self._align_all(runs), strict=True):
            if found is None and len(run) > 1:
                alone = [[u] for u in run]
                made |= {u: x and x[0] for u, x in zip(run, self._align_all(alone), strict=True)}
            else:
                made |= dict(zip(run, found or [None], strict=True))
        self.update({u: x for u, x in made.items() if len(u) <= _LONG})
        return made

    def _align_all(self, runs: list[list[str]]) -> Iterator[list[Known] | None]:
        texts = ["".join(run) for run in runs]
        # B puts a space in front: it stands for a text's own first space, else it is a token that is cut off again. An empty text has no token.
        of_b = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        space = [self.b.piece_to_id("▁")]
        for run, text, a, b in zip(runs, texts, self.a.encode_batch_fast(texts, add_special_tokens=False), of_b, strict=True):
            yield self._align(run, text, a.ids, space if text == " " else b if text[0] == " " else b[1:])

    def _align(self, run: list[str], text: str, ids_a: list[int], ids_b: list[int]) -> list[Known] | None:
        parts_a, parts_b, raw = [self.bytes_a[i] for i in ids_a], [self.bytes_b[i] for i in ids_b], text.encode("utf-8", "replace")
        if b"".join(parts_a) != raw or b"".join(parts_b) != raw:
            return None
        ends, digits = list(accumulate(map(len, parts_a))), self.digits
        found, groups, keys, i0, j0, first_a, first_b = [], [], [], 0, 0, 0, 0
        upto = accumulate(len(u) if u.isascii() else len(u.encode("utf-8", "replace")) for u in run)
        unit_end = next(upto)
        for i, j in common_ends(ends, list(accumulate(map(len, parts_b)))):
            i, j = i + 1, j + 1
            groups.append(f"{digits[ids_a[i0]] if i == i0 + 1 else ','.join([digits[x] for x in ids_a[i0:i]])}|{digits[ids_b[j0]] if j == j0 + 1 else ','.join([digits[x] for x in ids_b[j0:j]])}")
            keys.append(ids_a[i - 1] * _SIGN + ids_b[j - 1])
            i0, j0 = i, j
            if ends[i - 1] == unit_end:
                found.append((";".join(groups), pack(f"<{len(keys)}q", *keys), (i - first_a) << 32 | (j - first_b)))
                groups, keys, first_a, first_b, unit_end = [], [], i, j, next(upto, 0)
        return found


@cache
def _units(path_a: str, path_b: str) -> _Units:
    return _Units(path_a, path_b)


LINKS = "n_a long, n_b long, n_groups long, groups_sha256 string, keys array<bigint>, times array<int>"


def _encode(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, with_groups: bool) -> Iterator[pa.RecordBatch]:
    """The last column holds texts; the others stay in front of LINKS."""
    known = _units(path_a, path_b)
    none = (0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32), "")
    for batch in batches:
        out = []
        for first in range(0, batch.num_rows, _DOCS):
            texts = [t.as_py() for t in batch.column(batch.num_columns - 1).slice(first, _DOCS)]
            units = [known.split(f" {t}") if t else [] for t in texts]
            fresh = known.learn({u for own in units for u in own})
            for own in units:
                found = [known.get(u) or fresh.get(u) for u in own]
                if not own or None in found:
                    out.append(none)
                    continue
                groups, keys, sizes = zip(*found, strict=True)
                n_a, n_b = divmod(sum(sizes), 1 << 32)
                keys = np.frombuffer(b"".join(keys), "<i8")
                some, times = np.unique(keys, return_counts=True)
                text = ";".join(groups)
                out.append((n_a, n_b, len(keys), hashlib.sha256(text.encode()).hexdigest(), some, times.astype(np.int32), text if with_groups else ""))
        n_a, n_b, n_groups, digests, keys, times, groups = list(zip(*out, strict=True)) or [()] * 7
        starts = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.concatenate([np.zeros(0, t), *x]).astype(t))) for x, t in ((keys, np.int64), (times, np.int32))]
        columns = [*(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)), pa.array(digests, pa.string()), *lists, *([pa.array(groups, pa.string())] if with_groups else [])]
        names = ["n_a", "n_b", "n_groups", "groups_sha256", "keys", "times", *(["groups"] if with_groups else [])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *names])


def links(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, keys, times) of every text: its distinct links and how often it holds each; with_groups adds the groups as text.

    A key is 2**31 times the id of A, plus the id of B.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {LINKS}" + ", groups string" * with_groups
    return rows.mapInArrow(partial(_encode, path_a=path_a, path_b=path_b, with_groups=with_groups), schema)


def pair_counts(linked: DataFrame) -> DataFrame:
    """(key, n, best): how many links of the corpus are of an id pair, and whether no pair of the same B id has more."""
    each = linked.select(F.explode(F.arrays_zip("keys", "times")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    pairs = each.groupBy("key").agg(F.sum("times").alias("n")).withColumn("b", F.col("key") % _SIGN)
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    return pairs.join(most, "b").select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def level(pairs: DataFrame, rows: int) -> int:
    """The least power of two such that at most ``rows`` pairs have a count of that or more."""
    bits = pairs.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("bits")).collect()  # at most 63 rows
    total, low = 0, 62
    for row in bits:
        total += row["pairs"]
        if total > rows:
            break
        low = row["bits"] - 1
    return 1 << low


def align(work: Work, docs: DataFrame, path_a: str, path_b: str, *, hot: int = HOT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of docs (doc_id, text)."""
    linked = work.cut(links(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()))
    pairs = work.cut(pair_counts(linked))
    floor = level(pairs, hot)
    each = linked.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    looked = each.join(F.broadcast(pairs.where(F.col("n") >= floor)), "key", "left")  # at most ``hot`` rows
    sums = (F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    found = looked.where(F.col("n").isNotNull()).groupBy("row").agg(*sums)
    if floor > 1:  # else there are no others
        rare = looked.where(F.col("n").isNull()).select("row", "key", "times").join(pairs.where(F.col("n") < floor), "key")
        found = found.unionByName(rare.groupBy("row").agg(*sums))
    zero = F.lit(0).cast("long")
    own = linked.select("row", F.struct("doc_id", "n_a", "n_b", "n_groups", "groups_sha256").alias("own"), zero.alias("n_best"), zero.alias("count_sum"))
    both = own.unionByName(found.withColumn("own", F.lit(None).cast(own.schema["own"].dataType)))
    out = both.groupBy("row").agg(F.first("own", ignorenulls=True).alias("own"), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.select("own.doc_id", "own.n_a", "own.n_b", "own.n_groups", F.col("own.n_groups").alias("n_links"), "n_best", "count_sum", "own.groups_sha256")
