"""Left-to-right work along an item's rows that no task has to hold as a whole: numbering, running sums and maxima, greedy cuts, sorted streams.

An item's rows fall into blocks by a rising expression of their order. Windows run within blocks; one row for each block, not one for each row,
is then carried along the item.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a block where an order is dense.
BLOCK = 1024


def along(df: DataFrame, keys: list[str], order: list[str], block: Column, *, nth: str | None = None, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, before: dict[str, list[str]] | None = None) -> DataFrame:
    """df with ``nth`` (from 0), running ``sums`` (up to and with the row), ``maxima`` of the rows before, and, for each name in ``before``, columns of the row before as a struct (null at the start).

    block: rises with order within keys. Rows of a null key or block are left out. The rows are dealt by block once; block totals and windows both read that.
    """
    sums, maxima, before = sums or {}, maxima or {}, before or {}
    rows = df.withColumn("_block", block).repartition(*keys, "_block")
    local = W.partitionBy(*keys, "_block").orderBy(*order)
    upto = local.rowsBetween(W.unboundedPreceding, 0)
    last = {n: F.max_by(F.struct(*c), F.struct(*order)).alias(f"_{n}") for n, c in before.items()}
    made = {n: F.sum(c).alias(f"_{n}") for n, c in sums.items()} | {n: F.max(c).alias(f"_{n}") for n, c in maxima.items()} | last
    own = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"), *made.values())
    item = W.partitionBy(*keys).orderBy("_block")
    earlier = item.rowsBetween(W.unboundedPreceding, -1)
    carried = own.select(
        *keys, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"), *[F.sum(f"_{n}").over(earlier).alias(f"_{n}") for n in sums],
        *[F.max(f"_{n}").over(earlier).alias(f"_{n}") for n in maxima], *[F.lag(f"_{n}").over(item).alias(f"_{n}") for n in before],
    )
    rows = rows.withColumns({f"_own_{n}": F.sum(c).over(upto) for n, c in sums.items()} | {f"_own_{n}": F.max(c).over(local.rowsBetween(W.unboundedPreceding, -1)) for n, c in maxima.items()} | {f"_own_{n}": F.lag(F.struct(*c)).over(local) for n, c in before.items()} | {"_own": F.row_number().over(local) - 1})
    both = rows.join(carried, [*keys, "_block"])
    out = {n: F.coalesce(F.col(f"_{n}"), F.lit(0)) + F.coalesce(f"_own_{n}", F.lit(0)) for n in sums} | {n: F.greatest(f"_{n}", f"_own_{n}") for n in maxima} | {n: F.coalesce(f"_own_{n}", f"_{n}") for n in before}
    out |= {nth: F.col("_n") + F.col("_own")} if nth else {}
    return both.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def stream(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[list[list]], list[tuple]], schema: str) -> DataFrame:
    """fold over the rows of each key in order: it gets their columns (without keys) as lists and returns rows that follow the keys in schema.

    One sorted pass for all keys of a task; a task holds a batch and the rows of the key at hand.
    """
    values = [c for c in df.columns if c not in keys]
    sort = [*keys, *order]
    head = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    n = len(keys)
    rows = df.select(*keys, *values)
    typed = lambda schema: df.sparkSession.createDataFrame([], schema).toArrow().schema
    arrow = typed(rows.select(*keys).schema)

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(n + len(values))]

        def groups(cols: list[list], final: bool) -> Iterator[tuple[tuple, list[list]]]:
            """Whole keys of cols; the last, which may go on, is held unless final."""
            first, size = 0, len(cols[0])
            marks = list(zip(*cols[:n], strict=True))
            for i in range(1, size + 1):
                if i == size or marks[i] != marks[first]:
                    if i == size and not final:
                        break
                    yield marks[first], [c[first:i] for c in cols[n:]]
                    first = i
            for k, c in enumerate(cols):
                held[k] = c[first:]

        def made(cols: list[list], final: bool) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(n)]
            found: list[tuple] = []
            for mark, own in groups(cols, final):
                rows = fold(own)
                for k in range(n):
                    out[k].extend([mark[k]] * len(rows))
                found.extend(rows)
            columns = [pa.array(c, t) for c, t in zip([*out, *(zip(*found, strict=True) if found else [()] * len(types))], [*arrow.types, *types], strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=[*arrow.names, *names])

        for batch in batches:
            cols = [h + c.to_pylist() for h, c in zip(held, batch.columns, strict=True)]
            if cols[0]:
                yield made(cols, False)
        if held[0]:
            yield made(held, True)

    names, types = typed(schema).names, typed(schema).types
    return rows.repartition(*keys).sortWithinPartitions(*sort).mapInArrow(passes, f"{head}, {schema}")


def each(df: DataFrame, keys: list[str], fold: Callable[[list[list]], list[tuple]], schema: str) -> DataFrame:
    """As stream() where a row holds all of its key: its other columns are arrays, in order."""
    head = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    n = len(keys)
    rows = df.select(*keys, *[c for c in df.columns if c not in keys])
    typed = df.sparkSession.createDataFrame([], schema).toArrow().schema

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.columns[n:]
            ends = np.cumsum(lists[0].value_lengths().fill_null(0)).tolist() if lists else []
            flat, found, owners = [x.flatten().to_pylist() for x in lists], [], []
            for i, (lo, hi) in enumerate(zip([0, *ends], ends, strict=False)):
                made = fold([x[lo:hi] for x in flat]) if hi > lo else []
                found += made
                owners += [i] * len(made)
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [()] * len(typed), typed.types, strict=True)]
            owned = [c.take(pa.array(owners, pa.int64())) for c in batch.columns[:n]]
            yield pa.RecordBatch.from_arrays([*owned, *columns], names=[*keys, *typed.names])

    return rows.mapInArrow(passes, f"{head}, {schema}")


def _next_starts(size: np.ndarray, forced: np.ndarray, most: int, room: int) -> np.ndarray:
    """Where the next piece begins if one begins at each row: limits of rows and of size, or a forced start."""
    n = len(size)
    at, total = np.arange(n), np.concatenate([[0], np.cumsum(size)])
    by_size = np.searchsorted(total, total[:-1] + room, side="right") - 1
    nearest = np.minimum.accumulate(np.where(forced, at, n)[::-1])[::-1]
    by_force = np.concatenate([nearest[1:], [n]])[:n] if n else at
    return np.minimum(np.minimum(at + most, np.maximum(by_size, at + 1)), np.minimum(by_force, n))


def cut(rows: DataFrame, keys: list[str], *, most: int, room: int, block: int = BLOCK) -> DataFrame:
    """(keys, nth, piece): rows (keys, nth, size, forced) in order, a new piece where one is forced or the next row would pass ``most`` rows or ``room`` of size.

    A piece that begins in a block ends at most ``most`` rows further, so a block is a map from where its first piece may begin (``most`` places) to where the next
    block's first one does. Blocks are worked out on their own, the maps chained (one row for each block), and pieces numbered.
    """
    block = max(block, most)
    at = F.col("nth").cast("long")
    own = rows.select(*keys, F.floor(at / block).alias("block"), at.alias("nth"), F.col("size").cast("long").alias("size"), F.col("forced").cast("boolean").alias("forced"))
    ahead = own.where((F.col("block") > 0) & (F.col("nth") % block < most)).withColumn("block", F.col("block") - 1)  # what the block before has to see
    seen = own.unionByName(ahead)
    def starts(nth: list[int], size: list[int], forced: list[bool]) -> tuple[np.ndarray, int]:
        upto = next((i for i, x in enumerate(nth) if x // block > nth[0] // block), len(nth))
        return _next_starts(np.array(size, np.int64), np.array(forced, bool), most, room), upto

    def chart(cols: list[list]) -> list[tuple]:
        following, upto = starts(*cols)
        ends, pieces = [0] * upto, [0] * upto
        for i in range(upto - 1, -1, -1):
            j = int(following[i])
            ends[i], pieces[i] = (j - upto, 1) if j >= upto else (ends[j], pieces[j] + 1)
        return [(ends[:most], pieces[:most])]

    def chain(cols: list[list]) -> list[tuple]:
        entry, piece, out = 0, 0, []
        for number, ends, pieces in zip(*cols, strict=True):
            out.append((number, entry, piece))
            if entry < len(ends):  # else the block is shorter: no piece begins in it
                entry, piece = ends[entry], piece + pieces[entry]
            else:
                entry -= len(ends)
        return out

    def number(cols: list[list]) -> list[tuple]:
        entry, piece = cols[3][0], cols[4][0]
        following, upto = starts(*cols[:3])
        out, start = [(cols[0][i], piece - 1) for i in range(min(entry, upto))], entry
        while start < upto:
            stop = min(int(following[start]), upto)
            out += [(x, piece) for x in cols[0][start:stop]]
            start, piece = int(following[start]), piece + 1
        return out

    kinds = ["nth", "size", "forced"]
    maps = stream(seen.select(*keys, "block", *kinds), [*keys, "block"], ["nth"], chart, "ends array<int>, pieces array<int>")
    entries = stream(maps, keys, ["block"], chain, "block long, entry int, piece long")
    return stream(seen.join(entries, [*keys, "block"]).select(*keys, "block", *kinds, "entry", "piece"), [*keys, "block"], ["nth"], number, "nth long, piece long").drop("block")
