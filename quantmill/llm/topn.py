"""Problem 5: the N best items of every group, in one fixed order.

Method: a mergeable aggregation that keeps a heap of N items per group. Every task reduces its rows to the N best distinct
items of each group before the shuffle (a vectorised bounded heap over Arrow batches, compacted as it grows), so a group of
any size sends at most N rows per task. What is left is merged by the JVM's bounded priority queue, again first in each
task and then per group. Items are ordered by score, then by their identifier as text, both falling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

try:  # not a public name: without it the merge is a window with a limit, which Spark also cuts in each task
    from pyspark.sql.internal import InternalFunction
except ImportError:
    InternalFunction = None

#: Rows that a task holds before it compacts them, and after compaction before it sends them on.
HOLD, SEND = 200_000, 1_000_000


def best(t: pa.Table, n: int) -> pa.Table:
    """The ``n`` best distinct items of every group of (g, item, score)."""
    t = t.take(pc.sort_indices(t, [("g", "ascending"), ("score", "descending"), ("item", "descending")]))
    g = _codes(t.column("g"))
    item = _codes(t.column("item"))
    # an item counts once in a group, where it scores best: the first of its rows
    order = np.lexsort((np.arange(len(g)), item, g))
    first = np.ones(len(g), np.bool_)
    first[order[1:]] = (g[order[1:]] != g[order[:-1]]) | (item[order[1:]] != item[order[:-1]])
    rows = np.flatnonzero(first)
    start = np.searchsorted(g[rows], g[rows], "left") if _rising(g[rows]) else _starts(g[rows])
    return t.take(pa.array(rows[np.arange(len(rows)) - start < n]))


def _codes(col: pa.ChunkedArray) -> np.ndarray:
    return col.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)


def _rising(g: np.ndarray) -> bool:
    return bool((g[1:] >= g[:-1]).all())


def _starts(g: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    return np.repeat(edge, np.diff(np.append(edge, len(g))))


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 10) -> DataFrame:
    """(group, rank, item, score): the first ``n`` distinct items of every group by score, highest first; equal scores by
    ``item`` as text, falling. ``rank`` counts from 1.

    Rows with a null group or item, or a null or NaN score, are left out; infinite scores count; 0.0 and -0.0 are equal. An item that
    comes more than once in a group counts once, with its highest score. Groups with fewer than ``n`` items come out
    whole, and groups without a usable row do not appear. Other columns of ``df`` are ignored, whatever their names.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(
        df[group].cast("string").alias("g"), df[item].cast("string").alias("item"), (df[score].cast("double") + F.lit(0.0)).alias("score")
    ).where("g is not null and item is not null and score is not null and not isnan(score)")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            size += b.num_rows
            if size >= HOLD:
                kept = best(pa.concat_tables(held), n)
                if kept.num_rows > size // 2 or kept.num_rows >= SEND:  # groups are too small here for the heap to pay
                    yield from kept.combine_chunks().to_batches()
                    held, size = [], 0
                else:
                    held, size = [kept], kept.num_rows
        if size:
            yield from best(pa.concat_tables(held), n).combine_chunks().to_batches()

    kept = rows.mapInArrow(reduce, "g string, item string, score double")
    once = kept.groupBy("g", "item").agg(F.max("score").alias("score"))
    if InternalFunction is None:
        order = Window.partitionBy("g").orderBy(F.desc("score"), F.desc("item"))
        ranked = once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
        return ranked.select(F.col("g").alias(group), F.col("r").alias("rank"), F.col("item").alias(item), F.col("score").alias(score))
    heap = InternalFunction.collect_top_k(F.struct("score", "item"), n, False)
    merged = once.groupBy("g").agg(heap.alias("top"))
    return merged.select("g", F.posexplode("top").alias("at", "x")).select(
        F.col("g").alias(group), (F.col("at") + 1).cast("int").alias("rank"), F.col("x.item").alias(item), F.col("x.score").alias(score)
    )
