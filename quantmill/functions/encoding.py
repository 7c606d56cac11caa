"""Token ids of queries and passages for a token encoder: markers, special tokens, cutting, padding with masks, batches.

A tokenizer is a function from texts to lists of ids. It runs on Arrow batches; everything after it is array expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType

Tokenizer = Callable[[list[str]], list[list[int]]]
#: What stands between the passages of a query's background.
SEPARATOR = " [SEP] "


@dataclass(frozen=True)
class Special:
    """Ids of the special tokens: start, end, mask, padding, and the marks that tell queries and passages apart."""

    start: int = 101
    end: int = 102
    mask: int = 103
    pad: int = 0
    query: int = 1
    passage: int = 2


def token_ids(df: DataFrame, tokenize: Tokenizer, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of its texts; a null text has none. Other columns, such as values and units, are carried along."""
    schema = df.drop(out).schema.add(out, ArrayType(IntegerType()))
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(names.index(text)).to_pylist()
            ids = tokenize([t or "" for t in texts])
            yield pa.record_batch([*b.columns, pa.array([x if t is not None else [] for x, t in zip(ids, texts)], pa.list_(pa.int32()))], names)

    return df.drop(out).mapInArrow(run, schema)


def passage_ids(ids: Column, most: int, special: Special = Special()) -> Column:
    """Start, the passage's mark, the ids as far as ``most`` tokens allow, end."""
    kept = F.slice(ids, F.lit(1), F.lit(max(0, most - 3)))
    return F.concat(F.array(F.lit(special.start), F.lit(special.passage)), kept, F.array(F.lit(special.end)))


#: Tokens of a query whose length is not fixed.
FULL_LENGTH = 500


def query_ids(ids: Column, length: int, special: Special = Special(), context: Column | None = None, full_length: bool = False) -> Column:
    """Start, the query's mark, the ids, end, and masks up to ``length`` tokens, by which a query is expanded.

    ``full_length``: as long as the query is, up to FULL_LENGTH tokens, and no shorter than ``length``. ``context``: ids that follow the
    expanded query, ended like a text of their own."""
    most = FULL_LENGTH if full_length else length
    kept = F.slice(ids, F.lit(1), F.lit(max(0, most - 3)))
    body = F.concat(F.array(F.lit(special.start), F.lit(special.query)), kept, F.array(F.lit(special.end)))
    missing = F.greatest(F.lit(0), F.lit(length) - F.size(body))
    whole = F.concat(body, F.array_repeat(F.lit(special.mask), missing))
    return whole if context is None else F.concat(whole, F.slice(context, F.lit(1), F.lit(FULL_LENGTH)), F.array(F.lit(special.end)))


def attention(ids: Column, special: Special = Special(), masks: bool = False) -> Column:
    """1 for tokens that are attended to: not the padding, and the masks of an expanded query only if ``masks``."""
    ignored = [special.pad] if masks else [special.pad, special.mask]
    return F.transform(ids, lambda x: F.when(x.isin(*ignored), 0).otherwise(1))


def expansion(ids: Column, special: Special = Special()) -> Column:
    """How many masks a query was expanded by."""
    return F.size(F.filter(ids, lambda x: x == special.mask))


def tokens_of(ids: Column, special: Special = Special()) -> Column:
    """The ids of the text alone, without special tokens."""
    marks = [special.start, special.end, special.mask, special.pad]
    inner = F.filter(ids, lambda x: ~x.isin(*marks))
    return F.filter(inner, lambda x, i: (i > 0) | ~x.isin(special.query, special.passage))


def collate(df: DataFrame, size: int, ids: str = "ids", key: str = "pid", special: Special = Special(), window: int = 0) -> DataFrame:
    """``df`` with ``batch``, ``place`` and its ids padded to the longest of the batch. With ``window`` rows are put in order of length within
    windows of so many rows of rising key, so that little padding is needed; without, batches follow the key.

    ``key`` counts the rows from 0, so a row's window and batch come from it and no task holds more than a window."""
    if window:
        order = Window.partitionBy("_w").orderBy(F.size(ids), key)
        placed = df.withColumn("_w", F.floor(F.col(key) / window)).withColumn("_i", F.row_number().over(order) - 1)
        per = -(-window // size)
        numbered = placed.withColumn("batch", (F.col("_w") * per + F.floor(F.col("_i") / size)).cast("bigint")).withColumn("place", (F.col("_i") % size).cast("int")).drop("_w", "_i")
    else:
        numbered = df.withColumn("batch", F.floor(F.col(key) / size).cast("bigint")).withColumn("place", (F.col(key) % size).cast("int"))
    longest = F.max(F.size(ids)).over(Window.partitionBy("batch"))
    return numbered.withColumn(ids, F.concat(ids, F.array_repeat(F.lit(special.pad), longest - F.size(ids))))


def backgrounds(pairs: DataFrame, passages: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """(qid, background): the texts of each query's background passages, in order of ``place``, joined. ``pairs`` (qid, place, pid), ``passages`` (pid, text);
    passages that are not known or have no text are left out."""
    joined = pairs.join(passages.where("text is not null").select("pid", "text"), "pid")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    return joined.groupBy("qid").agg(F.array_join(listed, separator).alias("background"))
