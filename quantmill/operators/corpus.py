"""Corpora in long form: records, tokens, quantities, query terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quantmill.functions import text as T
from quantmill.session import cut


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """The last delivery of every ``key``; of equal times the row of the largest hash. Give only the columns that are needed: all are read for it."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), F.xxhash64(*df.columns).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def quantities(collection: DataFrame, drop_unitless: bool = False) -> DataFrame:
    """(doc_id, pos, unit, value): units and values zipped to the shorter list; ``-`` is the mark for no unit."""
    n = F.least(F.size("values"), F.size("units"))
    pairs = F.arrays_zip(F.slice(F.col("values"), 1, n).alias("value"), F.slice(F.col("units"), 1, n).alias("unit"))
    out = collection.where(n > 0).select("doc_id", F.posexplode(pairs).alias("pos", "x")).select("doc_id", "pos", T.unit_key(F.col("x.unit")).alias("unit"), F.col("x.value").alias("value"))
    return out.where("unit <> '-' and unit <> ''") if drop_unitless else out


def doc_terms(docs: DataFrame, text: str, analyse=T.simple_tokens) -> DataFrame:
    """(doc_id, terms) with the terms of every document as an array."""
    return docs.select("doc_id", analyse(F.col(text)).alias("terms"))


def term_queries(queries: DataFrame, analyse=T.simple_tokens) -> DataFrame:
    """Queries with ``terms`` from their keywords and a lower-cased unit."""
    return queries.select("qid", "condition", "value", "value2", T.unit_key(F.col("unit")).alias("unit"), analyse(F.col("keywords")).alias("terms"))


def top_k(scored: DataFrame, k: int, by: str = "qid") -> DataFrame:
    """``scored`` with ``rank``, reduced to the k best documents of each query (or other group ``by``); ties go to the larger doc_id. Scores that agree to nine places are
    tied, so that the order in which a sum was built cannot decide."""
    w = Window.partitionBy(by).orderBy(F.round("score", 9).desc(), F.col("doc_id").desc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def offsets(df: DataFrame, key: str, length: str) -> DataFrame:
    """``df`` with ``start``, the sum of ``length`` over all smaller keys. Rows are range-partitioned and summed per partition; only one number per
    partition is gathered."""
    part = cut(df.repartitionByRange(key).withColumn("_p", F.spark_partition_id()))
    sums = part.groupBy("_p").agg(F.sum(length).alias("_s"))
    before = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inner = F.coalesce(F.sum(length).over(Window.partitionBy("_p").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return part.withColumn("_i", inner).join(F.broadcast(before), "_p").withColumn("start", F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def first_of_each(df: DataFrame, group: str, item: str, order: str) -> DataFrame:
    """``df`` without the later occurrences of an item in its group, in the order of ``order`` (then of the item); the order is kept as ``place`` from 1."""
    w = Window.partitionBy(group, item).orderBy(order)
    once = df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order, item)))


def listed_by(df: DataFrame, key: str, item: str, order: str) -> DataFrame:
    """(key, items): the items of every key as one array in the order of ``order``. A key's items must fit one row."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(item).alias("_i"))))
    return df.groupBy(key).agg(F.transform(listed, lambda x: x["_i"]).alias("items"))
