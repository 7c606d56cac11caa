"""Dense single-vector ranking: exact nearest neighbours by inner product, and an approximate index by random hyperplanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quantmill.functions import vectors as V
from quantmill.operators.late import late_scores, summed, top_passages


def knn(vectors: DataFrame, query_vectors: DataFrame, k: int = 10, as_distance: bool = False) -> DataFrame:
    """(qid, pid, rank, score): the k vectors of largest inner product with each query, ties to the larger pid.

    ``vectors`` (pid, vec), ``query_vectors`` (qid, vec). Products are made in tiles of bounded size, and each batch keeps k per query before the
    shuffle. ``as_distance`` gives 1 - score as the score, in the same order."""
    rows = vectors.select(F.col("pid").cast("long").alias("pid"), F.array(V.doubles(F.col("vec"))).alias("vecs"))
    asked = query_vectors.select("qid", F.lit(0).alias("qtok"), V.doubles(F.col("vec")).alias("vec"))
    ranked = top_passages(late_scores(rows, asked, summed(), k=k), k).select("qid", "pid", "rank", "score")
    return ranked.withColumn("score", 1.0 - F.col("score")) if as_distance else ranked


def approximate_knn(vectors: DataFrame, query_vectors: DataFrame, k: int = 10, tables: int = 12, width: float = 1.5, seed: int = 5) -> DataFrame:
    """(qid, pid, rank, score): nearest by inner product among the rows that share a bucket of a random-projection hash; every row is indexed."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("pid", "vec", array_to_vector(V.doubles(F.col("vec"))).alias("f"))
    asked = query_vectors.select("qid", F.col("vec").alias("qvec"), array_to_vector(V.doubles(F.col("vec"))).alias("f"))
    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", numHashTables=tables, bucketLength=width, seed=seed).fit(rows.limit(1000))
    key = lambda df: model.transform(df).select("*", F.posexplode("h").alias("table", "b")).withColumn("b", F.col("b").cast("string")).drop("h", "f")
    met = key(rows).join(key(asked), ["table", "b"]).dropDuplicates(["qid", "pid"])
    return top_passages(met.select("qid", "pid", V.dot(F.col("vec"), F.col("qvec")).alias("score")), k).select("qid", "pid", "rank", "score")


def paired_scores(queries: DataFrame, docs: DataFrame, key: str = "key") -> DataFrame:
    """(key, score): the inner product of the query and the document of every key. ``queries`` (key, vec), ``docs`` (key, vec)."""
    d = docs.select(key, F.col("vec").alias("dvec"))
    return queries.join(d, key).select(key, V.dot(F.col("vec"), F.col("dvec")).alias("score"))


def in_batch_scores(queries: DataFrame, docs: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, qid, pid, score): every query of a batch against every document of the batch. ``queries`` (batch, qid, vec), ``docs`` (batch, pid, vec)."""
    d = docs.select(batch, "pid", F.col("vec").alias("dvec"))
    return queries.join(d, batch).select(batch, "qid", "pid", V.dot(F.col("vec"), F.col("dvec")).alias("score"))


def negatives_scores(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(qid, pid, score) of each query's own positives and negatives. ``queries`` (qid, vec), ``candidates`` (qid, pid, vec)."""
    c = candidates.select("qid", "pid", F.col("vec").alias("dvec"))
    return queries.join(c, "qid").select("qid", "pid", V.dot(F.col("vec"), F.col("dvec")).alias("score"))
