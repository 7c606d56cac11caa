"""Sparse term-weight rankers: dot product over postings, with or without a quantity score."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from quantmill.operators.cells import Asked, Block, Found, Grid, with_quantity
from quantmill.operators.corpus import top_k
from quantmill.session import cut


@dataclass
class SparseIndex:
    """``postings`` (term, doc_id, w); ``n_docs`` counts all documents, also those without a weight."""

    postings: DataFrame
    n_docs: DataFrame
    quantities: DataFrame | None = None

    @staticmethod
    def build(weights: DataFrame, docs: DataFrame, quantities: DataFrame | None = None) -> SparseIndex:
        """``weights`` (doc_id, term, w), zero weights dropped; ``docs`` (doc_id) all documents."""
        return SparseIndex(weights.where("w <> 0").select("term", "doc_id", "w"), docs.agg(F.count("*").alias("n")), quantities)

    def dot(self, query_weights: DataFrame, threshold: float = 0.0) -> DataFrame:
        """(qid, doc_id, score) above the threshold; ``query_weights`` (qid, term, qw)."""
        joined = query_weights.join(self.postings, "term")
        return joined.groupBy("qid", "doc_id").agg(F.sum(F.col("qw") * F.col("w")).alias("score")).where(F.col("score") > threshold)

    def normalised(self, scored: DataFrame) -> DataFrame:
        """Scores min-max normalised over all documents, those without a match being 0; equal scores everywhere give 0."""
        side = scored.groupBy("qid").agg(F.max("score").alias("hi"), F.min("score").alias("lo"), F.count("*").alias("m"))
        side = side.crossJoin(F.broadcast(self.n_docs)).withColumn("lo", F.when(F.col("m") < F.col("n"), F.least(F.lit(0.0), F.col("lo"))).otherwise(F.col("lo")))
        span = F.col("hi") - F.col("lo")
        return scored.join(side, "qid").withColumn("norm", F.when(span > 0, (F.col("score") - F.col("lo")) / span).otherwise(0.0))

    def gate(self, scored: DataFrame, quantile: float = 0.25) -> DataFrame:
        """(qid, gate): the quantile, linearly interpolated, of the normalised scores over all documents. Only counts of the
        documents without a match are needed, as their score is the least."""
        norm = self.normalised(scored)
        w = Window.partitionBy("qid").orderBy("norm")
        at = quantile * (F.col("n") - 1)
        zeros = F.col("n") - F.col("m")
        ranked = norm.withColumn("place", F.row_number().over(w) - 1 + zeros)
        low, high = F.floor(at), F.ceil(at)
        picked = ranked.groupBy("qid").agg(
            F.max(F.when(F.col("place") == low, F.col("norm"))).alias("a"), F.max(F.when(F.col("place") == high, F.col("norm"))).alias("b"), F.max(at - low).alias("f")
        )
        a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
        return picked.select("qid", (a + (b - a) * F.col("f")).alias("gate"))

    def rank(self, queries: DataFrame, query_weights: DataFrame, k: int = 10, numeric: bool = False, threshold: float = 0.0) -> DataFrame:
        """(qid, doc_id, rank, score). With ``numeric``, normalised scores; documents above the gate gain the mean kernel over their values of
        the query's unit. ``queries`` (qid, condition, value, value2, unit)."""
        if not numeric:
            return top_k(self.dot(query_weights, threshold), k).select("qid", "doc_id", "rank", "score")
        weighted = query_weights.where("qw is not null").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term", F.col("qw").cast("double").alias("times")))).alias("set"))
        asked = weighted.join(queries.select("qid", "condition", "value", "value2", "unit"), "qid", "left")
        grid = Grid(asked, lambda terms: self.postings.join(terms, "term", "left_semi"), self.quantities)

        def find(block: Block, at: np.ndarray, score: np.ndarray, hits: np.ndarray, facts: dict, asked: Asked) -> Found:
            at, score = at[score > threshold], score[score > threshold]
            lo, span = facts["lo"], facts["hi"] - facts["lo"]
            norm = (score - lo) / span if span > 0 else np.zeros(len(score))
            usable = ~np.isnan(asked.low) & np.array([u is not None for u in asked.unit.tolist()], bool)
            return with_quantity(block, at, norm, norm > facts["gate"], asked, usable, k, "ratio", 1.0, guarded=False)

        found = grid.ranked(find, self._gates(grid, threshold))
        return top_k(found.where(F.col("score") > threshold), k).select("qid", "doc_id", "rank", "score")

    def _gates(self, grid: Grid, threshold: float, quantile: float = 0.25) -> DataFrame:
        """(sid, hi, lo, gate) of every set: bounds of its scores over all documents, and the gate. This is 0 unless so many documents match that the
        quantile is a match; only the scores of such sets are written."""
        side = cut(grid.statistics(threshold).crossJoin(F.broadcast(self.n_docs)))
        side = side.withColumn("lo", F.when(F.col("m") < F.col("n"), F.least(F.lit(0.0), F.col("lo"))).otherwise(F.col("lo")))
        wide = side.where(F.ceil(quantile * (F.col("n") - 1)) >= F.col("n") - F.col("m")).select("sid")
        if wide.isEmpty():
            return side.select("sid", "hi", "lo", F.lit(0.0).alias("gate"))
        terms = grid.sets.join(wide, "sid").select(F.col("sid").alias("qid"), F.explode("set").alias("t")).select("qid", F.col("t.term").alias("term"), F.col("t.times").alias("qw"))
        gates = self.gate(cut(self.dot(terms, threshold)), quantile).withColumnRenamed("qid", "sid")
        return cut(side.join(gates, "sid", "left").select("sid", "hi", "lo", F.coalesce("gate", F.lit(0.0)).alias("gate")))

    def histogram(self) -> DataFrame:
        """(term, postings): the length of every posting list."""
        return self.postings.groupBy("term").agg(F.count("*").alias("postings"))

    def l0(self) -> DataFrame:
        """One row: mean number of non-zero weights of the documents that have any."""
        return self.postings.groupBy("doc_id").agg(F.count("*").alias("nnz")).agg(F.avg("nnz").alias("l0_docs"))
