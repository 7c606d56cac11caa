"""Lexical rankers: BM25, BM25 with a numeric filter, BM25 with a quantity score."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from quantmill.functions.numeric import kernel, value_text
from quantmill.operators.cells import Asked, Block, Found, Grid, filtered, nearest, term_set, with_quantity
from quantmill.operators.corpus import top_k
from quantmill.session import cut
from quantmill.sources import index_store
from quantmill.sources.io import read_index, write_index

EPSILON = 0.25
#: Asked terms whose statistics every task may hold.
HELD = 1_000_000


@dataclass
class LexicalIndex:
    """Postings with the statistics of BM25.

    ``postings`` (term, doc_id, tf), ``idf`` (term, df, raw, idf), ``docs`` (doc_id, dl), ``stats`` one row (n, total, avgdl).
    ``quantities`` (doc_id, unit, value) serve the numeric parts, and so do ``texts`` (doc_id, terms, dl), one row for each document, where the index is not loaded. ``words`` (term) may hold
    every term of ``texts``, and others: no statistics are made of texts for terms that are not in it. All are lazy, and a ranking writes only the scores that its parts share.
    ``save`` and ``load`` keep an index in a folder, its postings clustered by term.
    """

    postings: DataFrame
    idf: DataFrame
    docs: DataFrame
    stats: DataFrame
    quantities: DataFrame | None = None
    epsilon: float = EPSILON
    texts: DataFrame | None = None
    words: DataFrame | None = None

    @staticmethod
    def build(docs: DataFrame, quantities: DataFrame | None = None, unit_terms: bool = False, value_terms: bool = False, binary: bool = False, epsilon: float = EPSILON, words: DataFrame | None = None) -> LexicalIndex:
        """``docs`` (doc_id, terms), one row for each. Units and values may count as terms of their document, but not in its length; ``words``, where given, hold them too."""
        none = F.array().cast("array<string>")
        # of a mere column Spark first asks whether it is empty, for which the texts would be analysed again
        text = docs.select("doc_id", F.explode(F.concat("terms", none)).alias("term"))
        extra = []
        if quantities is not None and unit_terms:
            extra.append(quantities.where("unit is not null").select("doc_id", F.col("unit").alias("term")))
        if quantities is not None and value_terms:
            extra.append(quantities.where("value is not null").select("doc_id", value_text(F.col("value")).alias("term")))
        if binary:
            # what a text has already is left out beside it, so that tokens need not be shuffled to meet units and values
            postings = text.distinct()
            if extra:
                more = reduce(DataFrame.unionByName, extra).distinct().join(docs.select("doc_id", "terms"), "doc_id", "left")
                postings = postings.unionByName(more.where(~F.coalesce(F.array_contains("terms", F.col("term")), F.lit(False))).select("doc_id", "term"))
            postings = postings.withColumn("tf", F.lit(1).cast("bigint"))
        elif extra:
            postings = reduce(DataFrame.unionByName, extra, text).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
        else:
            postings = LexicalIndex._counted(docs)
        lengths = docs.select("doc_id", F.size("terms").cast("bigint").alias("dl"))
        stats, idf = LexicalIndex._statistics(lengths, postings, epsilon)
        texts = None if extra and not binary else docs.select("doc_id", "terms", F.size("terms").cast("bigint").alias("dl"))
        if extra and binary:
            more = reduce(DataFrame.unionByName, extra).groupBy("doc_id").agg(F.collect_set("term").alias("more"))
            texts = texts.join(more, "doc_id", "full").select("doc_id", F.array_union(F.coalesce("terms", none), F.coalesce("more", none)).alias("terms"), "dl")
        elif binary:
            texts = texts.withColumn("terms", F.array_distinct("terms"))
        return LexicalIndex(postings, idf, lengths, stats, quantities, epsilon, texts, words)

    @staticmethod
    def _counted(docs: DataFrame) -> DataFrame:
        """(doc_id, term, tf), counted within the row of each document: in order equal terms are neighbours, and only those that have one like them are looked for."""
        s, pos, term = F.col("s"), F.col("pos"), F.col("term")
        rows = docs.select("doc_id", F.sort_array("terms").alias("s")).select("doc_id", "s", F.posexplode(F.concat("s", F.array().cast("array<string>"))).alias("pos", "term"))
        first = rows.where((pos == 0) | ~F.get(s, pos - 1).eqNullSafe(term))
        times = F.size(s) - F.coalesce(F.size(F.array_remove(s, term)), F.size(F.array_compact(s)))
        single = (pos + 1 == F.size(s)) | ~F.get(s, pos + 1).eqNullSafe(term)
        return first.select("doc_id", "term", F.when(single, F.lit(1)).otherwise(times).cast("bigint").alias("tf"))

    @staticmethod
    def _statistics(docs: DataFrame, postings: DataFrame, epsilon: float) -> tuple[DataFrame, DataFrame]:
        stats = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).withColumn("avgdl", F.col("total") / F.col("n"))
        df = postings.groupBy("term").agg(F.count("*").alias("df"))
        n = F.broadcast(stats.select("n"))
        raw = df.crossJoin(n).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).drop("n")
        mean = F.broadcast(raw.agg(F.avg("raw").alias("mean")))
        return stats, raw.crossJoin(mean).withColumn("idf", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw"))).drop("mean")

    def save(self, folder: str, mode: str = "overwrite") -> LexicalIndex:
        """The index, written to ``folder`` and read from there. ``mode``: ``overwrite`` or ``reuse`` (a complete index that is there is taken as it is)."""
        spark = self.docs.sparkSession
        if mode == "reuse" and index_store.is_complete(spark, folder):
            return LexicalIndex.load(spark, folder)
        index_store.begin(spark, folder)
        write_index({"postings": self.postings, "docs": self.docs} | ({} if self.quantities is None else {"quantities": self.quantities}), folder, sort={"postings": "term"})
        # statistics are taken from what was written, so that the texts are analysed once
        kept = read_index(spark, folder, ["postings", "docs"])
        stats, idf = LexicalIndex._statistics(kept["docs"], kept["postings"], self.epsilon)
        write_index({"idf": idf, "stats": stats}, folder, sort={"idf": "term"})
        index_store.finish(spark, folder, {"kind": "lexical", "epsilon": self.epsilon, "quantities": self.quantities is not None})
        return LexicalIndex.load(spark, folder)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> LexicalIndex:
        meta = index_store.metadata(spark, folder)
        t = read_index(spark, folder, ["postings", "idf", "docs", "stats"])
        return LexicalIndex(t["postings"], t["idf"], t["docs"], t["stats"], read_index(spark, folder, ["quantities"])["quantities"] if meta["quantities"] else None, meta["epsilon"])

    def weights(self, k1: float = 1.5, b: float = 0.75, terms: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
        """(term, doc_id, w): what one occurrence of the term in a query adds to the score of the document. With ``terms`` (term) only
        their postings are joined to the statistics, with ``known`` (term, idf) only those of its terms."""
        avg = F.broadcast(self.stats.select("avgdl"))
        norm = self.docs.crossJoin(avg).select("doc_id", (k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))).alias("norm"))
        wanted = self.postings if terms is None else self.postings.join(terms, "term", "left_semi")
        joined = wanted.join(self.idf.select("term", "idf") if known is None else known, "term").join(norm, "doc_id")
        return joined.select("term", "doc_id", (F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + F.col("norm"))).alias("w"))

    def _asked_weights(self, terms: DataFrame, k1: float, b: float) -> DataFrame:
        """``weights`` of the ``terms`` (term), whose statistics are written once; where these are few, all tasks get them and no posting is shuffled by its term."""
        known = cut(self.idf.select("term", "idf").join(terms, "term", "left_semi"))
        return self.weights(k1, b, known=F.broadcast(known) if known.count() <= HELD else known)

    def lists(self, terms: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(doc_id, keys, xs): ``weights`` of the ``terms`` (term, key) of each document that has any, from ``texts``. These are analysed twice, for the statistics and
        for the weights, and not shuffled by term."""
        spark, kind = self.texts.sparkSession, dict(self.texts.dtypes)["doc_id"]
        out = f"doc_id {kind}, keys array<bigint>, xs array<double>"
        if self.words is not None:
            asked = terms.select("term")
            if self.words.join(F.broadcast(asked) if asked.count() <= HELD else asked, "term", "left_semi").isEmpty():
                return spark.createDataFrame([], out)
        # the mark for a document itself is no term; an array that is not a mere column is not analysed again to see whether it is empty
        marked = F.array_distinct(F.concat("terms", F.array(F.lit(None).cast("string"))))
        counts = cut(self.texts.select(F.explode(marked).alias("term"), "dl").groupBy("term").agg(F.count("*").alias("df"), F.count("dl").alias("n"), F.sum("dl").alias("total")))
        n, total = (counts.where("term is null").select("n", "total").first() or (0, 0))
        raw = counts.where("term is not null").select("term", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
        mean = raw.agg(F.avg("raw")).first()[0]
        idf = F.when(F.col("raw") < 0, F.lit(self.epsilon) * F.lit(mean)).otherwise(F.col("raw"))
        known = raw.join(terms, "term").select("term", "key", idf.cast("double").alias("idf"))
        if not n or known.isEmpty():
            return spark.createDataFrame([], out)
        if known.count() > HELD:
            weighted = self.weights(k1, b, terms.select("term")).join(terms, "term").groupBy("doc_id").agg(F.collect_list(F.struct("key", "w")).alias("items"))
            return weighted.select("doc_id", F.col("items.key").alias("keys"), F.col("items.w").alias("xs"))
        known = known.toArrow().combine_chunks()
        words, key, idf = (known.column(i).combine_chunks() for i in range(3))
        key, idf, avgdl = key.to_numpy(), idf.to_numpy(zero_copy_only=False), total / n

        def weighted(batches):
            for batch in batches:
                lists, dl = batch.column("terms"), batch.column("dl").to_numpy(zero_copy_only=False).astype(float)
                norm = k1 * (1 - b + b * dl / avgdl)
                word = pc.index_in(lists.flatten(), words).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                there = ~np.isnan(word) & ~np.isnan(dl[doc])
                pair, tf = np.unique(doc[there] * len(words) + word[there].astype(np.int64), return_counts=True)
                doc, word = np.divmod(pair, len(words))
                x = idf[word] * tf * (k1 + 1) / (tf + norm[doc])
                some, first = np.unique(doc, return_index=True)
                ends = pa.array(np.append(first, len(doc)).astype(np.int32))
                ids = batch.column("doc_id").take(pa.array(some))
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, pa.array(key[word])), pa.ListArray.from_arrays(ends, pa.array(x))], ["doc_id", "keys", "xs"])

        return self.texts.select("doc_id", "terms", "dl").mapInArrow(weighted, out)

    def score_sets(self, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(set, wanted, doc_id, score, matched) of the distinct sets of terms of ``queries`` (set)."""
        distinct = queries.select("set").distinct()
        wanted = F.size(F.array_distinct("set"))
        terms = distinct.select("set", wanted.alias("wanted"), F.explode("set").alias("term")).groupBy("set", "wanted", "term").agg(F.count("*").alias("times"))
        return (
            terms.join(self.weights(k1, b, terms.select("term").distinct()), "term")
            .groupBy("set", "wanted", "doc_id")
            .agg(F.sum(F.col("w") * F.col("times")).alias("score"), F.count("*").alias("matched"))
        )

    def score(self, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(qid, doc_id, score, matched, wanted) of all documents with a term of the query; a repeated term counts as often as it stands.

        Queries with the same terms are scored once.
        """
        sets = queries.select("qid", F.array_sort("terms").alias("set"))
        return sets.join(self.score_sets(sets, k1, b), "set").select("qid", "doc_id", "score", "matched", "wanted")

    def rank(self, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, numeric: str = "none", fixed: bool = False, weight: float = 2.0) -> DataFrame:
        """(qid, doc_id, rank, score) of ``queries`` (qid, terms, condition, value, value2, unit).

        ``numeric``: ``none`` BM25; ``filter`` zeroes documents that have all terms and numbers, but none that meets the condition
        (``=`` is met by no number unless ``fixed``); ``ratio`` and ``expo`` add ``weight`` times the quantity score to normalised BM25.
        Documents with no term of the query have score 0 and do not appear, but for ``ratio`` and ``expo`` of queries none of whose
        terms is known: these rank by quantity alone.

        The numeric part of a query only touches documents with all its terms, so of the others no more than the k best of each distinct set
        of terms are carried on.
        """
        if numeric == "none":
            asked = queries.withColumn("set", F.array_sort("terms")).drop("terms")
            best = top_k(self.score_sets(asked, k1, b), k, "set").select("set", "doc_id", "rank", "score")
            return asked.select("qid", "set").join(best, "set").select("qid", "doc_id", "rank", "score")
        if numeric not in ("filter", "ratio", "expo"):
            raise ValueError(f"unknown numeric mode {numeric!r}")
        grid = Grid(queries.withColumn("set", term_set(F.col("terms"))), lambda terms: self._asked_weights(terms, k1, b), self.quantities, None if self.texts is None else lambda terms: self.lists(terms, k1, b))
        out = self._filtered(grid, k, fixed) if numeric == "filter" else self._with_quantity(grid, k, numeric, weight)
        return top_k(out, k).select("qid", "doc_id", "rank", "score")

    def _filtered(self, grid: Grid, k: int, fixed: bool) -> DataFrame:
        """(qid, doc_id, score)."""
        return grid.ranked(lambda block, at, score, hits, facts, asked: filtered(block, at, score, hits == len(facts["set"]), asked, k, fixed))

    def _with_quantity(self, grid: Grid, k: int, mode: str, weight: float) -> DataFrame:
        """(qid, doc_id, score)."""
        best = cut(grid.statistics().select("sid", "hi"))

        def find(block: Block, at: np.ndarray, score: np.ndarray, hits: np.ndarray, facts: dict, asked: Asked) -> Found:
            hi = facts["hi"]
            base = score / hi if hi != 0 else score
            eligible = (hits == len(facts["set"])) & (hi != 0)
            usable = ~np.isnan(asked.low) & (asked.low != 0)
            return with_quantity(block, at, base, eligible, asked, usable, k, mode, weight, guarded=True)

        # none of the terms is known: all documents with the unit compete by quantity
        known = grid.sets.join(best, "sid", "left_semi").select("set")
        lost = grid.asked.where("value is not null and value <> 0 and condition is not null and unit is not null").join(known, "set", "left_anti")
        lost = cut(lost.select("qid", "condition", "value", "value2", "unit"))
        out = grid.ranked(find, best)
        return out if lost.isEmpty() else out.unionByName(nearest(lost, self.quantities, k, mode, weight))

    def quantity_scores(self, pairs: DataFrame, mode: str) -> DataFrame:
        """(qid, doc_id, q) of ``pairs`` (qid, doc_id, condition, value, value2, unit): mean kernel over the document's values of the
        query's unit, or of all units if the query has none."""
        v = self.quantities.where("value is not null").select("doc_id", F.col("unit").alias("v_unit"), F.col("value").alias("v"))
        met = pairs.join(v, "doc_id").where(F.col("unit").isNull() | (F.col("unit") == F.col("v_unit")))
        q = kernel(F.col("condition"), F.col("v"), F.col("value"), F.col("value2"), mode)
        return met.groupBy("qid", "doc_id").agg((F.sum(q) / F.count("*")).alias("q"))
