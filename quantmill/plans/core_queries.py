"""The driver's queries of the core operators, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quantmill.functions import encoders, numeric as N, text as T, vectors as V
from quantmill.functions.register import register
from quantmill.operators import dense, evaluate as E, generate as G, late, quantities
from quantmill.operators.corpus import latest, offsets, quantities as unit_values, term_queries, top_k
from quantmill.operators.lexical import LexicalIndex
from quantmill.operators.sparse import SparseIndex
from quantmill.session import ensure_checkpoint_dir
from quantmill.sources import io
from quantmill.streaming import append

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    _REGISTRY[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


# --- quantities in common units ----------------------------------------------------------------------------------


def _quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantities.harmonise(table(spark, sf_dir, "collection"), table(spark, sf_dir, "unit_ref"), table(spark, sf_dir, "concept_ref"))


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantities.converted(_quantities(spark, sf_dir)).distinct()


@query
def p1_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantities that are not converted: routed for review, with the model's confidence, or with an entry that is no unit."""
    return _quantities(spark, sf_dir).where("how in ('review', 'open', 'foreign')")


@query
def p1_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the classifier is right on units that were hidden from it, by confidence."""
    return quantities.held_out_precision(table(spark, sf_dir, "collection"), table(spark, sf_dir, "unit_ref"), table(spark, sf_dir, "concept_ref"))


# --- lexical ranking ---------------------------------------------------------------------------------------------


def _corpus(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return latest(table(spark, sf_dir, "collection").select("doc_id", "ingested_at", *(columns or ("sentence", "values", "units"))), "doc_id", "ingested_at")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir, "sentence").select("doc_id", T.simple_tokens(F.col("sentence")).alias("terms"))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_values(_corpus(spark, sf_dir, "values", "units"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_queries(table(spark, sf_dir, "queries"))


def _plain(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    return LexicalIndex.build(_terms(spark, sf_dir), _values(spark, sf_dir))


def _binary(spark: SparkSession, sf_dir: str, words: DataFrame | None = None) -> LexicalIndex:
    return LexicalIndex.build(_terms(spark, sf_dir), _values(spark, sf_dir), unit_terms=True, binary=True, words=words)


def _delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words and units of all deliveries, also of those that others replace, so that none need be shuffled to find the last."""
    rows = table(spark, sf_dir, "collection")
    units = unit_values(rows.select("doc_id", "values", "units")).select(F.col("unit").alias("term"))
    # of a mere column Spark first asks whether it is empty, for which the texts would be analysed again
    return rows.select(F.explode(F.concat(T.simple_tokens(F.col("sentence")), F.array().cast("array<string>"))).alias("term")).unionByName(units)


@query
def tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(spark, sf_dir).postings.select("doc_id", "term", "tf")


@query
def df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(spark, sf_dir).idf.select("term", "df")


@query
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(spark, sf_dir).stats.select("n", "total", _r("avgdl"))


@query
def idf_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(spark, sf_dir).idf.select("term", "df", _r("idf"))


@query
def doc_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir)


@query
def unit_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values grouped by unit per document, units without a mark."""
    v = unit_values(_corpus(spark, sf_dir), drop_unitless=True)
    return v.groupBy("doc_id", "unit").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("doc_id", "unit", "n", _r("total"))


@query
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(spark, sf_dir).rank(_asked(spark, sf_dir), 10).select("qid", "doc_id", "rank", _r("score"))


@query
def bm25_with_quantity_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and values as terms of their documents."""
    index = LexicalIndex.build(_terms(spark, sf_dir), _values(spark, sf_dir), unit_terms=True, value_terms=True)
    return index.rank(_asked(spark, sf_dir), 10).select("qid", "doc_id", "rank", _r("score"))


@query
def bm25_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of BM25 joined back to their sentences."""
    ranked = _plain(spark, sf_dir).rank(_asked(spark, sf_dir), 3)
    return ranked.join(_corpus(spark, sf_dir).select("doc_id", "sentence"), "doc_id").select("qid", "doc_id", "rank", "sentence")


@query
def term_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(spark, sf_dir).score(_asked(spark, sf_dir)).where("matched = wanted").select("qid", "doc_id")


@query
def numeric_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query, how many of the documents with all its terms have a number that meets its condition."""
    asked = _asked(spark, sf_dir)
    full = _plain(spark, sf_dir).score(asked).where("matched = wanted").select("qid", "doc_id")
    pairs = full.join(asked.select("qid", "condition", "value", "value2"), "qid").join(_values(spark, sf_dir).select("doc_id", F.col("value").alias("v")), "doc_id")
    met = pairs.groupBy("qid", "condition", "doc_id").agg(F.bool_or(N.satisfies(F.col("condition"), F.col("v"), F.col("value"), F.col("value2"))).alias("met"))
    return met.where("met").groupBy("qid", "condition").agg(F.count("*").alias("docs"))


@query
def bm25_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(spark, sf_dir).rank(_asked(spark, sf_dir), 10, numeric="filter").select("qid", "doc_id", "rank", _r("score"))


@query
def bm25_filter_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(spark, sf_dir).rank(_asked(spark, sf_dir), 10, numeric="filter", fixed=True).select("qid", "doc_id", "rank", _r("score"))


def _quantity_scores(mode: str, condition: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index, asked = _binary(spark, sf_dir), _asked(spark, sf_dir).where(F.col("condition") == condition)
        full = index.score(asked).where("matched = wanted").select("qid", "doc_id").join(asked.drop("terms"), "qid")
        return index.quantity_scores(full.where("value is not null"), mode).select("qid", "doc_id", _r("q"))

    return run


for _mode in ("ratio", "expo"):
    for _name, _condition in (("eq", "="), ("gt", ">"), ("lt", "<"), ("range", "<<")):
        _REGISTRY[f"q{_mode}_{_name}"] = _quantity_scores(_mode, _condition)


@query
def quantity_bm25_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _binary(spark, sf_dir).rank(_asked(spark, sf_dir), 10, 1.5, 0.75, "ratio").select("qid", "doc_id", "rank", _r("score"))


@query
def quantity_bm25_expo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _binary(spark, sf_dir).rank(_asked(spark, sf_dir), 10, 1.5, 0.75, "expo").select("qid", "doc_id", "rank", _r("score"))


@query
def quantity_bm25_oov_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same queries asked with unknown words: quantity alone ranks."""
    asked = _asked(spark, sf_dir).withColumn("terms", F.transform("terms", lambda t: F.concat(F.lit("zq"), F.reverse(t), F.lit("qz"))))
    index = _binary(spark, sf_dir, words=_delivered(spark, sf_dir))
    return index.rank(asked, 10, 1.5, 0.75, "ratio").select("qid", "doc_id", "rank", _r("score"))


@query
def content_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of stemmed content words."""
    docs = _corpus(spark, sf_dir).select("doc_id", T.content_tokens(F.col("sentence")).alias("terms"))
    return docs.select("doc_id", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("df"))


@query
def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 with the full analyzers of texts and keywords."""
    docs = _corpus(spark, sf_dir).select("doc_id", T.content_tokens(F.col("sentence")).alias("terms"))
    asked = table(spark, sf_dir, "queries").select("qid", T.keyword_tokens(F.col("keywords")).alias("terms"))
    return LexicalIndex.build(docs).rank(asked, 10).select("qid", "doc_id", "rank", _r("score"))


# --- sparse ranking ----------------------------------------------------------------------------------------------


def _sparse(spark: SparkSession, sf_dir: str) -> SparseIndex:
    docs = _corpus(spark, sf_dir)
    return SparseIndex.build(encoders.term_weights(docs, "sentence"), docs, _values(spark, sf_dir))


def _query_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("qid", F.explode(F.array_distinct("terms")).alias("term"), F.lit(1.0).alias("qw"))


def _shared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(qid, lead) and the weights of the leads: queries with the same terms share one lead, which is scored for all."""
    asked = _asked(spark, sf_dir).select("qid", F.array_sort(F.array_distinct("terms")).alias("set"))
    lead = asked.groupBy("set").agg(F.min("qid").alias("lead"))
    return asked.join(lead, "set").select("qid", "lead"), lead.select(F.col("lead").alias("qid"), F.explode("set").alias("term"), F.lit(1.0).alias("qw"))


def _spread(result: DataFrame, shares: DataFrame) -> DataFrame:
    return shares.join(result.withColumnRenamed("qid", "lead"), "lead").drop("lead")


@query
def sparse_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares, weights = _shared(spark, sf_dir)
    return _spread(_sparse(spark, sf_dir).rank(weights, weights, 10), shares).select("qid", "doc_id", "rank", _r("score"))


@query
def sparse_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares, weights = _shared(spark, sf_dir)
    index = _sparse(spark, sf_dir)
    norm = index.normalised(index.dot(weights)).select("qid", "doc_id", F.col("norm").alias("score"))
    return _spread(top_k(norm, 10), shares).select("qid", "doc_id", "rank", _r("score"))


@query
def quantile_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate at the upper hundredth: at a quarter it is 0 wherever most documents lack the terms."""
    shares, weights = _shared(spark, sf_dir)
    index = _sparse(spark, sf_dir)
    return _spread(index.gate(index.dot(weights), 0.99), shares).select("qid", _r("gate"))


@query
def qsparse_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir).rank(_asked(spark, sf_dir), _query_weights(spark, sf_dir), 10, numeric=True).select("qid", "doc_id", "rank", _r("score"))


@query
def posting_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir).histogram()


@query
def l0_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir).l0().select(_r("l0_docs"))


# --- late interaction --------------------------------------------------------------------------------------------

#: Token vectors per passage, and every how manyth passage asks.
TOKENS, ASKING = 5, 20


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / TOKENS).alias("pid"), (F.col("vec_id") % TOKENS).cast("int").alias("tok"), V.doubles(F.col("embedding")).alias("vec"), F.col("label").alias("code"))


def _query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).where(F.col("pid") % ASKING == 0).select(F.col("pid").alias("qid"), F.col("tok").alias("qtok"), "vec")


def _late(spark: SparkSession, sf_dir: str) -> late.LateIndex:
    tokens = _tokens(spark, sf_dir)
    return late.LateIndex.build(tokens, late.label_centroids(tokens), bits=2, exact=True)


def _top_maxsim(**options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored = late.maxsim(_tokens(spark, sf_dir), _query_tokens(spark, sf_dir), **options)
        return scored.select("qid", "pid", _r("score", 5))

    return run


_REGISTRY |= {"maxsim": _top_maxsim(), "maxsim_clamped": _top_maxsim(clamp_zero=True), "maxsim_l2": _top_maxsim(metric="l2"), "maxsim_top_tokens": _top_maxsim(top_tokens=3)}


@query
def probe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _late(spark, sf_dir).probe(_query_tokens(spark, sf_dir), 2).select("qid", "qtok", "code", _r("score", 5))


@query
def ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _late(spark, sf_dir).ivf()


@query
def centroid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _late(spark, sf_dir)
    counts = index.tokens.groupBy("code").agg(F.count("*").alias("c"))
    return index.centroids.select("code").join(counts, "code", "left").select("code", F.coalesce("c", F.lit(0)).cast("bigint").alias("tokens"))


@query
def candidate_pids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _late(spark, sf_dir).candidates(_query_tokens(spark, sf_dir), 1)


@query
def candidate_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _late(spark, sf_dir).candidate_hits(_query_tokens(spark, sf_dir), 2)


@query
def approx_score_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q = _late(spark, sf_dir), _query_tokens(spark, sf_dir)
    return index.approximate(index.candidates(q, 2), q, 0.1).select("qid", "pid", _r("score", 5))


@query
def staged_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q = _late(spark, sf_dir), _query_tokens(spark, sf_dir)
    return index.search(q, 10, late.SearchKnobs(2, 0.1, 64), vectors=_tokens(spark, sf_dir)).select("qid", "pid", "rank", _r("score", 5))


@query
def residual_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _late(spark, sf_dir)
    rows = [("cutoff", i, x) for i, x in enumerate(index.cutoffs)] + [("weight", i, x) for i, x in enumerate(index.weights)]
    return spark.createDataFrame(rows, "kind string, i int, x double").select("kind", "i", _r("x", 5))


@query
def mean_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _late(spark, sf_dir).residuals().select(F.explode("residual").alias("r")).agg(F.avg(F.abs("r")).alias("avg_residual")).select(_r("avg_residual"))


@query
def residual_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _late(spark, sf_dir).encoded().select("pid", "tok", "code", F.array_join(F.col("buckets").cast("array<string>"), "").alias("buckets"))


@query
def residual_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near the decoded vectors are to the true ones."""
    original = _tokens(spark, sf_dir).select("pid", "tok", F.col("vec").alias("x"))
    near = _late(spark, sf_dir).decoded().join(original, ["pid", "tok"])
    return near.select("pid", "tok", F.round(V.dot(F.col("vec"), F.col("x")), 5).alias("cosine"))


@query
def kmeans_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole index with trained centroids; passages of half of the cells are scored on their true vectors, none is cut by its centroids
    (two bits decoded find half of the best ten, and a second stage of three quarters of the passages less than 0.9)."""
    tokens = _tokens(spark, sf_dir)
    index = late.LateIndex.build(tokens, late.kmeans_centroids(tokens, 16), bits=2)
    passages = tokens.select("pid").distinct().count()
    return index.search(_query_tokens(spark, sf_dir), 10, late.SearchKnobs(8, 0.0, 4 * passages), vectors=tokens)


@query
def encoded_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences through a plugged-in token encoder, pooled to one vector each."""
    docs = _corpus(spark, sf_dir).select(F.col("doc_id").alias("pid"), F.col("sentence").alias("text"))
    tokens = encoders.encode_tokens(docs, encoders.HashEncoder(8))
    return encoders.pool(tokens).select("pid", F.round(V.norm(F.col("vec")), 5).alias("length"))


@query
def rerank_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir)
    first = _plain(spark, sf_dir).rank(asked, 1000)
    return late.rerank_with_quantity(first, asked, _values(spark, sf_dir), 10).select("qid", "doc_id", "rank", _r("score"))


@query
def dense_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), V.doubles(F.col("embedding")).alias("vec"))
    asked = e.where(F.col("pid") % ASKING == 0).select(F.col("pid").alias("qid"), "vec")
    return dense.knn(e, asked, 10).select("qid", "pid", "rank", _r("score", 5))


@query
def dense_knn_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), V.doubles(F.col("embedding")).alias("vec"))
    return dense.approximate_knn(e, e.where(F.col("pid") % ASKING == 0).select(F.col("pid").alias("qid"), "vec"), 10)


@query
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3.0).alias("v"))
    return e.select("vec_id", F.posexplode(V.l2_normalise(F.col("v"))).alias("dim", "x")).select("vec_id", "dim", _r("x"))


@query
def maxsim_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = late.maxsim_with_context(_tokens(spark, sf_dir), _query_tokens(spark, sf_dir), query_length=3, best_query=2, best_context=1)
    return scored.select("qid", "pid", _r("score", 5))


@query
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first token of every passage against its last."""
    t = _tokens(spark, sf_dir)
    first, last = (t.where(F.col("tok") == k).select(F.col("pid").alias("key"), "vec") for k in (0, TOKENS - 1))
    return dense.paired_scores(first, last).select("key", _r("score", 5))


@query
def in_batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within each batch of five passages, the first tokens against the last ones."""
    t = _tokens(spark, sf_dir).withColumn("batch", F.floor(F.col("pid") / 5))
    first = t.where("tok = 0").select("batch", F.col("pid").alias("qid"), "vec")
    return dense.in_batch_scores(first, t.where(F.col("tok") == TOKENS - 1).select("batch", "pid", "vec")).select("batch", "qid", "pid", _r("score", 5))


@query
def pooled_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoders.pool(_tokens(spark, sf_dir)).select("pid", F.round(V.norm(F.col("vec")), 5).alias("length"))


@query
def sparse_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token vectors taken as activations: ln(1 + relu), pooled over the tokens of a passage by their maximum."""
    t = _tokens(spark, sf_dir).select(F.col("pid").alias("doc_id"), "tok", F.posexplode("vec").alias("term_id", "logit"), F.lit(1.0).alias("mask"))
    return encoders.sparse_activation(t).select("doc_id", "term_id", _r("w"))


# --- generation --------------------------------------------------------------------------------------------------


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.concept_index(table(spark, sf_dir, "train_concepts_units_extended"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _concepts(spark, sf_dir)
    return G.partition(index, G.condition_pivots(G.pivots(index)))


@query
def concept_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _concepts(spark, sf_dir)
    return c.groupBy("keyword", "unit").agg(F.count("*").alias("rows"), F.countDistinct("value").alias("n_values"), F.countDistinct("sentence").alias("n_sentences"))


@query
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.value_counts(_concepts(spark, sf_dir))


@query
def pivot_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pivots(_concepts(spark, sf_dir))


@query
def random_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _concepts(spark, sf_dir)
    return G.random_pivots(index, G.pivots(index))


@query
def condition_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("keyword", "unit", "condition", "pivot", "sentence", "side", "value")


@query
def deterministic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sample(_parts(spark, sf_dir), 3).select("keyword", "unit", "condition", "pivot", "side", "place", "sentence")


@query
def sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sample_counts(_parts(spark, sf_dir), 3)


@query
def zip_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.triples(G.sample(_parts(spark, sf_dir), 3))


@query
def value_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence with its first value span rewritten as the half of its value."""
    c = _concepts(spark, sf_dir).where(F.size("value_spans") > 0)
    return c.select("keyword", "unit", "value", "sentence", T.splice(F.col("sentence"), F.col("value_spans")[0], N.plain_number(F.floor(F.col("value") / 2).cast("double"))).alias("spliced"))


@query
def value_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.value_permutation(_parts(spark, sf_dir))


@query
def corpus_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = G.sample(_parts(spark, sf_dir), 3)
    mixed = G.with_corpus_sentences(sampled, _corpus(spark, sf_dir, "sentence"))
    return mixed.select("keyword", "unit", "condition", "pivot", "side", "sentence")


@query
def generation_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many queries each pass gives, with the concept's topic as its extension."""
    index = _concepts(spark, sf_dir)
    entries = table(spark, sf_dir, "concept_ref").select("concept", F.concat_ws(" ", "topic", "concept").alias("extension"))
    named = G.lookup_concepts(index.select("keyword").distinct(), entries)
    return G.all_conditions(index, named).groupBy("pass", "condition").agg(F.count("*").alias("queries"))


@query
def unit_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _concepts(spark, sf_dir).where(F.size("unit_spans") > 0)
    return c.select("keyword", "unit", "value", "sentence", T.splice(F.col("sentence"), F.col("unit_spans")[0], F.lit("pct")).alias("spliced"))


@query
def unit_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.unit_permutation(_concepts(spark, sf_dir), G.unit_forms(table(spark, sf_dir, "unit_ref")))


@query
def mask_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.masked(_concepts(spark, sf_dir)).select("keyword", "unit", "value", "sentence", "masked_value", "masked_unit")


@query
def surface_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sibling_forms(G.unit_forms(table(spark, sf_dir, "unit_ref")))


@query
def noun_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of the concept index that the lexicon does not know."""
    forms = G.unit_forms(table(spark, sf_dir, "unit_ref")).select(F.col("form").alias("unit"))
    return _concepts(spark, sf_dir).select("unit").distinct().join(forms, "unit", "left_anti")


@query
def concept_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "concept_ref").select("concept", F.col("topic").alias("extension"))
    return G.lookup_concepts(_concepts(spark, sf_dir).select("keyword").distinct(), entries)


@query
def concept_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every concept through a provider (here a fixed one), asked once."""
    return encoders.complete(table(spark, sf_dir, "concept_ref"), lambda xs: [f"{x} report" for x in xs])


@query
def split_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "queries").where("split = 'val'").select(F.col("qid").cast("string").alias("qid"))
    return table(spark, sf_dir, "qrel").distinct().join(held, "qid", "left_semi")


@query
def split_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "queries").where("split = 'val'").select(F.col("qid").cast("string").alias("qid"))
    return table(spark, sf_dir, "qrel").distinct().join(held, "qid", "left_anti")


@query
def random_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, held = G.split_validation(table(spark, sf_dir, "queries"), "qid", 100)
    return train.select("qid", F.lit("train").alias("part")).unionByName(held.select("qid", F.lit("val").alias("part")))


@query
def training_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.training_tables(_concepts(spark, sf_dir))["triples"]


@query
def training_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.training_tables(_concepts(spark, sf_dir))["qrel"]


@query
def training_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.training_tables(_concepts(spark, sf_dir))["queries"]


@query
def training_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each generated table in the training and in the validation part, which has the first 100 queries."""
    tables = G.training_tables(_concepts(spark, sf_dir))
    both = G.split_tables(tables, tables["queries"].where("query_id < 100"))
    counts = [t.agg(F.count("*").alias("rows")).select(F.lit(part).alias("part"), F.lit(name).alias("name"), "rows") for part, ts in zip(("train", "val"), both) for name, t in ts.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query
def metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by split, written as JSON and read again."""
    folder = _scratch(spark, "metrics")
    io.write_metrics(E.evaluate(_run(spark, sf_dir), table(spark, sf_dir, "qrel")), folder)
    return io.read_metrics(spark, folder).select("split", "metric", _r("value"))


# --- evaluation --------------------------------------------------------------------------------------------------


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "run").select(F.col("q_id").alias("qid"), "doc_id", "score", "rank")


def _metric(column: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = E.per_query(_run(spark, sf_dir), table(spark, sf_dir, "qrel"), 10)
        return q.groupBy("split").agg(F.avg(column).alias(column), F.count("*").alias("queries")).select("split", _r(column), "queries")

    return run


_REGISTRY |= {"mrr_at_k": _metric("mrr"), "precision_at_k": _metric("p"), "recall_at_k": _metric("recall"), "ndcg_at_k": _metric("ndcg")}


@query
def truncate_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.truncate_run(_run(spark, sf_dir), 100).select("qid", "doc_id", "rank")


@query
def per_query_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = E.per_query(_run(spark, sf_dir), table(spark, sf_dir, "qrel"), 100)
    return q.select("split", "qid", _r("mrr"), _r("p"), _r("recall"), _r("ndcg"))


@query
def split_measure_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.evaluate(_run(spark, sf_dir), table(spark, sf_dir, "qrel"), ("MRR@10", "P@10", "recall@10", "ndcg_cut@10", "recall@100"))
    return found.select("split", "metric", _r("value"), "queries")


def _two_systems(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reciprocal ranks of the run by its score and by its rank column, over the complete judgements."""
    qrel = table(spark, sf_dir, "qrel").where("split = 'complete'")
    run = _run(spark, sf_dir)
    a = E.per_query(run, qrel, 10)
    b = E.per_query(run.where("score is not null and not isnan(score)").withColumn("score", -F.col("rank").cast("double")), qrel, 10)
    return a.select("qid", F.col("mrr").alias("v")), b.select("qid", F.col("mrr").alias("v"))


@query
def metric_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_systems(spark, sf_dir)
    return a.join(b.withColumnRenamed("v", "w"), "qid").agg(F.abs(F.avg("v") - F.avg("w")).alias("delta")).select(_r("delta"))


@query
def permutation_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.permutation_test(*_two_systems(spark, sf_dir), 1000).select("queries", _r("delta"), _r("p"))


# --- scalar functions, sources, streaming ------------------------------------------------------------------------


@query
def verbalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "queries")
    return q.select("qid", N.verbalise(F.col("keywords"), F.col("condition"), F.col("value"), F.col("value2"), F.col("unit")).alias("verbal"))


@query
def format_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written plainly and with thousands commas."""
    q = table(spark, sf_dir, "queries").where("value is not null")
    return q.select("qid", N.plain_number(F.col("value")).alias("plain"), N.magnitude(F.col("value")).alias("power"), N.alternate_number(F.col("value"), F.lit(True)).alias("commas"), N.alternate_number(F.col("value"), F.lit(False)).alias("words"), N.alternate_number(F.col("value"), F.lit(False), F.lit(True)).alias("brief"))


@query
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long after its publication a document was taken in."""
    d = table(spark, sf_dir, "documents").where("published_at is not null and ingested_at is not null")
    return d.select("doc_id", N.duration_text(F.unix_timestamp("ingested_at") - F.unix_timestamp("published_at")).alias("took"))


@query
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered SQL functions in SQL text: mean closeness of a query's own bounds, per condition."""
    register(spark)
    table(spark, sf_dir, "queries").createOrReplaceTempView("quantmill_queries")
    return spark.sql("""SELECT condition, count_if(meets_condition(condition, value + 1, value, value2)) AS met, round(avg(quantity_ratio(condition, value + 1, value, value2)), 6) AS ratio,
      CAST(sum(size(simple_tokens(keywords))) AS BIGINT) AS words FROM quantmill_queries WHERE value IS NOT NULL AND condition IS NOT NULL GROUP BY condition""")


@query
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clean(F.col("text")).alias("cleaned"))


@query
def doc_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    return offsets(docs, "doc_id", "n_chars").select("doc_id", "n_chars", "start")


@query
def scan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = io.chunks(table(spark, sf_dir, "documents"), "doc_id", 250, owners=4)
    return c.groupBy("chunk", "owner").agg(F.count("*").alias("docs"))


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query
def run_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking written as nested JSON and read again."""
    folder = _scratch(spark, "run-json")
    best = E.truncate_run(_run(spark, sf_dir), 10)
    io.write_nested_json(best.select("qid", "doc_id", "rank"), folder, "rank")
    return io.read_nested_json_lines(spark, folder, "int").select("qid", "doc_id", F.col("value").alias("rank"))


@query
def ranking_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking written as flat text and read again."""
    folder = _scratch(spark, "ranking")
    best = E.truncate_run(_run(spark, sf_dir), 10)
    io.write_ranking_tsv(best.select("qid", F.col("doc_id").alias("pid"), "rank", F.round("score", 4).alias("score")), folder, {"rows": "qid pid rank score"})
    return io.read_ranking_tsv(spark, folder).select("qid", "pid", "rank")


@query
def stream_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies of an index that was filled by a stream."""
    folder = _scratch(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    # as a pattern, so that it may be one file as well as a folder
    docs = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]").select("doc_id", "text")
    append.append_stream(docs, folder, f"{folder}/checkpoint").awaitTermination()
    return append.read_postings(spark, folder).groupBy("term").agg(F.count("*").alias("df"))


def queries() -> dict[str, Query]:
    from quantmill.plans import index_queries

    return _REGISTRY | index_queries.queries()


def oracle_sql() -> dict[str, str]:
    from quantmill.plans import core_sql, index_queries

    return core_sql.SQL | index_queries.oracle_sql()
