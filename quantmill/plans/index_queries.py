"""Queries of stored indexes, rankers on text and text encoding, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quantmill.functions import encoding, text as T
from quantmill.operators import late, late_store
from quantmill.operators.corpus import first_of_each, listed_by
from quantmill.operators.lexical import LexicalIndex
from quantmill.operators.rankers import LateRanker, LexicalRanker
from quantmill.plans import core_queries as C, core_sql as S
from quantmill.sources import index_store

PART = 20


def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 by an index that was written to a folder and loaded from it."""
    folder = C._scratch(spark, "lexical")
    LexicalIndex.build(C._terms(spark, sf_dir), C._values(spark, sf_dir)).save(folder)
    return LexicalIndex.load(spark, folder).rank(C._asked(spark, sf_dir), 10).select("qid", "doc_id", "rank", C._r("score"))


def search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of queries as text through the ranker's interface, with a numeric filter; the second build takes the index that is there."""
    folder = C._scratch(spark, "ranker")
    docs = C._corpus(spark, sf_dir, "sentence").select("doc_id", F.col("sentence").alias("text"))
    for mode in ("overwrite", "reuse"):
        ranker = LexicalRanker.build(docs, folder, mode, C._values(spark, sf_dir), "filter")
    asked = C.table(spark, sf_dir, "queries").select("qid", F.col("keywords").alias("query"), "condition", "value", "value2", T.unit_key(F.col("unit")).alias("unit"))
    return ranker.search_all(asked, 10).select("qid", "doc_id", "rank", C._r("score"))


def _stored(spark: SparkSession, sf_dir: str, folder: str, broken: bool) -> late_store.StoredLateIndex:
    tokens = C._tokens(spark, sf_dir).select("pid", "tok", "vec", "code")
    centroids = late.label_centroids(tokens)
    if broken:  # a run that ended after its first two parts
        late_store.build(tokens.where(F.col("pid") < 2 * PART), folder, 2, "overwrite", PART, centroids)
        index_store.begin(spark, folder)
    return late_store.build(tokens, folder, 2, "resume" if broken else "overwrite", PART, centroids)


def index_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of an index whose building was broken off and resumed, and the count of embeddings before each."""
    return index_store.part_totals(_stored(spark, sf_dir, C._scratch(spark, "late"), True).tokens)


def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_store.totals(C._tokens(spark, sf_dir)).select("passages", "embeddings", C._r("mean_length"))


def passage_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_store.lengths(C._tokens(spark, sf_dir))


def stored_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted file of a stored index, by the number of passages of each cell."""
    ivf = _stored(spark, sf_dir, C._scratch(spark, "late"), False).ivf()
    return ivf.groupBy("code").agg(F.count("*").alias("passages"))


def stored_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near the vectors that a stored index decodes are to the true ones."""
    index = _stored(spark, sf_dir, C._scratch(spark, "late"), False)
    true = C._tokens(spark, sf_dir).select("pid", "tok", F.col("vec").alias("x"))
    from quantmill.functions import vectors as V

    return index.decoded().join(true, ["pid", "tok"]).agg(F.count("*").alias("vectors"), F.round(F.avg(V.dot(F.col("vec"), F.col("x"))), 2).alias("cosine"))


def late_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries as text against an index of encoded documents, built, stored and searched by the late-interaction ranker."""
    docs = C.table(spark, sf_dir, "concept_ref").select(F.col("concept_id").cast("long").alias("doc_id"), F.col("concept").alias("text"))
    ranker = LateRanker.build(docs, C._scratch(spark, "text"), knobs=late.SearchKnobs(8, 0.0, 4096))
    asked = C.table(spark, sf_dir, "queries").select("qid", F.col("keywords").alias("query")).where("query is not null")
    return ranker.search_all(asked, 3)


def _word_lengths(texts: list[str]) -> list[list[int]]:
    """A tokenizer for the SQL check: a word is known by its length."""
    import re

    return [[1000 + len(w) for w in re.findall("[a-z0-9]+", t.lower())] for t in texts]


def encoded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encoding.token_ids(C.table(spark, sf_dir, "queries").select("qid", "query_text"), _word_lengths, "query_text")
    ids = encoding.query_ids(F.col("ids"), 32)
    return rows.select("qid", F.array_join(ids.cast("array<string>"), " ").alias("ids"), encoding.expansion(ids).alias("masks"), F.aggregate(encoding.attention(ids), F.lit(0), lambda s, x: s + x).alias("attended"))


def encoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of passages, in padded batches."""
    rows = encoding.token_ids(C.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pid"), "text"), _word_lengths)
    rows = rows.select("pid", encoding.passage_ids(F.col("ids"), 180).alias("ids"))
    padded = encoding.collate(rows, 32)
    return padded.select("pid", "batch", "place", F.size("ids").alias("padded"), F.aggregate(encoding.attention(F.col("ids")), F.lit(0), lambda s, x: s + x).alias("attended"))


def query_backgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantmill.operators import evaluate as E

    best = E.truncate_run(C._run(spark, sf_dir), 3).select("qid", F.col("rank").alias("place"), F.col("doc_id").cast("long").alias("pid"))
    texts = C._corpus(spark, sf_dir, "sentence").select(F.col("doc_id").alias("pid"), F.col("sentence").alias("text"))
    return encoding.backgrounds(best, texts)


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of every record in order of first mention."""
    units = C._values(spark, sf_dir).where("unit is not null")
    return first_of_each(units.select("doc_id", "unit", "pos"), "doc_id", "unit", "pos").select("doc_id", "unit", "place")


def values_by_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values listed by record, in order, as text."""
    rows = listed_by(C._values(spark, sf_dir).where("value is not null"), "doc_id", "value", "pos")
    return rows.select("doc_id", F.size("items").alias("n"), F.round(F.get("items", F.lit(0)), 6).alias("first"), F.round(F.get("items", F.size("items") - 1), 6).alias("last"))


_ALL = (
    index_roundtrip, search_all, index_resume, index_totals, passage_lengths, stored_ivf, stored_codec, late_text_search, encoded_queries, encoded_documents, query_backgrounds, ordered_distinct, values_by_record,
)


def queries() -> dict[str, C.Query]:
    return {f.__name__: f for f in _ALL}


def _clean_sql(column: str) -> str:
    """The cleaning of ``functions.text.clean`` in SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    one = {c: p for c, p in T._PLAIN.items() if len(p) == 1}
    sql = f"regexp_replace(replace({column}, '<num>', ' '), '[^\\x{{0000}}-\\x{{024F}}\\x{{1E00}}-\\x{{1EFF}}]', '', 'g')"
    sql = f"translate({sql}, {quote(''.join(one))}, {quote(''.join(one.values()))})"
    for c, p in T._PLAIN.items():
        if len(p) > 1:
            sql = f"replace({sql}, {quote(c)}, {quote(p)})"
    return f"regexp_replace({sql}, '[^\\x{{0000}}-\\x{{007F}}]', '', 'g')"


_WORDS = "regexp_extract_all(lower(coalesce({t}, '')), '[a-z0-9]+')"


def oracle_sql() -> dict[str, str]:
    part = f"pid // {PART}"
    query_words = f"list_transform(list_slice({_WORDS.format(t='query_text')}, 1, 29), lambda w: CAST(1000 + length(w) AS VARCHAR))"
    return {
        "index_roundtrip": S.SQL["bm25_topk"],
        "search_all": S.SQL["bm25_filter"],
        "clean_text": f"SELECT doc_id, {_clean_sql('text')} AS cleaned FROM documents",
        "index_totals": S._with(S.TOKENS) + "SELECT count(DISTINCT pid) AS passages, count(*) AS embeddings, round(count(*) / CAST(count(DISTINCT pid) AS DOUBLE), 6) AS mean_length FROM tokens",
        "passage_lengths": S._with(S.TOKENS) + "SELECT pid, count(*) AS length FROM tokens GROUP BY pid",
        "index_resume": S._with(S.TOKENS) + f"""SELECT CAST(part AS INTEGER) AS part, passages, embeddings, CAST(coalesce(sum(embeddings) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
            FROM (SELECT {part} AS part, count(DISTINCT pid) AS passages, count(*) AS embeddings FROM tokens GROUP BY 1)""",
        "stored_ivf": S._with(S.TOKENS, S.CODES) + "SELECT code, count(DISTINCT pid) AS passages FROM coded GROUP BY code",
        "encoded_queries": f"""SELECT qid, array_to_string(list_concat(['101', '1'], w, ['102'], list_transform(range(greatest(0, 29 - len(w))), lambda x: '103')), ' ') AS ids,
            CAST(greatest(0, 29 - len(w)) AS INTEGER) AS masks, CAST(len(w) + 3 AS INTEGER) AS attended FROM (SELECT qid, {query_words} AS w FROM queries)""",
        "encoded_documents": f"""SELECT pid, pid // 32 AS batch, CAST(pid % 32 AS INTEGER) AS place, CAST(max(n) OVER (PARTITION BY pid // 32) AS INTEGER) AS padded, CAST(n AS INTEGER) AS attended
            FROM (SELECT doc_id AS pid, 3 + least(177, len({_WORDS.format(t='text')})) AS n FROM documents)""",
        "query_backgrounds": f"""WITH {S.CORPUS}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) AS rank FROM ({S._run()})) WHERE rank <= 3)
            SELECT qid, string_agg(sentence, ' [SEP] ' ORDER BY rank) AS background FROM best b JOIN corpus c ON CAST(b.doc_id AS BIGINT) = c.doc_id WHERE sentence IS NOT NULL GROUP BY qid""",
        "ordered_distinct": S._with(S.CORPUS, S.QUANT) + """SELECT doc_id, unit, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) AS INTEGER) AS place
            FROM (SELECT doc_id, unit, min(pos) AS p FROM quant WHERE unit IS NOT NULL GROUP BY doc_id, unit)""",
        "values_by_record": S._with(S.CORPUS, S.QUANT) + """SELECT doc_id, CAST(count(*) AS INTEGER) AS n, round(arg_min(value, pos), 6) AS "first", round(arg_max(value, pos), 6) AS "last" FROM quant WHERE value IS NOT NULL GROUP BY doc_id""",
    }
