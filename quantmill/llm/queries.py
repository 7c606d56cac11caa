"""The driver's queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quantmill.llm import leaks, mapping, mixing, neardup, overlap, splitting, topn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _collection_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "collection").select(
        F.lit(0).alias("tab"), F.col("doc_id").alias("id"), "split", "source", F.col("ingested_at").alias("at"), F.col("sentence").alias("text")
    )


def _query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "queries").select(
        F.lit(1).alias("tab"), F.col("qid").cast("long").alias("id"), "split", "source", F.col("created_at").alias("at"), F.col("query_text").alias("text")
    )


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, rec_id, pos, ref_name, similarity, source) of every entry that is not letter for letter in its list."""
    collection, train = table(spark, sf_dir, "collection"), table(spark, sf_dir, "train_concepts_units_extended")
    units, concepts = table(spark, sf_dir, "unit_ref"), table(spark, sf_dir, "concept_ref")
    last = collection.groupBy("doc_id").agg(F.max_by(F.struct("units"), F.struct("ingested_at")).alias("x"))
    kind = {"unit": F.lit("unit").alias("kind"), "concept": F.lit("concept").alias("kind")}
    rows = (
        last.select(F.lit("collection.units").alias("field"), F.col("doc_id").alias("rec_id"), F.posexplode("x.units").alias("pos", "value"), kind["unit"])
        .unionByName(train.select(F.lit("train_concepts_units_extended.keyword").alias("field"), F.col("cu_id").alias("rec_id"), F.lit(0).alias("pos"), F.col("keyword").alias("value"), kind["concept"]))
        .unionByName(train.select(F.lit("train_concepts_units_extended.unit").alias("field"), F.col("cu_id").alias("rec_id"), F.lit(0).alias("pos"), F.col("unit").alias("value"), kind["unit"]))
    )
    scales = frozenset(w for r in units.where("unit_type = 'scale'").collect() for w in [r.unit, *(r.forms or [])])
    real = units.where("unit_type <> 'scale'")
    names = real.select(kind["unit"], F.col("unit").alias("value")).unionAll(concepts.select(kind["concept"], F.col("concept").alias("value")))
    forms = real.select(kind["unit"], F.explode(F.array_union("forms", F.array("unit"))).alias("form"), F.col("unit").alias("ref_name")).unionByName(
        concepts.select(kind["concept"], F.col("concept").alias("form"), F.col("concept").alias("ref_name"))
    )
    return mapping.map_entries(rows, forms.distinct(), names.distinct(), {"unit": scales, "concept": frozenset()})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("field", "rec_id", "pos", "ref_name").distinct()


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _collection_texts(spark, sf_dir).unionByName(_query_texts(spark, sf_dir))
    name = F.when(F.col("tab") == 0, "collection").otherwise("queries")
    return overlap.split_overlaps(rows).withColumn("tab", name)


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _collection_texts(spark, sf_dir).unionByName(_query_texts(spark, sf_dir))
    return overlap.overlap_report(rows).withColumn("tab", F.when(F.col("tab") == 0, "collection").otherwise("queries"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir).select("tab", "id_a", "id_b").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = neardup.near_duplicate_groups(_collection_texts(spark, sf_dir))
    return neardup.group_pairs(groups).distinct().select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, first, size): the group of every record, by its smallest id, and the records in it."""
    groups = neardup.near_duplicate_groups(_collection_texts(spark, sf_dir)).select("id", "group_id")
    size = groups.groupBy("group_id").agg(F.min("id").alias("first"), F.count("*").alias("size"))
    return groups.join(size, "group_id").select(F.col("id").alias("doc_id"), "first", "size")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_n(table(spark, sf_dir, "run"), "q_id", "doc_id", "score", 10).select("q_id", "rank", "doc_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    return mixing.Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"), table(spark, sf_dir, "concept_ref"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).shares().where("outcome <> 'within'").select("source", "outcome")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).shares()


def p7_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).marginals()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_documents(table(spark, sf_dir, "documents")).where("piece = 1").select("doc_id").distinct()


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_documents(table(spark, sf_dir, "documents"))


def p8_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, chars, within, overlapping): the characters of a document's pieces without those shared with the piece before, whether no piece is over the
    limit, and whether every piece but the first shares text with the one before."""
    pieces = splitting.split_documents(table(spark, sf_dir, "documents"))
    return pieces.groupBy("doc_id").agg(
        F.sum(F.length("text") - F.col("shared_chars")).cast("long").alias("chars"),
        (F.max("n_tokens") <= splitting.LIMIT).alias("within"),
        (F.count_if(F.col("shared_chars") > 0) == F.count("*") - 1).alias("overlapping"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p2_found, p3_found, p3_report, p4_found, p4_groups, p5_found, p6_found, p7_found, p7_shares, p7_marginals, p8_found, p8_pieces, p8_cover)
    return {f.__name__: f for f in found}


#: The distinct words of a text, the last deliveries of the two tables of problem 3, and what makes two of their texts similar.
_WORDS = "list_distinct(regexp_extract_all(lower({t}), '[a-z0-9]+'))"
_LAST = """SELECT doc_id AS id, split, source, sentence AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC) AS rn FROM collection) WHERE rn = 1"""
_SIMILAR = "5 * len(list_intersect(a.w, b.w)) >= 3 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AND 5 * len(a.w) >= 3 * len(b.w) AND 5 * len(b.w) >= 3 * len(a.w)"
_OVERLAPS = f"""WITH texts AS (SELECT 'collection' AS tab, id, split, source, text FROM ({_LAST}) UNION ALL SELECT 'queries', CAST(qid AS BIGINT), split, source, query_text FROM queries),
    w AS (SELECT tab, id, split, source, {_WORDS.format(t="text")} AS w FROM texts WHERE text IS NOT NULL AND split IN ('train', 'val', 'test')),
    k AS (SELECT * FROM w WHERE len(w) > 0),
    pairs AS (SELECT a.tab, a.id AS train_id, b.id AS eval_id, b.split, b.source, list_sort(a.w) = list_sort(b.w) AS same FROM k a JOIN k b ON a.tab = b.tab AND a.split = 'train' AND b.split <> 'train' AND {_SIMILAR})
    """


_GROUPS = f"""WITH RECURSIVE w AS (SELECT id, {_WORDS.format(t="text")} AS w FROM ({_LAST}) WHERE text IS NOT NULL), k AS (SELECT * FROM w WHERE len(w) > 0),
    links AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM k a JOIN k b ON a.id <> b.id AND {_SIMILAR}),
    reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
    """


def oracle_sql() -> dict[str, str]:
    """SQL over all pairs, phrases and windows: for the small scale that the driver checks."""
    return {
        "p3_found": _OVERLAPS + "SELECT tab, least(train_id, eval_id) AS id_a, greatest(train_id, eval_id) AS id_b FROM pairs",
        "p3_report": _OVERLAPS + """SELECT k.tab, k.split, k.source, count(*) AS records, count(p.eval_id) AS overlapping, coalesce(sum(CAST(p.same AS BIGINT)), 0)::BIGINT AS exact FROM k
            LEFT JOIN (SELECT tab, eval_id, bool_or(same) AS same FROM pairs GROUP BY tab, eval_id) p ON k.tab = p.tab AND k.id = p.eval_id WHERE k.split <> 'train' GROUP BY ALL""",
        "p4_found": _GROUPS + "SELECT DISTINCT x AS doc_id_a, y AS doc_id_b FROM reach WHERE x < y",
        "p4_groups": _GROUPS + """SELECT doc_id, "first", count(*) OVER (PARTITION BY "first") AS size FROM (SELECT k.id AS doc_id, least(k.id, coalesce(min(y), k.id)) AS "first" FROM k LEFT JOIN reach ON x = k.id GROUP BY k.id)""",
        "p6_found": """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
            i AS (SELECT item_id, regexp_extract_all(lower(item_text), '[a-z0-9]+') AS w FROM eval_items WHERE item_text IS NOT NULL),
            phrases AS (SELECT item_id, len(w[p : p + 12]) AS n, array_to_string(w[p : p + 12], ' ') AS phrase FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p FROM i WHERE len(w) > 0)),
            sizes AS (SELECT DISTINCT n FROM phrases), starts AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
            spans AS (SELECT doc_id, n, array_to_string(w[p : p + n - 1], ' ') AS phrase FROM starts, sizes WHERE p + n - 1 <= len(w))
            SELECT DISTINCT doc_id, item_id FROM spans JOIN phrases USING (n, phrase)""",
        "p7_found": """WITH own AS (SELECT source, sum(coalesce(length(text), 0)) AS own FROM documents GROUP BY source), total AS (SELECT sum(coalesce(length(text), 0)) AS total FROM documents)
            SELECT t.source, CASE WHEN coalesce(own, 0) * max_uses < target_share * total THEN 'capped' ELSE 'repeated' END AS outcome
            FROM mix_target t LEFT JOIN own USING (source), total WHERE coalesce(own, 0) < target_share * total""",
        "p8_cover": r"""SELECT doc_id, length(text) AS chars, true AS within, true AS overlapping FROM documents WHERE len(regexp_extract_all(text, '\s?\p{L}+|\s?\p{N}+|\s?[^\s\p{L}\p{N}]+')) > 1000""",
        # pieces of the tokenizers' word pattern: no text has more of them than tokens
        "p8_found": r"""SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '\s?\p{L}+|\s?\p{N}+|\s?[^\s\p{L}\p{N}]+')) > 1000""",
        "p5_found": """
            SELECT q_id, CAST(rank AS INTEGER) AS rank, doc_id FROM (
              SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, doc_id DESC) AS rank FROM (
                SELECT q_id, doc_id, max(score) AS s FROM run
                WHERE q_id IS NOT NULL AND doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY q_id, doc_id))
            WHERE rank <= 10""",
    }
