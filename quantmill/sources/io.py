"""Sources and sinks: annotated collections, queries, rankings, judgements, concept indexes, index tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quantmill import schemas as S
from quantmill.functions import text as T
from quantmill.functions.numeric import numericise


def list_literal(text: Column, kind: str) -> Column:
    """A list written as a literal of a script language (``['usd', None]``, ``[(1, 2)]``) as an array; null where it is none."""
    t = F.translate(text, "()", "[]")
    t = F.regexp_replace(t, r"(?<![\w'])None(?![\w'])", "null")
    t = F.regexp_replace(t, r",\s*\]", "]")
    quoted = F.regexp_replace(t, r"(?<=[\[,\s])'((?:[^'\\]|\\.)*)'(?=\s*[,\]])", '"$1"')
    return F.from_json(quoted, kind)


def spans_literal(text: Column) -> Column:
    """``[[(0, 3)], [(5, 9)]]`` as array of array of (start, end)."""
    pairs = list_literal(text, "array<array<array<int>>>")
    return F.transform(pairs, lambda ps: F.transform(ps, lambda p: F.struct(p[0].alias("start"), p[1].alias("end"))))


def read_collection_csv(spark: SparkSession, path: str, id_column: str = "_c0") -> DataFrame:
    """(doc_id, sentence, normalized_sentence, values, units) from a CSV with a header, quoted cells of several lines and list literals. The id is the
    unnamed first column, never the place of a row in a partition."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return raw.select(
        F.col(id_column).cast("bigint").alias("doc_id"), T.strip_text(F.col("sentence")).alias("sentence"), F.col("normalized_sentence"),
        list_literal(F.col("values"), "array<double>").alias("values"), list_literal(F.col("units"), "array<string>").alias("units"),
    )


def read_queries_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query_text, keywords, unit, value, value2, condition) from a TSV with a header; ``qid`` is its own column or else the row's number in the one
    file. ``value2`` may be absent. Unknown conditions raise when read."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="")
    if "qid" not in raw.columns:
        from quantmill.operators.generate import with_ids

        # a row's place: where its block of the file begins, and its number in the task that reads the block
        placed = raw.withColumns({"_b": F.col("_metadata.file_block_start"), "_i": F.monotonically_increasing_id()})
        raw = with_ids(placed, "qid", ["_b", "_i"]).drop("_b", "_i")
    condition = F.when(F.col("condition").isin(*S.CONDITIONS), F.col("condition")).otherwise(F.raise_error(F.concat(F.lit("unknown condition "), F.col("condition"))))
    second = F.col("value2").cast("double") if "value2" in raw.columns else F.lit(None).cast("double")
    return raw.select(F.col("qid").cast("int").alias("qid"), "query_text", "keywords", "unit", F.col("value").cast("double").alias("value"), second.alias("value2"), condition.alias("condition"))


def read_questions(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """(qid, query) from a TSV without a header or JSON lines with ``qid`` and ``question``; ids that occur twice raise, unless ``check`` is off."""
    if path.endswith((".json", ".jsonl")):
        rows = spark.read.schema("qid bigint, question string").json(path).select("qid", F.col("question").alias("query"))
    else:
        rows = spark.read.schema("qid bigint, query string").csv(path, sep="\t", quote="")
    return require_unique(rows, "qid") if check else rows


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """``df``, if no value of ``key`` occurs twice in it."""
    twice = repeated_ids(df, key).limit(3).collect()
    if twice:
        raise ValueError(f"{key} is not unique: {', '.join(str(r[0]) for r in twice)}")
    return df


def passages(spark: SparkSession, source: str | list[str] | DataFrame) -> DataFrame:
    """(pid, text) of a collection: a TSV of pid and text, a list of texts (numbered from 0), or a DataFrame, which is taken as it is."""
    if isinstance(source, DataFrame):
        return source.select(F.col("pid").cast("bigint").alias("pid"), "text")
    if isinstance(source, str):
        if not source.endswith(".tsv"):
            raise ValueError(f"no collection: {source}")
        return spark.read.schema("pid bigint, text string").csv(source, sep="\t", quote="")
    return spark.createDataFrame(list(enumerate(source)), "pid bigint, text string")


def write_ranking(ranking: DataFrame, path: str) -> None:
    """(qid, pid, rank, score) with their types, clustered by query."""
    ranking.select("qid", "pid", "rank", "score").repartitionByRange("qid").sortWithinPartitions("qid", "rank").write.mode("overwrite").parquet(path)


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """A ranking as ``write_ranking`` or, for a path ending in ``.tsv``, ``write_ranking_tsv`` wrote it."""
    return read_ranking_tsv(spark, path) if path.rstrip("/").endswith(".tsv") else spark.read.parquet(path)


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    """(key, count) of ids that occur more than once."""
    return df.groupBy(key).count().where("count > 1")


def read_nested_json(spark: SparkSession, path: str, value: str = "double") -> DataFrame:
    """(qid, doc_id, value) from a file ``{qid: {doc_id: value}}``."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,map<string,{value}>>").alias("m"))
    return raw.select(F.explode("m").alias("qid", "d")).select("qid", F.explode("d").alias("doc_id", "value"))


def read_run_json(spark: SparkSession, path: str) -> DataFrame:
    return read_nested_json(spark, path).withColumnRenamed("value", "score")


def read_qrels(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(split, qid, doc_id, rel) from one nested JSON file per split."""
    out = None
    for split, path in paths.items():
        part = read_nested_json(spark, path, "int").select(F.lit(split).alias("split"), "qid", "doc_id", F.col("value").alias("rel"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no judgements given")
    return out


def nested_json(run: DataFrame, value: str) -> DataFrame:
    """(qid, json): the documents of every query as one JSON object. One line per query, so no task holds more than a query's documents."""
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), F.col(value))))
    return run.groupBy(F.col("qid").cast("string").alias("qid")).agg(F.to_json(entries).alias("json"))


def write_nested_json(run: DataFrame, path: str, value: str = "score") -> None:
    """A ranking as lines ``{"qid": ..., "docs": {...}}``."""
    nested_json(run, value).select(F.format_string('{"qid": "%s", "docs": %s}', "qid", "json")).write.mode("overwrite").text(path)


def read_nested_json_lines(spark: SparkSession, path: str, value: str = "double") -> DataFrame:
    rows = spark.read.schema(f"qid string, docs map<string,{value}>").json(path)
    return rows.select("qid", F.explode("docs").alias("doc_id", "value"))


def read_ranking_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(qid, pid, rank, score) from flat rows of text."""
    raw = spark.read.schema("qid string, pid string, rank string, score string").csv(path, sep="\t", quote="")
    return raw.select(F.col("qid").cast("bigint").alias("qid"), F.col("pid").cast("bigint").alias("pid"), F.col("rank").cast("int").alias("rank"), numericise(F.col("score")).alias("score"))


def write_ranking_tsv(ranking: DataFrame, path: str, meta: dict | None = None) -> None:
    """Flat rows qid, pid, rank, score, and the provenance beside them as ``_meta.json`` (through Spark, so on any file system)."""
    ranking.select("qid", "pid", "rank", "score").write.mode("overwrite").csv(path, sep="\t", header=False)
    if meta is not None:
        spark = ranking.sparkSession
        spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}_meta")


def read_concept_csv(spark: SparkSession, path: str) -> DataFrame:
    """(keyword, unit, values, sentences, values_char, unit_char) from a CSV with list literals."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return raw.select(
        "keyword", "unit", list_literal(F.col("values"), "array<double>").alias("values"), list_literal(F.col("sentences"), "array<string>").alias("sentences"),
        spans_literal(F.col("values_char")).alias("values_char"), spans_literal(F.col("unit_char")).alias("unit_char"),
    )


def write_index(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite", sort: dict[str, str] | None = None) -> None:
    """Index tables as Parquet, one folder each. ``mode``: ``overwrite``, ``reuse`` (leave what is there) or ``append``. ``sort`` names the column by which a table is
    clustered, so that its readers skip row groups."""
    for name, df in tables.items():
        key = (sort or {}).get(name)
        out = df.repartitionByRange(F.col(key)).sortWithinPartitions(key) if key else df
        out.write.mode({"reuse": "ignore"}.get(mode, mode)).parquet(f"{folder}/{name}")


def read_index(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def compact(spark: SparkSession, source: str, target: str, rows_per_file: int = 5_000_000) -> None:
    """The Parquet files of ``source`` as fewer, evenly filled ones in ``target``."""
    df = spark.read.parquet(source)
    df.repartition(max(1, -(-df.count() // rows_per_file))).write.mode("overwrite").parquet(target)


def resume(rows: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key an earlier run has not written."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def chunks(df: DataFrame, key: str, size: int, owners: int = 1) -> DataFrame:
    """``df`` with its logical ``chunk`` and the ``owner`` of the chunk."""
    chunk = F.floor(F.col(key) / size)
    return df.withColumns({"chunk": chunk, "owner": F.pmod(chunk, F.lit(owners))})


def write_training_tables(tables: dict[str, DataFrame], folder: str, suffix: str = "") -> None:
    """Queries, passages and triples as TSV without a header, judgements as TSV and as JSON by query, triples also as JSON lines."""
    for name in ("queries", "collection", "triples", "id_triples"):
        if name in tables:
            tables[name].write.mode("overwrite").csv(f"{folder}/{name}{suffix}", sep="\t", header=False)
    q = tables["qrel"]
    q.select("query_id", F.lit(0).alias("zero"), "passage_id", "rel").write.mode("overwrite").csv(f"{folder}/qrel{suffix}", sep="\t", header=False)
    write_nested_json(q.select(F.col("query_id").alias("qid"), F.col("passage_id").alias("doc_id"), "rel"), f"{folder}/qrel_json{suffix}", "rel")
    tables["triples"].write.mode("overwrite").json(f"{folder}/triples_json{suffix}")


def write_metrics(evaluated: DataFrame, path: str) -> None:
    """Metrics (split, metric, value) as one JSON object per split, one line each: ``{"split": ..., "metrics": {...}}``."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics")
    evaluated.groupBy("split").agg(entries).select(F.to_json(F.struct("split", "metrics")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(split, metric, value) as ``write_metrics`` wrote them."""
    rows = spark.read.schema("split string, metrics map<string,double>").json(path)
    return rows.select("split", F.explode("metrics").alias("metric", "value"))


def tsv_files(folder: str) -> list[str]:
    return sorted(str(p) for p in Path(folder).glob("*.tsv"))
