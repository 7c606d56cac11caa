"""Incremental index build: documents that arrive as a stream are added to the postings, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quantmill.functions import text as T


def postings_of(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of (doc_id, text)."""
    return docs.select("doc_id", F.explode(T.simple_tokens(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def append_stream(docs: DataFrame, index: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the postings of streamed ``docs`` (doc_id, text) to ``index``/postings and their lengths to ``index``/docs.

    A batch that is run again after a failure, or a document that is delivered again, adds nothing: documents already there are left out. idf and mean length are
    statistics of an index version; they are computed from the tables when it is read."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.where("doc_id is not null").dropDuplicates(["doc_id"])
        if _exists(spark, f"{index}/docs"):
            new = new.join(spark.read.parquet(f"{index}/docs").select("doc_id"), "doc_id", "left_anti")
        new = new.persist()
        if not new.isEmpty():
            postings_of(new).write.mode("append").parquet(f"{index}/postings")
            # last, so that a failure before leaves the documents to be added again
            new.select("doc_id", F.size(T.simple_tokens(F.col("text"))).alias("dl")).write.mode("append").parquet(f"{index}/docs")
        new.unpersist()

    writer = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_postings(spark: SparkSession, index: str) -> DataFrame:
    """The postings of the documents that are wholly there."""
    return spark.read.parquet(f"{index}/postings").distinct().join(spark.read.parquet(f"{index}/docs").select("doc_id").distinct(), "doc_id", "left_semi").select("term", "doc_id", "tf")
