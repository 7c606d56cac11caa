"""Index folders: their life cycle (build, reuse, resume, load), metadata, numbered parts and lengths of passages.

Everything goes through Spark's readers and writers, so a folder may be on any file system that the cluster shares. A
folder is complete when its metadata are there; they are written last.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession, functions as F

_META = "metadata"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def is_complete(spark: SparkSession, folder: str) -> bool:
    return _exists(spark, f"{folder}/{_META}/_SUCCESS")


def begin(spark: SparkSession, folder: str) -> None:
    """Takes back the mark of completeness, before anything is written."""
    _delete(spark, f"{folder}/{_META}")


def finish(spark: SparkSession, folder: str, meta: dict) -> None:
    """Writes the metadata, which make the index complete."""
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{_META}")


def metadata(spark: SparkSession, folder: str) -> dict:
    if not is_complete(spark, folder):
        raise FileNotFoundError(f"no complete index in {folder}")
    return json.loads("".join(r.value for r in spark.read.text(f"{folder}/{_META}").collect()))


def parts(passages: DataFrame, size: int, key: str = "pid") -> DataFrame:
    """``passages`` with ``part``: passages key // size, so that parts are the same whatever the partitioning."""
    return passages.withColumn("part", F.floor(F.col(key) / size).cast("int"))


def write_parts(rows: DataFrame, folder: str, resume: bool = False) -> list[int]:
    """Writes ``rows`` (part, ...) as one sub-folder for each part; with ``resume`` only parts that are not there. Returns the parts written by
    this call. A part is there only when all of it is, as Spark moves its files at the end of the job."""
    spark = rows.sparkSession
    done = spark.read.parquet(folder).select("part").distinct() if resume and _exists(spark, f"{folder}/_SUCCESS") else None
    left = rows if done is None else rows.join(F.broadcast(done), "part", "left_anti")
    names = sorted(r.part for r in left.select("part").distinct().collect())
    if names or done is None:
        left.repartition("part").write.mode("append" if resume else "overwrite").partitionBy("part").parquet(folder)
    return names


def read_parts(spark: SparkSession, folder: str, first: int | None = None, end: int | None = None) -> DataFrame:
    """The rows of all parts, or of those from ``first`` to before ``end``; raises if a part between them is missing."""
    rows = spark.read.parquet(folder)
    if first is not None:
        rows = rows.where(F.col("part") >= first)
    if end is not None:
        rows = rows.where(F.col("part") < end)
    check_contiguous(rows, first)
    return rows


def check_contiguous(rows: DataFrame, first: int | None = None) -> None:
    """Raises unless the parts are numbered without a gap, from ``first`` or 0."""
    got = rows.agg(F.min("part").alias("low"), F.max("part").alias("high"), F.countDistinct("part").alias("n")).first()
    if got.n and (got.low != (first or 0) or got.high - got.low + 1 != got.n):
        raise ValueError(f"parts are not contiguous: {got.n} of {got.low} to {got.high}")


def lengths(tokens: DataFrame, key: str = "pid") -> DataFrame:
    """(pid, length): tokens of every passage."""
    return tokens.groupBy(key).agg(F.count("*").alias("length"))


def totals(tokens: DataFrame, key: str = "pid") -> DataFrame:
    """One row (passages, embeddings, mean_length)."""
    return lengths(tokens, key).agg(F.count("*").alias("passages"), F.coalesce(F.sum("length"), F.lit(0)).alias("embeddings"), F.avg("length").alias("mean_length"))


def part_totals(tokens: DataFrame) -> DataFrame:
    """(part, passages, embeddings, offset) of ``tokens`` (part, pid): the offset counts the embeddings of the parts before."""
    from pyspark.sql import Window

    each = tokens.groupBy("part", "pid").agg(F.count("*").alias("n")).groupBy("part").agg(F.count("*").alias("passages"), F.sum("n").alias("embeddings"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    return each.withColumn("offset", F.coalesce(F.sum("embeddings").over(before), F.lit(0)))


def sample_passages(tokens: DataFrame, passages: int, seed: int = 12345) -> DataFrame:
    """The tokens of a sample for training: about 1 + 16 sqrt(120 passages) passages, drawn by hash; all if there are fewer."""
    wanted = min(1 + int(16 * math.sqrt(120 * max(0, passages))), passages)
    share = wanted / max(1, passages)
    return tokens.where(F.pmod(F.xxhash64("pid", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30) + 1)) if share < 1 else tokens


def held_out(sample: DataFrame, count: int, most: int = 50_000, share: float = 0.05, seed: int = 99) -> tuple[DataFrame, DataFrame]:
    """(training, held out): a part of about ``share`` of the ``count`` tokens of a sample, at most ``most``, by hash of the token."""
    part = min(share, most / max(1, count))
    out = F.pmod(F.xxhash64("pid", "tok", F.lit(seed)), F.lit(1 << 30)) < int(part * (1 << 30))
    return sample.where(~out), sample.where(out)
