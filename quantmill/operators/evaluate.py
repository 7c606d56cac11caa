"""Evaluation of rankings: rank metrics by split, and the paired permutation test."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

METRICS = ("MRR", "P", "recall", "ndcg_cut")
#: The cuts of the supported measures.
CUTS = (10, 100, 1000)


def truncate_run(run: DataFrame, k: int) -> DataFrame:
    """The k best documents of every query by score; ties by doc_id as text, falling. Null and NaN scores are left out, and a document
    counts once with its best score. ``run`` (qid, doc_id, score)."""
    once = run.where("score is not null and not isnan(score)").groupBy("qid", "doc_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("doc_id"))
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def parse_metric(name: str) -> tuple[str, int]:
    """``recall@10`` as (recall, 10)."""
    m = re.fullmatch(r"(\w+)@(\d+)", name)
    if not m or m[1] not in METRICS or int(m[2]) not in CUTS:
        raise ValueError(f"unsupported metric {name!r}; there are {', '.join(METRICS)} at {', '.join(map(str, CUTS))}")
    return m[1], int(m[2])


def per_query(run: DataFrame, qrel: DataFrame, k: int = 10) -> DataFrame:
    """(split, qid, mrr, p, recall, ndcg) at k for every query of a split that is in the run and in the judgements.

    ``qrel`` (split, qid, doc_id, rel); repeated judgements count once, with the highest grade. One pass serves all splits."""
    judged = qrel.groupBy("split", "qid", "doc_id").agg(F.max("rel").alias("rel"))
    ranked = truncate_run(run, k)
    in_run = run.where("score is not null and not isnan(score)").select("qid").distinct()
    gain = lambda rel, rank: rel / F.log2(rank + 1.0)
    ideal_rank = Window.partitionBy("split", "qid").orderBy(F.desc("rel"), F.desc("doc_id"))
    ideal = (
        judged.where("rel > 0").withColumn("r", F.row_number().over(ideal_rank)).groupBy("split", "qid")
        .agg(F.sum(F.when(F.col("r") <= k, gain(F.col("rel"), F.col("r")))).alias("idcg"), F.count("*").alias("relevant"))
    )
    asked = judged.select("split", "qid").distinct().join(in_run, "qid", "left_semi")
    hits = (
        judged.where("rel > 0").join(ranked, ["qid", "doc_id"]).groupBy("split", "qid")
        .agg(F.min("rank").alias("first"), F.count("*").alias("found"), F.sum(gain(F.col("rel"), F.col("rank"))).alias("dcg"))
    )
    both = asked.join(ideal, ["split", "qid"], "left").join(hits, ["split", "qid"], "left")
    zero = F.lit(0.0)
    found = F.coalesce("found", F.lit(0)).cast("double")
    return both.select(
        "split", "qid", F.coalesce(1.0 / F.col("first"), zero).alias("mrr"), (found / F.lit(float(k))).alias("p"),
        F.coalesce(found / F.col("relevant"), zero).alias("recall"), F.coalesce(F.col("dcg") / F.col("idcg"), zero).alias("ndcg"),
    )


COLUMN = {"MRR": "mrr", "P": "p", "recall": "recall", "ndcg_cut": "ndcg"}


def evaluate(run: DataFrame, qrel: DataFrame, metrics: tuple[str, ...] = ("MRR@10", "P@10", "recall@10", "ndcg_cut@10")) -> DataFrame:
    """(split, metric, value, queries): means over the evaluated queries of every split."""
    wanted = [parse_metric(m) for m in metrics]
    out = None
    for k in sorted({k for _, k in wanted}):
        q = per_query(run, qrel, k)
        names = [m for m, kk in wanted if kk == k]
        stacked = q.select("split", F.explode(F.array(*[F.struct(F.lit(f"{m}@{k}").alias("metric"), F.col(COLUMN[m]).alias("v")) for m in names])).alias("x"))
        part = stacked.groupBy("split", "x.metric").agg(F.avg("x.v").alias("value"), F.count("*").alias("queries"))
        out = part if out is None else out.unionByName(part)
    return out


def sign(rep: Column, query: Column) -> Column:
    """+1 or -1 by a fixed integer mixing of repetition and query, the same in any SQL engine."""
    a = F.pmod(rep * 7919 + query * 104729 + F.lit(13), F.lit(10007))
    mixed = F.pmod(a * a + a * F.pmod(rep, F.lit(101)) + F.pmod(query, F.lit(977)) * 31, F.lit(10007))
    return F.when(F.pmod(mixed, F.lit(2)) == 0, 1.0).otherwise(-1.0)


def permutation_test(a: DataFrame, b: DataFrame, repetitions: int = 10_000) -> DataFrame:
    """One row (queries, delta, p): the paired permutation test on per-query values of two systems (qid, v).

    Each repetition exchanges the outputs of a query with probability one half; p = (1 + exceedances) / (repetitions + 1).
    Work is one row per query and repetition, summed in each task before the shuffle. Systems that were not evaluated on the same number
    of queries raise when the result is read.
    """
    d = a.select("qid", F.col("v").alias("va")).join(b.select("qid", F.col("v").alias("vb")), "qid").select(F.col("qid").cast("bigint").alias("q"), (F.col("va") - F.col("vb")).alias("d"))
    reps = d.select("q", "d", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("rep"))
    sums = reps.groupBy("rep").agg(F.sum(F.col("d") * sign(F.col("rep"), F.col("q"))).alias("s"))
    uneven = F.broadcast(a.agg(F.count("*").alias("na")).crossJoin(b.agg(F.count("*").alias("nb"))))
    base = d.agg(F.count("*").alias("queries"), F.sum("d").alias("total")).crossJoin(uneven)
    over = sums.crossJoin(F.broadcast(base)).agg(
        F.max("queries").alias("queries"), F.max(F.abs(F.col("total")) / F.col("queries")).alias("delta"),
        F.sum(F.when(F.round(F.abs("s"), 9) >= F.round(F.abs("total"), 9), 1).otherwise(0)).alias("over"), F.max("na").alias("na"), F.max("nb").alias("nb"),
    )
    p = (F.col("over") + 1.0) / F.lit(repetitions + 1.0)
    same = F.when((F.col("na") == F.col("nb")) | F.col("na").isNull(), p).otherwise(F.raise_error("the systems have different numbers of queries").cast("double"))
    return over.select("queries", "delta", same.alias("p"))
