"""Problem 7: a mix of sources with target shares of the tokens, small sources repeated up to a limit.

Method: iterative proportional fitting. The tokens of the documents are summed by cell (source, language, topic); the cells' weights are
raked in turn to the marginals of topic, language and source until they settle, the last being the target shares, with every
weight at most the source's limit of uses. The weight of a cell is the expected number of uses of its documents: each document
is used the whole part of it, and once more with the probability of the rest, drawn from a hash of its id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quantmill.llm import tokens as T
from quantmill.session import cut

#: Cells (sources of the targets, times languages, times topics) that the driver rakes itself; more are raked as a table.
MAX_CELLS = 200_000
ROUNDS, SETTLED = 200, 1e-12
OTHER = "other"


@lru_cache(maxsize=2)
def _automaton(concepts: tuple[tuple[str, str], ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase, topic in concepts:
        a.add_word(phrase, (topic, len(phrase)))
    a.make_automaton()
    return a


def topic_of(text: str | None, concepts: tuple[tuple[str, str], ...]) -> str:
    """The topic whose concepts the text names most often, as whole words (of equals, the first by name); ``other`` if none."""
    if not text or not concepts:
        return OTHER
    count: dict[str, int] = {}
    low = text.lower()
    for last, (topic, size) in _automaton(concepts).iter(low):
        before, after = last - size, last + 1
        if (before < 0 or not low[before].isalnum()) and (after == len(low) or not low[after].isalnum()):
            count[topic] = count.get(topic, 0) + 1
    return min(count, key=lambda t: (-count[t], t)) if count else OTHER


def sized(docs: DataFrame, concepts: list[tuple[str, str]], path: str = T.DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) of every document, in one pass over the texts."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].alias("source"), docs["lang"].alias("lang"), docs["text"].alias("text"))
    table = tuple(sorted({(c.lower(), t) for c, t in concepts if c}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.record_batch(
                [b.column("doc_id"), b.column("source"), b.column("lang"), pa.array([topic_of(x, table) for x in texts], pa.string()), pa.array([T.count(x, path) for x in texts], pa.int64())],
                ["doc_id", "source", "lang", "topic", "tokens"],
            )

    return rows.mapInArrow(run, "doc_id long, source string, lang string, topic string, tokens long")


def rake(cells: pd.DataFrame, targets: pd.DataFrame, total: float) -> pd.DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight``, the expected uses of each cell's documents.

    ``targets`` (source, target_share, max_uses). Topic and language keep the shares that they have among the cells; the source
    marginal comes last in each round and is met exactly, unless all uses of a source do not reach it: then all are used. Limits of
    uses can keep topics and languages from their shares; ``marginals`` reports what is reached.
    """
    cells = cells.merge(targets, on="source").reset_index(drop=True)
    size = cells["tokens"].to_numpy(float)
    most = cells["max_uses"].to_numpy(float)
    source, names = pd.factorize(cells["source"])
    need = targets.set_index("source")["target_share"].reindex(names).to_numpy(float) * total
    weight = np.minimum(1.0, most)
    sides = [pd.factorize(cells[c])[0] for c in ("topic", "lang")]
    before = weight.copy()
    for _ in range(ROUNDS):
        for side in sides:
            now = np.bincount(side, weight * size).astype(float)
            want = np.bincount(side, size).astype(float)
            want *= now.sum() / max(want.sum(), 1e-300)
            weight = np.minimum(weight * np.divide(want, now, out=np.ones_like(now), where=now > 0)[side], most)
        weight = _fill(weight, size, most, source, need)
        if np.abs(weight - before).max(initial=0) <= SETTLED * max(1.0, most.max(initial=1)):
            break
        before = weight.copy()
    cells["weight"] = weight
    return cells


def _fill(weight: np.ndarray, size: np.ndarray, most: np.ndarray, source: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Scale each source's weights so that its tokens meet its need, no weight above its limit."""
    full = np.zeros(len(weight), np.bool_)
    for _ in range(len(weight) + 1):
        held = np.bincount(source, np.where(full, most * size, 0.0), minlength=len(need))
        free = np.bincount(source, np.where(full, 0.0, weight * size), minlength=len(need))
        factor = np.divide(np.maximum(need - held, 0), free, out=np.ones_like(need), where=free > 0)
        scaled = np.where(full, most, weight * factor[source])
        over = ~full & (scaled >= most)
        if not over.any():
            return scaled
        full |= over
    return np.where(full, most, scaled)


def rake_table(cells: DataFrame, targets: DataFrame, total: float) -> DataFrame:
    """``rake`` for any number of cells, as joins and sums; every round is checkpointed, and the driver sees only the largest change."""
    used = F.sum(F.col("weight") * F.col("tokens"))
    kept = cells.join(F.broadcast(targets), "source").withColumn("weight", F.least(F.lit(1.0), F.col("max_uses").cast("double")))
    columns = kept.columns
    for _ in range(ROUNDS):
        now = kept.withColumn("before", F.col("weight"))
        for side in ("topic", "lang"):
            scale = F.col("all_now") / F.col("all_want") * F.col("want") / F.col("now")
            by = now.groupBy(side).agg(used.alias("now"), F.sum("tokens").alias("want"))
            every = by.agg(F.sum("now").alias("all_now"), F.sum("want").alias("all_want"))
            factor = by.crossJoin(F.broadcast(every)).select(side, F.when(F.col("now") > 0, scale).otherwise(1.0).alias("factor"))
            now = now.join(factor, side).withColumn("weight", F.least(F.col("weight") * F.col("factor"), F.col("max_uses").cast("double"))).drop("factor")
        now = cut(_fill_table(cut(now), total))
        step = now.agg(F.max(F.abs(F.col("weight") - F.col("before")))).first()[0] or 0.0
        kept = now.select(*columns)
        if step <= 1e-9:
            break
    return kept


def _fill_table(cells: DataFrame, total: float) -> DataFrame:
    """``_fill`` on a table: sources are scaled until no weight that is free passes its limit."""
    most = F.col("max_uses").cast("double")
    cells = cells.withColumn("full", F.lit(False))
    while True:
        held = F.sum(F.when(F.col("full"), most * F.col("tokens")).otherwise(0.0))
        free = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight") * F.col("tokens")))
        by = cells.groupBy("source").agg(held.alias("held"), free.alias("free"))
        factor = F.when(F.col("free") > 0, F.greatest(F.lit(0.0), F.col("target_share") * total - F.col("held")) / F.col("free")).otherwise(1.0)
        scaled = cells.join(F.broadcast(by), "source").withColumn("scaled", F.when(F.col("full"), most).otherwise(F.col("weight") * factor))
        scaled = cut(scaled.withColumn("over", ~F.col("full") & (F.col("scaled") >= most)).drop("held", "free"))
        if scaled.where("over").isEmpty():
            return scaled.withColumn("weight", F.col("scaled")).drop("scaled", "over", "full")
        cells = scaled.withColumn("full", F.col("full") | F.col("over")).drop("scaled", "over")


class Mix:
    """A mix of ``docs`` (doc_id, source, lang, text) by ``targets`` (source, target_share, max_uses), as large as all of ``docs``.

    A source of the targets without documents reaches nothing. Documents of no source, or of one without target, are not used but count in
    the size. Null and empty texts have no tokens. Targets with a null source, share or limit are left out. Null languages are a
    language of their own. Documents given twice count twice. Other columns are ignored.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, concepts: DataFrame, path: str = T.DEFAULT_VOCABULARY) -> None:
        self.spark = docs.sparkSession
        self.sized = cut(sized(docs, [(r[0], r[1]) for r in concepts.select("concept", "topic").where("concept is not null and topic is not null").collect()], path))
        self.targets = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_uses").cast("int").alias("max_uses")).dropna().toPandas()
        self.total = float(self.sized.agg(F.sum("tokens")).first()[0] or 0)
        names = self.spark.createDataFrame(self.targets[["source"]], "source string")
        grouped = self.sized.join(F.broadcast(names), "source", "left_semi").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
        grouped = cut(grouped.fillna({"lang": ""}))
        if grouped.count() <= MAX_CELLS:
            raked = rake(grouped.toPandas(), self.targets, self.total)
            names = "source string, lang string, topic string, tokens long, documents long, weight double"
            self.cells = self.spark.createDataFrame(raked[["source", "lang", "topic", "tokens", "documents", "weight"]], names)
        else:
            limits = self.spark.createDataFrame(self.targets, "source string, target_share double, max_uses int")
            self.cells = rake_table(grouped, limits, self.total)

    def documents(self, seed: int = 7) -> DataFrame:
        """(doc_id, source, tokens, uses) of the documents used at least once."""
        cells = self.cells.select("source", "lang", "topic", "weight")
        draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        uses = F.floor("weight") + (draw < F.col("weight") - F.floor("weight")).cast("int")
        return (
            self.sized.fillna({"lang": ""}).join(cells, ["source", "lang", "topic"])
            .select("doc_id", "source", "tokens", uses.cast("int").alias("uses")).where("uses > 0")
        )

    def marginals(self) -> DataFrame:
        """(side, name, wanted_share, reached_share): of every source of the targets, language and topic, the share of the mix's tokens that it should have and
        that its calibrated weights give it. Languages and topics should keep the shares that they have among the documents of the targets."""
        got = F.sum(F.col("weight") * F.col("tokens")).alias("got")
        targets = self.spark.createDataFrame(self.targets[["source", "target_share"]], "source string, target_share double")
        share = F.coalesce("got", F.lit(0.0)) / F.lit(max(self.total, 1.0))
        out = targets.join(self.cells.groupBy("source").agg(got), "source", "left").select(F.lit("source").alias("side"), F.col("source").alias("name"), F.col("target_share").alias("wanted_share"), share.alias("reached_share"))
        every = self.cells.agg(F.sum("tokens").alias("all_own"), got.alias("all_got"))
        for side in ("lang", "topic"):
            by = self.cells.groupBy(side).agg(F.sum("tokens").alias("own"), got).crossJoin(F.broadcast(every))
            out = out.unionByName(by.select(F.lit(side).alias("side"), F.col(side).alias("name"), (F.col("own") / F.col("all_own")).alias("wanted_share"), (F.col("got") / F.col("all_got")).alias("reached_share")))
        return out

    def shares(self) -> DataFrame:
        """(source, target_share, max_uses, documents, own_tokens, calibrated_share, sampled_share, outcome) for every target."""
        # one row for each source of the targets
        by = self.cells.groupBy("source").agg(F.sum("tokens").alias("own_tokens"), F.sum("documents").alias("documents"), F.sum(F.col("weight") * F.col("tokens")).alias("got")).toPandas().set_index("source")
        t = self.targets.merge(by, left_on="source", right_index=True, how="left").fillna({"own_tokens": 0, "documents": 0, "got": 0})
        need = t["target_share"] * self.total
        t["calibrated_share"] = t["got"] / max(self.total, 1.0)
        short = t["got"] < need * (1 - 1e-9)
        t["outcome"] = np.where(short, "capped", np.where(t["got"] > t["own_tokens"] * (1 + 1e-9), "repeated", "within"))
        t = t.astype({"own_tokens": "int64", "documents": "int64"}).drop(columns="got")
        left = self.spark.createDataFrame(t[["source", "target_share", "max_uses", "documents", "own_tokens", "calibrated_share", "outcome"]],
            "source string, target_share double, max_uses int, documents long, own_tokens long, calibrated_share double, outcome string")
        used = self.documents().groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used"))
        share = F.coalesce(F.col("used"), F.lit(0)) / F.lit(max(self.total, 1.0))
        return left.join(used, "source", "left").withColumn("sampled_share", share).drop("used")
