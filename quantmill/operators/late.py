"""Late interaction over token vectors: exact MaxSim, an inverted file with a residual codec, staged search, quantity re-ranking.

Queries are a stated set; they go to the tasks in blocks of whole queries of bounded size. The vectors of a passage stand in one row, so
a task scores its passages by matrix products in tiles of bounded size, sums over the query's tokens at once, and shuffles one row per
query and passage, or only the best k of each batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quantmill.functions import vectors as V

#: Query tokens per block, products per tile, and centroids that are held at most.
BLOCK, TILE, MAX_CENTROIDS = 4096, 2_000_000, 262_144
_LEAST = -9999.0


def matrix(col: pa.Array) -> np.ndarray:
    """A column of equally long vectors as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


@dataclass(frozen=True)
class Asked:
    """A block of whole queries: ``vecs`` of all their tokens, ``start`` of each query among these, token numbers."""

    qids: np.ndarray
    start: np.ndarray
    qtok: np.ndarray
    vecs: np.ndarray

    def of(self, k: int) -> slice:
        return slice(int(self.start[k]), int(self.start[k + 1]))


def query_blocks(query_tokens: DataFrame, size: int = BLOCK) -> Iterator[Asked]:
    """The queries (qid, qtok, vec) in order, in blocks of about ``size`` tokens; a query is never split."""
    rows: list = []
    for row in query_tokens.select("qid", "qtok", "vec").orderBy("qid", "qtok").toLocalIterator():
        if len(rows) >= size and row.qid != rows[-1].qid:
            yield _asked(rows)
            rows = []
        rows.append(row)
    if rows:
        yield _asked(rows)


def _asked(rows: list) -> Asked:
    qid = np.array([r.qid for r in rows], np.int64)
    start = np.flatnonzero(np.append(True, qid[1:] != qid[:-1]))
    return Asked(qid[start], np.append(start, len(qid)), np.array([r.qtok for r in rows], np.int64), np.array([r.vec for r in rows], np.float64))


def passages(tokens: DataFrame) -> DataFrame:
    """(pid, vecs): the token vectors of every passage in one row."""
    return tokens.select(F.col("pid").cast("long").alias("pid"), "vec").groupBy("pid").agg(F.collect_list(V.doubles(F.col("vec"))).alias("vecs"))


def _vectors(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of all vectors, offsets of each row's) of a column of lists of equally long vectors."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    count = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return matrix(col.flatten()), np.append(0, np.cumsum(count))


def _tiles(offsets: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose vectors times ``width`` make about TILE products."""
    most, first = max(1, TILE // max(1, width)), 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        yield first, last
        first = last


Pool = Callable[[np.ndarray, np.ndarray], np.ndarray]


def summed(clamp_zero: bool = False, top_tokens: int | None = None) -> Pool:
    """Sums the best matches of a query's tokens (rows) in each passage (columns)."""

    def pool(best: np.ndarray, qtok: np.ndarray) -> np.ndarray:
        if clamp_zero:
            best = np.maximum(best, 0.0)
        if top_tokens is not None and top_tokens < len(best):
            best = -np.partition(-best, top_tokens - 1, axis=0)[:top_tokens]
        return best.sum(axis=0)

    return pool


def similarity(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Inner products of the rows, or negative squared distances (``l2``)."""
    s = q @ x.T
    return s if metric == "dot" else -(np.sum(q * q, 1)[:, None] + np.sum(x * x, 1)[None, :] - 2 * s)


def _best(s: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The largest of each run of columns."""
    return np.maximum.reduceat(s, offsets[:-1] - offsets[0], axis=1)


def late_scores(rows: DataFrame, query_tokens: DataFrame, pool: Pool, metric: str = "dot", k: int | None = None) -> DataFrame:
    """(qid, pid, score) of all queries and passages (pid, vecs); with ``k`` only those that are among the best k of their batch."""
    schema = "qid long, pid long, score double"
    out = None
    for block in query_blocks(query_tokens):
        held = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            q = held.value
            for b in batches:
                pid = b.column("pid").to_numpy(zero_copy_only=False)
                x, offsets = _vectors(b.column("vecs"))
                some = np.flatnonzero(np.diff(offsets) > 0)
                pid, offsets = pid[some], np.append(offsets[:-1][some], offsets[-1])
                if not len(pid):
                    continue
                score = np.empty((len(q.qids), len(pid)))
                for i, j in _tiles(offsets, len(q.vecs)):
                    best = _best(similarity(q.vecs, x[offsets[i] : offsets[j]], metric), offsets[i : j + 1])
                    for n in range(len(q.qids)):
                        score[n, i:j] = pool(best[q.of(n)], q.qtok[q.of(n)])
                yield _rows(q.qids, pid, score, k)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], schema)


def _rows(qids: np.ndarray, pid: np.ndarray, score: np.ndarray, k: int | None) -> pa.RecordBatch:
    if k is None or k >= len(pid):
        at = np.broadcast_to(np.arange(len(pid)), score.shape)
    else:
        # ties of the kth are settled among all, so none of them is lost here
        order = np.round(score, 9)
        least = -np.partition(-order, k - 1, axis=1)[:, k - 1 : k]
        n, at = np.nonzero(order >= least)
        return pa.record_batch([pa.array(qids[n]), pa.array(pid[at]), pa.array(score[n, at])], ["qid", "pid", "score"])
    return pa.record_batch([pa.array(np.repeat(qids, len(pid))), pa.array(pid[at.ravel()]), pa.array(score.ravel())], ["qid", "pid", "score"])


def pair_scores(pairs: DataFrame, query_tokens: DataFrame, schema: str, score: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], pa.Array]) -> DataFrame:
    """(qid, pid, score) of ``pairs`` (qid, pid, more). ``score`` gets the query's vectors and token numbers and its pairs of a batch.
    Pairs are read once for each block of queries."""
    out = None
    for block in query_blocks(query_tokens):
        held = pairs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            q = held.value
            place = {int(x): n for n, x in enumerate(q.qids)}
            for b in batches:
                qid = b.column("qid").to_numpy(zero_copy_only=False)
                order = np.argsort(qid, kind="stable")
                start = np.flatnonzero(np.append(True, qid[order][1:] != qid[order][:-1])) if len(qid) else []
                for i, j in zip(start, np.append(start[1:], len(qid)) if len(qid) else []):
                    n = place.get(int(qid[order[i]]))
                    if n is None:
                        continue
                    part = b.take(pa.array(order[i:j]))
                    yield pa.record_batch([part.column("qid"), part.column("pid"), pa.array(score(q.vecs[q.of(n)], q.qtok[q.of(n)], part), pa.float64())], ["qid", "pid", "score"])

        ids = F.broadcast(pairs.sparkSession.createDataFrame([(int(x),) for x in block.qids], "qid long"))
        part = pairs.select(F.col("qid").cast("long").alias("qid"), F.col("pid").cast("long").alias("pid"), *[c for c in pairs.columns if c not in ("qid", "pid")]).join(ids, "qid", "left_semi").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else pairs.sparkSession.createDataFrame([], schema)


def maxsim(tokens: DataFrame, query_tokens: DataFrame, metric: str = "dot", clamp_zero: bool = False, top_tokens: int | None = None, k: int | None = None) -> DataFrame:
    """(qid, pid, score): the sum over query tokens of the best match in the passage.

    ``tokens`` (pid, vec), ``query_tokens`` (qid, qtok, vec); ``metric`` ``dot`` or ``l2`` (negative squared distance). ``clamp_zero`` counts negative
    matches as 0; ``top_tokens`` sums only the best so many query tokens. With ``k`` only passages that may be among a query's best k."""
    return late_scores(passages(tokens), query_tokens, summed(clamp_zero, top_tokens), metric, k)


def maxsim_pairs(pairs: DataFrame, tokens: DataFrame, query_tokens: DataFrame, pool: Pool | None = None) -> DataFrame:
    """(qid, pid, score) of ``pairs`` (qid, pid) alone: each query meets only the vectors of its own candidates."""
    pool = pool or summed()

    def score(q: np.ndarray, qtok: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
        x, offsets = _vectors(part.column("vecs"))
        out = np.empty(part.num_rows)
        for i, j in _tiles(offsets, len(q)):
            out[i:j] = pool(_best(similarity(q, x[offsets[i] : offsets[j]], "dot"), offsets[i : j + 1]), qtok)
        return out

    asked = pairs.join(passages(tokens), "pid")
    return pair_scores(asked, query_tokens, "qid long, pid long, score double", score)


def maxsim_with_context(tokens: DataFrame, query_tokens: DataFrame, query_length: int = 64, best_query: int = 32, best_context: int = 8) -> DataFrame:
    """(qid, pid, score): the best ``best_query`` matches of the query's first ``query_length`` tokens, and the best ``best_context`` of the tokens after them."""
    asked, context = summed(top_tokens=best_query), summed(top_tokens=best_context)

    def pool(best: np.ndarray, qtok: np.ndarray) -> np.ndarray:
        own = qtok < query_length
        return asked(best[own], qtok[own]) + context(best[~own], qtok[~own])

    return late_scores(passages(tokens), query_tokens, pool)


def content_tokens(tokens: DataFrame, skip: list[str], column: str = "token") -> DataFrame:
    """Token rows without marks and padding."""
    return tokens.where(~F.col(column).isin(*skip)) if skip else tokens


def top_passages(scored: DataFrame, k: int) -> DataFrame:
    """(qid, pid, score, rank): ties go to the larger pid."""
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), F.desc("pid"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class SearchKnobs:
    """Cells probed per query token, centroid score threshold, passages kept by the first stage."""

    ncells: int
    threshold: float
    ndocs: int

    @staticmethod
    def for_k(k: int) -> SearchKnobs:
        if k <= 10:
            return SearchKnobs(1, 0.5, 256)
        return SearchKnobs(2, 0.45, 1024) if k <= 100 else SearchKnobs(4, 0.4, max(4 * k, 4096))


def plan_index(passages: int, mean_length: float) -> dict[str, int]:
    """Sizes of an index: passages sampled for training, centroids, and bound of the held-out tokens."""
    return {
        "sampled": min(1 + int(16 * math.sqrt(120 * passages)), passages),
        "centroids": 2 ** int(math.floor(math.log2(16 * math.sqrt(max(1.0, passages * mean_length))))),
        "held_out": 50_000,
    }


def kmeans_centroids(tokens: DataFrame, k: int, iterations: int = 4, seed: int = 123) -> DataFrame:
    """(code, vec): unit-length centroids by k-means over the (L2-normalised) tokens."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, maxIter=iterations, seed=seed, featuresCol="f").fit(tokens.select(array_to_vector(V.l2_normalise(F.col("vec"))).alias("f")))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return tokens.sparkSession.createDataFrame(rows, "code int, vec array<double>").select("code", V.l2_normalise(F.col("vec")).alias("vec"))


def label_centroids(vectors: DataFrame) -> DataFrame:
    """(code, vec): the mean vector of every ``code``."""
    long = vectors.select("code", F.posexplode(V.doubles(F.col("vec"))).alias("dim", "x"))
    means = long.groupBy("code", "dim").agg(F.avg("x").alias("m"))
    return means.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("v")).select("code", F.col("v.m").alias("vec"))


def _held(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = centroids.select("code", "vec").limit(MAX_CENTROIDS + 1).collect()
    if len(rows) > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids")
    rows.sort(key=lambda r: r.code)
    return np.array([r.code for r in rows], np.int64), np.array([r.vec for r in rows], np.float64)


def assign_codes(tokens: DataFrame, centroids: DataFrame) -> DataFrame:
    """``tokens`` (pid, tok, vec) with ``code``: the centroid of the largest dot product, of equals the smallest code."""
    held = tokens.sparkSession.sparkContext.broadcast(_held(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, c = held.value
        for b in batches:
            x = matrix(b.column("vec"))
            step = max(1, TILE // max(1, len(c)))
            best = np.concatenate([codes[np.argmax(x[i : i + step] @ c.T, axis=1)] for i in range(0, len(x), step)]) if len(x) else codes[:0]
            yield pa.record_batch([b.column("pid"), b.column("tok"), b.column("vec"), pa.array(best.astype(np.int32))], ["pid", "tok", "vec", "code"])

    return tokens.select(F.col("pid").cast("long").alias("pid"), F.col("tok").cast("int").alias("tok"), V.doubles(F.col("vec")).alias("vec")).mapInArrow(run, "pid long, tok int, vec array<double>, code int")


@dataclass
class LateIndex:
    """``tokens`` (pid, tok, vec, code), ``centroids`` (code, vec), ``cutoffs`` and ``weights`` of the residual codec."""

    tokens: DataFrame
    centroids: DataFrame
    cutoffs: list[float]
    weights: list[float]
    bits: int

    @staticmethod
    def build(tokens: DataFrame, centroids: DataFrame, bits: int = 2, exact: bool = False) -> LateIndex:
        """Assign tokens to centroids and calibrate the buckets of residuals at their quantiles: to 1 / 10000, or
        exactly, which takes all residuals into one task and is for bounded samples."""
        coded = assign_codes(tokens, centroids)
        residuals = LateIndex.residuals_of(coded, centroids).select(F.explode("residual").alias("r"))
        n = 2**bits
        at = [i / n for i in range(1, n)] + [(i + 0.5) / n for i in range(n)]
        q = F.percentile("r", F.array(*[F.lit(x) for x in at])) if exact else F.percentile_approx("r", at, 10_000)
        values = [float(x) for x in residuals.agg(q).first()[0]]
        return LateIndex(coded, centroids, values[: n - 1], values[n - 1 :], bits)

    @staticmethod
    def residuals_of(coded: DataFrame, centroids: DataFrame) -> DataFrame:
        c = centroids.select("code", F.col("vec").alias("c"))
        return coded.join(c, "code").select("pid", "tok", "code", V.subtract(F.col("vec"), F.col("c")).alias("residual"))

    def residuals(self) -> DataFrame:
        return self.residuals_of(self.tokens, self.centroids)

    def encoded(self) -> DataFrame:
        """(pid, tok, code, buckets): the bucket number of every component of the residual."""
        return self.residuals().select("pid", "tok", "code", F.transform("residual", lambda r: V.bucket(r, self.cutoffs)).alias("buckets"))

    def decoded(self) -> DataFrame:
        """(pid, tok, vec): centroid plus bucket weights, at unit length."""
        weights = F.array(*[F.lit(w) for w in self.weights])
        joined = self.encoded().join(self.centroids.select("code", F.col("vec").alias("c")), "code")
        return joined.select("pid", "tok", V.l2_normalise(V.add(F.col("c"), F.transform("buckets", lambda b: F.get(weights, b)))).alias("vec"))

    def ivf(self) -> DataFrame:
        """(code, pid), distinct."""
        return self.tokens.select("code", "pid").distinct()

    def probe(self, query_tokens: DataFrame, ncells: int) -> DataFrame:
        """(qid, qtok, code, score): the best cells of every query token, chosen in the task; ties go to the smaller code."""
        held = query_tokens.sparkSession.sparkContext.broadcast(_held(self.centroids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, c = held.value
            k = min(ncells, len(codes))
            for b in batches:
                q = matrix(b.column("vec"))
                step = max(1, TILE // max(1, len(c)))
                for i in range(0, len(q) if k else 0, step):
                    s = q[i : i + step] @ c.T
                    least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                    row, at = np.nonzero(s >= least)
                    order = np.lexsort((codes[at], -s[row, at], row))
                    row, at = row[order], at[order]
                    first = np.arange(len(row)) - np.searchsorted(row, row) < k
                    row, at = row[first], at[first]
                    yield pa.record_batch([b.column("qid").take(pa.array(row + i)), b.column("qtok").take(pa.array(row + i)), pa.array(codes[at].astype(np.int32)), pa.array(s[row, at])], ["qid", "qtok", "code", "score"])

        asked = query_tokens.select(F.col("qid").cast("long").alias("qid"), F.col("qtok").cast("int").alias("qtok"), V.doubles(F.col("vec")).alias("vec"))
        return asked.mapInArrow(run, "qid long, qtok int, code int, score double")

    def candidates(self, query_tokens: DataFrame, ncells: int) -> DataFrame:
        """(qid, pid) of the passages with a token in a probed cell."""
        return self.probe(query_tokens, ncells).select("qid", "code").distinct().join(self.ivf(), "code").select("qid", "pid").distinct()

    def candidate_hits(self, query_tokens: DataFrame, ncells: int) -> DataFrame:
        """(qid, pid, hits): the candidates with the number of probed cells that they have a token in."""
        return self.probe(query_tokens, ncells).select("qid", "code").distinct().join(self.ivf(), "code").groupBy("qid", "pid").agg(F.count("*").alias("hits"))

    def approximate(self, pairs: DataFrame, query_tokens: DataFrame, threshold: float | None) -> DataFrame:
        """(qid, pid, score) of ``pairs`` from centroid scores alone; with a threshold, centroids that reach it for no token of the query are
        left out, and a query token without a centroid in the passage counts as the padding value."""
        held = pairs.sparkSession.sparkContext.broadcast(_held(self.centroids))

        def score(q: np.ndarray, qtok: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
            codes, c = held.value
            lists = part.column("codes")
            offsets = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            at = np.searchsorted(codes, lists.flatten().to_numpy(zero_copy_only=False))
            used, of = np.unique(at, return_inverse=True)
            s = q @ c[used].T
            if threshold is not None:
                s = np.where(s.max(axis=0) >= threshold, s, -np.inf)
            out = np.empty(part.num_rows)
            for i, j in _tiles(offsets, len(q)):
                best = _best(s[:, of[offsets[i] : offsets[j]]], offsets[i : j + 1])
                out[i:j] = np.where(np.isneginf(best), _LEAST, best).sum(axis=0)
            return out

        codes = self.tokens.groupBy("pid").agg(F.collect_set("code").alias("codes"))
        return pair_scores(pairs.join(codes, "pid"), query_tokens, "qid long, pid long, score double", score)

    def search(self, query_tokens: DataFrame, k: int = 10, knobs: SearchKnobs | None = None, keep=None, vectors: DataFrame | None = None) -> DataFrame:
        """(qid, pid, rank, score): candidates from the probed cells; the best ``ndocs`` by pruned centroid scores; a quarter of these by all
        centroid scores; MaxSim on their (decoded) vectors. ``keep`` is a filter on the candidates, a Column or a function."""
        knobs = knobs or SearchKnobs.for_k(k)
        pairs = self.candidates(query_tokens, knobs.ncells)
        if keep is not None:
            pairs = pairs.transform(keep) if callable(keep) else pairs.where(keep)
        first = top_passages(self.approximate(pairs, query_tokens, knobs.threshold), knobs.ndocs).select("qid", "pid")
        second = top_passages(self.approximate(first, query_tokens, None), max(1, knobs.ndocs // 4)).select("qid", "pid")
        source = vectors if vectors is not None else self.decoded()
        return top_passages(maxsim_pairs(second, source, query_tokens), k).select("qid", "pid", "rank", "score")


def rerank_with_quantity(first: DataFrame, queries: DataFrame, quantities: DataFrame, k: int = 10, weight: float = 1.0, depth: int = 1000) -> DataFrame:
    """(qid, doc_id, rank, score): the best ``depth`` of a first stage (qid, doc_id, score, and rank if it is ranked already), scores divided by the largest of the query, plus ``weight``
    times the quantity score, sorted anew."""
    from quantmill.functions.numeric import kernel
    from quantmill.operators.corpus import top_k

    top = (first.where(F.col("rank") <= depth) if "rank" in first.columns else top_k(first, depth)).select("qid", "doc_id", "score")
    best = top.groupBy("qid").agg(F.max("score").alias("best"))
    norm = top.join(best, "qid").select("qid", "doc_id", F.when(F.col("best") != 0, F.col("score") / F.col("best")).otherwise(0.0).alias("score"))
    usable = queries.where("value is not null and condition is not null and unit is not null").select("qid", "condition", "value", "value2", "unit")
    v = quantities.where("value is not null").select("doc_id", F.col("unit").alias("v_unit"), F.col("value").alias("v"))
    met = norm.select("qid", "doc_id").join(usable, "qid").join(v, "doc_id").where("unit = v_unit")
    q = met.groupBy("qid", "doc_id").agg((F.sum(kernel(F.col("condition"), F.col("v"), F.col("value"), F.col("value2"))) / F.count("*")).alias("q"))
    total = norm.join(q, ["qid", "doc_id"], "left").select("qid", "doc_id", (F.col("score") + weight * F.coalesce("q", F.lit(0.0))).alias("score"))
    return top_k(total, k).select("qid", "doc_id", "rank", "score")
