"""Many weighted sets of terms scored at once. Sets and documents stand in blocks, and a task scores one block of sets on one block of documents:
of all pairs of a set and a document nothing leaves the task but a line of statistics for each set, or the k best of each query."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quantmill.operators.corpus import top_k
from quantmill.session import cut

#: Postings of a block of documents; sets and queries of a block of sets; queries of a set that stand in one row; lists of values
#: of a block; products per tile. Of idle cores each gets a block of sets with at least FEW of them.
POSTINGS, SETS, QUERIES, TOGETHER, LISTS, TILE, FEW = 1_500_000, 16_384, 100_000, 2048, 1_000_000, 1_000_000, 1024
#: Of documents in order of score, how many a filter looks at before it looks at all.
FIRST = 256
_ASKED = ("qid", "condition", "value", "value2", "unit")


def term_set(terms: Column) -> Column:
    """The distinct terms of an array with the number of times that each stands in it, in order, so that equal sets are equal arrays."""
    distinct = F.array_sort(F.array_distinct(terms))
    return F.transform(distinct, lambda t: F.struct(t.alias("term"), F.size(F.filter(terms, lambda x: x == t)).cast("double").alias("times")))


def best(score: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores; of scores that agree to nine places the larger ``doc`` goes first."""
    key = np.where(np.isnan(score), np.inf, score)
    at = np.arange(len(key))
    if len(key) > k:
        at = np.flatnonzero(key >= np.partition(key, len(key) - k)[len(key) - k] - 2e-9)
    return at[np.lexsort((doc[at], np.round(key[at], 9)))[::-1][:k]]


def best_of_each(score: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``best`` of every row of ``score``, whose columns are ``doc``: (rows, columns), best first. What is -inf is not there."""
    key = np.where(np.isnan(score), np.inf, score)
    least = np.partition(key, key.shape[1] - k, axis=1)[:, [key.shape[1] - k]] - 2e-9 if key.shape[1] > k else -np.inf
    row, at = np.nonzero((key >= least) & (key > -np.inf))
    order = np.lexsort((doc[at], np.round(key[row, at], 9), -row))[::-1]
    row, at = row[order], at[order]
    first = np.searchsorted(row, row)
    kept = np.arange(len(row)) - first < k
    return row[kept], at[kept]


def closeness(condition: str, v: np.ndarray, low: np.ndarray, high: np.ndarray, mode: str, guarded: bool) -> np.ndarray:
    """``functions.numeric.kernel`` of all queries (rows) of one condition and all values (columns)."""
    low, high = low[:, None], high[:, None]
    near = lambda x: np.exp(-np.abs(v - x))
    with np.errstate(all="ignore"):
        if condition == "=":
            return np.where((v != 0) & (low != 0), near(low), 0.0) if guarded else near(low)
        if condition == ">":
            met = ~(v <= low) & (v != 0) if guarded else ~(v <= low)
            return np.where(met, near(low) if mode == "expo" else low / v, 0.0)
        if condition == "<":
            met = (v < low) & (low != 0) if guarded else v < low
            return np.where(met, near(low) if mode == "expo" else v / low, 0.0)
        if condition == "<<":
            return np.where(np.isnan(low + high), 0.0, near((low + high) / 2.0))
    return np.zeros((len(low), len(v)))


def meets(condition: str, v: np.ndarray, low: np.ndarray, high: np.ndarray, equality: bool) -> np.ndarray:
    """``functions.numeric.satisfies`` of all queries (rows) of one condition and all values (columns)."""
    low, high = low[:, None], high[:, None]
    if condition == ">":
        return ~(v <= low) & ~np.isnan(low)
    if condition == "<":
        return v < low
    if condition == "<<":
        return (v > np.fmin(low, high)) & (v < np.fmax(low, high))
    return v == low if condition == "=" and equality else np.zeros((len(low), len(v)), bool)


@dataclass(frozen=True)
class Values:
    """Values of documents of a block: those of ``doc[i]`` are ``value`` from ``start[i]`` to ``start[i + 1]``. Of documents without any nothing is held, as a
    block has these for each of its units."""

    doc: np.ndarray
    start: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(at: np.ndarray, value: np.ndarray) -> Values:
        order = np.argsort(at, kind="stable")
        doc, start = np.unique(at[order], return_index=True)
        return Values(doc, np.append(start, len(at)), value[order])

    def take(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of ``docs`` have values, the values in that order, where each one's begin)."""
        place = np.searchsorted(self.doc, docs)
        some = np.flatnonzero(place < len(self.doc))
        some = some[self.doc[place[some]] == docs[some]]
        first = self.start[place[some]]
        n = self.start[place[some] + 1] - first
        begin = np.cumsum(n) - n
        return some, self.value[np.repeat(first - begin, n) + np.arange(n.sum())], begin


@dataclass(frozen=True)
class Asked:
    """The queries of a set."""

    qid: pa.Array
    condition: np.ndarray
    low: np.ndarray
    high: np.ndarray
    unit: np.ndarray

    def blocks(self, rows: np.ndarray, width: int) -> Iterator[tuple[str, np.ndarray]]:
        """(condition, some of ``rows`` that ask for it), about TILE products at a time."""
        step = max(1, TILE // max(1, width))
        for c in {x for x in self.condition[rows].tolist() if x is not None}:
            own = rows[self.condition[rows] == c]
            for i in range(0, len(own), step):
                yield c, own[i : i + step]


class Block:
    """Postings and values of a block of documents, which it knows by their places in ``docs``, in order."""

    def __init__(self, rows: pa.Table) -> None:
        kind, doc = (rows.column(c).to_numpy() for c in ("kind", "doc_id"))
        keys = rows.column("keys").combine_chunks()
        n, key = keys.value_lengths().to_numpy(zero_copy_only=False), keys.flatten().to_numpy(zero_copy_only=False)
        x = rows.column("xs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        units = rows.column("unit").combine_chunks().dictionary_encode(null_encoding="encode")
        self.docs = np.unique(doc[kind == 0])
        at = np.searchsorted(self.docs, doc)
        known = at < len(self.docs)
        known[known] = self.docs[at[known]] == doc[known]
        posted, valued = (np.flatnonzero(np.repeat(known & (kind == what), n)) for what in (0, 1))
        unit = np.repeat(units.indices.to_numpy(), n)[valued]
        at = np.repeat(at, n)
        self.postings = self._by(key[posted], at[posted], x[posted])
        names = units.dictionary.to_pylist()
        self.units = {names[i]: pair for i, pair in self._by(unit, at[valued], x[valued]).items()}
        self._values: dict[tuple[str | None, bool], Values] = {}
        self.score, self.hits = np.zeros(len(self.docs)), np.zeros(len(self.docs), np.int32)

    @staticmethod
    def _by(key: np.ndarray, at: np.ndarray, x: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """The (places, numbers) of every key, in order of their places."""
        order = np.argsort(at, kind="stable")
        order = order[np.argsort(key[order], kind="stable")]
        names, first = np.unique(key[order], return_index=True)
        at, x = at[order], x[order]
        return {name: (at[i:j], x[i:j]) for name, i, j in zip(names.tolist(), first, [*first[1:], len(key)])}

    def values(self, unit: str | None, every: bool = False) -> Values:
        """The values of a unit, or of all."""
        key = (unit, every)
        if key not in self._values:
            found = list(self.units.values()) if every else [self.units[unit]] if unit in self.units else []
            at, v = (np.concatenate([p[i] for p in found]) if found else np.zeros(0, (np.int64, float)[i]) for i in (0, 1))
            self._values[key] = Values.of(at, v)
        return self._values[key]

    def scored(self, terms: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the documents with any of the terms, their scores, how many of the terms they have)."""
        found = []
        for t in terms:
            if (posting := self.postings.get(t["term"])) is not None:
                self.score[posting[0]] += posting[1] * t["times"]
                self.hits[posting[0]] += 1
                found.append(posting[0])
        if sum(map(len, found)) < len(self.docs):  # the places of a term are in order, so that merging them is less than to look at all documents
            at = np.sort(np.concatenate(found), kind="stable") if found else self.docs[:0].astype(np.int64)
            at = at[np.append(True, at[1:] != at[:-1])] if len(at) and len(found) > 1 else at
        else:
            at = np.flatnonzero(self.hits)
        score, hits = self.score[at], self.hits[at]
        self.score[at], self.hits[at] = 0.0, 0
        return at, score, hits


Found = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _same(rows: np.ndarray, places: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same ``places`` for all ``rows``."""
    return np.repeat(rows, len(places)), np.tile(places, len(rows)), np.tile(score, len(rows))


def filtered(block: Block, at: np.ndarray, score: np.ndarray, full: np.ndarray, asked: Asked, k: int, fixed: bool) -> Found:
    """(queries, places, scores): documents that have all terms and numbers, but none that meets the condition, count 0."""
    rest, held = np.flatnonzero(~full), np.flatnonzero(full)
    rest = rest[best(score[rest], at[rest], k)]
    held = held[np.lexsort((at[held], np.round(score[held], 9)))[::-1]]
    left = np.arange(len(asked.condition))
    # most queries find k documents among the first, so that the others' numbers need not be looked at
    for width in (FIRST, len(held)) if len(held) > FIRST else (len(held),):
        every = width == len(held)
        some, v, begin = block.values(None, every=True).take(at[held[:width]])
        found = np.append(held[:width], rest)
        unmet = []
        step = max(1, TILE // max(1, len(found), len(v)))
        for i in range(0, len(left), step):
            rows = left[i : i + step]
            ok = np.ones((len(rows), width), bool)
            if len(some):
                ok[:, some] = False
                for c, own in asked.blocks(rows, len(v)):
                    ok[np.ix_(np.searchsorted(rows, own), some)] = np.logical_or.reduceat(meets(c, v, asked.low[own], asked.high[own], fixed), begin, axis=1)
            s = np.tile(score[found], (len(rows), 1))
            s[:, :width][~ok] = 0.0 if every else -np.inf
            n, top = best_of_each(s, at[found], k)
            s = s[n, top]
            if not every:  # k documents before those that are not looked at and those that count 0
                ahead = np.bincount(n[s > max(1e-9, score[held[width]] + 2e-9)], minlength=len(rows))
                positive = np.bincount(n[s > 1e-9], minlength=len(rows))
                sure = (ahead >= k) | (positive >= k) & (np.count_nonzero(ok, axis=1) >= k)
                unmet.append(rows[~sure])
                n, top, s = n[sure[n]], top[sure[n]], s[sure[n]]
            yield rows[n], at[found[top]], s
        left = np.concatenate(unmet) if unmet else left[:0]


def with_quantity(block: Block, at: np.ndarray, base: np.ndarray, eligible: np.ndarray, asked: Asked, usable: np.ndarray, k: int, mode: str, weight: float, guarded: bool) -> Found:
    """(queries, places, scores): ``base`` plus ``weight`` times the mean closeness of the values of the query's unit, or of all if it has none, of eligible documents."""
    ahead = best(base, at, min(len(base), 8 * k))
    rows = np.flatnonzero(~usable)
    yield _same(rows, at[ahead[:k]], base[ahead[:k]])
    rows = np.flatnonzero(usable)
    held = np.flatnonzero(eligible)
    by_unit: dict[str | None, list[int]] = {}
    for n, unit in zip(rows.tolist(), asked.unit[rows].tolist()):
        by_unit.setdefault(unit, []).append(n)
    for unit, own in by_unit.items():
        own = np.array(own)
        some, v, begin = block.values(unit, every=unit is None).take(at[held])
        some = held[some]
        other = ahead[~np.isin(ahead, some)]
        if len(other) < k < len(base) and len(ahead) < len(base):
            left = np.setdiff1d(np.arange(len(base)), some)
            other = left[best(base[left], at[left], k)]
        other = other[:k]
        if not len(some):
            yield _same(own, at[other], base[other])
            continue
        count = np.diff(np.append(begin, len(v)))
        asked_any = np.array([x is not None for x in asked.condition[own].tolist()])
        yield _same(own[~asked_any], at[ahead[:k]], base[ahead[:k]])
        found = np.append(some, other)
        distinct, of = np.unique(v, return_inverse=True)
        for c, part in asked.blocks(own, len(found) + len(v)):
            q = closeness(c, distinct, asked.low[part], asked.high[part], mode, guarded)[:, of]
            if len(v) > len(some):
                q = np.add.reduceat(q, begin, axis=1) / count
            total = np.tile(base[found], (len(part), 1))
            total[:, : len(some)] += weight * q
            n, top = best_of_each(total, at[found], k)
            yield part[n], at[found[top]], total[n, top]


class Grid:
    """Blocks of the documents of ``weights`` (term, doc_id, w) and of the distinct ``set`` of ``asked`` (qid, set, condition, value, value2, unit), a set
    being an array of (term, times). ``weights`` is a function of the terms (term) that are asked for; where the documents are at hand as rows, ``lists`` is one of
    these terms with their ``key`` that gives (doc_id, keys, xs), the keys and weights of each document that has any."""

    def __init__(self, asked: DataFrame, weights: Callable[[DataFrame], DataFrame], values: DataFrame | None = None, lists: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.asked = asked
        self.sets = cut(asked.select("set").where(F.size("set") > 0).distinct().withColumn("sid", F.monotonically_increasing_id()))
        terms = self.sets.select(F.explode("set.term").alias("term")).distinct()
        self.seed = self._apart(terms)
        if lists is None:
            weighted = weights(terms).select(self._key(F.col("term")).alias("key"), "doc_id", F.col("w").cast("double").alias("x"))
            items = weighted.groupBy("doc_id").agg(F.collect_list(F.struct("key", "x")).alias("items"))
            self.docs = cut(items.select("doc_id", F.col("items.key").alias("keys"), F.col("items.x").alias("xs")))
        else:
            self.docs = cut(lists(terms.withColumn("key", self._key(F.col("term")))))
        self.values = values
        self.postings = self.docs.agg(F.sum(F.size("keys"))).first()[0] or 0
        self.blocks = max(1, math.ceil(self.postings / POSTINGS))
        self.n_sets = self.sets.count()

    @staticmethod
    def _apart(terms: DataFrame) -> int:
        """A seed with which no two of the terms have one hash."""
        for seed in range(100):
            n, different = terms.agg(F.count("*"), F.count_distinct(F.xxhash64(F.lit(seed), "term"))).first()
            if n == different:
                return seed
        raise ValueError("terms whose hashes agree")

    def _key(self, term: Column) -> Column:
        return F.xxhash64(F.lit(self.seed), term)

    def _parts(self, rows: int, most: int) -> int:
        """Blocks of sets for so many ``rows``, of which a block holds ``most``: no more than needed, as each gets all documents, but one for every core."""
        idle = math.ceil(self.asked.sparkSession.sparkContext.defaultParallelism / self.blocks)
        return max(1, math.ceil(self.n_sets / SETS), math.ceil(rows / most), min(idle, math.ceil(self.n_sets / FEW)))

    def _nothing(self, schema: str) -> DataFrame:
        """What ``_run`` gives where no document has an asked term: nothing is sent to blocks, values of documents neither. A limit of 0 lets Spark drop all that it is joined to."""
        return self.asked.sparkSession.createDataFrame([], schema).limit(0)

    def _run(self, sets: DataFrame, parts: int, values: bool, run: Callable[[Block, pa.Table], pa.Table], schema: str) -> DataFrame:
        """``run`` on every block of documents and the rows of ``sets`` (sb, set, ...) of a block of sets."""
        nameless = F.lit(None).cast("string").alias("unit")
        rows = self.docs.select(F.lit(0).cast("byte").alias("kind"), "doc_id", "keys", "xs", nameless)
        if values and self.values is not None:
            v = self.values.where("value is not null")
            rows = rows.unionByName(v.select(F.lit(1).cast("byte").alias("kind"), "doc_id", F.array(F.lit(0).cast("bigint")).alias("keys"), F.array(F.col("value").cast("double")).alias("xs"), "unit"))
        sets = sets.withColumn("set", F.transform("set", lambda t: F.struct(self._key(t["term"]).alias("term"), t["times"].alias("times"))))
        each = sets.crossJoin(F.broadcast(sets.sparkSession.range(self.blocks).select(F.col("id").cast("int").alias("db"))))
        names = [f.split()[0] for f in schema.split(", ")]

        def cell(left: pa.Table, right: pa.Table) -> pa.Table:
            return run(Block(left), right).select(names)

        of_sets = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("of_sets")
        rows = rows.select(of_sets, F.pmod(F.xxhash64("doc_id"), F.lit(self.blocks)).cast("int").alias("of_docs"), "kind", "doc_id", "keys", "xs", "unit")
        return rows.groupBy("of_sets", "of_docs").cogroup(each.groupBy("sb", "db")).applyInArrow(cell, schema)

    def statistics(self, above: float = -math.inf) -> DataFrame:
        """(sid, hi, lo, m) of the sets that any document has a term of: largest and least score, and number of documents, of those with a score ``above``."""

        def run(block: Block, sets: pa.Table) -> pa.Table:
            out = []
            for sid, terms in zip(sets.column("sid").to_pylist(), sets.column("set").to_pylist()):
                _, score, _ = block.scored(terms)
                score = score[score > above]
                if len(score):
                    out.append((sid, float(score.max()), float(score.min()), len(score)))
            types = (pa.int64(), pa.float64(), pa.float64(), pa.int64())
            return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["sid", "hi", "lo", "m"])

        schema = "sid long, hi double, lo double, m long"
        if not self.postings:
            return self._nothing(schema)
        parts = self._parts(self.n_sets, SETS)
        sets = self.sets.withColumn("sb", F.pmod(F.xxhash64("sid"), F.lit(parts)).cast("int"))
        found = self._run(sets, parts, False, run, schema)
        return found.groupBy("sid").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.sum("m").alias("m"))

    def ranked(self, find: Callable[[Block, np.ndarray, np.ndarray, np.ndarray, dict, Asked], Found], more: DataFrame | None = None) -> DataFrame:
        """(qid, doc_id, score) that ``find`` gives for the documents of a block (places, scores, number of terms), a set (with the columns of ``more`` by sid) and its queries."""
        kinds = dict(self.asked.dtypes) | dict(self.docs.dtypes)
        schema = f"qid {kinds['qid']}, doc_id {kinds['doc_id']}, score double"
        if not self.postings:
            return self._nothing(schema)
        own = self.asked.join(self.sets, "set").select("sid", *_ASKED)
        chunks = own.groupBy("sid").agg(F.ceil(F.count("*") / TOGETHER).alias("chunks"))
        together = own.join(chunks, "sid").groupBy("sid", F.pmod(F.xxhash64("qid"), F.col("chunks")).alias("chunk")).agg(F.collect_list(F.struct(*_ASKED)).alias("asked"))
        sets = together.join(self.sets, "sid")
        if more is not None:
            sets = sets.join(more, "sid")
        parts = self._parts(self.asked.count(), QUERIES)
        sets = sets.withColumn("sb", F.pmod(F.xxhash64("sid", "chunk"), F.lit(parts)).cast("int"))
        names = [] if more is None else [c for c in more.columns if c != "sid"]

        def run(block: Block, rows: pa.Table) -> pa.Table:
            qids, docs, scores = [], [], []
            for row in rows.select(["set", *names, "asked"]).to_batches(max_chunksize=1):
                facts = {c: row.column(c)[0].as_py() for c in ("set", *names)}
                at, score, hits = block.scored(facts["set"])
                if not len(at):
                    continue
                q = row.column("asked").flatten()
                condition, low, high, unit = (q.field(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
                asked = Asked(q.field(0), condition, low.astype(float), high.astype(float), unit)
                n, places, s = (np.concatenate(x) for x in zip(*find(block, at, score, hits, facts, asked)))
                qids.append(asked.qid.take(pa.array(n.astype(np.int64))))
                docs.append(block.docs[places])
                scores.append(s)
            if not qids:
                return pa.table([pa.array([], t) for t in (rows.schema.field("asked").type.value_type.field(0).type, pa.from_numpy_dtype(block.docs.dtype) if block.docs.dtype != object else pa.string(), pa.float64())], ["qid", "doc_id", "score"])
            return pa.table([pa.chunked_array(qids), pa.array(np.concatenate(docs)), pa.array(np.concatenate(scores))], ["qid", "doc_id", "score"])

        return self._run(sets, parts, True, run, schema)


def nearest(asked: DataFrame, quantities: DataFrame, k: int, mode: str, weight: float) -> DataFrame:
    """(qid, doc_id, score): of the documents with values of the query's unit the k of the largest mean closeness, times ``weight``, if that is above 0. ``asked``
    (qid, condition, value, value2, unit). Equal queries are asked once, and of documents with equal values of a unit only the k largest are carried on."""
    kinds = dict(asked.dtypes) | dict(quantities.dtypes)
    what = ["unit", "condition", "value", "value2"]
    own = asked.select("unit").distinct()
    v = quantities.where("value is not null").join(F.broadcast(own), "unit", "left_semi")
    lists = v.groupBy("unit", "doc_id").agg(F.array_sort(F.collect_list(F.col("value").cast("double"))).alias("vs"))
    w = Window.partitionBy("unit", "vs").orderBy(F.desc("doc_id"))
    lists = cut(lists.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).groupBy("unit", "vs").agg(F.collect_list("doc_id").alias("docs")))
    leads = asked.groupBy(F.struct(*what).alias("what")).agg(F.min("qid").alias("lead"), F.collect_list("qid").alias("qids"))
    distinct = leads.select("what.*", "lead")
    blocks = max(1, math.ceil(lists.count() / LISTS))
    listed = lists.select("unit", F.pmod(F.xxhash64("vs"), F.lit(blocks)).cast("int").alias("block"), "vs", "docs")
    parts = F.broadcast(distinct.groupBy("unit").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts")))
    # every block of values of a unit meets every part of its queries
    left = listed.join(parts, "unit").select(F.col("unit").alias("of_unit"), F.col("block").alias("of_block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("of_part"), "vs", "docs")
    right = distinct.join(parts, "unit").withColumn("part", F.pmod(F.xxhash64(*what), F.col("parts")).cast("int")).drop("parts")
    right = right.crossJoin(F.broadcast(asked.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"))))

    def run(values: pa.Table, queries: pa.Table) -> pa.Table:
        docs, scores, leads = [], [], []
        if values.num_rows and queries.num_rows:
            values = values.combine_chunks()
            vs, ids = values.column("vs").combine_chunks(), values.column("docs").combine_chunks()
            n, v, doc = vs.value_lengths().to_numpy(), vs.flatten().to_numpy(), ids.flatten().to_numpy(zero_copy_only=False)
            many = ids.value_lengths().to_numpy()
            held = np.cumsum(many) - many
            begin = np.cumsum(n) - n
            columns = {c: queries.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("condition", "value", "value2")}
            lead = queries.column("lead").combine_chunks()
            q = Asked(lead, columns["condition"], columns["value"].astype(float), columns["value2"].astype(float), columns["condition"])
            first = doc[held + _largest(doc, held, many)]
            for c, rows in q.blocks(np.arange(len(lead)), len(v)):
                score = weight * np.add.reduceat(closeness(c, v, q.low[rows], q.high[rows], mode, True), begin, axis=1) / n
                for r, row in zip(rows, score):
                    some = np.flatnonzero(row > 0)
                    some = some[best(row[some], first[some], k)]  # k lists hold the k best documents
                    at = np.repeat(held[some] - np.cumsum(many[some]) + many[some], many[some]) + np.arange(many[some].sum())
                    s = np.repeat(row[some], many[some])
                    top = best(s, doc[at], k)
                    leads.append(np.full(len(top), r))
                    docs.append(doc[at[top]])
                    scores.append(s[top])
        place = np.concatenate(leads).astype(np.int64) if leads else np.zeros(0, np.int64)
        lead = queries.column("lead").combine_chunks()
        ids = pa.array(np.concatenate(docs)) if docs else pa.array([], values.schema.field("docs").type.value_type)
        return pa.table([lead.take(pa.array(place)), ids, pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["lead", "doc_id", "score"])

    found = left.groupBy("of_unit", "of_block", "of_part").cogroup(right.groupBy("unit", "block", "part")).applyInArrow(run, f"lead {kinds['qid']}, doc_id {kinds['doc_id']}, score double")
    return leads.join(top_k(found, k, "lead"), "lead").select(F.explode("qids").alias("qid"), "doc_id", "score")


def _largest(doc: np.ndarray, held: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The place within each run of ``doc`` of its largest."""
    run = np.repeat(np.arange(len(held)), many)
    order = np.lexsort((doc, run))
    return order[held + many - 1] - held
