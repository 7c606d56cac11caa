"""Rankings in blocks: what is written, and that the blocks do not change the result."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantmill.functions.numeric import kernel
from quantmill.operators import cells, lexical
from quantmill.operators.corpus import top_k
from quantmill.operators.lexical import LexicalIndex
from quantmill.operators.sparse import SparseIndex

WORDS = [f"w{i}" for i in range(12)]
QUERY = "qid int, terms array<string>, condition string, value double, value2 double, unit string"


@pytest.fixture(scope="module")
def tables(spark):
    """60 documents that have two words of every three that are asked for, and 66 sets of words."""
    docs = spark.createDataFrame([(i, [w for j, w in enumerate(WORDS) if (i + j) % 3] + ["x"] * (i % 4)) for i in range(60)], "doc_id long, terms array<string>")
    values = spark.createDataFrame([(i, u, float(i % 7 + j)) for i in range(60) for j, u in enumerate(("usd", "eur", None, "usd")[: i % 5])], "doc_id long, unit string, value double")
    conditions = [(">", 3.0, None), ("<", 4.0, None), ("=", 3.0, None), ("<<", 5.0, 2.0), (">", None, None), (None, 3.0, None), ("<", 0.0, None)]
    rows = [(i, list(pair), *conditions[i % 7], ("usd", "eur", None, "yen")[i % 4]) for i, pair in enumerate(itertools.combinations(WORDS, 2))]
    rows += [(100 + i, ["unknown"], *conditions[i % 7], "usd") for i in range(7)] + [(200, [], ">", 3.0, None, "usd"), (201, WORDS[:2] * 2, ">", 3.0, None, "usd")]
    return docs, values, spark.createDataFrame(rows, QUERY)


def ranking(df):
    return sorted((r.qid, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())


def blocked(monkeypatch):
    for name, size in (("POSTINGS", 100), ("SETS", 20), ("QUERIES", 30), ("TOGETHER", 2), ("LISTS", 5)):
        monkeypatch.setattr(cells, name, size)


@pytest.mark.parametrize("numeric", ["filter", "ratio", "expo"])
def test_nothing_is_written_for_a_set_and_a_document(spark, tables, monkeypatch, numeric):
    docs, values, asked = tables
    written = []

    def counted(df, own=lexical.cut):
        out = own(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(lexical, "cut", counted)
    monkeypatch.setattr(cells, "cut", counted)
    index = LexicalIndex.build(docs, values)
    index.rank(asked, 5, numeric=numeric).collect()
    assert max(written) <= index.postings.count() < 66 * 40


@pytest.mark.parametrize("options", [{"numeric": "filter"}, {"numeric": "filter", "fixed": True}, {"numeric": "ratio"}, {"numeric": "expo"}])
def test_blocks_do_not_change_a_ranking(spark, tables, monkeypatch, options):
    docs, values, asked = tables
    index = LexicalIndex.build(docs, values)
    want = ranking(index.rank(asked, 5, **options))
    blocked(monkeypatch)
    assert ranking(index.rank(asked, 5, **options)) == want and {q for q, *_ in want} >= set(range(66))


def test_filter_equals_scores_of_all_pairs(spark, tables):
    docs, values, asked = tables
    index = LexicalIndex.build(docs, values)
    numbers = {}
    for r in values.where("value is not null").collect():
        numbers.setdefault(r.doc_id, []).append(r.value)
    ask = {r.qid: r for r in asked.collect()}
    met = {">": lambda v, r: v > r.value, "<": lambda v, r: v < r.value, "<<": lambda v, r: min(r.value, r.value2) < v < max(r.value, r.value2)}
    want = {}
    for r in index.score(asked).collect():
        q = ask[r.qid]
        fails = r.matched == r.wanted and r.doc_id in numbers and not any(q.value is not None and q.condition in met and met[q.condition](v, q) for v in numbers[r.doc_id])
        want.setdefault(r.qid, []).append((0.0 if fails else round(r.score, 9), r.doc_id))
    want = sorted((q, n + 1, d, s) for q, rows in want.items() for n, (s, d) in enumerate(sorted(rows, reverse=True)[:5]))
    assert ranking(index.rank(asked, 5, numeric="filter")) == want


def test_sparse_ranking_in_blocks(spark, tables, monkeypatch):
    """Against the ranking of all pairs, with sets that more than three quarters of the documents match, whose gate is a match."""
    docs, values, asked = tables
    weights = docs.select("doc_id", F.explode("terms").alias("term")).groupBy("doc_id", "term").agg((F.count("*") + F.col("doc_id") % 5).cast("double").alias("w"))
    index = SparseIndex.build(weights, docs, values)
    asked = asked.where("condition is null or condition <> '>' or value is not null")
    q = asked.select("qid", F.explode(F.array_distinct("terms")).alias("term"), F.lit(1.0).alias("qw"))
    dots = index.dot(q)
    norm = index.normalised(dots).join(index.gate(dots), "qid")
    assert norm.where("gate > 0").count() and norm.where("gate = 0").count()
    usable = asked.where("value is not null and condition is not null and unit is not null").select("qid", "condition", "value", "value2", "unit")
    v = values.where("value is not null and value <> 0").select("doc_id", F.col("unit").alias("u"), F.col("value").alias("v"))
    close = kernel(F.col("condition"), F.col("v"), F.col("value"), F.nullif(F.col("value2"), F.lit(0.0)), "ratio", guarded=True)
    met = norm.where("norm > gate").select("qid", "doc_id").join(usable.where("value <> 0"), "qid").join(v, "doc_id").where("u = unit").groupBy("qid", "doc_id").agg((F.sum(close) / F.count("*")).alias("q"))
    want = ranking(top_k(norm.join(met, ["qid", "doc_id"], "left").select("qid", "doc_id", (F.col("norm") + F.coalesce("q", F.lit(0.0))).alias("score")).where("score > 0"), 5))
    kept = values.where("value is not null and value <> 0")
    own = SparseIndex(index.postings, index.n_docs, kept)
    asked = asked.where("value <> 0 or value is null")
    want = [r for r in want if r[0] in {x.qid for x in asked.collect()}]
    q = q.join(asked.select("qid"), "qid", "left_semi")
    blocked(monkeypatch)
    written = []
    monkeypatch.setattr(cells, "cut", lambda df, own=cells.cut: written.append(own(df)) or written[-1])
    assert ranking(own.rank(asked, q, 5, numeric=True)) == want
    assert max(df.count() for df in written) <= index.postings.count()


def test_units_hold_their_own_values_only():
    """Of 200 units with one value each a block holds no list of all 200 documents."""
    n = 200
    kinds = pa.array([0] * n + [1] * n, pa.int8())
    docs = pa.array([*range(n), *range(n)], pa.int64())
    rows = pa.table({"kind": kinds, "doc_id": docs, "keys": pa.array([[7]] * 2 * n, pa.list_(pa.int64())), "xs": pa.array([[float(i)] for i in range(2 * n)]), "unit": pa.array([None] * n + [f"u{i}" for i in range(n)], pa.string())})
    block = cells.Block(rows)
    for i in range(n):
        some, v, begin = block.values(f"u{i}").take(np.array([i - 1, i, i + 1]).clip(0, n - 1))
        assert (n + i in v) and len(v) == len(some) == len(begin)
    assert sum(x.size for held in block._values.values() for x in vars(held).values()) < 5 * n
    assert len(block.values("other").take(np.arange(n))[0]) == 0 and len(block.values(None, every=True).take(np.arange(n))[0]) == n


def test_tokens_are_not_shuffled_to_meet_units(spark):
    docs = spark.createDataFrame([(1, ["usd", "a", "a"]), (2, ["b"]), (3, [])], "doc_id long, terms array<string>").repartition(3, "doc_id")
    values = spark.createDataFrame([(1, "usd", 1.0), (1, "eur", 2.0), (1, "eur", 3.0), (2, None, 4.0), (3, "usd", 5.0), (4, "usd", 5.0)], "doc_id long, unit string, value double").repartition(3, "doc_id")
    postings = LexicalIndex.build(docs, values, unit_terms=True, binary=True).postings
    assert sorted((r.doc_id, r.term, r.tf) for r in postings.collect()) == [(1, "a", 1), (1, "eur", 1), (1, "usd", 1), (2, "b", 1), (3, "usd", 1), (4, "usd", 1)]
    assert not re.search(r"hashpartitioning\(doc_id#\d+L?, term#", postings._jdf.queryExecution().executedPlan().toString())


def test_documents_are_sent_to_as_few_blocks_of_sets_as_hold_the_queries(spark, tables):
    docs, values, asked = tables
    grid = cells.Grid(asked.withColumn("set", cells.term_set(F.col("terms"))), lambda terms: LexicalIndex.build(docs, values).weights(terms=terms), values)
    assert grid.docs.count() == docs.count() and grid.blocks == 1
    grid.blocks, grid.n_sets = 100, 4000
    assert grid._parts(200_000, cells.QUERIES) == 2


def random_block(rng, n):
    """A block of ``n`` documents with one word, some of them with values of two units, and queries on them."""
    docs = [(0, i, [7], [0.0], None) for i in range(n)] + [(1, int(i), [0], [float(rng.integers(1, 9))], u) for u in ("usd", "eur") for i in rng.integers(0, n, n)]
    types = (pa.int8(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.string())
    block = cells.Block(pa.table([pa.array([d[i] for d in docs], t) for i, t in enumerate(types)], ["kind", "doc_id", "keys", "xs", "unit"]))
    m = 60
    condition = np.array([("<", ">", "=", "<<", None)[i % 5] for i in range(m)], object)
    low, high = rng.integers(0, 10, m).astype(float), rng.integers(1, 9, m).astype(float)
    low[::11] = np.nan
    return block, cells.Asked(pa.array(range(m)), condition, low, high, np.array([("usd", "eur", None, "yen")[i % 4] for i in range(m)], object))


def listed(found):
    n, places, score = (np.concatenate(x) for x in zip(*found))
    return {q: [(int(d), round(float(s), 9)) for d, s in zip(places[n == q], score[n == q])] for q in set(n.tolist())}


@pytest.mark.parametrize("first, fixed, low", [(3, True, 0.0), (3, False, -0.4), (40, True, -1.0), (10_000, True, 0.0)])
def test_filter_of_the_first_documents_is_that_of_all(monkeypatch, first, fixed, low):
    monkeypatch.setattr(cells, "FIRST", first)
    rng = np.random.default_rng(first)
    block, asked = random_block(rng, 300)
    at = np.sort(rng.choice(300, 200, replace=False))
    score, full = np.round(rng.uniform(low, 1, 200), 1), rng.random(200) < 0.8
    values = {d: np.concatenate([v[p == d] for p, v in block.units.values()]) for d in at.tolist()}
    want = {}
    for n in range(60):
        met = [cells.meets(asked.condition[n], values[d][None, :], asked.low[[n]], asked.high[[n]], fixed).any() for d in at.tolist()]
        s = np.array([0.0 if f and len(values[d]) and not m else x for f, d, m, x in zip(full, at.tolist(), met, score)])
        top = cells.best(s, at, 5)
        want[n] = list(zip(at[top].tolist(), np.round(s[top], 9).tolist()))
    assert listed(cells.filtered(block, at, score, full, asked, 5, fixed)) == want


@pytest.mark.parametrize("options", [{}, {"unit_terms": True, "binary": True}])
def test_documents_are_analysed_twice(spark, tables, options):
    """For the statistics and for the weights."""
    docs, values, asked = tables
    read = spark.sparkContext.accumulator(0)

    def count(rows):
        for batch in rows:
            read.add(batch.num_rows)
            yield batch

    index = LexicalIndex.build(docs.mapInArrow(count, docs.schema), values, **options)
    index.rank(asked, 5, numeric="filter").collect()
    assert read.value <= 2 * docs.count()


@pytest.mark.parametrize("options", [{}, {"unit_terms": True, "binary": True}, {"binary": True}])
def test_lists_hold_the_weights(spark, tables, options):
    docs, values, _ = tables
    more = spark.createDataFrame([(99, "w1", 1.0), (99, "eur", 2.0)], "doc_id long, unit string, value double")
    index = LexicalIndex.build(docs.unionByName(spark.createDataFrame([(98, ["w1", "w1", "usd"]), (97, [])], docs.schema)), values.unionByName(more), **options)
    terms = spark.createDataFrame([(w, i) for i, w in enumerate(["w1", "w2", "x", "usd", "nowhere"])], "term string, key long")
    want = sorted((r.doc_id, r.key, round(r.w, 12)) for r in index.weights(terms=terms.select("term")).join(terms, "term").collect())
    got = sorted((r.doc_id, k, round(x, 12)) for r in index.lists(terms).collect() for k, x in zip(r["keys"], r.xs))
    assert got == want and len(want) > 100 and not index.lists(terms.where("key = 4")).count()


def test_places_of_a_term_are_in_order():
    """However the documents arrive, so that those of a set are merged, and not looked for among all of the block."""
    rng = np.random.default_rng(1)
    ids = rng.permutation(500)
    keys = [sorted(rng.choice(6, 2, replace=False).tolist()) for _ in ids]
    rows = pa.table({"kind": pa.array([0] * 500, pa.int8()), "doc_id": pa.array(ids), "keys": pa.array(keys, pa.list_(pa.int64())), "xs": pa.array([[1.0, 2.0]] * 500), "unit": pa.array([None] * 500, pa.string())})
    block = cells.Block(rows)
    assert len(block.postings) == 6 and all((np.diff(p) > 0).all() for p, _ in block.postings.values())
    own = {d: dict(zip(k, (1.0, 2.0))) for d, k in zip(ids.tolist(), keys)}
    for asked in ([0], [1, 2], [0, 1, 2, 3, 4, 5], [9], [9, 3]):
        at, score, hits = block.scored([{"term": t, "times": 1.0 + t} for t in asked])
        want = {d: (sum(x[t] * (1 + t) for t in asked if t in x), sum(t in x for t in asked)) for d, x in own.items() if any(t in x for t in asked)}
        assert {d: (s, h) for d, s, h in zip(at.tolist(), score.tolist(), hits.tolist())} == want and (np.diff(at) > 0).all()


def test_terms_are_counted_within_a_document(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b", "c", "b", "a"]), (2, ["c"]), (3, []), (4, ["a", None, "a", None, "d"])], "doc_id long, terms array<string>")
    postings = LexicalIndex.build(docs).postings
    assert {(r.doc_id, r.term, r.tf) for r in postings.collect()} == {(1, "a", 2), (1, "b", 3), (1, "c", 1), (2, "c", 1), (4, None, 2), (4, "a", 2), (4, "d", 1)}
    assert postings.count() == 7 and dict(postings.dtypes)["tf"] == "bigint"
    assert not re.search("Aggregate|Exchange", postings._jdf.queryExecution().executedPlan().toString())


def test_a_stored_index_shuffles_no_posting_by_its_term(spark, tables, tmp_path):
    docs, values, asked = tables
    index = LexicalIndex.build(docs, values).save(str(tmp_path / "index"))
    terms = spark.createDataFrame([("w1",), ("x",)], "term string")
    plan = index._asked_weights(terms, 1.5, 0.75)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(term#", plan)
    key = lambda df: sorted((r.term, r.doc_id, round(r.w, 12)) for r in df.collect())
    assert key(index._asked_weights(terms, 1.5, 0.75)) == key(LexicalIndex.build(docs, values).weights(terms=terms)) != []
    assert ranking(index.rank(asked, 5, numeric="filter")) == ranking(LexicalIndex.build(docs, values).rank(asked, 5, numeric="filter"))


def test_documents_are_analysed_once_where_no_term_is_known(spark, tables):
    docs, values, asked = tables
    read = spark.sparkContext.accumulator(0)

    def count(rows):
        for batch in rows:
            read.add(batch.num_rows)
            yield batch

    unknown = asked.withColumn("terms", F.transform("terms", lambda t: F.concat(F.lit("zq"), t)))
    index = LexicalIndex.build(docs.mapInArrow(count, docs.schema), values, unit_terms=True, binary=True)
    got = ranking(index.rank(unknown, 5, numeric="ratio"))
    assert got and read.value <= docs.count()


@pytest.mark.parametrize("numeric", ["filter", "ratio", "expo"])
def test_no_value_is_sent_to_a_block_where_no_term_is_known(spark, tables, monkeypatch, numeric):
    docs, values, asked = tables
    blocked(monkeypatch)
    index = LexicalIndex.build(docs, values, unit_terms=True, binary=True)
    lost = index.rank(asked.where("qid between 100 and 106"), 5, numeric=numeric)
    assert "of_sets" not in lost._jdf.queryExecution().optimizedPlan().toString()
    # as where other queries have terms that are known
    among = [r for r in ranking(index.rank(asked, 5, numeric=numeric)) if 100 <= r[0] <= 106]
    assert ranking(lost) == among and bool(among) == (numeric != "filter")


def test_texts_are_not_analysed_for_terms_that_no_record_has(spark, tables):
    docs, values, asked = tables
    read = spark.sparkContext.accumulator(0)

    def count(rows):
        for batch in rows:
            read.add(batch.num_rows)
            yield batch

    # words of replaced records may be among them
    words = docs.select(F.explode("terms").alias("term")).unionByName(values.select(F.col("unit").alias("term"))).unionByName(spark.createDataFrame([("replaced",)], "term string"))
    index = LexicalIndex.build(docs.mapInArrow(count, docs.schema), values, unit_terms=True, binary=True, words=words)
    plain = LexicalIndex.build(docs, values, unit_terms=True, binary=True)
    unknown = asked.withColumn("terms", F.transform("terms", lambda t: F.concat(F.lit("zq"), t)))
    assert ranking(index.rank(unknown, 5, numeric="ratio")) == ranking(plain.rank(unknown, 5, numeric="ratio")) != [] and read.value == 0
    some = unknown.withColumn("terms", F.when(F.col("qid") == 0, F.array(F.lit("replaced"))).otherwise(F.col("terms")))
    for own in (asked, some, some.where("qid = 0")):
        assert ranking(index.rank(own, 5, numeric="ratio")) == ranking(plain.rank(own, 5, numeric="ratio")) != []
    assert read.value > 0
