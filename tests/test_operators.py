import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from quantmill.functions import encoders, numeric as N, text as T, vectors as V
from quantmill.functions.unit_text import FOREIGN, MISSING, Lexicon, align
from quantmill.operators import evaluate as E, generate as G, late, quantities as Qn
from quantmill.operators.components import connected_components
from quantmill.operators.lexical import LexicalIndex
from quantmill.operators.sparse import SparseIndex

# --- lexical ranking on five documents, with values computed by hand ----------------------------------------------

DOCS = [(0, "iphon sale rise"), (1, "iphon sale fall"), (2, "oil price rise"), (3, "iphon launch"), (4, "bank profit")]
VALUES = [(0, "usd", 20.0), (0, "percent", 5.0), (1, "usd", 50.0), (2, "usd", 100.0), (2, "usd", 80.0), (4, "usd", 7.0)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").select("doc_id", T.simple_tokens(F.col("text")).alias("terms"))
    return docs, spark.createDataFrame(VALUES, "doc_id long, unit string, value double")


def asked(spark, condition, value, value2=None, unit="usd", terms=("iphon", "sale")):
    return spark.createDataFrame([(1, list(terms), condition, value, value2, unit)], "qid int, terms array<string>, condition string, value double, value2 double, unit string")


def scores(df):
    return {r.doc_id: round(r.score, 6) for r in df.collect()}


def test_idf_is_floored(spark, tables):
    docs, values = tables
    idf = {r.term: r for r in LexicalIndex.build(docs, values, unit_terms=True, value_terms=True).idf.collect()}
    assert len(idf) == 17
    assert round(idf["iphon"].idf, 6) == 0.198821 and round(idf["iphon"].raw, 6) == -0.336472 and round(idf["sale"].idf, 6) == 0.336472 and round(idf["usd"].raw, 6) == -1.098612
    binary = {r.term: r.idf for r in LexicalIndex.build(docs, values, unit_terms=True, binary=True).idf.collect()}
    assert len(binary) == 11 and round(binary["iphon"], 6) == 0.157458


def test_bm25_and_filters(spark, tables):
    index = LexicalIndex.build(*tables, unit_terms=True, value_terms=True)
    assert scores(index.rank(asked(spark, ">", 30.0))) == {0: 0.500634, 1: 0.500634, 3: 0.22186}
    assert scores(index.rank(asked(spark, ">", 30.0), numeric="filter")) == {0: 0.0, 1: 0.500634, 3: 0.22186}
    assert scores(index.rank(asked(spark, "=", 20.0), numeric="filter")) == {0: 0.0, 1: 0.0, 3: 0.22186}
    assert scores(index.rank(asked(spark, "=", 20.0), numeric="filter", fixed=True)) == {0: 0.500634, 1: 0.0, 3: 0.22186}


@pytest.mark.parametrize(
    ("mode", "condition", "low", "high", "want"),
    [
        ("ratio", ">", 30.0, None, {0: 1.0, 1: 2.2, 3: 0.380354}),
        ("ratio", "<", 30.0, None, {0: 2.333333, 1: 1.0, 3: 0.380354}),
        ("ratio", "=", 20.0, None, {0: 3.0, 1: 1.0, 3: 0.380354}),
        ("ratio", "<<", 40.0, 60.0, {0: 1.0, 1: 3.0, 3: 0.380354}),
        ("expo", ">", 49.0, None, {0: 1.0, 1: 1.735759, 3: 0.380354}),
    ],
)
def test_quantity_bm25(spark, tables, mode, condition, low, high, want):
    index = LexicalIndex.build(*tables, unit_terms=True, binary=True)
    assert scores(index.rank(asked(spark, condition, low, high), numeric=mode)) == want


def test_unknown_words_rank_by_quantity(spark, tables):
    index = LexicalIndex.build(*tables, unit_terms=True, binary=True)
    assert scores(index.rank(asked(spark, ">", 30.0, terms=("nowhere",)), numeric="ratio")) == {1: 1.2, 2: 0.675}


def test_kernels(spark):
    df = spark.createDataFrame([(100.0,), (80.0,)], "v double")
    total = lambda mode, c: df.select(F.avg(N.kernel(F.lit(c), F.col("v"), F.lit(90.0), None, mode))).first()[0]
    assert round(total("ratio", ">"), 6) == 0.45 and round(total("ratio", "<"), 6) == 0.444444 and abs(total("expo", ">") - 0.0000226999) < 1e-9
    with pytest.raises(ValueError):
        N.kernel(F.lit("="), F.col("v"), F.lit(1.0), None, "other")


def test_sparse_gate_counts_missing_documents(spark):
    weights = spark.createDataFrame([(i, "t", float(i)) for i in range(1, 5)], "doc_id long, term string, w double")
    docs = spark.range(8).withColumnRenamed("id", "doc_id")
    index = SparseIndex.build(weights, docs)
    dots = index.dot(spark.createDataFrame([(1, "t", 2.0)], "qid int, term string, qw double"))
    dense = np.array([0, 0, 0, 0, 2, 4, 6, 8.0]) / 8
    for q in (0.25, 0.5, 0.6, 0.9):
        assert abs(index.gate(dots, q).first().gate - np.quantile(dense, q)) < 1e-12


# --- evaluation --------------------------------------------------------------------------------------------------


def test_metrics(spark):
    run = spark.createDataFrame([("1", "a", 3.0), ("1", "b", 2.0), ("1", "c", 1.0), ("1", "d", 0.5), ("1", "d", math.nan), ("1", "e", None), ("1", "a", 1.0)], "qid string, doc_id string, score double")
    qrel = spark.createDataFrame([("s", "1", "b", 1), ("s", "1", "c", 1), ("s", "1", "z", 1), ("s", "1", "z", 1), ("s", "2", "a", 1)], "split string, qid string, doc_id string, rel int")
    got = {r.metric: (round(r.value, 6), r.queries) for r in E.evaluate(run, qrel).collect()}
    assert got == {"MRR@10": (0.5, 1), "P@10": (0.2, 1), "recall@10": (0.666667, 1), "ndcg_cut@10": (0.530721, 1)}
    assert [r.doc_id for r in E.truncate_run(run, 2).orderBy("rank").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        E.parse_metric("map@10")


def test_permutation_test(spark):
    rng = np.random.default_rng(1)
    a = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.random(60))], "qid int, v double")
    same = E.permutation_test(a, a, 200).first()
    assert same.p == 1.0 and same.delta == 0.0
    better = E.permutation_test(a, a.withColumn("v", F.col("v") + 0.5), 200).first()
    assert better.p == pytest.approx(1 / 201) and better.delta == pytest.approx(0.5)


# --- late interaction --------------------------------------------------------------------------------------------


def test_maxsim(spark):
    tokens = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.6, 0.8]), (1, [-1.0, -1.0])], "pid long, vec array<double>")
    q = spark.createDataFrame([(7, 0, [1.0, 0.0]), (7, 1, [0.0, 1.0])], "qid long, qtok int, vec array<double>")
    assert {r.pid: round(r.score, 9) for r in late.maxsim(tokens, q).collect()} == {0: 1.8, 1: -2.0}
    assert {r.pid: round(r.score, 9) for r in late.maxsim(tokens, q, clamp_zero=True).collect()} == {0: 1.8, 1: 0.0}
    assert late.maxsim(tokens, q.where("false")).count() == 0 and late.maxsim(tokens.where("false"), q).count() == 0


def test_codec_and_search(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tokens = spark.createDataFrame([(i // 4, i % 4, [float(v) for v in row]) for i, row in enumerate(x)], "pid long, tok int, vec array<double>")
    index = late.LateIndex.build(tokens, late.kmeans_centroids(tokens, 8), bits=4)
    near = index.decoded().withColumnRenamed("vec", "y").join(tokens, ["pid", "tok"]).select(F.min(V.dot(F.col("vec"), F.col("y")))).first()[0]
    assert near > 0.9
    q = tokens.where("pid % 20 = 0").select(F.col("pid").alias("qid"), F.col("tok").alias("qtok"), "vec")
    got = index.search(q, 3, late.SearchKnobs(8, -1.0, 1000)).collect()
    assert all(r.pid == r.qid for r in got if r["rank"] == 1) and len(got) == 15
    assert index.search(q, 3, keep=F.col("pid") > 50).where("pid <= 50").count() == 0


def test_fixed_buckets_and_bits(spark):
    cutoffs = [-0.1, 0.0, 0.1]
    df = spark.createDataFrame([([-0.2, -0.1, 0.05, 0.3],)], "r array<double>").select(F.transform("r", lambda x: V.bucket(x, cutoffs)).alias("b"))
    assert df.first().b == [0, 0, 2, 3]
    packed = df.select("b", V.pack_bits(F.col("b"), 2).alias("p"))
    assert packed.select(V.unpack_bits(F.col("p"), 2, 4)).first()[0] == [0, 0, 2, 3]


def test_index_plan():
    assert late.plan_index(1000, 100.0) == {"sampled": 1000, "centroids": 4096, "held_out": 50_000}
    assert late.SearchKnobs.for_k(10).ncells == 1 and late.SearchKnobs.for_k(100).ndocs == 1024 and late.SearchKnobs.for_k(2000).ndocs == 8000


def test_encoders(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "c")], "pid long, text string")
    tokens = encoders.encode_tokens(docs, encoders.HashEncoder(4))
    assert {(r.pid, r.tok) for r in tokens.collect()} == {(1, 0), (1, 1), (1, 2), (4, 0)}
    assert encoders.pool(tokens, "cls").count() == 2
    asked = []
    answers = encoders.complete(spark.createDataFrame([("x",), ("x",), (None,)], "concept string"), lambda xs: [x + "!" for x in xs])
    assert [tuple(r) for r in answers.collect()] == [("x", "x!")] and not asked


# --- text and generation -----------------------------------------------------------------------------------------


def test_stems():
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "rational": "ration", "adoption": "adopt", "controlling": "control", "rate": "rate", "sky": "sky"}
    assert {w: T.porter(w) for w in want} == want


def test_spans(spark):
    df = spark.createDataFrame([("sales of 20 percent",)], "s string").select("s", F.struct(F.lit(9).alias("start"), F.lit(11).alias("end")).alias("v"), F.struct(F.lit(12).alias("start"), F.lit(19).alias("end")).alias("u"))
    r = df.select(T.splice(F.col("s"), F.col("v"), F.lit("35")), T.splice(F.col("s"), F.col("u"), F.lit("pct")), T.mask(F.col("s"), F.array("v"))).first()
    assert tuple(r) == ("sales of 35 percent", "sales of 20 pct", "sales of [MASK] percent")


def test_pivots(spark):
    rows = [("k", "u", v, f"s{v}{i}") for v, n in {1.0: 2, 5.0: 1, 9.0: 3, 12.0: 1}.items() for i in range(n)]
    p = G.pivots(spark.createDataFrame(rows, "keyword string, unit string, value double, sentence string")).first()
    assert (p.equal, p.equal2, p.less, p.less2, p.greater, p.greater2) == (9.0, 1.0, 9.0, 9.0, 1.0, 1.0)


def test_ids_are_dense_whatever_the_partitions(spark):
    df = spark.range(1000).select(F.col("id").alias("x"))
    for n in (1, 7):
        got = G.with_ids(df.repartition(n), "n", ["x"]).collect()
        assert sorted((r.x, r.n) for r in got) == [(i, i) for i in range(1000)]


def test_generated_tables_agree(spark):
    index = G.concept_index(spark.read.parquet(f"{SMALL}/train_concepts_units_extended.parquet"))
    t = G.training_tables(index, 2)
    ids = {r.passage_id for r in t["collection"].collect()}
    assert ids == set(range(len(ids)))
    assert {r.passage_id for r in t["qrel"].collect()} == ids
    assert {r.query_id for r in t["qrel"].collect()} <= {r.query_id for r in t["queries"].collect()}


def test_numbers(spark):
    df = spark.createDataFrame([(20.0,), (1234567.0,), (2.5e7,), (0.5,), (1500.0,)], "v double")
    v = F.col("v")
    assert [r[0] for r in df.select(N.value_text(v)).collect()] == ["20.0", "1234567.0", "25000000.0", "0.5", "1500.0"]
    assert [r[0] for r in df.select(N.alternate_number(v, F.lit(False))).collect()] == ["20", "1234567", "25 million", "0.5", "1.5 thousand"]
    assert [r[0] for r in df.select(N.alternate_number(v, F.lit(True))).collect()] == ["20", "1,234,567", "25,000,000", "0.5", "1,500"]


# --- components --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in list(root)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- quantities in common units ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def lexicon(spark):
    return Lexicon.of([r.asDict() for r in spark.read.parquet(f"{SMALL}/unit_ref.parquet").collect()])


@pytest.mark.parametrize(
    ("text", "unit", "scale"),
    [
        ("usd", "usd", 1), (" [US Dollars] ", "usd", 1), ("in ft", "foot", 1), ("€ (bln)", "eur", 1e9), ("usd, '000", "usd", 1e3), ("THOUSAND TONNE", "tonne", 1e3), ("crore of ₹", "inr", 1e7),
        ("metric_tons", "tonne", 1), ("centimerte", "centimetre", 1), ("poundspersquareinch", "psi", 1), ("ruupees", "inr", 1), ("pct\xa0", "percent", 1), ("us cetns", "us cent", 1), ("pound", "pound", 1),
    ],
)
def test_unit_entries(lexicon, text, unit, scale):
    k, s = lexicon.entry(text)
    assert lexicon.names[k] == unit and s == scale


def test_entries_that_are_no_unit(lexicon):
    assert [lexicon.entry(x)[0] for x in (None, "", " ", "-")] == [MISSING] * 4
    assert [lexicon.entry(x)[0] for x in ("cartridges", "n/a", "million", "xxxx", "hospital beds")] == [FOREIGN] * 5


@pytest.mark.parametrize(
    ("sentence", "values", "units", "want"),
    [
        ("sales of usd 4 million in may", [4e6], ["-"], [("usd", 1)]),
        ("sales of usd 4 million in may", [4.0], ["usd"], [("usd", 1e6)]),
        ("eur 250 billion were lost", [250.0], ["€ (bln)"], [("eur", 1e9)]),
        ("in dollars million: the base of 30 fell", [30.0], ["us dollar"], [("usd", 1e6)]),
        ("amounts in thousand of euro: 18 in revenue", [18.0], [None], [("eur", 1e3)]),
        ("on 3 may, rate of 4 pct and 3 bps", [4.0, 3.0], ["", None], [("percent", 1), ("basis point", 1)]),
        ("€twelve for 6 457 yen", [12.0, 6457.0], [], [("eur", 1), ("jpy", 1)]),
        ("fivemg of it", [5.0], ["mg"], [("milligram", 1)]),
        ("sales of 1.5 k barrels note mn-28574 usd 2", [1500.0, 2.0], [None, None], [("barrel", 1), ("usd", 1)]),
        ("us$22.63 billions", [22.63], ["dollars"], [("usd", 1e9)]),
        (None, [3.0], ["mn eur"], [(None, 1e6)]),
        ("no number at all", [3.0], [None], [(None, 1)]),
    ],
)
def test_sentences(lexicon, sentence, values, units, want):
    entries = [lexicon.entry(u) for u in units] + [(MISSING, 1.0)] * (len(values) - len(units))
    got = align(lexicon.read(sentence), values, entries)
    assert [(lexicon.names[g.unit] if g.unit >= 0 else None, g.missing_scale) for g in got] == want


def collection(spark, rows):
    t0 = dt.datetime(2030, 1, 1)
    full = [(r[0], r[1], r[2], r[3], r[4] if len(r) > 4 else "a", t0 + dt.timedelta(hours=r[5] if len(r) > 5 else 0), 1, "x") for r in rows]
    return spark.createDataFrame(full, "doc_id long, sentence string, values array<double>, units array<string>, source string, ingested_at timestamp, pos int, unit string")


#: Added to the ids of the rows of a test, which stand beside those of the small table, as a classifier needs labelled quantities.
FAR = 10**9


def harmonise(spark, rows, trained=True):
    refs = [spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("unit_ref", "concept_ref")]
    own = collection(spark, [(r[0] + FAR, *r[1:]) for r in rows])
    if trained:
        own = own.unionByName(spark.read.parquet(f"{SMALL}/collection.parquet"), allowMissingColumns=True)
    return Qn.harmonise(own, *refs).where(F.col("doc_id") > FAR).withColumn("doc_id", F.col("doc_id") - FAR)


def test_harmonise_edges(spark):
    rows = [
        (1, "a loss of usd 4 million", [4e6], ["usd"]),
        (2, "a loss of usd 4 million", [4.0], ["usd"]),
        (3, "body weight of 5 kg and 3 cartridges", [5.0, 3.0], [None, "cartridges"]),
        (4, None, [7.0, None, math.nan], ["hour"]),
        (5, "", None, None), (6, "x", [], []), (7, "core temperature of 50 °f", [50.0], ["fahrenheit"], None),
        (8, "old 3 kg", [3.0, 4.0], ["kg", "kg"], "a", 0), (8, "new 9 mg", [9.0], ["mg"], "a", 3),
        (9, "zero 0 kg", [0.0], ["kilogram"]), (10, "a " * 100_000 + "12 km", [12.0], [""]), (11, "2 kg", [2.0], ["kg", "mg"]),
        (12, "a term of 1 year", [1.0], ["year"]), (13, "a term of 2 months", [2.0], ["month"]),
    ]
    result = harmonise(spark, rows).persist()
    out = {(r.doc_id, r.pos): r for r in result.collect()}
    assert set(out) == {(1, 0), (2, 0), (3, 0), (3, 1), (4, 0), (7, 0), (8, 0), (9, 0), (10, 0), (11, 0), (12, 0), (13, 0)}
    assert out[3, 1].how == "foreign" and out[3, 1].base_value is None and out[7, 0].base_value == pytest.approx(10.0, abs=1e-4)
    got = {tuple(r) for r in Qn.converted(result).collect()}
    assert got == {
        (2, 0, "usd", "4.000e+06"), (3, 0, "gram", "5.000e+03"), (4, 0, "day", "2.917e-01"), (7, 0, "celsius", "1.000e+01"), (8, 0, "gram", "9.000e-03"), (10, 0, "metre", "1.200e+04"), (11, 0, "gram", "2.000e+03"),
        (12, 0, "day", "3.652e+02"), (13, 0, "day", "6.088e+01"),
    }


def test_without_a_model_missing_units_are_reviewed(spark):
    rows = [(1, "mass of 3 kg", [3.0], [None]), (2, "mass of 3 kg", [3.0], ["kg"])]
    alone = {r.doc_id: r for r in harmonise(spark, rows, trained=False).collect()}
    assert alone[1].how == "review" and alone[1].base_value == 3000.0
    assert {r.doc_id for r in Qn.converted(harmonise(spark, rows, trained=False)).collect()} == {2}


def test_harmonise_without_rows(spark):
    refs = [spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("unit_ref", "concept_ref")]
    assert Qn.harmonise(collection(spark, [(1, "x", [1.0], ["kg"])]).where("false"), *refs).count() == 0
    assert Qn.held_out_precision(collection(spark, [(1, "x", [1.0], ["kg"])]).where("false"), *refs).count() == 0


def test_the_classifier_decides(spark, monkeypatch):
    """Filled rows come from the model: without it none is left."""
    c, u, k = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("collection", "unit_ref", "concept_ref"))
    filled = lambda: Qn.converted(Qn.harmonise(c, u, k).where("how <> 'entry'")).count()
    assert filled() > 5
    monkeypatch.setattr(Qn.UnitClassifier, "predict", lambda self, rows, stated="stated": rows.withColumns({"predicted": F.lit(None).cast("int"), "confidence": F.lit(0.0)}))
    assert filled() == 0


def test_classifier_on_held_out_quantities(spark):
    """Units hidden from labelled quantities come out again: always where the sentence tells them, and mostly where the model is confident without."""
    c, u, k = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("collection", "unit_ref", "concept_ref"))
    out = Qn.held_out_precision(c, u, k).toPandas()
    told, silent = out[out.told], out[~out.told]
    sure = lambda x: x[x.confidence >= Qn.CONFIDENT]
    assert sure(told).right.sum() >= 0.999 * told.quantities.sum()
    assert silent.right.sum() > 0.4 * silent.quantities.sum()
    assert sure(silent).quantities.sum() > 30 and sure(silent).right.sum() >= 0.9 * sure(silent).quantities.sum()


def test_source_habits_fill_silent_sentences(spark):
    """Sources that always use one unit: with a silent sentence the model converts; where the sentence contradicts, the quantity is reviewed."""
    rows = [(i, "a report of no words for it", [float(1 + i % 90)], ["kg" if i % 2 else "km"], f"s{i % 2}") for i in range(400)]
    rows += [(1000 + i, "nothing said", [5.0], [None], f"s{i % 2}") for i in range(20)] + [(2000, "it came to 5 mg", [5.0], ["-"], "s1")]
    out = {r.doc_id: r for r in harmonise(spark, rows, trained=False).collect()}
    assert all((out[1000 + i].how, out[1000 + i].unit) == ("model", ("kilometre", "kilogram")[i % 2]) for i in range(20))
    assert out[2000].how == "review"


def test_isotonic_rates_rise():
    rng = np.random.default_rng(1)
    s = rng.random(2000)
    at, rate = Qn.isotonic(s, (rng.random(2000) < s).astype(float))
    assert (np.diff(rate) > 0).all() and (np.diff(at) > 0).all() and abs(rate[np.searchsorted(at, 0.5) - 1] - 0.5) < 0.15


# --- independence of the layout ----------------------------------------------------------------------------------


def test_results_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SMALL}/collection.parquet").select("doc_id", T.simple_tokens(F.col("sentence")).alias("terms")).dropDuplicates(["doc_id"])
    q = spark.read.parquet(f"{SMALL}/queries.parquet").select("qid", T.simple_tokens(F.col("keywords")).alias("terms"))
    want = None
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n, shuffle in ((1, 3), (9, 7)):
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        got = sorted(tuple(r) for r in LexicalIndex.build(docs.repartition(n)).rank(q.repartition(n), 5).select("qid", "rank", "doc_id", F.round("score", 9)).collect())
        assert want is None or got == want
        want = got
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_invariants_of_scores(spark):
    df = spark.createDataFrame([(c, float(v), float(a), float(b)) for c in ("=", ">", "<", "<<", "?") for v in (-3, 0, 0.5, 7, 1e9) for a in (0, 2, 9) for b in (3, 12)], "c string, v double, a double, b double")
    for mode in ("ratio", "expo"):
        for r in df.select("c", "v", N.kernel(F.col("c"), F.col("v"), F.col("a"), F.col("b"), mode).alias("k")).collect():
            assert (0 <= r.k <= 1 if r.v >= 0 else True) and (r.c != "?" or r.k == 0)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_kmeans_search_recall(spark, size):
    from quantmill.plans import core_queries as C

    d = f"/root/testdata/{size}"
    best = late.top_passages(late.maxsim(C._tokens(spark, d), C._query_tokens(spark, d)), 10)
    want = {(r.qid, r.pid) for r in best.collect()}
    got = {(r.qid, r.pid) for r in C.kmeans_search(spark, d).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_every_corpus_sentence_can_be_drawn(spark):
    corpus = spark.range(20_000).select(F.format_string("s%05d", "id").alias("sentence"))
    sampled = spark.range(100_000).select(
        F.lit("k").alias("keyword"), F.lit("u").alias("unit"), F.lit("=").alias("condition"), F.col("id").cast("double").alias("pivot"), F.format_string("p%d", "id").alias("sentence"), F.lit("pos").alias("side")
    )
    drawn = G.with_corpus_sentences(sampled, corpus).where("side = 'neg'").select("sentence")
    assert drawn.count() == 100_000
    assert drawn.distinct().count() > 19_000
