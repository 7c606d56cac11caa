import math
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from conftest import SMALL
from harness import connect, differences
from llm import brute
from quantmill.llm import leaks, mapping, mixing, splitting, tokens, topn, words as W
from quantmill.llm.fm import FMIndex, Wavelet, suffix_array
from quantmill.llm import queries as Q


# --- top n -------------------------------------------------------------------------------------------------------


def best(rows, n):
    by = {}
    for g, i, s in rows:
        if g is None or i is None or s is None or math.isnan(s):
            continue
        d = by.setdefault(g, {})
        d[i] = max(d.get(i, -math.inf), s)
    return {(g, k + 1, i) for g, d in by.items() for k, (i, _) in enumerate(sorted(d.items(), key=lambda x: (x[1], x[0].encode()), reverse=True)[:n])}


def test_top_n_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topn, "HOLD", 50)
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice([None, *(f"d{i}" for i in range(60))]), rng.choice([None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1.5, 2.0, rng.random()])) for _ in range(3000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "q string, item string, s double, rank int, g string").repartition(5)
    got = topn.top_n(df, "q", "item", "s", 7).collect()
    assert {(r.q, r["rank"], r.item) for r in got} == best(rows, 7) and len(got) == len(best(rows, 7))
    monkeypatch.setattr(topn, "InternalFunction", None)
    assert {(r.q, r["rank"], r.item) for r in topn.top_n(df, "q", "item", "s", 7).collect()} == best(rows, 7)
    assert topn.top_n(df.where("false"), "q", "item", "s", 7).count() == 0


def test_partial_heap_is_mergeable():
    rng = random.Random(2)
    rows = [("g", f"d{rng.randrange(30)}", float(rng.randrange(10))) for _ in range(500)]
    t = lambda rs: pa.table({"g": [r[0] for r in rs], "item": [r[1] for r in rs], "score": [r[2] for r in rs]})
    whole = topn.best(t(rows), 5)
    merged = topn.best(pa.concat_tables([topn.best(t(rows[i::4]), 5) for i in range(4)]), 5)
    assert whole.to_pylist() == merged.to_pylist()


# --- leaks -------------------------------------------------------------------------------------------------------


def test_suffix_array_and_wavelet():
    rng = np.random.default_rng(1)
    text = np.append(0, rng.integers(0, 4, 500))
    sa = suffix_array(text)
    key = lambda i: [(0, j) if text[j] == 0 else (1, text[j]) for j in range(i, min(len(text), i + 60))]
    assert sa.tolist() == sorted(range(len(text)), key=key)
    w = Wavelet(text, 4)
    at = rng.integers(0, len(text) + 1, 200)
    for c in range(4):
        assert w.rank(np.full(200, c), at).tolist() == [int((text[:i] == c).sum()) for i in at]
    assert (w.get(np.arange(len(text))) == text).all()


def test_fm_index_locates_all_occurrences():
    rng = np.random.default_rng(2)
    text = np.concatenate([np.append(0, rng.integers(1, 4, rng.integers(1, 40))) for _ in range(40)])
    index = FMIndex(text, 4)
    for length in (1, 2, 5):
        p = rng.integers(1, 4, (30, length))
        lo, hi = index.search(p, np.full(30, length))
        for row, a, b in zip(p, lo, hi):
            want = [i for i in range(len(text) - length + 1) if (text[i : i + length] == row).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


@pytest.mark.parametrize("shard", [50, 2_000_000])
def test_leaks_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(leaks, "SHARD", shard)
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([3, 12, 13, 14, 40])))) for i in range(30)]
    items += [(99, None), (98, ""), (97, "..."), (96, items[0][1]), (None, items[1][1])]
    docs = []
    for d in range(60):
        w = [f"w{rng.randrange(60)}" for _ in range(80)]
        for _ in range(rng.randrange(3)):
            s = brute.words(items[rng.randrange(30)][1])
            k = rng.randrange(len(s))
            at = rng.randrange(len(w))
            w[at:at] = s[k : k + rng.randrange(10, 20)]
        docs.append((d, ", ".join(w).upper()))
    docs += [(100, None), (101, ""), (102, " ".join(x for _, t in items[:30] for x in brute.words(t)) * 30)]
    df = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, spans string")
    it = spark.createDataFrame([(*r, 1) for r in items], "item_id long, item_text string, doc_id int")
    out = leaks.leaked_items(df, it).collect()
    assert {(r.doc_id, r.item_id) for r in out} == brute.leaks(docs, items)
    for r in out[:50]:
        w = brute.words(dict(docs)[r.doc_id])
        for s in r.spans:
            assert 0 <= s["first"] < s["end"] <= len(w) and set(w[s["first"] : s["end"]]) <= set(brute.words(dict(items)[r.item_id]))
    assert leaks.leaked_items(df.where("false"), it).count() == 0
    assert leaks.leaked_items(df, it.where("false")).count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 7)
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/eval_items.parquet").select("item_id", "item_text").collect()][:20]
    got = leaks.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute.leaks(docs, items)


def test_one_index_for_many_batches(spark, monkeypatch):
    """A task's batches are gathered to one shard, and all blocks of items are searched in one reading."""
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 5)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(15))) for i in range(12)]
    phrases = [leaks.Phrases.of([i for i, _ in items], [t for _, t in items])]
    shards = leaks.Shards(phrases[0])
    for n in range(7):
        shards.add(*W.words(pa.array([f"some text {items[n][1]} of it", "none"])), 2 * n)
    shards.close()
    assert shards.indexed == 1
    text, item, first, length = shards.found()
    assert set(zip(text.tolist(), item.tolist())) == {(2 * n, n) for n in range(7)} and set(first.tolist()) == {2, 3, 4} and set(length.tolist()) == {13}
    docs = [(d, f"x {items[d % 12][1]} y {items[(d + 1) % 12][1]}") for d in range(300)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        out = leaks.leaked_items(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, item_text string"))
        assert {(r.doc_id, r.item_id) for r in out.collect()} == brute.leaks(docs, items)
        assert out._jdf.queryExecution().toString().count("MapInArrow") <= 4
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_found_leaks_on_the_small_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/eval_items.parquet").select("item_id", "item_text").collect()]
    assert {tuple(r) for r in Q.p6_found(spark, SMALL).select("doc_id", "item_id").collect()} == brute.leaks(docs, items)


def test_merge_spans():
    z = np.array
    doc, item, first, end = leaks.merge_spans(z([1, 1, 1, 2, 1]), z([5, 5, 5, 5, 6]), z([0, 1, 30, 0, 0]), z([13, 13, 13, 13, 4]))
    assert list(zip(doc.tolist(), item.tolist(), first.tolist(), end.tolist())) == [(1, 5, 0, 14), (1, 5, 30, 43), (1, 6, 0, 4), (2, 5, 0, 13)]


# --- mapping -----------------------------------------------------------------------------------------------------


def jaccard(a, b):
    x, y = set(a), set(b)
    return Fraction(len(x & y), len(x | y)) if x | y else Fraction(0)


def test_mapping_equals_all_pairs(spark):
    rng = random.Random(6)
    names = [r.concept for r in spark.read.parquet(f"{SMALL}/concept_ref.parquet").collect()]
    values = set()
    for _ in range(400):
        w = list(rng.choice(names))
        for _ in range(rng.randrange(0, 5)):
            i = rng.randrange(len(w))
            w[i : i + rng.randrange(2)] = rng.choice("abcdefg ")
        values.add("".join(w))
    values |= {"", "   ", "zzz", "net", names[0].upper(), " ".join(reversed(names[1].split())), "é" + names[2], "x" * 5000}
    df = spark.createDataFrame([("k", v) for v in values] + [("k", None)], "kind string, value string").distinct()
    ref = spark.createDataFrame([("k", n, n) for n in names + names[:3]], "kind string, form string, ref_name string")
    got = {r.value: (r.ref_name, r.similarity) for r in mapping.match(df, ref, {"k": frozenset()}).collect()}
    sets = {n: mapping.tokens(mapping.normal_form(n)) for n in names}
    for v in values:
        t = mapping.tokens(mapping.normal_form(v))
        top = max(jaccard(t, s) for s in sets.values())
        if top >= Fraction(mapping.SIM_NUM, mapping.SIM_DEN):
            assert v in got and abs(got[v][1] - float(top)) < 1e-9 and jaccard(t, sets[got[v][0]]) == top, v
        else:
            assert v not in got, (v, got.get(v))


def test_mapping_to_many_names(spark):
    """A list of 200,000 names, joined without a broadcast: every slip finds its name, or one that is as near."""
    rng = random.Random(7)
    parts = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(3)) for _ in range(700)]
    names = sorted({f"{rng.choice(parts)} {rng.choice(parts)}" for _ in range(230_000)})[:200_000]
    want = {}
    for n in rng.sample(names, 300):
        k = rng.randrange(1, len(n) - 1)
        want[n[:k] + rng.choice("xyz") + n[k + 1 :]] = n
    ref = spark.createDataFrame([("k", n, n) for n in names], "kind string, form string, ref_name string")
    values = spark.createDataFrame([("k", v) for v in want], "kind string, value string")
    got = {r.value: r for r in mapping.match(values, ref, {"k": frozenset()}).collect()}
    assert set(got) == set(want)
    for v, n in want.items():
        sets = [mapping.tokens(mapping.normal_form(x)) for x in (v, n, got[v].ref_name)]
        assert jaccard(sets[0], sets[2]) >= jaccard(sets[0], sets[1])


def test_mapping_of_units():
    scale = frozenset({"million", "millions", "mn", "k", "'000"})
    forms = {"MN USD": "usd", "usd, '000": "usd", "(%)": "%", "[metric tons]": "metric tons", "thousand": "thousand", "millions of us_dollars": "us dollars", "in mg/l.": "mg l", "ml\xa0": "ml", "million": ""}
    for typed, want in forms.items():
        assert mapping.normal_form(typed, scale) == want


def test_mapped_entries(spark):
    data = [("k", v, 1) for v in ("alpha", "Alpha", "alpah beta", "-", " ", "", "quite other", "alpha")] + [("k", None, 2)]
    rows = spark.createDataFrame(data, "kind string, value string, similarity_ int")
    ref = spark.createDataFrame([("k", "alpha", "alpha"), ("k", "alpha beta", "ab")], "kind string, form string, ref_name string")
    exact = spark.createDataFrame([("k", "alpha")], "kind string, value string")
    got = sorted((r.value, r.ref_name) for r in mapping.map_entries(rows, ref, exact, {"k": frozenset()}).collect())
    assert got == [("Alpha", "alpha"), ("alpah beta", "ab"), ("quite other", "none")]
    assert mapping.map_entries(rows.where("false"), ref, exact, {"k": frozenset()}).count() == 0
    assert {r.ref_name for r in mapping.map_entries(rows, ref.where("false"), exact, {"k": frozenset()}).collect()} == {"none"}


# --- mixing ------------------------------------------------------------------------------------------------------


def test_raking_meets_shares_and_limits():
    rng = np.random.default_rng(3)
    cells = pd.DataFrame([(s, l, t, int(rng.integers(100, 5000)), 1) for s in "abcd" for l in ("en", "fr") for t in ("x", "y")], columns=["source", "lang", "topic", "tokens", "documents"])
    total = float(cells.tokens.sum())
    targets = pd.DataFrame([("a", 0.5, 9), ("b", 0.05, 1), ("c", 0.9, 1), ("zz", 0.1, 3)], columns=["source", "target_share", "max_uses"])
    out = mixing.rake(cells, targets, total)
    got = (out.weight * out.tokens).groupby(out.source).sum() / total
    own = cells.groupby("source").tokens.sum() / total
    assert abs(got["a"] - 0.5) < 1e-9 and abs(got["b"] - 0.05) < 1e-9 and abs(got["c"] - own["c"]) < 1e-9
    assert (out.weight <= out.max_uses + 1e-12).all() and (out.weight >= 0).all() and set(out.source) == {"a", "b", "c"}


def test_mix_outcomes(spark):
    docs = [(i, "one two three four five " * 20, s, None if i % 3 else "en", 0) for i, s in enumerate(["big"] * 60 + ["small"] * 20 + ["tiny"] * 4 + [None] * 6)]
    docs += [(1000, None, "big", "en", 0), (1001, "", "small", "en", 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, uses int")
    t = spark.createDataFrame([("big", 0.3, 1), ("small", 0.4, 3), ("tiny", 0.2, 2), ("absent", 0.1, 5), (None, 0.1, 1)], "source string, target_share double, max_uses int")
    c = spark.createDataFrame([("two three", "a")], "concept string, topic string")
    m = mixing.Mix(d, t, c)
    got = {r.source: r for r in m.shares().collect()}
    assert {s: r.outcome for s, r in got.items()} == {"big": "within", "small": "repeated", "tiny": "capped", "absent": "capped"}
    uses = m.documents().collect()
    limit = {"big": 1, "small": 3, "tiny": 2}
    assert all(1 <= r.uses <= limit[r.source] for r in uses) and len({r.doc_id for r in uses}) == len(uses)
    assert all(r.uses == 2 for r in uses if r.source == "tiny")
    assert abs(got["small"].sampled_share - 0.4) < 0.1
    empty = mixing.Mix(d.where("false"), t, c).shares().collect()
    assert {r.outcome for r in empty} <= {"capped", "within"}


def test_raking_as_a_table_equals_raking_in_memory(spark, monkeypatch):
    rng = random.Random(9)
    docs = [(i, rng.choice(["bond yield ", "body weight ", "none of it "]) * rng.randrange(5, 30), rng.choice("aabc"), rng.choice(["en", "fr", None])) for i in range(300)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    c = spark.createDataFrame([("bond yield", "finance"), ("body weight", "clinical")], "concept string, topic string")
    t = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.3, 1), ("zz", 0.1, 2)], "source string, target_share double, max_uses int")
    monkeypatch.setattr(mixing, "ROUNDS", 2)
    near = mixing.Mix(d, t, c)
    monkeypatch.setattr(mixing, "MAX_CELLS", 3)
    far = mixing.Mix(d, t, c)
    weights = [{(r.source, r.lang, r.topic): r.weight for r in m.cells.collect()} for m in (near, far)]
    assert set(weights[0]) == set(weights[1]) and len(weights[0]) > 20 and all(abs(weights[0][k] - weights[1][k]) < 1e-6 for k in weights[0])
    assert [{r.source: r.outcome for r in m.shares().collect()} for m in (near, far)] == [{"a": "within", "b": "repeated", "c": "capped", "zz": "capped"}] * 2


def test_topics():
    c = (("bond yield", "finance"), ("body weight", "clinical"))
    assert mixing.topic_of("BOND YIELD, bond yield and body weight", c) == "finance"
    assert mixing.topic_of("body weight bond yield", c) == "clinical" and mixing.topic_of(None, c) == "other"
    assert mixing.topic_of("antibody weights, bond yields", c) == "other" and mixing.topic_of("(bond yield)", c) == "finance"


def test_marginals_are_reached_and_reported(spark):
    """With room in the limits, languages and topics keep their shares; without, the report shows by how much they miss them."""
    rng = random.Random(5)
    docs = [(i, rng.choice(["bond yield here ", "body weight here "]) * 10, rng.choice("ab"), rng.choice(["en", "fr"])) for i in range(400)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    c = spark.createDataFrame([("bond yield", "finance"), ("body weight", "clinical")], "concept string, topic string")
    t = spark.createDataFrame([("a", 0.8, 5), ("b", 0.2, 1)], "source string, target_share double, max_uses int")
    got = {(r.side, r.name): r for r in mixing.Mix(d, t, c).marginals().collect()}
    assert len(got) == 6 and all(abs(r.wanted_share - r.reached_share) < 1e-6 for r in got.values())
    # raking decides: without it the shares of the languages would follow the sources
    cells = pd.DataFrame([("a", "en", "x", 900, 1), ("a", "fr", "x", 100, 1), ("b", "en", "x", 100, 1), ("b", "fr", "x", 900, 1)], columns=["source", "lang", "topic", "tokens", "documents"])
    out = mixing.rake(cells, pd.DataFrame([("a", 0.8, 9), ("b", 0.2, 9)], columns=["source", "target_share", "max_uses"]), 2000.0)
    by = (out.weight * out.tokens).groupby(out.lang).sum()
    assert abs(by["en"] - by["fr"]) < 1e-6 * by.sum()


# --- splitting ---------------------------------------------------------------------------------------------------

TEXTS = {
    "letters": "x" * 30_000,
    "words": "word " * 4000,
    "paragraphs": "\n\n".join(f"Sentence {i} is here. Another one follows!" for i in range(500)),
    "markup": "".join(f"<h2>Title {i}</h2><p>{'some text of it ' * 30}</p>" for i in range(60)),
    "wide": "日本語のテキスト" * 900,
    "blanks": " " * 6000,
    "lines": "a\n" * 4000,
    "mixed": "".join(chr(random.Random(1).randrange(32, 3000)) for _ in range(10)) * 700,
}


@pytest.mark.parametrize("name", TEXTS)
def test_pieces_cover_the_text(name):
    text = TEXTS[name]
    total = tokens.count(text)
    pieces = splitting.split_text(text)
    ids = tokens.encode(text)
    assert (len(pieces) == 1) == (total <= 1000)
    assert all(tokens.count(p.text) == p.tokens <= 1000 for p in pieces)
    enc, size = tokens.encoder()
    at = np.append(0, np.cumsum(size[np.array(ids)]))
    raw, done = text.encode(), 0
    for k, p in enumerate(pieces):
        start = int(at[p.first])
        body = p.text.encode()
        assert raw[start : start + len(body)] == body
        if k:
            assert start < done and np.searchsorted(at, done) - p.first in range(50, 54)
        assert start + len(body) > done
        done = start + len(body)
    assert done == len(raw)


def test_cuts_are_natural():
    pieces = splitting.split_text(TEXTS["paragraphs"])
    assert all(p.text.rstrip().endswith(("!", ".")) for p in pieces)


def test_parts_have_the_tokens_of_the_whole(monkeypatch):
    text = "Some text, with words; and numbers 12 345 " * 200
    whole = tokens.encoder()[0].encode_ordinary(text)
    monkeypatch.setattr(tokens, "PART", 500)
    assert len(tokens.parts(text)) > 5 and tokens.encode(text) == whole


def test_long_white_space_has_the_tokens_of_the_whole(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice([" ", " ", "\n", "\t", "\r", "\xa0", "\x1c", "a", "7", "."]) * rng.randrange(1, 12) for _ in range(40)) for _ in range(300)]
    texts += [" " * 900, "\n" * 900 + "x", "a" + " \n" * 700 + " b", "\t" * 500, " x" + " " * 777 + "\ny"]
    whole = [tokens.encoder()[0].encode_ordinary(t) for t in texts]
    monkeypatch.setattr(tokens, "BLANKS", 3)
    assert [tokens.encode(t) for t in texts] == whole


def test_extreme_texts():
    for t in (" " * 300_000, "\n" * 50_000 + "x" * 50_000, "1 2 3 " * 50_000):
        ids = tokens.encode(t)
        assert int(tokens.encoder()[1][np.array(ids)].sum()) == len(t.encode())
        assert "".join(p.text for p in splitting.split_text(t, overlap=0)) == t


def test_split_documents(spark):
    rows = [(1, None, "p"), (2, "", "p"), (3, "short", "p"), (4, TEXTS["words"], "p"), (4, TEXTS["words"], "p"), (5, TEXTS["letters"], "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    out = splitting.split_documents(df).collect()
    assert {r.doc_id for r in out} == {i for i, t, _ in rows if t and tokens.count(t) > 1000}
    four = [r for r in out if r.doc_id == 4]
    assert len(four) == 2 * four[0].pieces
    assert splitting.split_documents(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        splitting.split_text("x", limit=60, overlap=50)


def test_long_documents_of_the_small_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert {r.doc_id for r in Q.p8_found(spark, SMALL).collect()} == {r.doc_id for r in docs if tokens.count(r.text) > 1000}


# --- registered queries ------------------------------------------------------------------------------------------


def test_sql_of_the_queries(spark):
    c = connect(SMALL)
    for name, sql in Q.oracle_sql().items():
        assert not differences(Q.queries()[name](spark, SMALL), sql, c), name


def test_all_queries_have_the_defined_columns(spark):
    want = {
        "p2_found": ["field", "rec_id", "pos", "ref_name"], "p3_found": ["tab", "id_a", "id_b"], "p4_found": ["doc_id_a", "doc_id_b"], "p5_found": ["q_id", "rank", "doc_id"],
        "p6_found": ["doc_id", "item_id"], "p7_found": ["source", "outcome"], "p8_found": ["doc_id"],
    }
    for name, columns in want.items():
        df = Q.queries()[name](spark, SMALL)
        assert df.columns == columns and df.count() == df.distinct().count() > 0, name
