import pytest
from pyspark.sql import functions as F

from quantmill.functions import text as T
from quantmill.operators import evaluate as E
from quantmill.sources import io
from quantmill.streaming import append


def test_collection_csv(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text(',sentence,normalized_sentence,values,units\n0," Sales of\n20 pct ",s,"[20.0, 5]","[\'percent\', \'-\']"\n1,"a ""quoted"" one",s,[],[]\n')
    rows = io.read_collection_csv(spark, str(p)).orderBy("doc_id").collect()
    assert rows[0].sentence == "Sales of\n20 pct" and rows[0]["values"] == [20.0, 5.0] and rows[0].units == ["percent", "-"]
    assert rows[1].sentence == 'a "quoted" one' and rows[1].units == []


def test_literals(spark):
    df = spark.createDataFrame([("['it''s', None]", "[[(0, 3)], [(5, 9), (1, 2)]]")], "a string, s string")
    r = df.select(io.list_literal(F.lit("['usd', None, 'x y']"), "array<string>"), io.spans_literal(F.col("s"))).first()
    assert r[0] == ["usd", None, "x y"] and [[tuple(p) for p in q] for q in r[1]] == [[(0, 3)], [(5, 9), (1, 2)]]


def test_queries_tsv(spark, tmp_path):
    p = tmp_path / "q.tsv"
    p.write_text("query_text\tkeywords\tunit\tvalue\tcondition\nfirst\ta b\tusd\t3\t>\nsecond\tc\t\t4.5\t=\n")
    rows = io.read_queries_tsv(spark, str(p)).orderBy("qid").collect()
    assert [(r.qid, r.value, r.condition, r.unit) for r in rows] == [(0, 3.0, ">", "usd"), (1, 4.5, "=", None)]
    p.write_text("query_text\tkeywords\tunit\tvalue\tcondition\nfirst\ta\tusd\t3\t?\n")
    with pytest.raises(Exception, match="unknown condition"):
        io.read_queries_tsv(spark, str(p)).collect()


def test_questions(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text('{"qid": 3, "question": "what"}\n{"qid": 3, "question": "again"}\n')
    df = io.read_questions(spark, str(p), check=False)
    assert df.count() == 2 and io.repeated_ids(df, "qid").first()["count"] == 2


def test_nested_json(spark, tmp_path):
    p = tmp_path / "run.json"
    p.write_text('{"1": {"a": 1.5, "b": 2}, "2": {}}')
    assert {tuple(r) for r in io.read_run_json(spark, str(p)).collect()} == {("1", "a", 1.5), ("1", "b", 2.0)}
    run = io.read_run_json(spark, str(p))
    io.write_nested_json(run, str(tmp_path / "out"))
    assert {tuple(r) for r in io.read_nested_json_lines(spark, str(tmp_path / "out")).collect()} == {("1", "a", 1.5), ("1", "b", 2.0)}
    q = tmp_path / "qrel.json"
    q.write_text('{"1": {"a": 1}}')
    assert E.evaluate(run, io.read_qrels(spark, {"s": str(q)}), ("MRR@10",)).first().value == 0.5


def test_ranking_and_index(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 1, 0.5), (1, 3, 2, 7.0)], "qid long, pid long, rank int, score double")
    io.write_ranking_tsv(df, str(tmp_path / "r"), {"k": 2})
    assert {tuple(r) for r in io.read_ranking_tsv(spark, str(tmp_path / "r")).collect()} == {(1, 2, 1, 0.5), (1, 3, 2, 7.0)}
    assert spark.read.text(str(tmp_path / "r_meta")).first().value == '{"k": 2}'
    io.write_index({"t": df}, str(tmp_path / "i"), sort={"t": "pid"})
    io.write_index({"t": df}, str(tmp_path / "i"), mode="reuse")
    t = io.read_index(spark, str(tmp_path / "i"), ["t"])["t"]
    assert t.count() == 2 and io.resume(df.unionAll(df.withColumn("pid", F.lit(9).cast("long"))), t, "pid").count() == 2


def test_stream_adds_each_document_once(spark, tmp_path):
    src, index, ck = (str(tmp_path / x) for x in ("src", "index", "ck"))
    docs = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string")
    docs.coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema(docs.schema).parquet(src)
    append.append_stream(stream(), index, ck).awaitTermination()
    docs.union(spark.createDataFrame([(3, "c a")], docs.schema)).coalesce(1).write.mode("append").parquet(src)
    append.append_stream(stream(), index, ck).awaitTermination()
    append.append_stream(stream(), index, ck + "2").awaitTermination()
    got = {tuple(r) for r in append.read_postings(spark, index).collect()}
    assert got == {("a", 1, 2), ("b", 1, 1), ("b", 2, 1), ("c", 3, 1), ("a", 3, 1)}


def test_analysers(spark):
    df = spark.createDataFrame([("The prices <num> of Café's 20% oil, rose!",), (None,)], "s string")
    rows = df.select(T.content_tokens(F.col("s")), T.keyword_tokens(F.col("s")), T.clean(F.col("s"))).collect()
    assert rows[0][0] == ["price", "cafe", "'s", "20", "%", "oil", "rose"] and rows[1][0] == [] and "Cafe's" in rows[0][2]


def test_rows_are_numbered_by_their_place(spark, tmp_path):
    """Also where a file is read in blocks by several tasks."""
    p = tmp_path / "many.tsv"
    n = 5000
    p.write_text("query_text\tkeywords\tunit\tvalue\tcondition\n" + "".join(f"text of query {i} {'x' * (i % 50)}\tk{i}\tkg\t{i}.0\t>\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        rows = io.read_queries_tsv(spark, str(p)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.qid, r.value) for r in rows) == [(i, float(i)) for i in range(n)]


def test_ids_must_be_unique(spark, tmp_path):
    p = tmp_path / "q.tsv"
    p.write_text("1\ta\n2\tb\n1\tc\n")
    with pytest.raises(ValueError, match="not unique"):
        io.read_questions(spark, str(p))
    assert io.read_questions(spark, str(p), check=False).count() == 3


def test_collections_and_typed_rankings(spark, tmp_path):
    p = tmp_path / "c.tsv"
    p.write_text("0\tone\n1\ttwo\n")
    want = [(0, "one"), (1, "two")]
    for source in (str(p), ["one", "two"], spark.createDataFrame(want, "pid int, text string")):
        assert sorted(map(tuple, io.passages(spark, source).collect())) == want
    with pytest.raises(ValueError):
        io.passages(spark, "c.jsonl")
    ranking = spark.createDataFrame([(1, 5, 1, 0.5), (1, 6, 2, 0.25)], "qid long, pid long, rank int, score double")
    io.write_ranking(ranking, str(tmp_path / "r"))
    io.write_ranking_tsv(ranking, str(tmp_path / "r.tsv"))
    for name in ("r", "r.tsv"):
        back = io.read_ranking(spark, str(tmp_path / name))
        assert back.dtypes == ranking.dtypes and sorted(map(tuple, back.collect())) == sorted(map(tuple, ranking.collect()))
