"""Units whose semantics the oracle tables don't reach: folds, ladders, streams, sources."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from stackroom.functions import providers as P
from stackroom.functions import python as py
from stackroom.functions import text as T
from stackroom.operators import budgets as B
from stackroom.operators import linking as L
from stackroom.operators import search as S
from stackroom.operators import structure as ST
from stackroom.operators.references import bibliography_entries
from stackroom.sources import records as R
from stackroom.streaming import jobs as J


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("It is 3.5 e.g. here. Next [E1]. Then", ["It is 3.5 e.g. here.", "Next [E1].", "Then"]),
        ("Claim one. [E1] Claim two. [E2]", ["Claim one. [E1]", "Claim two. [E2]"]),
        ("[E1] leads. More", ["[E1] leads.", "More"]),
        ("我们。采用！", ["我们。", "采用！"]),
        ("", []),
    ],
)
def test_sentences(spark, text, want):
    assert one(spark, T.split_sentences(F.col("s")), text) == want


def test_nulls_stay_null(spark):
    for f in (T.tokens, T.snippet_of, T.canonical_source_text, T.estimate_tokens, T.normalize_unit):
        assert one(spark, f(F.col("s")), None) is None


def test_statistics_are_outside_the_scope(spark):
    ch = spark.createDataFrame([(1, "t", "red blue", "a"), (2, "t", "red", "b"), (3, "t", "green", "b"), (4, "t", "grey", "b")], "chunk_id long, title string, text string, section string")
    v = spark.createDataFrame([("v", "red")], "variant string, word string")
    every = {r["chunk_id"]: r["score"] for r in S.bm25(ch, v).collect()}
    scoped = {r["chunk_id"]: r["score"] for r in S.bm25(ch, v, F.col("section") == "b").collect()}
    assert set(every) == {1, 2} and set(scoped) == {2} and scoped[2] == pytest.approx(every[2])


def test_empty_allow_list_allows_nothing(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    q = F.array(F.lit(1.0), F.lit(0.0))
    assert S.dense_top_k(v, q).count() == 2
    assert S.dense_top_k(v, q, allowed=v.where("false").select("id")).count() == 0


def test_paragraphs_survive_short_marks_but_not_figures(spark):
    b = spark.createDataFrame([(1, 0, 1, "plain text", "An unfinished"), (1, 1, 1, "plain text", "7"), (1, 2, 1, "plain text", "line goes on"), (1, 3, 1, "figure", ""), (1, 4, 2, "plain text", "and stops")], "doc int, pos int, page int, layout string, text string")
    assert sorted(r["text"] for r in ST.assemble_paragraphs(b).collect()) == ["An unfinished line goes on", "and stops"]


def test_as_of_is_strict(spark):
    p = spark.createDataFrame([(1, 0), (1, 5), (1, 6)], "doc int, pos int")
    h = spark.createDataFrame([(1, 0, "a"), (1, 5, "b")], "doc int, pos int, section string")
    assert {r["pos"]: r["section"] for r in ST.assign_sections(p, h).collect()} == {0: None, 5: "a", 6: "b"}


def test_two_columns_are_read_one_after_the_other(spark):
    rows = [(1, 1, 0, "title", 0.0, 600.0, 0.0), (1, 1, 1, "plain text", 310.0, 600.0, 20.0), (1, 1, 2, "plain text", 0.0, 290.0, 20.0), (1, 1, 3, "plain text", 0.0, 290.0, 40.0), (1, 1, 4, "abandon", 0.0, 50.0, -10.0)]
    order = lambda rows: [r["pos"] for r in ST.reading_order(spark.createDataFrame(rows, "doc int, page int, pos int, layout string, x0 double, x1 double, y0 double")).orderBy("rank").collect()]
    assert order([*rows, (1, 1, 5, "plain text", 310.0, 600.0, 40.0)]) == [0, 2, 3, 1, 5, 4]
    # too few blocks for two columns are read by their height
    assert order(rows) == [0, 2, 1, 3, 4]


def test_reattach_ladder(spark):
    p = spark.createDataFrame([(1, "h1", 1, 1, "alpha beta gamma"), (2, "h2", 1, 1, "beta beta"), (3, "h3", 1, 2, "part")], "id int, anchor string, doc int, page int, text string")
    t = spark.createDataFrame([("a", "h1", 1, 1, "x"), ("b", "no", 1, 1, "gamma"), ("c", "no", 1, 1, "beta"), ("d", "no", 1, 2, "a part of it"), ("e", "no", 1, 2, "gamma"), ("f", "no", 1, 1, "")], "target string, anchor string, doc int, page int, quote string")
    assert {r["target"]: r["state"] for r in ST.reattach(t, p).collect()} == {"a": "EXACT", "b": "REATTACHED", "c": "AMBIGUOUS", "d": "REATTACHED", "e": "ORPHANED", "f": "ORPHANED"}


def test_a_row_larger_than_the_limit_is_a_batch_of_its_own(spark):
    r = spark.createDataFrame([(1, i, c) for i, c in enumerate([9000, 10, 9000, 10])], "doc int, pos int, chars int")
    assert [x["batch"] for x in B.greedy_batches(r).orderBy("pos").collect()] == [1, 2, 3, 4]


def test_containment_finds_needles_without_inner_words(spark):
    n = spark.createDataFrame([(1, "abcdefgh"), (2, "ends with words here"), (3, "short")], "i int, text string")
    h = spark.createDataFrame([(1, "xx abcdefghij"), (2, "it ends with words hereabouts"), (3, None)], "j int, text string")
    assert sorted(map(tuple, L.contained_in(n, "i", h, "j").collect())) == [(1, 1), (2, 2)]


def test_bibliography(spark):
    e = bibliography_entries(spark.createDataFrame([(1, "[1] A [2] B cites [1] too [3] C"), (2, "text [1] x [2] y")], "id int, text string"))
    assert [(r["id"], r["text"]) for r in e.orderBy("id", "n").collect()] == [(1, "[1] A"), (1, "[2] B cites [1] too"), (1, "[3] C"), (2, "text [1] x [2] y")]


def test_python_functions(spark):
    assert one(spark, py.nfkc(F.col("s")), "ﬁ") == "fi" and one(spark, py.casefold(F.col("s")), "Straße") == "strasse"
    assert one(spark, py.fold_accents(F.col("s")), "Étude") == "Etude"
    assert one(spark, py.recover_json(F.col("s")), 'x {"a": [1, {"b": "}"}, {"c') == json.dumps({"a": [1, {"b": "}"}]})


def test_calls_keep_the_text_when_the_reply_fails_twice(spark):
    d = spark.createDataFrame([("a {v0} b",), (None,)], "text string")
    assert [r["reply"] for r in P.call(d, lambda t: "lost", ok=lambda t, r: "{v0}" in r).collect()] == ["a {v0} b", None]


def test_memo_asks_only_once(spark):
    d = spark.createDataFrame([("a b",), ("a b",), ("c d",)], "text string")
    out, memo = P.memoised(d, spark.createDataFrame([], "key string, reply string"), P.echo)
    assert memo.count() == 2 and sorted(r["reply"] for r in out.collect()) == ["b a", "b a", "d c"]
    again, memo2 = P.memoised(d, memo, lambda t: "never")
    assert sorted(r["reply"] for r in again.collect()) == ["b a", "b a", "d c"]


def test_stream_reply(spark):
    d = spark.createDataFrame([("abcdef",)], "t string").createOrReplaceTempView("replies")
    spark.udtf.register("stream_reply", P.StreamReply)
    assert [r["chunk"] for r in spark.sql("select r.* from replies, lateral stream_reply(t, 4) r order by seq").collect()] == ["abcd", "ef"]


def test_feed_ignores_braces_in_strings():
    got, scan = [], J.Scan()
    for c in ['{"works": [{"t": "}"', ', "u": 1}, {"t"', ": 2}, {broken", "}, {\"t\": 3}] trailing {"]:
        got += scan.feed(c)
    assert [json.loads(x) for x in got] == [{"t": "}", "u": 1}, {"t": 2}, {"t": 3}]


def test_streams_match_batches(spark, tmp_path):
    at = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(at).schema
    src = str(tmp_path / "in")
    spark.read.parquet(at).repartition(3).write.parquet(src)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = J.ledger_stream(s).writeStream.outputMode("complete").format("memory").queryName("ledger_out").start()
    q.processAllAvailable()
    q.stop()
    want = J.ledger_stream(spark.read.parquet(src)).collect()
    assert sorted(map(tuple, spark.sql("select * from ledger_out").collect())) == sorted(map(tuple, want))


def test_objects_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    for i, c in enumerate(['[{"a": 1}, {"a"', ": 2}]"]):
        spark.createDataFrame([("s", i, c)], "stream_id string, seq int, chunk string").coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema("stream_id string, seq int, chunk string").parquet(src)
    with J.typed_state(spark):
        q = J.objects(s).writeStream.outputMode("append").format("memory").queryName("objects_out").start()
        q.processAllAvailable()
    q.stop()
    assert [r["value"] for r in spark.sql("select * from objects_out order by n").collect()] == ['{"a": 1}', '{"a": 2}']


def test_resumable_job_does_missing_rows_once(spark, tmp_path):
    path = str(tmp_path / "sink")
    planned = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    run = J.resumable(spark, planned, path, lambda df: df.withColumn("t", F.col("id") * 10))
    batch = spark.createDataFrame([(1,), (2,), (9,)], "id int")
    run(batch, 0)
    run(batch, 0)
    run(spark.createDataFrame([(2,), (3,)], "id int"), 1)
    assert sorted(r["t"] for r in spark.read.parquet(path).collect()) == [10, 20, 30]


def test_archives_and_records(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("../evil.json", "{}")
        z.writestr("ok/x.json", '{"id": 1}')
    (tmp_path / "b.zip").write_bytes(b"no archive")
    got = R.read_archives(spark, str(tmp_path / "*.zip")).collect()
    assert [(r["member"], r["value"]) for r in got] == [("ok/x.json", '{"id": 1}')]
    (tmp_path / "r.json").write_text('{"id": 1}\nbroken\n{"id": 2}\n')
    assert sorted(r["id"] for r in R.read_records(spark, str(tmp_path / "r.json"), "id int").collect()) == [1, 2]
    assert R.fingerprints(spark, str(tmp_path / "a.zip")).first()["length"] == os.path.getsize(tmp_path / "a.zip")


def test_keyed_write_replaces_only_its_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    R.write_keyed(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), path, "k")
    R.write_keyed(spark.createDataFrame([("b", 3)], "k string, v int"), path, "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]


def test_top_k_is_limited_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 variant", "id chunk_id", "-id score")
    plan = S.top_k(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
