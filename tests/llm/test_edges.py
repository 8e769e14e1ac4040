"""Null, empty, long, tied and repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stackroom.llm import ann, bpe, chat, htmltext, jaccard, licenses, linededup, lm, packing, quality


def by_id(df, *cols):
    return sorted(((r["doc_id"], *[r[c] for c in cols]) for r in df.collect()), key=str)


def test_licenses(edge, none):
    got = by_id(licenses.scan(edge), "n_words", "places")
    assert (3, 0, []) in got and (4, 0, []) in got and (5, 0, []) in got and len(got) == edge.count()
    row = next(r for r in licenses.scan(edge).collect() if r["doc_id"] == 7)
    assert row["n_words"] == 6 and sorted((p["start"], p["label"]) for p in row["places"]) == [(0, "mit"), (4, "mit")]
    assert licenses.scan(none).count() == 0


def test_quality(edge, none):
    got = quality.judge(edge)
    assert got.count() == edge.count() and got.columns.count("n_words") == 1 and dict(got.dtypes)["n_words"] == "bigint"
    rows = {r["doc_id"]: r for r in got.where("doc_id is not null").collect()}
    assert rows[3]["n_words"] == 0 and rows[3]["base_failed"] and not rows[3]["kept"] and rows[6]["n_words"] == 60_000
    assert rows[1]["n_repeat_words"] == 80 and rows[1]["n_dup_lines"] == 3 and rows[1]["base_failed"]
    assert quality.judge(none).count() == 0 and quality.quality_filter(edge).columns == edge.columns


def test_line_dedup(edge, none):
    out = linededup.dedup_lines(edge, counts=True)
    assert out.count() == edge.count() and out.columns == [*edge.columns, "n_lines", "n_removed"]
    rows = {(r["doc_id"], i): r for i, r in enumerate(out.collect())}
    assert any(k[0] == 3 and r["text"] is None and r["n_lines"] == 0 for k, r in rows.items())
    assert linededup.dedup_lines(none).count() == 0


def test_jaccard(edge, none):
    got = by_id(jaccard.near_duplicates(edge), "n_shingles", "component_id")
    assert got.count(next(g for g in got if g[0] == 1)) == 2
    assert {g[0]: g[2] for g in got if g[0]} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}
    assert (3, 0, 3) in got and (None, 0, None) in got and len(got) == edge.count()
    assert jaccard.near_duplicates(none).count() == 0
    kept = jaccard.keep_one(edge)
    assert kept.columns == edge.columns and [r["doc_id"] for r in kept.collect()].count(1) == 1 and kept.where("doc_id = 2").count() == 0


def test_bpe(edge, none):
    path = bpe.default_path("byte_bpe_multi_50k.tiktoken")
    e = bpe.encode(edge.withColumn("ids", F.lit("clash")), path)
    d = bpe.decode(e.drop("char_starts", "char_ends"), path)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in d.collect()) and d.count() == edge.count()
    assert bpe.encode(none, path).count() == 0


def test_lm(edge, none):
    got = lm.score(edge)
    assert got.count() == edge.count() and got.where("score > 0 or n_tokens < 1").count() == 0
    assert got.where("doc_id = 3 and n_tokens = 1").count() == 1 and got.where("doc_id is null and not held_out").count() == 0
    assert lm.score(none).count() == 0


def test_packing(edge, none):
    p = packing.pieces(edge)
    assert p.where("doc_id = 3 and doc_tokens = 1").count() == 1
    assert packing.pieces(none).count() == 0
    got = p.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024")
    assert got.count() == 0


def test_html(spark, none):
    rows = [(1, None), (2, ""), (3, "<p>"), (4, "plain & simple"), (5, "<article>" + "<p>word the of and</p>" * 3000), (5, None)]
    out = htmltext.extract(spark.createDataFrame([(a, b, "clash") for a, b in rows], "page_id long, html string, text string"))
    got = [(r["page_id"], r["text"]) for r in out.collect()]
    assert out.columns == ["page_id", "html", "text"] and got[:3] == [(1, ""), (2, ""), (3, "")] and got[4][1].count("\n") == 2999 and got[5] == (5, "")
    assert htmltext.extract(none.select(F.col("text").alias("html"))).count() == 0


def test_chat(spark):
    rows = [(1, 0, "system", None), (1, 1, "user", "</s> a\\"), (1, 2, "assistant", "long " * 2000), (1, 2, "assistant", "tie"), (1, 2, "assistant", "tie"), (None, 0, None, "x"), (2, None, "odd\nrole\\n", "[INST] y")]
    t = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, window string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(t)).collect()}
    assert got[1]["n_turns"] == 5 and got[1]["loss_chars"] == 10_006 and got[None]["n_turns"] == 1
    import hashlib

    assert got[2]["turns_sha256"] == hashlib.sha256(b"odd\nrole\\n\n[INST] y\n").hexdigest()
    assert chat.format_chats(t.where("false")).count() == 0


def test_ann(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (100, [1.0, 0.0]), (9, [None, 1.0])]
    e = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string")
    got = [tuple(r) for r in ann.search(e, e.where("vec_id = 100")).orderBy("rank").collect()]
    assert [(g[1], g[2]) for g in got] == [(1, 1), (2, 2), (3, 3)] and got[0][3] == 0 and got[2][3] == pytest.approx(2**0.5)
    assert ann.search(e.where("false"), e.where("false")).count() == 0
    # most queries are of another length than most rows
    mixed = spark.createDataFrame([(i, [1.0, float(i), 2.0]) for i in range(1, 31)] + [(100 * i, [1.0, 2.0]) for i in range(1, 4)] + [(400, [1.0, 5.5, 2.0])], "vec_id long, embedding array<double>")
    got = ann.search(mixed, mixed.where("vec_id % 100 = 0")).collect()
    assert {r["query_id"] for r in got} == {400} and sorted(r["vec_id"] for r in got)[:2] == [1, 2] and len(got) == 10


def test_pipeline_stages(spark, edge, none):
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars")
    for d in (docs, none.select(*docs.columns)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, "unused")
            assert name == corpus_pipeline.STAGES[-1][0] or out.columns == d.columns
            out.count()


def test_no_folder_of_our_own_on_a_cluster():
    from types import SimpleNamespace as N

    from stackroom.llm import common

    session = lambda master, at=None: N(conf=N(get=lambda k, d=None: at), sparkContext=N(master=master, applicationId="app-1", getConf=lambda: N(get=lambda k: None)))
    for master in ("spark://h:7077", "yarn", "local-cluster[3,2,3000]", "k8s://x"):
        with pytest.raises(RuntimeError):
            common.shared_dir(session(master))
        assert common.shared_dir(session(master, "hdfs://x/y/")) == "hdfs://x/y/stackroom-app-1"
    assert common.shared_dir(session("local[8]")).endswith("/stackroom-app-1")
