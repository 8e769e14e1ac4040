"""Streams of objects, parser trees, spans and title similarity against plain versions."""

import difflib
import json
import random

from pyspark.sql import functions as F

from stackroom.functions import spans
from stackroom.operators import linking
from stackroom.sources import records, trees
from stackroom.streaming import jobs


def test_objects_of_every_array_however_they_are_cut():
    text = 'See [1] and {this}: ```{"headings":[{"id":"h1"}],"meta":{"list":[{"id":"in object"}]},"paragraphs":[{"id":"p1","x":[{"y":"}] {"}]},[{"id":"nested"}],{"id":"p\\"2"}, {"cut": '
    want = [{"id": "h1"}, {"id": "in object"}, {"id": "p1", "x": [{"y": "}] {"}]}, {"id": "nested"}, {"id": 'p"2'}]
    for size in (1, 2, 7, len(text)):
        scan = jobs.Scan()
        got = [v for k in range(0, len(text), size) for v in scan.feed(text[k : k + size])]
        assert [json.loads(v) for v in got] == want
        assert scan.held == '{"cut": '
    assert jobs.Scan().feed('[{bad}, {"ok": 1}]') == ['{"ok": 1}'] and jobs.Scan().feed("") == []


def test_typed_state_survives_a_restart(spark, tmp_path):
    text = 'prose [2] {"headings": [{"a": "}] {"}], "paragraphs": [{"a": 2}, {"a": {"b": [{}]}}]}'
    chunks = [("s", i, text[k : k + 7]) for i, k in enumerate(range(0, len(text), 7))] + [("t", 1, "]"), ("t", 0, '[{"c": 1}')]
    batches = [chunks[5:9] + chunks[-1:], chunks[:2] + chunks[:1], chunks[2:5] + chunks[9:-1]]
    schema = "stream_id string, seq int, chunk string"
    (tmp_path / "in").mkdir()
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
        with jobs.typed_state(spark):
            jobs.landed(jobs.objects(src), f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()
    got = sorted((r["stream_id"], r["n"], r["value"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("s", 0, '{"a": "}] {"}'), ("s", 1, '{"a": 2}'), ("s", 2, '{"a": {"b": [{}]}}'), ("t", 0, '{"c": 1}')]
    batch = spark.createDataFrame([c for b in batches for c in b], schema)
    assert sorted((r["stream_id"], r["n"], r["value"]) for r in jobs.objects_batch(batch).collect()) == got


def test_state_ends_with_its_time(spark, tmp_path):
    schema = "user_id long, event_id long, ts timestamp, value double"
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    batches = [[(1, 1, at(0), 1.0), (2, 2, at(10), 2.0)], [(1, 3, at(1200), 3.0)], [(1, 4, at(5), 9.0), (2, 5, at(1300), 5.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "user_id long, event_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    with jobs.typed_state(spark):
        q = jobs.progress_within(src, 60_000, "30 seconds").writeStream.format("memory").queryName("progress_rows").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {tuple(r) for r in spark.sql("select user_id, value, late, expired from progress_rows").collect()}
    # a row behind the watermark is counted; a task that has been silent for longer than a minute is forgotten
    assert {(1, 1.0, 0, False), (2, 2.0, 0, False), (1, 3.0, 0, False), (1, 3.0, 1, False), (1, 3.0, 1, True), (2, 5.0, 0, False)} <= got and not any(v == 9.0 for _, v, _, _ in got)


def test_spans_of_all_kinds():
    two = [{"type": "text", "content": "a"}, {"type": "equation_inline", "content": "  "}, {"type": "text", "content": "b"}]
    assert spans.joined(two) == ("a b", [])
    link = [{"type": "hyperlink", "styles": ["bold", "wavy"], "content": [{"type": "text", "content": " x\t "}, {"type": "code_inline", "styles": ["bold", "italic"], "content": "y"}]}, {"type": "equation_inline", "content": " z "}, "stray", 7]
    assert spans.joined(link) == ("x y$z$".replace("y$", "y $"), [(0, 1, ["bold"]), (2, 3, ["bold", "italic", "code"])])
    assert spans.joined("  plain \t text ") == ("plain text", []) and spans.joined(None) == ("", []) and spans.joined([]) == ("", []) and spans.joined([{"content": " ", "styles": ["bold"]}]) == ("", [])
    wide = [{"content": "漢"}, {"type": "equation_inline", "content": "x"}, {"content": ", and"}]
    assert spans.joined(wide)[0] == "漢$x$, and"


def test_parser_dialects(spark):
    v4 = {"pages": [{"page_idx": 0, "blocks": [
        {"type": "doc_title", "content": [{"type": "text", "content": "T"}], "bbox": [0, 0, 1, 0.1]},
        {"type": "title", "content": "unknown kind"}, 7, None,
        {"type": "paragraph_title", "level": 1, "content": "First"}, {"type": "paragraph_title", "content": "No level"},
        {"type": "list", "bbox": [0, 0, 0.5, 0.5], "sub_type": "ref_text", "continues_prev": True, "content": [{"type": "list", "content": [{"type": "list", "content": [{"type": "text", "content": "deep"}]}]}, {"type": "text", "content": "one", "bbox": [0, 0, 1, 1]}]},
        {"type": "equation", "content": "E", "image_path": "e.png"},
        {"type": "code", "content": [{"type": "code_body", "content": "  x = 1"}, {"type": "code_caption", "content": [{"content": "L"}]}]},
        {"type": "code", "content": [{"type": "algorithm_body", "content": [{"content": "step"}]}]},
        {"type": "chart", "content": [{"type": "chart_body", "content": "?"}, {"type": "chart_footnote", "content": "note"}]},
        {"type": "index", "content": "hidden"}, {"type": "footer", "content": "7"},
    ]}, {"page_idx": -1, "blocks": [{"type": "text", "content": "off"}]}, "x"]}
    legacy = {"pdf_info": [{"page_idx": 1, "page_size": [306, 396], "para_blocks": [
        {"type": "text", "bbox": [1, 2, 3, 4], "lines": [{"spans": [{"content": "self-"}]}, {"spans": [{"type": "text", "content": "contained"}, {"type": "inline_equation", "content": "x"}, {"type": "odd", "content": "!"}]}, {"spans": []}, 3]},
        {"type": "table", "blocks": [{"type": "table_body", "lines": [{"spans": [{"html": "<table>", "image_path": "t.png"}]}]}]}, {"type": "list", "lines": [{"spans": [{"content": "lone"}]}]}],
        "discarded_blocks": [{"type": "header", "lines": [{"spans": [{"content": "H"}]}]}]}]}
    raw = spark.createDataFrame([("a", json.dumps(v4)), ("b", json.dumps(legacy)), ("c", "broken"), ("d", "[]"), ("e", None)], "id string, value string")
    got = {(r["id"], r["pos"]): r for r in records.blocks(raw).collect()}
    a = [got["a", i] for i in range(sum(k[0] == "a" for k in got))]
    assert [(r["kind"], r["text"], r["level"]) for r in a] == [("doc_title", "T", 1), ("heading", "First", 1), ("heading", "No level", None), ("ref", "deep", None), ("ref", "one", None), ("equation", "E", None), ("code", "  x = 1", None), ("figure_caption", "L", None), ("code", "step", None), ("figure", "", None), ("figure_caption", "note", None), ("abandon", "", None), ("abandon", "7", None)]
    assert [r["continues"] for r in a[3:5]] == [True, False] and a[3]["bbox"] == [0, 0, 306, 396] and a[4]["bbox"] == [0, 0, 612, 792] and a[6]["visual"] == a[7]["visual"] != a[8]["visual"] and a[5]["image_path"] == "e.png"
    b = [got["b", i] for i in range(sum(k[0] == "b" for k in got))]
    assert [(r["kind"], r["text"], r["html"]) for r in b] == [("text", "selfcontained $x$", None), ("table", "", "<table>"), ("text", "lone", None), ("abandon", "H", None)] and b[0]["bbox"] == [2, 4, 6, 8] and {k[0] for k in got} == {"a", "b"}
    assert {(r["key"], str(r["leaf"])) for r in trees.leaves(spark.createDataFrame([(1, '{"a": [{"b": 1}, [2]], "c": "x"}'), (2, "no")], "id int, value string")).select("key", F.to_json("leaf").alias("leaf")).collect()} == {("b", "1"), (None, "2"), ("c", '"x"')}


def test_titles_alike(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["deep", "residual", "learning", "of", "graphs", "transformer", "attention", "a", "image", "models"])
    works = [" ".join(word() for _ in range(rng.randrange(1, 7))) for _ in range(120)] + ["transformers", "abc", "ab", "abcd", "aaaa aaaa aaaa", "attention is all you need for very large language models today"]

    def typo(t):
        t = list(t)
        for _ in range(rng.randrange(0, 3)):
            k = rng.randrange(len(t))
            t[k : k + rng.randrange(0, 2)] = rng.choice(["x", "", "zz"])
        return "".join(t) or "q"

    asked = [typo(t) for t in works] + ["transformer", "abcde", "aaa aaaaa aaaa", "atention is al you need for very large languge models today"]
    want = {(i, j) for i, x in enumerate(asked) for j, y in enumerate(works) if difflib.SequenceMatcher(None, y, x).ratio() >= 0.88}
    left, right = spark.createDataFrame(list(enumerate(asked)), "l int, lt string"), spark.createDataFrame(list(enumerate(works)), "r int, rt string")
    assert {(r["l"], r["r"]) for r in linking.alike_titles(left, right).collect()} == want and len(want) > 120
    got = linking.identify(left.select(F.col("l").alias("qid"), F.col("lt").alias("title"), F.lit(None).cast("string").alias("doi")), right.select(F.col("r").alias("work"), F.col("rt").alias("title"), F.lit(None).cast("string").alias("doi"))).collect()
    like = lambda i, j: difflib.SequenceMatcher(None, works[j], asked[i]).ratio()
    assert {r["qid"]: r["work"] for r in got} == {i: min((-like(i, j), j) for k, j in want if k == i)[1] for i in {i for i, _ in want}}


def test_late_terms_come_once(spark, tmp_path):
    texts = spark.createDataFrame([(1, "a neural net"), (2, "networks only"), (3, "Nets and glossaries"), (4, None)], "id int, text string")
    path = f"file://{tmp_path}/done"
    texts.select("id", F.coalesce(F.upper("text"), F.lit("")).alias("done"), F.lit(0).alias("version")).where("id <> 3").write.parquet(path)
    calls = []

    def work(rows, v):
        ids = sorted(r["id"] for r in rows.collect())
        calls.append(ids)
        return rows.select("id", F.concat(F.lit("Netz "), "text").alias("done"))

    run = jobs.late_terms(spark, texts, path, work)
    term = lambda *x: spark.createDataFrame([x], "source string, target string, version int")
    for epoch in (0, 1):
        run(term("net", "Netz", 1), epoch)
    jobs.resumable(spark, texts, path, lambda t: t.select("id", F.lit("late Netz").alias("done"), F.lit(1).alias("version")))(texts, 2)
    run(term("glossary", "Glossar", 2), 3)
    run(term("glossaries", "Glossare", 3), 4)
    assert calls == [[1], [], [], [3]]
    assert sorted((r["id"], r["version"]) for r in jobs.newest(spark.read.parquet(path)).collect()) == [(1, 1), (2, 0), (3, 3), (4, 0)]


def test_units_by_their_rarest_words(spark):
    rng = random.Random(12)
    word = lambda: rng.choice("the of a in net deep x y z residual learning graph i k".split())
    text = lambda n: " ".join(word() for _ in range(n))
    paras = [(1, i, text(rng.randrange(1, 40))) for i in range(120)]
    units = []
    for i, (_, _, t) in enumerate(paras):
        w = t.split()
        cut = rng.randrange(0, 4)
        units.append((1, 3 * i, t[cut : len(t) - cut]))
        units.append((1, 3 * i + 1, " ".join([text(rng.randrange(0, 5)), t, text(rng.randrange(0, 5))])))
        rng.shuffle(w)
        units.append((1, 3 * i + 2, " ".join(w[: max(1, len(w) * 9 // 10)] + [word() for _ in range(2)])))

    def score(u, p):
        if u in p:
            return 1.0
        if p in u:
            return len(p) / len(u)
        a, b = set(u.split(" ")), set(p.split(" "))
        return len(a & b) / len(a)

    norm = {r["unit"]: r["t"] for r in spark.createDataFrame(units, "doc int, unit int, text string").select("unit", linking.T.normalize_unit(F.col("text")).alias("t")).collect()}
    want = {}
    for _, k, _ in units:
        if len(norm[k]) >= 40:
            s = [(score(norm[k], t), i) for _, i, t in paras]
            best = max(x for x, _ in s)
            hits = [i for x, i in s if x == best]
            want[k] = None if best < 0.8 or len(hits) > 1 else hits[0]
    got = linking.map_units(spark.createDataFrame(units, "doc int, unit int, text string"), spark.createDataFrame(paras, "doc int, paragraph int, text string")).collect()
    assert {r["unit"]: r["paragraph"] for r in got if len(norm[r["unit"]]) >= 40} == want and sum(v is not None for v in want.values()) > 20
